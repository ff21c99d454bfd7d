"""P4's previous ranks against a ranking in Python, with ties and SKUs that the previous window lacks."""

import pytest
from pyspark.sql import functions as F

from orderlens.operators import compare
from orderlens.plans.catalog import cmp_request
from orderlens.plans.request import previous_window
from orderlens.sources.history import history_lines
from orderlens.sources.tables import order_lines

from paths import SF_SMALL

SKU = "canonical_sku_normalized"


@pytest.mark.parametrize("amount", ["total_amount", "0"])   # 0: every SKU ties
def test_previous_ranks_equal_a_plain_ranking(spark, amount):
    # one SKU in three has no rows before the current window
    later = F.col("order_date") >= F.lit(previous_window(cmp_request())[0])
    history = (history_lines(order_lines(spark, SF_SMALL)).where(later | (F.crc32("sku") % 3 != 0))
               .withColumn("total_amount", F.floor(F.expr(amount) / 20000).cast("double")))
    per = compare._two_window_sums(history, cmp_request(), SKU, "total_amount")[0].collect()
    now = sorted((r for r in per if r.cur_rows), key=lambda r: (-r.cur, r[SKU]))[:25]
    before = [r[SKU] for r in sorted((r for r in per if r.prev_rows), key=lambda r: (-r.prev, r[SKU]))]
    want = [(r[SKU], i + 1, before.index(r[SKU]) + 1 if r[SKU] in before else None) for i, r in enumerate(now)]
    got = compare.top_skus_rank_growth(history, cmp_request(), 25).collect()
    assert sorted((r.canonical_sku, r.current_rank, r.previous_rank) for r in got) == sorted(want)
    assert any(w[2] is None for w in want) and any(w[2] for w in want)


def test_no_rows_give_no_ranks(spark):
    history = history_lines(order_lines(spark, SF_SMALL)).where("1 = 0")
    assert compare.top_skus_rank_growth(history, cmp_request()).collect() == []
