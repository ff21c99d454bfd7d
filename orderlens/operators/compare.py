"""Segment and period comparisons.

Two-window operators read both windows in one scan (``fetch_two_windows``)
and use conditional sums per key instead of joining two aggregates. Top-N
selections are ``orderBy(...).limit(n)`` (TakeOrderedAndProject: each task
keeps n rows), so the selected keys are a proven-bounded frame that may be
broadcast back; grand totals come from scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import growth_pct, money, ratio, safe_pct, strip_sku_prefix
from ..plans.history import fetch_two_windows
from ..plans.request import HistoryRequest, previous_window, trailing_windows
from .core import order_level, status_flag
from .kpis import CANCELLED, RTO


def _segment_rows(df: DataFrame, seg: Column, segments: list[str], with_rto: bool, with_units: bool) -> DataFrame:
    """One row with ``<segment>_<metric>`` columns, zeros for empty segments."""
    flags = {"c": status_flag(CANCELLED), "r": status_flag(RTO)}
    sums = {"amt": F.col("total_amount"), "units": F.col("item_quantity")}
    per_order = order_level(df.withColumn("_seg", seg).where(F.col("_seg").isNotNull()), ["_seg"], flags, sums)
    aggs = []
    for s in segments:
        is_s = F.col("_seg") == s
        has = is_s & F.col("order_id").isNotNull()
        aggs += [F.count(F.when(has, 1)).alias(f"{s}_orders"),
                 F.coalesce(F.sum(F.when(is_s, F.col("amt"))), F.lit(0)).alias(f"{s}_amt"),
                 F.coalesce(F.sum(F.when(is_s, F.col("units"))), F.lit(0)).alias(f"{s}_units"),
                 F.coalesce(F.sum(F.when(has, F.col("c"))), F.lit(0)).alias(f"{s}_c"),
                 F.coalesce(F.sum(F.when(has, F.col("r"))), F.lit(0)).alias(f"{s}_r")]
    row = per_order.agg(*aggs)
    out = []
    for s in segments:
        o = F.col(f"{s}_orders")
        out.append(o.alias(f"{s}_order_count"))
        if with_units:
            out.append(ratio(F.col(f"{s}_units"), o).alias(f"{s}_units_per_order"))
        else:
            out.append(money(F.col(f"{s}_amt")).alias(f"{s}_revenue"))
        out.append(ratio(F.col(f"{s}_amt"), o).alias(f"{s}_aov"))
        out.append(F.round(safe_pct(F.col(f"{s}_c"), o), 2).alias(f"{s}_cancellation_rate"))
        if with_rto:
            out.append(F.round(safe_pct(F.col(f"{s}_r"), o), 2).alias(f"{s}_rto_rate"))
    return row.select(*out)


def cod_vs_prepaid(df: DataFrame) -> DataFrame:
    """COD vs every other payment mode (rows with mode COD after cleaning)."""
    seg = F.when(F.col("payment_mode") == "COD", "cod").otherwise("prepaid")
    return _segment_rows(df, seg, ["cod", "prepaid"], with_rto=True, with_units=False)


def b2b_vs_b2c(df: DataFrame) -> DataFrame:
    """B2B vs B2C (other order types are left out)."""
    t = F.upper(F.trim(F.col("order_type")))
    seg = F.when(t == "B2B", "b2b").when(t == "B2C", "b2c")
    return _segment_rows(df, seg, ["b2b", "b2c"], with_rto=False, with_units=True)


def _two_window_sums(history: DataFrame, req: HistoryRequest, key: str, value: str,
                     extra_cols: tuple[str, ...] = ()) -> tuple[DataFrame, tuple]:
    cs, ce, ps, pe, _ = previous_window(req)
    tagged = fetch_two_windows(history, req, (cs, ce), (ps, pe), extra_cols)
    is_cur, is_prev = F.col("window") == "current", F.col("window") == "previous"
    per = tagged.groupBy(key).agg(
        F.sum(F.when(is_cur, F.col(value))).alias("cur"),
        F.sum(F.when(is_prev, F.col(value))).alias("prev"),
        F.count(F.when(is_cur, 1)).alias("cur_rows"),
        F.count(F.when(is_prev, 1)).alias("prev_rows"))
    return per, (cs, ce, ps, pe)


def top_states_vs_rest(history: DataFrame, req: HistoryRequest, n: int = 5) -> DataFrame:
    """Top-n states by current revenue vs the rest; share of the grand total (Q8)."""
    per, _ = _two_window_sums(history, req, "state", "total_amount")
    per = per.withColumns({"cur": F.coalesce("cur", F.lit(0)), "prev": F.coalesce("prev", F.lit(0))})
    top = (per.where(F.col("cur_rows") > 0).orderBy(F.col("cur").desc(), F.col("state").asc())
           .limit(n).select(F.col("state").alias("_top")))
    labelled = (per.join(F.broadcast(top), per.state == top._top, "left")
                .withColumn("bucket", F.coalesce(F.col("_top"), F.lit("REST"))))
    grouped = labelled.groupBy("bucket").agg(F.sum("cur").alias("cur"), F.sum("prev").alias("prev"))
    total = per.agg(F.sum("cur")).scalar()
    return grouped.select(
        F.col("bucket").alias("state"),
        money(F.col("cur")).alias("current_revenue"),
        money(F.col("prev")).alias("previous_revenue"),
        F.round(safe_pct(F.col("cur"), total), 2).alias("revenue_share"),
        F.round(growth_pct(F.col("cur"), F.col("prev")), 2).alias("growth_pct"))


def top_skus_rank_growth(history: DataFrame, req: HistoryRequest, n: int = 10) -> DataFrame:
    """Top-n canonical SKUs by current revenue with previous rank and growth.

    The previous rank of a selected SKU is 1 + the number of SKUs ahead of it in the previous window. The n selected
    rows are one array (a scalar subquery of n rows); every SKU of the previous window counts for the slot of that
    array's previous order that it falls into, partially per task, so n + 1 counts are all that is shuffled, and a
    rank is their running sum. One job: no collect while planning, no join, no window over all SKUs.
    """
    key = "canonical_sku_normalized"
    per, _ = _two_window_sums(history, req, key, "total_amount")
    top = (per.where(F.col("cur_rows") > 0).orderBy(F.col("cur").desc(), F.col(key).asc()).limit(n)
           .select(F.col("cur").alias("t_cur"), F.col(key).alias("sku"), F.coalesce(F.col("prev"), F.lit(0)).alias("t_prev"),
                   (F.col("prev_rows") > 0).alias("before")))
    chosen = top.agg(F.collect_list(F.struct(*top.columns))).scalar()

    def ahead(prev: Column, sku: Column, of: Column) -> Column:
        return F.coalesce((prev > of["t_prev"]) | ((prev == of["t_prev"]) & (sku < of["sku"])), F.lit(False))

    # a SKU is ahead of those of the chosen that come after its slot
    behind = F.size(F.filter(F.col("chosen"), lambda t: t["before"] & ~ahead(F.col("prev"), F.col(key), t)))
    slots = (per.where(F.col("prev_rows") > 0).withColumn("chosen", chosen).groupBy(behind.alias("slot"))
             .agg(F.count("*").alias("skus")))
    one = (slots.agg(F.collect_list(F.struct("slot", "skus")).alias("slots")).withColumn("chosen", chosen))
    by_now = F.array_sort(F.col("chosen"), lambda a, b: F.when(
        (a["t_cur"] > b["t_cur"]) | ((a["t_cur"] == b["t_cur"]) & (a["sku"] < b["sku"])), -1).otherwise(1))
    ranked = (one.select("slots", "chosen", F.posexplode(by_now).alias("at", "t"))
              .select("t.*", "slots", "chosen", (F.col("at") + 1).cast("bigint").alias("current_rank")))
    me = F.size(F.filter(F.col("chosen"), lambda t: t["before"] & ahead(t["t_prev"], t["sku"], F.struct("t_prev", "sku"))))
    rank = F.aggregate(F.filter("slots", lambda s: s["slot"] <= F.col("me")), F.lit(0).cast("bigint"), lambda x, s: x + s["skus"]) + 1
    ranked = ranked.withColumn("me", me).withColumn("previous_rank", F.when(F.col("before"), rank))
    return ranked.select(
        F.col("sku").alias("canonical_sku"), "current_rank", "previous_rank",
        (F.col("previous_rank") - F.col("current_rank")).alias("rank_change"),
        money(F.col("t_cur")).alias("current_revenue"), money(F.col("t_prev")).alias("previous_revenue"),
        F.round(growth_pct(F.col("t_cur"), F.col("t_prev")), 2).alias("growth_pct"))


def size_mix_change(history: DataFrame, req: HistoryRequest) -> DataFrame:
    """P5: units per size bucket now vs before; shares, share change (pp) and growth."""
    per, _ = _two_window_sums(history, req, "size_bucket", "item_quantity")
    per = per.withColumns({"cur": F.coalesce("cur", F.lit(0)).cast("double"),
                           "prev": F.coalesce("prev", F.lit(0)).cast("double")})
    tot_cur, tot_prev = per.agg(F.sum("cur")).scalar(), per.agg(F.sum("prev")).scalar()
    cur_share, prev_share = safe_pct(F.col("cur"), tot_cur), safe_pct(F.col("prev"), tot_prev)
    return per.select(
        F.col("size_bucket").alias("size"), F.col("cur").alias("current_units"), F.col("prev").alias("previous_units"),
        F.round(cur_share, 2).alias("current_share"), F.round(prev_share, 2).alias("previous_share"),
        F.round(cur_share - prev_share, 2).alias("share_change_pp"),
        F.round(growth_pct(F.col("cur"), F.col("prev")), 2).alias("growth_pct"))


def sku_vs_sku(history: DataFrame, req: HistoryRequest, sku_1: str, sku_2: str,
               comparison_window: str = "30d") -> DataFrame:
    """Six metrics for two SKUs, their difference, and growth vs the previous window.

    One row per SKU. ``comparison_window`` is 7d, 30d (trailing windows ending
    at the request end) or all-time (the request window, no growth).
    """
    from ..functions.filters import strip_control_keys
    a = F.regexp_replace(F.trim(F.lit(sku_1)), "^YCE_", "")
    b = F.regexp_replace(F.trim(F.lit(sku_2)), "^YCE_", "")
    r = HistoryRequest(req.start, req.end, strip_control_keys(req.filters))
    if comparison_window in ("7d", "30d"):
        cs, ce, ps, pe = trailing_windows(r.end, 7 if comparison_window == "7d" else 30)
        tagged = fetch_two_windows(history, r, (cs, ce), (ps, pe))
    elif comparison_window == "all-time":
        from ..plans.history import fetch
        tagged = fetch(history, r).withColumn("window", F.lit("current"))
    else:
        raise ValueError("comparison_window must be one of: 7d, 30d, all-time")
    key = "canonical_sku_normalized"
    rows = tagged.where(F.col(key).isin(a, b)).withColumn("_sku", F.col(key))
    per_order = order_level(rows, ["_sku", "window"], {"c": status_flag(CANCELLED), "r": status_flag(RTO)},
                            {"amt": F.col("total_amount"), "units": F.col("item_quantity")})
    m = {}
    for w, p in (("current", "cur"), ("previous", "prev")):
        is_w = F.col("window") == w
        m[f"{p}_orders"] = F.count(F.when(is_w, 1))
        m[f"{p}_units"] = F.coalesce(F.sum(F.when(is_w, F.col("units"))), F.lit(0)).cast("double")
        m[f"{p}_amt"] = F.coalesce(F.sum(F.when(is_w, F.col("amt"))), F.lit(0))
        m[f"{p}_c"] = F.coalesce(F.sum(F.when(is_w, F.col("c"))), F.lit(0))
        m[f"{p}_r"] = F.coalesce(F.sum(F.when(is_w, F.col("r"))), F.lit(0))
    per_sku = per_order.groupBy("_sku").agg(*[c.alias(n) for n, c in m.items()])
    # Both SKUs always appear (zeros when a SKU has no rows): a 2-row name frame
    # left-joined to the (at most 4-row) per-SKU aggregate.
    names = (per_sku.sparkSession.range(1).select(F.posexplode(F.array(a, b)).alias("pos", "sku"))
             .dropDuplicates(["sku"]))
    full = names.join(per_sku, names.sku == per_sku._sku, "left")

    def metrics(p: str) -> dict[str, Column]:
        o = F.coalesce(F.col(f"{p}_orders"), F.lit(0)).cast("bigint")
        amt = F.coalesce(F.col(f"{p}_amt"), F.lit(0))
        return {
            f"{p}_order_count": o,
            f"{p}_units": F.coalesce(F.col(f"{p}_units"), F.lit(0.0)),
            f"{p}_revenue": amt.cast("double"),
            f"{p}_aov": ratio(amt, o),
            f"{p}_cancellation_rate": F.round(safe_pct(F.coalesce(F.col(f"{p}_c"), F.lit(0)), o), 2),
            f"{p}_rto_rate": F.round(safe_pct(F.coalesce(F.col(f"{p}_r"), F.lit(0)), o), 2),
        }
    full = full.select("pos", "sku", *[c.alias(n) for n, c in {**metrics("cur"), **metrics("prev")}.items()])
    other = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    diff = {}
    for mname in ("order_count", "units", "revenue", "aov", "cancellation_rate", "rto_rate"):
        o = F.sum(F.col(f"cur_{mname}")).over(other) - F.col(f"cur_{mname}")  # the other SKU's value (2 rows)
        diff[f"{mname}_diff_vs_other"] = F.round(F.col(f"cur_{mname}") - o, 2).cast("double")
        if mname in ("revenue", "units"):
            diff[f"{mname}_lift_pct_vs_other"] = F.round(growth_pct(F.col(f"cur_{mname}"), o), 2)
    growth = {}
    if comparison_window != "all-time":
        for mname in ("order_count", "units", "revenue", "aov"):
            growth[f"{mname}_growth_pct"] = F.round(growth_pct(F.col(f"cur_{mname}"), F.col(f"prev_{mname}")), 2)
        for mname in ("cancellation_rate", "rto_rate"):
            growth[f"{mname}_change_pp"] = F.round(F.col(f"cur_{mname}") - F.col(f"prev_{mname}"), 2)
    out = full.select(
        F.when(F.col("pos") == 0, "sku_1").otherwise("sku_2").alias("role"), "sku",
        *[F.col(f"cur_{x}").alias(x) for x in ("order_count", "units", "aov", "cancellation_rate", "rto_rate")],
        F.round(F.col("cur_revenue"), 2).alias("revenue"),
        *[c.alias(n) for n, c in diff.items()], *[c.alias(n) for n, c in growth.items()])
    return out
