"""Driver tables and the order-shaped views derived from them.

``order_lines`` turns the TPC-H-style star schema into the flat order-history
shape the analytics run on (one row per line item). The joins are written
fact-first and left to Catalyst/AQE: dimension sides whose file statistics
fall under ``spark.sql.autoBroadcastJoinThreshold`` are broadcast, larger
ones use a sort-merge join (with AQE skew splitting), so nothing unbounded is
ever broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dec(c: str | Column, p: int, s: int) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast(f"decimal({p},{s})")


FIRST_DATE = "first_date"


def order_lines(spark: SparkSession, sf_dir: str, orders_first: bool = False, by_date: bool = False) -> DataFrame:
    """One row per line item in the order-history shape (see FIXTURES.md §2.1).

    ``orders_first``: lines meet their orders first, so that a window of days leaves its lines alone to the other joins.
    They then have ``first_date`` too, the least date of their order's id: with the id it tells an order document.
    ``by_date``: these lines lie by both, dealt before names are looked up.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")

    # Keys travel, names are looked up last. Orders come after parts and suppliers: a sort-merge join then leaves the
    # lines dealt by order, so what groups them by order shuffles nothing more.
    orders = o.join(c, o.o_custkey == c.c_custkey).drop("c_custkey")
    states = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    order_date = F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate"))
    if orders_first:
        # orders without a state come to nothing below: their dates don't count
        orders = orders.join(states, "c_nationkey", "left_semi").withColumn(
            FIRST_DATE, F.min(order_date).over(Window.partitionBy("o_orderkey")))
        joined = (li.join(orders, li.l_orderkey == orders.o_orderkey)
                  .join(p, li.l_partkey == p.p_partkey)
                  .join(s, li.l_suppkey == s.s_suppkey))
        joined = joined.repartitionByRange(FIRST_DATE, "l_orderkey") if by_date else joined
    else:
        joined = (li.join(p, li.l_partkey == p.p_partkey)
                  .join(s, li.l_suppkey == s.s_suppkey)
                  .join(orders, li.l_orderkey == orders.o_orderkey))
    j = (joined
         .join(states, "c_nationkey")
         .join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("courier"),
                        F.col("n_regionkey").alias("s_regionkey")), "s_nationkey")
         .join(r.select(F.col("r_regionkey").alias("s_regionkey"),
                        F.col("r_name").alias("import_warehouse_name")), "s_regionkey"))

    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    status = (F.when((rf == "R") & (ls == "O"), "RTO").when(rf == "R", "Returned")
              .when((rf == "A") & (ls == "O"), "Cancelled").when(rf == "A", "Shipped")
              .when(ls == "O", "Open").otherwise("Manifest Scanned"))
    pri = F.col("o_orderpriority")
    payment = (F.when(pri == "1-URGENT", "COD").when(pri == "2-HIGH", " cod ")
               .when(pri == "3-MEDIUM", "PrePaid").when(pri == "4-NOT SPECIFIED", "PREPAID"))
    seg = F.col("c_mktsegment")
    otype = F.when(seg.isin("BUILDING", "AUTOMOBILE"), "B2B").when(seg == "MACHINERY", "B2B2C").otherwise("B2C")
    part_mod = (F.col("l_partkey") % 200).cast("string")
    size = (F.col("p_size") % 12).cast("string")
    mrp = _dec("p_retailprice", 12, 2)

    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        order_date.alias("order_date"),
        (_dec("l_extendedprice", 12, 2) * (F.lit(1).cast("decimal(3,2)") - _dec("l_discount", 3, 2))).alias("total_amount"),
        F.col("l_quantity").cast("bigint").alias("item_quantity"),
        status.alias("order_status"),
        payment.alias("payment_mode"),
        otype.alias("order_type"),
        F.col("state"),
        seg.alias("marketplace"),
        F.col("courier"),
        F.col("import_warehouse_name"),
        (F.col("o_custkey") % 1000).cast("string").alias("pin_code"),
        F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("YCE_")).otherwise(F.lit("")), part_mod, F.lit("_"), size).alias("sku"),
        F.concat(F.lit("ABC-"), part_mod, F.lit("-"), F.col("l_suppkey").cast("string"), F.lit("-"), size).alias("raw_sku"),
        F.col("p_name").alias("model_no"),
        F.col("p_type").alias("product_name"),
        F.col("p_brand").alias("brand"),
        mrp.alias("mrp"),
        (mrp * F.lit(0.6).cast("decimal(3,2)")).alias("cost"),
        F.col("l_shipdate").alias("load_ts"),
        *([F.col(FIRST_DATE)] if orders_first else []),
    )


def vendor_cost_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor cost sheet side view (style, collection, brand, MRP, final price)."""
    p = read_table(spark, sf_dir, "part")
    mrp = _dec("p_retailprice", 12, 2)
    return p.select(
        F.col("p_name").alias("style_name"), F.col("p_type").alias("collection_name"),
        F.col("p_brand").alias("brand"), mrp.alias("mrp"),
        (mrp * F.lit(0.6).cast("decimal(3,2)")).alias("final_price"))


def payment_cycle_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributor payment-cycle side view (party, ASM, margin, CD, cycle days)."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("s_name").alias("party_name"), F.col("n_name").alias("asm_name"),
                    (F.col("s_suppkey") % 50).alias("margin"), (F.col("s_suppkey") % 7).alias("cd"),
                    (F.col("s_suppkey") % 61).alias("payment_cycle")))
