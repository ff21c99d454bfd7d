"""Distributor payment-cycle metrics.

Columns: ``margin``, ``cd`` (cash discount), ``payment_cycle`` (days),
``party_name``. Non-numeric values are null and left out, as in the source
definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed bucket edges (days) of the payment-cycle distribution and the default
# high-risk thresholds.
CYCLE_EDGES = (15, 30, 45)
RISK_MARGIN, RISK_CYCLE = 30, 45


def _n(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def payment_cycle_metrics(sheet: DataFrame, volume_column: str | None = None) -> DataFrame:
    """D1–D4, D6–D8 in one aggregate row."""
    return sheet.agg(*metric_columns(volume_column))


def metric_columns(volume_column: str | None = None) -> list[Column]:
    """D1–D4, D6–D8 as aggregates, for the whole sheet or per group."""
    m, cyc, cd = _n("margin"), _n("payment_cycle"), _n("cd")
    pos = cyc > 0
    if volume_column:
        v = _n(volume_column)
        weighted = F.round(F.try_divide(F.sum(m * v), F.when(F.sum(v) != 0, F.sum(v))), 2)
    else:
        weighted = F.round(F.avg(m), 2)
    lo, mid, hi = CYCLE_EDGES
    return [
        F.round(F.avg(m), 2).alias("avg_margin"),
        weighted.alias("weighted_avg_margin"),
        F.round(F.avg(F.when(pos, m / cyc)), 4).alias("margin_per_payment_day"),
        F.round(F.sum(m), 2).alias("total_margin_exposure"),
        F.round(F.avg(F.when(pos, (100 - m) / cyc)), 4).alias("cycle_efficiency_score"),
        F.count(F.when((cyc >= 0) & (cyc < lo), 1)).alias("very_short_cycle_0_15"),
        F.count(F.when((cyc >= lo) & (cyc < mid), 1)).alias("short_cycle_15_30"),
        F.count(F.when((cyc >= mid) & (cyc < hi), 1)).alias("medium_cycle_30_45"),
        F.count(F.when(cyc >= hi, 1)).alias("long_cycle_45plus"),
        F.round(F.coalesce(F.sum(cd), F.lit(0.0)), 2).alias("cd_sum"),
        F.round(F.coalesce(F.avg(cd), F.lit(0.0)), 2).alias("cd_mean"),
        F.round(F.coalesce(F.max(cd), F.lit(0.0)), 2).alias("cd_max"),
        F.round(F.coalesce(F.min(cd), F.lit(0.0)), 2).alias("cd_min"),
        F.count(cd).alias("cd_count")]


def high_risk_distributors(sheet: DataFrame, margin_threshold: float = RISK_MARGIN,
                           cycle_threshold: float = RISK_CYCLE) -> DataFrame:
    """Margin > threshold and cycle > threshold; score = margin/100 · cycle/45, highest first."""
    m, cyc = _n("margin"), _n("payment_cycle")
    return (sheet.where((m > margin_threshold) & (cyc > cycle_threshold))
            .select("party_name", F.col("margin"), F.col("payment_cycle"), F.col("cd"),
                    F.round(m / 100.0 * (cyc / 45.0), 3).alias("risk_score"))
            .orderBy(F.col("risk_score").desc(), "party_name"))
