"""Sessions, rebalance calendars, snapping, as-of joins and forward fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FREQUENCIES = {"month_end": "month", "quarter_end": "quarter", "week_end": "week"}


def sessions(bars: DataFrame) -> DataFrame:
    """(date, ord): the distinct dates of ``bars`` numbered from 0.

    The numbering is a window over the calendar alone, a few hundred rows a year.
    """
    days = bars.select("date").filter("date is not null").distinct()
    return days.withColumn("ord", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def rebalance_calendar(days: DataFrame, freq: str = "month_end") -> DataFrame:
    """(date, rebal): the last session of each period, numbered from 0."""
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown freq {freq!r}; choose from {sorted(FREQUENCIES)}")
    last = days.groupBy(F.date_trunc(FREQUENCIES[freq], "date").alias("_p")).agg(F.max("date").alias("date")).drop("_p")
    return last.withColumn("rebal", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def snap_targets(targets: DataFrame, days: DataFrame, *, lag: int = 0) -> DataFrame:
    """``targets`` (strategy, decision_date, ticker, weight) with the session they execute on.

    A decision snaps forward to the first session on or after it, then moves ``lag`` sessions on; past
    the end it is dropped. Of several decisions for one session the latest wins. Adds exec_date and
    exec_ord.
    """
    if lag < 0:
        raise ValueError("execution_lag must be >= 0")
    cal = F.broadcast(days.select(F.col("date").alias("_d"), F.col("ord").alias("_o")))  # one row a session
    decisions = targets.select("strategy", "decision_date").distinct()
    snapped = decisions.join(cal, F.col("_d") >= F.col("decision_date")).groupBy("strategy", "decision_date").agg((F.min("_o") + lag).alias("exec_ord"))
    placed = snapped.join(F.broadcast(days.select(F.col("ord").alias("exec_ord"), F.col("date").alias("exec_date"))), "exec_ord")
    latest = Window.partitionBy("strategy", "exec_ord").orderBy(F.col("decision_date").desc())
    kept = placed.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")
    return targets.join(kept, ["strategy", "decision_date"])


def asof_backward(left: DataFrame, right: DataFrame, *, on: str = "date", value: str, by: Sequence[str] = ()) -> DataFrame:
    """``left`` with the last non-null ``value`` of ``right`` at or before its ``on``; others are dropped.

    A union and one window per ``by`` group: each side is shuffled once and rows are never paired.
    """
    keys = [*by, on]
    both = left.select(*left.columns, F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side")).unionByName(
        right.select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter((F.col("_side") == 1) & F.col(value).isNotNull()).select(*left.columns, value)


def forward_fill(value: str | Column, by: Sequence[str], order: str) -> Column:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def unique_bars(bars: DataFrame, order: str | None = None) -> DataFrame:
    """One row per (date, ticker): of repeated rows each column's last value that is not null.

    Last by the column ``order`` (an ingestion time, say); without one rows have no order, and the
    largest value stands, so that the result is the same every time.
    """
    rest = [c for c in bars.columns if c not in ("date", "ticker", order)]
    value = (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))) if order else F.max
    return bars.groupBy("date", "ticker").agg(*(value(c).alias(c) for c in rest)) if rest else bars.select("date", "ticker").distinct()


def dense(bars: DataFrame, days: DataFrame) -> DataFrame:
    """Every (ticker, session) from a ticker's first bar on, with its bar or nulls; repeated bars count once.

    Sessions are generated per ticker from its own first ordinal, so nothing is crossed with the
    past before a listing.
    """
    bars = unique_bars(bars)
    at = bars.join(F.broadcast(days), "date")
    span = at.groupBy("ticker").agg(F.min("ord").alias("_lo"))
    last = days.agg(F.max("ord").alias("_hi"))
    grid = span.join(F.broadcast(last)).select("ticker", F.explode(F.sequence("_lo", "_hi")).alias("ord"))
    return grid.join(F.broadcast(days), "ord").join(bars, ["ticker", "date"], "left")
