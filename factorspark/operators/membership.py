"""Point-in-time index membership from today's list and a change log.

Walking the log backwards from today and undoing every change after a date means that, for each
symbol, the *oldest* later event decides: had it been removed later, it was in; added later, it was
out; without any later event it is in exactly if it is in today's list. So one window over
(date, symbol) replaces the walk, for all dates at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.symbols import normalize_ticker

CHANGES = "pos int, date date, added_ticker string, added_security string, removed_ticker string, removed_security string, reason string"


def events(changes: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(symbol, date, pos, removed): the log exploded, symbols mapped from old to current."""
    out = changes.filter("date is not null").select(
        "date", "pos", F.explode(F.array(F.struct(F.col("added_ticker").alias("symbol"), F.lit(0).alias("removed")), F.struct(F.col("removed_ticker").alias("symbol"), F.lit(1).alias("removed")))).alias("e")
    ).select("date", "pos", "e.symbol", "e.removed").filter("symbol is not null and symbol <> ''")
    if renames is None:
        return out
    known = renames.select(F.col("old").alias("symbol"), F.col("new").alias("_new"))
    return out.join(known, "symbol", "left").withColumn("symbol", F.coalesce("_new", "symbol")).drop("_new")


def members_as_of(constituents: DataFrame, changes: DataFrame, dates: DataFrame, *, fetched_at: object, renames: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """(as_of, ticker): who was in the index on each ``as_of`` of ``dates``.

    Changes after ``fetched_at`` are ignored, one dated ``as_of`` is in effect. Of equally dated
    events of a symbol the one latest in the log decides, a removal before an addition. ``renames``
    (old, new, effective): before ``effective`` a company goes by its old symbol.
    """
    log = events(changes, renames).filter(F.col("date") <= F.to_date(F.lit(fetched_at)))
    days = dates.select("as_of").distinct()
    later = log.join(F.broadcast(days), F.col("date") > F.col("as_of"))
    first = Window.partitionBy("as_of", "symbol").orderBy("date", F.col("pos").desc(), F.col("removed").desc())
    decided = later.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("as_of", "symbol", "removed")
    listed = constituents.select(F.col("ticker").alias("symbol")).filter("symbol is not null").distinct()
    stayed = days.crossJoin(F.broadcast(listed)).join(decided, ["as_of", "symbol"], "left_anti")  # one row per answer
    out = stayed.unionByName(decided.filter("removed = 1").select("as_of", "symbol"))
    if renames is not None:
        past = renames.filter("effective is not null").select(F.col("new").alias("symbol"), "old", "effective")
        first_old = Window.partitionBy("as_of", "symbol").orderBy("effective", "old")
        hit = out.join(past, "symbol").filter("as_of < effective").withColumn("_r", F.row_number().over(first_old)).filter("_r = 1").select("as_of", "symbol", "old")
        out = out.join(hit, ["as_of", "symbol"], "left").select("as_of", F.coalesce("old", "symbol").alias("symbol"))
    ticker = normalize_ticker(F.col("symbol")) if normalize else F.col("symbol")
    return out.select("as_of", ticker.alias("ticker")).distinct()


def members_by(rule: Callable[[date], Iterable[str]], dates: DataFrame) -> DataFrame:
    """(as_of, ticker): what ``rule`` says for each ``as_of`` of ``dates``, asked once a date on the driver.

    A rule of Python's can't run elsewhere; there are as many calls as rebalance dates, whatever the bars.
    """
    days = sorted(r["as_of"] for r in dates.select("as_of").distinct().filter("as_of is not null").collect())
    rows = [(day, ticker) for day in days for ticker in sorted(set(rule(day)))]
    return dates.sparkSession.createDataFrame(rows, "as_of date, ticker string")


def union_ever(constituents: DataFrame, changes: DataFrame, start: object, end: object, *, fetched_at: object, renames: DataFrame | None = None, sample_dates: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """(ticker), sorted: every symbol sampled in [start, end] or named by a change within.

    Samples are each year's 30 June unless ``sample_dates`` (as_of) is given.
    """
    if sample_dates is None:
        years = constituents.sparkSession.range(1).select(F.explode(F.sequence(F.year(F.to_date(F.lit(start))), F.year(F.to_date(F.lit(end))))).alias("y"))
        sample_dates = years.select(F.make_date("y", F.lit(6), F.lit(30)).alias("as_of"))
    inside = changes.filter(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    named = inside.select(F.explode(F.array("added_ticker", "removed_ticker")).alias("ticker"))
    seen = members_as_of(constituents, changes, sample_dates, fetched_at=fetched_at, renames=renames).select("ticker").union(named)
    ticker = normalize_ticker(F.col("ticker")) if normalize else F.col("ticker")
    return seen.filter("ticker is not null and ticker <> ''").select(ticker.alias("ticker")).distinct().orderBy("ticker")
