"""A market over the driver's tables: brands are tickers, line items are trades.

Sums are taken in decimals, so prices don't depend on the order of adding; a close is the VWAP of a
ticker's last ``SMOOTH`` trading days, rounded to 6 decimals.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.lineage import cut
from factorspark.operators import calendar, evaluation, factors, factor_risk, membership, monitor

from factorspark.operators.strategies import filled_marks, top_bucket_weights

SMOOTH, TOP_NAMES = 20, 20
_MARKETS: dict[tuple[str, str], Market] = {}


def _round6(x: Column) -> Column:
    """Six decimals in binary arithmetic, the same in every engine; decimal rounding of halves is not."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def forget() -> None:
    """Drops every shared market with what it keeps in memory: for changed tables and for timing."""
    for m in _MARKETS.values():
        m.release()
    _MARKETS.clear()


class Market:
    """DataFrames over one folder of tables, built when first asked for.

    Bars and what is as long as they are stay lazy and are kept in memory or on local disk. Calendars,
    members, panels, ICs, exposures and targets have a row per rebalance date and name at most; they are
    computed once and written to the shared checkpoint folder, so queries on them neither plan nor run
    the market again.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._panels: dict[tuple, DataFrame] = {}

    @staticmethod
    def of(spark: SparkSession, sf_dir: str) -> Market:
        """The market of this application and folder; queries share it."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _MARKETS:
            for old in [k for k in _MARKETS if k[0] != key[0]]:  # of applications that have ended
                del _MARKETS[old]
            _MARKETS[key] = Market(spark, sf_dir)
        return _MARKETS[key]

    def release(self) -> None:
        """Unpersists what is kept; the market can't be used afterwards."""
        for name in ("bars", "marks"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def trades(self) -> DataFrame:
        """(ticker, date, volume, notional, disc, n) per weekday and brand; part is the small side."""
        li = self.table("lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), "l_quantity", "l_extendedprice", "l_discount")
        li = li.filter(F.weekday("date") < 5)
        part = self.table("part").select("p_partkey", F.upper("p_brand").alias("ticker"))
        dec = lambda c, s: F.sum(F.col(c).cast(f"decimal(18,{s})"))
        return li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker", "date").agg(
            dec("l_quantity", 2).alias("volume"), dec("l_extendedprice", 2).alias("notional"), dec("l_discount", 4).alias("disc"), F.count("*").alias("n"))

    @staticmethod
    def _bars(trades: DataFrame) -> DataFrame:
        by = Window.partitionBy("ticker").orderBy("date")
        w = by.rowsBetween(1 - SMOOTH, 0)
        x = trades.select(
            "date", "ticker", F.col("volume").cast("double").alias("volume"),
            _round6(F.sum("notional").over(w).cast("double") / F.sum("volume").over(w).cast("double")).alias("close"),
            (F.sum("disc").over(w).cast("double") / F.sum("n").over(w).cast("double")).alias("_d"))
        x = x.withColumn("open", F.coalesce(F.lag("close").over(by), F.col("close"))).withColumn("adj_close", _round6(F.col("close") * (1 - F.col("_d"))))
        return x.select("date", "ticker", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close", "adj_close", "volume")

    @cached_property
    def bars(self) -> DataFrame:
        """The daily bars. Every factor reads them several times, so they are kept (spilling to disk; a
        lost part is computed again)."""
        return self._bars(self.trades).persist()

    @cached_property
    def benchmark(self) -> DataFrame:
        """(date, close) of all brands together."""
        total = self.trades.groupBy("date").agg(*(F.sum(c).alias(c) for c in ("volume", "notional", "disc", "n"))).withColumn("ticker", F.lit("INDEX"))
        return self._bars(total).select("date", "close")

    @cached_property
    def sessions(self) -> DataFrame:
        return cut(calendar.sessions(self.bars))

    @cached_property
    def calendar(self) -> DataFrame:
        return cut(calendar.rebalance_calendar(self.sessions, "month_end"))

    @cached_property
    def quarter_members(self) -> DataFrame:
        """(as_of, ticker, q): the most traded names of each quarter, as of its last day."""
        v = self.bars.groupBy(F.date_trunc("quarter", "date").cast("date").alias("q0"), "ticker").agg(F.sum("volume").alias("v"))
        r = v.withColumn("r", F.row_number().over(Window.partitionBy("q0").orderBy(F.col("v").desc(), "ticker"))).filter(F.col("r") <= TOP_NAMES)
        return cut(r.select(F.last_day(F.add_months("q0", 2)).alias("as_of"), "ticker", (F.year("q0") * 4 + F.quarter("q0")).alias("q")))

    @cached_property
    def constituents(self) -> DataFrame:
        m = self.quarter_members
        last = m.agg(F.max("q").alias("q"))
        return m.join(F.broadcast(last), "q").select("ticker", F.col("ticker").alias("security"), F.lit(None).cast("string").alias("sector"), F.col("as_of").alias("date_added"))

    @cached_property
    def changes(self) -> DataFrame:
        """The log between neighbouring quarters: additions and removals paired by rank."""
        m = self.quarter_members
        nxt = m.select((F.col("q") - 1).alias("q"), "ticker", F.lit(1).alias("_in"))
        prev = m.select((F.col("q") + 1).alias("q"), "ticker", F.lit(1).alias("_in"))
        span = F.broadcast(m.select("q", "as_of").distinct())
        first = F.broadcast(m.agg(F.min("q").alias("_lo")))
        w = Window.partitionBy("q").orderBy("ticker")
        added = m.join(prev, ["q", "ticker"], "left_anti").join(first).filter("q > _lo").select("q", F.row_number().over(w).alias("k"), F.col("ticker").alias("added_ticker"))
        removed = m.join(nxt, ["q", "ticker"], "left_anti").withColumn("q", F.col("q") + 1).select("q", F.row_number().over(w).alias("k"), F.col("ticker").alias("removed_ticker"))
        both = added.join(removed, ["q", "k"], "full_outer").join(span, "q")
        return both.select((F.col("q") * 100 + F.col("k")).cast("int").alias("pos"), F.col("as_of").alias("date"), "added_ticker", F.col("added_ticker").alias("added_security"),
                           "removed_ticker", F.col("removed_ticker").alias("removed_security"), F.lit("rebalanced").alias("reason"))

    #: The snapshot's date: later than anything in the data.
    FETCHED = "2010-01-01"

    @cached_property
    def members(self) -> DataFrame:
        """(as_of, ticker) on the rebalance dates, rebuilt from constituents and change log."""
        days = self.calendar.select(F.col("date").alias("as_of"))
        return cut(membership.members_as_of(self.constituents, self.changes, days, fetched_at=self.FETCHED))

    def panel(self, *fs: type[factors.Factor]) -> DataFrame:
        """(factor, date, ticker, value, fwd_ret) of the given (default: all) factors."""
        kinds = fs or factors.FACTORS
        if kinds not in self._panels:
            self._panels[kinds] = cut(factors.factor_panel([f() for f in kinds], self.bars, self.calendar, self.members))
        return self._panels[kinds]

    @cached_property
    def ic(self) -> DataFrame:
        return cut(evaluation.information_coefficient(self.panel()))

    @cached_property
    def regime(self) -> DataFrame:
        return cut(monitor.classify_regime(self.benchmark, expanding=True))

    @cached_property
    def exposures(self) -> DataFrame:
        return cut(factor_risk.exposure_panel(self.panel()))

    @cached_property
    def marks(self) -> DataFrame:
        return filled_marks(self.bars).persist()

    @cached_property
    def nav(self) -> DataFrame:
        """(strategy, date, nav): every ticker held on its own."""
        return self.marks.select(F.col("ticker").alias("strategy"), "date", F.col("mark").alias("nav"))

    @cached_property
    def momentum_targets(self) -> DataFrame:
        scores = factors.MomentumFactor().panel(self.bars, self.calendar.select(F.col("date").alias("as_of")), self.members)
        return cut(top_bucket_weights(scores, "momentum"))

    @cached_property
    def monthly(self) -> DataFrame:
        """(date, asset, ret): calendar-month returns, dated by the month's first day."""
        from factorspark.operators.strategies import monthly_returns

        r = monthly_returns(self.bars)
        return cut(r.select(F.make_date(F.floor(F.col("m") / 12).cast("int"), (F.col("m") % 12 + 1).cast("int"), F.lit(1)).alias("date"), F.col("ticker").alias("asset"), "ret"))
