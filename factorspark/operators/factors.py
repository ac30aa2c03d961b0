"""Price factors, for all formation dates in one plan.

A factor is a function of long bars (date, ticker, adj_close, close, volume) and a table of formation
dates (as_of). Every value uses rows dated at or before its ``as_of`` only; ``compute`` also raises
if it is given later rows. Values are signed so that higher should mean more return.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from datetime import date
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.stats import ratio
from factorspark.functions.symbols import to_date
from factorspark.operators.calendar import dense, forward_fill, sessions
from factorspark.operators.membership import members_by


class LookaheadBiasError(ValueError):
    """Bars dated after the formation date were handed to a factor."""


def month_number(d) -> F.Column:
    return F.year(d) * 12 + F.month(d) - 1


class Factor(ABC):
    """A named factor. Subclasses say which columns they need and how values follow from bars."""

    name: str = "factor"
    required: tuple[str, ...] = ("date", "ticker", "adj_close")

    @abstractmethod
    def values(self, bars: DataFrame, dates: DataFrame) -> DataFrame:
        """(as_of, ticker, value) for every formation date; absent rows mean undefined."""

    def check(self, bars: DataFrame) -> None:
        missing = [c for c in self.required if c not in bars.columns]
        if missing:
            raise ValueError(f"{self.name} needs the columns {missing}")

    def panel(self, bars: DataFrame, dates: DataFrame, members: DataFrame | None = None) -> DataFrame:
        """(factor, date, ticker, value): members only (as_of, ticker) where given, null where undefined."""
        self.check(bars)
        found = self.values(bars, dates)
        if members is not None:
            found = members.join(F.broadcast(dates.select("as_of")), "as_of", "left_semi").join(found, ["as_of", "ticker"], "left")
        return found.select(F.lit(self.name).alias("factor"), F.col("as_of").alias("date"), "ticker", F.col("value").cast("double").alias("value"))

    def compute(self, bars: DataFrame, universe: DataFrame, as_of: object, *, enforce_pit: bool = True) -> DataFrame:
        """(ticker, value) of every ticker of ``universe`` at one date.

        With ``enforce_pit`` a row after ``as_of`` is an error; without, such rows are left out.
        """
        self.check(bars)
        day = to_date(as_of)
        if enforce_pit:
            last = bars.agg(F.max("date")).first()[0]
            if last is not None and to_date(last) > day:
                raise LookaheadBiasError(f"{self.name}: bars reach {last}, after {day}")
        past = bars.filter(F.col("date") <= F.lit(day)).join(universe.select("ticker").distinct(), "ticker", "left_semi")
        dates = bars.sparkSession.range(1).select(F.lit(day).alias("as_of"))
        return universe.select("ticker").distinct().join(self.values(past, dates).select("ticker", "value"), "ticker", "left")


def month_prices(bars: DataFrame, col: str = "adj_close") -> DataFrame:
    """(ticker, m, price): the last non-null price of each ticker and month."""
    return bars.filter(F.col(col).isNotNull()).groupBy("ticker", month_number("date").alias("m")).agg(F.max(F.struct("date", col))[col].alias("price"))


def _last_month(dates: DataFrame, label: str) -> DataFrame:
    """(as_of, m): the latest month that counts at each date.

    ``calendar``: months are labelled by their calendar end, so a month counts once that is reached;
    ``session``: the month of the date itself counts.
    """
    if label not in ("calendar", "session"):
        raise ValueError("month_label must be 'calendar' or 'session'")
    m = month_number("as_of")
    return dates.select("as_of", (F.when(F.last_day("as_of") > F.col("as_of"), m - 1).otherwise(m) if label == "calendar" else m).alias("m")).distinct()


def _month_ratio(bars: DataFrame, dates: DataFrame, start: int, end: int, label: str) -> DataFrame:
    """(as_of, ticker, value): price ``end`` months back over price ``start`` months back, less 1.

    Two equi-joins on the month number; a month without a price gives no value. Of the month under
    way only bars up to the date count, which matters where a date isn't the month's last session.
    """
    months = month_prices(bars)
    at = _last_month(dates, label)
    base = months.select("ticker", F.col("m").alias("_ms"), F.col("price").alias("_p0"))
    top = months.select("ticker", F.col("m").alias("_me"), F.col("price").alias("_p1"))
    if label == "session" and end == 0:
        last = bars.filter(F.col("adj_close").isNotNull()).join(F.broadcast(at), (month_number("date") == F.col("m")) & (F.col("date") <= F.col("as_of")))
        pairs = last.groupBy("as_of", "m", "ticker").agg(F.max_by("adj_close", "date").alias("_p1"))
    else:
        pairs = F.broadcast(at).join(top, F.col("_me") == F.col("m") - end).select("as_of", "m", "ticker", "_p1")
    full = pairs.withColumn("_ms", F.col("m") - start).join(base, ["ticker", "_ms"])
    return full.select("as_of", "ticker", (ratio(F.col("_p1"), F.col("_p0")) - 1).alias("value")).filter("value is not null")


class MomentumFactor(Factor):
    """Return from ``lookback`` to ``skip`` months before the formation date."""

    def __init__(self, lookback: int = 12, skip: int = 1, *, month_label: str = "calendar") -> None:
        if skip < 0 or lookback <= skip:
            raise ValueError("need lookback > skip >= 0")
        self.lookback, self.skip, self.month_label = lookback, skip, month_label
        self.name = f"momentum_{lookback}_{skip}"

    def values(self, bars: DataFrame, dates: DataFrame) -> DataFrame:
        return _month_ratio(bars, dates, self.lookback, self.skip, self.month_label)


class ShortTermReversalFactor(Factor):
    """Minus the return of the last ``lookback_months``."""

    def __init__(self, lookback_months: int = 1, *, month_label: str = "calendar") -> None:
        if lookback_months < 1:
            raise ValueError("lookback_months must be >= 1")
        self.lookback_months, self.month_label = lookback_months, month_label
        self.name = f"short_term_reversal_{lookback_months}"

    def values(self, bars: DataFrame, dates: DataFrame) -> DataFrame:
        return _month_ratio(bars, dates, self.lookback_months, 0, self.month_label).withColumn("value", -F.col("value"))


def session_returns(bars: DataFrame, *, col: str = "adj_close", gap_fill: str = "pad") -> DataFrame:
    """``bars`` on the dense (ticker, session) grid with ``ord`` and the simple return ``ret``.

    ``pad``: gaps hold the last price, so a halted session returns 0; ``none``: a gap has no return.
    """
    if gap_fill not in ("pad", "none"):
        raise ValueError("gap_fill must be 'pad' or 'none'")
    grid = dense(bars, sessions(bars))
    w = Window.partitionBy("ticker").orderBy("ord")
    px = forward_fill(col, ["ticker"], "ord") if gap_fill == "pad" else F.col(col)
    grid = grid.withColumn("_px", px)
    return grid.withColumn("ret", ratio(F.col("_px"), F.lag("_px").over(w)) - 1).drop("_px")


def _at(rolled: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of the last session at or before each formation date."""
    days = rolled.select("date", "ord").distinct()
    snap = dates.select("as_of").distinct().join(F.broadcast(days), F.col("date") <= F.col("as_of")).groupBy("as_of").agg(F.max("ord").alias("ord"))
    return rolled.drop("date").join(F.broadcast(snap), "ord")


class LowVolatilityFactor(Factor):
    """Minus the sample deviation of the returns of the last ``window`` sessions."""

    def __init__(self, window: int = 252, min_periods: int | None = None, *, gap_fill: str = "pad") -> None:
        if window < 2:
            raise ValueError("window must be >= 2")
        self.window, self.gap_fill = window, gap_fill
        self.min_periods = max(2, window // 2) if min_periods is None else min_periods
        self.name = f"low_volatility_{window}"

    def values(self, bars: DataFrame, dates: DataFrame) -> DataFrame:
        w = Window.partitionBy("ticker").orderBy("ord").rowsBetween(1 - self.window, 0)
        r = session_returns(bars.select("date", "ticker", "adj_close"), gap_fill=self.gap_fill)
        rolled = r.select("ticker", "date", "ord", F.when(F.count("ret").over(w) >= self.min_periods, -F.stddev_samp("ret").over(w)).alias("value"))
        return _at(rolled, dates).select("as_of", "ticker", "value").filter("value is not null")


class AmihudIlliquidityFactor(Factor):
    """Mean absolute return per traded money over ``window`` sessions, times ``scale``."""

    required = ("date", "ticker", "adj_close", "close", "volume")

    def __init__(self, window: int = 21, min_periods: int | None = None, scale: float = 1e6, *, gap_fill: str = "pad") -> None:
        if window < 2:
            raise ValueError("window must be >= 2")
        self.window, self.scale, self.gap_fill = window, scale, gap_fill
        self.min_periods = max(2, window // 2) if min_periods is None else min_periods
        self.name = f"amihud_illiq_{window}"

    def values(self, bars: DataFrame, dates: DataFrame) -> DataFrame:
        w = Window.partitionBy("ticker").orderBy("ord").rowsBetween(1 - self.window, 0)
        r = session_returns(bars.select("date", "ticker", "adj_close", "close", "volume"), gap_fill=self.gap_fill)
        r = r.withColumn("_x", ratio(F.abs("ret"), F.col("close") * F.col("volume").cast("double")))
        rolled = r.select("ticker", "date", "ord", F.when(F.count("_x").over(w) >= self.min_periods, F.avg("_x").over(w) * F.lit(float(self.scale))).alias("value"))
        return _at(rolled, dates).select("as_of", "ticker", "value").filter("value is not null")


class PandasFactor(Factor):
    """A user's factor written in pandas: fn(bars of one date's history, as_of) -> Series by ticker.

    Histories are grouped by formation date with a range join on ``history_months``; each group runs
    on its own, so dates are computed in parallel. Use it where column functions can't express a
    factor.
    """

    def __init__(self, name: str, fn: Callable[[pd.DataFrame, object], pd.Series], *, history_months: int = 16, required: tuple[str, ...] = ("date", "ticker", "adj_close")) -> None:
        self.name, self.fn, self.history_months, self.required = name, fn, history_months, required

    def values(self, bars: DataFrame, dates: DataFrame) -> DataFrame:
        fn = self.fn
        past = history(bars, dates, months=self.history_months)

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            s = fn(pdf.drop(columns="as_of"), key[0])
            return pd.DataFrame({"as_of": key[0], "ticker": s.index.astype(str), "value": s.to_numpy(float)}).dropna()

        return past.groupBy("as_of").applyInPandas(run, "as_of date, ticker string, value double")


def history(bars: DataFrame, dates: DataFrame, *, months: int = 16) -> DataFrame:
    """``bars`` with each ``as_of`` whose history [as_of - months, as_of] they belong to."""
    d = F.broadcast(dates.select("as_of").distinct())
    return bars.join(d, (F.col("date") <= F.col("as_of")) & (F.col("date") >= F.add_months("as_of", -months)))


FACTORS = (MomentumFactor, LowVolatilityFactor, ShortTermReversalFactor, AmihudIlliquidityFactor)


def forward_returns(bars: DataFrame, calendar: DataFrame, *, col: str = "adj_close") -> DataFrame:
    """(date, ticker, fwd_ret): from each rebalance date to the next, on the exact dates only."""
    cal = F.broadcast(calendar.select("date", "rebal"))
    at = bars.filter(F.col(col).isNotNull()).join(cal, "date").select("date", "rebal", "ticker", F.col(col).alias("_p"))
    nxt = at.select((F.col("rebal") - 1).alias("rebal"), "ticker", F.col("_p").alias("_q"))
    return at.join(nxt, ["rebal", "ticker"], "left").select("date", "ticker", (ratio(F.col("_q"), F.col("_p")) - 1).alias("fwd_ret"))


def factor_panel(factors: list[Factor], bars: DataFrame, calendar: DataFrame, members: DataFrame | Callable[[date], Iterable[str]] | None = None) -> DataFrame:
    """(factor, date, ticker, value, fwd_ret) of all factors over a rebalance calendar.

    Rows are the union of tickers with a value and tickers with a forward return, on the dates that
    have members (without ``members``: all dates). ``members`` is a table (as_of, ticker) or a
    function that names the tickers of a date.
    """
    dates = calendar.select(F.col("date").alias("as_of"))
    if callable(members):
        members = members_by(members, dates)
    values = reduce(DataFrame.unionByName, (f.panel(bars, dates, members) for f in factors))
    fwd = forward_returns(bars, calendar)
    if members is not None:
        fwd = fwd.join(F.broadcast(members.select(F.col("as_of").alias("date")).distinct()), "date", "left_semi")
    wide = fwd.withColumn("factor", F.explode(F.array(*(F.lit(f.name) for f in factors))))
    return values.join(wide, ["factor", "date", "ticker"], "full_outer").select("factor", "date", "ticker", "value", "fwd_ret")
