"""Performance metrics of NAV series (strategy, date, nav), one row per strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.stats import ratio
from factorspark.lineage import cut


def _by():
    return Window.partitionBy("strategy").orderBy("date")

#: Largest median gap in days of each cadence, and its periods per year; a longer gap is yearly.
CADENCES = ((3, 252), (10, 52), (45, 12), (120, 4))


def periods_per_year(df: DataFrame) -> DataFrame:
    """(strategy, ppy) from the median gap between dates; 252 with fewer than three."""
    gaps = df.select("strategy", "date", F.datediff("date", F.lag("date").over(_by())).alias("_g"))
    agg = gaps.groupBy("strategy").agg(F.count("*").alias("_n"), F.percentile("_g", F.lit(0.5)).alias("_m"))
    ppy = F.lit(1)
    for most, n in reversed(CADENCES):
        ppy = F.when(F.col("_m") <= most, n).otherwise(ppy)
    return agg.select("strategy", F.when(F.col("_n") < 3, 252).otherwise(ppy).alias("ppy"))


def to_returns(nav: DataFrame) -> DataFrame:
    """(strategy, date, ret) without the first date."""
    clean = nav.filter("nav is not null").select("strategy", "date", "nav")
    return clean.withColumn("ret", ratio(F.col("nav"), F.lag("nav").over(_by())) - 1).filter("ret is not null").select("strategy", "date", "ret")


def drawdown_series(nav: DataFrame) -> DataFrame:
    """(strategy, date, drawdown): nav over its running peak, less 1."""
    peak = F.max("nav").over(_by().rowsBetween(Window.unboundedPreceding, 0))
    return nav.filter("nav is not null").select("strategy", "date", (ratio(F.col("nav"), peak) - 1).alias("drawdown"))


def max_drawdown(nav: DataFrame) -> DataFrame:
    """(strategy, max_drawdown, max_dd_peak, max_dd_trough).

    The trough is the first date of the deepest drawdown, the peak the first date of the highest nav
    up to it; both are null if there never was a drawdown.
    """
    peak = F.max("nav").over(_by().rowsBetween(Window.unboundedPreceding, 0))
    at_peak = F.max(F.when(F.col("nav") == F.col("_p"), F.col("_first_peak"))).over(_by().rowsBetween(Window.unboundedPreceding, 0))
    x = nav.filter("nav is not null").withColumn("_p", peak)
    # a date is a peak's first if it is above everything before it
    prior = F.max("nav").over(_by().rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_first_peak", F.when(prior.isNull() | (F.col("nav") > prior), F.col("date")))
    x = x.withColumn("_peak_date", at_peak).withColumn("_dd", ratio(F.col("nav"), F.col("_p")) - 1)
    low = x.groupBy("strategy").agg(F.min(F.struct("_dd", "date", "_peak_date")).alias("m"))
    fell = F.col("m._dd") < 0
    return low.select("strategy", F.coalesce("m._dd", F.lit(0.0)).alias("max_drawdown"), F.when(fell, F.col("m._peak_date")).alias("max_dd_peak"), F.when(fell, F.col("m.date")).alias("max_dd_trough"))


def _cagr(first: Column, last: Column, n: Column, ppy: Column) -> Column:
    growth = ratio(last, first)
    return F.when(n < 2, 0.0).when(growth.isNull() | (growth <= 0), -1.0).otherwise(F.pow(F.greatest(growth, F.lit(1e-300)), ratio(ppy.cast("double"), (n - 1).cast("double"))) - 1)


def _risk(ret_mean: Column, ret_sd: Column, n: Column, ppy: Column, free: float) -> tuple[Column, Column]:
    vol = F.when(n < 2, 0.0).otherwise(ret_sd * F.sqrt(ppy.cast("double")))
    sharpe = F.when((n < 2) | (ret_sd == 0), 0.0).otherwise((ret_mean - F.lit(free) / ppy) / F.nullif(ret_sd, F.lit(0.0)) * F.sqrt(ppy.cast("double")))
    return vol, sharpe


def monthly_win_rate(nav: DataFrame) -> DataFrame:
    """(strategy, monthly_win_rate): share of months, by last nav, with a gain; 0 without a month's return."""
    months = nav.filter("nav is not null").groupBy("strategy", F.last_day("date").alias("date")).agg(F.max_by("nav", "date").alias("nav"))
    ret = to_returns(months).groupBy("strategy").agg(F.avg((F.col("ret") > 0).cast("double")).alias("monthly_win_rate"))
    return nav.select("strategy").distinct().join(ret, "strategy", "left").select("strategy", F.coalesce("monthly_win_rate", F.lit(0.0)).alias("monthly_win_rate"))


def annual_turnover(turnover: DataFrame) -> DataFrame:
    """(strategy, annual_turnover): mean turnover times the cadence of its dates."""
    mean = turnover.groupBy("strategy").agg(F.avg("turnover").alias("_t"))
    return mean.join(periods_per_year(turnover), "strategy").select("strategy", (F.col("_t") * F.col("ppy")).alias("annual_turnover"))


def benchmark_metrics(nav: DataFrame, benchmark: DataFrame, ppy: DataFrame) -> DataFrame:
    """(strategy, benchmark_cagr, information_ratio, tracking_error) against (date, nav) on common dates."""
    b = benchmark.filter("nav is not null").select("date", F.col("nav").alias("_b"))
    both = nav.filter("nav is not null").join(b, "date")
    agg = both.groupBy("strategy").agg(F.min_by("_b", "date").alias("_f"), F.max_by("_b", "date").alias("_l"), F.count("*").alias("_n"))
    diff = to_returns(nav).join(to_returns(both.select("strategy", "date", F.col("_b").alias("nav"))).withColumnRenamed("ret", "_r"), ["strategy", "date"])
    diff = diff.groupBy("strategy").agg(F.avg(F.col("ret") - F.col("_r")).alias("_m"), F.stddev_samp(F.col("ret") - F.col("_r")).alias("_s"), F.count("*").alias("_k"))
    x = agg.join(diff, "strategy", "left").join(ppy, "strategy")
    te, ir = _risk(F.col("_m"), F.col("_s"), F.coalesce("_k", F.lit(0)), F.col("ppy"), 0.0)
    return x.select("strategy", _cagr(F.col("_f"), F.col("_l"), F.col("_n"), F.col("ppy")).alias("benchmark_cagr"), ir.alias("information_ratio"), te.alias("tracking_error"))


def compute_metrics(nav: DataFrame, *, benchmark: DataFrame | None = None, turnover: DataFrame | None = None, periods: int | None = None, risk_free: float = 0.0) -> DataFrame:
    """One row per strategy with all metrics; the four relative ones are null without a benchmark."""
    nav = cut(nav.filter("nav is not null").select("strategy", "date", "nav"))  # read by every metric
    ppy = nav.select("strategy").distinct().withColumn("ppy", F.lit(periods)) if periods else periods_per_year(nav)
    ends = nav.groupBy("strategy").agg(F.min_by("nav", "date").alias("_f"), F.max_by("nav", "date").alias("_l"), F.count("*").alias("_n"))
    ret = to_returns(nav).groupBy("strategy").agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.count("*").alias("_k"))
    x = ends.join(ppy, "strategy").join(ret, "strategy", "left").join(max_drawdown(nav), "strategy").join(monthly_win_rate(nav), "strategy")
    x = x.join(annual_turnover(turnover), "strategy", "left") if turnover is not None else x.withColumn("annual_turnover", F.lit(0.0))
    cagr = _cagr(F.col("_f"), F.col("_l"), F.col("_n"), F.col("ppy"))
    vol, sharpe = _risk(F.col("_m"), F.col("_s"), F.coalesce("_k", F.lit(0)), F.col("ppy"), risk_free)
    out = x.select(
        "strategy", F.when(F.col("_n") < 2, 0.0).otherwise(ratio(F.col("_l"), F.col("_f")) - 1).alias("total_return"), cagr.alias("cagr"), vol.alias("annual_volatility"),
        sharpe.alias("sharpe"), "max_drawdown", "max_dd_peak", "max_dd_trough", ratio(cagr, F.abs("max_drawdown")).alias("calmar"), "monthly_win_rate",
        F.coalesce("annual_turnover", F.lit(0.0)).alias("annual_turnover"), F.col("ppy").alias("periods_per_year"))
    if benchmark is None:
        none = F.lit(None).cast("double")
        return out.withColumns({"benchmark_cagr": none, "excess_cagr": none, "information_ratio": none, "tracking_error": none})
    rel = benchmark_metrics(nav, benchmark, ppy)
    return out.join(rel, "strategy", "left").select(*out.columns, "benchmark_cagr", (F.col("cagr") - F.col("benchmark_cagr")).alias("excess_cagr"), "information_ratio", "tracking_error")


def rebase(benchmark: DataFrame, days: DataFrame, capital: float) -> DataFrame:
    """(date, nav): a benchmark (date, close) on the sessions ``days``, forward-filled, starting at ``capital``."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    on = days.select("date").join(benchmark.select("date", "close"), "date", "left").withColumn("close", F.last("close", ignorenulls=True).over(w))
    first = F.first("close", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return on.select("date", (ratio(F.col("close"), first) * F.lit(float(capital))).alias("nav"))
