"""What each chart shows, as a small DataFrame: any plotting tool draws them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.stats import ratio
from factorspark.operators import evaluation, metrics, monitor

#: Observations of the rolling mean in IC charts.
ROLL = 12


def nav_chart(nav: DataFrame, benchmark: DataFrame | None = None, *, label: str = "Benchmark") -> DataFrame:
    """(strategy, date, nav) of every strategy, and of the benchmark (date, nav) as one more line."""
    lines = nav.select("strategy", "date", "nav")
    return lines if benchmark is None else lines.unionByName(benchmark.select(F.lit(label).alias("strategy"), "date", "nav"))


def drawdown_chart(nav: DataFrame) -> DataFrame:
    """(strategy, date, drawdown_pct)."""
    return metrics.drawdown_series(nav).select("strategy", "date", (F.col("drawdown") * 100).alias("drawdown_pct"))


def ic_chart(ic: DataFrame, *, roll: int = ROLL) -> DataFrame:
    """(factor, date, ic, rolling, mean): bars, their mean over the last ``roll`` (null before there are so many), the overall mean."""
    clean = ic.filter("ic is not null")
    last = Window.partitionBy("factor").orderBy("date").rowsBetween(1 - roll, 0)
    return clean.select("factor", "date", "ic", F.when(F.count("ic").over(last) == roll, F.avg("ic").over(last)).alias("rolling"), F.avg("ic").over(Window.partitionBy("factor")).alias("mean"))


def decile_chart(panel: DataFrame, *, n: int = 10) -> DataFrame:
    """(factor, bucket, annualized_pct)."""
    ann = evaluation.decile_annualized(evaluation.decile_returns(panel, n=n))
    return ann.filter("annualized is not null").select("factor", "bucket", (F.col("annualized") * 100).alias("annualized_pct"))


def correlation_chart(panel: DataFrame) -> DataFrame:
    """(f1, f2, corr, label)."""
    c = evaluation.factor_correlation(panel)
    return c.select("f1", "f2", "corr", F.format_string("%+.2f", "corr").alias("label"))


def health_chart(ic: DataFrame, *, window: int = monitor.ROLLING_IC) -> DataFrame:
    """(factor, date, ic, rolling, alert): alert marks the date of a decay."""
    alerts = monitor.factor_health_report(ic, window=window).select("factor", "alert_date")
    rolled = monitor.rolling_ic(ic.filter("ic is not null"), window=window).join(alerts, "factor", "left")
    return rolled.select("factor", "date", "ic", "rolling", F.coalesce(F.col("date") == F.col("alert_date"), F.lit(False)).alias("alert"))


def regime_chart(matrix: DataFrame) -> DataFrame:
    """(factor, regime, mean_ic, n, shade): shade is the mean over the largest absolute mean, -1 to 1."""
    top = F.max(F.abs("mean_ic")).over(Window.partitionBy(F.lit(1)))  # factors x regimes: a few rows
    return matrix.select("factor", "regime", "mean_ic", "n", ratio(F.col("mean_ic"), top).alias("shade"))


def exposure_chart(profile: DataFrame) -> DataFrame:
    """(date, factor, exposure, n_held) of the latest date with anything held, from an exposure profile by date."""
    last = profile.filter("n_held > 0").agg(F.max("date").alias("date"))
    return profile.join(F.broadcast(last), "date").select("date", "factor", "exposure", "n_held")


def average_exposure(profile: DataFrame) -> DataFrame:
    """(factor, exposure, n): mean exposure over the dates with anything held."""
    return profile.filter("n_held > 0").groupBy("factor").agg(F.avg("exposure").alias("exposure"), F.count("*").alias("n"))


def risk_chart(parts: DataFrame, total: DataFrame) -> DataFrame:
    """(label, variance): the specific variance and a bar for each factor's contribution."""
    own = total.select(F.lit("Specific").alias("label"), F.col("specific_variance").alias("variance"))
    return own.unionByName(parts.select(F.col("factor").alias("label"), F.col("contribution").alias("variance")))


def evaluation_table(panel: DataFrame, *, n: int = 10) -> DataFrame:
    """One row per factor: IC summary, long-short, top and bottom bucket, monotonicity, mean rank autocorrelation."""
    ret = evaluation.decile_returns(panel, n=n)
    ends = evaluation.decile_annualized(ret).groupBy("factor").agg(
        F.max(F.when(F.col("bucket") == n, F.col("annualized"))).alias("top"), F.max(F.when(F.col("bucket") == 1, F.col("annualized"))).alias("bottom"))
    auto = evaluation.rank_autocorrelation(panel).groupBy("factor").agg(F.avg("autocorr").alias("rank_autocorr"))
    out = evaluation.ic_summary(evaluation.information_coefficient(panel))
    for more in (evaluation.decile_summary(ret, n=n), ends, auto):
        out = out.join(more, "factor", "left")
    return out
