"""Market regimes, rolling IC, CUSUM change points and factor health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.stats import SESSIONS, ratio
from factorspark.operators.calendar import asof_backward

REGIMES = ("low_vol_up", "low_vol_down", "high_vol_up", "high_vol_down")
#: Critical values of the Brownian bridge's largest excursion, by confidence.
CUSUM_CRITICAL = {0.90: 1.22, 0.95: 1.36, 0.99: 1.63}
ROLLING_IC = 36


def regime_inputs(benchmark: DataFrame, *, vol_window: int = 21, trend_window: int = 200, annualize: int = SESSIONS, expanding: bool = False) -> DataFrame:
    """(date, close, vol, trend, threshold) of a single series (date, close).

    One series of a few thousand sessions: its windows run in one task by nature.
    """
    w = Window.orderBy("date")
    px = benchmark.filter("close is not null").select("date", "close").withColumn("_r", ratio(F.col("close"), F.lag("close").over(w)) - 1)
    wv, wt = w.rowsBetween(1 - vol_window, 0), w.rowsBetween(1 - trend_window, 0)
    px = px.withColumn("vol", F.when(F.count("_r").over(wv) == vol_window, F.stddev_samp("_r").over(wv) * F.sqrt(F.lit(float(annualize)))))
    px = px.withColumn("trend", F.when(F.count("close").over(wt) == trend_window, F.avg("close").over(wt)))
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if expanding else Window.unboundedFollowing)
    return px.withColumn("threshold", F.percentile("vol", F.lit(0.5)).over(frame)).drop("_r")


def classify_regime(benchmark: DataFrame, **how) -> DataFrame:
    """(date, regime): volatility above its median and price above its trend, both strictly.

    With ``expanding`` the median uses the past only. Sessions without both full windows have none.
    """
    x = regime_inputs(benchmark, **how).filter("vol is not null and trend is not null")
    high, up = F.col("vol") > F.col("threshold"), F.col("close") > F.col("trend")
    label = F.when(high & up, "high_vol_up").when(high, "high_vol_down").when(up, "low_vol_up").otherwise("low_vol_down")
    return x.select("date", label.alias("regime"))


def regime_as_of(regime: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, regime): the last known regime at each of ``dates``; earlier dates are dropped."""
    return asof_backward(dates.select("date").distinct(), regime, value="regime")


def pit_regime_by_date(benchmark: DataFrame, dates: DataFrame, *, vol_window: int = 21, trend_window: int = 200) -> DataFrame:
    return regime_as_of(classify_regime(benchmark, vol_window=vol_window, trend_window=trend_window, expanding=True), dates)


def factor_regime_matrix(ic: DataFrame, regime: DataFrame) -> DataFrame:
    """(factor, regime, mean_ic, n) for all four regimes, n = 0 where none matched."""
    seen = ic.filter("ic is not null").join(regime, "date").groupBy("factor", "regime").agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n"))
    grid = ic.select("factor").distinct().select("factor", F.explode(F.array(*map(F.lit, REGIMES))).alias("regime"))
    return grid.join(seen, ["factor", "regime"], "left").select("factor", "regime", "mean_ic", F.coalesce("n", F.lit(0)).alias("n"))


def best_worst_regime(matrix: DataFrame) -> DataFrame:
    """(factor, best_regime, worst_regime); ties go to the regime named first in REGIMES."""
    place = F.array_position(F.array(*map(F.lit, REGIMES)), F.col("regime"))
    has = F.col("mean_ic").isNotNull()
    return matrix.groupBy("factor").agg(
        F.max_by("regime", F.when(has, F.struct("mean_ic", (-place).alias("p")))).alias("best_regime"), F.min_by("regime", F.when(has, F.struct("mean_ic", place.alias("p")))).alias("worst_regime"))


def rolling_ic(ic: DataFrame, *, window: int = ROLLING_IC) -> DataFrame:
    """(factor, date, ic, rolling): trailing mean, null under max(6, window // 3) observations."""
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(1 - window, 0)
    return ic.select("factor", "date", "ic", F.when(F.count("ic").over(w) >= max(6, window // 3), F.avg("ic").over(w)).alias("rolling"))


def cusum_path(ic: DataFrame) -> DataFrame:
    """(factor, date, k, n, ic, path): cumulated deviations from the mean over sd * sqrt(n)."""
    clean = ic.filter("ic is not null").select("factor", "date", "ic")
    every = Window.partitionBy("factor")
    w = every.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = clean.withColumns({"n": F.count("ic").over(every), "_m": F.avg("ic").over(every), "_s": F.stddev_samp("ic").over(every)})
    return x.select("factor", "date", F.row_number().over(every.orderBy("date")).alias("k"), "n", "ic", (F.sum(F.col("ic") - F.col("_m")).over(w) / F.nullif(F.col("_s") * F.sqrt("n"), F.lit(0.0))).alias("path"))


def cusum_test(ic: DataFrame, *, confidence: float = 0.95) -> DataFrame:
    """(factor, change_point, statistic, critical, triggered, mean_before, mean_after, is_decay).

    The first largest excursion is the change point and belongs to what is before. Too short or
    constant series have null results and don't trigger.
    """
    if confidence not in CUSUM_CRITICAL:
        raise ValueError(f"confidence must be one of {sorted(CUSUM_CRITICAL)}")
    critical = CUSUM_CRITICAL[confidence]
    path = cusum_path(ic)
    top = path.filter("path is not null and n >= 2").groupBy("factor").agg(F.min(F.struct((-F.round(F.abs("path"), 12)).alias("a"), "date", "k")).alias("s"))
    both = path.join(top, "factor").groupBy("factor").agg(
        F.first("s").alias("s"), F.avg(F.when(F.col("k") <= F.col("s.k"), F.col("ic"))).alias("mean_before"), F.avg(F.when(F.col("k") > F.col("s.k"), F.col("ic"))).alias("mean_after"))
    hit = (-F.col("s.a")) > critical
    out = both.select("factor", F.col("s.date").alias("change_point"), (-F.col("s.a")).alias("statistic"), hit.alias("triggered"), "mean_before", "mean_after",
                      (hit & F.coalesce(F.col("mean_after") < F.col("mean_before"), F.lit(False))).alias("is_decay"))
    every = ic.select("factor").distinct().join(out, "factor", "left")
    no = F.lit(False)
    return every.select("factor", "change_point", "statistic", F.lit(critical).alias("critical"), F.coalesce("triggered", no).alias("triggered"), "mean_before", "mean_after", F.coalesce("is_decay", no).alias("is_decay"))


def factor_health_report(ic: DataFrame, *, window: int = ROLLING_IC, confidence: float = 0.95) -> DataFrame:
    """(factor, current_rolling_ic, historical_mean_ic, decay_alert, alert_date)."""
    roll = rolling_ic(ic, window=window)
    now = roll.groupBy("factor").agg(F.max_by("rolling", F.when(F.col("rolling").isNotNull(), F.col("date"))).alias("current_rolling_ic"), F.avg("ic").alias("historical_mean_ic"))
    test = cusum_test(ic, confidence=confidence)
    return now.join(test, "factor").select("factor", "current_rolling_ic", "historical_mean_ic", F.col("is_decay").alias("decay_alert"), F.when(F.col("is_decay"), F.col("change_point")).alias("alert_date"))
