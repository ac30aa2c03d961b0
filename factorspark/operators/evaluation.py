"""Factor evaluation over a panel (factor, date, ticker, value, fwd_ret)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.stats import MONTHS, RANK_DECIMALS, annualize, average_rank, correlation, deciles, ratio


def information_coefficient(panel: DataFrame, *, method: str = "spearman") -> DataFrame:
    """(factor, date, ic) of the dates with at least two complete pairs."""
    return correlation(panel, "value", "fwd_ret", ["factor", "date"], method=method, out="ic").select("factor", "date", "ic")


def ic_summary(ic: DataFrame) -> DataFrame:
    """(factor, n, mean, std, icir, t_stat, hit_rate) of IC series; ratios are null where std is 0.

    An IC that is zero but for the order of summing is no hit."""
    agg = ic.filter("ic is not null").groupBy("factor").agg(
        F.count("*").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.round("ic", RANK_DECIMALS) > 0).cast("double")).alias("hit_rate"))
    icir = ratio(F.col("mean"), F.col("std"))
    return agg.select("factor", "n", "mean", "std", icir.alias("icir"), (icir * F.sqrt("n")).alias("t_stat"), "hit_rate")


def decile_returns(panel: DataFrame, *, n: int = 10) -> DataFrame:
    """(factor, date, bucket, ret): mean forward return by bucket.

    Buckets are cut over all names with a value; names without a forward return drop out after.
    """
    cut = deciles(panel, "value", ["factor", "date"], n=n)
    return cut.filter("bucket is not null and fwd_ret is not null").groupBy("factor", "date", "bucket").agg(F.avg("fwd_ret").alias("ret"))


def decile_annualized(returns: DataFrame, *, periods_per_year: int = MONTHS) -> DataFrame:
    """(factor, bucket, n, annualized) by compounding the bucket's returns."""
    agg = returns.groupBy("factor", "bucket").agg(F.count("ret").alias("n"), F.product(1 + F.col("ret")).alias("_g"))
    return agg.select("factor", "bucket", "n", annualize(F.col("_g"), F.col("n"), periods_per_year).alias("annualized"))


def long_short(returns: DataFrame, *, n: int = 10) -> DataFrame:
    """(factor, date, ret): top bucket less bottom bucket, on dates that have both."""
    top = F.max(F.when(F.col("bucket") == n, F.col("ret")))
    bottom = F.max(F.when(F.col("bucket") == 1, F.col("ret")))
    return returns.groupBy("factor", "date").agg((top - bottom).alias("ret")).filter("ret is not null")


def decile_summary(returns: DataFrame, *, n: int = 10, periods_per_year: int = MONTHS) -> DataFrame:
    """(factor, long_short_annualized, monotonicity); monotonicity is Spearman of bucket against
    annualised return, null with fewer than two buckets."""
    ls = long_short(returns, n=n).groupBy("factor").agg(F.count("ret").alias("_n"), F.product(1 + F.col("ret")).alias("_g"))
    ls = ls.select("factor", annualize(F.col("_g"), F.col("_n"), periods_per_year).alias("long_short_annualized"))
    ann = decile_annualized(returns, periods_per_year=periods_per_year)
    mono = correlation(ann.withColumn("bucket", F.col("bucket").cast("double")), "bucket", "annualized", ["factor"], out="monotonicity").select("factor", "monotonicity")
    return returns.select("factor").distinct().join(ls, "factor", "left").join(mono, "factor", "left")


def rank_autocorrelation(panel: DataFrame, *, lag: int = 1, method: str = "spearman") -> DataFrame:
    """(factor, date, autocorr): ranks now against ranks ``lag`` panel dates before, by the later date."""
    if lag < 1:
        raise ValueError("lag must be >= 1")
    days = panel.select("factor", "date").distinct()
    days = days.withColumn("_k", F.row_number().over(Window.partitionBy("factor").orderBy("date")))
    now = panel.filter("value is not null").join(days, ["factor", "date"]).select("factor", "date", "_k", "ticker", "value")
    before = now.select("factor", (F.col("_k") + lag).alias("_k"), "ticker", F.col("value").alias("_before"))
    return correlation(now.join(before, ["factor", "_k", "ticker"]), "_before", "value", ["factor", "date"], method=method, out="autocorr").select("factor", "date", "autocorr")


def factor_correlation(panel: DataFrame, *, method: str = "spearman") -> DataFrame:
    """(f1, f2, corr): mean over the dates all factors share of their pairwise correlations.

    Each pair uses the names both factors have on that date.
    """
    n = panel.select("factor").distinct()
    shared = panel.select("factor", "date").distinct().groupBy("date").agg(F.count("*").alias("_c"))
    dates = shared.join(F.broadcast(n.agg(F.count("*").alias("_n"))), F.col("_c") == F.col("_n")).select("date")
    v = panel.filter("value is not null").join(F.broadcast(dates), "date", "left_semi").select("factor", "date", "ticker", "value")
    a = v.select(F.col("factor").alias("f1"), "date", "ticker", F.col("value").alias("_a"))
    b = v.select(F.col("factor").alias("f2"), "date", "ticker", F.col("value").alias("_b"))
    per_date = correlation(a.join(b, ["date", "ticker"]), "_a", "_b", ["f1", "f2", "date"], method=method)
    return per_date.groupBy("f1", "f2").agg(F.avg("corr").alias("corr"))


def ranks(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """``df`` with the average rank of ``col`` as ``rank``; rows without a value are left out."""
    return df.filter(F.col(col).isNotNull()).withColumn("rank", average_rank(col, by))
