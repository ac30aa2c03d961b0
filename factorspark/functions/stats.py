"""Cross-sectional statistics over long tables.

All take a long DataFrame and partition columns ``by``; missing values are null. Divisions are
guarded, since a session may run under ANSI rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks compare values rounded to so many decimals, so that the order of summing can't flip ties.
RANK_DECIMALS = 12
MONTHS, SESSIONS = 12, 252


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def null_nan(df: DataFrame, *cols: str) -> DataFrame:
    """NaN as null in the given (default: all floating) columns; the boundary rule for new data."""
    names = cols or tuple(f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float"))
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def winsorize(df: DataFrame, col: str, by: Sequence[str], *, lower: float = 0.01, upper: float = 0.99, out: str | None = None) -> DataFrame:
    """``col`` clipped to its cross-section's quantiles (linear interpolation); nulls stay null."""
    if not 0 <= lower < upper <= 1:
        raise ValueError("need 0 <= lower < upper <= 1")
    bounds = df.groupBy(*by).agg(F.percentile(col, F.array(F.lit(lower), F.lit(upper))).alias("_q"))
    clipped = F.when(F.col(col).isNotNull(), F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], F.col(col))))
    return df.join(bounds, list(by)).withColumn(out or col, clipped).drop("_q")


def zscore(df: DataFrame, col: str, by: Sequence[str], *, out: str | None = None) -> DataFrame:
    """(x - mean) / sample deviation per cross-section; centred only where that is nil.

    A deviation below 1e-12 of the mean's size counts as nil: rounding leaves such dust on a
    constant column, and dividing by it would blow the scores up.
    """
    w = Window.partitionBy(*by)
    mean, sd = F.avg(col).over(w), F.stddev_samp(col).over(w)
    fine = F.when(sd > F.lit(1e-12) * F.greatest(F.lit(1.0), F.abs(mean)), sd)
    return df.withColumn(out or col, F.coalesce((F.col(col) - mean) / fine, F.col(col) - mean))


def bucket(rank: Column, m: Column, n: int) -> Column:
    """Equal-count bucket of rank r among m names: quantile cuts of 1..m, at most m buckets."""
    k = F.least(F.lit(n), m)
    # (r-1)k/(m-1) in whole numbers, rounded up
    up = F.floor(((rank - 1) * k + m - 2) / F.nullif(m - 1, F.lit(0))).cast("int")
    return F.when(rank == 1, 1).otherwise(up)


def deciles(df: DataFrame, col: str, by: Sequence[str], *, n: int = 10, key: str = "ticker", out: str = "bucket") -> DataFrame:
    """Bucket 1 (lowest) to n (highest) of the non-null values; ties go by ``key``; null stays null."""
    if n < 1:
        raise ValueError("n must be at least 1")
    has = F.col(col).isNotNull()
    w = Window.partitionBy(*by, has).orderBy(F.round(col, RANK_DECIMALS), key)
    m = F.count(col).over(Window.partitionBy(*by)).cast("int")
    return df.withColumn(out, F.when(has, bucket(F.row_number().over(w), m, n)))


def average_rank(col: str, by: Sequence[str]) -> Column:
    """Rank with ties at their mean; the caller has removed nulls."""
    v = F.round(col, RANK_DECIMALS)
    first = F.rank().over(Window.partitionBy(*by).orderBy(v))
    return first + (F.count(F.lit(1)).over(Window.partitionBy(*by, v)) - 1) / F.lit(2.0)


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str], *, method: str = "spearman", out: str = "corr") -> DataFrame:
    """Correlation of the complete pairs of each group; groups without one are left out.

    ``method``: spearman (Pearson of average ranks) or pearson. Fewer than two pairs or a constant
    side give no row.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError("method must be 'spearman' or 'pearson'")
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if method == "spearman":
        pairs = pairs.withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)})
    else:
        pairs = pairs.withColumns({"_x": F.col(x), "_y": F.col(y)})
    agg = pairs.groupBy(*by).agg(F.covar_samp("_x", "_y").alias("_c"), F.stddev_samp("_x").alias("_sx"), F.stddev_samp("_y").alias("_sy"), F.count("*").alias("n"))
    return agg.select(*by, ratio(F.col("_c"), F.col("_sx") * F.col("_sy")).alias(out), "n").filter(F.col(out).isNotNull() & (F.col("n") >= 2))


def annualize(growth: Column, n: Column, periods_per_year: Column | int) -> Column:
    """growth ** (ppy / n) - 1; null without periods or for growth that isn't positive."""
    ppy = F.lit(periods_per_year) if isinstance(periods_per_year, int) else periods_per_year
    return F.when((n > 0) & (growth > 0), F.pow(growth, ratio(ppy.cast("double"), n.cast("double"))) - 1)


def product(col: Column) -> Column:
    """Product of an aggregate's values, null-skipping."""
    return F.product(col)
