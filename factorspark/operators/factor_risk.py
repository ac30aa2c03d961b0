"""Factor risk model: exposures, cross-sectional regressions, covariance and attribution."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.functions.stats import ratio, winsorize, zscore
from factorspark.operators.covariance import sample_covariance


def exposure_panel(panel: DataFrame, *, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """(date, ticker, factor, z): each factor's cross-section winsorised, then z-scored."""
    by = ["factor", "date"]
    clipped = winsorize(panel.select("factor", "date", "ticker", "value"), "value", by, lower=lower, upper=upper)
    return zscore(clipped, "value", by, out="z").select("date", "ticker", "factor", "z")


@dataclass
class Regressions:
    """factor_returns (date, factor, ret) and specific_returns (date, ticker, resid)."""

    factor_returns: DataFrame
    specific_returns: DataFrame


def cross_sectional_regressions(exposures: DataFrame, returns: DataFrame, factors: list[str], *, add_intercept: bool = True, min_names: int | None = None) -> Regressions:
    """Least squares of each date's ``returns`` (date, ticker, ret) on its exposures.

    Only names with a return and all exposures take part; a date with fewer than ``min_names``
    (default: one more than there are coefficients) has no result. Each date is one small group.
    """
    k = len(factors)
    least = k + (2 if add_intercept else 1) if min_names is None else min_names
    wide = exposures.groupBy("date", "ticker").pivot("factor", factors).agg(F.first("z")).join(returns.select("date", "ticker", "ret"), ["date", "ticker"])
    wide = wide.na.drop("any", subset=[*factors, "ret"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = ["date", "kind", "name", "value"]
        if len(pdf) < least:
            return pd.DataFrame(columns=cols)
        pdf = pdf.sort_values("ticker")
        x = pdf[factors].to_numpy(float)
        x = np.column_stack([np.ones(len(x)), x]) if add_intercept else x
        y = pdf["ret"].to_numpy(float)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        slopes = beta[1:] if add_intercept else beta
        day = pdf["date"].iloc[0]
        out = [(day, "factor", f, float(b)) for f, b in zip(factors, slopes, strict=True)]
        out += [(day, "resid", t, float(r)) for t, r in zip(pdf["ticker"], y - x @ beta, strict=True)]
        return pd.DataFrame(out, columns=cols)

    fit = wide.groupBy("date").applyInPandas(run, "date date, kind string, name string, value double")
    return Regressions(
        fit.filter("kind = 'factor'").select("date", F.col("name").alias("factor"), F.col("value").alias("ret")),
        fit.filter("kind = 'resid'").select("date", F.col("name").alias("ticker"), F.col("value").alias("resid")))


def single_factor_regressions(exposures: DataFrame, returns: DataFrame) -> DataFrame:
    """(date, factor, slope, intercept, n) of one-factor regressions, as built-in aggregates."""
    both = exposures.join(returns.select("date", "ticker", "ret"), ["date", "ticker"]).filter("z is not null and ret is not null")
    agg = both.groupBy("date", "factor").agg(F.covar_samp("z", "ret").alias("_c"), F.var_samp("z").alias("_v"), F.avg("z").alias("_x"), F.avg("ret").alias("_y"), F.count("*").alias("n"))
    slope = ratio(F.col("_c"), F.col("_v"))
    return agg.filter("n >= 3").select("date", "factor", slope.alias("slope"), (F.col("_y") - slope * F.col("_x")).alias("intercept"), "n")


def specific_variance(specific: DataFrame, *, min_periods: int = 2) -> DataFrame:
    """(ticker, variance): sample variance of the residuals, null under ``min_periods`` of them."""
    return specific.groupBy("ticker").agg(F.when(F.count("resid") >= min_periods, F.var_samp("resid")).alias("variance"))


def portfolio_exposure(weights: DataFrame, exposures: DataFrame, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """(*by, factor, exposure): sum of weight times z; a held name without an exposure adds nothing."""
    held = weights.select(*by, "ticker", "weight")
    return exposures.join(held, [*by, "ticker"], "left").groupBy(*by, "factor").agg(F.sum(F.coalesce("weight", F.lit(0.0)) * F.coalesce("z", F.lit(0.0))).alias("exposure"))


def exposure_profile(weights: DataFrame, exposures: DataFrame, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """``portfolio_exposure`` with the number of names held."""
    n = weights.filter("weight <> 0").groupBy(*by).agg(F.count("*").alias("n_held"))
    return portfolio_exposure(weights, exposures, by).join(n, list(by), "left").withColumn("n_held", F.coalesce("n_held", F.lit(0)))


def decompose(weights: DataFrame, exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variance of one portfolio: (factor, exposure, contribution) rows and a one-row total
    (total_variance, factor_variance, specific_variance, factor_pct, specific_pct).

    Contributions are exposure_i * sum_j cov_ij * exposure_j and sum to the factor variance; names
    without a specific variance add none.
    """
    held = exposures.join(weights.select("ticker", "weight"), "ticker", "left")
    e = held.groupBy("factor").agg(F.sum(F.coalesce("weight", F.lit(0.0)) * F.coalesce("z", F.lit(0.0))).alias("exposure"))
    ei = e.select(F.col("factor").alias("i"), F.col("exposure").alias("_i"))
    ej = e.select(F.col("factor").alias("j"), F.col("exposure").alias("_j"))
    parts = factor_cov.join(ei, "i").join(ej, "j").groupBy("i").agg(F.max("_i").alias("exposure"), F.sum(F.col("_i") * F.col("cov") * F.col("_j")).alias("contribution"))
    parts = parts.select(F.col("i").alias("factor"), "exposure", "contribution")
    own = specific.filter("variance is not null").join(weights.select("ticker", "weight"), "ticker").agg(F.coalesce(F.sum(F.col("weight") * F.col("weight") * F.col("variance")), F.lit(0.0)).alias("s"))
    f = parts.agg(F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("f"))
    total = f.join(own).select((F.col("f") + F.col("s")).alias("total_variance"), F.col("f").alias("factor_variance"), F.col("s").alias("specific_variance"))
    return parts, total.withColumns({"factor_pct": ratio(F.col("factor_variance"), F.col("total_variance")), "specific_pct": ratio(F.col("specific_variance"), F.col("total_variance"))})


class FactorRiskModel:
    """Regressions over time, then factor covariance, specific variance and decomposition."""

    def __init__(self, factors: list[str], *, add_intercept: bool = True, min_names: int | None = None) -> None:
        self.factors, self.add_intercept, self.min_names = factors, add_intercept, min_names

    def fit(self, exposures: DataFrame, returns: DataFrame) -> FactorRiskModel:
        r = cross_sectional_regressions(exposures, returns, self.factors, add_intercept=self.add_intercept, min_names=self.min_names)
        self.factor_returns_, self.specific_returns_ = r.factor_returns, r.specific_returns
        return self

    def factor_covariance(self, estimator: Callable[[DataFrame], DataFrame] = sample_covariance) -> DataFrame:
        return estimator(self.factor_returns_.withColumnRenamed("factor", "asset"))

    def specific_variance(self, min_periods: int = 2) -> DataFrame:
        return specific_variance(self.specific_returns_, min_periods=min_periods)

    def decompose(self, weights: DataFrame, exposures: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
        return decompose(weights, exposures, self.factor_covariance(**how), self.specific_variance())
