"""Target weights (strategy, decision_date, ticker, weight) from factor panels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.stats import deciles, winsorize, zscore
from factorspark.lineage import cut
from factorspark.operators.calendar import dense, forward_fill, sessions
from factorspark.operators.covariance import CovarianceEstimator, LedoitWolfCovariance
from factorspark.operators.factors import MomentumFactor, month_number, month_prices
from factorspark.operators.portfolio import mean_variance_chain, risk_parity_by_date

TOP = (9, 10)
#: Optimised weights of no more than this are dropped.
DUST = 1e-6


def top_bucket_weights(scores: DataFrame, strategy: str, *, col: str = "value", n: int = 10, top: tuple[int, ...] = TOP) -> DataFrame:
    """Equal weights over the names of (date, ticker, ``col``) in the ``top`` of ``n`` buckets."""
    picked = deciles(scores, col, ["date"], n=n).filter(F.col("bucket").isin(*top))
    w = 1 / F.count("*").over(Window.partitionBy("date"))
    return picked.select(F.lit(strategy).alias("strategy"), F.col("date").alias("decision_date"), "ticker", w.alias("weight"))


def momentum_weights(bars: DataFrame, dates: DataFrame, members: DataFrame | None = None, *, strategy: str = "momentum", factor: MomentumFactor | None = None, **how) -> DataFrame:
    return top_bucket_weights((factor or MomentumFactor()).panel(bars, dates, members), strategy, **how)


def regime_conditioned_weights(ic: DataFrame, regime: DataFrame, *, negative: str = "invert", min_obs: int = 6) -> DataFrame:
    """(date, factor, weight): factor mix of each date of ``regime`` (date, regime).

    A factor counts with its mean IC over strictly earlier dates of the date's regime, 0 with fewer
    than ``min_obs`` of them or, under ``zero``, where negative. Weights add up to 1 in absolute
    value; where all are 0 every factor gets the same.
    """
    if negative not in ("invert", "zero"):
        raise ValueError("negative must be 'invert' or 'zero'")
    seen = ic.filter("ic is not null").join(regime, "date").select("factor", "regime", "date", "ic", F.lit(1).alias("_obs"))
    asked = ic.select("factor").distinct().join(regime).select("factor", "regime", "date", F.lit(None).cast("double").alias("ic"), F.lit(0).alias("_obs"))
    # the frame ends before the date itself: its own observation is not known yet
    w = Window.partitionBy("factor", "regime").orderBy(F.unix_date("date")).rangeBetween(Window.unboundedPreceding, -1)
    x = seen.unionByName(asked).withColumns({"_m": F.avg("ic").over(w), "_n": F.count("ic").over(w)}).filter("_obs = 0")
    raw = F.when(F.col("_n") < min_obs, 0.0).otherwise(F.col("_m") if negative == "invert" else F.greatest(F.lit(0.0), F.col("_m")))
    x = x.select("date", "factor", raw.alias("_raw"))
    per = Window.partitionBy("date")
    l1, k = F.sum(F.abs("_raw")).over(per), F.count("*").over(per)
    return x.select("date", "factor", F.when(l1 > 0, F.col("_raw") / F.nullif(l1, F.lit(0.0))).otherwise(1 / k).alias("weight"))


def composite_score(exposures: DataFrame, mix: DataFrame) -> DataFrame:
    """(date, ticker, score): sum of factor weight times z; a missing z or weight adds 0."""
    both = exposures.join(mix.select("date", "factor", "weight"), ["date", "factor"], "left")
    dates = mix.select("date").distinct()
    return both.join(dates, "date", "left_semi").groupBy("date", "ticker").agg(F.sum(F.coalesce("weight", F.lit(0.0)) * F.coalesce("z", F.lit(0.0))).alias("score"))


def regime_adaptive_weights(exposures: DataFrame, ic: DataFrame, regime: DataFrame, *, strategy: str = "regime_adaptive", negative: str = "invert", min_obs: int = 6, n: int = 10,
                            top: tuple[int, ...] = TOP, score_domain: str = "panel") -> tuple[DataFrame, DataFrame]:
    """(weights, factor mix). ``score_domain``: ``panel`` ranks every name with a row, where those
    without any exposure score 0; ``members`` leaves them out."""
    if score_domain not in ("panel", "members"):
        raise ValueError("score_domain must be 'panel' or 'members'")
    mix = regime_conditioned_weights(ic, regime, negative=negative, min_obs=min_obs)
    used = exposures if score_domain == "panel" else exposures.filter("z is not null")
    return top_bucket_weights(composite_score(used, mix), strategy, col="score", n=n, top=top), mix


def static_multifactor_weights(exposures: DataFrame, *, strategy: str = "static_multifactor", n: int = 10, top: tuple[int, ...] = TOP) -> DataFrame:
    """Equal mix of all factors: the mean of a name's exposures, names without any left out."""
    score = exposures.groupBy("date", "ticker").agg(F.avg("z").alias("score"))
    return top_bucket_weights(score, strategy, col="score", n=n, top=top)


def monthly_returns(bars: DataFrame) -> DataFrame:
    """(ticker, m, ret) between neighbouring months' last prices."""
    p = month_prices(bars)
    nxt = p.select("ticker", (F.col("m") + 1).alias("m"), F.col("price").alias("_q"))
    return p.join(nxt, ["ticker", "m"]).select("ticker", "m", (F.col("price") / F.nullif("_q", F.lit(0.0)) - 1).alias("ret"))


def trailing_returns(bars: DataFrame, dates: DataFrame, *, months: int = 24, recent: int = 6, names: DataFrame | None = None) -> DataFrame:
    """(as_of, date, asset, ret): the last ``months`` monthly returns known at each (date) of ``dates``; date is the month's number.

    Assets need a return in all of the last ``recent`` months; ``names`` (date, ticker) limits them by date.
    Nothing after a date enters its rows.
    """
    ret = monthly_returns(bars).select("ticker", "m", "ret")
    last = F.when(F.last_day("date") > F.col("date"), month_number("date") - 1).otherwise(month_number("date"))
    asked = dates.select("date").distinct().withColumn("_m", last).withColumn("m", F.explode(F.sequence(F.col("_m") - months + 1, F.col("_m"))))
    rows = asked.join(ret, "m")
    if names is not None:
        rows = rows.join(names.select("date", "ticker").distinct(), ["date", "ticker"], "left_semi")
    new = F.sum((F.col("m") > F.col("_m") - recent).cast("int")).over(Window.partitionBy("date", "ticker"))
    return rows.withColumn("_n", new).filter(F.col("_n") == recent).select(F.col("date").alias("as_of"), F.col("m").alias("date"), F.col("ticker").alias("asset"), "ret")


def trailing_covariance(returns: DataFrame, estimator: CovarianceEstimator | None = None) -> DataFrame:
    """(date, i, j, cov) of ``trailing_returns``: every date's own matrix, all dates side by side; dates with one asset have none."""
    several = returns.groupBy("as_of").agg(F.countDistinct("asset").alias("_n")).filter("_n > 1")
    used = returns.join(several, "as_of", "left_semi")
    return (estimator or LedoitWolfCovariance()).estimate(used, by=("as_of",)).select(F.col("as_of").alias("date"), "i", "j", "cov")


def three_weight_schemes(bars: DataFrame, panel: DataFrame, *, months: int = 24, recent: int = 6, cap: float = 0.02, risk_aversion: float = 5.0, turnover_penalty: float = 0.01,
                         n: int = 10, top: tuple[int, ...] = TOP, estimator: CovarianceEstimator | None = None) -> DataFrame:
    """Targets of three strategies over the same top-bucket names: equal, mvo and erc.

    Alpha is the winsorised z-score over the whole cross-section. A cap too low to invest fully is
    raised to what equal weights need. Covariances (default Ledoit-Wolf) and risk parity are
    worked out date by date in parallel; only the mean-variance solutions, each anchored to the
    one before, follow one another. A date with fewer than two names of enough history has equal weights in all
    three.
    """
    chosen = deciles(panel, "value", ["date"], n=n).filter(F.col("bucket").isin(*top)).select("date", "ticker")
    alpha = zscore(winsorize(panel.select("date", "ticker", "value"), "value", ["date"]), "value", ["date"])
    share = 1 / F.count("*").over(Window.partitionBy("date"))
    equal = chosen.select("date", "ticker", share.alias("weight"))
    cov = cut(trailing_covariance(trailing_returns(bars, chosen, months=months, recent=recent, names=chosen), estimator))
    fit = cov.select("date", F.col("i").alias("ticker")).distinct()
    asked = fit.join(alpha, ["date", "ticker"], "left").select(F.lit("mvo").alias("strategy"), "date", "ticker", F.coalesce("value", F.lit(0.0)).alias("alpha"))
    solved = {
        "mvo": mean_variance_chain(asked, cov, risk_aversion=risk_aversion, max_weight=cap, raise_cap=True, turnover_penalty=turnover_penalty),
        "erc": risk_parity_by_date(cov, max_weight=cap, raise_cap=True),
    }
    rest = equal.join(cov.select("date").distinct(), "date", "left_anti")
    out = equal.withColumn("strategy", F.lit("equal"))
    for name, weights in solved.items():
        kept = weights.filter(F.col("weight") > DUST).select("date", "ticker", "weight").unionByName(rest)
        out = out.unionByName(kept.withColumn("strategy", F.lit(name)))
    return out.select("strategy", F.col("date").alias("decision_date"), "ticker", "weight")


def filled_marks(bars: DataFrame, col: str = "adj_close") -> DataFrame:
    """(date, ticker, mark) on the dense grid, forward-filled."""
    grid = dense(bars.select("date", "ticker", col), sessions(bars))
    return grid.select("date", "ticker", forward_fill(col, ["ticker"], "ord").alias("mark"))


def as_array(weights: DataFrame) -> np.ndarray:
    """Weights of a small portfolio as an array, by ticker; for the driver's own use."""
    return np.array([r["weight"] for r in weights.orderBy("ticker").collect()])
