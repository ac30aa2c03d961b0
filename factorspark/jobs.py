"""Experiments from the command line: ``python -m factorspark.jobs NAME --tables FOLDER --out FOLDER``.

Each writes its result tables as CSV folders and a Markdown report into ``--out``.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.operators import backtest, covariance, evaluation, factor_risk, factors, membership, metrics, monitor, strategies
from factorspark.operators.costs import CostModel
from factorspark.plans.market import Market
from factorspark.reports import charts, text
from factorspark.sources import prices
from factorspark.sources.config import load_cost_model, write_csv

#: Names asked for beside the index's members: the benchmark.
EXTRA = ("SPY",)


def _save(out: Path, **tables: DataFrame) -> None:
    for name, df in tables.items():
        write_csv(df, str(out / name), order=[c for c in ("strategy", "factor", "date") if c in df.columns])


def _run(m: Market, targets: DataFrame, costs: CostModel) -> tuple[backtest.BacktestResult, DataFrame]:
    fills = m.bars.select("date", "ticker", prices.derived("adj_open").alias("adj_open"))
    res = backtest.run_backtest(m.bars, targets, cost_model=costs, execution_prices=fills, execution_lag=1, defer_halted=True)
    bench = metrics.rebase(m.benchmark, m.sessions, res.initial_capital)
    return res, metrics.compute_metrics(res.nav, benchmark=bench, turnover=res.turnover)


def evaluate(m: Market, out: Path, costs: CostModel) -> None:
    panel = m.panel()
    table, corr = charts.evaluation_table(panel), evaluation.factor_correlation(panel)
    _save(out, summary=table, correlation=corr, ic=charts.ic_chart(m.ic), deciles=charts.decile_chart(panel))
    text.evaluation_markdown(table, corr, out / "evaluation.md")


def monitoring(m: Market, out: Path, costs: CostModel) -> None:
    regimes = monitor.factor_regime_matrix(m.ic, monitor.regime_as_of(m.regime, m.calendar))
    health, tests = monitor.factor_health_report(m.ic), monitor.cusum_test(m.ic)
    _save(out, health=health, breaks=tests, regimes=charts.regime_chart(regimes), rolling=charts.health_chart(m.ic))
    text.monitoring_markdown(health, tests, regimes, monitor.best_worst_regime(regimes), out / "monitoring.md")


def momentum(m: Market, out: Path, costs: CostModel) -> None:
    res, measured = _run(m, m.momentum_targets, costs)
    _save(out, nav=charts.nav_chart(res.nav), drawdown=charts.drawdown_chart(res.nav), trades=res.trades, skipped=res.skipped, metrics=measured)
    text.metrics_markdown(measured, out / "momentum.md", title="Momentum")


def comparison(m: Market, out: Path, costs: CostModel) -> None:
    targets = strategies.three_weight_schemes(m.bars, m.panel(factors.MomentumFactor))
    res, measured = _run(m, targets, costs)
    _save(out, nav=charts.nav_chart(res.nav), metrics=measured)
    text.comparison_markdown(measured, out / "comparison.md", order=["equal", "mvo", "erc"])


def adaptive(m: Market, out: Path, costs: CostModel) -> None:
    weights, mix = strategies.regime_adaptive_weights(m.exposures, m.ic, monitor.regime_as_of(m.regime, m.calendar))
    res, measured = _run(m, weights.unionByName(strategies.static_multifactor_weights(m.exposures)), costs)
    _save(out, nav=charts.nav_chart(res.nav), factor_weights=mix, metrics=measured)
    text.comparison_markdown(measured, out / "regime_adaptive.md")


def attribution(m: Market, out: Path, costs: CostModel) -> None:
    fwd = factors.forward_returns(m.bars, m.calendar).withColumnRenamed("fwd_ret", "ret")
    model = factor_risk.FactorRiskModel([f().name for f in factors.FACTORS]).fit(m.exposures, fwd)
    held = m.momentum_targets.select(F.col("decision_date").alias("date"), "ticker", "weight")
    profile = factor_risk.exposure_profile(held, m.exposures)
    last = charts.exposure_chart(profile)
    on = F.broadcast(last.select("date").distinct())
    parts, total = factor_risk.decompose(
        held.join(on, "date").select("ticker", "weight"), m.exposures.join(on, "date").select("ticker", "factor", "z"), model.factor_covariance(covariance.sample_covariance), model.specific_variance())
    average = charts.average_exposure(profile)
    _save(out, exposures=profile, average=average, risk=charts.risk_chart(parts, total), latest=last)
    text.risk_markdown(total, parts, average, out / "risk.md")


def download(spark: SparkSession, constituents: DataFrame, changes: DataFrame, fetcher: prices.Fetcher, *, path: str, fetched_at: object, start: str = "2014-01-01", end: str = "2026-01-01",
             extra: tuple[str, ...] = EXTRA, **how) -> prices.QualityReport:
    """Bars of every name that was ever a member between ``start`` and ``end``, and of ``extra``."""
    ever = [r["ticker"] for r in membership.union_ever(constituents, changes, start, end, fetched_at=fetched_at).collect()]
    return prices.download_prices(spark, [*sorted(ever), *extra], start, end, path=path, fetcher=fetcher, **how)


def yahoo_fetcher() -> prices.Fetcher:
    """A client behind the ``Fetcher`` type, where the optional package ``yfinance`` is installed."""
    client = importlib.import_module("yfinance")
    return lambda names, start, end: client.download(names, start=start, end=end, auto_adjust=False, group_by="ticker", progress=False, threads=True)


JOBS: dict[str, Callable[[Market, Path, CostModel], None]] = {
    "evaluation": evaluate, "monitoring": monitoring, "momentum": momentum, "comparison": comparison, "regime-adaptive": adaptive, "attribution": attribution,
}


def main(argv: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser(prog="factorspark.jobs")
    cli.add_argument("job", choices=JOBS)
    cli.add_argument("--tables", required=True, help="folder of the market's tables")
    cli.add_argument("--out", required=True, help="folder for results")
    cli.add_argument("--costs", help="YAML file with a costs block")
    a = cli.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    JOBS[a.job](Market(spark, a.tables), Path(a.out), load_cost_model(a.costs) if a.costs else CostModel.free())


if __name__ == "__main__":
    main()
