"""Reports as Markdown. Tables are collected here: they have a row per strategy, factor or regime."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame

from factorspark.sources.config import write_text

# Labels of the metrics, in the order they are shown, with their column and form.
LABELS = (
    ("Total Return", "total_return", "pct"), ("CAGR", "cagr", "pct"), ("Annual Volatility", "annual_volatility", "pct"), ("Sharpe Ratio", "sharpe", "num"),
    ("Max Drawdown", "max_drawdown", "pct"), ("Max DD Peak", "max_dd_peak", "day"), ("Max DD Trough", "max_dd_trough", "day"), ("Calmar Ratio", "calmar", "num"),
    ("Monthly Win Rate", "monthly_win_rate", "pct"), ("Annual Turnover", "annual_turnover", "times"),
    ("Benchmark CAGR", "benchmark_cagr", "pct"), ("Excess CAGR", "excess_cagr", "pct"), ("Information Ratio", "information_ratio", "num"), ("Tracking Error", "tracking_error", "pct"),
)
RELATIVE = 4  # the last of them need a benchmark


def show(value: object, form: str) -> str:
    """A number or date for a table; nothing for a missing date, ``nan`` for a missing number."""
    if form == "day":
        return value.isoformat() if isinstance(value, date) else ""
    x = float("nan") if value is None else float(value)
    return {"pct": f"{x:.2%}", "num": f"{x:.2f}", "times": f"{x:.2f}x", "signed_pct": f"{x:+.2%}", "signed": f"{x:+.4f}", "signed2": f"{x:+.2f}", "share": f"{x:.0%}"}[form]


def table(head: Iterable[str], rows: Iterable[Iterable[str]]) -> str:
    """A Markdown table."""
    head = list(head)
    lines = [head, ["---"] * len(head), *rows]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in lines)


def metric_rows(row: Mapping) -> dict[str, str]:
    """Label -> text of one row of ``compute_metrics``; without a benchmark its metrics are left out."""
    labels = LABELS if row["excess_cagr"] is not None else LABELS[:-RELATIVE]
    return {label: show(row[col], form) for label, col, form in labels}


def metric_views(metrics: DataFrame) -> dict[str, dict[str, str]]:
    return {r["strategy"]: metric_rows(r.asDict()) for r in metrics.orderBy("strategy").collect()}


def metrics_summary(metrics: DataFrame) -> str:
    """Every strategy's metrics as plain aligned lines."""
    return "\n\n".join("\n".join([name, *(f"{k:<18} {v:>12}" for k, v in rows.items())]) for name, rows in metric_views(metrics).items())


def document(title: str, *parts: str | None) -> str:
    return "\n\n".join([f"# {title}", *(p for p in parts if p)]) + "\n"


def metrics_markdown(metrics: DataFrame, path: str | Path, *, title: str = "Performance Summary", preamble: str | None = None) -> None:
    """One strategy's metrics."""
    (rows,) = metric_views(metrics).values()
    write_text(path, document(title, preamble, table(("Metric", "Value"), rows.items())))


def comparison_markdown(metrics: DataFrame, path: str | Path, *, title: str = "Strategy Comparison", preamble: str | None = None, order: list[str] | None = None) -> None:
    """Strategies side by side, with the metrics that all of them have, in the first one's order."""
    views = metric_views(metrics)
    names = order or list(views)
    shared = [k for k in views[names[0]] if all(k in views[n] for n in names)]
    write_text(path, document(title, preamble, table(["Metric", *names], ([k, *(views[n][k] for n in names)] for k in shared))))


def evaluation_markdown(evaluated: DataFrame, corr: DataFrame, path: str | Path, *, title: str = "Factor Evaluation", preamble: str | None = None) -> None:
    """``charts.evaluation_table`` and the factor correlations."""
    head = ["Factor", "Mean IC", "ICIR", "IC t-stat", "Hit rate", "Long-short (ann.)", "Top bucket", "Bottom bucket", "Monotonicity", "Rank autocorr"]
    forms = (("mean", "signed"), ("icir", "signed2"), ("t_stat", "signed2"), ("hit_rate", "share"), ("long_short_annualized", "signed_pct"), ("top", "signed_pct"), ("bottom", "signed_pct"),
             ("monotonicity", "signed2"), ("rank_autocorr", "signed2"))
    rows = [[r["factor"], *(show(r[c], f) for c, f in forms)] for r in evaluated.orderBy("factor").collect()]
    write_text(path, document(title, preamble, "## Headline", table(head, rows), "## Rank correlation of the factors", matrix(corr, "f1", "f2", "corr", "signed2")))


def matrix(df: DataFrame, row: str, col: str, value: str, form: str, extra: str | None = None) -> str:
    """A long table as a square one; ``extra`` is a count shown beside each number."""
    cells = {(r[row], r[col]): "" if r[value] is None else show(r[value], form) + (f" (n={r[extra]})" if extra else "") for r in df.collect()}
    rows, cols = (sorted({k[i] for k in cells}) for i in (0, 1))
    return table(["", *cols], ([a, *(cells.get((a, b), "") for b in cols)] for a in rows))


def monitoring_markdown(health: DataFrame, cusum: DataFrame, regimes: DataFrame, best: DataFrame, path: str | Path, *, title: str = "Factor Monitoring", preamble: str | None = None) -> None:
    """Health, break tests, and mean IC by regime with the best and worst."""
    parts = ["## Health", "\n".join(f"- {x}" for x in health_text(health)), "## Breaks", "\n".join(f"- {x}" for x in cusum_text(cusum)), "## Mean IC by regime",
             matrix(regimes, "factor", "regime", "mean_ic", "signed", "n"), "\n".join(f"- {x}" for x in regime_text(best))]
    write_text(path, document(title, preamble, *parts))


def risk_markdown(total: DataFrame, parts: DataFrame, average: DataFrame, path: str | Path, *, title: str = "Risk Attribution", preamble: str | None = None) -> None:
    """Variance by source, and mean exposures over time."""
    t = total.first()
    lead = f"Factors explain {show(t['factor_pct'], 'share')} of the variance, {show(t['specific_pct'], 'share')} is specific (volatility {show(t['total_variance'] ** 0.5, 'pct')} a period)."
    rows = [[r["factor"], show(r["exposure"], "signed2"), f"{r['contribution']:.3g}"] for r in parts.orderBy("factor").collect()]
    mean = [[r["factor"], show(r["exposure"], "signed2"), str(r["n"])] for r in average.orderBy("factor").collect()]
    write_text(path, document(title, preamble, lead, table(("Factor", "Exposure", "Variance"), rows), "## Mean exposure over time", table(("Factor", "Exposure", "Dates"), mean)))


def ic_text(summary: DataFrame) -> list[str]:
    return [f"{r['factor']}: mean IC {show(r['mean'], 'signed')} over {r['n']} dates, ICIR {show(r['icir'], 'signed2')}, t {show(r['t_stat'], 'signed2')}, positive on {show(r['hit_rate'], 'share')}"
            for r in summary.orderBy("factor").collect()]


def decile_text(summary: DataFrame) -> list[str]:
    return [f"{r['factor']}: long-short {show(r['long_short_annualized'], 'signed_pct')} a year, monotonicity {show(r['monotonicity'], 'signed2')}" for r in summary.orderBy("factor").collect()]


def cusum_text(tests: DataFrame) -> list[str]:
    out = []
    for r in tests.orderBy("factor").collect():
        if r["triggered"]:
            what = "decay" if r["is_decay"] else "improvement"
            out.append(f"{r['factor']}: {what} after {r['change_point']} (statistic {show(r['statistic'], 'num')} over {show(r['critical'], 'num')}; mean IC {show(r['mean_before'], 'signed')} before, {show(r['mean_after'], 'signed')} after)")
        else:
            out.append(f"{r['factor']}: no break (statistic {show(r['statistic'], 'num')}, critical {show(r['critical'], 'num')})")
    return out


def health_text(health: DataFrame) -> list[str]:
    return [f"{r['factor']}: rolling IC {show(r['current_rolling_ic'], 'signed')} against {show(r['historical_mean_ic'], 'signed')} overall" + (f"; DECAY since {r['alert_date']}" if r["decay_alert"] else "")
            for r in health.orderBy("factor").collect()]


def regime_text(best: DataFrame) -> list[str]:
    return [f"{r['factor']}: best in {r['best_regime']}, worst in {r['worst_regime']}" for r in best.orderBy("factor").collect()]
