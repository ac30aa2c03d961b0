"""Reports as text, and jobs end to end on the smallest tables."""

from datetime import date
from pathlib import Path

import pandas as pd
import pytest

from factorspark import jobs
from factorspark.operators import calendar, metrics, monitor
from factorspark.plans.market import Market
from factorspark.reports import charts, text

TABLES, MORE = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")


def nav(spark, **lines):
    days = [d.date() for d in pd.date_range("2021-01-31", periods=6, freq="ME")]
    return spark.createDataFrame([(s, d, float(v)) for s, vs in lines.items() for d, v in zip(days, vs, strict=True)], "strategy string, date date, nav double")


def test_metric_tables(spark, tmp_path):
    n = nav(spark, one=[100, 110, 99, 120, 130, 125], two=[100, 101, 102, 103, 104, 105])
    m = metrics.compute_metrics(n)
    views = text.metric_views(m)
    assert views["one"]["Total Return"] == "25.00%" and views["one"]["Max Drawdown"] == "-10.00%" and views["one"]["Max DD Trough"] == "2021-03-31" and "Excess CAGR" not in views["one"]
    assert views["two"]["Max DD Peak"] == "" and views["two"]["Annual Turnover"] == "0.00x" and views["two"]["Calmar Ratio"] == "nan"
    text.comparison_markdown(m, tmp_path / "c.md", preamble="Words.", order=["two", "one"])
    lines = (tmp_path / "c.md").read_text().splitlines()
    assert lines[:3] == ["# Strategy Comparison", "", "Words."] and "| Metric | two | one |" in lines and any(x.startswith("| Total Return | 5.00% | 25.00% |") for x in lines)
    text.metrics_markdown(m.filter("strategy = 'one'"), tmp_path / "deep" / "m.md", title="One")
    assert "| CAGR |" in (tmp_path / "deep" / "m.md").read_text() and "one" in text.metrics_summary(m)
    bench = n.filter("strategy = 'two'").select("date", "nav")
    assert "Information Ratio" in text.metric_views(metrics.compute_metrics(n, benchmark=bench))["one"]
    assert charts.nav_chart(n, bench).select("strategy").distinct().count() == 3


def test_texts(spark):
    days = [d.date() for d in pd.date_range("2015-01-31", periods=60, freq="ME")]
    ic = spark.createDataFrame([("f", d, (0.1 if k < 30 else -0.1) + 0.001 * (k % 3)) for k, d in enumerate(days)] + [("g", d, 0.01 * (-1) ** k) for k, d in enumerate(days)], "factor string, date date, ic double")
    broken, steady = text.cusum_text(monitor.cusum_test(ic))
    assert broken.startswith("f: decay after 2017-06-30") and "no break" in steady
    assert "DECAY since 2017-06-30" in text.health_text(monitor.factor_health_report(ic))[0]
    assert charts.health_chart(ic).filter("alert").count() == 1
    chart = charts.ic_chart(ic, roll=12)
    assert chart.filter("factor = 'f' and rolling is null").count() == 11


def test_unique_bars(spark):
    rows = [(date(2020, 1, 1), "A", 1.0, 5.0, 1), (date(2020, 1, 1), "A", 2.0, None, 2), (date(2020, 1, 2), "A", 3.0, 6.0, 1)]
    b = spark.createDataFrame(rows, "date date, ticker string, close double, volume double, at int")
    assert sorted(map(tuple, calendar.unique_bars(b, "at").collect())) == [(date(2020, 1, 1), "A", 2.0, 5.0), (date(2020, 1, 2), "A", 3.0, 6.0)]
    assert calendar.dense(b.drop("at"), calendar.sessions(b)).count() == 2


@pytest.mark.skipif(not TABLES.exists(), reason="no test data")
@pytest.mark.parametrize("job, report, tables", [("evaluation", "evaluation.md", ["summary", "correlation", "ic", "deciles"]), ("monitoring", "monitoring.md", ["health", "regimes"]),
                                                 ("momentum", "momentum.md", ["nav", "metrics"]), ("attribution", "risk.md", ["exposures", "risk"])])
def test_jobs(spark, tmp_path, job, report, tables):
    # regressions on four factors need more names than the smallest tables have
    jobs.JOBS[job](Market.of(spark, str(MORE if job == "attribution" else TABLES)), tmp_path, jobs.CostModel(0.005, 5.0))
    assert (tmp_path / report).read_text().startswith("# ") and all(list((tmp_path / t).glob("*.csv")) for t in tables)
