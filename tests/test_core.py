"""Closed-form and point-in-time cases of the equity-factor operators."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.functions import stats, symbols
from factorspark.operators import backtest, calendar, covariance, evaluation, factor_risk, factors, membership, metrics, monitor, portfolio, strategies
from factorspark.operators.costs import CostModel
from factorspark.sources import html_tables, prices
from factorspark.sources.aliases import AliasResolver, closure, infer_renames

D = date.fromisoformat


def month_ends(n, last="2020-06-30"):
    return [d.date() for d in pd.date_range(end=last, periods=n, freq="ME")]


def bars(spark, series, days):
    rows = [(d, t, float(p), float(p), 1000.0) for t, ps in series.items() for d, p in zip(days, ps, strict=True) if p is not None]
    return spark.createDataFrame(rows, "date date, ticker string, adj_close double, close double, volume double")


def universe(spark, *t):
    return spark.createDataFrame([(x,) for x in t], "ticker string")


def values(df):
    return {r["ticker"]: r["value"] for r in df.collect()}


def test_membership(spark):
    cons = spark.createDataFrame([(t,) for t in ("AAA", "NEWCO", "META", "ZZZ", "KEEP")], "ticker string")
    log = [(0, D("2026-06-30"), "FUTCO", None), (1, D("2020-12-21"), "NEWCO", "OLDCO"), (2, D("2016-01-01"), None, "GONE"), (3, D("2015-06-30"), "ZZZ", None), (4, D("2013-12-23"), "FB", None)]
    changes = spark.createDataFrame([(p, d, a, None, r, None, None) for p, d, a, r in log], membership.CHANGES)
    ren = spark.createDataFrame([("FB", "META", D("2022-06-09"))], "old string, new string, effective date")
    days = spark.createDataFrame([(D(d),) for d in ("2015-06-30", "2015-06-29", "2013-01-01", "2026-01-01")], "as_of date")
    got = {}
    for r in membership.members_as_of(cons, changes, days, fetched_at="2026-01-01", renames=ren).collect():
        got.setdefault(str(r["as_of"]), set()).add(r["ticker"])
    assert got["2015-06-30"] == {"AAA", "KEEP", "OLDCO", "GONE", "ZZZ", "FB"} and got["2015-06-29"] == got["2015-06-30"] - {"ZZZ"}
    assert not {"FB", "META"} & got["2013-01-01"] and got["2026-01-01"] == {"AAA", "NEWCO", "META", "ZZZ", "KEEP"}
    ever = {r["ticker"] for r in membership.union_ever(cons, changes, "2015-01-01", "2016-12-31", fetched_at="2026-01-01", renames=ren).collect()}
    assert {"ZZZ", "GONE", "OLDCO"} <= ever and "FUTCO" not in ever


def test_aliases(spark):
    r = AliasResolver([("FB", "META"), ("VIAB", "VIAC"), ("VIAC", "PARA"), ("A", "B"), ("B", "A")], [("TWTR", "2022-10-27")])
    assert [r.to_current(x) for x in ("fb", "META", "VIAB", "BRK.B")] == ["META", "META", "PARA", "BRK-B"] and r.to_current("A") in "AB"
    assert r.aliases_of("PARA") == ["VIAB", "VIAC"] and r.is_delisted("twtr") and r.is_rename("FB")
    chain = spark.createDataFrame([("VIAB", "VIAC"), ("VIAC", "PARA"), ("PARA", "PSKY"), ("A", "B"), ("B", "A")], "old string, new string")
    got = {x["old"]: x["current"] for x in closure(chain).collect()}
    assert got["VIAB"] == got["VIAC"] == got["PARA"] == "PSKY" and got["A"] in "AB"
    log = [(0, D("2019-03-04"), "NWD", "Northwind Harbour", "NWH", "Northwind Harbour Lines", None), (1, D("2019-03-04"), "QQA", "Quarry Apples", "ZZB", "Zebra Basalt", None)]
    assert [(x["old"], x["new"]) for x in infer_renames(spark.createDataFrame(log, membership.CHANGES)).collect()] == [("NWH", "NWD")]


def test_html(spark):
    page = """<table id="constituents"><tr><th>S</th><th>N</th></tr><tr><td>BRK.B[1]</td><td>Berk</td><td>Fin</td><td></td><td></td><td>2010-02-16</td></tr><tr><td>AAA</td><td>A</td></tr></table>
    <table id="changes"><tr><th>Date</th><th colspan="2">Added</th></tr><tr><td rowspan="2">June 20, 2024[2]</td><td>AAA</td><td>A</td><td>BBB</td><td>B</td><td>cap</td></tr>
    <tr><td>CCC</td><td>C</td><td></td><td></td><td>x</td></tr><tr><td>Mar 03, 2015</td><td></td><td></td><td>DDD</td><td>D</td><td></td></tr></table>"""
    cons, log = html_tables.parse_membership(spark, page)
    assert [r["ticker"] for r in cons.collect()] == ["BRK.B", "AAA"]
    assert [(str(r["date"]), r["added_ticker"], r["removed_ticker"]) for r in log.orderBy("pos").collect()] == [("2024-06-20", "AAA", "BBB"), ("2024-06-20", "CCC", None), ("2015-03-03", None, "DDD")]
    with pytest.raises(ValueError):
        html_tables.parse_membership(spark, "<p>none</p>")


def test_store_and_download(spark, tmp_path):
    days = pd.bdate_range("2020-01-01", periods=15)

    def fetch(names, start, end):
        frames = {t: pd.DataFrame({"Open": 1.0, "High": 2.0, "Low": 1.0, "Close": np.linspace(100, 114, 15), "Adj Close": np.linspace(99, 113, 15), "Volume": 1e6}, index=days) for t in names if t != "CCC"}
        return pd.concat(frames, axis=1)

    path = str(tmp_path / "bars")
    rep = prices.download_prices(spark, ["AAA", "BBB", "CCC", "AAA"], "2020-01-01", "2020-02-01", path=path, fetcher=fetch, pause=0.0)
    assert (rep.requested, rep.downloaded, rep.failed) == (3, 2, ["CCC"]) and rep.missing_rate == pytest.approx(1 / 3) and rep.flagged().count() == 0
    assert prices.available_tickers(spark, path) == ["AAA", "BBB"]
    wide = prices.get_prices(spark, ["AAA", "BBB", "NO"], "2020-01-02", "2020-01-08", path=path, field="adj_open")
    assert wide.columns == ["date", "AAA", "BBB"] and wide.count() == 5
    with pytest.raises(ValueError):
        prices.get_prices(spark, ["AAA"], path=path, field="vwap")
    assert "requested 3" in rep.summary()


def test_momentum_and_reversal(spark):
    days = month_ends(14)
    up = [100 * 1.01**k for k in range(14)]
    spike = [p * (1.5 if k == 13 else 1) for k, p in enumerate(up)]
    b = bars(spark, {"UP": up, "SPIKE": spike, "SHORT": [None] * 4 + up[4:]}, days)
    got = values(factors.MomentumFactor().compute(b, universe(spark, "UP", "SPIKE", "SHORT", "NONE"), days[-1]))
    assert got["UP"] == pytest.approx(1.01**11 - 1) == got["SPIKE"] and got["SHORT"] is None and got["NONE"] is None
    rev = values(factors.ShortTermReversalFactor().compute(b, universe(spark, "SPIKE"), days[-1]))
    assert rev["SPIKE"] == pytest.approx(-(1.5 * 1.01 - 1))
    with pytest.raises(factors.LookaheadBiasError):
        factors.MomentumFactor().compute(b, universe(spark, "UP"), days[-2])
    clean = values(factors.MomentumFactor().compute(b.filter(F.col("date") <= F.lit(days[-2])), universe(spark, "UP"), days[-2]))
    assert values(factors.MomentumFactor().compute(b, universe(spark, "UP"), days[-2], enforce_pit=False)) == clean
    with pytest.raises(ValueError):
        factors.MomentumFactor(lookback=1, skip=1)


def test_volatility_and_illiquidity(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=60)]
    r = np.random.default_rng(0)
    b = bars(spark, {"CALM": 100 * np.cumprod(1 + 0.001 * r.standard_normal(60)), "CHOP": 100 * np.cumprod(1 + 0.03 * r.standard_normal(60)), "STEADY": 100 * 1.01 ** np.arange(60)}, days)
    got = values(factors.LowVolatilityFactor(40).compute(b, universe(spark, "CALM", "CHOP", "STEADY"), days[-1]))
    assert got["CALM"] > got["CHOP"] and got["STEADY"] == pytest.approx(0, abs=1e-12)
    thin = b.withColumn("volume", F.when(F.col("ticker") == "CALM", 100.0).otherwise(1e6))
    ill = values(factors.AmihudIlliquidityFactor(21).compute(thin, universe(spark, "CALM", "STEADY"), days[-1]))
    double = values(factors.AmihudIlliquidityFactor(21, scale=2e6).compute(thin, universe(spark, "CALM", "STEADY"), days[-1]))
    assert ill["CALM"] > ill["STEADY"] > 0 and double["CALM"] == pytest.approx(2 * ill["CALM"])


def test_pandas_factor(spark):
    days = month_ends(3)
    b = bars(spark, {"A": [1, 2, 3], "B": [2, 2, 2]}, days)
    f = factors.PandasFactor("last", lambda pdf, as_of: pdf.sort_values("date").groupby("ticker")["adj_close"].last())
    assert values(f.compute(b, universe(spark, "A", "B", "C"), days[-1])) == {"A": 3.0, "B": 2.0, "C": None}


def panel(spark, rows):
    return spark.createDataFrame([("f", D(d), t, v, x) for d, t, v, x in rows], "factor string, date date, ticker string, value double, fwd_ret double")


def test_evaluation(spark):
    rows = [(f"2020-0{m}-28", t, float(k), s * k / 100) for m, s in ((1, 1), (2, -1)) for k, t in enumerate("ABCD", 1)] + [("2020-03-28", "A", 1.0, None), ("2020-03-28", "B", 2.0, 0.1)]
    ic = {str(r["date"]): r["ic"] for r in evaluation.information_coefficient(panel(spark, rows)).collect()}
    assert ic == {"2020-01-28": pytest.approx(1), "2020-02-28": pytest.approx(-1)}
    s = evaluation.ic_summary(spark.createDataFrame([("f", D(f"2020-0{k}-01"), v) for k, v in enumerate((0.1, 0.2, 0.3, 0.2), 1)], "factor string, date date, ic double")).first()
    assert s["n"] == 4 and s["mean"] == pytest.approx(0.2) and s["hit_rate"] == 1 and s["t_stat"] == pytest.approx(2 * s["icir"])
    grown = panel(spark, [(f"2020-0{m}-28", f"T{k:02d}", float(k), 0.001 * k) for m in (1, 2, 3) for k in range(20)])
    out = evaluation.decile_summary(evaluation.decile_returns(grown, n=5), n=5).first()
    assert out["monotonicity"] == pytest.approx(1) and out["long_short_annualized"] > 0
    assert [r["autocorr"] for r in evaluation.rank_autocorrelation(grown).collect()] == [pytest.approx(1)] * 2
    down = grown.withColumn("factor", F.lit("g")).withColumn("value", -F.col("value"))
    corr = {(r["f1"], r["f2"]): r["corr"] for r in evaluation.factor_correlation(grown.unionByName(down)).collect()}
    assert corr[("f", "g")] == pytest.approx(-1) and corr[("f", "f")] == pytest.approx(1)


def test_preprocess(spark):
    df = spark.range(100).select(F.lit(1).alias("d"), F.format_string("T%03d", "id").alias("ticker"), F.col("id").cast("double").alias("v"))
    assert {r["count"] for r in stats.deciles(df, "v", ["d"]).groupBy("bucket").count().collect()} == {10}
    z = stats.zscore(df, "v", ["d"]).agg(F.avg("v"), F.stddev_samp("v")).first()
    assert z[0] == pytest.approx(0, abs=1e-12) and z[1] == pytest.approx(1)
    w = stats.winsorize(df, "v", ["d"], lower=0.1, upper=0.9).agg(F.min("v"), F.max("v")).first()
    assert w[0] == pytest.approx(9.9) and w[1] == pytest.approx(89.1)
    flat = stats.zscore(df.withColumn("v", F.lit(0.1)), "v", ["d"]).agg(F.max(F.abs("v"))).first()[0]
    assert flat < 1e-9
    with pytest.raises(ValueError):
        stats.winsorize(df, "v", ["d"], lower=0.9, upper=0.1)


def simulate(spark, series, targets, n=None, **how):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=n or len(next(iter(series.values()))))]
    rows = [(d, t, None if p is None else float(p)) for t, ps in series.items() for d, p in zip(days, ps, strict=True)]
    px = spark.createDataFrame(rows, "date date, ticker string, adj_close double")
    tg = spark.createDataFrame([("s", d if isinstance(d, date) else days[d], t, float(w)) for d, ws in targets.items() for t, w in ws.items()], "strategy string, decision_date date, ticker string, weight double")
    if "opens" in how:
        o = how.pop("opens")
        how["execution_prices"] = spark.createDataFrame([(d, t, None if p is None else float(p)) for t, ps in o.items() for d, p in zip(days, ps, strict=True)], "date date, ticker string, adj_open double")
    return backtest.run_backtest(px, tg, **how)


def test_backtest(spark):
    r = simulate(spark, {"AAA": [100, 110]}, {0: {"AAA": 1}}, initial_capital=100)
    assert [x["nav"] for x in r.nav.orderBy("date").collect()] == [100, pytest.approx(110)] and r.total_return().first()[1] == pytest.approx(0.1)
    r = simulate(spark, {"AAA": [100, 100]}, {0: {"AAA": 1}}, initial_capital=1000, cost_model=CostModel(0.5, 10))
    last = r.nav.orderBy(F.col("date").desc()).first()
    assert last["cash"] == pytest.approx(-6) and last["nav"] == pytest.approx(994)
    r = simulate(spark, {"AAA": [37, 37]}, {0: {"AAA": 1}}, initial_capital=500, allow_fractional=False)
    assert r.trades.first()["shares"] == 13 and r.nav.first()["cash"] == pytest.approx(19)
    r = simulate(spark, {"AAA": [100] * 3, "BBB": [100] * 3}, {0: {"AAA": 1}, 1: {"BBB": 1}})
    assert [x["turnover"] for x in r.turnover.orderBy("date").collect()] == [pytest.approx(1), pytest.approx(2)]
    r = simulate(spark, {"AAA": [100, 100], "BBB": [None, 100]}, {0: {"AAA": 0.5, "BBB": 0.5}}, initial_capital=1000)
    assert r.skipped.collect()[0]["reason"] == backtest.NO_PRICE and r.nav.orderBy("date").first()["cash"] == pytest.approx(500)
    r = simulate(spark, {"AAA": [100, 125, 125]}, {0: {"AAA": 1}}, initial_capital=1000, opens={"AAA": [99, 130, 125]}, execution_lag=1)
    assert r.trades.first()["price"] == 130 and r.trades.first()["shares"] == pytest.approx(1000 / 130)
    opens = {"AAA": [100, None, 150, 150]}
    r = simulate(spark, {"AAA": [100] * 4}, {0: {"AAA": 1}}, initial_capital=1000, opens=opens, execution_lag=1, defer_halted=True)
    assert r.trades.first()["price"] == 150 and r.skipped.count() == 0
    r = simulate(spark, {"AAA": [100] * 4, "BBB": [100] * 4}, {0: {"AAA": 1}, 1: {"BBB": 1}}, initial_capital=1000, opens={"AAA": [100, None, None, None], "BBB": [100] * 4}, execution_lag=1, defer_halted=True)
    assert [x["reason"] for x in r.skipped.collect()] == [backtest.SUPERSEDED] and r.trades.first()["ticker"] == "BBB"
    assert simulate(spark, {"AAA": [100, 100]}, {1: {"AAA": 1}}, execution_lag=1).trades.count() == 0
    assert CostModel(0.01, 20).cost(100, 50) == pytest.approx(11.0)
    with pytest.raises(ValueError):
        CostModel(-1, 0)
    with pytest.raises(ValueError):
        calendar.rebalance_calendar(spark.createDataFrame([(D("2020-01-01"),)], "date date"), "yearly")


def test_metrics(spark):
    def nav(vals, freq="ME"):
        return spark.createDataFrame([("s", d.date(), float(v)) for d, v in zip(pd.date_range("2020-01-31", periods=len(vals), freq=freq), vals, strict=True)], "strategy string, date date, nav double")

    m = metrics.compute_metrics(nav(np.linspace(100, 200, 25))).first()
    assert m["cagr"] == pytest.approx(2**0.5 - 1) and m["periods_per_year"] == 12 and m["monthly_win_rate"] == 1 and m["benchmark_cagr"] is None
    d = metrics.max_drawdown(nav([100, 120, 90, 150])).first()
    assert d["max_drawdown"] == pytest.approx(-0.25) and str(d["max_dd_peak"]) == "2020-02-29" and str(d["max_dd_trough"]) == "2020-03-31"
    v = metrics.compute_metrics(nav([100, 102, 102 * 0.98], "D")).first()
    assert v["annual_volatility"] == pytest.approx(np.std([0.02, -0.02], ddof=1) * 252**0.5) and v["periods_per_year"] == 252
    t = nav([0.5] * 6).withColumnRenamed("nav", "turnover")
    assert metrics.annual_turnover(t).first()["annual_turnover"] == pytest.approx(6)


def test_regime_and_decay(spark):
    r = np.random.default_rng(0)
    ic = np.concatenate([r.normal(0.05, 0.02, 60), r.normal(-0.03, 0.02, 60)])
    df = spark.createDataFrame([("f", d.date(), float(v)) for d, v in zip(pd.date_range("2010-01-31", periods=120, freq="ME"), ic, strict=True)], "factor string, date date, ic double")
    c = monitor.cusum_test(df).first()
    assert c["triggered"] and c["is_decay"] and abs((c["change_point"] - D("2014-12-31")).days) < 100
    assert monitor.factor_health_report(df).first()["decay_alert"]
    px = 100 * np.cumprod(1 + np.concatenate([r.normal(0.001, 0.004, 400), r.normal(-0.002, 0.02, 400)]))
    b = spark.createDataFrame([(D("2015-01-01") + timedelta(k), float(p)) for k, p in enumerate(px)], "date date, close double")
    full = monitor.classify_regime(b, expanding=True)
    past = monitor.classify_regime(b.filter("date < '2016-06-01'"), expanding=True)
    assert past.count() and past.exceptAll(full).count() == 0  # the future doesn't change the past
    late = spark.createDataFrame([(D("2030-01-01"),), (D("2000-01-01"),)], "date date")
    assert monitor.regime_as_of(full, late).count() == 1


def test_covariance_and_risk(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((60, 4)) * [0.1, 0.15, 0.2, 0.12]
    rows = [(D("2020-01-01") + timedelta(i), f"A{j}", float(x[i, j])) for i in range(60) for j in range(4)]
    df = spark.createDataFrame([*rows, (D("2021-01-01"), "A0", 9.0)], "date date, asset string, ret double")
    w = 0.5 ** (np.arange(60)[::-1] / 10)
    w /= w.sum()
    c, e = x - x.mean(axis=0), x - w @ x
    plain = c.T @ c / 60
    mu, noise = np.trace(plain) / 4, ((c**2).T @ (c**2) / 60 - plain**2).sum() / 60
    shrink = min(1, noise / ((plain - mu * np.eye(4)) ** 2).sum())
    forms = {"sample": np.cov(x.T), "ewma": (e * w[:, None]).T @ e / (1 - (w**2).sum()), "ledoit_wolf": shrink * mu * np.eye(4) + (1 - shrink) * plain}
    for name, want in forms.items():
        got = {(a["i"], a["j"]): a["cov"] for a in covariance.estimate_covariance(df, name, **({"halflife": 10} if name == "ewma" else {})).collect()}
        assert len(got) == 16 and all(got[f"A{i}", f"A{j}"] == pytest.approx(want[i, j]) for i in range(4) for j in range(4))
    two = df.withColumn("g", F.lit("all")).unionByName(df.filter("date < '2020-02-01'").withColumn("g", F.lit("early")))
    early = {(a["i"], a["j"]): a["cov"] for a in covariance.SampleCovariance().estimate(two, by=("g",)).filter("g = 'early'").collect()}
    assert all(early[f"A{i}", f"A{j}"] == pytest.approx(np.cov(x[:31].T)[i, j]) for i in range(4) for j in range(4))
    for bad in (lambda: covariance.estimate_covariance(df, "median"), lambda: covariance.SampleCovariance(min_periods=61).estimate(df), lambda: covariance.ewma_covariance(df, halflife=0)):
        with pytest.raises(ValueError):
            bad()
    wide = r.standard_normal((8, 12))
    few = spark.createDataFrame([(D("2020-01-01") + timedelta(i), f"B{j:02d}", float(wide[i, j])) for i in range(8) for j in range(12)], "date date, asset string, ret double")
    m = pd.DataFrame([tuple(a) for a in covariance.ledoit_wolf_covariance(few).select("i", "j", "cov").collect()], columns=["i", "j", "cov"]).pivot(index="i", columns="j", values="cov")
    assert np.linalg.eigvalsh(m.to_numpy()).min() > 0 > np.linalg.eigvalsh(np.cov(wide.T)).min() - 1e-9
    z = r.standard_normal(10)
    e = spark.createDataFrame([(D("2020-01-31"), f"T{k}", "f", float(z[k])) for k in range(10)], "date date, ticker string, factor string, z double")
    ret = spark.createDataFrame([(D("2020-01-31"), f"T{k}", float(0.01 + 0.03 * z[k])) for k in range(10)], "date date, ticker string, ret double")
    fit = factor_risk.cross_sectional_regressions(e, ret, ["f"])
    assert fit.factor_returns.first()["ret"] == pytest.approx(0.03) and fit.specific_returns.agg(F.max(F.abs("resid"))).first()[0] < 1e-12
    assert factor_risk.cross_sectional_regressions(e.limit(2), ret, ["f"]).factor_returns.count() == 0


def test_optimisers():
    a, c = pd.Series([0.02, 0.07, 0.04], index=["X", "Y", "Z"]), pd.DataFrame([[0.05, 0.01, 0.0], [0.01, 0.08, 0.02], [0.0, 0.02, 0.03]], index=["X", "Y", "Z"], columns=["X", "Y", "Z"])
    inv = np.linalg.inv(c.to_numpy())
    nu = (np.ones(3) @ inv @ a - 3.0) / (np.ones(3) @ inv @ np.ones(3))
    w = portfolio.MeanVarianceOptimizer(risk_aversion=3.0, long_only=False).optimize(a, c).weights
    assert w.to_numpy() == pytest.approx(inv @ (a.to_numpy() - nu) / 3.0, abs=1e-6)
    n = list("ABCDE")
    alpha, cov = pd.Series([0.25, 0.16, 0.09, 0.04, 0.01], index=n), pd.DataFrame(np.diag([0.05, 0.04, 0.06, 0.03, 0.05]), index=n, columns=n)
    w = portfolio.MeanVarianceOptimizer(max_weight=0.35).optimize(alpha, cov).weights
    assert w.sum() == pytest.approx(1) and w.max() <= 0.35 + 1e-9 and w.min() >= 0
    r = portfolio.MeanVarianceOptimizer(risk_aversion=0.01, target_volatility=0.13).optimize(alpha, cov)
    assert r.success and r.weights @ cov @ r.weights <= 0.13**2 * (1 + 1e-5)
    assert not portfolio.MeanVarianceOptimizer(target_volatility=0.01).optimize(alpha, cov).success
    with pytest.raises(ValueError):
        portfolio.MeanVarianceOptimizer(max_weight=0.1).optimize(alpha, cov)
    prev, moved = pd.Series(0.2, index=n), []
    for lam in (0, 0.003, 0.03, 0.1, 0.4, 2):
        moved.append(portfolio.MeanVarianceOptimizer(turnover_penalty=lam).optimize(alpha, cov, previous_weights=prev).turnover)
    assert all(x >= y - 1e-6 for x, y in zip(moved, moved[1:], strict=False)) and moved[-1] < 1e-6
    vol = np.array([0.1, 0.2, 0.4])
    erc = portfolio.RiskParityOptimizer().optimize(pd.DataFrame(np.diag(vol**2)))
    assert erc.weights.to_numpy() == pytest.approx((1 / vol) / (1 / vol).sum(), abs=1e-6) and erc.risk_contributions.to_numpy() == pytest.approx([1 / 3] * 3, abs=1e-6)
    capped = portfolio.RiskParityOptimizer(max_weight=0.4).optimize(pd.DataFrame(np.diag(vol**2)))
    assert capped.weights.max() <= 0.4 + 1e-9 and capped.weights.sum() == pytest.approx(1)


def test_regime_weights_use_the_past_only(spark):
    days = [d.date() for d in pd.date_range("2015-01-31", periods=20, freq="ME")]
    ic = spark.createDataFrame([(f, d, v) for f, v in (("a", 0.05), ("b", -0.02)) for d in days], "factor string, date date, ic double")
    reg = spark.createDataFrame([(d, "low_vol_up" if k % 2 else "high_vol_up") for k, d in enumerate(days)], "date date, regime string")
    w = {(r["date"], r["factor"]): r["weight"] for r in strategies.regime_conditioned_weights(ic, reg).collect()}
    assert w[days[0], "a"] == 0.5 == w[days[0], "b"] and w[days[-1], "a"] == pytest.approx(5 / 7) and w[days[-1], "b"] == pytest.approx(-2 / 7)
    spoiled = ic.withColumn("ic", F.when(F.col("date") >= F.lit(days[15]), 9.0).otherwise(F.col("ic")))
    v = {(r["date"], r["factor"]): r["weight"] for r in strategies.regime_conditioned_weights(spoiled, reg).collect()}
    assert all(v[k] == pytest.approx(w[k]) for k in w if k[0] <= days[15])
    zero = {(r["date"], r["factor"]): r["weight"] for r in strategies.regime_conditioned_weights(ic, reg, negative="zero").collect()}
    assert zero[days[-1], "b"] == 0 and zero[days[-1], "a"] == 1


def test_symbols(spark):
    df = spark.createDataFrame([("June 20, 2024",), ("Mar 03, 2015",), ("March 2015",), ("on 2020-01-02 x",), ("junk",)], "t string")
    assert [str(r[0]) for r in df.select(symbols.change_date(F.col("t"))).collect()] == ["2024-06-20", "2015-03-03", "2015-03-01", "2020-01-02", "None"]


def test_members_by_a_function(spark):
    """A function of the date does what its table does; dates it names nobody for have no rows."""
    days = month_ends(16)
    px = bars(spark, {"A": [10 + k for k in range(16)], "B": [40 - k for k in range(16)]}, days)
    rebal = spark.createDataFrame([(k, x) for k, x in enumerate(days[-4:])], "rebal long, date date")
    who = {days[-4]: ["B", "A", "B"], days[-3]: ["A"]}
    table = spark.createDataFrame([(x, t) for x, ts in who.items() for t in set(ts)], "as_of date, ticker string")
    asked = []

    def rule(day):
        asked.append(day)
        return who.get(day, [])

    kinds = [factors.MomentumFactor(), factors.LowVolatilityFactor()]
    got, want = (sorted(map(str, factors.factor_panel(kinds, px, rebal, m).collect())) for m in (rule, table))
    assert want and got == want and asked == days[-4:]
    assert membership.members_by(rule, rebal.limit(0).selectExpr("date AS as_of")).count() == 0


def test_empty_panels(spark):
    px = spark.createDataFrame([], "date date, ticker string, adj_close double")
    tg = spark.createDataFrame([], "strategy string, decision_date date, ticker string, weight double")
    res = backtest.run_backtest(px, tg, defer_halted=True)
    assert res.nav.count() == res.trades.count() == res.skipped.count() == res.turnover.count() == 0


def test_exits_wait_too(spark):
    """A name to be sold whose price is missing is skipped with weight 0 if it is held, and kept."""
    opens = {"AAA": [50, None, None, 60], "BBB": [20, 20, 20, 20]}
    r = simulate(spark, {"AAA": [50] * 4, "BBB": [20] * 4}, {0: {"AAA": 1}, 1: {"BBB": 1}}, initial_capital=1000, opens=opens)
    assert [(x["ticker"], x["weight"], x["reason"]) for x in r.skipped.collect()] == [("AAA", 0.0, backtest.NO_PRICE)]
    r = simulate(spark, {"AAA": [50] * 4, "BBB": [20] * 4}, {0: {"AAA": 1}, 1: {"BBB": 1}}, initial_capital=1000, opens=opens, defer_halted=True)
    assert r.skipped.count() == 0 and [(x["ticker"], x["shares"]) for x in r.trades.orderBy("date", "ticker").collect()][-1] == ("AAA", -20.0)


def test_optimisers_by_date(spark):
    """Dates in parallel and a chain that is anchored to the date before; a date without covariances is left out."""
    d = [D("2020-01-31"), D("2020-02-29"), D("2020-03-31")]
    vol = {"A": 0.1, "B": 0.2, "C": 0.3}
    cov = spark.createDataFrame([(x, i, j, vol[i] * vol[j] * (1.0 if i == j else 0.2)) for x in d[:2] for i in vol for j in vol], "date date, i string, j string, cov double")
    erc = portfolio.risk_parity_by_date(cov).collect()
    assert len(erc) == 6 and all(x["share"] == pytest.approx(1 / 3, abs=1e-6) and x["success"] for x in erc)
    alpha = spark.createDataFrame([("s", x, t, v * (-1) ** k) for k, x in enumerate(d) for t, v in (("A", 0.03), ("B", 0.02), ("C", -0.01))], "strategy string, date date, ticker string, alpha double")
    free = portfolio.mean_variance_chain(alpha, cov, risk_aversion=1.0)
    held = portfolio.mean_variance_chain(alpha, cov, risk_aversion=1.0, turnover_penalty=10.0)
    moved = [{str(x["date"]): x["turnover"] for x in c.collect()} for c in (free, held)]
    assert set(moved[0]) == {"2020-01-31", "2020-02-29"} and moved[0]["2020-02-29"] > 0.1 > 1e-6 > moved[1]["2020-02-29"]
    w = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "ticker string, weight double")
    got = portfolio.risk_contributions(w, cov.filter(F.col("date") == F.lit(d[0])))
    assert got.agg(F.sum("share")).first()[0] == pytest.approx(1) and got.filter("ticker = 'B'").first()["contribution"] == pytest.approx(0.25 * 0.04 + 0.25 * 0.004)


def test_regression_on_several_factors(spark):
    r = np.random.default_rng(8)
    z = r.standard_normal((3, 30, 4))
    beta = np.array([0.01, -0.02, 0.03, 0.005])
    days = [D("2021-01-31"), D("2021-02-28"), D("2021-03-31")]
    e = spark.createDataFrame([(days[t], f"T{i:02d}", f"f{k}", float(z[t, i, k])) for t in range(3) for i in range(30) for k in range(4) if not (t == 2 and i > 4)], "date date, ticker string, factor string, z double")
    ret = spark.createDataFrame([(days[t], f"T{i:02d}", float(0.002 + z[t, i] @ beta)) for t in range(3) for i in range(30)], "date date, ticker string, ret double")
    got = factor_risk.cross_sectional_regressions(e, ret, ["f0", "f1", "f2", "f3"]).factor_returns.collect()
    assert len(got) == 8 and all(x["ret"] == pytest.approx(beta[int(x["factor"][1])]) for x in got)


def test_regime_adaptive_strategy(spark):
    days = [x.date() for x in pd.date_range("2018-01-31", periods=16, freq="ME")]
    ic = spark.createDataFrame([(f, x, v) for x in days for f, v in (("good", 0.2), ("bad", -0.1))], "factor string, date date, ic double")
    reg = spark.createDataFrame([(x, "low_vol_up") for x in days], "date date, regime string")
    z = spark.createDataFrame([(x, f"T{i:02d}", f, float(i if f == "good" else -i)) for x in days for i in range(20) for f in ("good", "bad")], "date date, ticker string, factor string, z double")
    weights, mix = strategies.regime_adaptive_weights(z, ic, reg)
    late = weights.filter(F.col("decision_date") == F.lit(days[-1])).collect()
    assert {x["ticker"] for x in late} == {"T16", "T17", "T18", "T19"} and all(x["weight"] == 0.25 for x in late)
    assert {x["factor"]: x["weight"] for x in mix.filter(F.col("date") == F.lit(days[-1])).collect()} == {"good": pytest.approx(2 / 3), "bad": pytest.approx(-1 / 3)}
    with pytest.raises(ValueError):
        strategies.regime_adaptive_weights(z, ic, reg, score_domain="all")


def test_trailing_returns_know_no_future(spark):
    days = [x.date() for x in pd.bdate_range("2018-01-01", "2020-12-31")]
    r = np.random.default_rng(3)
    b = bars(spark, {t: 100 * np.cumprod(1 + 0.01 * r.standard_normal(len(days))) for t in "ABCDE"}, days)
    dates = spark.createDataFrame([(D("2019-12-31"),), (D("2020-06-30"),)], "date date")
    cov = strategies.trailing_covariance(strategies.trailing_returns(b, dates, months=12))
    past = strategies.trailing_covariance(strategies.trailing_returns(b.filter("date <= '2019-12-31'"), dates.filter("date < '2020-01-01'"), months=12))
    full = {(x["i"], x["j"]): x["cov"] for x in cov.filter("date < '2020-01-01'").collect()}
    assert len(full) == 25 and all(full[x["i"], x["j"]] == pytest.approx(x["cov"]) for x in past.collect())
    schemes = strategies.three_weight_schemes(b, spark.createDataFrame([(x, t, float(k)) for x in (D("2019-12-31"), D("2020-06-30")) for k, t in enumerate("ABCDE")], "date date, ticker string, value double"), n=5, top=(4, 5), months=12)
    assert {(x["strategy"], x["n"]): round(x["w"], 6) for x in schemes.groupBy("strategy").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()} == {(s, 4): 2.0 for s in ("equal", "mvo", "erc")}
