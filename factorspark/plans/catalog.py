"""Queries over the market view, one per operator, each beside its oracle where SQL has one.

Results are rounded where sums of doubles are involved, for two engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.functions import stats, symbols
from factorspark.operators import backtest, calendar, covariance, evaluation, factor_risk, factors, membership, metrics, monitor, portfolio, strategies
from factorspark.operators.costs import CostModel
from factorspark.plans.market import Market
from factorspark.plans.oracle import sql
from factorspark.reports import charts
from factorspark.sources import aliases, prices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *, plain: bool = False):
    """Registers a function of a Market; ``plain`` SQL stands alone."""

    def register(fn: Callable[[Market], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Market.of(spark, sf_dir))
        if oracle:
            ORACLES[fn.__name__] = oracle if plain else sql(oracle)
        return fn

    return register


def r(col: str, places: int = 6, name: str | None = None):
    return F.round(col, places).alias(name or col)


# Data


@query("SELECT date, ticker, open, high, low, close, adj_close, volume FROM bars")
def op_s7_bars(m: Market) -> DataFrame:
    return m.bars


@query("SELECT date, ticker, adj_close FROM bars WHERE ticker IN ('BRAND#1', 'BRAND#3') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def op_s7_get_prices(m: Market) -> DataFrame:
    return prices.get_prices(m.spark, ["BRAND#1", "BRAND#3", "NONE"], "1996-01-01", "1997-06-30", bars=m.bars).select("date", "ticker", "adj_close")


@query("SELECT DISTINCT ticker FROM bars")
def op_s6_catalogue(m: Market) -> DataFrame:
    return m.bars.select("ticker").distinct()


@query("SELECT date, max(CASE WHEN ticker = 'BRAND#1' THEN adj_close END) AS \"BRAND#1\", max(CASE WHEN ticker = 'BRAND#2' THEN adj_close END) AS \"BRAND#2\" FROM bars WHERE ticker IN ('BRAND#1', 'BRAND#2') GROUP BY 1")
def op_a2_wide_prices(m: Market) -> DataFrame:
    return prices.get_prices(m.spark, ["BRAND#1", "BRAND#2"], bars=m.bars, field="adj_close")


@query("SELECT date, ticker, round(open * adj_close / nullif(close, 0), 6) AS adj_open FROM bars")
def op_p1_adjusted_open(m: Market) -> DataFrame:
    return m.bars.select("date", "ticker", F.round(prices.derived("adj_open"), 6).alias("adj_open"))


@query("SELECT date, ticker, close FROM bars WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'")
def op_p2_date_slice(m: Market) -> DataFrame:
    return m.bars.filter(F.col("date").between("1998-01-01", "1998-03-31")).select("date", "ticker", "close")


@query("""SELECT ticker, count(*) AS n_rows, min(date) AS start, max(date) AS "end", 0::BIGINT AS n_missing_close, count(*) FILTER (volume = 0) AS n_zero_volume,
  count(*) FILTER (abs(adj_close / p - 1) > 0.05) AS n_extreme_moves, coalesce(count(*) FILTER (abs(adj_close / p - 1) > 0.05), 0) = 0 AS ok
  FROM (SELECT *, lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM bars) GROUP BY 1""")
def op_a5_quality(m: Market) -> DataFrame:
    return prices.quality(m.bars, jump_threshold=0.05).select("ticker", "n_rows", "start", "end", "n_missing_close", "n_zero_volume", "n_extreme_moves", "ok")


@query("""SELECT count(DISTINCT ticker) AS n_tickers, count(DISTINCT ticker) FILTER (bad > 0) AS n_flagged FROM (
  SELECT ticker, count(*) FILTER (abs(adj_close / p - 1) > 0.05) AS bad FROM (SELECT *, lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM bars) GROUP BY 1)""")
def op_a6_quality_rollup(m: Market) -> DataFrame:
    return prices.quality(m.bars, jump_threshold=0.05).agg(F.count("*").alias("n_tickers"), F.count_if(~F.col("ok")).alias("n_flagged"))


@query("SELECT n_name AS old, last_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current FROM nation QUALIFY old <> current", plain=True)
def op_j1_alias_closure(m: Market) -> DataFrame:
    n = m.table("nation")
    renames = n.select(F.col("n_name").alias("old"), F.lead("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("new"))
    return aliases.closure(renames)


@query("SELECT current, count(*) AS n, string_agg(old, ',' ORDER BY old) AS aliases FROM (SELECT n_name AS old, last_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current FROM nation) WHERE old <> current GROUP BY 1", plain=True)
def op_j2_reverse_aliases(m: Market) -> DataFrame:
    return aliases.reverse_aliases(op_j1_alias_closure(m)).select("current", F.size("aliases").cast("long").alias("n"), F.array_join("aliases", ",").alias("aliases"))


@query("SELECT replace(upper(trim(p_brand || '.b ')), '.', '-') AS symbol, count(*) AS n FROM part GROUP BY 1", plain=True)
def op_f2_canonical_symbol(m: Market) -> DataFrame:
    return m.table("part").groupBy(symbols.canonical_symbol(F.concat("p_brand", F.lit(".b "))).alias("symbol")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus || ' x' AS cell FROM orders", plain=True)
def op_f3_clean_cell(m: Market) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("[1] x[note 2] "))
    return m.table("orders").select("o_orderkey", symbols.clean_cell(raw).alias("cell"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders", plain=True)
def op_f5_change_dates(m: Market) -> DataFrame:
    o, d = m.table("orders"), F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.date_format(d, "MMMM d, yyyy")).when(k == 1, F.date_format(d, "MMM dd, yyyy")).when(k == 2, F.date_format(d, "MMMM yyyy"))
            .when(k == 3, F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit("[3]"))).otherwise("unknown"))
    return o.select("o_orderkey", symbols.change_date(text).alias("day"))


@query("""SELECT a.p_partkey AS key, coalesce(list_has_all(CASE WHEN len(a.t) <= len(b.t) THEN b.t ELSE a.t END, CASE WHEN len(a.t) <= len(b.t) THEN a.t ELSE b.t END)
  AND len(list_filter(CASE WHEN len(a.t) <= len(b.t) THEN a.t ELSE b.t END, lambda x: length(x) >= 4)) > 0, false) AS same
  FROM (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM part) a
  JOIN (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM part) b ON b.p_partkey = a.p_partkey + 1""", plain=True)
def op_f7_same_company(m: Market) -> DataFrame:
    p = m.table("part")
    nxt = p.select((F.col("p_partkey") - 1).alias("k"), F.concat_ws(" ", "p_name", "p_type").alias("other"))
    return p.join(nxt, F.col("p_partkey") == F.col("k")).select(F.col("p_partkey").alias("key"), symbols.same_company(F.col("p_type"), F.col("other")).alias("same"))


@query("SELECT as_of, ticker FROM members")
def op_u1_membership(m: Market) -> DataFrame:
    return m.members


@query("SELECT as_of, count(*) AS n FROM members GROUP BY 1")
def op_u1_membership_counts(m: Market) -> DataFrame:
    return m.members.groupBy("as_of").agg(F.count("*").alias("n"))


@query("""SELECT as_of, CASE WHEN ticker = 'BRAND#1' AND as_of < DATE '1998-06-01' THEN 'OLD#1' ELSE ticker END AS ticker FROM members""")
def op_u2_renamed_membership(m: Market) -> DataFrame:
    ren = m.spark.range(1).select(F.lit("OLD#1").alias("old"), F.lit("BRAND#1").alias("new"), F.to_date(F.lit("1998-06-01")).alias("effective"))
    days = m.calendar.select(F.col("date").alias("as_of"))
    return membership.members_as_of(m.constituents, m.changes, days, fetched_at=m.FETCHED, renames=ren)


@query("""SELECT DISTINCT ticker FROM (
  SELECT m.ticker FROM (SELECT make_date(y, 6, 30) AS d FROM range(1996, 1999) t(y)) s JOIN qm m ON m.as_of = (SELECT max(as_of) FROM qd WHERE as_of <= s.d)
  UNION SELECT ticker FROM qm a WHERE as_of BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND NOT EXISTS (SELECT 1 FROM qm b WHERE b.q = a.q - 1 AND b.ticker = a.ticker) AND q > (SELECT min(q) FROM qm)
  UNION SELECT a.ticker FROM qm a WHERE EXISTS (SELECT 1 FROM qm n WHERE n.q = a.q + 1 AND n.as_of BETWEEN DATE '1996-01-01' AND DATE '1998-12-31') AND NOT EXISTS (SELECT 1 FROM qm b WHERE b.q = a.q + 1 AND b.ticker = a.ticker))""")
def op_u3_union_ever(m: Market) -> DataFrame:
    return membership.union_ever(m.constituents, m.changes, "1996-01-01", "1998-12-31", fetched_at=m.FETCHED, normalize=False)


@query("SELECT date, count(*) AS n FROM cal JOIN members ON as_of = date JOIN (SELECT date, ticker FROM bars) b USING (date, ticker) GROUP BY 1")
def op_u4_members_priced(m: Market) -> DataFrame:
    priced = m.members.join(m.bars.select(F.col("date").alias("as_of"), "ticker"), ["as_of", "ticker"], "left_semi")
    return priced.groupBy(F.col("as_of").alias("date")).agg(F.count("*").alias("n"))


@query("SELECT m.as_of, m.ticker FROM members m ANTI JOIN bars b ON b.date = m.as_of AND b.ticker = m.ticker")
def op_u7_missing_names(m: Market) -> DataFrame:
    return m.members.join(m.bars.select(F.col("date").alias("as_of"), "ticker"), ["as_of", "ticker"], "left_anti")


def _calendar(freq: str, unit: str) -> None:
    @query(f"SELECT max(date) AS date FROM sess GROUP BY date_trunc('{unit}', date)")
    def fn(m: Market) -> DataFrame:
        return calendar.rebalance_calendar(m.sessions, freq).select("date")

    QUERIES[f"op_b1_{freq}"], ORACLES[f"op_b1_{freq}"] = QUERIES.pop("fn"), ORACLES.pop("fn")


for _f, _u in calendar.FREQUENCIES.items():
    _calendar(_f, _u)


# Factors


def _factor(f: factors.Factor, cte: str, places: int = 8) -> None:
    @query(f"SELECT date, ticker, round(value, {places}) AS value FROM {cte}")
    def fn(m: Market) -> DataFrame:
        days = m.calendar.select(F.col("date").alias("as_of"))
        return f.panel(m.bars, days).select("date", "ticker", r("value", places))

    name = f"op_x_{f.name}"
    QUERIES[name], ORACLES[name] = QUERIES.pop("fn"), ORACLES.pop("fn")


_factor(factors.MomentumFactor(), "mom")
_factor(factors.LowVolatilityFactor(), "lowvol")
_factor(factors.ShortTermReversalFactor(), "rev")
_factor(factors.AmihudIlliquidityFactor(), "amihud", 6)


@query("SELECT count(*) AS n, count(DISTINCT ticker) AS tickers, max(date) AS last FROM bars WHERE date <= DATE '1999-12-31'")
def op_p3_pit_slice(m: Market) -> DataFrame:
    return m.bars.filter(F.col("date") <= F.lit("1999-12-31").cast("date")).agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.max("date").alias("last"))


@query("SELECT c.date AS as_of, count(*) AS n FROM cal c JOIN bars b ON b.date <= c.date AND b.date >= CAST(c.date - INTERVAL 16 MONTH AS DATE) GROUP BY 1")
def op_p4_history(m: Market) -> DataFrame:
    return factors.history(m.bars, m.calendar.select(F.col("date").alias("as_of"))).groupBy("as_of").agg(F.count("*").alias("n"))


@query("SELECT date, ticker, round(fwd_ret, 8) AS fwd_ret FROM fwd")
def op_w6_forward_returns(m: Market) -> DataFrame:
    return factors.forward_returns(m.bars, m.calendar).select("date", "ticker", r("fwd_ret", 8))


@query("SELECT ticker, m, round(price, 6) AS price FROM mp")
def op_a3_month_prices(m: Market) -> DataFrame:
    return factors.month_prices(m.bars).select("ticker", F.col("m").cast("long").alias("m"), r("price"))


@query("SELECT factor, date, ticker, round(value, 6) AS value, round(fwd_ret, 8) AS fwd_ret FROM panel")
def op_x6_factor_panel(m: Market) -> DataFrame:
    return m.panel().select("factor", "date", "ticker", r("value"), r("fwd_ret", 8))


@query("SELECT ticker, date, round(ret, 8) AS ret FROM rets WHERE ret IS NOT NULL")
def op_w1_session_returns(m: Market) -> DataFrame:
    return factors.session_returns(m.bars).filter("ret is not null").select("ticker", "date", r("ret", 8))


@query("SELECT date, ticker, round(mark, 6) AS mark FROM grid")
def op_w13_forward_fill(m: Market) -> DataFrame:
    return m.marks.select("date", "ticker", r("mark"))


# Cross-sections


@query("SELECT factor, date, ticker, round(v, 6) AS value FROM wz")
def op_f10_winsorize(m: Market) -> DataFrame:
    w = stats.winsorize(m.panel(), "value", ["factor", "date"])
    return w.groupBy("factor", "date").agg(F.count("value").alias("_n")).filter("_n > 0").join(w, ["factor", "date"]).select("factor", "date", "ticker", r("value"))


@query("SELECT factor, date, ticker, round(z, 6) AS z FROM zz WHERE z IS NOT NULL")
def op_m5_exposures(m: Market) -> DataFrame:
    return m.exposures.filter("z is not null").select("factor", "date", "ticker", r("z"))


@query("SELECT factor, date, ticker, bucket FROM bk")
def op_w15_buckets(m: Market) -> DataFrame:
    return stats.deciles(m.panel(), "value", ["factor", "date"]).filter("bucket is not null").select("factor", "date", "ticker", "bucket")


@query("SELECT factor, date, ticker, x AS rank FROM rk")
def op_w16_average_rank(m: Market) -> DataFrame:
    return evaluation.ranks(m.panel().filter("fwd_ret is not null"), "value", ["factor", "date"]).select("factor", "date", "ticker", "rank")


# Evaluation


@query("SELECT factor, date, round(ic, 6) AS ic FROM ic")
def op_x7_information_coefficient(m: Market) -> DataFrame:
    return m.ic.select("factor", "date", r("ic"))


@query("""SELECT factor, count(*) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / stddev_samp(ic), 6) AS icir,
  round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 5) AS t_stat, round(avg(CASE WHEN round(ic, 12) > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM ic GROUP BY 1""")
def op_x8_ic_summary(m: Market) -> DataFrame:
    return evaluation.ic_summary(m.ic).select("factor", "n", r("mean"), r("std"), r("icir"), r("t_stat", 5), r("hit_rate"))


@query("SELECT factor, date, bucket, round(ret, 8) AS ret FROM dec")
def op_x9_decile_returns(m: Market) -> DataFrame:
    return evaluation.decile_returns(m.panel()).select("factor", "date", "bucket", r("ret", 8))


@query("SELECT factor, bucket, n, round(annualized, 6) AS annualized FROM ann")
def op_a9_annualized(m: Market) -> DataFrame:
    return evaluation.decile_annualized(evaluation.decile_returns(m.panel())).select("factor", "bucket", "n", r("annualized"))


@query("""SELECT f.factor, round(l.v, 6) AS long_short_annualized, round(c.v, 6) AS monotonicity FROM (SELECT DISTINCT factor FROM dec) f
  LEFT JOIN (SELECT factor, pow(product(1 + ret), 12.0 / count(*)) - 1 AS v FROM ls GROUP BY 1) l USING (factor)
  LEFT JOIN (SELECT factor, covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) AS v FROM (
    SELECT factor, rank() OVER (PARTITION BY factor ORDER BY bucket) AS x, rank() OVER (PARTITION BY factor ORDER BY round(annualized, 12)) AS y FROM ann) GROUP BY 1) c USING (factor)""")
def op_x9_decile_summary(m: Market) -> DataFrame:
    return evaluation.decile_summary(evaluation.decile_returns(m.panel())).select("factor", r("long_short_annualized"), r("monotonicity"))


@query("""SELECT factor, date, round(covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)), 6) AS autocorr FROM (
  SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY round(a, 12)) + (count(*) OVER (PARTITION BY factor, date, round(a, 12)) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY factor, date ORDER BY round(b, 12)) + (count(*) OVER (PARTITION BY factor, date, round(b, 12)) - 1) / 2.0 AS y FROM (
    SELECT n.factor, n.date, p.value AS a, n.value AS b FROM panel n JOIN (SELECT factor, date, lead(date) OVER (PARTITION BY factor ORDER BY date) AS nd FROM (SELECT DISTINCT factor, date FROM panel)) d
      ON d.factor = n.factor AND d.nd = n.date JOIN panel p ON p.factor = n.factor AND p.date = d.date AND p.ticker = n.ticker WHERE n.value IS NOT NULL AND p.value IS NOT NULL))
  GROUP BY 1, 2 HAVING count(*) >= 2 AND stddev_samp(x) > 0 AND stddev_samp(y) > 0""")
def op_x10_rank_autocorrelation(m: Market) -> DataFrame:
    return evaluation.rank_autocorrelation(m.panel()).select("factor", "date", r("autocorr"))


@query("""SELECT f1, f2, round(avg(c), 6) AS corr FROM (SELECT f1, f2, date, covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) AS c FROM (
  SELECT f1, f2, date, rank() OVER (PARTITION BY f1, f2, date ORDER BY round(a, 12)) + (count(*) OVER (PARTITION BY f1, f2, date, round(a, 12)) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY f1, f2, date ORDER BY round(b, 12)) + (count(*) OVER (PARTITION BY f1, f2, date, round(b, 12)) - 1) / 2.0 AS y FROM (
    SELECT a.factor AS f1, b.factor AS f2, a.date, a.value AS a, b.value AS b FROM panel a JOIN panel b ON a.date = b.date AND a.ticker = b.ticker WHERE a.value IS NOT NULL AND b.value IS NOT NULL))
  GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND stddev_samp(x) > 0 AND stddev_samp(y) > 0) GROUP BY 1, 2""")
def op_x11_factor_correlation(m: Market) -> DataFrame:
    return evaluation.factor_correlation(m.panel()).select("f1", "f2", r("corr"))


# Backtest and metrics


@query("""SELECT s.date AS exec_date, t.ticker, round(t.weight, 6) AS weight FROM (
    SELECT k.decision_date, (SELECT min(ord) FROM sess WHERE date >= k.decision_date) + 1 AS o FROM (SELECT DISTINCT decision_date FROM tgt) k) e
  JOIN sess s ON s.ord = e.o JOIN tgt t ON t.decision_date = e.decision_date""")
def op_b2_snapped_targets(m: Market) -> DataFrame:
    return calendar.snap_targets(m.momentum_targets, m.sessions, lag=1).select("exec_date", "ticker", r("weight"))


@query("SELECT decision_date, ticker, round(weight, 6) AS weight FROM tgt")
def op_m23_momentum_weights(m: Market) -> DataFrame:
    return m.momentum_targets.select("decision_date", "ticker", r("weight"))


@query("""SELECT l_orderkey, l_linenumber, round(abs(l_quantity) * 0.005, 6) AS commission, round(abs(l_extendedprice) * 5.0 * 1e-4, 6) AS slippage,
  round(abs(l_quantity) * 0.005 + abs(l_extendedprice) * 5.0 * 1e-4, 6) AS cost FROM lineitem""", plain=True)
def op_f12_trade_costs(m: Market) -> DataFrame:
    c, n, px = CostModel(0.005, 5.0), F.col("l_quantity"), F.col("l_extendedprice") / F.col("l_quantity")
    return m.table("lineitem").select("l_orderkey", "l_linenumber", F.round(c.commission(n), 6).alias("commission"), F.round(c.slippage(n, px), 6).alias("slippage"), F.round(c.cost(n, px), 6).alias("cost"))


@query("""SELECT d.date, round(1e6 * exp(coalesce((SELECT sum(ln(g)) FROM step s2 WHERE s2.nk <= d.k), 0)) * d.g, 2) AS nav FROM (
  SELECT s.date, k.k, sum(t.weight * a.mark / b.mark) + 1 - sum(t.weight) AS g FROM sess s
    ASOF JOIN (SELECT DISTINCT decision_date AS k FROM tgt) k ON s.date >= k.k JOIN tgt t ON t.decision_date = k.k
    JOIN grid a ON a.ticker = t.ticker AND a.date = s.date JOIN grid b ON b.ticker = t.ticker AND b.date = k.k GROUP BY 1, 2) d""".replace("SELECT d.date", """, step AS (
  SELECT k.k, k.nk, sum(t.weight * a.mark / b.mark) + 1 - sum(t.weight) AS g FROM (SELECT decision_date AS k, lead(decision_date) OVER (ORDER BY decision_date) AS nk FROM (SELECT DISTINCT decision_date FROM tgt)) k
    JOIN tgt t ON t.decision_date = k.k JOIN grid a ON a.ticker = t.ticker AND a.date = k.nk JOIN grid b ON b.ticker = t.ticker AND b.date = k.k WHERE k.nk IS NOT NULL GROUP BY 1, 2)
SELECT d.date""", 1))
def op_b5_frictionless_nav(m: Market) -> DataFrame:
    """No costs, no halts: marks are filled forward before they are traded on."""
    marks = m.marks.withColumnRenamed("mark", "adj_close")
    nav = backtest.run_backtest(marks, m.momentum_targets).nav
    first = m.momentum_targets.agg(F.min("decision_date").alias("_f"))
    return nav.join(F.broadcast(first)).filter("date >= _f").select("date", F.round("nav", 2).alias("nav"))


def _engine(m: Market, **how) -> backtest.BacktestResult:
    fills = m.bars.select("date", "ticker", prices.derived("adj_open").alias("adj_open"))
    return backtest.run_backtest(m.bars, m.momentum_targets, cost_model=CostModel(0.005, 5.0), execution_prices=fills, execution_lag=1, defer_halted=True, **how)


@query()
def op_b5_engine_nav(m: Market) -> DataFrame:
    return _engine(m).nav


# Fills by schedule: a leg fills on its ticker's first priced session from its rebalance on, before the next one.
_FILLS = """, reb AS (SELECT o, min(ord) AS dummy, lead(o) OVER (ORDER BY o) AS nx, any_value(k) AS k FROM (
    SELECT k, (SELECT min(ord) FROM sess WHERE date >= k) + 1 AS o, (SELECT min(ord) FROM sess WHERE date >= k) + 1 AS ord FROM (SELECT DISTINCT decision_date AS k FROM tgt)) WHERE o <= (SELECT max(ord) FROM sess) GROUP BY o),
  legs AS (SELECT r.o, r.nx, n.ticker, coalesce(t.weight, 0) AS w FROM reb r JOIN (SELECT DISTINCT ticker FROM tgt) n ON true LEFT JOIN tgt t ON t.decision_date = r.k AND t.ticker = n.ticker
    WHERE EXISTS (SELECT 1 FROM tgt e JOIN reb q ON q.k = e.decision_date WHERE e.ticker = n.ticker AND q.o <= r.o)),
  priced AS (SELECT b.ticker, s.ord, b.open * b.adj_close / b.close AS px FROM bars b JOIN sess s USING (date) WHERE b.close > 0 AND b.open * b.adj_close / b.close > 0 {where}),
  found AS (SELECT l.*, (SELECT min(p.ord) FROM priced p WHERE p.ticker = l.ticker AND p.ord >= l.o AND (l.nx IS NULL OR p.ord < l.nx)) AS f FROM legs l),
  owned AS (SELECT *, coalesce(last_value(CASE WHEN f IS NOT NULL THEN w END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS held FROM found)"""


@query(_FILLS.format(where="") + " SELECT s.date, x.ticker, round(p.px, 6) AS price FROM owned x JOIN priced p ON p.ticker = x.ticker AND p.ord = x.f JOIN sess s ON s.ord = x.f WHERE x.w > 0 OR x.held")
def op_b4_engine_trades(m: Market) -> DataFrame:
    """What is traded when and at which price; sizes depend on the portfolio's value."""
    return _engine(m).trades.select("date", "ticker", r("price"))


@query(_FILLS.format(where="AND dayofmonth(s.date) > 9") + """ SELECT s.date, x.ticker, round(x.w, 6) AS weight,
  CASE WHEN x.nx IS NULL THEN 'halted; never filled before end of data' ELSE 'halted; superseded by next rebalance before it could fill' END AS reason FROM owned x JOIN sess s ON s.ord = x.o WHERE x.f IS NULL AND (x.w > 0 OR x.held)
  UNION ALL SELECT NULL, 'legs filled late', count(*), NULL FROM owned WHERE f > o AND (w > 0 OR held)""")
def op_b5_engine_skipped(m: Market) -> DataFrame:
    """Nothing can be traded in the first nine days of a month, so legs wait; one row counts those that filled late."""
    fills = m.bars.filter(F.dayofmonth("date") > 9).select("date", "ticker", prices.derived("adj_open").alias("adj_open"))
    res = backtest.run_backtest(m.bars, m.momentum_targets, execution_prices=fills, execution_lag=1, defer_halted=True)
    first = calendar.snap_targets(m.momentum_targets, m.sessions, lag=1).select(F.col("exec_date").alias("date")).distinct()
    late = res.trades.join(first, "date", "left_anti").agg(F.lit(None).cast("date").alias("date"), F.lit("legs filled late").alias("ticker"), F.count("*").cast("double").alias("weight"), F.lit(None).cast("string").alias("reason"))
    return res.skipped.select("date", "ticker", r("weight"), "reason").unionByName(late)


# Costs without halts: what is held follows from the last value, so the value alone is carried on.
@query(""", ks AS (SELECT decision_date AS k, row_number() OVER (ORDER BY decision_date) AS i FROM (SELECT DISTINCT decision_date FROM tgt)),
  nm AS (SELECT a.i, a.k, n.ticker, coalesce(t.weight, 0) AS w, coalesce(u.weight, 0) AS w0, g.mark AS p, g0.mark AS p0, g1.mark AS p1 FROM ks a JOIN (SELECT DISTINCT ticker FROM tgt) n ON true
    LEFT JOIN ks b ON b.i = a.i - 1 LEFT JOIN ks c ON c.i = a.i + 1 LEFT JOIN tgt t ON t.decision_date = a.k AND t.ticker = n.ticker LEFT JOIN tgt u ON u.decision_date = b.k AND u.ticker = n.ticker
    JOIN grid g ON g.ticker = n.ticker AND g.date = a.k LEFT JOIN grid g0 ON g0.ticker = n.ticker AND g0.date = b.k LEFT JOIN grid g1 ON g1.ticker = n.ticker AND g1.date = c.k WHERE t.weight > 0 OR u.weight > 0),
  steps AS (SELECT i, list({'w': w, 'w0': w0, 'p': p, 'p0': coalesce(p0, 1), 'p1': coalesce(p1, p)}) AS l FROM nm GROUP BY 1),
  walk AS (SELECT 1::BIGINT AS i, 1e6::DOUBLE AS v, 0::DOUBLE AS v0
    UNION ALL SELECT i + 1, v - list_sum(list_transform(l, lambda x: abs(x.w * v / x.p - x.w0 * v0 / x.p0) * (0.005 + x.p * 5e-4))) + list_sum(list_transform(l, lambda x: x.w * v / x.p * (x.p1 - x.p))), v FROM walk JOIN steps USING (i))
  SELECT ks.k AS date, round(v, 2) AS value FROM walk JOIN ks USING (i)""")
def op_b5_cost_value(m: Market) -> DataFrame:
    """Value before each rebalance with commission and slippage; marks are filled forward before they are traded on."""
    marks = m.marks.withColumnRenamed("mark", "adj_close")
    res = backtest.run_backtest(marks, m.momentum_targets, cost_model=CostModel(0.005, 5.0))
    paid = res.trades.groupBy("date").agg(F.sum("cost").alias("_c"))
    on = m.momentum_targets.select(F.col("decision_date").alias("date")).distinct()
    return res.nav.join(on, "date", "left_semi").join(paid, "date", "left").select("date", F.round(F.col("nav") + F.coalesce("_c", F.lit(0.0)), 2).alias("value"))


@query()
def op_b7_engine_metrics(m: Market) -> DataFrame:
    res = _engine(m)
    bench = metrics.rebase(m.benchmark, m.sessions, res.initial_capital)
    return metrics.compute_metrics(res.nav, benchmark=bench, turnover=res.turnover)


_PPY = "SELECT strategy, CASE WHEN count(*) < 3 THEN 252 WHEN median(g) <= 3 THEN 252 WHEN median(g) <= 10 THEN 52 WHEN median(g) <= 45 THEN 12 WHEN median(g) <= 120 THEN 4 ELSE 1 END AS ppy FROM (SELECT strategy, date - lag(date) OVER (PARTITION BY strategy ORDER BY date) AS g FROM nav) GROUP BY 1"


@query(_PPY)
def op_a19_cadence(m: Market) -> DataFrame:
    return metrics.periods_per_year(m.nav)


@query(f"""SELECT n.strategy, round(l / f - 1, 6) AS total_return, round(pow(l / f, p.ppy / (k - 1.0)) - 1, 6) AS cagr, round(r.s * sqrt(p.ppy), 6) AS annual_volatility, round(r.a / r.s * sqrt(p.ppy), 5) AS sharpe
  FROM (SELECT strategy, arg_min(nav, date) AS f, arg_max(nav, date) AS l, count(*) AS k FROM nav GROUP BY 1) n JOIN ({_PPY}) p USING (strategy)
  JOIN (SELECT strategy, avg(ret) AS a, stddev_samp(ret) AS s FROM nret GROUP BY 1) r USING (strategy)""")
def op_f14_performance(m: Market) -> DataFrame:
    x = metrics.compute_metrics(m.nav)
    return x.select("strategy", r("total_return"), r("cagr"), r("annual_volatility"), r("sharpe", 5))


@query("""SELECT strategy, round(min(dd), 6) AS max_drawdown, arg_min(date, (dd, date)) AS max_dd_trough, arg_min(pk, (dd, date)) AS max_dd_peak FROM (
  SELECT strategy, date, nav / p - 1 AS dd, (SELECT min(b.date) FROM nav b WHERE b.strategy = a.strategy AND b.nav = a.p) AS pk FROM (
    SELECT *, max(nav) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM nav) a) GROUP BY 1""")
def op_f17_max_drawdown(m: Market) -> DataFrame:
    return metrics.max_drawdown(m.nav).select("strategy", r("max_drawdown"), "max_dd_trough", "max_dd_peak")


@query("SELECT strategy, date, round(nav / max(nav) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM nav")
def op_w12_drawdown(m: Market) -> DataFrame:
    return metrics.drawdown_series(m.nav).select("strategy", "date", r("drawdown"))


@query("""SELECT strategy, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS monthly_win_rate FROM (
  SELECT strategy, v / lag(v) OVER (PARTITION BY strategy ORDER BY mo) - 1 AS x FROM (SELECT strategy, date_trunc('month', date) AS mo, arg_max(nav, date) AS v FROM nav GROUP BY 1, 2)) WHERE x IS NOT NULL GROUP BY 1""")
def op_f18_win_rate(m: Market) -> DataFrame:
    return metrics.monthly_win_rate(m.nav).select("strategy", r("monthly_win_rate"))


@query(f"""SELECT a.strategy, round(stddev_samp(a.ret - b.ret) * sqrt(any_value(p.ppy)), 6) AS tracking_error, round(avg(a.ret - b.ret) / stddev_samp(a.ret - b.ret) * sqrt(any_value(p.ppy)), 5) AS information_ratio
  FROM nret a JOIN (SELECT strategy, date, close / lag(close) OVER (PARTITION BY strategy ORDER BY date) - 1 AS ret FROM nav JOIN bench USING (date)) b ON a.strategy = b.strategy AND a.date = b.date AND b.ret IS NOT NULL
  JOIN ({_PPY}) p ON p.strategy = a.strategy GROUP BY 1""")
def op_f16_benchmark_relative(m: Market) -> DataFrame:
    rel = metrics.benchmark_metrics(m.nav, m.benchmark.select("date", F.col("close").alias("nav")), metrics.periods_per_year(m.nav))
    return rel.select("strategy", r("tracking_error"), r("information_ratio", 5))


@query("""SELECT s.date, round(1e6 * last_value(b.close IGNORE NULLS) OVER (ORDER BY s.date ROWS UNBOUNDED PRECEDING) / first_value(b.close IGNORE NULLS) OVER (ORDER BY s.date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 2) AS nav
  FROM sess s LEFT JOIN bench b USING (date)""")
def op_j16_benchmark_nav(m: Market) -> DataFrame:
    return metrics.rebase(m.benchmark, m.sessions, 1e6).select("date", r("nav", 2))


# Regimes and decay


@query("SELECT date, round(vol, 6) AS vol, round(trend, 9) AS trend, round(med, 6) AS threshold FROM rg1")
def op_w9_regime_inputs(m: Market) -> DataFrame:
    return monitor.regime_inputs(m.benchmark, expanding=True).select("date", r("vol"), r("trend", 9), r("threshold"))


@query("SELECT date, regime FROM regime")
def op_m17_regime_expanding(m: Market) -> DataFrame:
    return m.regime


@query("SELECT date, CASE WHEN vol > med_all THEN 'high_vol' ELSE 'low_vol' END || CASE WHEN close > trend THEN '_up' ELSE '_down' END AS regime FROM rg1 WHERE vol IS NOT NULL AND trend IS NOT NULL")
def op_m17_regime_full_sample(m: Market) -> DataFrame:
    return monitor.classify_regime(m.benchmark)


@query("SELECT date, regime FROM rgcal")
def op_m18_regime_as_of(m: Market) -> DataFrame:
    return monitor.regime_as_of(m.regime, m.calendar)


@query("""SELECT f.factor, g.regime, round(avg(i.ic), 6) AS mean_ic, count(i.ic) AS n FROM (SELECT DISTINCT factor FROM ic) f CROSS JOIN (VALUES ('low_vol_up'), ('low_vol_down'), ('high_vol_up'), ('high_vol_down')) g(regime)
  LEFT JOIN (SELECT ic.factor, ic.ic, rgcal.regime FROM ic JOIN rgcal USING (date)) i ON i.factor = f.factor AND i.regime = g.regime GROUP BY 1, 2""")
def op_m19_regime_matrix(m: Market) -> DataFrame:
    return monitor.factor_regime_matrix(m.ic, monitor.regime_as_of(m.regime, m.calendar)).select("factor", "regime", r("mean_ic"), "n")


@query("""SELECT factor, arg_max(regime, v) AS best_regime, arg_min(regime, v) AS worst_regime FROM (SELECT ic.factor, rgcal.regime, avg(ic.ic) AS v FROM ic JOIN rgcal USING (date) GROUP BY 1, 2) GROUP BY 1""")
def op_a12_best_worst_regime(m: Market) -> DataFrame:
    return monitor.best_worst_regime(monitor.factor_regime_matrix(m.ic, monitor.regime_as_of(m.regime, m.calendar)))


@query("""SELECT factor, date, CASE WHEN count(ic) OVER w >= 12 THEN round(avg(ic) OVER w, 6) END AS rolling FROM ic WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)""")
def op_m20_rolling_ic(m: Market) -> DataFrame:
    return monitor.rolling_ic(m.ic).select("factor", "date", r("rolling"))


_CUSUM = """SELECT factor, date, ic, row_number() OVER w AS k, sum(ic - a) OVER w / (s * sqrt(n)) AS path FROM (
  SELECT *, avg(ic) OVER (PARTITION BY factor) AS a, stddev_samp(ic) OVER (PARTITION BY factor) AS s, count(*) OVER (PARTITION BY factor) AS n FROM ic) WINDOW w AS (PARTITION BY factor ORDER BY date ROWS UNBOUNDED PRECEDING)"""


@query(f"SELECT factor, date, round(path, 6) AS path FROM ({_CUSUM})")
def op_w11_cusum_path(m: Market) -> DataFrame:
    return monitor.cusum_path(m.ic).select("factor", "date", r("path"))


@query(f"""SELECT t.factor, any_value(t.date) AS change_point, round(any_value(t.v), 6) AS statistic, any_value(t.v) > 1.36 AS triggered, round(avg(CASE WHEN c.k <= t.k THEN c.ic END), 6) AS mean_before,
  round(avg(CASE WHEN c.k > t.k THEN c.ic END), 6) AS mean_after FROM ({_CUSUM}) c JOIN (SELECT factor, date, k, abs(path) AS v FROM ({_CUSUM}) QUALIFY row_number() OVER (PARTITION BY factor ORDER BY round(abs(path), 12) DESC, date) = 1) t USING (factor) GROUP BY 1""")
def op_m21_cusum(m: Market) -> DataFrame:
    return monitor.cusum_test(m.ic).select("factor", "change_point", r("statistic"), "triggered", r("mean_before"), r("mean_after"))


@query("""SELECT factor, round(arg_max(v, date), 6) AS current_rolling_ic, round(any_value(h), 6) AS historical_mean_ic FROM (
  SELECT factor, date, CASE WHEN count(ic) OVER w >= 12 THEN avg(ic) OVER w END AS v, avg(ic) OVER (PARTITION BY factor) AS h FROM ic WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)) GROUP BY 1""")
def op_m22_factor_health(m: Market) -> DataFrame:
    return monitor.factor_health_report(m.ic).select("factor", r("current_rolling_ic"), r("historical_mean_ic"))


# Risk


@query("SELECT a.asset AS i, b.asset AS j, round(covar_samp(a.ret, b.ret), 8) AS cov FROM cmret a JOIN cmret b USING (m) GROUP BY 1, 2")
def op_m1_sample_covariance(m: Market) -> DataFrame:
    return covariance.sample_covariance(m.monthly).select("i", "j", r("cov", 8))


@query(""", ww AS (SELECT m, w / sum(w) OVER () AS w FROM (SELECT m, pow(0.5, (row_number() OVER (ORDER BY m DESC) - 1) / 12.0) AS w FROM (SELECT DISTINCT m FROM cmret))),
  cc AS (SELECT asset, m, w, ret - sum(w * ret) OVER (PARTITION BY asset) AS x FROM cmret JOIN ww USING (m))
  SELECT a.asset AS i, b.asset AS j, round(sum(a.w * a.x * b.x) / (1 - (SELECT sum(w * w) FROM ww)), 8) AS cov FROM cc a JOIN cc b USING (m) GROUP BY 1, 2""")
def op_m2_ewma_covariance(m: Market) -> DataFrame:
    return covariance.ewma_covariance(m.monthly, halflife=12.0).select("i", "j", r("cov", 8))


@query(""", cx AS (SELECT asset, m, ret - avg(ret) OVER (PARTITION BY asset) AS x FROM cmret),
  s AS (SELECT a.asset AS i, b.asset AS j, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q, count(*) AS t FROM cx a JOIN cx b USING (m) GROUP BY 1, 2),
  k AS (SELECT sum(CASE WHEN i = j THEN s END) / count(DISTINCT i) AS mu, sum(q - s * s) AS phi, max(t) AS t FROM s),
  g AS (SELECT any_value(mu) AS mu, greatest(0.0, least(1.0, any_value(phi) / sum(pow(s.s - CASE WHEN i = j THEN mu ELSE 0 END, 2)) / any_value(k.t))) AS d FROM s CROSS JOIN k)
  SELECT i, j, round(d * CASE WHEN i = j THEN mu ELSE 0 END + (1 - d) * s, 8) AS cov, round(d, 6) AS shrinkage FROM s CROSS JOIN g""")
def op_m3_ledoit_wolf(m: Market) -> DataFrame:
    return covariance.ledoit_wolf_covariance(m.monthly).select("i", "j", r("cov", 8), r("shrinkage"))


@query("SELECT z.factor, z.date, round(covar_samp(z, fwd_ret) / var_samp(z), 6) AS slope, count(*) AS n FROM zz z JOIN fwd f ON f.date = z.date AND f.ticker = z.ticker WHERE z IS NOT NULL AND fwd_ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def op_m6_single_factor_ols(m: Market) -> DataFrame:
    fwd = factors.forward_returns(m.bars, m.calendar).withColumnRenamed("fwd_ret", "ret")
    return factor_risk.single_factor_regressions(m.exposures, fwd).select("factor", "date", r("slope"), "n")


# Least squares by orthogonalising the factors one after the other (each date demeaned first) and substituting back.
_OLS = """, wide AS (SELECT z.date, z.ticker, any_value(f.fwd_ret) AS y, max(CASE WHEN factor = 'momentum_12_1' THEN z END) AS a, max(CASE WHEN factor = 'low_volatility_252' THEN z END) AS b,
    max(CASE WHEN factor = 'short_term_reversal_1' THEN z END) AS c, max(CASE WHEN factor = 'amihud_illiq_21' THEN z END) AS d
    FROM zz z JOIN fwd f ON f.date = z.date AND f.ticker = z.ticker WHERE f.fwd_ret IS NOT NULL GROUP BY 1, 2 HAVING count(z.z) = 4),
  w0 AS (SELECT date, y - avg(y) OVER g AS y, a - avg(a) OVER g AS a, b - avg(b) OVER g AS b, c - avg(c) OVER g AS c, d - avg(d) OVER g AS d FROM wide WINDOW g AS (PARTITION BY date) QUALIFY count(*) OVER g >= 6),
  w1 AS (SELECT *, b - a * sum(a * b) OVER g / sum(a * a) OVER g AS b1, c - a * sum(a * c) OVER g / sum(a * a) OVER g AS c1, d - a * sum(a * d) OVER g / sum(a * a) OVER g AS d1 FROM w0 WINDOW g AS (PARTITION BY date)),
  w2 AS (SELECT *, c1 - b1 * sum(b1 * c1) OVER g / sum(b1 * b1) OVER g AS c2, d1 - b1 * sum(b1 * d1) OVER g / sum(b1 * b1) OVER g AS d2 FROM w1 WINDOW g AS (PARTITION BY date)),
  w3 AS (SELECT *, d2 - c2 * sum(c2 * d2) OVER g / sum(c2 * c2) OVER g AS d3 FROM w2 WINDOW g AS (PARTITION BY date)),
  k4 AS (SELECT *, sum(d3 * y) OVER g / sum(d3 * d3) OVER g AS bd FROM w3 WINDOW g AS (PARTITION BY date)),
  k3 AS (SELECT *, sum(c2 * (y - bd * d)) OVER g / sum(c2 * c2) OVER g AS bc FROM k4 WINDOW g AS (PARTITION BY date)),
  k2 AS (SELECT *, sum(b1 * (y - bd * d - bc * c)) OVER g / sum(b1 * b1) OVER g AS bb FROM k3 WINDOW g AS (PARTITION BY date)),
  ols AS (SELECT date, any_value(bd) AS bd, any_value(bc) AS bc, any_value(bb) AS bb, sum(a * (y - bd * d - bc * c - bb * b)) / sum(a * a) AS ba FROM k2 GROUP BY 1)"""


@query(_OLS + """ SELECT date, 'momentum_12_1' AS factor, round(ba, 6) AS ret FROM ols UNION ALL SELECT date, 'low_volatility_252', round(bb, 6) FROM ols
  UNION ALL SELECT date, 'short_term_reversal_1', round(bc, 6) FROM ols UNION ALL SELECT date, 'amihud_illiq_21', round(bd, 6) FROM ols""")
def op_m7_factor_returns(m: Market) -> DataFrame:
    fwd = factors.forward_returns(m.bars, m.calendar).withColumnRenamed("fwd_ret", "ret")
    fit = factor_risk.cross_sectional_regressions(m.exposures, fwd, [f().name for f in factors.FACTORS])
    return fit.factor_returns.select("date", "factor", r("ret"))


@query("SELECT ticker, CASE WHEN count(fwd_ret) >= 2 THEN round(var_samp(fwd_ret), 8) END AS variance FROM fwd GROUP BY 1")
def op_a14_specific_variance(m: Market) -> DataFrame:
    fwd = factors.forward_returns(m.bars, m.calendar).withColumnRenamed("fwd_ret", "resid")
    return factor_risk.specific_variance(fwd).select("ticker", r("variance", 8))


@query("SELECT z.date, z.factor, round(sum(coalesce(t.weight, 0) * coalesce(z.z, 0)), 6) AS exposure, coalesce(any_value(n.n), 0) AS n_held FROM zz z LEFT JOIN tgt t ON t.decision_date = z.date AND t.ticker = z.ticker LEFT JOIN (SELECT decision_date, count(*) AS n FROM tgt GROUP BY 1) n ON n.decision_date = z.date GROUP BY 1, 2")
def op_m9_exposure_profile(m: Market) -> DataFrame:
    w = m.momentum_targets.select(F.col("decision_date").alias("date"), "ticker", "weight")
    e = m.exposures
    seen = e.groupBy("date", "factor").agg(F.count("z").alias("_n")).filter("_n > 0").drop("_n")
    return factor_risk.exposure_profile(w, e.join(seen, ["date", "factor"], "left_semi")).select("date", "factor", r("exposure"), "n_held")


_DECOMP = """, sl AS (SELECT z.factor, z.date, covar_samp(z, fwd_ret) / var_samp(z) AS v FROM zz z JOIN fwd f ON f.date = z.date AND f.ticker = z.ticker WHERE z IS NOT NULL AND fwd_ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
  sc AS (SELECT * FROM sl WHERE date IN (SELECT date FROM sl GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT factor) FROM sl))),
  fc AS (SELECT a.factor AS i, b.factor AS j, covar_samp(a.v, b.v) AS cov FROM sc a JOIN sc b USING (date) GROUP BY 1, 2),
  ld AS (SELECT max(decision_date) AS d FROM tgt),
  ex AS (SELECT z.factor, sum(coalesce(t.weight, 0) * coalesce(z.z, 0)) AS e FROM zz z LEFT JOIN tgt t ON t.decision_date = z.date AND t.ticker = z.ticker WHERE z.date = (SELECT d FROM ld) GROUP BY 1),
  pt AS (SELECT i AS factor, any_value(a.e) AS exposure, sum(a.e * cov * b.e) AS contribution FROM fc JOIN ex a ON a.factor = i JOIN ex b ON b.factor = j GROUP BY 1),
  sv AS (SELECT ticker, var_samp(fwd_ret) AS v FROM fwd GROUP BY 1 HAVING count(fwd_ret) >= 2)"""


def _decompose(m: Market) -> tuple[DataFrame, DataFrame]:
    fwd = factors.forward_returns(m.bars, m.calendar).withColumnRenamed("fwd_ret", "ret")
    e = m.exposures
    slopes = factor_risk.single_factor_regressions(e, fwd).select("date", F.col("factor").alias("asset"), F.col("slope").alias("ret"))
    last = m.momentum_targets.agg(F.max("decision_date").alias("date"))
    w = m.momentum_targets.join(F.broadcast(last), F.col("decision_date") == F.col("date")).select("ticker", "weight")
    now = e.join(F.broadcast(last), "date").select("ticker", "factor", "z")
    return factor_risk.decompose(w, now, covariance.sample_covariance(slopes), factor_risk.specific_variance(fwd.withColumnRenamed("ret", "resid")))


@query(f"{_DECOMP} SELECT factor, round(exposure, 6) AS exposure, round(contribution, 9) AS contribution FROM pt")
def op_m8_factor_contributions(m: Market) -> DataFrame:
    return _decompose(m)[0].select("factor", r("exposure"), r("contribution", 9))


@query(f"{_DECOMP} SELECT round(f + s, 8) AS total_variance, round(f, 8) AS factor_variance, round(s, 8) AS specific_variance, round(f / (f + s), 5) AS factor_pct FROM (SELECT (SELECT sum(contribution) FROM pt) AS f, (SELECT sum(weight * weight * v) FROM tgt JOIN sv USING (ticker) WHERE decision_date = (SELECT d FROM ld)) AS s)")
def op_m8_decomposition(m: Market) -> DataFrame:
    return _decompose(m)[1].select(r("total_variance", 8), r("factor_variance", 8), r("specific_variance", 8), r("factor_pct", 5))


# Portfolios


@query("""SELECT date, round(sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))), 6) AS turnover FROM (
  SELECT k AS date, pk, ticker FROM (SELECT decision_date AS k, lag(decision_date) OVER (ORDER BY decision_date) AS pk FROM (SELECT DISTINCT decision_date FROM tgt)) d JOIN (SELECT DISTINCT ticker FROM tgt) n ON true WHERE pk IS NOT NULL) g
  LEFT JOIN tgt a ON a.decision_date = g.date AND a.ticker = g.ticker LEFT JOIN tgt b ON b.decision_date = g.pk AND b.ticker = g.ticker GROUP BY 1""")
def op_m13_turnover(m: Market) -> DataFrame:
    w = m.momentum_targets.select(F.col("decision_date").alias("date"), "ticker", "weight")
    days = w.select("date").distinct().withColumn("_next", F.lead("date").over(Window.orderBy("date")))
    before = w.join(F.broadcast(days), "date").filter("_next is not null").select(F.col("_next").alias("date"), "ticker", "weight")
    first = days.agg(F.min("date").alias("_f"))
    return portfolio.turnover(w, before, ("date",)).join(F.broadcast(first)).filter("date > _f").select("date", r("turnover"))


_MIX = """SELECT date, factor, CASE WHEN sum(abs(v)) OVER (PARTITION BY date) > 0 THEN v / sum(abs(v)) OVER (PARTITION BY date) ELSE 1.0 / count(*) OVER (PARTITION BY date) END AS weight FROM (
  SELECT g.date, f.factor, CASE WHEN count(i.ic) >= 6 THEN avg(i.ic) ELSE 0 END AS v FROM rgcal g CROSS JOIN (SELECT DISTINCT factor FROM ic) f
  LEFT JOIN (SELECT ic.factor, ic.date, ic.ic, rgcal.regime FROM ic JOIN rgcal USING (date)) i ON i.factor = f.factor AND i.regime = g.regime AND i.date < g.date GROUP BY 1, 2)"""


@query(f"SELECT date, factor, round(weight, 6) AS weight FROM ({_MIX})")
def op_m15_regime_weights(m: Market) -> DataFrame:
    return strategies.regime_conditioned_weights(m.ic, monitor.regime_as_of(m.regime, m.calendar)).select("date", "factor", r("weight"))


@query(f"SELECT z.date, z.ticker, round(sum(coalesce(w.weight, 0) * coalesce(z.z, 0)), 6) AS score FROM zz z JOIN (SELECT DISTINCT date FROM rgcal) d USING (date) LEFT JOIN ({_MIX}) w ON w.date = z.date AND w.factor = z.factor GROUP BY 1, 2 HAVING count(z.z) > 0")
def op_f22_composite_score(m: Market) -> DataFrame:
    mix = strategies.regime_conditioned_weights(m.ic, monitor.regime_as_of(m.regime, m.calendar))
    return strategies.composite_score(m.exposures.filter("z is not null"), mix).select("date", "ticker", r("score"))


@query("""SELECT date, ticker, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM (
  SELECT *, CASE WHEN r = 1 THEN 1 ELSE CAST(ceil((r - 1) * least(10, m) / (m - 1) - 1e-9) AS INT) END AS bucket FROM (
    SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY round(avg(z), 12), ticker) AS r, count(*) OVER (PARTITION BY date) AS m FROM zz WHERE z IS NOT NULL GROUP BY date, ticker)) WHERE bucket IN (9, 10)""")
def op_m16_static_multifactor(m: Market) -> DataFrame:
    return strategies.static_multifactor_weights(m.exposures).select(F.col("decision_date").alias("date"), "ticker", r("weight"))


_BUCKETS = """SELECT date, ticker, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM (
  SELECT *, CASE WHEN r = 1 THEN 1 ELSE CAST(ceil((r - 1) * least(10, m) / (m - 1) - 1e-9) AS INT) END AS bucket FROM (
    SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY round(v, 12), ticker) AS r, count(*) OVER (PARTITION BY date) AS m FROM ({score}))) WHERE bucket IN (9, 10)"""


@query(_BUCKETS.format(score=f"SELECT z.date, z.ticker, sum(coalesce(w.weight, 0) * coalesce(z.z, 0)) AS v FROM zz z JOIN (SELECT DISTINCT date FROM rgcal) d USING (date) LEFT JOIN ({_MIX}) w ON w.date = z.date AND w.factor = z.factor GROUP BY 1, 2 HAVING count(z.z) > 0"))
def op_m16_regime_adaptive(m: Market) -> DataFrame:
    got, _ = strategies.regime_adaptive_weights(m.exposures, m.ic, monitor.regime_as_of(m.regime, m.calendar), score_domain="members")
    return got.select(F.col("decision_date").alias("date"), "ticker", r("weight"))


# Names with a monthly return in each of the last six months before a date.
_TRAIL = """, tm AS (SELECT a.date, a.m AS last, r.asset FROM atm a JOIN mret r ON r.m BETWEEN a.m - 5 AND a.m {names} GROUP BY 1, 2, 3 HAVING count(*) = 6),
  tn AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM tm QUALIFY n > 1),
  th AS (SELECT t.date, r.m FROM tn t JOIN mret r ON r.asset = t.asset AND r.m BETWEEN t.last - 23 AND t.last GROUP BY 1, 2 HAVING count(*) = any_value(t.n)),
  tr AS (SELECT * FROM tn WHERE date IN (SELECT date FROM th GROUP BY 1 HAVING count(*) >= 2))"""


@query(_TRAIL.format(names="JOIN tgt g ON g.decision_date = a.date AND g.ticker = r.asset") + """ SELECT strategy, decision_date, CAST(sum(w) AS BIGINT) AS names, 1.0 AS total FROM (
    SELECT 'equal' AS strategy, decision_date, 1 AS w FROM tgt UNION ALL SELECT s, decision_date, 1 FROM tgt, (VALUES ('mvo'), ('erc')) x(s) WHERE decision_date NOT IN (SELECT date FROM tr)
    UNION ALL SELECT s, date, 1 FROM tr, (VALUES ('mvo'), ('erc')) x(s)) GROUP BY 1, 2""")
def op_m24_three_schemes(m: Market) -> DataFrame:
    """Names and whole weight of each scheme and date. The cap is as low as possible, so mvo and erc hold every name they may."""
    got = strategies.three_weight_schemes(m.bars, m.panel(factors.MomentumFactor))
    return got.groupBy("strategy", "decision_date").agg(F.count("*").alias("names"), F.round(F.sum("weight"), 6).alias("total"))


@query(_TRAIL.format(names="") + " SELECT date, asset AS ticker, round(1.0 / n, 4) AS share FROM tr")
def op_m12_risk_parity(m: Market) -> DataFrame:
    """Shares in the risk, which uncapped risk parity makes equal, from each date's own trailing covariance."""
    cov = strategies.trailing_covariance(strategies.trailing_returns(m.bars, m.calendar))
    return portfolio.risk_parity_by_date(cov).select("date", "ticker", r("share", 4))


@query(_TRAIL.format(names="") + """ SELECT z.date, count(*) AS names, 1.0 AS total, true AS kept FROM zz z JOIN tr ON tr.date = z.date AND tr.asset = z.ticker
  WHERE z.factor = 'momentum_12_1' AND z.z IS NOT NULL GROUP BY 1 HAVING count(*) >= 4""")
def op_m10_mean_variance(m: Market) -> DataFrame:
    """Names, whole weight and whether long-only and the cap hold, on dates with names enough for a cap of a quarter."""
    days = m.exposures.filter("factor = 'momentum_12_1' and z is not null")
    cov = strategies.trailing_covariance(strategies.trailing_returns(m.bars, m.calendar))
    alpha = days.select(F.lit("mvo").alias("strategy"), "date", "ticker", F.col("z").alias("alpha"))
    got = portfolio.mean_variance_chain(alpha, cov, risk_aversion=5.0, max_weight=0.25, raise_cap=True, turnover_penalty=0.01)
    kept = F.bool_and((F.col("weight") >= 0) & (F.col("weight") <= 0.25 + 1e-6) & F.col("success"))
    return got.groupBy("date").agg(F.count("*").alias("names"), F.round(F.sum("weight"), 6).alias("total"), kept.alias("kept")).filter("names >= 4")


# Reports


@query("SELECT strategy, date, round(100 * (nav / max(nav) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1), 6) AS drawdown_pct FROM nav")
def op_r2_drawdown_chart(m: Market) -> DataFrame:
    return charts.drawdown_chart(m.nav).select("strategy", "date", r("drawdown_pct"))


@query("SELECT strategy, date, round(nav, 6) AS nav FROM nav UNION ALL SELECT 'Benchmark', date, round(close, 6) FROM bench")
def op_r1_nav_chart(m: Market) -> DataFrame:
    return charts.nav_chart(m.nav, m.benchmark.select("date", F.col("close").alias("nav"))).select("strategy", "date", r("nav"))


@query("SELECT factor, date, round(ic, 6) AS ic, CASE WHEN count(ic) OVER w = 12 THEN round(avg(ic) OVER w, 6) END AS rolling, round(avg(ic) OVER (PARTITION BY factor), 6) AS mean FROM ic WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def op_r5_ic_chart(m: Market) -> DataFrame:
    return charts.ic_chart(m.ic).select("factor", "date", r("ic"), r("rolling"), r("mean"))


@query("SELECT factor, bucket, round(100 * annualized, 4) AS annualized_pct FROM ann WHERE annualized IS NOT NULL")
def op_r5_decile_chart(m: Market) -> DataFrame:
    return charts.decile_chart(m.panel()).select("factor", "bucket", r("annualized_pct", 4))


@query("""SELECT factor, regime, round(v, 6) AS mean_ic, n, round(v / max(abs(v)) OVER (), 5) AS shade FROM (
  SELECT f.factor, g.regime, avg(i.ic) AS v, count(i.ic) AS n FROM (SELECT DISTINCT factor FROM ic) f CROSS JOIN (VALUES ('low_vol_up'), ('low_vol_down'), ('high_vol_up'), ('high_vol_down')) g(regime)
  LEFT JOIN (SELECT ic.factor, ic.ic, rgcal.regime FROM ic JOIN rgcal USING (date)) i ON i.factor = f.factor AND i.regime = g.regime GROUP BY 1, 2)""")
def op_r6_regime_chart(m: Market) -> DataFrame:
    return charts.regime_chart(monitor.factor_regime_matrix(m.ic, monitor.regime_as_of(m.regime, m.calendar))).select("factor", "regime", r("mean_ic"), "n", r("shade", 5))


@query(f"""SELECT r.factor, r.date, round(r.ic, 6) AS ic, round(r.rolling, 6) AS rolling, coalesce(a.triggered AND a.after < a.before AND a.point = r.date, false) AS alert FROM (
    SELECT factor, date, ic, CASE WHEN count(ic) OVER w >= 12 THEN avg(ic) OVER w END AS rolling FROM ic WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)) r
  LEFT JOIN (SELECT t.factor, any_value(t.date) AS point, any_value(t.v) > 1.36 AS triggered, avg(CASE WHEN c.k <= t.k THEN c.ic END) AS before, avg(CASE WHEN c.k > t.k THEN c.ic END) AS after
    FROM ({_CUSUM}) c JOIN (SELECT factor, date, k, abs(path) AS v FROM ({_CUSUM}) QUALIFY row_number() OVER (PARTITION BY factor ORDER BY round(abs(path), 12) DESC, date) = 1) t USING (factor) GROUP BY 1) a USING (factor)""")
def op_r6_health_chart(m: Market) -> DataFrame:
    return charts.health_chart(m.ic).select("factor", "date", r("ic"), r("rolling"), "alert")


_PROFILE = "SELECT z.date, z.factor, sum(coalesce(t.weight, 0) * coalesce(z.z, 0)) AS exposure, any_value(n.n) AS n_held FROM zz z JOIN (SELECT decision_date, count(*) AS n FROM tgt GROUP BY 1) n ON n.decision_date = z.date LEFT JOIN tgt t ON t.decision_date = z.date AND t.ticker = z.ticker GROUP BY 1, 2"


def _profile(m: Market) -> DataFrame:
    e = m.exposures
    seen = e.groupBy("date", "factor").agg(F.count("z").alias("_n")).filter("_n > 0").drop("_n")
    return factor_risk.exposure_profile(m.momentum_targets.select(F.col("decision_date").alias("date"), "ticker", "weight"), e.join(seen, ["date", "factor"], "left_semi"))


@query(f"SELECT factor, round(avg(exposure), 6) AS exposure, count(*) AS n FROM ({_PROFILE}) GROUP BY 1")
def op_a20_average_exposure(m: Market) -> DataFrame:
    return charts.average_exposure(_profile(m)).select("factor", r("exposure"), "n")


@query(f"SELECT date, factor, round(exposure, 6) AS exposure, n_held FROM ({_PROFILE}) WHERE date = (SELECT max(decision_date) FROM tgt)")
def op_r7_exposure_chart(m: Market) -> DataFrame:
    return charts.exposure_chart(_profile(m)).select("date", "factor", r("exposure"), "n_held")


@query(f"{_DECOMP} SELECT factor AS label, round(contribution, 9) AS variance FROM pt UNION ALL SELECT 'Specific', round(sum(weight * weight * v), 9) FROM tgt JOIN sv USING (ticker) WHERE decision_date = (SELECT d FROM ld)")
def op_r7_risk_chart(m: Market) -> DataFrame:
    return charts.risk_chart(*_decompose(m)).select("label", r("variance", 9))


@query("SELECT date, ticker, max(adj_close) AS adj_close, max(volume) AS volume FROM (SELECT date, ticker, adj_close, volume FROM bars UNION ALL SELECT date, ticker, adj_close, NULL FROM bars WHERE ticker < 'BRAND#3') GROUP BY 1, 2")
def op_a1_unique_bars(m: Market) -> DataFrame:
    """Repeated bars, some without a volume, come out once."""
    b = m.bars.select("date", "ticker", "adj_close", "volume")
    return calendar.unique_bars(b.unionByName(b.filter("ticker < 'BRAND#3'").withColumn("volume", F.lit(None).cast("double"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum's mean forward return by bucket."""
    m = Market.of(spark, sf_dir)
    ret = evaluation.decile_returns(m.panel(factors.MomentumFactor))
    return ret.groupBy("bucket").agg(F.round(F.avg("ret"), 6).alias("mean_fwd_ret"), F.count("*").alias("n_dates"))
