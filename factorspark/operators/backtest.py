"""Portfolio simulation: a schedule of fills, a ledger over it, and daily marking as joins.

Which session a leg fills in depends on prices and schedule alone, so the plan settles it first: each
leg looks forward to its ticker's next priced session (a window over legs and prices together).
What never fills before the next rebalance is a skip row. Only sizes and cash depend on the
portfolio: one sequential ledger per strategy walks the sessions with fills, as arrays over its
names. Costs, turnover, positions, NAV and the exits among the skips follow from its trades by joins.
Strategies run in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.symbols import to_date
from factorspark.lineage import cut
from factorspark.operators.calendar import dense, forward_fill, sessions, snap_targets
from factorspark.operators.costs import CostModel

# The reasons of skip rows.
NO_PRICE = "no price / halted"
SUPERSEDED = "halted; superseded by next rebalance before it could fill"
NEVER = "halted; never filled before end of data"
#: Fewer shares than this count as none.
SHARE_EPS = 1e-9
_LEDGER = "strategy string, ord int, ticker string, shares double, price double, value double, cash double"


@dataclass
class BacktestResult:
    """DataFrames keyed by strategy: nav (date, cash, positions_value, nav), turnover (date, turnover),
    trades and skipped."""

    nav: DataFrame
    turnover: DataFrame
    trades: DataFrame
    skipped: DataFrame
    initial_capital: float

    def returns(self) -> DataFrame:
        w = Window.partitionBy("strategy").orderBy("date")
        return self.nav.withColumn("ret", F.col("nav") / F.lag("nav").over(w) - 1).filter("ret is not null").select("strategy", "date", "ret")

    def total_return(self) -> DataFrame:
        """(strategy, total_return) against the initial capital."""
        last = self.nav.groupBy("strategy").agg(F.max_by("nav", "date").alias("_n"))
        return last.select("strategy", (F.col("_n") / F.lit(self.initial_capital) - 1).alias("total_return"))


def _schedule(legs: DataFrame, fills: DataFrame, defer: bool) -> DataFrame:
    """``legs`` (strategy, exec_ord, next_ord, ticker, weight) with fill_ord and px; both null where a leg never fills."""
    both = legs.select("ticker", F.col("exec_ord").alias("ord"), "strategy", "exec_ord", "next_ord", "weight").unionByName(
        fills.select("ticker", "ord", F.struct("ord", "px").alias("priced")), allowMissingColumns=True)
    ahead = Window.partitionBy("ticker").orderBy("ord").rangeBetween(0, Window.unboundedFollowing)
    found = both.withColumn("f", F.min("priced").over(ahead)).filter("strategy is not null")
    fits = F.col("f.ord") < F.coalesce("next_ord", F.lit(2**31 - 1)) if defer else F.col("f.ord") == F.col("exec_ord")
    return found.select("strategy", "exec_ord", "next_ord", "ticker", "weight", F.when(fits, F.col("f.ord")).alias("fill_ord"), F.when(fits, F.col("f.px")).alias("px"))


def _ledger(pdf: pd.DataFrame, strategy: str, capital: float, model: CostModel, fractional: bool) -> pd.DataFrame:
    """Trades of one strategy, and a row without a ticker for each session with its value before and cash after.

    ``pdf``: (ord, ticker, mark, weight, px), a row per session and name; a weight where the name fills.
    """
    names, code = np.unique(pdf["ticker"].to_numpy(str), return_inverse=True)
    pdf = pdf.assign(code=code).sort_values(["ord", "code"])
    owned, cash, out = np.zeros(len(names)), float(capital), []
    for session, rows in pdf.groupby("ord", sort=True):
        who, mark, px, weight = (rows[c].to_numpy() for c in ("code", "mark", "px", "weight"))
        value = cash + float(np.nansum(owned[who] * mark))
        aim = weight * value / px
        delta = np.nan_to_num((aim if fractional else np.trunc(aim)) - owned[who])
        delta[np.abs(delta) <= SHARE_EPS] = 0.0
        moved = np.flatnonzero(delta)
        n, at = delta[moved], px[moved]
        cash -= float((n * at).sum() + model.cost(n, at).sum())
        owned[who] += delta
        owned[np.abs(owned) <= SHARE_EPS] = 0.0
        out += [(strategy, session, t, x, y, value, cash) for t, x, y in zip(names[who[moved]], n, at, strict=True)]
        out.append((strategy, session, None, None, None, value, cash))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _LEDGER.split(", ")])


def run_backtest(
    prices: DataFrame, targets: DataFrame, *, initial_capital: float = 1_000_000.0, cost_model: CostModel | None = None, price_field: str = "adj_close",
    execution_prices: DataFrame | None = None, execution_price_field: str = "adj_open", execution_lag: int = 0, defer_halted: bool = False,
    allow_fractional: bool = True, start: object = None, end: object = None,
) -> BacktestResult:
    """Simulates ``targets`` (strategy, decision_date, ticker, weight) over long daily ``prices``.

    Marks are forward-filled; execution prices (``execution_prices``, else the marks' own) are not, so
    a gap or a price of 0 or less is a halt: the leg is skipped, or with ``defer_halted`` retried on
    the first priced session before the next rebalance. Sizes follow the value marked on the day of
    the fill. Held names without a target are sold. Costs are paid in cash.
    """
    model = cost_model or CostModel()
    bars = prices.select("date", "ticker", F.col(price_field).cast("double").alias("mark"))
    if start is not None:
        bars = bars.filter(F.col("date") >= F.lit(to_date(start)))
    if end is not None:
        bars = bars.filter(F.col("date") <= F.lit(to_date(end)))
    # Events, fills and marks all start from targets, sessions and grid. The first two are small and are
    # written out, which also keeps their plans from being copied into every join below; the grid is as
    # large as the bars, so it is kept where it was computed.
    days, targets = cut(sessions(bars)), cut(targets.select("strategy", "decision_date", "ticker", "weight"))
    names = targets.select("strategy", "ticker").distinct()
    used = bars.join(names.select("ticker").distinct(), "ticker", "left_semi")
    grid = dense(used, days).select("ticker", "ord", "date", forward_fill("mark", ["ticker"], "ord").alias("mark"), F.col("mark").alias("_own")).persist()
    if execution_prices is not None:
        fills = execution_prices.select("date", "ticker", F.col(execution_price_field).cast("double").alias("px")).join(F.broadcast(days), "date").select("ticker", "ord", "px")
    else:
        fills = grid.select("ticker", "ord", F.col("_own").alias("px"))
    fills = fills.filter("px > 0")
    snapped = snap_targets(targets, days, lag=execution_lag)
    weights = snapped.groupBy("strategy", "exec_ord", "ticker").agg(F.sum("weight").alias("weight"))
    sched = weights.select("strategy", "exec_ord").distinct()
    sched = sched.withColumn("next_ord", F.lead("exec_ord").over(Window.partitionBy("strategy").orderBy("exec_ord")))
    # a rebalance has a leg for every name with a target now or before; the latter may be held and is then sold
    before = Window.partitionBy("strategy", "ticker").orderBy("exec_ord").rowsBetween(Window.unboundedPreceding, 0)
    legs = sched.join(names, "strategy").join(weights, ["strategy", "exec_ord", "ticker"], "left")
    legs = legs.withColumn("seen", F.count("weight").over(before)).filter("seen > 0").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    plan = cut(_schedule(legs, fills, defer_halted))
    orders = plan.filter("fill_ord is not null").select("strategy", F.col("fill_ord").alias("ord"), "ticker", "weight", "px")
    events = sched.select("strategy", F.col("exec_ord").alias("ord")).union(orders.select("strategy", "ord")).distinct()
    rows = events.join(names, "strategy").join(grid.select("ticker", "ord", "mark"), ["ticker", "ord"], "left").join(orders, ["strategy", "ord", "ticker"], "left")
    capital = float(initial_capital)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _ledger(pdf, key[0], capital, model, allow_fractional)

    log = cut(rows.groupBy("strategy").applyInPandas(run, _LEDGER))  # every result starts from it
    done, states = log.filter("ticker is not null"), log.filter("ticker is null").select("strategy", "ord", "value", "cash")
    dated = F.broadcast(days)
    n, at = F.col("shares"), F.col("price")
    trades = done.join(dated, "ord").select("strategy", "date", "ticker", "shares", "price", (-n * at).alias("notional"), model.commission(n).cast("double").alias("commission"),
                                            model.slippage(n, at).cast("double").alias("slippage"), model.cost(n, at).cast("double").alias("cost"))
    traded = done.groupBy("strategy", "ord").agg(F.sum(F.abs(n * at)).alias("_t"))
    rebalanced = sched.select("strategy", F.col("exec_ord").alias("ord"), F.lit(True).alias("_r"))
    turnover = states.join(traded, ["strategy", "ord"], "left").join(rebalanced, ["strategy", "ord"], "left").filter("_r or _t is not null").join(dated, "ord").select(
        "strategy", "date", F.when(F.col("value") > 0, F.coalesce("_t", F.lit(0.0)) / F.col("value")).otherwise(0.0).alias("turnover"))
    # positions hold from a trade to the name's next one
    by_name = Window.partitionBy("strategy", "ticker").orderBy("ord")
    held = done.select("strategy", "ticker", "ord", F.sum("shares").over(by_name).alias("shares"), (F.lead("ord").over(by_name) - 1).alias("_to"))
    held = held.filter(F.abs("shares") > SHARE_EPS)
    unfilled = plan.filter("fill_ord is null")
    exits = unfilled.filter("weight = 0").join(held.select("strategy", "ticker", F.col("ord").alias("_o"), "_to"), ["strategy", "ticker"])
    exits = exits.filter((F.col("_o") < F.col("exec_ord")) & (F.col("_to").isNull() | (F.col("_to") + 1 >= F.col("exec_ord")))).select(*unfilled.columns)
    late = F.when(F.col("next_ord").isNull(), NEVER).otherwise(SUPERSEDED) if defer_halted else F.lit(NO_PRICE)
    skipped = unfilled.filter("weight <> 0").unionByName(exits).withColumnRenamed("exec_ord", "ord").join(dated, "ord").select("strategy", "date", "ticker", "weight", late.alias("reason"))
    last = days.agg(F.max("ord").alias("_last"), F.min("ord").alias("_first"))
    w = Window.partitionBy("strategy").orderBy("ord")
    starts = names.select("strategy").distinct().select("strategy", F.lit(-1).alias("ord"), F.lit(capital).alias("cash"))
    cash = states.select("strategy", "ord", "cash").unionByName(starts).withColumn("_to", F.lead("ord").over(w) - 1)
    spans = cash.join(F.broadcast(last)).withColumn("_to", F.coalesce("_to", "_last"))
    daily_cash = spans.filter(F.col("_to") >= F.greatest("ord", "_first")).select("strategy", "cash", F.explode(F.sequence(F.greatest("ord", "_first"), "_to")).alias("ord"))
    daily = held.join(F.broadcast(last)).select("strategy", "ticker", "shares", F.explode(F.sequence("ord", F.coalesce("_to", "_last"))).alias("ord"))
    value = daily.join(grid.select("ticker", "ord", "mark"), ["ticker", "ord"]).groupBy("strategy", "ord").agg(F.sum(F.col("shares") * F.col("mark")).alias("_v"))
    nav = daily_cash.join(value, ["strategy", "ord"], "left").join(dated, "ord").select(
        "strategy", "date", "cash", F.coalesce("_v", F.lit(0.0)).alias("positions_value"), (F.col("cash") + F.coalesce("_v", F.lit(0.0))).alias("nav"))
    return BacktestResult(nav=nav, turnover=turnover, trades=trades, skipped=skipped, initial_capital=capital)
