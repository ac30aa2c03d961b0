"""DuckDB restatements of the market and its derived tables, as common table expressions."""

from __future__ import annotations

CTES = """
WITH RECURSIVE trades AS (
  SELECT upper(p_brand) AS ticker, CAST(l_shipdate AS DATE) AS date, sum(CAST(l_quantity AS DECIMAL(18,2))) AS volume,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS notional, sum(CAST(l_discount AS DECIMAL(18,4))) AS disc, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE isodow(CAST(l_shipdate AS DATE)) <= 5 GROUP BY 1, 2),
px AS (
  SELECT ticker, date, CAST(volume AS DOUBLE) AS volume,
         floor(CAST(sum(notional) OVER w AS DOUBLE) / CAST(sum(volume) OVER w AS DOUBLE) * 1e6 + 0.5) / 1e6 AS close,
         CAST(sum(disc) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) AS d
  FROM trades WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
bars0 AS (
  SELECT date, ticker, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY date), close) AS open, close,
         floor(close * (1 - d) * 1e6 + 0.5) / 1e6 AS adj_close, volume FROM px),
bars AS (SELECT date, ticker, open, greatest(open, close) AS high, least(open, close) AS low, close, adj_close, volume FROM bars0),
itrades AS (SELECT date, sum(volume) AS volume, sum(notional) AS notional FROM trades GROUP BY 1),
bench AS (
  SELECT date, floor(CAST(sum(notional) OVER w AS DOUBLE) / CAST(sum(volume) OVER w AS DOUBLE) * 1e6 + 0.5) / 1e6 AS close
  FROM itrades WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
sess AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ord FROM (SELECT DISTINCT date FROM bars)),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rebal FROM (SELECT max(date) AS date FROM sess GROUP BY date_trunc('month', date))),
qv AS (SELECT date_trunc('quarter', date) AS q0, ticker, sum(volume) AS v FROM bars GROUP BY 1, 2),
qm AS (
  SELECT CAST(last_day(CAST(q0 AS DATE) + INTERVAL 2 MONTH) AS DATE) AS as_of, ticker, year(q0) * 4 + quarter(q0) AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY q0 ORDER BY v DESC, ticker) AS r FROM qv) WHERE r <= 20),
qd AS (SELECT DISTINCT as_of FROM qm),
members AS (
  SELECT c.as_of, m.ticker FROM (
    SELECT cal.date AS as_of, coalesce((SELECT max(as_of) FROM qd WHERE qd.as_of <= cal.date), (SELECT min(as_of) FROM qd)) AS snap FROM cal) c
  JOIN qm m ON m.as_of = c.snap),
mp AS (SELECT ticker, year(date) * 12 + month(date) - 1 AS m, arg_max(adj_close, date) AS price FROM bars GROUP BY 1, 2),
atm AS (SELECT date, CASE WHEN last_day(date) > date THEN year(date) * 12 + month(date) - 2 ELSE year(date) * 12 + month(date) - 1 END AS m FROM cal),
mom AS (SELECT a.date, p1.ticker, p1.price / p0.price - 1 AS value FROM atm a JOIN mp p1 ON p1.m = a.m - 1 JOIN mp p0 ON p0.ticker = p1.ticker AND p0.m = a.m - 12),
rev AS (SELECT a.date, p1.ticker, -(p1.price / p0.price - 1) AS value FROM atm a JOIN mp p1 ON p1.m = a.m JOIN mp p0 ON p0.ticker = p1.ticker AND p0.m = a.m - 1),
grid AS (
  SELECT f.ticker, s.date, s.ord, b.close, b.volume, b.adj_close,
         last_value(b.adj_close IGNORE NULLS) OVER (PARTITION BY f.ticker ORDER BY s.ord ROWS UNBOUNDED PRECEDING) AS mark
  FROM (SELECT ticker, min(date) AS d0 FROM bars GROUP BY 1) f JOIN sess s ON s.date >= f.d0 LEFT JOIN bars b ON b.ticker = f.ticker AND b.date = s.date),
rets AS (SELECT *, mark / lag(mark) OVER (PARTITION BY ticker ORDER BY ord) - 1 AS ret FROM grid),
lv0 AS (
  SELECT ticker, date, CASE WHEN count(ret) OVER w >= 126 THEN -stddev_samp(ret) OVER w END AS value
  FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY ord ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
lowvol AS (SELECT date, ticker, value FROM lv0 JOIN cal USING (date) WHERE value IS NOT NULL),
am0 AS (
  SELECT ticker, date, CASE WHEN count(x) OVER w >= 10 THEN avg(x) OVER w * 1e6 END AS value
  FROM (SELECT ticker, date, ord, abs(ret) / nullif(close * volume, 0) AS x FROM rets) WINDOW w AS (PARTITION BY ticker ORDER BY ord ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
amihud AS (SELECT date, ticker, value FROM am0 JOIN cal USING (date) WHERE value IS NOT NULL),
raw AS (
  SELECT 'momentum_12_1' AS factor, * FROM (SELECT date, ticker, value FROM mom) UNION ALL SELECT 'low_volatility_252', date, ticker, value FROM lowvol
  UNION ALL SELECT 'short_term_reversal_1', date, ticker, value FROM rev UNION ALL SELECT 'amihud_illiq_21', date, ticker, value FROM amihud),
names AS (SELECT DISTINCT factor FROM raw),
vals AS (SELECT n.factor, m.as_of AS date, m.ticker, r.value FROM members m CROSS JOIN names n LEFT JOIN raw r ON r.factor = n.factor AND r.date = m.as_of AND r.ticker = m.ticker),
atreb AS (SELECT c.rebal, c.date, b.ticker, b.adj_close AS p FROM bars b JOIN cal c USING (date)),
fwd AS (SELECT a.date, a.ticker, b.p / a.p - 1 AS fwd_ret FROM atreb a LEFT JOIN atreb b ON b.ticker = a.ticker AND b.rebal = a.rebal + 1),
fgrid AS (SELECT n.factor, f.* FROM fwd f CROSS JOIN names n WHERE f.date IN (SELECT as_of FROM members)),
panel AS (
  SELECT coalesce(v.factor, f.factor) AS factor, coalesce(v.date, f.date) AS date, coalesce(v.ticker, f.ticker) AS ticker, v.value, f.fwd_ret
  FROM vals v FULL JOIN fgrid f ON v.factor = f.factor AND v.date = f.date AND v.ticker = f.ticker),
pairs AS (SELECT * FROM panel WHERE value IS NOT NULL AND fwd_ret IS NOT NULL),
rk AS (
  SELECT factor, date, ticker,
    rank() OVER (PARTITION BY factor, date ORDER BY round(value, 12)) + (count(*) OVER (PARTITION BY factor, date, round(value, 12)) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY factor, date ORDER BY round(fwd_ret, 12)) + (count(*) OVER (PARTITION BY factor, date, round(fwd_ret, 12)) - 1) / 2.0 AS y FROM pairs),
ic AS (
  SELECT factor, date, covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) AS ic FROM rk GROUP BY 1, 2
  HAVING count(*) >= 2 AND stddev_samp(x) > 0 AND stddev_samp(y) > 0),
bk0 AS (
  SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY round(value, 12), ticker) AS r, count(*) OVER (PARTITION BY factor, date) AS m
  FROM panel WHERE value IS NOT NULL),
bk AS (SELECT *, CASE WHEN r = 1 THEN 1 ELSE CAST(ceil((r - 1) * least(10, m) / (m - 1) - 1e-9) AS INT) END AS bucket FROM bk0),
dec AS (SELECT factor, date, bucket, avg(fwd_ret) AS ret FROM bk WHERE fwd_ret IS NOT NULL GROUP BY 1, 2, 3),
ann AS (SELECT factor, bucket, count(*) AS n, CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 12.0 / count(*)) - 1 END AS annualized FROM dec GROUP BY 1, 2),
ls AS (
  SELECT factor, date, max(CASE WHEN bucket = 10 THEN ret END) - max(CASE WHEN bucket = 1 THEN ret END) AS ret FROM dec GROUP BY 1, 2
  HAVING max(CASE WHEN bucket = 10 THEN ret END) IS NOT NULL AND max(CASE WHEN bucket = 1 THEN ret END) IS NOT NULL),
qt AS (SELECT factor, date, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM panel WHERE value IS NOT NULL GROUP BY 1, 2),
wz AS (SELECT p.factor, p.date, p.ticker, CASE WHEN p.value IS NOT NULL THEN greatest(q.lo, least(q.hi, p.value)) END AS v FROM panel p JOIN qt q ON q.factor = p.factor AND q.date = p.date),
zz AS (
  SELECT factor, date, ticker, CASE WHEN s > 1e-12 * greatest(1.0, abs(a)) THEN (v - a) / s ELSE v - a END AS z
  FROM (SELECT *, avg(v) OVER (PARTITION BY factor, date) AS a, stddev_samp(v) OVER (PARTITION BY factor, date) AS s FROM wz)),
br AS (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM bench),
rg0 AS (
  SELECT date, close, CASE WHEN count(r) OVER v = 21 THEN stddev_samp(r) OVER v * sqrt(252.0) END AS vol, CASE WHEN count(*) OVER t = 200 THEN avg(close) OVER t END AS trend
  FROM br WINDOW v AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), t AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
rg1 AS (SELECT *, median(vol) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS med, median(vol) OVER () AS med_all FROM rg0),
regime AS (
  SELECT date, CASE WHEN vol > med THEN 'high_vol' ELSE 'low_vol' END || CASE WHEN close > trend THEN '_up' ELSE '_down' END AS regime
  FROM rg1 WHERE vol IS NOT NULL AND trend IS NOT NULL),
rgcal AS (SELECT c.date, r.regime FROM cal c ASOF JOIN regime r ON c.date >= r.date),
nav AS (SELECT ticker AS strategy, date, mark AS nav FROM grid),
nret AS (SELECT * FROM (SELECT strategy, date, nav, nav / lag(nav) OVER (PARTITION BY strategy ORDER BY date) - 1 AS ret FROM nav) WHERE ret IS NOT NULL),
tgt AS (
  SELECT date AS decision_date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM bk WHERE factor = 'momentum_12_1' AND bucket IN (9, 10)),
mret AS (SELECT a.ticker AS asset, a.m, a.price / b.price - 1 AS ret FROM mp a JOIN mp b ON b.ticker = a.ticker AND b.m = a.m - 1),
cmret AS (SELECT * FROM mret WHERE m IN (SELECT m FROM mret GROUP BY m HAVING count(*) = (SELECT count(DISTINCT asset) FROM mret)))
"""


def sql(body: str) -> str:
    """``body`` as the final select over the expressions above."""
    return f"{CTES}\n{body}"
