"""Nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length one, rotated by a fixed random orthogonal matrix, and kept as the
signs of its coordinates, packed into bits, with two scalars: its length and the inner product of
the rotated unit vector with its own code. The inner product of a rotated query with the code,
divided by that scalar, is an unbiased estimate of the true one with a known error bound. Every
candidate whose upper bound reaches the exact score of the query's current k-th best is scored
exactly on the original vectors, in double precision: codes choose what is looked at, they never
decide an order.

Equal vectors are one class, indexed once with its smallest ids. Classes are dealt to cells around
centres fitted on a bounded sample (``SAMPLE`` classes); their codes are made once. A query first
visits the cell nearest to it, which gives a k-th score to beat, and then only the cells whose own
upper bound (the cone around the centre that holds them, and the longest vector) reaches that score.
So clustered vectors are searched in part and vectors spread evenly in whole, with one result.
Queries meet cells in blocks of bounded size, and a task hands on k + 1 rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import cut, kept_table, spread_join

SEED, K = 13, 20
#: Width of the error bound in standard deviations of the estimate (larger: surer and slower).
EPSILON = 4.0
#: Classes that centres are fitted on at most, classes for a cell to be made, and cells at most.
SAMPLE, CELL, CELLS = 16_384, 8192, 8192
#: Classes of a block and queries of a block; queries are scored so many at a time.
BLOCK, QUERIES, AT_ONCE = 16_384, 1024, 128
_FOUND = "q1 long, q2 long, vec_id long, same boolean, score double"


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths); components are scaled first, so that no square overflows or vanishes."""
    with np.errstate(over="ignore"):
        scale = np.abs(x).max(axis=1)
        scaled = x / scale[:, None]
        norm = np.sqrt((scaled * scaled).sum(axis=1))
        return scaled / norm[:, None], scale * norm


class Codes:
    """One-bit codes of a block: packed signs and the correction scalar."""

    def __init__(self, bits: np.ndarray, own: np.ndarray, dim: int) -> None:
        self.bits, self.own, self.dim = bits, own, dim

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        rotated = unit @ rotation(unit.shape[1]).T
        # <o, code>, about 0.8 for many dimensions; at least 1 / sqrt(dim)
        own = np.abs(rotated).sum(axis=1) / np.sqrt(unit.shape[1])
        return cls(np.packbits(rotated >= 0, axis=1), own, unit.shape[1])

    def estimate(self, unit_queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated cosines, a row per query; error bound of each code)."""
        signs = np.unpackbits(self.bits, axis=1, count=self.dim).astype(np.float32) * np.float32(2) - np.float32(1)
        rotated = (unit_queries @ rotation(self.dim).T).astype(np.float32)
        by = (1 / (np.sqrt(self.dim) * self.own)).astype(np.float32)
        error = np.sqrt(np.maximum(1 - self.own**2, 0)) / self.own / np.sqrt(max(self.dim - 1, 1))
        return (rotated @ signs.T) * by, EPSILON * error + 1e-5


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products added from the first component on, one order for every pair whatever block it comes from."""
    return np.add.accumulate(x * y, axis=1)[:, -1]


def search_block(x: np.ndarray, length: np.ndarray, codes: Codes, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs that may be among the ``k`` best of each query and reach its ``floor``.

    Scores are exact; a query's pairs hold its ``k`` best rows of the block and all ties of the last.
    """
    unit, q_len = lengths(q)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    longest, shortest = length.max(), length.min()
    with np.errstate(all="ignore"):
        # where products may overflow or vanish, bounds say nothing: those queries see every row
        plain = (q_len * longest < 1e300) & (q_len * shortest > 1e-280)
        for at in range(0, len(q), AT_ONCE):
            who = np.arange(at, min(at + AT_ONCE, len(q)))
            for part, bounded in ((who[plain[who]], True), (who[~plain[who]], False)):
                if not len(part):
                    continue
                if bounded:
                    est, error = codes.estimate(unit[part])
                    scores = q[part] @ x.T
                    least = floor[part]
                    # sums in another order differ by rounding
                    slack = 1e-12 * q_len[part] * longest
                    below = (est + error) * (length * q_len[part][:, None])
                    if len(x) > k:
                        lead = np.argpartition(-est * length, k - 1, axis=1)[:, :k]
                        least = np.maximum(least, np.take_along_axis(scores, lead, axis=1).min(axis=1))
                        below = below < (least - slack)[:, None]
                        np.put_along_axis(below, lead, False, axis=1)
                    else:
                        below = below < (least - slack)[:, None]
                    scores[below] = -np.inf
                else:
                    scores = np.stack([inner(x, v) for v in q[part]])
                    scores[np.isnan(scores)] = -np.inf
                    slack = np.zeros(len(part))
                last = np.partition(scores, -k, axis=1)[:, -k] if len(x) > k else np.full(len(part), -np.inf)
                i, j = np.nonzero(scores >= (last - slack)[:, None])
                exact = np.concatenate([inner(x[j[s : s + 8192]], q[part[i[s : s + 8192]]]) for s in range(0, len(i), 8192)] or [np.empty(0)])
                reach = ~(exact < floor[part[i]])
                out.append((part[i][reach], j[reach], exact[reach]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: no null, non-finite or all-zero vector."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0").filter(fine)


def fit_centres(unit: np.ndarray, n: int) -> np.ndarray:
    """``n`` unit centres of a sample of unit vectors, by a few rounds of spherical k-means."""
    centres = unit[np.random.default_rng(SEED).permutation(len(unit))[:n]]
    for _ in range(8):
        nearest_ = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest_, unit)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], centres)
    return centres


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), np.float64).reshape(-1, dim)


def _coded(classes: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Classes with their dim, cell, cosine to its centre, length, code and correction scalar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims).tolist():
                rows = b.filter(pa.array(dims == dim))
                unit, length = lengths(_matrix(rows.column("v"), dim))
                codes = Codes.of(unit)
                cos = unit @ centres[dim].T if dim in centres else np.ones((len(unit), 1))
                cell = cos.argmax(axis=1)
                more = [cell.astype(np.int32), cos[np.arange(len(cell)), cell], length]
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x) for x in more), pa.array([c.tobytes() for c in codes.bits], pa.binary()), pa.array(codes.own)],
                                                 names=[*b.schema.names, "cell", "cos", "length", "bits", "own"])

    return classes.mapInArrow(run, "c1 long, c2 long, v array<double>, ids array<long>, dim int, cell int, cos double, length double, bits binary, own double")


def nearest(vectors: DataFrame, *, every: int = 20, k: int = K, cell: int = CELL, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query (a row whose vec_id is divisible by ``every``).

    Defined cases: vectors that are null, zero, or hold null or non-finite components take no part;
    vectors of another dimension than the query's are not compared with it; rows that repeat a
    vec_id are candidates and queries each, a query never finds its own row; products beyond the
    range of doubles are infinite and tie, undefined ones (NaN) come last; fewer than k candidates:
    all; other columns are ignored; an empty table gives an empty result.
    """
    rows = usable(vectors).select("vec_id", "v", F.xxhash64("v").alias("c1"), F.xxhash64(F.lit(SEED), "v").alias("c2"))
    asks = cut(rows.filter(F.col("vec_id") % every == 0).select("c1", "c2", "vec_id"))
    # of equal vectors only the smallest ids can be among the nearest: k, and one that may be the query's own
    low = rows.withColumn("r", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    classes = kept_table(low.groupBy("c1", "c2").agg(F.min("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v")), "classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") > cell).collect()}
    centres = {}
    for dim, n in sizes.items():
        drawn = classes.filter(F.col("dim") == dim).filter(F.pmod("c1", F.lit(1 << 20)) < max(1, min(1 << 20, (SAMPLE << 20) // n))).select("v").limit(2 * SAMPLE)
        sample = np.array([r["v"] for r in drawn.collect()], np.float64).reshape(-1, dim)
        if len(sample) > 1:
            centres[dim] = fit_centres(lengths(sample)[0], min(-(-n // cell), CELLS, len(sample)))
    coded = kept_table(_coded(classes, centres), "codes")
    # a row for each cell: at most CELLS for each dimension
    cells = coded.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("cos").alias("cos"), F.max("length").alias("longest")).collect()
    blocks = {(r["dim"], r["cell"]): -(-r["n"] // block) for r in cells}
    cones = {d: [(r["cell"], r["cos"], r["longest"]) for r in cells if r["dim"] == d] for d in centres}
    spark = coded.sparkSession
    shape = cut(spark.createDataFrame([(d, c, n) for (d, c), n in blocks.items()], "dim int, cell int, blocks int"))
    query = coded.join(asks.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi").select("c1", "c2", "dim", "cell", "v")

    def meet(visits: DataFrame) -> DataFrame:
        """Each visit (c1, c2, dim, cell, v, floor) scored against its cell's blocks."""
        asked = visits.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(float(queries))).cast("int").alias("parts"))
        plan = F.broadcast(asked.join(shape, ["dim", "cell"]))
        c = coded.join(plan, ["dim", "cell"]).withColumn("b", F.pmod(F.xxhash64("c2"), F.col("blocks")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        q = visits.join(plan, ["dim", "cell"]).withColumn("p", F.pmod(F.xxhash64("c2"), F.col("parts")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["dim", "cell", "b", "p"]

        def run(key: tuple, c: pa.Table, q: pa.Table) -> pa.Table:
            none = pa.table({"q1": pa.array([], pa.int64()), "q2": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "same": pa.array([], pa.bool_()), "score": pa.array([], pa.float64())})
            if not c.num_rows or not q.num_rows:
                return none
            dim = key[0].as_py()
            bits = np.frombuffer(b"".join(c.column("bits").to_pylist()), np.uint8).reshape(c.num_rows, -1)
            codes = Codes(bits, np.asarray(c.column("own")), dim)
            i, j, score = search_block(_matrix(c.column("v"), dim), np.asarray(c.column("length")), codes, _matrix(q.column("q_v"), dim), np.asarray(q.column("q_floor")), k + 1)
            ids = c.column("ids").combine_chunks()
            many = np.asarray(ids.value_lengths())[j]
            start = np.asarray(ids.offsets)[:-1][j] - ids.offsets[0].as_py()
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            c1, c2, q1, q2 = np.asarray(c.column("c1")), np.asarray(c.column("c2")), np.asarray(q.column("q_c1")), np.asarray(q.column("q_c2"))
            same = np.repeat((c1[j] == q1[i]) & (c2[j] == q2[i]), many)
            i, score, vec = np.repeat(i, many), np.repeat(score, many), np.asarray(ids.flatten())[np.repeat(start, many) + inside]
            order = np.lexsort((vec, np.nan_to_num(-score, nan=np.inf, posinf=np.inf, neginf=-np.inf), np.isnan(score), i))
            i, score, vec, same = i[order], score[order], vec[order], same[order]
            first = np.concatenate(([True], i[1:] != i[:-1]))[: len(i)]
            place = np.arange(len(i)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            i, score, vec, same = (y[place <= k] for y in (i, score, vec, same))
            return pa.table({"q1": q1[i], "q2": q2[i], "vec_id": vec, "same": same, "score": score})

        return c.select(*keys, "c1", "c2", "ids", "v", "length", "bits", "own").groupBy(*keys).cogroup(
            # names of their own: columns of one origin are ambiguous
            q.select(*(F.col(n).alias(f"q_{n}") for n in (*keys, "c1", "c2", "v", "floor"))).groupBy(*(f"q_{n}" for n in keys))).applyInArrow(run, _FOUND)

    def best(found: DataFrame) -> DataFrame:
        order: list[Column] = [F.isnan("score"), F.col("score").desc(), F.col("vec_id")]
        return found.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(*order))).filter(F.col("r") <= k + 1)

    lowest = F.lit(float("-inf"))
    found = best(meet(query.withColumn("floor", lowest)))
    if centres:
        found = cut(found)
        reached = found.filter((F.col("r") == k + 1) & ~F.isnan("score")).select(F.col("q1").alias("c1"), F.col("q2").alias("c2"), F.col("score").alias("floor"))
        asking = query.join(reached, ["c1", "c2"], "left").withColumn("floor", F.coalesce("floor", lowest))

        def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for every further cell whose upper bound reaches the query's floor."""
            for b in batches:
                dims = np.asarray(b.column("dim"))
                for dim in np.unique(dims).tolist():
                    if dim not in cones:
                        continue
                    number, cos, longest = (np.array(x) for x in zip(*cones[dim], strict=True))
                    part = b.filter(pa.array(dims == dim))
                    for at in range(0, part.num_rows, AT_ONCE):
                        rows_ = part.slice(at, AT_ONCE)
                        unit, length = lengths(_matrix(rows_.column("v"), dim))
                        away = np.arccos(np.clip(unit @ centres[dim][number].T, -1, 1)) - np.arccos(np.clip(cos, -1, 1))
                        with np.errstate(all="ignore"):
                            high = (np.cos(np.clip(away - 1e-6, 0, np.pi)) + 1e-9) * (longest * length[:, None])
                        # a negative cosine is largest for the shortest vector; zero bounds it
                        go = ~(np.maximum(high, 0) < np.asarray(rows_.column("floor"))[:, None])
                        go &= np.asarray(rows_.column("cell"))[:, None] != number
                        i, j = np.nonzero(go)
                        got = rows_.take(pa.array(i))
                        yield pa.RecordBatch.from_arrays([*(got.column(n) for n in ("c1", "c2", "dim")), pa.array(number[j].astype(np.int32)), got.column("v"), got.column("floor")],
                                                         names=["c1", "c2", "dim", "cell", "v", "floor"])

        visits = asking.mapInArrow(onward, "c1 long, c2 long, dim int, cell int, v array<double>, floor double")
        found = best(found.drop("r").unionByName(meet(visits)))
    top = found.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "same", "score"))).alias("top"))
    per = asks.groupBy("c1", "c2").agg(F.count("*").alias("n")).join(top, (F.col("c1") == F.col("q1")) & (F.col("c2") == F.col("q2")), "inner").select("c1", "c2", "n", "top")
    each = spread_join(asks, per, ["c1", "c2"], "n", small=20_000)
    # the query's own row goes: one of its id and class
    own = F.array_position(F.transform("top", lambda t: t["same"] & (t["vec_id"] == F.col("vec_id"))), F.lit(True))
    rest = F.when(own > 0, F.filter("top", lambda t, i: i + 1 != own)).otherwise(F.col("top"))
    out = each.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(rest, 1, k)).alias("place", "t"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
