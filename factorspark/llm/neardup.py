"""Near copies by SimHash and BK-trees: all pairs of texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more.

Texts of equal words are one class. A class has a fingerprint whose bits are majority votes of its
shingles' hashes. A bit differs in a pair at 0.8 with chance ``DIFFER`` at most, so 64 bits at radius 2,
as in ``simhash``, can't reach it: the fingerprint is longer. ``BITS`` of its bits are what trees measure, with radius
``RADIUS`` (a pair at 0.8 is beyond it with chance 1e-6); the rest are cut to blocks, so many that a pair
agrees on none with chance ``MISS`` (the pigeonhole of radius 2 would need blocks of 3 bits). A class
goes to one shard per block, keyed by the block's value. Blocks get wider and more with the corpus
(``blocks``), so shards stay at about 16 random classes. In a shard's BK-trees each class looks for those within the radius
along the edges that can lead there; only classes that found one or were found go on.

Links are then checked exactly, in two rounds, so that a large group of near copies does not
cost all its pairs: first a spanning forest of each shard, then every pair of a shard that the
links of the first round leave in different components. A bound that loses nothing comes before
the exact comparison: each shingle flips one of 256 bits, so two sets differ in at least as many shingles as
their bits do.

No task holds a large shard: one of over ``SHARD_MAX`` classes skips the tree and goes on whole. In the first round a
shard is dealt to parts of about ``PART`` classes, and about ``PIVOTS`` of its classes go to all of them, so that the
parts' forests meet. In the second, parts of the whole shard meet parts of what is outside its largest component: all
pairs that are left, and no shard of one component is read at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import cut, kept_table, one_per_group, spread_join
from factorspark.llm.components import components
from factorspark.llm.simhash import BKTree

SHINGLE, SEED = 5, 42
#: Bits that trees measure, and how many may differ.
BITS, RADIUS = 128, 42
#: Chances, at most, that a bit of a pair at 0.8 differs, and that all its blocks do.
DIFFER, MISS = 0.156, 3e-6
#: Classes of the largest shard that gets a tree.
SHARD_MAX = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP, _MIX, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Votes are summed in bytes.
_CHUNK = 250
#: Classes of a bucket that one group compares, about, and those of a larger bucket that all its groups share.
PART, PIVOTS = 1024, 64
#: Rows per record batch sent on.
_OUT = 20_000
_DEALT = "key long, h long, f0 long, f1 long"


def shingles(text: str | None) -> tuple[int, np.ndarray]:
    """(hash of the words, sorted distinct shingle hashes); shorter texts are one shingle, blank ones none."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    h = xxhash.xxh3_64_intdigest(line, SEED)
    if len(w) <= SHINGLE:
        return h, np.array([digest(line, SEED)] if w else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts, stops = [0, *ends[:-SHINGLE].tolist()], (ends[SHINGLE - 1 :] - 1).tolist()
    return h, np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def blocks(rows: int) -> tuple[int, int]:
    """(bits of a block, number of blocks) for a corpus of so many rows."""
    width = max(8, math.ceil(math.log2(max(rows, 1))) - 4)
    return width, math.ceil(math.log(MISS) / math.log1p(-((1 - DIFFER) ** width)))


def fingerprint(s: np.ndarray, bits: int) -> np.ndarray:
    """Bit b is 1 if more than half of the shingles' hashes have it.

    Sets of up to three shingles are at 0.8 only if they are equal, so they vote as one. To larger ones
    a vote that all share is added: sets of four and five at 0.8 would differ in 0.19 of their bits.
    """
    x = np.append(s, _STEP) if len(s) > 3 else np.bitwise_xor.reduce(s * _MIX, keepdims=True)
    step = np.arange(1, -(-bits // 64) + 1, dtype=np.uint64) * _STEP
    ones = np.zeros(64 * len(step), np.int64)
    for at in range(0, len(x), _CHUNK):
        h = x[at : at + _CHUNK, None] + step
        h = (h ^ (h >> np.uint64(30))) * _MIX
        h = (h ^ (h >> np.uint64(27))) * _FOLD
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (2 * ones[:bits] > len(x)).view(np.uint8)


def block_keys(bits: np.ndarray, width: int) -> np.ndarray:
    """A key for each block of each row of ``bits``, which are those after the first ``BITS``."""
    value = bits.reshape(len(bits), -1, width) @ (1 << np.arange(width))
    return value + (np.arange(value.shape[1]) << width)


def parities(s: np.ndarray) -> bytes:
    """256 bits, each the parity of the shingles that fall to it."""
    return np.packbits(np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch], width: int, count: int) -> Iterator[pa.RecordBatch]:
    """``bits`` are the parities and the fingerprint's first bits, ``blocks`` the others."""
    for b in batches:
        hs, n, bits, rest = [], [], [], []
        for t in b.column(2):
            h, s = shingles(t.as_py())
            hs.append(h)
            n.append(len(s))
            f = fingerprint(s, BITS + width * count)
            bits.append(parities(s) + np.packbits(f[:BITS]).tobytes())
            rest.append(np.packbits(f[BITS:]).tobytes())
        h = np.array(hs, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(h), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(rest, pa.binary())],
            names=["doc_id", "text_hash", "h", "n", "bits", "blocks"])


def _deal(batches: Iterator[pa.RecordBatch], width: int, count: int) -> Iterator[pa.RecordBatch]:
    """A row for each block of a class."""
    for b in batches:
        for at in range(0, b.num_rows, max(1, _OUT // count)):
            p = b.slice(at, max(1, _OUT // count))
            m = p.num_rows
            rest = np.frombuffer(b"".join(p.column(2).to_pylist()), np.uint8).reshape(m, -1)
            f = np.frombuffer(b"".join(p.column(1).to_pylist()), np.int64).reshape(m, -1)[:, 4:]
            key = block_keys(np.unpackbits(rest, axis=1, count=width * count), width)
            cols = (np.repeat(c, count) for c in (np.asarray(p.column(0)), f[:, 0], f[:, 1]))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *map(pa.array, cols)], names=["key", "h", "f0", "f1"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key another one has; rows come sorted by key."""
    held, sent = None, False
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        key = np.asarray(b.column(0))
        same = key[1:] == key[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        # the last row waits for the next batch; sent already, it comes back to show its key
        if held is not None:
            keep[0] = same[0] and not sent
        sent, held = bool(keep[-1]), b.slice(b.num_rows - 1)
        yield b.filter(pa.array(keep))


def _search(tree: BKTree, value: int, radius: int) -> Iterator[int]:
    """Indices of the nodes within ``radius`` of ``value``. Nodes have fewer edges than a wide radius has distances."""
    values, children, stack = tree.values, tree.children, [0] if tree.values else []
    while stack:
        i = stack.pop()
        d = (values[i] ^ value).bit_count()
        if d <= radius:
            yield i
        for r, k in children[i].items():
            if d - radius <= r <= d + radius:
                stack.append(k)


def neighboured(values: list[int], radius: int) -> list[bool]:
    """Of each value whether another one is within ``radius`` of it.

    By two BK-trees, so that a group of near copies does not cost all its pairs. One has the values that
    found none when they came: all of it is searched, for they wait to be found. Of the other any node will do.
    """
    alone, met, rows, found, first = BKTree(), BKTree(), [], [False] * len(values), {}
    for i, v in enumerate(values):
        if radius >= 0 and (j := first.setdefault(v, i)) != i:
            found[i] = found[j] = True
            continue
        hits = list(_search(alone, v, radius))
        for k in hits:
            found[rows[k]] = True
        if hits or next(_search(met, v, radius), None) is not None:
            found[i] = True
            met.add(v)
        else:
            alone.add(v)
            rows.append(i)
    return found


def _near(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(key, h) of the rows that have a neighbour in their shard, all of one too large for a tree; they come sorted by key."""
    held, large = None, None

    def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
        key = np.asarray(rows.column(0))
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        f0, f1 = (np.asarray(rows.column(i)).view(np.uint64).tolist() for i in (2, 3))
        values = [a << 64 | b for a, b in zip(f0, f1, strict=True)]
        keep: list[bool] = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            keep += [True] * (e - s) if e - s > SHARD_MAX or key[s] == large else neighboured(values[s:e], radius)
        return rows.select(["key", "h"]).filter(pa.array(keep, pa.bool_()))

    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        key = np.asarray(b.column(0))
        last = int(np.searchsorted(key, key[-1]))
        if key[-1] == large or len(key) - last > SHARD_MAX:  # what follows of this key goes on as well
            out, held = settle(b), None
            large = key[-1]
        else:
            out, held = settle(b.slice(0, last)) if last else None, b.slice(last)
        if out is not None:
            yield out
    if held is not None:
        yield settle(held)


def _buckets(batches: Iterator[pa.RecordBatch], pairs: Callable) -> Iterator[pa.RecordBatch]:
    """(a, b) by ``pairs`` of each group of rows (key, h, n, bits, comp, side); they come sorted by key."""
    held: list[pa.RecordBatch] = []
    out: list[np.ndarray] = []

    def settle(rows: pa.Table) -> None:
        cols = [np.asarray(c.combine_chunks()) for c in (rows.column(0), rows.column(1), rows.column(2), rows.column(4), rows.column(5))]
        bits = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint64).reshape(len(rows), -1)
        key, h, n, comp, side = cols
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s > 1:
                for x, y in pairs(n[s:e], bits[s:e], comp[s:e], side[s:e]):
                    out.append(np.stack((h[s:e][x], h[s:e][y])))

    def done() -> Iterator[pa.RecordBatch]:
        if out:
            ab = np.concatenate(out, axis=1)
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ab.min(axis=0)), pa.array(ab.max(axis=0))], names=["a", "b"])

    for b in batches:
        key = np.asarray(b.column(0))
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1].column(0)[0].as_py() != key[0]):
            held.append(b.slice(0, last))
            settle(pa.Table.from_batches(held))
            held = []
            yield from done()
        held.append(b.slice(last))
    if held:
        settle(pa.Table.from_batches(held))
        yield from done()


def _differ(n: np.ndarray, bits: np.ndarray, size: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose fingerprint is within the radius and that may be at 0.8 or more from a set of ``size`` and ``code`` (sets
    then differ in a ninth of their sizes' sum), and their bound. Of ``bits`` four numbers are the parities, the others the fingerprint."""
    x = np.bitwise_count(bits ^ code)
    d = np.maximum(x[:, :4].sum(axis=1, dtype=np.int64), np.abs(n - size))
    at = np.flatnonzero((9 * d <= n + size) & (x[:, 4:].sum(axis=1, dtype=np.int64) <= RADIUS))
    return at, d[at]


def _forest(n: np.ndarray, bits: np.ndarray, comp: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    label = np.arange(len(n))
    for i in range(1, len(n)):
        at, d = _differ(n[:i], bits[:i], n[i], bits[i])
        if len(at):
            at = at[np.argsort(d, kind="stable")]
            trees, first = np.unique(label[at], return_index=True)
            yield at[first], np.full(len(first), i)
            label[: i + 1][np.isin(label[: i + 1], trees)] = i


def _across(n: np.ndarray, bits: np.ndarray, comp: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of side 1 with those of side 0 that are in another component."""
    left = np.flatnonzero(side == 0)
    for i in np.flatnonzero(side == 1):
        other = left[comp[left] != comp[i]]
        at, _ = _differ(n[other], bits[other], n[i], bits[i])
        if len(at):
            yield other[at], np.full(len(at), i)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            p = b.slice(at, 500)
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array([shingles(t.as_py())[1].tobytes() for t in p.column(1)], pa.binary())], names=["h", "s"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            ok.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, ok) of distinct ``pairs`` of classes: whether their sets are at 0.8 or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    chosen = classes.select("h", "text_hash").join(ends, "h", "left_semi")
    picked = texts.join(chosen, "text_hash").select("h", "text").dropDuplicates(["h"])
    sets = kept_table(picked.mapInArrow(_sets, "h long, s binary"), "sets")
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long, ok boolean"))


def links(classes: DataFrame, texts: DataFrame, width: int, count: int, *, radius: int = RADIUS) -> DataFrame:
    """(a, b): links of the classes, enough that every pair at 0.8 or more is connected."""
    dealt = classes.filter("n > 0").select("h", "bits", "blocks").mapInArrow(lambda batches: _deal(batches, width, count), _DEALT)
    shards = dealt.repartition("key").sortWithinPartitions("key")
    near = kept_table(shards.mapInArrow(lambda batches: _near(_shared(batches), radius), "key long, h long"), "near")
    buckets = kept_table(near.join(classes.select("h", "n", "bits"), "h").select("key", "h", "n", "bits"), "buckets")

    def pairs(rows: DataFrame, rule: Callable) -> DataFrame:
        rows = rows.select("key", "h", "n", "bits", "comp", "side").repartition("key").sortWithinPartitions("key", "side", "h")
        return cut(rows.mapInArrow(lambda batches: _buckets(batches, rule), "a long, b long").distinct())

    first = _verified(pairs(_parts(buckets), _forest), classes, texts)
    comp = components(first.filter("ok").select("a", "b"))
    known = buckets.join(comp, buckets["h"] == comp["node"], "left").withColumn("comp", F.coalesce("component", "h"))
    more = pairs(_meetings(kept_table(known.select(*buckets.columns, "comp"), "known")), _across).join(first, ["a", "b"], "left_anti")
    return first.unionByName(_verified(cut(more), classes, texts)).filter("ok").select("a", "b")


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), n - 1)


def _parts(buckets: DataFrame) -> DataFrame:
    """Buckets dealt to groups: a class is in one part of its bucket, a pivot in all."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("rows")).withColumn("m", F.col("rows"))
    n = F.ceil(F.col("m") / PART)
    pivot = (n > 1) & (F.pmod(F.xxhash64("h", F.lit(1)), F.col("m")) < PIVOTS)
    at = F.explode(F.when(pivot, _upto(n)).otherwise(F.array(F.pmod(F.xxhash64("h"), n))))
    dealt = spread_join(buckets, sizes, ["key"], "rows").withColumn("part", at)
    return dealt.withColumns({"key": F.xxhash64("key", "part"), "comp": F.col("h"), "side": F.lit(0)})


def _meetings(known: DataFrame) -> DataFrame:
    """Groups of the buckets that hold several components: each part of a bucket (side 0) with each
    part of its classes outside the largest component (side 1)."""
    by_comp = known.groupBy("key", "comp").agg(F.count("*").alias("c"))
    sizes = by_comp.groupBy("key").agg(F.sum("c").alias("rows"), F.max(F.struct("c", "comp")).alias("top")).filter("top.c < rows")
    sizes = sizes.select("key", "rows", F.ceil(F.col("rows") / PART).alias("n_all"), F.ceil((F.col("rows") - F.col("top.c")) / PART).alias("n_out"), F.col("top.comp").alias("main"))
    i, j = F.pmod(F.xxhash64("h"), F.col("n_all")), F.pmod(F.xxhash64("h", F.lit(1)), F.col("n_out"))
    left = F.transform(_upto(F.col("n_out")), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(0).alias("side")))
    right = F.transform(_upto(F.col("n_all")), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(1).alias("side")))
    seats = F.explode(F.when(F.col("comp") == F.col("main"), left).otherwise(F.concat(left, right)))
    dealt = spread_join(known, sizes, ["key"], "rows").withColumn("seat", seats)
    return dealt.withColumns({"key": F.xxhash64("key", "seat.i", "seat.j"), "side": F.col("seat.side")})


def keep_one(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near copies, groups being the components of all pairs at 0.8 or more.

    The survivor has the smallest doc_id, a null one last, and of these the smallest text hash.
    Blank and null texts are one group. Columns as given.
    """
    width, count = blocks(docs.count())
    texts = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    sketch = rows.mapInArrow(lambda batches: _sketches(batches, width, count), "doc_id long, text_hash long, h long, n long, bits binary, blocks binary")
    rows = kept_table(sketch, "sketches")
    classes = kept_table(rows.select("h", "text_hash", "n", "bits", "blocks").dropDuplicates(["h"]), "classes")
    comp = components(links(classes, texts, width, count, radius=radius))
    return one_per_group(docs, rows.select("doc_id", "text_hash", "h"), comp)
