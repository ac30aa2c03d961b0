"""SimHash near-duplicates with BK-trees.

Every text gets a 64-bit fingerprint; equal fingerprints are one class, so copies never meet as
rows. Two fingerprints at distance ``radius`` or less agree on at least one of radius + 1 bit
blocks, so each class goes to one shard per block, keyed by the block's value. A shard's
fingerprints form a BK-tree whose children are keyed by their Hamming distance to the parent; a
search follows only the edges within the radius. A shard of more than ``SHARD_MAX`` classes is
split further by blocks of the bits that its key leaves open, and so on: after four levels at most
13 bits are open, hence a tree has at most 2**13 nodes whatever the input. Shard trees are built
where their fingerprints are (they would grow with the corpus, so they are not broadcast), and
each hands on a spanning forest of its links, never all pairs. Components of the links follow by
distributed contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import cut, one_per_group, spread_join
from factorspark.llm.components import components

BITS, SEED, SHINGLE, RADIUS = 64, 42, 3, 2
SHARD_MAX = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is 1 if more than half of the shingles' XXH64 (seed 42) have it; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    line, n = b" ".join(w), len(w) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed long. Null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children of a node are keyed by their integer Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the nodes within ``radius`` of ``value``."""
        found, stack = [], [0] if self.values else []
        while stack:
            i = stack.pop()
            d = (self.values[i] ^ value).bit_count()
            if d <= radius:
                found.append(i)
            kids = self.children[i]
            for r in range(max(1, d - radius), d + radius + 1):
                if (k := kids.get(r)) is not None:
                    stack.append(k)
        return found

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new, i = len(self.values) - 1, 0
        while new:
            d = (self.values[i] ^ value).bit_count()
            if d not in self.children[i]:
                self.children[i][d] = new
                break
            i = self.children[i][d]
        return new


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct ``values`` within ``radius``, by a BK-tree."""
    tree, parent, links = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for v in values:
        near = tree.within(v, radius)
        i = tree.add(v)
        parent.append(i)
        for j in near:
            if (r := root(j)) != (s := root(i)):
                parent[r] = s
                links.append((v, tree.values[j]))
    return links


def _blocks(open_bits: list[int], parts: int) -> list[list[int]]:
    """``open_bits`` dealt into ``parts`` runs of nearly equal length."""
    q, r = divmod(len(open_bits), parts)
    out, at = [], 0
    for k in range(parts):
        out.append(open_bits[at : at + q + (k < r)])
        at += q + (k < r)
    return out


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _spread(shards: DataFrame, radius: int) -> DataFrame:
    """Each (fp, mask) goes on with radius + 1 masks, every one fixing one more block of open bits."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for b in batches:
            fp, mask = np.asarray(b.column(0)), np.asarray(b.column(1))
            for m in np.unique(mask).tolist():
                if m not in known:
                    open_bits = [k for k in range(BITS) if not (m >> k) & 1]
                    known[m] = [m | _mask(part) for part in _blocks(open_bits, radius + 1)]
                own = fp[mask == m]
                for more in known[m]:
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), more, np.int64))], names=["fp", "mask"])

    return shards.select("fp", "mask").mapInArrow(refine, "fp long, mask long").withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))


def _shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """Spanning forests of the shards, (a, b); rows of a shard come together and sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, values = None, []

        def flush() -> pd.DataFrame | None:
            links = forest(values, radius) if len(values) > 1 else []
            return pd.DataFrame(np.array(links, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"]) if links else None

        for pdf in batches:
            for m, bits, fp in zip(pdf["mask"].tolist(), pdf["bits"].tolist(), pdf["fp"].to_numpy().view(np.uint64).tolist(), strict=True):
                if (m, bits) != key:
                    if (out := flush()) is not None:
                        yield out
                    key, values = (m, bits), []
                values.append(fp)
        if (out := flush()) is not None:
            yield out

    dealt = shards.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")
    return dealt.select("mask", "bits", "fp").mapInPandas(run, "a long, b long")


def links(classes: DataFrame, *, radius: int = RADIUS, shard_max: int = SHARD_MAX) -> DataFrame:
    """(a, b): forest links of distinct fingerprints ``fp`` at ``radius`` or fewer differing bits."""
    out, todo = None, classes.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(4):
        spread = cut(_spread(todo, radius))
        counts = spread.groupBy("mask", "bits").agg(F.count("*").alias("n"))
        last = level == 3
        small = counts.filter(F.col("n") > 1) if last else counts.filter((F.col("n") > 1) & (F.col("n") <= shard_max))
        found = _shard_links(spread.join(small.select("mask", "bits"), ["mask", "bits"]), radius)
        out = found if out is None else out.unionByName(found)
        if last:
            break
        large = cut(counts.filter(F.col("n") > shard_max).select("mask", "bits"))
        if large.isEmpty():
            break
        todo = spread.join(large, ["mask", "bits"], "left_semi").select("fp", "mask")
    return out


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``; component_id is the smallest doc_id
    that links reach from it, itself included.

    Defined cases: null, empty and blank texts have fingerprint 0 and link like any other; a null
    doc_id gets its component's smallest id, null if it has none; repeated rows: a result each;
    other columns are ignored; an empty table gives an empty result.
    """
    fps = cut(fingerprints(docs))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    comp = components(links(classes, radius=radius))
    named = classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("c"))
    lowest = named.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    by_class = spread_join(named.select("fp", "n", "c"), lowest, ["c"], "members").select("fp", "n", "component_id")
    return spread_join(fps, by_class, ["fp"], "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id, nulls last.

    A row is named by its doc_id and text together; rows that repeat both stay only once. Columns
    as given.
    """
    hashed = docs.select(F.xxhash64("text").alias("doc_id"), F.col("text"))
    comp = near_duplicates(hashed, radius=radius).select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.xxhash64("text").alias("h"))
    return one_per_group(docs, rows, comp)
