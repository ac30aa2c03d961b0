"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

A document is contaminated if ``WINDOW`` tokens in a row match an item's in at least ``LEAST`` of
the places (an item of ``SHORTEST`` to ``WINDOW`` tokens counts as one window; a shorter one must
appear whole, and its seed is a mask that reads all of it). Three fixed masks read five of up to eight tokens and ignore the
others: they were chosen so that every window with as many substitutions as that allows, wherever
they fall, still shows one mask's five tokens unharmed (``tests/llm`` goes through all of them), so
nothing is lost. Masked hashes of the documents meet those of the benchmark, and around each hit
the windows that contain it are compared token by token.

The benchmark's seeds are broadcast while they number at most ``BROADCAST_ROWS``; beyond that
they are joined by a shuffle on the hash. Seeds with equal surroundings are one row, so a preamble
that thousands of items share costs no more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import cut, nameless

#: Fixed masks: 1 reads a token, 0 ignores it.
MASKS = ("11111", "111011", "11010011")
WINDOW, SHORTEST, LEAST, BROADCAST_ROWS = 12, 8, 0.8, 100_000
#: Blocks of scripts that write no blanks between words: Thai, Lao, Myanmar, Khmer, kana, Han. All lie beyond PLAIN.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}]"
PLAIN = r"[^\x00-\u0DFF]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; one empty string may stand at either end.

    In scripts that write no blanks between words every character is a token. A plain split stays inside generated code, which a lambda would end; an empty string equals no
    token of an item.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    apart = F.when(low.rlike(PLAIN), F.regexp_replace(low, UNSPACED, " $0 ")).otherwise(low)
    return F.split(apart, r"[^\p{L}\p{N}]+")


def _masked(toks: Column, at: Column, masks: tuple[str, ...]) -> list[Column]:
    out = []
    for k, mask in enumerate(masks):
        read = [F.get(toks, at + o) for o, bit in enumerate(mask) if bit == "1"]
        out.append(F.struct(F.xxhash64(F.lit(k), *read).alias("h"), F.lit(k).alias("m")))
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, t) of the items with a token."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.filter(tokens(F.col("text")), lambda t: t != "").alias("t")).filter(F.size("t") > 0)


def _masks(items: DataFrame) -> tuple[str, ...]:
    """The fixed masks, and a full one for each size under ``SHORTEST`` that an item has."""
    short = sorted(r[0] for r in items.select(F.size("t").alias("n")).filter(F.col("n") < SHORTEST).distinct().collect())
    return (*MASKS, *("1" * n for n in short))


def seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(h, ctx, off, ln, item_id): masked hashes with the tokens around them.

    ``ctx`` holds every token that a window around the seed can reach, ``off`` is the seed's place in
    it, ``ln`` the window's length; equal rows keep the smallest item_id.
    """
    at = items.select("item_id", "t", F.least(F.size("t"), F.lit(WINDOW)).alias("ln"), F.posexplode("t").alias("b", "_"))
    hit = at.select("item_id", "t", "ln", "b", F.explode(F.array(*_masked(F.col("t"), F.col("b"), masks))).alias("s"))
    span = F.element_at(F.array(*(F.lit(len(m)) for m in masks)), F.col("s.m") + 1)
    # an item under SHORTEST has its own full mask and no other, which no longer item uses
    own = F.when(F.size("t") < SHORTEST, (F.col("s.m") >= len(MASKS)) & (span == F.size("t"))).otherwise(F.col("s.m") < len(MASKS))
    hit = hit.withColumn("span", span).filter(own & (F.col("b") + F.col("span") <= F.size("t")))
    low = F.greatest(F.lit(0), F.col("b") + F.col("span") - F.col("ln"))
    high = F.least(F.size("t"), F.col("b") + F.col("ln"))
    ctx = F.slice("t", low + 1, high - low)
    rows = hit.select(F.col("s.h").alias("h"), ctx.alias("ctx"), (F.col("b") - low).alias("off"), "ln", "item_id")
    return rows.groupBy("h", "ctx", "off", "ln").agg(F.min("item_id").alias("item_id"))


def _near(hits: DataFrame) -> DataFrame:
    """Keeps of a hit's document only the tokens that face ``ctx``; ``shift`` of those have none."""
    begin = F.col("i") - F.col("off")
    near = F.slice("t", F.greatest(begin, F.lit(0)) + 1, F.size("ctx"))
    return hits.select("doc_id", "text_hash", "item_id", "ln", "ctx", near.alias("near"), F.greatest(-begin, F.lit(0)).alias("shift"))


def _best() -> Column:
    """Most matching tokens of a window of ``ctx`` against ``near``."""
    same = F.transform("ctx", lambda x, k: F.coalesce((F.get(F.col("near"), k - F.col("shift")) == x).cast("int"), F.lit(0)))
    starts = F.sequence(F.lit(1), F.size("ctx") - F.col("ln") + 1)
    return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(same, s, F.col("ln")), F.lit(0), lambda a, x: a + x)))


def overlaps(docs: DataFrame, benchmark: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, item_id, best) of each contaminated text.

    ``best`` is the largest share of matching tokens over all windows, ``item_id`` the smallest item
    that overlaps. Defined cases: null texts match nothing, nor do items without a token; a null doc_id is reported as
    null; equal rows are reported once; other columns are ignored; empty tables give nothing.
    """
    items = cut(_items(benchmark))
    masks = _masks(items)
    table = cut(seeds(items, masks))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), tokens(F.col("text")).alias("t"))
    # outer: else a filter on the array's size is inferred, which splits every text twice
    at = known.select("doc_id", "text_hash", "t", F.posexplode_outer("t").alias("i", "_"))
    probe = at.select("doc_id", "text_hash", "t", "i", F.explode(F.array(*(m["h"] for m in _masked(F.col("t"), F.col("i"), masks)))).alias("h"))
    if table.count() <= broadcast_rows:
        hits = probe.join(F.broadcast(table), "h")
    else:
        met = probe.select("doc_id", "text_hash", "i", "h").join(table, "h").select("doc_id", "text_hash", "i", "ctx", "off", "ln", "item_id")
        k = known.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "t").dropDuplicates(["_d", "_h"])
        hits = met.join(k, met["doc_id"].eqNullSafe(k["_d"]) & (met["text_hash"] == k["_h"])).drop("_d", "_h")
    # exploded, so that the comparison isn't pushed into the join, which would leave generated code
    found = _near(hits).select("doc_id", "text_hash", "item_id", "ln", F.explode(F.array(_best())).alias("n"))
    found = found.filter(F.col("n") >= F.when(F.col("ln") < SHORTEST, F.col("ln")).otherwise(F.ceil(F.col("ln") * F.lit(LEAST))))
    return found.groupBy("doc_id", "text_hash").agg(F.min("item_id").alias("item_id"), F.max(F.col("n") / F.col("ln")).alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows; columns as given."""
    own, columns, to = nameless(docs)
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    same = own[to["doc_id"]].cast("long").eqNullSafe(bad["_d"]) & (F.xxhash64(own[to["text"]]) == bad["_h"])
    return own.join(bad, same, "left_anti").toDF(*columns)
