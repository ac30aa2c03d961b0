"""Sharding by jump consistent hashing (DataFrame functions only).

``jump_hash`` is the published generator (a 64-bit linear congruence whose upper 31 bits give
the next jump), written with 16/32-bit limbs because a 64-bit product overflows under ANSI
rules. No ring table exists: the shard follows from the key and the shard count alone, and one
more shard takes about 1/(n+1) of the rows, all of them into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import nameless, spread_join

#: The multiplier of the published generator, as 32-bit limbs.
MULTIPLIER = 2862933555777941757
C_HI, C_LO = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
C_LO_HI, C_LO_LO = C_LO >> 16, C_LO & 0xFFFF
M32 = 0xFFFFFFFF
#: Slots are numbered within sub-buckets of a shard, so no task sorts a whole shard; there are about so many in all.
BUCKETS = 98_304
#: Jumps made at a time; a row that has not landed by then makes as many again, and so on.
ROUNDS = 8


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2**64; no intermediate passes 2**63."""
    mask = F.lit(M32)
    cross = lo * F.lit(C_LO_HI)
    low = F.shiftleft(cross.bitwiseAND(F.lit(0xFFFF)), 16) + lo * F.lit(C_LO_LO) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(cross, 16)
    hi_cl = (hi * F.lit(C_LO_LO) + F.shiftleft((hi * F.lit(C_LO_HI)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)
    ch_lo, ch_hi = C_HI & 0xFFFF, C_HI >> 16
    lo_ch = (lo * F.lit(ch_lo) + F.shiftleft((lo * F.lit(ch_hi)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)
    return (carry + hi_cl + lo_ch).bitwiseAND(mask), low.bitwiseAND(mask)


def jump_hash(key: Column, n: int) -> Column:
    """Struct (shard, grown): the key's shard among ``n`` and among ``n + 1``.

    About ln(n) jumps land; a row that has not landed after ``ROUNDS`` goes on for as many more,
    then twice and four times as many. Jumps are strictly increasing, so n + 2 always suffice and
    no row is left over. A null key counts as 0.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(M32)).alias("lo"),
        F.lit(0).cast("long").alias("j"), F.lit(-1).cast("long").alias("b"), F.lit(-1).cast("long").alias("g"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        landed = s["j"]
        b = F.when(landed < n, landed).otherwise(s["b"])
        g = F.when(landed < n + 1, landed).otherwise(s["g"])
        draw = F.shiftright(hi, 1)  # the generator's upper 31 bits
        jump = F.floor((landed + 1).cast("double") * (F.lit(float(1 << 31)) / (draw + 1).cast("double"))).cast("long")
        # once past n + 1 nothing changes any more; staying there keeps the numbers small
        return F.struct(
            hi.alias("hi"), lo.alias("lo"), F.when(landed > n, landed).otherwise(jump).alias("j"), b.alias("b"), g.alias("g")
        )

    def go_on(state: Column, rounds: int, left: int) -> Column:
        """``state`` after ``rounds`` jumps, the rows still under way going on; each state is computed once."""
        done = F.aggregate(F.sequence(F.lit(1), F.lit(min(rounds, left))), state, step)
        if left <= rounds:
            return done
        more = 2 * rounds if left < n + 2 else rounds
        one = F.transform(F.array(done), lambda s: F.when(s["j"] > n, s).otherwise(go_on(s, more, left - rounds)))
        return F.element_at(one, 1)

    end = F.transform(F.array(go_on(start, ROUNDS, n + 2)), lambda s: F.struct(s["b"].cast("int").alias("shard"), s["g"].cast("int").alias("grown")))
    return F.element_at(end, 1)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard(df: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with columns size, text_crc32, law, shard, slot and grown_shard added.

    Law: ``key``. The shard depends on the key and ``n_shards`` only; equal texts under different
    keys may part. Slots number each shard's rows from 0 without a gap: rows fall into
    sub-buckets by the generator's first number and the CRC, are numbered inside (by key, then CRC), and shifted by
    the counts of the sub-buckets before, a table of about ``BUCKETS`` rows (or ``n_shards``, if
    more; beyond 100,000 it is joined by a shuffle). So a task sorts sub-buckets, never a shard,
    and rows under one key part by their texts.

    Defined cases: null key: shard of key 0. Null text: size 8, CRC 0. Repeated rows: a slot each.
    Input columns with one of the six names are replaced; others pass through. Empty: empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    own, columns, to = nameless(df.select(*(F.col(f"`{c}`") for c in df.columns if c not in added or c in (key, text))))
    rest = [(to[c], c) for c in columns if c not in added]
    k, t = F.col(to[key]), F.col(to[text])
    subs = max(1, BUCKETS // n_shards)

    def placed(x: DataFrame) -> DataFrame:
        whole = F.coalesce(k.cast("long"), F.lit(0).cast("long"))
        hi, _ = _next(F.shiftrightunsigned(whole, 32), whole.bitwiseAND(F.lit(M32)))
        sub = (hi + F.col("text_crc32")) % F.lit(subs)
        x = x.withColumn("text_crc32", F.coalesce(F.crc32(t), F.lit(0)).cast("long"))
        return x.withColumn("_j", jump_hash(k, n_shards)).select(*x.columns, sub.alias("sub"), F.col("_j.shard").alias("shard"), F.col("_j.grown").alias("grown_shard"))

    rows = placed(own).withColumn("size", text_size(t))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed(own.select(k, t) if key != text else own.select(k)).groupBy("shard", "sub").agg(F.count("*").alias("n"))
        .withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "sub", "off", "n")
    )
    inside = Window.partitionBy("shard", "sub").orderBy(k, "text_crc32", "size")
    out = spread_join(rows, offsets, ["shard", "sub"], "n").withColumn("rn", F.row_number().over(inside))
    return out.select(
        *(F.col(x).alias(c) for x, c in rest), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("rn") - 1 + F.col("off")).cast("long").alias("slot"), "grown_shard",
    )
