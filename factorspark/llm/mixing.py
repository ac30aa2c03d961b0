"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

A source's target gives each of its documents the same number of copies on average. The whole
part is taken at once; the fractional parts are rounded by fights between two documents: mass (in
words) moves from one to the other until one of the two copy numbers is whole, the direction drawn
so that every document keeps its expected number of copies. Words are conserved in every fight, so
a source ends within one document of its target. Documents fight inside blocks of about
``BLOCK`` rows dealt by hash, each block leaves at most one undecided document, and these meet in
the next level of a reduction tree until one is left per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import cut, n_words, nameless, spread_join

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST, BLOCK, SEED = 1.5, 2.0, 128, 20240607
_SCALE = float(1 << 53)


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, n_units) of a table of (source, size) rows.

    Sources in code-point order (null last) take ``weights`` in turn and share ``share`` of all
    sizes; a target stops at ``most`` times its source's size and the excess goes to the others by
    weight, again and again until none is above. Each round is one aggregate over the catalogue of
    sources; the driver gets its single row. A source without words has target 0.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_units"))
    # places by a range shuffle: numbered inside each part and shifted by the parts before
    total = cut(total.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = total.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    total, place = total.withColumn("inside", inside).join(F.broadcast(before), "part"), F.col("before") + F.col("inside") - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    cat = cut(total.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(most))))
    level, full = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("w") * F.lit(level) > F.col("most")
        row = cat.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("most")).otherwise(0.0)).alias("used"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("w"))).alias("left"), F.sum(capped.cast("int")).alias("full"),
        ).first()
        if not row["all"] or row["full"] == full:
            break
        full = row["full"]
        if not row["left"]:
            break
        level = (share * row["all"] - row["used"]) / row["left"]
    target = F.least(F.col("w") * F.lit(level if level is not None else 0.0), F.col("most"))
    return cat.select("source", "source_size", target.alias("target"), "n_units")


def _fight(rows: Column, seed: int) -> Column:
    """Folds an array of (id, s, p) into (id, s, p of the undecided; out: the decided with p 0 or 1).

    Rows come largest first, so what stays undecided to the end is small.
    """
    key_type = "struct<d:bigint,h:bigint>"
    out_type = f"array<struct<id:{key_type},s:double,p:double>>"
    none = F.struct(F.lit(None).cast(key_type).alias("id"), F.lit(0.0).alias("s"), F.lit(0.0).alias("p"))
    start = F.struct(none.alias("c"), F.array().cast(out_type).alias("out"))

    def entry(i: Column, s: Column, p: Column) -> Column:
        return F.struct(i.alias("id"), s.alias("s"), p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        c = state["c"]
        # the most words that can move from c to x (down), and from x to c (up)
        down = F.least(c["s"] * c["p"], x["s"] * (1 - x["p"]))
        up = F.least(c["s"] * (1 - c["p"]), x["s"] * x["p"])
        draw = F.shiftrightunsigned(F.xxhash64(c["id"], x["id"], F.lit(seed)), 11).cast("double") / F.lit(_SCALE)
        fall = draw * (down + up) < up  # expectation of both is kept
        move = F.when(fall, -down).otherwise(up)
        cp, xp = c["p"] + move / c["s"], x["p"] - move / x["s"]
        c_done = F.when(fall, c["s"] * c["p"] <= x["s"] * (1 - x["p"])).otherwise(c["s"] * (1 - c["p"]) <= x["s"] * x["p"])
        decided = F.when(c_done, entry(c["id"], c["s"], F.when(fall, 0.0).otherwise(1.0))).otherwise(
            entry(x["id"], x["s"], F.when(fall, 1.0).otherwise(0.0))
        )
        kept = F.when(c_done, entry(x["id"], x["s"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), xp)))).otherwise(
            entry(c["id"], c["s"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), cp)))
        )
        open_ = c["id"].isNotNull() & (c["p"] > 0) & (c["p"] < 1)
        settled = c["id"].isNotNull() & ~open_
        return F.struct(
            F.when(open_, kept).otherwise(entry(x["id"], x["s"], x["p"])).alias("c"),
            F.when(open_, F.concat(state["out"], F.array(decided)))
            .when(settled, F.concat(state["out"], F.array(c))).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(rows, start, step)


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per distinct (doc_id, source, text) with its number of copies.

    Columns: doc_id, source, text_hash, size, n_rows, source_size, target, copies (for each of its
    n_rows equal rows). Draws hash ids, so reruns agree. Defined cases: null text has size 0 and no
    copies; null doc_id and null source are values of their own; equal rows share one decision;
    an empty table gives an empty result.
    """
    unit = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")
    )
    units = cut(unit.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("n_rows")))
    targets = source_targets(units.select("source", (F.col("size") * F.col("n_rows")).alias("size")), weights=weights, share=share, most=most)
    # the ratio is at most ``most``; a target at its cap has exactly that many copies of everything
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = [F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("key")]
    keyed = targets.select(*key, "source_size", "target", "n_units", F.col("n_units").alias("n"))
    rows = spread_join(units.select("*", *key), keyed, ["none", "key"], "n").drop("none", "key").withColumn("ratio", ratio)
    rows = rows.withColumn("whole", F.floor("ratio").cast("long")).withColumn("p", F.col("ratio") - F.floor("ratio"))
    rows = rows.withColumn("id", F.struct(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")))
    rows = cut(rows.drop("ratio"))
    fighting = rows.filter((F.col("size") > 0) & (F.col("p") > 0)).select(
        "source", "id", (F.col("size") * F.col("n_rows")).cast("double").alias("s"), "p", F.col("n_units").alias("n")
    )
    level, done = 0, None
    while True:
        blocks = F.ceil(F.col("n") / F.lit(float(block))).cast("long")
        dealt = fighting.withColumn("_b", F.pmod(F.xxhash64("id", F.lit(seed + level)), blocks)).withColumn("_n", blocks)
        folded = cut(
            dealt.groupBy("source", "_b", "_n")
            .agg(F.sort_array(F.collect_list(F.struct("s", "id", "p")), asc=False).alias("rows"))
            .withColumn("rows", F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["s"].alias("s"), r["p"].alias("p"))))
            .select("source", "_n", _fight(F.col("rows"), seed + level).alias("f"))
        )
        won = folded.select("source", F.explode("f.out").alias("o")).select("source", F.col("o.id").alias("id"), F.col("o.p").alias("win"))
        done = won if done is None else done.unionByName(won)
        left = folded.select("source", F.col("f.c.id").alias("id"), F.col("f.c.s").alias("s"), F.col("f.c.p").alias("p"), F.col("_n").alias("n"))
        top = left.agg(F.max("n")).first()[0]
        if top is None or top <= 1:
            break
        fighting, level = left, level + 1
    # the last of each source: drawn with its own probability
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed - 1)), 11).cast("double") / F.lit(_SCALE)
    last = left.select("source", "id", F.when((F.col("p") > 0) & (draw < F.col("p")), 1.0).otherwise(0.0).alias("win"))
    done = done.unionByName(last)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round(F.coalesce(F.col("win"), F.lit(0.0))).cast("long")).otherwise(0)
    done = done.select(F.col("source").alias("_s"), F.col("id.d").alias("_d"), F.col("id.h").alias("_h"), "win")
    same = rows["doc_id"].eqNullSafe(done["_d"]) & (rows["text_hash"] == done["_h"]) & rows["source"].eqNullSafe(done["_s"])
    return rows.join(done, same, "left").select("doc_id", "source", "text_hash", "size", "n_rows", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; only its own columns."""
    own, columns, to = nameless(docs)
    plan = mix(docs, **how).filter("copies > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("text_hash").alias("_h"), "copies")
    d = own.withColumn("_th", F.xxhash64(to["text"]))
    same = d[to["doc_id"]].cast("long").eqNullSafe(plan["_d"]) & (d["_th"] == plan["_h"]) & d[to["source"]].cast("string").eqNullSafe(plan["_s"])
    return d.join(plan, same).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*own.columns).toDF(*columns)
