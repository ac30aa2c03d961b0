"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.lineage import cut, kept_table, shared_folder

__all__ = ["ascii_lower", "cut", "held_out", "kept_table", "n_words", "nameless", "one_per_group", "shared_folder", "spread_join", "table", "words"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: A table of so many rows may be broadcast.
SMALL = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of ``text`` as an array; empty for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words ``text`` has; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def nameless(df: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``df`` with its columns called ``c0_``, ``c1_``, ... so that none clashes with ours; the names it had, and old to new."""
    new = [f"c{k}_" for k in range(len(df.columns))]
    return df.toDF(*new), list(df.columns), dict(zip(df.columns, new, strict=True))


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, *, small: int = SMALL) -> DataFrame:
    """``rows`` joined with ``facts``, one row for each key, ``n`` of which says how many rows have it.

    At most ``small`` facts are broadcast as they are. Of more, the keys with over 1 / ``small`` of
    all rows (there can't be more than ``small``) are broadcast, so their rows stay where they are;
    the others are joined by a shuffle in which no key is hot. Keys are not null; ``n`` is dropped.
    """
    facts = cut(facts)
    size = facts.agg(F.count("*").alias("k"), F.sum(n).alias("n")).first()
    if size["k"] <= small:
        return rows.join(F.broadcast(facts.drop(n)), keys)
    hot = facts.filter(F.col(n) > max(1, size["n"] // small))
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti").drop(n), keys)
    return rows.join(F.broadcast(hot.drop(n)), keys).unionByName(cold)


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def one_per_group(docs: DataFrame, rows: DataFrame, comp: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group: smallest doc_id, nulls last, then smallest text hash.

    ``rows`` has (doc_id, text_hash, h) of every row, ``comp`` (node, component) of the h that are
    linked. A row is named by its doc_id and text together; rows that repeat both stay only once.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("t"))).alias("m")
    by_class = rows.groupBy("h").agg(least)
    named = by_class.join(comp, by_class["h"] == comp["node"], "left").groupBy(F.coalesce("component", "h")).agg(F.min("m").alias("m"))
    kept = named.select(F.coalesce("m.id", F.lit(0)).alias("_id"), F.col("m.none").alias("_none"), F.col("m.t").alias("_text_hash"))
    own, columns, to = nameless(docs)
    doc_id, text = F.col(to["doc_id"]), F.col(to["text"])
    keyed = own.withColumns({"_id": F.coalesce(doc_id.cast("long"), F.lit(0)), "_none": doc_id.isNull(), "_text_hash": F.xxhash64(text)})
    names = ["_id", "_none", "_text_hash"]
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).select(*own.columns).toDF(*columns)
