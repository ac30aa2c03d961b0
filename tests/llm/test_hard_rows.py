"""Clashing column names, hubs, letters of large scripts, grammar and generator against slow versions."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.llm import common, components, decontaminate, langid, mixing, neardup, sharding, simhash, substrings, toxicity
from test_operators import docs, jump, words

CLASH = ["score", "lang_pred", "grams", "_th", "_k", "_off", "_rn", "_id", "_none", "_text_hash", "c0_", "c1_", "n", "h", "m", "copies", "sub", "off", "size", "slot"]


@pytest.mark.parametrize("stage", [langid.keep_identified, simhash.keep_one, neardup.keep_one, mixing.mixed_rows, lambda d: sharding.shard(d, 3),
                                   lambda d: decontaminate.clean(d, d.limit(0).select(F.col("doc_id").alias("item_id"), "text"))])
def test_columns_of_any_name_pass_through(spark, stage):
    rows = docs(spark, [(k, "the house and the river " + words(k, 30), "en", "ab"[k % 2]) for k in range(8)])
    for c in CLASH:
        rows = rows.withColumn(c, F.col("doc_id") * 2)
    out = stage(rows)
    kept = [c for c in rows.columns if c not in ("size", "slot", "shard")]
    assert [c for c in out.columns if c in kept] == kept
    got = out.select("doc_id", *[c for c in CLASH if c in kept]).collect()
    assert got and all(v == r["doc_id"] * 2 for r in got for v in r[1:])
    assert stage(rows.limit(0)).count() == 0


def test_hub(spark):
    """A star and a chain whose hub is met by broadcast, not in one task."""
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(5000, 5050).select("id", F.col("id") + 1))
    got = {tuple(r) for r in components.components(star, small=4).groupBy("component").count().collect()}
    assert got == {(0, 3000), (5000, 51)}


def test_spread_join(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), (F.max("id") + 1).alias("f"))
    for small in (10, 100_000):
        out = common.spread_join(rows, facts, ["k"], "n", small=small)
        assert out.columns == ["k", "id", "f"] and out.count() == 2000 and out.filter("k = 0 and f = 900").count() == 900


def test_letters_of_large_scripts():
    a, b = (langid._draw(np.array([c]))[0].astype(int) for c in (0x4E00, 0x4E00 + 508))
    assert abs(a @ b) < 200 and langid.profile("一二") @ langid.profile("一二") == pytest.approx(1)
    many = "".join(chr(0x4E00 + k) for k in range(6000)) * 2  # more letters than are kept
    assert langid.profile(many) @ langid.profile(many) == pytest.approx(1, abs=1e-5)


def test_profile_matches_slow_version():
    text = "Ähre 12 the  The-thé"
    clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    total = np.zeros(langid.DIM)
    for i in range(len(clean) - 2):
        v = np.ones(langid.DIM)
        for k, c in enumerate(clean[i : i + 3]):
            v = v * np.roll(langid._draw(np.array([0 if c == " " else ord(c)]))[0], k)
        total += v
    assert np.allclose(langid.profile(text), total / np.linalg.norm(total), atol=1e-5)


def test_gibberish_and_unlearned_scripts_go(spark):
    r, seeds = random.Random(5), {"en": "the house and the river with many old trees by the long road", "de": "das große Haus und der Fluss mit vielen alten Bäumen an der Straße"}
    rows = [(k, f"{t} {t[k % 7 :]}", lang, "a") for k, (lang, t) in enumerate(itertools.islice(itertools.cycle(seeds.items()), 60))]
    rows += [(100 + k, "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(200)), None, "") for k in range(10)]
    rows += [(200 + k, " ".join("".join(chr(r.randrange(0x430, 0x450)) for _ in range(6)) for _ in range(40)), None, "") for k in range(10)]
    kept = {x["doc_id"] for x in langid.keep_identified(docs(spark, rows)).collect()}
    assert kept == set(range(60))


def slow_clause(toks, g):
    """The grammar read off its description: what is negated, whether a target and a report stand anywhere."""
    negated, insults, threats = False, 0.0, 0.0
    for t in toks:
        if t in toxicity.NEGATION:
            negated = True
        elif t in toxicity.CONTRAST and t not in toxicity.TARGET and t not in toxicity.REPORTED:
            negated = False
        elif t in toxicity.THREAT and t not in toxicity.TARGET | toxicity.REPORTED | toxicity.CONTRAST:
            threats += toxicity.THREAT_WEIGHT * (toxicity.NEGATED if negated else 1)
        elif t not in toxicity.TARGET | toxicity.REPORTED:
            insults += g.insult(t) * (toxicity.NEGATED if negated else 1)
    target, report = any(t in toxicity.TARGET - toxicity.NEGATION for t in toks), any(t in toxicity.REPORTED - toxicity.TARGET - toxicity.NEGATION for t in toks)
    return (insults * (toxicity.RAISED if target else 1) + (threats if target else 0)) * (toxicity.QUOTED if report else 1)


def test_automaton_matches_slow_grammar():
    g, r = toxicity.Grammar({"idiot": 3.0, "scum": 2.5}, {"mor": 1.0, "moro": 2.0}), random.Random(1)
    some = ["idiot", "scum", "morons", "you", "they", "not", "never", "but", "said", "kill", "hurt", "the", "box", "tree", "was"]
    for _ in range(500):
        toks = r.choices(some, k=r.randrange(1, 9))
        assert g.clause(toks) == pytest.approx(slow_clause(toks, g)), toks
    assert len(toxicity.FINAL) == 8


def test_grammar_orders_clauses():
    g = toxicity.Grammar({"idiot": 3.0}, {})
    assert g.raw("kill you") > g.raw("you idiot") > g.raw("the idiot box was repaired") > g.raw("not one of you is an idiot") > g.raw("The box was repaired. You said so") == 0
    assert g.raw("You idiot, he said") < g.raw("you idiot") and g.raw("not you but the idiot") > g.raw("not you the idiot")
    long = "the box " * 200_000 + "you idiot"
    assert g.raw(long) == g.raw("you idiot")


def test_held_out_recall(spark):
    """On the labelled documents of sf0.1, the fold that is never learned from."""
    duckdb = pytest.importorskip("duckdb")
    import zlib
    from pathlib import Path

    at = Path("/root/testdata/sf0.1")
    if not at.exists():
        pytest.skip("no test data")
    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{at}/documents.parquet' JOIN '{at}/labels.parquet' USING (doc_id)").fetchall()
    d, lab = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    g = toxicity.learn(d, lab)
    test = [(g.score(t) >= toxicity.THRESHOLD, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    toxic = [p for p, y in test if y]
    clean = [p for p, y in test if not y]
    assert sum(toxic) / len(toxic) >= 0.9 and sum(clean) / len(clean) <= 0.02


@pytest.mark.parametrize("n", [1, 2, 24, 700])
def test_jumps_of_any_shard_count(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [random.Random(3).randrange(2**63) for _ in range(300)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n).alias("j")).collect()
    assert all((x["j"]["shard"], x["j"]["grown"]) == (jump(x["k"], n), jump(x["k"], n + 1)) for x in got)


def test_radix_groups():
    r = np.random.default_rng(0)
    data = np.frombuffer(("ab" * 300 + "".join(r.choice(list("ab"), 400)) + "ab" * 100).encode(), np.uint8)
    start = np.arange(len(data) - 19)
    group = start % 2
    which, number = substrings.radix_groups(data, start, group, width=20)
    want = {}
    for s, x in zip(start.tolist(), group.tolist()):
        want.setdefault((x, bytes(data[s : s + 20])), set()).add(s)
    got = {}
    for w, x in zip(which.tolist(), number.tolist()):
        got.setdefault(x, set()).add(w)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_substrings_of_many_rows_without_an_id(spark):
    """400 rows under no id: each text keeps what its own twin rows share, and hands nothing to another."""
    texts = [words(k, 40) for k in range(400)]
    got = substrings.removed_spans(docs(spark, [(None, t, "", "") for t in texts] + [(1, texts[0], "", "")])).collect()
    assert sorted(r["n_removed"] for r in got) == [0] * 400 + [len(texts[0].encode())]
    assert {r["n_removed"] for r in got if r["doc_id"] == 1} == {0}


def test_short_items_and_unspaced_scripts(spark):
    bench = spark.createDataFrame([(1, "Wer wagt gewinnt"), (2, "今天天气很好我们出去玩")], "item_id long, text string")
    rows = [(1, "so: wer WAGT, gewinnt!", "", ""), (2, "wer wagt verliert", "", ""), (3, "x今天天气很差我们出去玩y", "", ""), (4, "今天", "", ""), (5, re.sub("a", "b", words(1, 30)), "", "")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs(spark, rows), bench).collect()}
    assert got == {(1, 1), (3, 2)}
