"""The near-copy stage against all pairs."""

import itertools

import numpy as np
import pyarrow as pa

import corpus_pipeline
from factorspark.llm import neardup
from test_operators import docs, words


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(text, seed, n):
    w, r = text.split(), np.random.default_rng(seed)
    for j in r.integers(0, len(w), n):
        w[j] = f"edit{r.integers(10**6)}"
    return " ".join(w)


def survivors(rows):
    """Smallest ids of the components of all pairs at 0.8 or more."""
    label = list(range(len(rows)))
    sets = [grams(t) for _, t, *_ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or (a | b and 5 * len(a & b) >= 4 * len(a | b)):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    return sorted(min(r[0] for r, y in zip(rows, label, strict=True) if y == x) for x in set(label))


def test_stage_drops_edited_copies(spark):
    rows = [(1, words(1, 300), "en", "a")]
    rows += [(1 + k, edited(rows[0][1], k, k), "en", "a") for k in range(1, 6)]
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()] == [1]


def test_stage_matches_all_pairs(spark):
    rows = []
    for f in range(12):
        base = words(100 + f, 40 + 30 * f)
        for k in range(14):
            rows.append((len(rows), edited(base, 1000 * f + k, k % (2 + f)), "en", "a"))
        # a chain: each a few words further on
        rows.append((len(rows), " ".join(base.split()[4:]) + " " + words(f + 700, 4), "en", "a"))
    rows += [(900 + k, t, "en", "a") for k, t in enumerate([None, "", " \n", "One two", "one TWO", "One two three", words(5, 9000)])]
    got = neardup.keep_one(docs(spark, rows))
    want = survivors(rows)
    assert 20 < len(want) < len(rows) - 20
    assert sorted(r["doc_id"] for r in got.collect()) == want and got.columns == docs(spark, rows).columns
    assert neardup.keep_one(docs(spark, rows).limit(0)).count() == 0


def test_large_buckets_in_parts(spark, monkeypatch):
    """Buckets many times a part's size: groups of near copies, and chains that only pairs across parts link."""
    monkeypatch.setattr(neardup, "PART", 6)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    base, rows = words(400, 300), []
    for k in range(60):
        rows.append((k, edited(base, k, 1 + k % 5), "en", "a"))
    for k in range(40):  # similar enough for shared keys, at 0.8 to few
        rows.append((100 + k, edited(base, 300 + k, 4 + k % 5), "en", "a"))
    want = survivors(rows)
    assert 1 < len(want) < 60
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs(spark, rows)).collect()) == want


def test_parts_meet_in_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 5)
    comps = [0] * 30 + list(range(100, 123)) + [7] * 9
    known = spark.createDataFrame([(1, k, 10, b"", c) for k, c in enumerate(comps)] + [(2, k, 10, b"", 3) for k in range(20)], "key long, h long, n long, bits binary, comp long")
    groups = {}
    for r in neardup._meetings(known).collect():
        groups.setdefault(r["key"], ([], []))[r["side"]].append(r["h"])
    met = {frozenset((a, b)) for left, right in groups.values() for a in left for b in right if comps[a] != comps[b]}
    assert met == {frozenset(p) for p in itertools.combinations(range(len(comps)), 2) if comps[p[0]] != comps[p[1]]}
    assert max(len(a) + len(b) for a, b in groups.values()) < 30


def test_bound_loses_no_pair():
    base = words(9, 120)
    sets = [neardup.shingles(edited(base, k, k % 9))[1] for k in range(60)]
    n, bits = np.array([len(s) for s in sets]), np.frombuffer(b"".join(map(neardup.parities, sets)), np.uint64).reshape(-1, 4)
    for i in range(1, 60):
        at, _ = neardup._differ(n[:i], bits[:i], n[i], bits[i])
        assert {j for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (n[i] + n[j])} <= set(at.tolist())


def test_shared_keys_over_batch_edges():
    keys = [1, 2, 2, 2, 2, 3, 4, 4, 5, 6, 6]
    for size in (1, 2, 3, 5, 20):
        batches = [pa.record_batch([pa.array(keys[i : i + size])], names=["key"]) for i in range(0, len(keys), size)]
        assert [k for b in neardup._shared(iter(batches)) for k in b.column(0).to_pylist()] == [2, 2, 2, 2, 4, 4, 6, 6]
