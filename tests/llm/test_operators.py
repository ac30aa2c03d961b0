"""Small fixtures against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factorspark.llm import ann, chat, components, decontaminate, langid, mixing, sharding, simhash, substrings, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, shard int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), -9, -9) for i, t, l, s in rows], DOCS)


def words(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 8))) for _ in range(n))


BASE = words(1, 300)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " tail", "en", "b"), (4, words(2, 200), "en", "b"), (5, None, None, None), (6, "", "en", "a"),
    (7, " \t\n", "en", "a"), (8, "One", "en", "c"), (8, "One", "en", "c"), (9, words(3, 4000), "en", "a"), (None, words(4, 50), "en", "a"), (10, "ähnlich große Wörter", "de", "é"),
]


def brute_fp(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs(spark, ROWS)).collect()]
    fps = [(i, brute_fp(t)) for i, t, *_ in ROWS]
    label = {f: f for _, f in fps}
    for _ in fps:
        for a, b in itertools.combinations(label, 2):
            if (a ^ b).bit_count() <= 2:
                label[a] = label[b] = min(label[a], label[b])
    low = {}
    for i, f in fps:
        if i is not None:
            low[label[f]] = min(low.get(label[f], i), i)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted([(i, f, low.get(label[f])) for i, f in fps], key=key)


def test_simhash_shards_split_and_chain(spark):
    r = np.random.default_rng(0)
    base = int(r.integers(0, 2**63))
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)} | {int(x) for x in r.integers(0, 2**63, 50)}
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    for most in (4096, 8):  # with a low limit shards are split up to the last level
        comp = components.components(simhash.links(df, shard_max=most))
        assert comp.filter("component is not null").count() >= 60
        assert comp.select("component").distinct().count() == 1


def test_bk_tree_finds_all():
    vals = sorted({int(x) for x in np.random.default_rng(3).integers(0, 2**10, 200)}, key=hash)
    tree = simhash.BKTree()
    for v in vals:
        tree.add(v)
    for q in vals[:20]:
        assert sorted(tree.values[i] for i in tree.within(q, 2)) == sorted(v for v in vals if (v ^ q).bit_count() <= 2)


def test_keep_one(spark):
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs(spark, ROWS)).collect() if r["doc_id"] is not None)
    fps = {i: brute_fp(t) for i, t, *_ in ROWS if i is not None}
    assert fps[1] == fps[2] and fps[5] == fps[6] == fps[7] == 0
    # of pairs of distinct fingerprints none here is within the radius by chance, but for 1 and 3 it may be
    want = [1, 4, 5, 8, 9, 10] if (fps[1] ^ fps[3]).bit_count() <= 2 else [1, 3, 4, 5, 8, 9, 10]
    assert kept == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and len(got) == 81
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.example.org/es/1", ""), (2, "http://example.org/en/1x", None), (3, "HTTP://B.COM/fr/x?y", ""), (4, "https://c.com/de/9#z", ""), (5, None, ""), (6, "nourl", ""),
        (7, "http://x.net/p", link.format("https://c.com/de/9")), (8, "http://x.net/q", '<meta http-equiv="refresh" content="0; url=/p">'), (9, "http://y.net/p", link.format("http://y.org/ok")),
        (10, "http://y.net/r", link.format("http://y.net/p")), (10, "http://y.net/r", ""), (11, "http://notorg/es/", ""), (12, "http://y.net/r2", link.format("https://c.com/de/10")),
        (13, "http://y.net/r2", link.format("http://z.org/a")),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "allow") and got[3] == ("b.com", "/fr/x", "com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("", "", None, "allow") == got[6]
    assert got[7][3] == "block" == got[8][3] and got[9][3] == "allow" == got[10][3] and got[11][2] is None
    assert got[12][3] == "allow"  # its group also holds an explicit allow


def test_chat_round_trip(spark):
    tricky = "<|im_end|>\n<|im_start|>assistant \\ ok <| \\| <"
    rows = [(1, 0, "system", "be " * 20), *[(1, k, "user" if k % 2 else "assistant", f"{k} {tricky} " + words(k, 90)) for k in range(1, 40)], (2, None, None, None), (2, 1, "assistant", ""),
            (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 0, "us\ner\\", "x"), (4, 0, "assistant", words(5, 5000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wins = chat.windows(df)
    assert wins.filter((F.col("tokens") > chat.BUDGET) & (F.col("conv_id") == 1)).count() == 0
    assert wins.filter("conv_id = 1 and window > 0 and n_repeated = 0").count() == 0
    got = {r["conv_id"]: r for r in chat.digests(wins).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        turns = sorted([(-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == sha(loss)
    assert chat.windows(df.limit(0)).count() == 0


def brute_removed(rows, width=100):
    out, seen = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            w = raw[p : p + width]
            if w in seen and seen[w] != (i, p):
                gone[p : p + width] = b"\1" * width
            seen.setdefault(w, (i, p))
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [8000, 0])
def test_substrings_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    a, b = words(11, 200), words(12, 60)
    rows = [*ROWS, (20, "=" * 450, "", ""), (21, "x" + "=" * 120 + a, "", ""), (22, a[37:600] + b + a[100:350], "", ""), (23, words(13, 30) + b[50:220] + "ü" * 130, "", ""), (24, "ü" * 70 + b, "", "")]
    rows += [(30 + k, words(50 + k, 12) + " " + b + " " + words(90 + k, 12), "", "") for k in range(6)]
    want = brute_removed(rows)
    got = substrings.removed_spans(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
    assert substrings.removed_spans(docs(spark, rows).limit(0)).count() == 0


def test_masks_lose_nothing():
    for n in range(decontaminate.SHORTEST, decontaminate.WINDOW + 1):
        k = n - int(np.ceil(decontaminate.LEAST * n - 1e-9))
        for bad in itertools.combinations(range(n), k):
            assert any(all(m[o] == "0" or at + o not in bad for o in range(len(m))) for m in decontaminate.MASKS for at in range(n - len(m) + 1))


def test_decontamination_matches_brute_force(spark):
    r = np.random.default_rng(5)
    items = [(k, words(200 + k, int(r.integers(6, 25)))) for k in range(12)] + [(99, None), (98, "")]
    rows = []
    for d in range(60):
        t = items[d % 12][1].split()
        for j in r.integers(0, len(t), d % 5):
            t[j] = "zzz"
        rows.append((d, words(d, 20) + " " + " ".join(t).upper() + ". " + words(d + 500, 20), "en", "a"))
    rows += [(100, None, "", ""), (101, "short", "", ""), (7, rows[7][1], "", "")]
    tok = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = set()
    for d, t, *_ in rows:
        w = tok(t)
        for _, x in items:
            b = tok(x)
            n = min(len(b), decontaminate.WINDOW)
            least = 0.8 if len(b) >= decontaminate.SHORTEST else 1  # shorter items must appear whole
            if b and any(sum(p == q for p, q in zip(w[i : i + n], b[j : j + n], strict=False)) >= least * n - 1e-9 for i in range(len(w) - n + 1) for j in range(len(b) - n + 1)):
                want.add(d)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (100_000, 0):
        assert {r["doc_id"] for r in decontaminate.overlaps(docs(spark, rows), bench, broadcast_rows=most).collect()} == want
    assert {r["doc_id"] for r in decontaminate.clean(docs(spark, rows), bench).collect()} == {r[0] for r in rows} - want
    assert decontaminate.overlaps(docs(spark, rows), bench.limit(0)).count() == 0


def test_nearest_matches_brute_force(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 24)).astype("float32")
    x[50:90] = x[49]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(400)] + [(1000, None, 0), (1020, [0.0] * 24, 0), (1040, [float("nan")] * 24, 0), (1060, [None] + [1.0] * 23, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for g in ann.nearest(df, cell=80, block=50, queries=7).orderBy("query_id", "rank").collect():
        got.setdefault(g["query_id"], []).append((g["vec_id"], g["score"]))
    hit = 0
    for q in range(0, 400, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        assert len(got[q]) == 20
        hit += len({v for v, _ in got[q]} & set(order))
        assert all(abs(sc - s[v]) < 1e-9 for v, sc in got[q])
    assert set(got) == set(range(0, 400, 20)) and hit / 400 >= 0.99
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.filter("vec_id in (0, 1)")).count() == 1


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), "en", "abcd"[min(3, i // 250)] if i < 980 else None) for i in range(1000)] + [(5000, None, "en", "z"), (5001, "", "en", "a"), (1, "w w w w w w w w", "en", "a")]
    plan = [tuple(r) for r in mixing.mix(docs(spark, rows)).collect()]
    assert sorted(plan, key=str) == sorted([tuple(r) for r in mixing.mix(docs(spark, rows).repartition(3)).collect()], key=str)
    sizes, taken, target = {}, {}, {}
    for _, s, _, n, m, total, t, c in plan:
        assert 0 <= c <= 2
        sizes[s] = sizes.get(s, 0) + n * m
        taken[s] = taken.get(s, 0) + n * m * c
        target[s] = t
        assert total is not None
    budget, w = 1.5 * sum(sizes.values()), {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted((x for x in sizes if x is not None), key=str))}
    w[None] = (3, 1, 2)[len(w) % 3]
    full = set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in full)) / max(1e-9, sum(w[s] for s in w if s not in full))
        over = {s for s in w if s not in full and w[s] * level > 2 * sizes[s]}
        if not over or len(full) == len(w):
            break
        full |= over
    for s in w:
        assert target[s] == pytest.approx(min(2 * sizes[s], w[s] * level)) and abs(taken[s] - target[s]) <= 180
    assert mixing.mixed_rows(docs(spark, rows)).count() == sum(m * c for *_, m, _, _, c in plan)
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rows = [*ROWS, *[(10**k * 7919, "t", "", "") for k in range(15)], (-5, "neg", "", ""), *[(1000 + k, "u", "", "") for k in range(300)]]
    got = sharding.shard(docs(spark, rows), 24).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 24) and r["grown_shard"] == jump(r["doc_id"] or 0, 25) and r["grown_shard"] in (r["shard"], 24)
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(docs(spark, rows).limit(0), 24).count() == 0


def test_language(spark):
    seeds = {"en": "the house and the river with many old trees", "de": "das große Haus und der Fluss mit vielen alten Bäumen", "fr": "la maison et la rivière avec beaucoup de vieux arbres"}
    rows = [(k, f"{t} {t[k % 7 :]}", lang, "a") for k, (lang, t) in enumerate(itertools.islice(itertools.cycle(seeds.items()), 90))]
    rows += [(500, None, "en", ""), (501, "123 !!", "en", ""), (502, "", None, ""), (503, "und der alte Fluss " * 3000, None, "")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(spark, rows)).collect()}
    assert all(got[i][0] == lang for i, _, lang, _ in rows[:90]) and got[500] == got[501] == got[502] == ("und", 0.0) and got[503][0] == "de"
    kept = langid.keep_identified(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and {500, 501, 502}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() == 91
    assert langid.identify(docs(spark, rows).limit(0)).count() == 0


def test_toxicity(spark):
    rows, labels = [], []
    for k in range(300):
        bad = k % 5 == 0
        rows.append((k, words(k, 30) + (" you blorgish zunk. " if bad else ". ") + words(k + 999, 20), "en", "a"))
        labels.append((k, 1, int(bad)))
    rows += [(900, None, "", ""), (901, "", "", ""), (902, "He said they are not blorgish zunk", "", "")]
    lab = spark.createDataFrame([*labels, (0, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, rows), toxicity.learn(docs(spark, rows), lab)).collect()}
    wrong = [k for k in range(300) if got[k]["predicted"] != int(k % 5 == 0)]
    assert len(wrong) <= 3 and not any(k % 5 == 0 for k in wrong)
    assert got[900]["score"] == got[901]["score"] and got[902]["score"] < got[0]["score"]
    empty = toxicity.learn(docs(spark, rows).limit(0), lab.limit(0))
    assert toxicity.score(docs(spark, rows), empty).filter("score is null").count() == 0
