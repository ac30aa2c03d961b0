"""The near-copy stage's SimHash fingerprints, blocks and BK-trees."""

import numpy as np
import pyarrow as pa

from factorspark.llm import neardup
from test_neardup import edited
from test_operators import docs, words


def pair(rng, n):
    """Two sets at 0.8, or a little more."""
    a, b = (0, n // 4) if n < 8 else (n // 8, n // 8)
    x = rng.integers(0, 1 << 64, n + a + b, dtype=np.uint64)
    return np.unique(x[: n + a]), np.unique(np.concatenate((x[:n], x[n + a :])))


def test_similar_sets_meet_within_the_radius():
    rng = np.random.default_rng(3)
    for rows in (100, 200_000):
        width, count = neardup.blocks(rows)
        for n in [4, 4, 5, 6, 8, 9, 40, 300] * 8:
            x, y = (neardup.fingerprint(s, neardup.BITS + width * count) for s in pair(rng, n))
            assert (x != y)[: neardup.BITS].sum() <= neardup.RADIUS
            kx, ky = (neardup.block_keys(f[None, neardup.BITS :], width)[0] for f in (x, y))
            assert len(set(kx.tolist())) == count and (kx == ky).any()


def test_bits_are_majorities_and_equal_sets_equal():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 1 << 64, 701, dtype=np.uint64)
    one = [neardup.fingerprint(np.concatenate((np.full(4, h), s[:0])), 640).astype(int) for h in s]  # four equal votes decide
    got, votes = neardup.fingerprint(s, 640), sum(one)
    sure = np.abs(2 * votes - len(s)) > 1  # the shared vote can't turn these
    assert sure.sum() > 500 and (got[sure] == (2 * votes > len(s))[sure]).all()
    for n in (1, 2, 3, 5):
        assert (neardup.fingerprint(s[:n], 640) == neardup.fingerprint(s[:n].copy(), 640)).all()
    assert (neardup.fingerprint(s[:2], 640) != neardup.fingerprint(s[:3], 640)).sum() > 250


def values(seed, n):
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        v = int.from_bytes(rng.bytes(16), "big")
        if out and rng.random() < 0.5:
            v = out[rng.integers(len(out))]
            for b in rng.integers(0, 128, rng.integers(0, 30)):
                v ^= 1 << int(b)
        out.append(v)
    return out


def test_trees_find_who_has_a_neighbour():
    for seed in range(20):
        v = values(seed, 60)
        for radius in (-1, 0, 5, 20, 42):
            want = [any(i != j and (x ^ y).bit_count() <= radius for j, y in enumerate(v)) for i, x in enumerate(v)]
            assert neardup.neighboured(v, radius) == want


def test_shards_over_batch_edges_and_too_large_ones(monkeypatch):
    monkeypatch.setattr(neardup, "SHARD_MAX", 8)
    sizes, v = [1, 5, 8, 2, 9, 30, 1, 7, 3], values(50, 66)
    key = [k for k, n in enumerate(sizes) for _ in range(n)]
    f0, f1 = (np.array(x, np.uint64).view(np.int64) for x in ([x >> 64 for x in v], [x & (1 << 64) - 1 for x in v]))
    want = []
    for k, n in enumerate(sizes):
        at = [i for i in range(66) if key[i] == k]
        want += at if n > 8 else [i for i, ok in zip(at, neardup.neighboured([v[i] for i in at], 20), strict=True) if ok]
    assert 39 < len(want) < 60
    rows = pa.record_batch([pa.array(key), pa.array(range(66)), pa.array(f0), pa.array(f1)], names=["key", "h", "f0", "f1"])
    for size in (1, 2, 7, 10, 66):
        got = [h for b in neardup._near(iter([rows.slice(i, size) for i in range(0, 66, size)]), 20) for h in b.column(1).to_pylist()]
        assert got == want


def test_stage_links_by_the_trees(spark):
    rows = [(1, words(1, 300), "en", "a")]
    rows += [(1 + k, edited(rows[0][1], k, k), "en", "a") for k in range(1, 6)]
    kept = {r: sorted(x["doc_id"] for x in neardup.keep_one(docs(spark, rows), radius=r).collect()) for r in (-1, neardup.RADIUS)}
    assert kept == {-1: [1, 2, 3, 4, 5, 6], neardup.RADIUS: [1]}
