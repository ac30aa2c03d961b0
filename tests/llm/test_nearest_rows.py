"""Nearest neighbours of rows that repeat ids or vectors, and of very large or small components."""

import numpy as np
import pytest

from factorspark.llm import ann


def brute(rows, k=20, every=20):
    """(query_id, rank, vec_id, score) with each row a candidate for every other one."""
    out = []
    for a, (qid, q) in enumerate(rows):
        if qid % every == 0:
            with np.errstate(all="ignore"):
                found = [(float((np.array(v) * np.array(q)).sum()), vid) for b, (vid, v) in enumerate(rows) if b != a and len(v) == len(q)]
            found.sort(key=lambda t: (np.isnan(t[0]), -t[0], t[1]))
            out += [(qid, r + 1, vid, s) for r, (s, vid) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [8192, 30])
def test_repeats_and_clusters(spark, cell):
    r = np.random.default_rng(4)
    hubs = r.standard_normal((6, 12)) * 3
    rows = [(i, list(map(float, hubs[i % 6] + r.standard_normal(12) * 0.2))) for i in range(300)]
    rows += [(20, rows[21][1]), (5, rows[20][1]), (5, rows[20][1]), (40, rows[40][1]), (1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (2000, [0.5] * 3)]
    rows += [(3000 + i, [7.0] * 12) for i in range(60)]  # one vector under many ids, queries among them
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = sorted(((g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in ann.nearest(df, cell=cell, block=64, queries=16).collect()), key=str)
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


@pytest.mark.parametrize("scale", [1e200, 1e150, 1e-200])
def test_large_and_small_components(spark, scale):
    r = np.random.default_rng(5)
    rows = [(i, list(map(float, r.standard_normal(8) * scale))) for i in range(5)]
    got = ann.nearest(spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    want = {(r_, v) for _, r_, v, _ in brute(rows)}
    assert len(got) == 4 and {(g["rank"], g["vec_id"]) for g in got} == want
