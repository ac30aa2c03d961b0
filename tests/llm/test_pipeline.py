"""The stages in a row over a small corpus."""

from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import BASE, docs, words


def test_pipeline_stages(spark, tmp_path):
    leak = words(700, 30)
    rows = [(k, words(k, 60), "en", "ab"[k % 2]) for k in range(60)]
    rows += [(100, BASE, "en", "a"), (101, BASE, "en", "b"), (102, words(800, 30) + " " + leak, "en", "a"), (103, None, "en", "a"), (104, "12 34", "en", "b")]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = [r.asDict() for r in out.collect()]
    ids = {r["doc_id"] for r in got}
    assert ids.isdisjoint({101, 102, 103, 104}) and len(corpus_pipeline.STAGES) == 5
    # 150 % of all words at 3 : 1 stops at twice the larger source's; no row more than twice
    assert max(sum(r["doc_id"] == i for r in got) for i in ids) <= 2
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert out.filter(F.col("grown_shard") < F.col("shard")).count() == 0
