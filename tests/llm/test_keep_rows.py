"""Near-duplicate survivors where ids are null or repeated."""

import pytest

from factorspark.llm import neardup, simhash
from test_operators import docs, words


@pytest.mark.parametrize("keep_one", [simhash.keep_one, neardup.keep_one])
def test_rows_are_named_by_id_and_text(spark, keep_one):
    a, b, c, d = (words(k, 80) for k in range(4))
    rows = [(None, a), (None, a), (1, a), (None, b), (None, b), (2, c), (2, d), (3, c), (3, c)]
    kept = sorted(((r["doc_id"], r["text"]) for r in keep_one(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()), key=str)
    assert kept == sorted([(1, a), (None, b), (2, c), (2, d)], key=str)
