"""Texts without an id, or under one id, are documents of their own."""

import hashlib

import pytest
import xxhash

from factorspark.llm import substrings
from test_operators import docs, words


@pytest.mark.parametrize("hot", [8000, 0])
@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_whose_hashes_share_their_low_bits(spark, monkeypatch, hot, doc_id):
    monkeypatch.setattr(substrings, "HOT", hot)
    # two texts of one start whose hashes agree in the low 23 bits
    base, seen, k = words(1, 60), {}, 0
    while True:
        text = f"{base} {k:07d} {words(k % 50, 40)}"
        low = xxhash.xxh3_64_intdigest(text.encode(), 5) & 0x7FFFFF
        if low in seen:
            break
        seen[low], k = text, k + 1
    pair = [seen[low].encode(), text.encode()]
    got = substrings.removed_spans(docs(spark, [(doc_id, p.decode(), "", "") for p in pair])).collect()
    gone = {r["kept_sha256"] for r in got}
    want = []
    for first, second in (pair, pair[::-1]):
        starts = {first[i : i + 100] for i in range(len(first) - 99)}
        bad = bytearray(len(second))
        for i in range(len(second) - 99):
            if second[i : i + 100] in starts:
                bad[i : i + 100] = b"\1" * 100
        kept = bytes(x for x, y in zip(second, bad, strict=True) if not y)
        want.append({hashlib.sha256(first).hexdigest(), hashlib.sha256(kept).hexdigest()})
    assert len(gone) == 2 and gone in want
