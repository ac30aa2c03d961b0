"""Language identification by hyperdimensional profiles.

A letter is a random vector of ``DIM`` signs drawn from its code point, every letter its own. An n-gram binds its
letters: each is permuted (rotated) by its place and the vectors are multiplied. A text bundles
its n-grams by adding them up, a language's prototype bundles the unit vectors of its texts, and a
text goes to the prototype of the largest cosine. Prototypes are learned from all labelled texts
outside the held-out fold: tasks add up their own, and only one vector per language goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import held_out, nameless

DIM, GRAM, SEED = 1024, 3, 7
UNKNOWN = "und"
#: Letters whose vectors a task keeps; of more it draws them again when they are met.
KEPT = 4096
#: Noise of a cosine is 1 / sqrt(DIM); a language counts as told from so many times that on (many n-grams), or
#: from less, in proportion, where a text has few of them.
SURE, FEW = 3.0, 48


class _Letters:
    """Vectors of letters by code point, permuted for each place; drawn when first met."""

    def __init__(self) -> None:
        self.row = np.full(0x110000, -1, np.int32)
        self.signs = np.empty((GRAM, 0, DIM), np.int8)

    def of(self, points: np.ndarray) -> np.ndarray | None:
        """The row in ``signs`` of each of ``points``; None if these alone are more letters than are kept."""
        rows = self.row[points]
        if (rows < 0).any():
            new = np.unique(points[rows < 0])
            if self.signs.shape[1] + len(new) > KEPT:
                new = np.unique(points)
                if len(new) > KEPT:
                    return None
                self.__init__()
            base = _draw(new)
            self.row[new] = np.arange(len(new), dtype=np.int32) + self.signs.shape[1]
            self.signs = np.concatenate((self.signs, np.stack([np.roll(base, k, axis=1) for k in range(GRAM)])), axis=1)
            rows = self.row[points]
        return rows


def _draw(points: np.ndarray) -> np.ndarray:
    """DIM signs for each code point: a 64-bit mixing function of point, word and seed, a bit a sign."""
    x = points.astype(np.uint64)[:, None] * np.uint64(DIM // 64) + np.arange(DIM // 64, dtype=np.uint64) + np.uint64(SEED << 40)
    for mult in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(mult)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


_LETTERS = cache(_Letters)


def _codes(text: str) -> np.ndarray:
    """Letters of a text as code points; runs of anything else become one blank (0)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _is_letter()
    known = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 2)
    odd = known == 2
    if odd.any():
        known[odd] = [chr(c).isalpha() for c in points[odd].tolist()]
    letter = known == 1
    keep = letter | np.concatenate(([True], letter[:-1]))
    out = np.where(letter, points, 0)[keep].astype(np.int64)
    return out


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x3000)], np.int8)


def profile(text: str | None) -> np.ndarray | None:
    """The bundle of a text's n-grams, of unit length; None without a letter."""
    return _profile(text)[0]


def _profile(text: str | None) -> tuple[np.ndarray | None, int]:
    """The profile and the number of distinct n-grams."""
    if not text:
        return None, 0
    codes = _codes(text)
    if not codes.any():
        return None, 0
    codes = np.concatenate(([0], codes[1:] if codes[0] == 0 else codes, [] if codes[-1] == 0 else [0])).astype(np.int64)
    if len(codes) < GRAM:
        codes = np.concatenate((codes, np.zeros(GRAM - len(codes), np.int64)))
    n, letters = len(codes) - GRAM + 1, _LETTERS()
    rows, size = letters.of(codes), KEPT
    if rows is None:  # a text of very many letters numbers them itself
        alphabet, rows = np.unique(codes, return_inverse=True)
        size = len(alphabet)
    rows = rows.astype(np.int64)
    grams = rows[:n].copy()
    for k in range(1, GRAM):
        grams = grams * size + rows[k : k + n]
    ids, counts = np.unique(grams, return_counts=True)
    total = np.zeros(DIM, np.float32)
    for at in range(0, len(ids), 1024):
        part, places = ids[at : at + 1024], []
        for _ in range(GRAM):
            places.append(part % size)
            part = part // size
        if size != KEPT:
            met = letters.of(alphabet[np.concatenate(places)])  # 1024 * GRAM of them are kept at once
            places = np.split(met, GRAM)
        signs = letters.signs
        bound = signs[GRAM - 1][places[0]]
        for k in range(1, GRAM):
            bound = bound * signs[GRAM - 1 - k][places[k]]
        total += counts[at : at + 1024].astype(np.float32) @ bound.astype(np.float32)
    norm = float(np.sqrt(np.dot(total, total)))
    return (total / norm if norm else None), len(ids)


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """Language -> unit prototype, from the texts of rows whose ``lang`` is not null.

    What reaches the driver is one vector of DIM numbers per language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if (v := profile(t.as_py())) is not None:
                    sums[lang] = sums[lang] + v if lang in sums else v.astype(np.float64)
        for lang, v in sums.items():
            # whole numbers add up alike in any order
            whole = np.round(v * (1 << 20)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(whole)], names=["lang", "k", "v"])

    labelled = docs.filter("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    summed = labelled.mapInArrow(run, "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("x")).select("lang", F.col("x.v").alias("v")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["lang"]):
        v = np.array(r["v"], np.float64)
        if (n := np.linalg.norm(v)) > 0:
            out[r["lang"]] = (v / n).astype(np.float32)
    return out


def classify(docs: DataFrame, protos: dict[str, np.ndarray], *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred, score (the cosine, cut to 0..1) and grams, the number of distinct n-grams.

    Defined cases: null text or no letter: ``und`` with score 0, as for every text where no
    prototype was learned; ties: the first language by code point; very long texts are read whole;
    columns of the input that are not in ``keep`` are ignored.
    """
    names = list(protos)
    matrix = np.stack([protos[n] for n in names]) if names else np.zeros((0, DIM), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, sizes = [], [], []
            for t in b.column(b.num_columns - 1):
                v, n = _profile(t.as_py()) if names else (None, 0)
                sizes.append(n)
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cos = matrix @ v
                k = int(cos.argmax())
                langs.append(names[k])
                scores.append(min(1.0, max(0.0, round(float(cos[k]), 6))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], schema=pa.schema(
                [*list(b.schema)[:-1], pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("grams", pa.int64())]))

    cols = [F.col(f"`{c}`") for c in keep]
    src = docs.select(*cols, F.col("text").cast("string").alias("_text_read"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{types}, lang_pred string, score double, grams long")


def identify(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learns from the rows outside the held-out fold, then classifies every row of ``docs``."""
    return classify(docs, prototypes(docs.filter(~held_out(F.col("doc_id")))), keep=keep)


def keep_identified(docs: DataFrame, *, sure: float = SURE) -> DataFrame:
    """``docs`` without the rows whose language can't be told: no letter, or a cosine within the code's noise.

    The level is ``sure`` standard deviations of the noise (1 / sqrt(DIM)) for a text of many
    distinct n-grams and grows towards it with their number, so that a short text stays.
    """
    own, columns, to = nameless(docs)
    asked = own.withColumnsRenamed({to[c]: c for c in ("doc_id", "text", "lang")})
    names = asked.columns
    level = F.lit(sure / DIM**0.5) * F.col("grams") / (F.col("grams") + FEW)
    named = identify(asked, keep=tuple(names))
    return named.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= level)).select(*(F.col(c) for c in names)).toDF(*columns)
