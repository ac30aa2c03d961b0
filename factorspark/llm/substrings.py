"""Exact removal of repeated 100-byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through ``WIDTH`` bytes and no further, most significant digit first, and
only groups that a digit leaves undecided go on to the next one. Groups equal to the full depth
are exactly the repeated strings. The digits:

1. The anchor: of the ``GRAM``-byte strings inside a window, the one of the smallest hash (leftmost
   of equals) and its place. Equal windows have equal anchors, so windows part into groups by
   anchor. Consecutive windows mostly share one, and a run of windows with one anchor is one row:
   about one per 39 bytes.
2. The context: all bytes that the run's windows cover, and the anchor's place in them. Runs of equal
   context are equal window by window, so all but the first are repeated from end to end.
3. The bytes. First runs whose anchor has several contexts are sent by anchor with their bytes (some
   140 each), and the suffixes that start their windows are ordered by most-significant-digit
   passes over ``DIGIT`` bytes at a time: a pass sorts what the ones before left undecided, a suffix
   alone in its group is decided, and what is still together after ``WIDTH`` bytes is repeated.
   Of an anchor with more than ``HOT`` contexts the windows themselves are dealt by a digest.

Before a shuffle every task settles its own repeats: of equal runs it hands on the first, and an
anchor with several contexts in one task goes straight to the third digit, with one marker row to
tell the other tasks. So a group has at most a few rows per task, however many copies there are.
What crosses a shuffle without its bytes (second digit, windows of hot anchors) is compared by
128-bit digests; a row for every suffix with its bytes would be over 20 times the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import SMALL, kept_table

WIDTH, GRAM, DIGIT = 100, 24, 8
#: Contexts of one anchor that a task may hold at a time.
HOT = 8000
#: A task settles repeats among about so many runs at a time.
BATCH = 1_500_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Rows per record batch sent on.
_OUT = 50_000
_FAR = (1 << 63) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class _Power:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        return self.up[:n], self.down[:n]


_A = _Power(int(_P))


def _digests(parts: Iterator[bytes]) -> np.ndarray:
    """128-bit digests as rows of two signed numbers."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x) for x in parts]), np.int64).reshape(-1, 2)


def _rolling(data: np.ndarray, width: int, power: _Power) -> np.ndarray:
    """Mixed polynomial hash of every ``width``-byte string of ``data``."""
    n = len(data) - width + 1
    up, down = power.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[width:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _P
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    step, out = 1, a
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    if step < width:
        out = np.minimum(out[: len(a) - width + 1], out[width - step : width - step + len(a) - width + 1])
    return out


def runs(raw: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, context digest, first start, number of windows) of a text's runs of windows."""
    n = len(raw) - width + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, e.reshape(0, 2), e, e
    data = np.frombuffer(raw, np.uint8)
    h = _rolling(data, gram, _A)
    at = np.arange(len(h), dtype=np.uint64)
    low = _sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | at, width - gram + 1)
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
    count = np.diff(np.concatenate((first, [n])))
    anchor = anchor[first]
    digest, view = xxhash.xxh3_128_digest, memoryview(raw)
    ctx = b"".join([digest(view[s : s + c + width - 1], a - s) for s, c, a in zip(first.tolist(), count.tolist(), anchor.tolist(), strict=True)])
    return h[anchor].view(np.int64), np.frombuffer(ctx, np.int64).reshape(-1, 2), first, count


def _pack(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The start and, in 7 bits, the count."""
    return (start.astype(np.int64) << np.int64(7)) | count.astype(np.int64)


def _row_hash(raw: bytes) -> int:
    """What tells apart texts under one doc_id: 64 bits, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw, 5)).view(np.int64))


#: kind of a row: 0 to be compared by anchor; 1 repeated; 2 to go on to the third digit; 3 marker.
_RUN_SCHEMA = "kind int, a long, c long, c2 long, doc long, row long, at long"
_NAMES = ["kind", "a", "c", "c2", "doc", "row", "at"]


def _emit(kind: np.ndarray | int, a: np.ndarray, c: np.ndarray, c2: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    kinds = np.full(len(a), kind, np.int32) if isinstance(kind, int) else kind.astype(np.int32)
    for k in range(0, len(a), _OUT):
        s = slice(k, k + _OUT)
        yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (kinds, a, c, c2, doc, row, at)], names=_NAMES)


def _settle(a: np.ndarray, c: np.ndarray, c2: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task can tell on its own about its runs."""
    order = np.lexsort((at, row, doc, c2, c, a))
    cols = a, c, c2, doc, row, at = tuple(x[order] for x in (a, c, c2, doc, row, at))
    new_a = np.concatenate(([True], a[1:] != a[:-1]))
    new_c = new_a | np.concatenate(([True], (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])))
    lead = np.flatnonzero(new_c)
    of = np.cumsum(new_c) - 1
    # equal rows of a repeated document tie with the first and stay with it
    tie = (doc == doc[lead[of]]) & (row == row[lead[of]]) & (at == at[lead[of]])
    yield from _emit(1, *(x[~tie] for x in cols))
    n_ctx = np.bincount((np.cumsum(new_a) - 1)[lead])
    many = n_ctx[np.cumsum(new_a) - 1] > 1
    yield from _emit(0, *(x[lead[~many[lead]]] for x in cols))
    yield from _emit(2, *(x[lead[many[lead]]] for x in cols))
    mark = np.flatnonzero(new_a & many)
    zero = np.zeros(len(mark), np.int64)
    yield from _emit(3, a[mark], zero, zero, zero, zero, zero)


def _first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            a, c, first, count = runs(raw)
            if len(a):
                held.append((a, c[:, 0], c[:, 1], np.full(len(a), _FAR if doc is None else doc, np.int64), np.full(len(a), _row_hash(raw), np.int64), _pack(first, count)))
                size += len(a)
        if size >= BATCH:
            yield from _settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield from _settle(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _second_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, c, c2, doc, row, at), a whole anchor to a task; kinds 1 and 2 pass through."""
    # the last row seen, the first row of its context, and an anchor's first context while it is the only one
    last_a = last_c = lead = None
    pending: list[tuple[int, ...]] = []
    several = False
    out: list[list[int]] = []

    def done() -> Iterator[pa.RecordBatch]:
        if out:
            cols = [np.array(x, np.int64) for x in zip(*out, strict=True)]
            out.clear()
            yield from _emit(*cols)

    for b in batches:
        cols = [np.asarray(x) for x in b.columns]
        kind = cols[0]
        through = (kind == 1) | (kind == 2)
        if through.any():
            yield from _emit(kind[through], *(x[through] for x in cols[1:]))
        k, a, c, c2, doc, row, at = (x[~through] for x in cols)
        if not len(a):
            continue
        # an anchor with one row, inside the batch, needs nothing: only the others are walked
        alone = np.concatenate(([a[0] != last_a], a[1:] != a[:-1])) & np.concatenate((a[1:] != a[:-1], [False]))
        walk = np.flatnonzero(~alone)
        for kk, aa, cc, c3, dd, rr, tt in zip(*(x[walk].tolist() for x in (k, a, c, c2, doc, row, at)), strict=True):
            if aa != last_a:
                last_a, last_c, lead, several, pending = aa, None, None, False, []
            if kk == 3:
                several = True
                out.extend([2, *p] for p in pending)
                pending = []
                continue
            if (cc, c3) != last_c:
                if last_c is not None:
                    several = True
                last_c, lead = (cc, c3), (dd, rr, tt)
            if (dd, rr, tt) != lead:
                out.append([1, aa, cc, c3, dd, rr, tt])
            elif several:
                out.extend([2, *p] for p in pending)
                pending = []
                out.append([2, aa, cc, c3, dd, rr, tt])
            else:
                pending.append((aa, cc, c3, dd, rr, tt))
        if len(out) >= _OUT:
            yield from done()
    yield from done()


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: they cross a shuffle."""
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raws = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(1)]
        z, row = [pack.compress(raw) for raw in raws], [_row_hash(raw) for raw in raws]
        doc = [_FAR if d is None else d for d in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(z, pa.binary())], names=["doc_id", "doc", "row", "z"])


def _release(z: pa.Scalar, unpack: zstandard.ZstdDecompressor) -> bytes:
    return unpack.decompress(z.as_py())


_DEEP_SCHEMA = "a long, w long, w2 long, doc long, row long, at long, ctx binary"
_DEEP = ["a", "w", "w2", "doc", "row", "at", "ctx"]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, w, w2, doc, row, at, ctx) of the runs that need the third digit: the context, or for hot anchors one
    row a window with its digest; of equal windows of a hot anchor a task sends on the first and the
    others as known repeats (a null)."""
    unpack, held, size = zstandard.ZstdDecompressor(), [], 0

    def settle() -> Iterator[pa.RecordBatch]:
        a, w, w2, doc, row, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, row, doc, w2, w, a))
        a, w, w2, doc, row, at = (x[order] for x in (a, w, w2, doc, row, at))
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (w[1:] != w[:-1]) | (w2[1:] != w2[:-1])))
        of = np.flatnonzero(new)[np.cumsum(new) - 1]
        known = (doc != doc[of]) | (row != row[of]) | (at != at[of])
        send = new | known
        for k in range(0, int(send.sum()), _OUT):
            i = np.flatnonzero(send)[k : k + _OUT]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[i], pa.int64(), mask=known[i]), *(pa.array(x[i]) for x in (w, w2, doc, row, at)), pa.nulls(len(i), pa.binary())], names=_DEEP)

    for b in batches:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for doc, row, z, anchors, spots, hot in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), *b.columns[3:], strict=True):
            raw = _release(z, unpack)
            at, a, h = np.asarray(spots.values), np.asarray(anchors.values), hot.values.to_numpy(zero_copy_only=False)
            start, count = at >> 7, at & 127
            for aa, tt, s, c in zip(a[~h].tolist(), at[~h].tolist(), start[~h].tolist(), count[~h].tolist(), strict=True):
                out[0].append(aa)
                out[1].append(doc)
                out[2].append(row)
                out[3].append(tt)
                out[4].append(raw[s : s + c + WIDTH - 1])
            if h.any():
                start, count = start[h], count[h]
                starts = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                w = _digests(raw[x : x + WIDTH] for x in starts.tolist())
                one = np.ones(len(starts), np.int64)
                held.append((np.repeat(a[h], count), w[:, 0], w[:, 1], doc * one, row * one, _pack(starts, one)))
                size += len(starts)
        if out[0]:
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=_DEEP)
        if size >= BATCH:
            yield from settle()
            held, size = [], 0
    if held:
        yield from settle()


def radix_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray, width: int = WIDTH, digit: int = DIGIT) -> tuple[np.ndarray, np.ndarray]:
    """(which, group): the suffixes of ``data`` at ``start`` that equal another of their ``group`` through ``width`` bytes.

    Most significant digit first. ``which`` indexes ``start``, in the order of groups and bytes;
    equal strings of one group have one number.
    """
    which = np.argsort(group, kind="stable")
    group = group[which]
    group = np.cumsum(np.concatenate(([False], group[1:] != group[:-1]))[: len(group)])
    # the digit at every place of the data, most significant byte first
    digits = np.zeros(max(0, len(data) - digit + 1), np.uint64)
    for k in range(digit):
        digits = (digits << np.uint64(8)) | data[k : len(data) - digit + 1 + k]
    for at in range(0, width, digit):
        # the last digit begins early rather than going past the end: what it reads again is equal
        value = digits[start[which] + min(at, width - digit)]
        new = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
        odd = value != value[np.flatnonzero(new)][group]
        if odd.any():
            # only groups that this digit tells apart are sorted; each stays in its place
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[odd]] = True
            at_ = np.flatnonzero(mixed[group])
            order = np.lexsort((value[at_], group[at_]))
            which[at_], value[at_] = which[at_][order], value[at_][order]
            new[1:] |= value[1:] != value[:-1]
            group = np.cumsum(new) - 1
        undecided = np.bincount(group, minlength=1)[group] > 1
        if not undecided.all():
            which, group = which[undecided], group[undecided]
            group = np.cumsum(np.concatenate(([False], group[1:] != group[:-1]))[: len(group)])
        if not len(which):
            break
    return which, group


def _compare(anchor: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, ctx: list[bytes]) -> pa.RecordBatch:
    """Repeated windows of whole anchors' contexts, as runs; equal windows share their anchor."""
    count = at & 127
    size = np.fromiter(map(len, ctx), np.int64, len(ctx))
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    inside = np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    of = np.repeat(np.arange(len(at)), count)
    which, group = radix_groups(np.frombuffer(b"".join(ctx), np.uint8), base[of] + inside, anchor[of])
    wdoc, wrow, wat = doc[of], row[of], (((at >> 7)[of] + inside) << 7) | 1
    order = np.lexsort((wat[which], wrow[which], wdoc[which], group))
    which, group = which[order], group[order]
    new = np.concatenate(([True], group[1:] != group[:-1]))[: len(which)]
    lead = which[np.flatnonzero(new)[np.cumsum(new) - 1]]
    # ties with the first (rows of a repeated document) stay
    bad = np.sort(which[(wdoc[which] != wdoc[lead]) | (wrow[which] != wrow[lead]) | (wat[which] != wat[lead])])
    if not len(bad):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["doc", "row", "at"])
    cut_ = np.flatnonzero(np.concatenate(([True], (np.diff(bad) != 1) | (np.diff(of[bad]) != 0))))
    n = np.diff(np.concatenate((cut_, [len(bad)])))
    first = bad[cut_]
    return pa.RecordBatch.from_arrays([pa.array(wdoc[first]), pa.array(wrow[first]), pa.array((wat[first] & ~np.int64(127)) | n)], names=["doc", "row", "at"])


def _third_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, at) of repeated windows. Rows come sorted by (a, w, w2, doc, row, at): contexts of an anchor
    together, and each window of a hot one after its first."""
    anchors, docs, rows, ats, ctxs, last = [], [], [], [], [], None
    key, lead = None, None

    def flush() -> Iterator[pa.RecordBatch]:
        if docs:
            yield _compare(np.array(anchors, np.int64), np.array(docs, np.int64), np.array(rows, np.int64), np.array(ats, np.int64), ctxs)
            anchors.clear()
            docs.clear()
            rows.clear()
            ats.clear()
            ctxs.clear()

    for b in batches:
        whole = np.asarray(b.column(6).is_valid())
        a, w, w2, doc, row, at = b.column(0), *(np.asarray(x) for x in b.columns[1:6])
        known = ~np.asarray(a.is_valid())
        a = np.asarray(a.fill_null(0))
        for i in np.flatnonzero(whole).tolist():
            if a[i] != last:
                last = a[i]
                if len(docs) >= 2 * HOT:
                    yield from flush()
            anchors.append(int(a[i]))
            docs.append(int(doc[i]))
            rows.append(int(row[i]))
            ats.append(int(at[i]))
            ctxs.append(b.column(6)[i].as_py())
        bad = known.copy()
        for i in np.flatnonzero(~whole & ~known).tolist():
            if (a[i], w[i], w2[i]) != key:
                key, lead = (a[i], w[i], w2[i]), (doc[i], row[i], at[i])
            bad[i] = (doc[i], row[i], at[i]) != lead
        if bad.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[bad]), pa.array(row[bad]), pa.array(at[bad])], names=["doc", "row", "at"])
    yield from flush()


def _merge(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals as maximal ones that neither overlap nor touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cuts = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[cuts].tolist(), end[np.concatenate((cuts[1:] - 1, [len(end) - 1]))].tolist(), strict=True))


def _carve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for doc, z, spots in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            raw = _release(z, unpack)
            spans: list[tuple[int, int]] = []
            if spots.is_valid:
                at = np.asarray(spots.values)
                spans = _merge(at >> 7, (at >> 7) + (at & 127) + WIDTH - 1)
            sha, pos = hashlib.sha256(), 0
            for s, e in spans:
                sha.update(raw[pos:s])
                pos = e
            sha.update(raw[pos:])
            out.append((doc, len(raw), sum(e - s for s, e in spans), len(spans), sha.hexdigest(), [x for s in spans for x in s]))
        d, n, r, k, h, s = zip(*out, strict=True) if out else ((),) * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(h, pa.string()), pa.array(s, pa.list_(pa.int64()))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs``.

    A byte goes if a WIDTH-byte string that covers it also starts earlier: in a smaller doc_id, or
    in the same document before. ``spans`` lists start, end of each maximal removed run, in bytes.
    Defined cases: null text: empty; texts under WIDTH bytes lose nothing; rows equal in doc_id and
    text are one document and get the same result each; rows of one doc_id with different texts come
    one after the other in an order by hash; a null doc_id comes last; other columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows that only pass through are dealt by their place
    deal = F.when(F.col("kind").isin(1, 2), F.xxhash64("doc", "row", "at")).otherwise(F.col("a"))
    dealt = rows.mapInArrow(_first_digits, _RUN_SCHEMA).repartition(deal).sortWithinPartitions("a", "c", "c2", "doc", "row", "at")
    second = kept_table(dealt.mapInArrow(_second_digit, _RUN_SCHEMA).select("kind", "a", "doc", "row", "at"), "runs")
    deep = second.filter("kind = 2")
    hot = kept_table(deep.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("a", F.lit(True).alias("hot")), "hot")
    hot = F.broadcast(hot) if hot.count() <= SMALL else hot
    wanted = deep.join(hot, "a", "left").groupBy("doc", "row").agg(
        F.collect_list("a").alias("as"), F.collect_list("at").alias("ats"), F.collect_list(F.coalesce("hot", F.lit(False))).alias("hots"))
    # both joins read the texts from one shuffle
    texts = rows.mapInArrow(_squeeze, "doc_id long, doc long, row long, z binary").repartition("doc", "row")
    todo = texts.join(wanted, ["doc", "row"]).select("doc_id", "doc", "row", "z", "as", "ats", "hots")
    deep = todo.mapInArrow(_contexts, _DEEP_SCHEMA)
    spread = F.when(F.col("ctx").isNotNull(), F.col("a")).when(F.col("a").isNull(), F.xxhash64("doc", "row", "at")).otherwise(F.xxhash64("a", "w", "w2"))
    deep = deep.repartition(spread).sortWithinPartitions("a", "w", "w2", "doc", "row", "at").mapInArrow(_third_digit, "doc long, row long, at long")
    gone = second.filter("kind = 1").select("doc", "row", "at").unionByName(deep).groupBy("doc", "row").agg(F.collect_set("at").alias("ats"))
    whole = texts.join(gone, ["doc", "row"], "left").select("doc_id", "z", "ats")
    return whole.mapInArrow(_carve, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
