"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer rewrites a clause's tokens into symbols: insult (learned words and word
beginnings, weighted by log odds), threat, target, negation, contrast, reported speech, other.
Small transducers, each an arc table, read the symbols:

* negation: from a negation to the clause's end or a contrast, insults and threats come out negated;
* target: whether a target stands anywhere in the clause, before or after;
* report: whether reported speech stands anywhere in the clause;
* clause: collects the weights of insults and threats along its path.

They are composed once into one clause automaton. An arc multiplies its token's weight, a final
state multiplies what the path has collected: an insult counts for more with a target, a threat
for nothing without one, and everything for less in reported speech. A document's score is a
logistic curve over the summed weights of its matched clauses, fitted on the learning rows; a text
without a matched clause has the score of an empty one.

The insult lexicon is learned: ``SAMPLE`` labelled documents (a bounded sample by hash of the id)
give, for every word and word beginning, in how many toxic and other documents it occurs; what is
frequent and lopsided enough is kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import held_out

#: At most about so many labelled documents are learned from.
SAMPLE = 20_000
MIN_DOCS, MIN_ODDS, THRESHOLD = 3, 2.0, 0.3
#: A word is an insult if chance would put it into so many toxic documents with a smaller probability than this.
CHANCE = 1e-3
STEMS = (4, 5, 6, 7)

# Fixed word lists of the grammar, in English, German, French and Spanish.
THREAT = frozenset(
    "kill killing hurt destroy punch stab beat strangle shoot murder burn crush töten umbringen schlagen vernichten erschießen verprügeln erwürgen "
    "tuer frapper détruire poignarder étrangler abattre écraser matar golpear destruir apuñalar estrangular disparar aplastar".split())
TARGET = frozenset("you your you're he she they him her them du dich dein ihr euch er sie tu toi ton vous votre il elle ils tú te tus usted ustedes él ella ellos".split())
NEGATION = frozenset("not no never isn't aren't nicht kein keine nie ne pas jamais nunca ni sin".split())
CONTRAST = frozenset("but however though aber sondern jedoch mais cependant pero sino".split())
REPORTED = frozenset("said says wrote quoted called reported sagte schrieb nannte dit écrit cité dijo escribió citó".split())

_CLAUSE = re.compile(r"[.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Weights of the automaton: an insult's arc with and without a negation, final factors of a target and of a report,
#: and what a threat weighs (an insult weighs its log odds, seldom over 6).
NEGATED, RAISED, QUOTED, THREAT_WEIGHT = 0.3, 1.6, 0.5, 8.0

# Symbols of the tape. The negation transducer writes the last two.
INSULT, THREATENS, TARGETS, NEGATES, TURNS, REPORTS, OTHER, NOT_INSULT, NOT_THREAT = range(9)
_READ = (INSULT, THREATENS, TARGETS, NEGATES, TURNS, REPORTS, OTHER)

# Arc tables: (state, symbol) -> (next state, symbol written). What is not listed stays and copies; 0 is the start.
NEGATION_ARCS = {
    (0, NEGATES): (1, OTHER), (1, NEGATES): (1, OTHER), (1, TURNS): (0, TURNS), (1, INSULT): (1, NOT_INSULT), (1, THREATENS): (1, NOT_THREAT),
}
TARGET_ARCS = {(0, TARGETS): (1, TARGETS)}
REPORT_ARCS = {(0, REPORTS): (1, REPORTS)}
# The clause transducer's arcs weigh: symbol -> (into the insult sum, into the threat sum), times the token's weight.
CLAUSE_WEIGHTS = {INSULT: (1.0, 0.0), NOT_INSULT: (NEGATED, 0.0), THREATENS: (0.0, 1.0), NOT_THREAT: (0.0, NEGATED)}


def compose(*tables: dict) -> tuple[dict, list[tuple[int, ...]]]:
    """(arcs, states) of transducers run one on the other's output: arcs[state, symbol] = (next state, symbol written).

    ``states`` holds the parts' states of every state that the start reaches.
    """
    states, arcs = [(0,) * len(tables)], {}
    for number, parts in enumerate(states):
        for symbol in _READ:
            after, written = [], symbol
            for table, part in zip(tables, parts, strict=True):
                to, written = table.get((part, written), (part, written))
                after.append(to)
            if tuple(after) not in states:
                states.append(tuple(after))
            arcs[number, symbol] = (states.index(tuple(after)), written)
    return arcs, states


def _automaton() -> tuple[list[list[tuple[int, float, float]]], list[tuple[float, float]]]:
    """The composed grammar: per state and symbol (next, insult weight, threat weight), and a state's final factors."""
    arcs, states = compose(NEGATION_ARCS, TARGET_ARCS, REPORT_ARCS)
    table = [[(arcs[s, x][0], *CLAUSE_WEIGHTS.get(arcs[s, x][1], (0.0, 0.0))) for x in _READ] for s in range(len(states))]
    final = []
    for _, target, report in states:
        quoted = QUOTED if report else 1.0
        final.append((quoted * (RAISED if target else 1.0), quoted if target else 0.0))
    return table, final


ARCS, FINAL = _automaton()


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def features(text: str) -> set[str]:
    """Words, and word beginnings as ``stem*``, of a text."""
    out = set(tokens(text))
    for n in STEMS:
        out |= {w[:n] + "*" for w in out if len(w) > n and w[-1] != "*"}
    return out


class Grammar:
    """The composed automaton with learned insult weights and the fitted curve."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], curve: tuple[float, float] = (-3.0, 1.5)) -> None:
        self.words, self.stems, self.curve = words, stems, curve
        self.cache: dict[str, tuple[int, float]] = {}

    def insult(self, token: str) -> float:
        """Weight of the lexicon's path for a token; 0 if it has none."""
        if (w := self.words.get(token)) is not None:
            return w
        for n in reversed(STEMS):
            if len(token) > n and (w := self.stems.get(token[:n])) is not None:
                return w
        return 0.0

    def read(self, token: str) -> tuple[int, float]:
        """The lexical transducer: (symbol, weight) of a token; the fixed lists come before learned words."""
        if (got := self.cache.get(token)) is None:
            got = next(((s, 1.0) for s, known in ((NEGATES, NEGATION), (TARGETS, TARGET), (REPORTS, REPORTED), (TURNS, CONTRAST)) if token in known), None)
            if got is None and token in THREAT:
                got = (THREATENS, THREAT_WEIGHT)
            if got is None:
                w = self.insult(token)
                got = (INSULT, w) if w else (OTHER, 0.0)
            if len(self.cache) < 200_000:
                self.cache[token] = got
        return got

    def clause(self, toks: list[str]) -> float:
        """One run of the automaton."""
        state, insults, threats = 0, 0.0, 0.0
        for t in toks:
            symbol, weight = self.read(t)
            state, a, b = ARCS[state][symbol]
            insults += a * weight
            threats += b * weight
        return FINAL[state][0] * insults + FINAL[state][1] * threats

    def raw(self, text: str | None) -> float:
        """Log of one plus the summed weights of the matched clauses, 0 where nothing matches."""
        if not text:
            return 0.0
        total, cache, read = 0.0, self.cache, self.read
        for part in _CLAUSE.split(text):
            toks = tokens(part)
            # only a clause with an insult or a threat can match
            if any((cache.get(t) or read(t))[0] <= THREATENS for t in toks):
                total += self.clause(toks)
        return math.log1p(total)

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-(a + b * self.raw(text))))


def _tail(p: int, n: int, share: float) -> float:
    """Probability that of ``p + n`` documents at least ``p`` are toxic if each is with probability ``share``."""
    if not 0 < share < 1:
        return float(share >= 1)
    m = p + n
    logs = (math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(share) + (m - k) * math.log1p(-share) for k in range(p, m + 1))
    return sum(math.exp(x) for x in logs)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature by Newton steps with a little ridge."""
    a, b = -3.0, 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(p - y).sum() + 1e-2 * a, ((p - y) * x).sum() + 1e-2 * b])
        w = p * (1 - p)
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-8:
            break
    return a, max(b, 0.0)


def sample(docs: DataFrame, labels: DataFrame, *, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of about ``size`` labelled documents outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, size / max(1, known.count()))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 11).cast("double") / float(1 << 53)
    chosen = known.filter(draw < share)
    text = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # bounded by ``size`` rows of two numbers
    return text.join(F.broadcast(chosen), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, *, size: int = SAMPLE) -> Grammar:
    """The grammar for a corpus. The driver gets the lexicon of a bounded sample and one histogram."""
    rows = sample(docs, labels, size=size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        n_pos = n_neg = 0
        for b in batches:
            for t, x in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                f = features(t.as_py())
                if x:
                    pos.update(f)
                    n_pos += 1
                else:
                    neg.update(f)
                    n_neg += 1
        names = ["", *pos]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([n_pos, *(pos[k] for k in names[1:])], pa.int64()), pa.array([n_neg, *(neg[k] for k in names[1:])], pa.int64())], names=["f", "p", "n"])
        # what never occurs in a toxic document can't be an insult, but other tasks may have seen it in one
        rest = [k for k, c in neg.items() if k not in pos and c >= 1]
        for at in range(0, len(rest), 50_000):
            part = rest[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([0] * len(part), pa.int64()), pa.array([neg[k] for k in part], pa.int64())], names=["f", "p", "n"])

    total = rows.mapInArrow(count, "f string, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    total = total.filter((F.col("f") == "") | ((F.col("p") >= MIN_DOCS) & (F.col("p") > 2 * F.col("n"))))
    got = {r["f"]: (r["p"], r["n"]) for r in total.collect()}
    n_pos, n_neg = got.pop("", (0, 0))
    words, stems = {}, {}
    for f, (p, n) in got.items():
        odds = math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1))
        if odds >= MIN_ODDS and _tail(p, n, n_pos / (n_pos + n_neg)) < CHANCE:
            (stems if f[-1] == "*" else words)[f.rstrip("*")] = odds
    grammar = Grammar(words, stems)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [round(grammar.raw(t.as_py()), 1) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), b.column(2)], names=["x", "y"])

    # a histogram of log weights: a few hundred bins at most
    bins = rows.mapInArrow(score, "x double, y int").groupBy("x").agg(F.sum(F.col("y").cast("double")).alias("p"), F.count("*").alias("n")).collect()
    if bins and (words or stems):
        x = np.repeat([r["x"] for r in bins], 2)
        y = np.tile([1.0, 0.0], len(bins))
        w = np.array([v for r in bins for v in (r["p"], r["n"] - r["p"])])
        grammar.curve = _fit_weighted(x, y, w)
    return grammar


def _fit_weighted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    scale = max(1.0, w.sum() / 5000)
    reps = np.maximum(np.round(w / scale), (w > 0)).astype(int)
    return _fit(np.repeat(x, reps), np.repeat(y, reps))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Defined cases: null and empty texts get the curve's value where nothing matches; repeated
    rows: a result each; other columns are ignored; an empty table gives an empty result.
    """
    model = (grammar.words, grammar.stems, grammar.curve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(*model)
        for b in batches:
            s = [round(g.score(t.as_py()), 6) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
