"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insults (a lexicon learned from labels), threats, targets, negations and
words of reported speech. Five weighted transducers read a clause's classes one after another, each the classes that the one before
writes: the insult transducer passes the weight of insults alone, the target transducer
raises insults next to a target, the threat transducer writes a menace where a threat and a target meet, the negation
transducer lowers insults and menaces behind a negation, and the reported-speech transducer lowers what follows a word of
saying. ``compose`` multiplies weights over product states, so all five run as one
table; a clause's score is what the composed machine emits, and words are never scored alone. The factors are
constants; what they are worth is learned with the curve. A logistic curve over a text's clause scores (their sum, the largest and the rate a
word) gives the probability.

Learning uses at most ``TRAIN_ROWS`` labelled texts (a documented bound: those of the smallest id hashes),
whole. Two thirds of them teach the lexicon: whole words and word beginnings that stand in ``CONTEXTS``
different contexts of toxic texts and are far rarer in others (Spark joins the counts of both kinds, so only the
lexicon reaches the driver); copies of one text give one context each word, so they teach nothing. The last third fits the curve.

Defined results: a null or empty text has no clauses and the curve's lowest score; without labelled texts of both kinds
scores are 0; null labels aren't learned from; repeated rows each come back; labels, ids, languages and sources
are never inputs of a score; of several labels of one id the greatest counts; terms of equal odds are all kept; an empty table gives an
empty result; other columns, whatever their names, are not read; very long texts are read whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm import common as C

TRAIN_ROWS = 12000
CONTEXTS = 5
LEAST_ODDS = 2.5
PREFIXES = (4, 5, 6)
REACH = 3
WITH_TARGET, NEGATED, REPORTED, THREATENED = 1.5, 0.4, 0.6, 4.0
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP, MENACE = range(8)
KINDS = 8
# Function words of English, German, French and Spanish, and words of threats with their regular endings.
WORDS = {
    THREAT: [w + e for w in "kill murder destroy shoot hurt".split() for e in ("", "s", "ed", "ing")]
    + "stab stabs stabbed stabbing beat beats beaten beating töten töte tötet getötet umbringen umbringe umgebracht schlagen schlage schlägt "
      "verletzen verletze tuer tue tué frapper frappe blesser blessé matar mato mataré herir golpear".split(),
    TARGET: "you your yourself they them he she him her people du dich dir ihr euch sie tu toi te vous ils elles tú ti usted ustedes vosotros ellos ellas".split(),
    NEGATION: "not never no isn aren wasn don doesn nicht nie kein keine keinen niemals ne pas jamais aucun nunca jamás tampoco".split(),
    REPORT: "said says called wrote quoted claimed reported sagte schrieb nannte zitierte dit écrit appelé cité dijo escribió llamó citó".split(),
}
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")


class Transducer:
    """For each state and class read: the next state, the class written and the factor on the symbol's weight. State 0 is the start."""

    def __init__(self, next_: np.ndarray, writes: np.ndarray, factor: np.ndarray):
        self.next, self.writes, self.factor = next_, writes, factor

    @classmethod
    def of(cls, states: int, rule) -> "Transducer":
        """From ``rule(state, kind)``, which gives the next state, and if they change the class written and the factor."""
        next_, writes, factor = np.zeros((states, KINDS), dtype=np.int64), np.zeros((states, KINDS), dtype=np.int64), np.ones((states, KINDS))
        for state in range(states):
            for kind in range(KINDS):
                told = rule(state, kind)
                told = told if isinstance(told, tuple) else (told,)
                next_[state, kind] = told[0]
                writes[state, kind] = told[1] if len(told) > 1 else kind
                factor[state, kind] = told[2] if len(told) > 2 else 1.0
        return cls(next_, writes, factor)

    def apply(self, kinds: list[int], weights: list[float]) -> tuple[list[int], list[float]]:
        """What it writes for one clause."""
        state, out, scaled = 0, [], []
        for kind, weight in zip(kinds, weights, strict=True):
            out.append(int(self.writes[state, kind]))
            scaled.append(weight * float(self.factor[state, kind]))
            state = int(self.next[state, kind])
        return out, scaled


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that does what ``second`` does with what ``first`` writes."""
    many = len(second.next)
    pair = np.arange(len(first.next) * many)
    one, two = pair // many, pair % many
    read = first.writes[one]
    return Transducer(first.next[one] * many + second.next[two[:, None], read], second.writes[two[:, None], read], first.factor[one] * second.factor[two[:, None], read])


def _after(kind: int, changed: tuple[int, ...], by: float, reach: int | None) -> Transducer:
    """Changes the weight of classes within ``reach`` words (None: to the clause's end) after a word of a class."""
    longest = 1 if reach is None else reach

    def rule(state: int, read: int):
        left = longest if read == kind else 0 if read == STOP else state if reach is None else max(state - 1, 0)
        return left, read, by if state and read in changed else 1.0
    return Transducer.of(longest + 1, rule)


def _threats() -> Transducer:
    """Writes a menace for a target soon after a threat, or a threat soon after a target."""
    n = REACH + 1

    def rule(state: int, read: int):
        threat, target = divmod(state, n)
        if (read == TARGET and threat) or (read == THREAT and target):
            return 0, MENACE
        threat = REACH if read == THREAT else 0 if read == STOP else max(threat - 1, 0)
        target = REACH if read == TARGET else 0 if read == STOP else max(target - 1, 0)
        return threat * n + target
    return Transducer.of(n * n, rule)


def transducers() -> list[Transducer]:
    """Insult, target, threat, negation and reported speech, in the order they read."""
    insults = Transducer.of(1, lambda state, read: (0, read, 1.0 if read in (INSULT, THREAT, TARGET) else 0.0))
    return [insults, _after(TARGET, (INSULT,), WITH_TARGET, REACH), _threats(), _after(NEGATION, (INSULT, MENACE), NEGATED, REACH),
            _after(REPORT, (INSULT, MENACE), REPORTED, None)]


def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, factor on an insult's weight, menace emitted) of the composed machine, by state and class."""
    whole = functools.reduce(compose, transducers())
    return whole.next, np.where(whole.writes == INSULT, whole.factor, 0.0), np.where(whole.writes == MENACE, whole.factor * THREATENED, 0.0)


class Lexicon(dict):
    """Class and weight of a word, remembered up to a bound: word -> (class, weight)."""

    def __init__(self, terms: dict[str, float], most: int = 300_000):
        super().__init__()
        self.terms, self.most = terms, most
        self.fixed = {w: (kind, 0.0) for kind, words in WORDS.items() for w in words} | {c: (STOP, 0.0) for c in ".!?;:\n"}

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        found = self.fixed.get(word)
        if found is None:
            weight = max((self.terms.get(t, 0.0) for t in terms_of(word)), default=0.0)
            found = (INSULT, weight) if weight > 0 else (OTHER, 0.0)
        self[word] = found
        return found


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def features(text: str, lexicon: Lexicon, tables) -> tuple[float, float, float]:
    """(log of 1 + sum, largest, sum per hundred words) of the clauses' scores."""
    tokens = TOKEN.findall(text.lower())
    read = [lexicon[t] for t in tokens]
    kinds = np.fromiter((r[0] for r in read), dtype=np.int8, count=len(read))
    hot = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
    if not len(hot):
        return 0.0, 0.0, 0.0
    next_, factor, threat = tables
    stops = np.flatnonzero(kinds == STOP)
    total = largest = 0.0
    # Clauses without an insult or a threat emit nothing.
    for c in np.unique(np.searchsorted(stops, hot)).tolist():
        first = int(stops[c - 1]) + 1 if c else 0
        last = int(stops[c]) if c < len(stops) else len(read)
        state, score = 0, 0.0
        for kind, weight in read[first:last]:
            score += weight * factor[state, kind] + threat[state, kind]
            state = next_[state, kind]
        total += score
        largest = max(largest, score)
    return float(np.log1p(total)), float(largest), float(100 * total / max(1, len(read) - len(stops)))


class Grammar:
    def __init__(self, terms: dict[str, float], curve: list[float] | None):
        self.terms, self.curve = terms, curve

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve[1:]) + self.curve[0], -30, 30)))


def _context_rows():
    """Rows (term, n, contexts) of a slab: texts with the term, and a 64-bit set of the words before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        for whole in batches:
            for batch in C.slabs(whole, most=C.WIDE_SLAB_BYTES):
                many: dict[str, int] = {}
                bits: dict[str, int] = {}
                for text in batch.column(1).to_pylist():
                    seen: set[str] = set()
                    before = ""
                    for word in TOKEN.findall((text or "").lower()):
                        bit = 1 << (zlib.crc32(before.encode()) & 63)
                        before = word
                        for term in terms_of(word):
                            seen.add(term)
                            bits[term] = bits.get(term, 0) | bit
                    for term in seen:
                        many[term] = many.get(term, 0) + 1
                names = list(many)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([many[t] for t in names], pa.int64()), pa.array([bits[t] - (1 << 64) if bits[t] >> 63 else bits[t] for t in names], pa.int64())],
                                                 names=["term", "n", "contexts"])
    return run


def _features_of(terms: dict[str, float], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, tables = Lexicon(terms), machine()
        for whole in batches:
            for batch in C.slabs(whole, most=C.WIDE_SLAB_BYTES):
                rows = [features(t or "", lexicon, tables) for t in batch.column(1).to_pylist()]
                x = np.array(rows, dtype=np.float64).reshape(len(rows), 3)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array(x[:, i]) for i in range(3)], names=[*keep, "total", "largest", "rate"])
    return run


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps, classes weighted equally in the middle."""
    x = np.hstack((np.ones((len(x), 1)), x))
    w = np.zeros(x.shape[1])
    ridge = np.array([1e-3, 0.05, 0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-6 * np.eye(len(w)), grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Grammar:
    """Learn the lexicon and the curve from at most ``rows`` labelled documents of ``docs``."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
    draw = F.xxhash64("doc_id", F.lit(13))
    known = C.written(known.orderBy(draw, "doc_id").limit(rows), "labels")
    texts = C.with_small(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), known, "doc_id", "inner", 16)
    sample = C.written(texts.select("toxic", "text", (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(3)) == 0).alias("curve")), "sample")
    teach = sample.where("not curve")
    many = {r.toxic: r.n for r in teach.groupBy("toxic").agg(F.count("*").alias("n")).limit(4).collect()}
    if not many.get(0) or not many.get(1):
        return Grammar({}, None)
    shape = "term string, n long, contexts long"
    agg = (F.sum("n").alias("n"), F.bit_count(F.bit_or("contexts")).alias("contexts"))
    bad = teach.where("toxic = 1").select("toxic", "text").mapInArrow(_context_rows(), shape).groupBy("term").agg(*agg).where(F.col("contexts") >= CONTEXTS)
    good = teach.where("toxic = 0").select("toxic", "text").mapInArrow(_context_rows(), shape).groupBy("term").agg(F.sum("n").alias("good"))
    odds = F.log((F.col("n") + 0.5) / (many[1] + 1)) - F.log((F.coalesce("good", F.lit(0)) + 0.5) / (many[0] + 1))
    chosen = bad.join(good, "term", "left").select("term", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS).toArrow()
    terms = dict(zip(chosen.column("term").to_pylist(), chosen.column("odds").to_pylist(), strict=True))
    # A beginning stands for its longer ones.
    terms = {t: w for t, w in terms.items() if not any(p != t and p in terms for p in terms_of(t.rstrip("*")) if len(p.rstrip("*")) < len(t.rstrip("*")))}
    got = sample.where("curve").select("toxic", "text").mapInArrow(_features_of(terms, ["toxic"]), "toxic int, total double, largest double, rate double").toArrow()
    x = np.stack([got.column(c).to_numpy() for c in ("total", "largest", "rate")], axis=1)
    y = got.column("toxic").to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return Grammar(terms, [-2.0, 2.0, 0.0, 0.0])
    order = np.lexsort((y, *x.T))
    return Grammar(terms, _fit(x[order], y[order]))


def toxicity(docs: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from a half on), largest (its worst clause)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _features_of(grammar.terms, ["doc_id"])(batches):
            x = np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)], axis=1)
            score = grammar.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), batch.column(2)], names=["doc_id", "score", "predicted", "largest"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, largest double")
