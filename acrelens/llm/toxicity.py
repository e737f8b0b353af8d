"""Toxicity by a string-kernel support vector machine on Nystrom landmarks.

Kernel: gap-weighted subsequences of three characters; a subsequence spread over s
characters counts DECAY^(s - 3), up to SPAN of them, so a word keeps most of its
likeness when characters are put into it. A unit is a word without its outer
punctuation, or a run of three or more single characters, which are joined. The kernel
of two units is normalised; that of two sentences is the sum over their units.

Fitting, on the driver, from a bounded sample of labelled documents (TRAIN_DOCS and
CALIBRATION_DOCS by hash order, and as many of their rows where a doc_id repeats; SENTENCES
of their sentences): a sentence has its document's label, and each is an example of the
machine. A sentence of over SENTENCE_CHARS characters is several, cut between words (a
longer word by itself in stretches of that length). LANDMARKS,
which are sentences of a single unit, span the Nystrom space, half of them from units
that stand unevenly in both kinds of sentences and half from all others; they are a
basis and have no label. In that space a linear machine with squared hinge loss is
fitted to the labelled sentences. A clean sentence on the wrong side costs CLEAN_COST
times a toxic one, as most sentences of a toxic document are not toxic themselves. The
kernel has explicit features (three character codes of 32), so the machine folds into
one weight per feature and a unit is scored without touching the landmarks.

Scoring: every unit of the whole text, as the sentence that it alone would be; a
logistic rule, fitted on CALIBRATION_DOCS other labelled documents, turns the share of
units over the margin, their number and the furthest margin into a probability.

Labels are learnt only from documents whose crc32(doc_id) mod 5 is not 0.

Cases: null and empty texts have no unit and get the rule's score for none. A null
doc_id is scored and not held out. Repeated rows come back repeated. Several labels
of one document count as the highest. Without labels of both kinds every score is
the share of toxic labels.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelens.llm.worker import remembered, small_batches

TRAIN_DOCS = 3000
CALIBRATION_DOCS = 3000
SENTENCES = 24_000
SENTENCE_CHARS = 400
LANDMARKS = 256
CLEAN_COST = 2.0
DECAY = 0.7
SPAN = 8
LONGEST = 24
_LIMIT = 200_000
_FEATURES = 1 << 15
#: What is known of a text after its units are scored.
FACTS = ("over", "well_over", "excess", "number", "furthest")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_SENTENCE = "[.!?]+\\s+|\\n+"
_STRETCH = rf"(?s)\S.{{0,{SENTENCE_CHARS - 1}}}(?=\s|\z)|\S{{1,{SENTENCE_CHARS}}}"


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 5


def unit_of(word: str) -> str:
    """A lower-case word without the punctuation around it."""
    if word.isalnum():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def units(text: str) -> tuple[list[str], list[str]]:
    """The words of a text in lower case, and its runs of single characters, joined."""
    low = text.lower()
    return low.split(), ["".join(m.split()) for m in _SPACED.findall(low)]


@cache
def _triples(n: int) -> tuple[np.ndarray, ...]:
    found = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    i, j, k = np.array(found).T
    return i, j, k, DECAY ** (k - i - 2).astype(np.float64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and normalised values, a row per unit; all of one length of at least three."""
    codes = np.array([[_code(c) for c in w] for w in words])
    i, j, k, value = _triples(codes.shape[1])
    f = codes[:, i] * 1024 + codes[:, j] * 32 + codes[:, k]
    order = np.argsort(f, axis=1)
    f = np.take_along_axis(f, order, 1)
    v = value[order]
    new = np.ones(f.shape, dtype=bool)
    new[:, 1:] = f[:, 1:] != f[:, :-1]
    sums = np.add.reduceat(v.ravel(), np.flatnonzero(new))
    squares = np.add.reduceat(sums * sums, np.concatenate([[0], np.cumsum(new.sum(axis=1))[:-1]]))
    return f, v / np.sqrt(squares)[:, None]


def windows(unit: str) -> list[str]:
    """A unit as it is, or a very long one in overlapping parts."""
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[a : a + LONGEST] for a in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


class Machine:
    """Weights of the folded machine and of the logistic rule."""

    def __init__(self, weight: np.ndarray, bias: float, rule: np.ndarray, share: float):
        self.weight, self.bias, self.rule, self.share = weight, bias, rule, share
        self.mark = hashlib.sha256(weight.tobytes() + repr(bias).encode()).hexdigest()  # equal for equal margins

    def margins(self, found: list[str]) -> dict[str, float]:
        """The margin of every unit; under three characters: -1."""
        parts: dict[int, set[str]] = {}
        for u in found:
            for w in windows(u):
                parts.setdefault(len(w), set()).add(w)
        margin: dict[str, float] = {}
        for n, group in parts.items():
            listed = sorted(group)
            if n < 3:
                margin |= dict.fromkeys(listed, -1.0)
                continue
            for at in range(0, len(listed), 500):
                f, v = features(listed[at : at + 500])
                margin |= zip(listed[at : at + 500], ((self.weight[f] * v).sum(axis=1) + self.bias).tolist())
        return {u: max(margin[w] for w in windows(u)) for u in found}

    def score(self, facts: np.ndarray) -> np.ndarray:
        if not len(self.rule):
            return np.full(len(facts), self.share)
        return 1 / (1 + np.exp(-np.clip(facts @ self.rule[:-1] + self.rule[-1], -30, 30)))


class _Known(dict):
    """Margins of words; emptied between batches when it holds _LIMIT entries."""

    def learn(self, machine: Machine, words: set[str]) -> None:
        if len(self) > _LIMIT:
            self.clear()
        missing = [w for w in words if w not in self]
        by_word = {w: unit_of(w) for w in missing}
        margin = machine.margins(list(set(by_word.values())))
        self.update((w, margin[u]) for w, u in by_word.items())


def facts_of(texts: pa.Array, machine: Machine, known: _Known) -> np.ndarray:
    """Per text: what share of the units is over the margin, over half of it, and by how much; how many are; the furthest."""
    out = np.zeros((len(texts), len(FACTS)))
    for at in range(0, len(texts), 200):
        split = [units(t or "") for t in texts.slice(at, 200).to_pylist()]
        split = [w + spaced for w, spaced in split]
        known.learn(machine, set().union(*split))
        for i, words in enumerate(split, at):
            if words:
                m = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))
                shares = np.array([(m > 0).mean(), (m > 0.5).mean(), np.clip(m, 0, 1).mean()])
                out[i] = *np.minimum(1.0, 25 * shares), np.log1p((m > 0.5).sum()) / 4, np.clip(m.max(), -1, 1.5)
            else:
                out[i, -1] = -1.0
    return out


def facts(docs: DataFrame, machine: Machine, score: bool) -> DataFrame:
    """doc_id with the facts of its text, or with its score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(("margins", machine.mark), _Known)
        for batch in small_batches(batches):
            found = facts_of(batch.column(1), machine, known)
            columns = [machine.score(found)] if score else list(found.T)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "score"] if score else ["doc_id", *FACTS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double" if score else f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FACTS))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS, sentences: int = SENTENCES) -> Machine:
    """A machine from a bounded sample; see the module's text."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    nothing = Machine(np.zeros(_FEATURES), 0.0, np.zeros(0), share)
    if not (counts.get(0) and counts.get(1)):
        return nothing
    total = train_docs + calibration_docs
    picked = []  # (doc_id, label, place) of at most train_docs + calibration_docs documents, half of them toxic if there are as many
    for label in (0, 1):
        ids = known.filter(F.col("_toxic") == label).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(total // 2).collect()
        picked += [(r["doc_id"], label, place % 2) for place, r in enumerate(ids)]
    chosen = docs.sparkSession.createDataFrame(picked, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _toxic int, _part int")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")  # at most `total` rows are broadcast
    sentence = sample.filter("_part = 0").select("doc_id", "_toxic", F.explode(F.split("text", _SENTENCE)).alias("sentence"))
    sentence = sentence.select("doc_id", "_toxic", F.explode(F.when(F.length("sentence") <= SENTENCE_CHARS, F.array("sentence")).otherwise(F.regexp_extract_all("sentence", F.lit(_STRETCH), F.lit(0)))).alias("sentence"))
    rows = sentence.orderBy(F.xxhash64("doc_id", "sentence"), "doc_id", "sentence").limit(sentences).select("_toxic", "sentence").collect()
    weight, bias = _fit_sentences([r["_toxic"] for r in rows], [r["sentence"] for r in rows])
    del rows
    machine = Machine(weight, bias, np.zeros(0), share)
    known = facts(sample.filter("_part = 1"), machine, score=False).join(F.broadcast(chosen), "doc_id").select("doc_id", *FACTS, "_toxic")
    told = known.orderBy(F.xxhash64("doc_id", *FACTS), "doc_id", *FACTS).limit(calibration_docs).collect()
    told = [r[1:] for r in sorted(told)]
    y = np.array([r[-1] for r in told])
    if len(set(y.tolist())) < 2:
        return nothing
    x = np.array([r[: len(FACTS)] for r in told])
    machine.rule = _logistic(x, y)
    return machine


def _fit_sentences(labels: list[int], sentences: list[str]) -> tuple[np.ndarray, float]:
    """Weight of each feature and bias of the machine; see the module's text."""
    number: dict[str, int] = {}
    at, unit = [], []  # a row per unit of a sentence
    for i, sentence in enumerate(sentences):
        words, spaced = units(sentence)
        for u in map(unit_of, words + spaced):
            for w in windows(u):
                if len(w) >= 3:
                    at.append(i)
                    unit.append(number.setdefault(w, len(number)))
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    if not number or len(set(labels)) < 2:
        return np.zeros(_FEATURES), -1.0
    at, unit, names = np.array(at), np.array(unit), list(number)
    seen = np.zeros((2, len(names)))
    np.add.at(seen, ((y[at] > 0).astype(int), unit), 1)
    total, (clean, toxic) = seen.sum(axis=1, keepdims=True), seen
    expected = seen.sum(axis=0) * total[1, 0] / total.sum()
    uneven = np.argsort(-np.abs(toxic - expected) / np.sqrt(expected + 1), kind="stable")[: LANDMARKS // 2]
    others = np.setdiff1d(np.arange(len(names)), uneven)
    common = others[np.argsort(-seen.sum(axis=0)[others], kind="stable")]
    basis = np.concatenate([uneven, common[:: max(1, 2 * len(common) // LANDMARKS)][: LANDMARKS // 2]])
    z = _dense([names[i] for i in basis])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    root = vectors @ np.diag(np.maximum(values, 1e-4) ** -0.5) @ vectors.T
    x = np.zeros((len(sentences), len(basis)), dtype=np.float32)
    order = np.argsort(unit, kind="stable")
    start = np.searchsorted(unit[order], np.arange(len(names) + 1))
    for low in range(0, len(names), 2000):
        high = min(low + 2000, len(names))
        here = order[start[low] : start[high]]
        np.add.at(x, at[here], (_products(names[low:high], z))[unit[here] - low])
    x = np.hstack([x.astype(np.float64) @ root, np.ones((len(x), 1))])
    importance = np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()) / CLEAN_COST, 1.0)
    w = _squared_hinge(x, y, importance)
    return (root @ w[:-1]) @ z.astype(np.float64), float(w[-1])


def _dense(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), _FEATURES), dtype=np.float32)
    for row, w in zip(out, words):
        f, v = features([w])
        np.add.at(row, f[0], v[0])
    return out


def _products(words: list[str], z: np.ndarray) -> np.ndarray:
    """Kernel values of words against landmarks with dense features z."""
    out = np.zeros((len(words), len(z)), dtype=np.float32)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    columns = np.ascontiguousarray(z.T)
    for at in by_length.values():
        for a in range(0, len(at), 50):
            f, v = features([words[i] for i in at[a : a + 50]])
            out[at[a : a + 50]] = np.einsum("wfl,wf->wl", columns[f], v.astype(np.float32))
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear machine by Newton steps on the rows inside the margin."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(30):
        inside = y * (x @ w) < 1
        a = x[inside] * importance[inside, None]
        after = np.linalg.solve(keep + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(after, w, atol=1e-8):
            break
        w = after
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return facts(docs, fit(docs, labels), score=True).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; all columns stay."""
    machine = fit(docs, labels)
    schema, names, at = docs.schema, docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(("margins", machine.mark), _Known)
        for batch in small_batches(batches):
            score = machine.score(facts_of(batch.column(at), machine, known))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(score < 0.5)) for c in batch.columns], names)

    return docs.mapInArrow(run, schema)
