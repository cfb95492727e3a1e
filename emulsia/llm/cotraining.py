"""Quality classifier by co-training: a text view and a metadata view teach each other, and both score all documents.

A document is good if its label says quality 1 and not toxic. The text view sees hashed words and shares of symbols,
capitals, repeats and so on; the metadata view sees language, source and length. A view is a logistic model whose hashed
features are weighted by how much more often good documents have them than others do (a log ratio of document counts),
which is what a view learns from documents without a label: over ROUNDS rounds each view labels all documents that have
no label in the sample, and those it is sure of are counted for the other view. Each round is one pass over the whole
table on the executors; only sums of counts come back, a row a view, label and feature. The views are then calibrated on
labelled documents that neither was trained on, a logistic model of both calibrated logits combines them, and the score
from which a document stays is the one that KEEP_GOOD of the held-out good documents reach.

The one bounded sample, a parameter: at most `labelled` labelled documents, those with the least hashes of their ids, are
used for fitting. Features, pseudo-labels and scores cover whole texts of all documents; the only things sent to executors
are the views' weights (2**BITS and 2**META_BITS numbers).

Defined results: a null text is empty and a very long one is read whole; null metadata is a value of its own; unlabelled
ids (null too) are scored like any; a document with several labels is good if all say so; without labels of both classes
every score is the share of good labels (1 without labels); equal rows get equal scores; columns besides those used
aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, META_BITS = 16, 10
ROUNDS = 2
SURE = 0.95
#: A hashed feature's first weight, in units of its log ratio: metadata has few features, so that their ratios nearly decide.
START = {"text": 0.02, "meta": 1.0}
#: A document stays from the score on that this share of the held-out good documents reaches, which is between these two.
KEEP_GOOD, KEEP = 0.995, (0.5, 0.9)
_SYMBOLS = re.compile(r"[#*$%&|<>!]")
_DENSE = 8

Row = tuple[list[int], list[float]]


def text_features(text: str | None) -> Row:
    """Indices and values: a constant, shares, and log counts of hashed words."""
    words = (text or "").split()
    n = max(1, len(words))
    counts = Counter(words)
    chars = max(1, len(text or ""))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    dense = [1.0, min(3.0, len(_SYMBOLS.findall(text or "")) / n), sum(map(str.isupper, words)) / n, repeats / n, len(counts) / n, math.log1p(n) / 10, min(3.0, chars / n / 10), 1 - len(set(lines)) / max(1, len(lines))]
    size = (1 << BITS) - _DENSE
    hashed: dict[int, float] = {}
    for w, c in counts.items():
        i = _DENSE + zlib.crc32(w.lower().strip(".,;:!?\"'()").encode()) % size
        hashed[i] = hashed.get(i, 0.0) + c
    return [*range(_DENSE), *hashed], [*dense, *(0.3 * math.log1p(c) for c in hashed.values())]


def meta_features(lang: str | None, source: str | None, length: int | None) -> Row:
    size = (1 << META_BITS) - 8
    bucket = min(24, int(length).bit_length()) if length is not None and length >= 0 else "none"
    names = [f"lang={lang}", f"source={source}", f"length={bucket}", f"lang={lang},length={bucket}"]
    return [0, *(8 + zlib.crc32(x.encode()) % size for x in names)], [1.0] * 5


@dataclass
class Sparse:
    """Rows of indices and values."""

    indices: np.ndarray
    values: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(rows: list[Row]) -> Sparse:
        return Sparse(np.array([i for r in rows for i in r[0]], dtype=np.int64), np.array([v for r in rows for v in r[1]]), np.array([len(r[0]) for r in rows], dtype=np.int64))

    @staticmethod
    def of_lists(indices: pa.ChunkedArray, values: pa.ChunkedArray) -> Sparse:
        a, b = ([c for c in x.chunks if len(c)] for x in (indices, values))
        flat = lambda chunks, kind: np.concatenate([np.zeros(0, dtype=kind), *[c.flatten().to_numpy(zero_copy_only=False).astype(kind) for c in chunks]])
        return Sparse(flat(a, np.int64), flat(b, np.float64), np.concatenate([np.zeros(0, dtype=np.int64), *[np.diff(c.offsets.to_numpy()).astype(np.int64) for c in a]]))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        return np.add.reduceat(weights[self.indices] * self.values, starts) if len(self.sizes) else np.zeros(0)

    def pull(self, errors: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.indices, weights=self.values * np.repeat(errors, self.sizes), minlength=n)

    def take(self, which: np.ndarray) -> Sparse:
        starts = np.concatenate(([0], np.cumsum(self.sizes)))
        at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in which]) if len(which) else np.zeros(0, dtype=np.int64)
        return Sparse(self.indices[at], self.values[at], self.sizes[which])

    def times(self, factors: np.ndarray) -> Sparse:
        return Sparse(self.indices, self.values * factors[self.indices], self.sizes)

    def documents(self, which: np.ndarray, n: int) -> np.ndarray:
        """How many of the documents have each feature."""
        return np.bincount(self.indices[np.repeat(which, self.sizes)], minlength=n).astype(float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: Sparse, y: np.ndarray, start: np.ndarray, steps: int = 300, l2: float = 1e-4, rate: float = 0.3) -> np.ndarray:
    """Weights by Adagrad on the whole sample, drawn to `start`; both classes weigh the same."""
    w, seen = start.copy(), np.full(len(start), 1e-8)
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    for _ in range(steps):
        g = x.pull((_sigmoid(x.dot(w)) - y) * weight, len(w)) + l2 * (w - start)
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def fit_line(columns: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression on few dense columns (a constant is added), by Newton steps."""
    x = np.column_stack([columns, np.ones(len(columns))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        w -= np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + 1e-3 * np.eye(len(w)), x.T @ (p - y) + 1e-3 * w)
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_line: np.ndarray
    meta_line: np.ndarray
    both: np.ndarray
    cut: float = KEEP[0]
    prior: float | None = None

    def scores(self, text: Sparse, meta: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.prior is not None:
            same = np.full(len(text.sizes), self.prior)
            return same, same, same
        a = text.dot(self.text) * self.text_line[0] + self.text_line[1]
        b = meta.dot(self.meta) * self.meta_line[0] + self.meta_line[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(a * self.both[0] + b * self.both[1] + self.both[2])


SIZES = {"text": 1 << BITS, "meta": 1 << META_BITS}
DENSE = {"text": _DENSE, "meta": 1}


@dataclass
class Counts:
    """Documents with each feature, and all documents, of the two labels (0: not good)."""

    features: np.ndarray
    documents: np.ndarray

    @staticmethod
    def of(x: Sparse, y: np.ndarray, n: int) -> Counts:
        return Counts(np.stack([x.documents(y < 0.5, n), x.documents(y > 0.5, n)]), np.array([(y < 0.5).sum(), (y > 0.5).sum()], dtype=float))

    def with_taught(self, more: Counts) -> Counts:
        return Counts(self.features + more.features, self.documents + more.documents)

    def ratios(self, dense: int) -> np.ndarray:
        """The log of how much more often good documents have a feature; 1 for dense ones."""
        out = np.log((self.features[1] + 1) / (self.documents[1] + 2)) - np.log((self.features[0] + 1) / (self.documents[0] + 2))
        out[:dense] = 1.0
        return out


def fit_view(view: str, x: Sparse, y: np.ndarray, counts: Counts) -> np.ndarray:
    """A view's weights for plain features, from those for features times their log ratios."""
    ratios = counts.ratios(DENSE[view])
    start = np.full(SIZES[view], START[view])
    start[: DENSE[view]] = 0.0
    return fit_logistic(x.times(ratios), y, start) * ratios


def co_train(views: dict[str, Sparse], y: np.ndarray, teach: Callable[[Model], dict[str, Counts]], rounds: int = ROUNDS) -> Model:
    """The model from labelled views; teach gives the counts that each view gets from the other over all unlabelled documents."""
    if not len(y) or y.min() == y.max():
        return Model(*[np.zeros(1)] * 5, prior=float(y.mean()) if len(y) else 1.0)
    train, held = np.flatnonzero(np.arange(len(y)) % 4 != 0), np.flatnonzero(np.arange(len(y)) % 4 == 0)
    if len(set(y[held])) < 2 or len(set(y[train])) < 2:
        train = held = np.arange(len(y))
    own = {v: Counts.of(x.take(train), y[train], SIZES[v]) for v, x in views.items()}
    parts = {v: (x.take(train), x.take(held)) for v, x in views.items()}

    def fitted(counts: dict[str, Counts]) -> Model:
        weights = {v: fit_view(v, parts[v][0], y[train], counts[v]) for v in parts}
        scores = {v: parts[v][1].dot(weights[v]) for v in parts}
        # sure by the probability on held-out labels: a view that can't tell the classes apart teaches nothing
        lines = {v: fit_line(s[:, None], y[held]) for v, s in scores.items()}
        logits = np.column_stack([scores[v] * lines[v][0] + lines[v][1] for v in ("text", "meta")])
        both = fit_line(logits, y[held])
        good = _sigmoid(logits[y[held] > 0.5] @ both[:2] + both[2])
        return Model(weights["text"], weights["meta"], lines["text"], lines["meta"], both, float(np.clip(np.quantile(good, 1 - KEEP_GOOD), *KEEP)))

    model = fitted(own)
    for _ in range(rounds):
        taught = teach(model)
        if not any(t.documents.any() for t in taught.values()):
            break
        model = fitted({v: own[v].with_taught(taught[v]) for v in own})
    return model


_NEEDED = ["text", "lang", "source", "length"]


def _rows(b: pa.RecordBatch) -> tuple[list[Row], list[Row]]:
    text, lang, source, length = (b.column(c).to_pylist() for c in _NEEDED)
    return list(map(text_features, text)), list(map(meta_features, lang, source, length))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, meta = _rows(b)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("good"), *[pa.array([r[k] for r in v], pa.list_(t)) for v in (text, meta) for k, t in ((0, pa.int32()), (1, pa.float32()))]], names=["doc_id", "good", "ti", "tv", "mi", "mv"])


def _taught(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Counts (view, label, feature, n) of a task's documents that a view is sure of, for the other view; feature -1 counts
    documents."""
    found = {(v, k): np.zeros(SIZES[v] + 1, dtype=np.int64) for v in SIZES for k in (0, 1)}
    for whole in batches:
        for b in [whole.slice(i, 512) for i in range(0, whole.num_rows, 512)]:
            views = dict(zip(("text", "meta"), map(Sparse.of, _rows(b))))
            text, meta, _ = model.scores(views["text"], views["meta"])
            for pupil, p in (("meta", text), ("text", meta)):
                for label, sure in ((0, p <= 1 - SURE), (1, p >= SURE)):
                    found[pupil, label][:-1] += views[pupil].documents(sure, SIZES[pupil]).astype(np.int64)
                    found[pupil, label][-1] += int(sure.sum())
    for (v, k), n in found.items():
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(at)), pa.array([k] * len(at), pa.int32()), pa.array(np.where(at == SIZES[v], -1, at), pa.int32()), pa.array(n[at], pa.int64())], names=["view", "label", "feature", "n"])


def teacher(docs: DataFrame) -> Callable[[Model], dict[str, Counts]]:
    """A round of teaching over docs: one pass, whose sums come to the driver."""

    def teach(model: Model) -> dict[str, Counts]:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        sums = docs.select(*_NEEDED).mapInArrow(lambda b: _taught(b, shared.value), "view string, label int, feature int, n long").groupBy("view", "label", "feature").agg(F.sum("n").alias("n"))
        # at most a row for each view, label and feature
        rows = sums.toArrow()
        shared.unpersist()
        out = {v: Counts(np.zeros((2, SIZES[v])), np.zeros(2)) for v in SIZES}
        for view, label, feature, n in zip(*(rows.column(c).to_pylist() for c in ("view", "label", "feature", "n"))):
            if feature < 0:
                out[view].documents[label] += n
            else:
                out[view].features[label, feature] += n
        return out

    return teach


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in [whole.slice(i, 512) for i in range(0, whole.num_rows, 512)]:
            text, meta = map(Sparse.of, _rows(b))
            a, m, both = model.scores(text, meta)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(a), pa.array(m), pa.array(both), pa.array(both >= model.cut)], names=["doc_id", "text_score", "meta_score", "score", "keep"])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 8000, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """docs has doc_id, text, lang, source, length."""
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("double").alias("good")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("__id"), good).groupBy("__id").agg(F.min("good").alias("good"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(labelled)
    # at most `labelled` ids
    sample = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "good", *_NEEDED).mapInArrow(_featured, f"doc_id {key}, good double, ti array<int>, tv array<float>, mi array<int>, mv array<float>").toArrow()
    ids, good_of = rows.column("doc_id").to_pylist(), rows.column("good").to_pylist()
    ranked = np.array(sorted(range(len(ids)), key=lambda i: (zlib.crc32(repr(ids[i]).encode()), repr(ids[i]))), dtype=np.int64)
    views = {n: Sparse.of_lists(rows.column(f"{v}i"), rows.column(f"{v}v")).take(ranked) for n, v in (("text", "t"), ("meta", "m"))}
    # every document that isn't in the sample is taught from; only the sample's ids are sent
    rest = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"), "left_anti")
    return co_train(views, np.array([good_of[i] for i in ranked]), teacher(rest), rounds)


def score(docs: DataFrame, labels: DataFrame, labelled: int = 8000, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", length: str = "n_chars") -> DataFrame:
    """Per row of docs: key, text_score, meta_score, score and keep (a score from the model's cut on)."""
    lean = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(length).cast("long").alias("length"))
    weights = docs.sparkSession.sparkContext.broadcast(fit(lean, labels, labelled))
    schema = f"doc_id {lean.schema['doc_id'].dataType.simpleString()}, text_score double, meta_score double, score double, keep boolean"
    return lean.mapInArrow(lambda b: _scored(b, weights.value), schema).withColumnsRenamed({"doc_id": key})
