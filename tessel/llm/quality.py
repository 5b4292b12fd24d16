"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Random indexing: every token has a sparse ternary index vector that its hash fixes; the vector of a vocabulary entry is the
sum of the index vectors of the tokens within two places of its occurrences in the sample, of unit length, plus
its own index vector. Tokens outside of the vocabulary share an entry per shape (upper case, mark
and so on), so all words have a vector. A document is the mean of its tokens' vectors, standardized; a hidden layer of tanh
units and a logistic output, trained in numpy, give the score, whose temperature is fitted on texts held back
from training.

The model is fitted on a bounded sample of labelled texts (``max_rows``, ``max_bytes``) and applied to all
rows. Only text goes into a score. Tokens that are not among the ``entries`` most frequent of the sample, or occur in it
twice at most, count by their shape.

NULL, empty and blank texts are the zero mean and have a score too; with nothing to learn from all scores are 0.5. Rows with
a NULL doc_id are scored, not learned from; repeated rows are scored alike and learned from once; an empty table gives
no rows; columns beside doc_id and text do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import TABLE_CHARS, labelled_sample, map_batches, row_sums

_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
WINDOW = 2
NONZERO = 4


def tokens(word: str) -> list[str]:
    """Of a white-space-separated word: letters (lower-cased, with a token for upper case), digits, marks."""
    out = []
    for t in _TOKENS.findall(word):
        out.append(t.lower())
        if len(t) > 1 and t.isupper():
            out.append("<UPPER>")
    return out


def shape(token: str) -> str:
    if token[0].isdigit():
        return f"<NUMBER {min(len(token), 6)}>"
    if not token[0].isalpha():
        return f"<MARK {len(set(token)) == 1} {min(len(token), 4)}>"
    return f"<WORD {min(len(token) // 4, 5)}>"


def index_vectors(names: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each token's index vector."""
    seeds = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names], dtype=np.uint64)
    places, signs = np.empty((len(names), NONZERO), np.int64), np.empty((len(names), NONZERO), np.float32)
    for k in range(NONZERO):
        seeds = (seeds + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = seeds ^ (seeds >> np.uint64(29))
        places[:, k] = (mixed >> np.uint64(33)) % np.uint64(dim)
        signs[:, k] = np.where(mixed >> np.uint64(20) & np.uint64(1), 1, -1)
    return places, signs


@dataclass
class QualityModel:
    vocabulary: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.float32))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(64))
    spread: np.ndarray = field(default_factory=lambda: np.ones(64))
    w1: np.ndarray = field(default_factory=lambda: np.zeros((64, 1)))
    b1: np.ndarray = field(default_factory=lambda: np.zeros(1))
    w2: np.ndarray = field(default_factory=lambda: np.zeros(1))
    b2: float = 0.0
    temperature: float = 1.0

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh((pooled - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -40, 40)))


class Pooler:
    """Document vectors; keeps the sums of distinct words' token vectors, up to ``limit`` words or TABLE_CHARS characters."""

    def __init__(self, vocabulary: dict[str, int], vectors: np.ndarray, limit: int = 150_000):
        self.vocabulary, self.vectors, self.limit, self.chars = vocabulary, vectors, limit, 0
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1024, vectors.shape[1] + 1), np.float32)  # of ``row``; doubled when full

    def entry(self, token: str) -> int:
        at = self.vocabulary.get(token)
        return self.vocabulary.get(shape(token), -1) if at is None else at

    def _words(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.row))
        if len(self.row) + len(new) > self.limit or self.chars > TABLE_CHARS:
            self.row.clear()
            self.chars = 0
            new = list(dict.fromkeys(words))
        if new:
            self.chars += sum(map(len, new))
            while len(self.row) + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            entries = [[e for t in tokens(w) if (e := self.entry(t)) >= 0] for w in new]
            n = [len(e) for e in entries]
            flat = np.array([e for x in entries for e in x], dtype=np.int64)
            a, b = len(self.row), len(self.row) + len(new)
            self.row.update(zip(new, range(a, b), strict=True))
            self.rows[a:b, :-1], self.rows[a:b, -1] = row_sums(self.vectors[flat], n), n
        return self.rows[[self.row[w] for w in words]]

    def pool(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]))
        for i, t in enumerate(texts):  # a document at a time, a long one in parts: sums do not depend on the batch
            words = (t or "").split()
            total = np.zeros(self.vectors.shape[1] + 1)
            for a in range(0, len(words), 20_000):
                total += self._words(words[a : a + 20_000]).sum(axis=0, dtype=np.float64)
            if total[-1]:
                out[i] = total[:-1] / total[-1]
        return out


def random_index(texts: list[str], dim: int, entries: int) -> tuple[dict[str, int], np.ndarray]:
    """Vocabulary (the ``entries`` most frequent tokens, then shapes) and the vectors of its entries."""
    streams = [[t for w in text.split() for t in tokens(w)] for text in texts]
    counts = Counter(t for s in streams for t in s)
    frequent = [t for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:entries] if n > 2]
    names = list(dict.fromkeys([*frequent, *sorted({shape(t) for t in counts})]))
    vocabulary = {t: i for i, t in enumerate(names)}
    places, signs = index_vectors(names, dim)
    context = np.zeros(len(names) * dim)
    gap = [-1] * WINDOW  # between documents
    ids = np.array([i for s in streams for i in [*(vocabulary.get(t, -2) if t in vocabulary else vocabulary[shape(t)] for t in s), *gap]], dtype=np.int64)
    for a in range(0, len(ids), 1_000_000):
        for step in range(1, WINDOW + 1):
            left, right = ids[a : a + 1_000_000], ids[a + step : a + step + 1_000_000]
            left = left[: len(right)]
            both = (left >= 0) & (right >= 0)
            for x, y in ((left[both], right[both]), (right[both], left[both])):
                for k in range(NONZERO):
                    context += np.bincount(x * dim + places[y, k], weights=signs[y, k], minlength=len(context))
    context = context.reshape(len(names), dim)
    own = np.zeros((len(names), dim))
    for k in range(NONZERO):
        np.add.at(own, (np.arange(len(names)), places[:, k]), signs[:, k])
    unit = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return vocabulary, (unit + own).astype(np.float32)


def fit(sample: list[tuple[str, int]], dim: int = 64, hidden: int = 24, entries: int = 20_000, epochs: int = 60, seed: int = 11) -> QualityModel:
    """The same sample gives the same model."""
    if not sample:
        return QualityModel()
    vocabulary, vectors = random_index([t for t, _ in sample], dim, entries)
    x = Pooler(vocabulary, vectors).pool([t for t, _ in sample])
    y = np.array([float(q) for _, q in sample])
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    rng = np.random.default_rng(seed)
    mean, spread = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    params = [rng.normal(0, 1 / np.sqrt(dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z, t, step = (x[~held] - mean) / spread, y[~held], 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for a in range(0, len(order), 64):
            part = order[a : a + 64]
            h = np.tanh(z[part] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - t[part]) / len(part)
            back = np.outer(error, params[2]) * (1 - h * h)
            grads = [z[part].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vocabulary, vectors, mean, spread, params[0], params[1], params[2], float(params[3][0]))
    if held.any():
        logits, truth = model.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = lambda s: np.mean(np.logaddexp(0, logits / s) - truth * logits / s)
        model.temperature = float(min(grid, key=loss))
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 16_000_000, **options) -> QualityModel:
    """``labels``: (doc_id, label 0/1); a bounded sample of them is fitted with the texts of ``docs``."""
    return fit(labelled_sample(docs, labels, max_rows, max_bytes), **options)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score in [0, 1] and predicted for each row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded: ``entries`` vectors of ``dim`` numbers

    def make():
        model = shipped.value
        pooler = Pooler(model.vocabulary, model.vectors)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = model.probabilities(pooler.pool(batch.column("text").to_pylist()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return run

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, make, "doc_id bigint, score double, predicted int")
