"""Language identification: averaged hashed subword embeddings and a linear softmax.

Words are the letters of a text's white-space-separated runs, lower-cased, with a border mark at both ends; subwords
are their character pairs and triples, hashed into ``buckets`` embeddings. A text is the average of its subwords'
embeddings; a linear softmax on it gives the language. Embeddings and softmax are trained together by
stochastic gradient descent in numpy, on whole texts and on random stretches of them, so that short texts are known too.
The softmax is calibrated by one temperature, fitted on a part of the sample that is not trained on.
A text is rejected if it has no letter or its calibrated score is far (``reject_margin``) under what all but ``reject_share`` of
those held-back texts reach: texts in two of the languages stay.

The model is fitted on a bounded sample (``max_rows`` texts of ``max_bytes`` together) and applied to all rows.
Texts without a letter, empty or NULL are ``und`` with score 0, as all texts are if nothing could be learned. Rows with a NULL
doc_id are predicted, not learned from; repeated rows are predicted alike and learned from once; an empty table gives
no rows; columns that clash with ``names`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import TABLE_CHARS, labelled_sample, map_batches, row_sums

_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def letters_only(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def subwords(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pairs and triples of each word (letters only), and how many each has, all words at once."""
    joined = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    ends = codes == ord(">")
    word_of = np.cumsum(ends) - ends
    shift = np.uint32(32 - bits)
    pair = ((codes[:-1] * _M1) ^ (codes[1:] * _M2)) * _M3 >> shift
    pair_at = np.flatnonzero(~ends[:-1])
    triple = ((codes[:-2] * _M1) ^ (codes[1:-1] * _M2) ^ (codes[2:] * _M3)) * _M1 >> shift
    triple_at = np.flatnonzero(~ends[:-2] & ~ends[1:-1])
    owner = np.concatenate([word_of[pair_at], word_of[triple_at]])
    order = np.argsort(owner, kind="stable")
    grams = np.concatenate([pair[pair_at], triple[triple_at]])[order].astype(np.int64)
    return grams, np.bincount(owner, minlength=len(words))


@dataclass
class LanguageModel:
    langs: list[str]
    bits: int
    table: np.ndarray  # (buckets, languages): what a subword adds to the logits before averaging
    bias: np.ndarray
    temperature: float
    reject_below: float


class Scorer:
    """Applies a model; keeps the sums of distinct words, up to ``limit`` of them or TABLE_CHARS characters."""

    def __init__(self, model: LanguageModel, limit: int = 300_000):
        self.model, self.limit, self.chars = model, limit, 0
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.langs) + 1))  # of ``row``; doubled when full

    def _words(self, words: list[str]) -> np.ndarray:
        """For each word: the sum of its subwords' rows, and their number."""
        new = list(dict.fromkeys(w for w in words if w not in self.row))
        if len(self.row) + len(new) > self.limit or self.chars > TABLE_CHARS:
            self.row.clear()
            self.chars = 0
            new = list(dict.fromkeys(words))
        if new:
            self.chars += sum(map(len, new))
            while len(self.row) + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            grams, n = subwords([letters_only(w).lower() for w in new], self.model.bits)
            # A word without letters is only its two border marks.
            sums = row_sums(self.model.table[grams], n)
            real = np.array([any(map(str.isalpha, w)) for w in new])
            a, b = len(self.row), len(self.row) + len(new)
            self.row.update(zip(new, range(a, b), strict=True))
            self.rows[a:b] = np.column_stack([sums, n]) * real[:, None]
        return self.rows[[self.row[w] for w in words]]

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        model, langs, scores = self.model, [], []
        a = 0
        while a < len(texts):  # a few MB at once
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b] or "") < 2_000_000):
                size += len(texts[b] or "")
                b += 1
            split = [(t or "").split() for t in texts[a:b]]
            sums = row_sums(self._words([w for s in split for w in s]), [len(s) for s in split]) if any(split) else np.zeros((b - a, len(model.langs) + 1))
            for row in sums:
                if not model.langs or row[-1] == 0:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                p = _softmax((row[:-1] / row[-1] + model.bias) / model.temperature)
                langs.append(model.langs[int(p.argmax())])
                scores.append(float(p.max()))
            a = b
        return langs, scores


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(sample: list[tuple[str, str]], bits: int = 15, dim: int = 16, epochs: int = 4, rate: float = 4.0, reject_share: float = 0.001, reject_margin: float = 0.8, seed: int = 7) -> LanguageModel:
    """A model of the (text, language) pairs in ``sample``. The same sample gives the same model."""
    langs = sorted({x for _, x in sample})
    if not langs:
        return LanguageModel([], bits, np.zeros((2**bits, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    bags = []
    for text, lang in sample:
        words = [x for w in text.split() if (x := letters_only(w).lower())]
        if words:
            bags.append((words, langs.index(lang)))
    held = [i for i in range(len(bags)) if i % 5 == 0] if len(bags) >= 50 else []
    train = [b for i, b in enumerate(bags) if i % 5] if held else bags
    emb = rng.normal(0, 1 / dim, (2**bits, dim)).astype(np.float64)
    out, bias = np.zeros((dim, len(langs))), np.zeros(len(langs))
    out += rng.normal(0, 0.1, out.shape)
    steps = max(1, epochs * ((2 * len(train) + 31) // 32))
    done = 0
    for _ in range(epochs):
        stretches = []
        for words, y in train:
            for length in (int(rng.integers(3, 12)), int(rng.integers(12, 120))):
                at = int(rng.integers(0, max(1, len(words) - length + 1)))
                stretches.append((words[at : at + length], y))
        order = rng.permutation(len(stretches))
        for a in range(0, len(order), 32):
            part = [stretches[i] for i in order[a : a + 32]]
            grams, per_word = subwords([w for words, _ in part for w in words], bits)
            ends = np.cumsum([len(words) for words, _ in part])
            n = np.add.reduceat(per_word, np.concatenate([[0], ends[:-1]]))
            mean = row_sums(emb[grams], n) / n[:, None]
            wrong = _softmax(mean @ out + bias)
            wrong[np.arange(len(part)), [y for _, y in part]] -= 1
            lr = rate * (1 - done / steps) / len(part)
            push = (wrong @ out.T) / n[:, None]
            out -= lr * mean.T @ wrong
            bias -= lr * 0.1 * wrong.sum(axis=0)
            # Embedding rows are averaged over many subwords: their step is larger by the size of a short text.
            np.subtract.at(emb, grams, np.repeat(push * lr * 30, n, axis=0))
            done += 1
    model = LanguageModel(langs, bits, emb @ out, bias, 1.0, 0.0)
    if held:
        scorer = Scorer(model)
        logits, truth = [], []
        for i in held:
            words, y = bags[i]
            for part in (words, words[:4]):  # short ones, since errors are among them
                row = scorer._words(part).sum(axis=0)
                logits.append(row[:-1] / row[-1] + bias)
                truth.append(y)
        logits, truth = np.array(logits), np.array(truth)
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()))
        whole = np.sort(_softmax(logits[::2] / model.temperature).max(axis=1))
        # No higher than chance between two languages: a doubtful text is doubtful, not foreign.
        model.reject_below = float(min(0.45, whole[int(len(whole) * reject_share)] * reject_margin))
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 16_000_000, **options) -> LanguageModel:
    """``labels``: (doc_id, label); a bounded sample of them is fitted with the texts of ``docs``."""
    return fit(labelled_sample(docs, labels, max_rows, max_bytes), **options)


def predict(docs: DataFrame, model: LanguageModel, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the language, its score and whether it is rejected under ``names``, which replace columns so named;
    others pass through.
    """
    docs = docs.drop(*names)
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # bounded: 2^bits rows of a number per language
    others = docs.columns

    def make():
        scorer = Scorer(shipped.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = scorer.score(batch.column("text").to_pylist())
            reject = [x == "und" or s < scorer.model.reject_below for x, s in zip(langs, scores, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(reject, pa.bool_())], names=[*others, *names])

        return run

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return map_batches(docs, make, f"{kept}`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def labels_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("lang").alias("label"))
