"""Language-model scores from a subword lattice.

A text is its words (runs of other than ASCII white space, A-Z lower-cased) and one end. A word's spelling
probability is the sum over all its segmentations into pieces of an existing unigram vocabulary, by a forward recursion
in log space over the lattice of pieces, with a stop probability after each piece, so that it is a distribution over
words. The vocabulary's scores are where this starts; ``em_steps`` rounds of expectation-maximization over the distinct
training words fit them to the corpus. Training words have an edge of their own, their discounted
relative frequency, and the discount's mass goes to the corpus-wide frequency and to the spelling. All this is
kept for each of a few classes of training texts; the score is the log10 of the class-weighted sum of a text's
probabilities, so no class has to be known for the text that is scored. Beside it stands ``lattice_score``, the marginal
probability under the lattice of the vocabulary's own scores alone, which nothing of the corpus changes.

Flow: a pass over the texts writes blocks (up to ``block_bytes`` of text each) of encoded texts and of the block's distinct
words with their training counts; words are summed over blocks, scored once each, and sent back to the
blocks, where texts are added up. What meets in one task is a block (or a few, if tasks made unequal numbers of them), never
all that a word or a source has.

NULL, empty and blank texts are an end alone. Rows with a NULL doc_id are scored, not learned from. With nothing
to learn from, the vocabulary's own scores are the model.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.sentencepieces import MARK
from tessel.llm.shared import arrow_batches, ascii_words, discard, shared_folder, stored
from tessel.llm.vocabulary import Vocabulary

DISCOUNT, CORPUS_SHARE, PRIOR, WORDS_AT_ONCE = 0.7, 0.3, 50.0, 20_000
END = b""


class Lattice:
    """log_p: (pieces, classes), each piece's log probability with that of going on; stop: (classes,)."""

    def __init__(self, vocabulary: Vocabulary, log_p: np.ndarray, stop: np.ndarray):
        self.vocabulary, self.log_p, self.stop = vocabulary, log_p, stop

    @classmethod
    def initial(cls, vocabulary: Vocabulary, classes: int, stop: float = 0.25) -> Lattice:
        log_p = np.repeat(vocabulary.log_p[:, None] + np.log1p(-stop), classes, axis=1)
        return cls(vocabulary, log_p, np.full(classes, np.log(stop)))

    def _edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, places of words that have such a piece, pieces) for words of one length, by rising start.

        All words walk down the trie of pieces at once from each start; those that leave it drop out. A character without
        a piece is one edge of piece len(vocabulary) + k for the k-th of ``self.spelled``.
        """
        n, length = len(self.vocabulary), len(words[0])
        trie = self.vocabulary.trie()
        chars = trie.classes(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)).reshape(len(words), length).T
        for start in range(length):
            at, node = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
            for end in range(start + 1, length + 1):
                node = trie.step(node, chars[end - 1, at])
                if end == start + 1:
                    ids = np.where(node >= 0, trie.piece[node], -1)
                    if len(lone := np.flatnonzero(ids < 0)):
                        ids[lone] = [n + self.spelled.setdefault(words[i][start], len(self.spelled)) for i in lone.tolist()]
                    yield start, end, at, ids
                    if len(gone := np.flatnonzero(node < 0)):
                        at, node = np.delete(at, gone), np.delete(node, gone)
                else:
                    there = node >= 0
                    at, node = at[there], node[there]
                    if len(full := np.flatnonzero(trie.piece[node] >= 0)):
                        yield start, end, at[full], trie.piece[node[full]]
                if not len(at):
                    break

    def _table(self) -> np.ndarray:
        extra = [self.log_p[self.vocabulary.byte_ids(c)].sum(axis=0) for c in self.spelled]
        return np.vstack([self.log_p, *extra]) if extra else self.log_p

    def _by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        order: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            order.setdefault(len(w), []).append(i)
        for length, places in order.items():
            step = max(1, 400_000 // (length + 1))  # bounds the forward table
            for a in range(0, len(places), step):
                part = places[a : a + step]
                yield np.array(part), [words[i] for i in part]

    def spelling(self, words: list[str]) -> np.ndarray:
        """Log probability of each word's spelling, (words, classes)."""
        out = np.zeros((len(words), self.log_p.shape[1]))
        for places, part in self._by_length([MARK + w for w in words]):
            self.spelled: dict[str, int] = {}
            edges = list(self._edges(part))
            out[places] = self._forward(part, edges, self._table())[-1] + self.stop
        return out

    def _forward(self, words: list[str], edges: list, table: np.ndarray) -> np.ndarray:
        alpha = np.full((len(words[0]) + 1, len(words), table.shape[1]), -np.inf)
        alpha[0] = 0
        for start, end, at, ids in edges:
            alpha[end, at] = np.logaddexp(alpha[end, at], alpha[start, at] + table[ids])
        return alpha

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, (pieces, classes), in words of the given weights (words, classes)."""
        out = np.zeros_like(self.log_p)
        for places, part in self._by_length([MARK + w for w in words]):
            self.spelled = {}
            edges = list(self._edges(part))
            table, w = self._table(), weights[places]
            alpha = self._forward(part, edges, table)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            uses, ids_of = [], []
            for start, end, at, ids in reversed(edges):
                tail = table[ids] + beta[end, at]
                beta[start, at] = np.logaddexp(beta[start, at], tail)
                uses.append(np.exp(alpha[start, at] + tail - alpha[-1, at]) * w[at])
                ids_of.append(ids)
            ids, uses = np.concatenate(ids_of), np.concatenate(uses)
            spelled = list(self.spelled)
            n = len(self.vocabulary)
            for k in range(out.shape[1]):
                sums = np.bincount(ids, weights=uses[:, k], minlength=len(table))
                out[:, k] += sums[:n]
                for c, x in zip(spelled, sums[n:], strict=True):
                    for b in self.vocabulary.byte_ids(c):
                        out[b, k] += x
        return out

    def refit(self, uses: np.ndarray, words: np.ndarray) -> Lattice:
        """Piece probabilities from expected uses and the numbers of words, smoothed by the vocabulary's own."""
        own = np.exp(self.vocabulary.log_p)[:, None]
        total = uses.sum(axis=0)
        log_p = np.log((uses + PRIOR * own) / (total + PRIOR))
        stop = (words + 1) / (words + total + 4)
        return Lattice(self.vocabulary, log_p + np.log1p(-stop), np.log(stop))


def _pack(rows: np.ndarray) -> bytes:
    """A text's words as counts of the block's rows: differences of the sorted distinct rows, then counts."""
    distinct, n = np.unique(rows, return_counts=True)
    return zlib.compress(np.concatenate([np.diff(distinct, prepend=0), n]).astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), dtype="<u4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def encode_blocks(docs: DataFrame, classes: int, block_bytes: int) -> DataFrame:
    """Rows of two kinds. Words: (block, row, word, n0.. = training counts by class); texts: (block, doc_id, held_out, bag).

    ``docs``: doc_id, text, held_out, class (a number under ``classes``, or NULL for texts not to learn from). Blocks are
    told apart by the task's partition, so this has to be stored before it is used.
    """
    counts = [f"n{k}" for k in range(classes)]
    names = ["block", "row", "word", *counts, "doc_id", "held_out", "bag"]
    types = [pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * classes, pa.int64(), pa.bool_(), pa.binary()]
    nothing = lambda n, t: pa.nulls(n, t)

    def run(batches):
        base, block, size = TaskContext.get().partitionId() << 24, 0, 0
        ids: dict[bytes, int] = {}
        tally = np.zeros((classes, 1024), np.int64)

        def words():
            n = len(ids)
            cols = [pa.array(np.full(n, base + block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(ids), pa.binary()), *(pa.array(tally[k, :n].copy()) for k in range(classes)), *(nothing(n, t) for t in types[-3:])]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            texts, docs_, held, of = (batch.column(c) for c in ("text", "doc_id", "held_out", "class"))
            bags, blocks, ready = [], [], []
            for text, k in zip(texts.to_pylist(), of.to_pylist(), strict=True):
                split = ascii_words(text)
                split.append(END)
                rows = np.array([ids.setdefault(w, len(ids)) for w in split], dtype=np.int64)
                if len(ids) > tally.shape[1]:
                    tally = np.concatenate([tally, np.zeros((classes, max(tally.shape[1], len(ids))), np.int64)], axis=1)
                if k is not None:
                    np.add.at(tally[k], rows, 1)
                bags.append(_pack(rows))
                blocks.append(base + block)
                size += sum(map(len, split)) + len(split)
                if size >= block_bytes:
                    ready.append(words())
                    ids.clear()
                    tally[:] = 0
                    block, size = block + 1, 0
            n = len(bags)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(nothing(n, t) for t in types[1:-3]), docs_, held, pa.array(bags, pa.binary())], names=names)
            yield from ready
        if ids:
            yield words()

    schema = "block bigint, row int, word binary, " + "".join(f"n{k} bigint, " for k in range(classes)) + "doc_id bigint, held_out boolean, bag binary"
    return docs.mapInArrow(run, schema)


def _regroup(batches, rows: int = WORDS_AT_ONCE):
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _texts(column) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in column.to_pylist()]


def fit_lattice(words: DataFrame, vocabulary: Vocabulary, classes: int, em_steps: int) -> Lattice:
    """EM over the distinct training words of each class, each counting once, since the lattice is for new words.

    The driver gets a row of sums for each piece of the vocabulary, whatever the corpus.
    """
    counts = [f"n{k}" for k in range(classes)]
    known = words.where(sum((F.col(c) for c in counts), F.lit(0)) > 0)
    lattice = Lattice.initial(vocabulary, classes)
    for _ in range(em_steps):
        shipped = words.sparkSession.sparkContext.broadcast(lattice)  # bounded by the vocabulary

        def run(batches, shipped=shipped):
            lattice = shipped.value
            uses, n = np.zeros_like(lattice.log_p), np.zeros(classes)
            for t in _regroup(batches):
                weights = np.column_stack([t.column(c).to_numpy() > 0 for c in counts]).astype(float)
                uses += lattice.expected(_texts(t.column("word")), weights)
                n += weights.sum(axis=0)
            at = np.flatnonzero(uses.any(axis=1))
            # The last row has the numbers of words.
            cols = [pa.array(np.append(at, -1)), *(pa.array(np.append(uses[at, k], n[k])) for k in range(classes))]
            yield pa.RecordBatch.from_arrays(cols, names=["piece", *(f"e{k}" for k in range(classes))])

        parts = known.mapInArrow(run, "piece bigint, " + ", ".join(f"e{k} double" for k in range(classes)))
        # Rounded, so that the order in which tasks' sums are added shows in no later digit.
        sums = parts.groupBy("piece").agg(*(F.round(F.sum(f"e{k}"), 6).alias(f"e{k}") for k in range(classes))).collect()
        uses, n = np.zeros_like(lattice.log_p), np.zeros(classes)
        for r in sums:
            if r[0] < 0:
                n[:] = r[1:]
            else:
                uses[r[0]] = r[1:]
        lattice = lattice.refit(uses, n)
        shipped.unpersist()
    return lattice


class WordModel:
    """Log probabilities of words by class from counts and spelling."""

    def __init__(self, lattice: Lattice, totals: np.ndarray, types: np.ndarray, all_types: int, docs: np.ndarray):
        own = Lattice.initial(lattice.vocabulary, 1)
        # One more class, so that the vocabulary's own lattice is summed over the same edges.
        self.lattice = Lattice(lattice.vocabulary, np.hstack([lattice.log_p, own.log_p]), np.append(lattice.stop, own.stop))
        self.totals, self.types = totals, types
        self.n, self.v = int(totals.sum()), all_types
        self.log_prior = np.log((docs + 1) / (docs + 1).sum())

    def log_p(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """One column for each class, then one of the vocabulary's own lattice."""
        both = self.lattice.spelling(words)
        spelled, own_lattice = both[:, :-1], both[:, -1:]
        if not self.n:
            return both
        corpus = counts.sum(axis=1, keepdims=True) / self.n
        rest = np.where(self.totals > 0, DISCOUNT * self.types / np.maximum(self.totals, 1), 1.0)
        own = np.maximum(counts - DISCOUNT, 0) / np.maximum(self.totals, 1)
        with np.errstate(divide="ignore"):
            seen = np.log(own + rest * CORPUS_SHARE * corpus)
        return np.hstack([np.logaddexp(seen, np.log(rest * (1 - CORPUS_SHARE)) + spelled), own_lattice])


def score(docs: DataFrame, model: bytes, held_out: Column, class_of: Column | None = None, max_classes: int = 6, block_bytes: int = 32_000_000, em_steps: int = 2, folder: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score of each row of ``docs``.

    ``held_out``: of doc_id; rows for which it is true (and those without a doc_id) are not learned from. ``class_of``: a
    label of training texts, of which the ``max_classes`` - 1 most frequent are told apart. ``base_score`` is the
    log10 probability under add-0.1 word frequencies; ``score`` is the model's, ``lattice_score`` the vocabulary's own lattice's.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    label = F.lit(None).cast("string") if class_of is None else class_of.cast("string")
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held.alias("held_out"), F.when(~held & F.col("doc_id").isNotNull(), F.coalesce(label, F.lit(""))).alias("label"))
    top = rows.where("label is not null and label <> ''").groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_classes - 1).collect()
    labels = [r["label"] for r in top]
    classes = len(labels) + 1
    number = F.when(F.col("label").isNull(), F.lit(None).cast("int"))
    for k, x in enumerate(labels, 1):
        number = number.when(F.col("label") == x, F.lit(k))
    arrow_batches(spark)
    coded = rows.select("doc_id", "text", "held_out", number.otherwise(0).alias("class"))
    blocks = stored(encode_blocks(coded, classes, block_bytes), folder, "blocks")
    counts = [f"n{k}" for k in range(classes)]
    in_blocks = blocks.where("row is not null")
    words = stored(in_blocks.groupBy("word").agg(*(F.sum(c).alias(c) for c in counts)), folder, "words")
    total = sum((F.col(c) for c in counts), F.lit(0))
    facts = words.agg(
        *(F.coalesce(F.sum(c), F.lit(0)) for c in counts), *(F.count_if(F.col(c) > 0) for c in counts),
        *(F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col(c))), F.lit(0)) for c in counts), F.count_if(total > 0),
    ).first()
    totals, types, ends = (np.array(facts[i * classes : (i + 1) * classes], dtype=float) for i in range(3))
    n, v = int(totals.sum()), int(facts[3 * classes])
    lattice = fit_lattice(words, Vocabulary(model), classes, em_steps if n else 0)
    word_model = WordModel(lattice, totals, types, v, ends)
    shipped = spark.sparkContext.broadcast(word_model)  # bounded by the vocabulary
    logs = [f"p{k}" for k in range(classes + 1)]

    def weigh(batches):
        for t in _regroup(batches):
            found = np.column_stack([t.column(c).to_numpy() for c in counts])
            log_p = shipped.value.log_p(_texts(t.column("word")), found).astype(np.float32)
            cols = [t.column("word").combine_chunks(), pa.array(found.sum(axis=1)), *(pa.array(np.ascontiguousarray(log_p[:, k])) for k in range(classes + 1))]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "c", *logs])

    weighed = stored(words.mapInArrow(weigh, "word binary, c bigint, " + ", ".join(f"{p} float" for p in logs)), folder, "weighed")
    discard(spark, f"{folder}/words")
    parts = in_blocks.select("block", "row", "word").join(weighed, "word").select("block", "row", "c", *logs)
    texts = blocks.where("bag is not null").select("block", "doc_id", "held_out", "bag")
    # A block is (task, number in the task). As many partitions as blocks, dealt by number: hashes would put several in one.
    spread, last = texts.agg(F.greatest(F.count_distinct("block"), F.lit(1)), F.coalesce(F.max(F.shiftright("block", 24)), F.lit(0))).first()
    # No common factor with the tasks, so that no two blocks of a task meet.
    while math.gcd(spread, last + 1) > 1:
        spread += 1
    place = F.shiftright("block", 24) + (last + 1) * F.col("block").bitwiseAND(F.lit((1 << 24) - 1))
    met = parts.unionByName(texts, allowMissingColumns=True).repartitionById(spread, F.pmod(place, F.lit(spread)).cast("int"))
    prior = word_model.log_prior

    def add_up(batches):
        """Words and texts of the partition's blocks, in any order; what is held is as large as these blocks."""
        words: dict[int, list[np.ndarray]] = {}
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            of, words_only = batch.column("block").to_numpy(), np.asarray(batch.column("bag").is_null())
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (words_only[1:] != words_only[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if words_only[a]:
                    words.setdefault(int(of[a]), []).append(np.column_stack([part.column(x).to_numpy() for x in ("row", "c", *logs)]))
                else:
                    held.setdefault(int(of[a]), []).append(part.select(["doc_id", "held_out", "bag"]))
        for block in sorted(held):
            table = np.concatenate(words.pop(block))
            table = table[np.argsort(table[:, 0])]
            c, log_p = table[:, 1], table[:, 2:]
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            yield from (totals_of(part, c, base, log_p) for part in held.pop(block))

    def totals_of(part: pa.RecordBatch, c: np.ndarray, base: np.ndarray, log_p: np.ndarray) -> pa.RecordBatch:
        out = np.empty((part.num_rows, 5))
        for i, bag in enumerate(part.column("bag").to_pylist()):
            at, times = _unpack(bag)
            sums = times @ log_p[at]
            joint = sums[:-1] + prior
            best = joint.max()
            out[i] = times.sum(), times[c[at] > 0].sum(), times @ base[at], (best + np.log(np.exp(joint - best).sum())) / np.log(10), sums[-1] / np.log(10)
        whole = out[:, :2].astype(np.int64)
        cols = [part.column("doc_id"), part.column("held_out"), *(pa.array(whole[:, k].copy()) for k in range(2)), pa.array(np.full(len(out), n)), *(pa.array(out[:, k].copy()) for k in range(2, 5))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"])

    return met.mapInArrow(add_up, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, lattice_score double")
