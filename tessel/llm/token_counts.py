"""Token counts under the best unigram segmentation, by dynamic programming shared along a trie.

A text's pre-tokens are its runs of other than ASCII white space, each with a marker before it. Every worker has a trie of
the distinct ones that it met. A node is a prefix with the best forward score of its segmentations and the number of
pieces of the best one; both are worked out once, from the nodes above it, when the first pre-token comes that way. The
number at a pre-token's last node is its count, and a document's count is the sum over its pre-tokens.

Prefixes of more than ``kept_depth`` characters are hardly shared: there the walk goes on in the same way but leaves no
nodes. The trie is emptied at ``max_nodes``, and the table of finished pre-tokens at ``limit`` entries or TABLE_CHARS
characters, so memory is bounded, and nothing is shuffled.

Scores are integers (log probability in millionths of a nat), so results do not depend on the order of additions; of
segmentations of equal score the one with fewer pieces counts. Characters without a piece count one token for each of
their bytes. NULL, empty and blank texts have 0 tokens. Rows with a NULL doc_id and repeated rows are counted like any
other; an empty table gives no rows; columns beside doc_id and text do not matter.
"""

from __future__ import annotations

from array import array
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.sentencepieces import MARK
from tessel.llm.shared import TABLE_CHARS, map_batches
from tessel.llm.vocabulary import Vocabulary

_COUNTERS: dict[bytes, TrieCounter] = {}


class TrieCounter:
    def __init__(self, vocabulary: Vocabulary, limit: int = 300_000, max_nodes: int = 400_000, kept_depth: int = 64):
        self.limit, self.max_nodes, self.kept_depth = limit, max_nodes, kept_depth
        self.longest = vocabulary.longest
        millionths = [round(x * 1e6) for x in vocabulary.log_p]
        self.score_of = {p: millionths[k] for p, k in vocabulary.piece_id.items()}
        self.byte_score = [millionths[vocabulary.byte_at + b] for b in range(256)]
        self.counts: dict[bytes, int] = {}
        self.chars = 0
        self._empty_trie()

    def _empty_trie(self) -> None:
        self.child: dict[int, int] = {}  # node << 21 | code point -> node
        self.score, self.pieces = array("q", [0]), array("q", [0])

    def _insert(self, word: str) -> int:
        """Pieces of the best segmentation of ``word``, which becomes a path of the trie."""
        child, score_of, longest = self.child, self.score_of, self.longest
        path = [0]
        for c in word[: self.kept_depth]:
            node = child.get(path[-1] << 21 | ord(c))
            if node is None:
                break
            path.append(node)
        depth = len(path) - 1
        # Scores and pieces of the last prefixes, the first of which has ``first`` characters.
        first = max(0, depth + 1 - longest)
        score, pieces = [self.score[n] for n in path[first:]], [self.pieces[n] for n in path[first:]]
        node = path[-1]
        for end in range(depth + 1, len(word) + 1):
            best, n = None, 0
            for start in range(max(0, end - longest), end):
                s = score_of.get(word[start:end])
                if s is not None:
                    s += score[start - first]
                    if best is None or s > best or (s == best and pieces[start - first] + 1 < n):
                        best, n = s, pieces[start - first] + 1
            if word[end - 1] not in score_of:
                spelled = word[end - 1].encode("utf-8", "surrogatepass")
                s = score[-1] + sum(self.byte_score[b] for b in spelled)
                if best is None or s > best or (s == best and pieces[-1] + len(spelled) < n):
                    best, n = s, pieces[-1] + len(spelled)
            score.append(best)
            pieces.append(n)
            if end <= self.kept_depth:
                child[node << 21 | ord(word[end - 1])] = node = len(self.score)
                self.score.append(best)
                self.pieces.append(n)
            if len(score) > 4096:  # of a very long word only the end is needed
                first += len(score) - longest
                del score[:-longest], pieces[:-longest]
        return pieces[-1]

    def count(self, texts: list[str | None]) -> list[int]:
        tally = [Counter((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
        if len(self.counts) > self.limit or self.chars > TABLE_CHARS:
            self.counts.clear()
            self.chars = 0
        counts = self.counts
        for w in set(chain.from_iterable(tally)):
            if w not in counts:
                if len(self.score) > self.max_nodes:
                    self._empty_trie()
                counts[w] = self._insert(MARK + w.decode("utf-8", "surrogatepass"))
                self.chars += len(w)
        return [sum(n * counts[w] for w, n in t.items()) for t in tally]


def counter(model: bytes) -> TrieCounter:
    """This worker's counter, kept between tasks."""
    if model not in _COUNTERS:
        _COUNTERS[model] = TrieCounter(Vocabulary(model))
    return _COUNTERS[model]


def token_counts(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and n_tokens BIGINT for each row of ``docs``."""

    def make():
        c = counter(model)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = c.count(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

        return run

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, "doc_id bigint, n_tokens bigint")
