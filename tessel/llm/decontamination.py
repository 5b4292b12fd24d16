"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is the set of its distinct 5-word shingles (all its words where it has fewer than five), and a document
contains it if it has ``threshold`` of them at least. Items are partitioned by their number n of shingles into classes of
sizes from 2^c to 2^(c+1) - 1. The sketch of an item is a bottom-k MinHash, its k smallest shingle hashes, where k is one
number for each class: what its largest size s could miss, s - ceil(threshold * s), and one more. A document that has
ceil(threshold * n) of an item's shingles misses n - ceil(threshold * n) at most, so it has the other hashes of the
sketch at least, and no fewer than one. Looking up every shingle of a document in the classes' sketches and counting
hits for each item therefore finds all containing pairs, however long the document is; those with enough hits
are verified on the words of all the item's shingles, not on hashes.

Items are split into blocks of ``block_bytes`` of text. Blocks go one at a time: the driver builds the index of one, sends it
to every task, stores what a pass over the documents finds, and drops it. So what it holds and sends is bounded
whatever the benchmark's size, at the price of one pass for each block.

Words are runs of other than ASCII white space, A-Z lower-cased. NULL, empty and blank items contain nothing and are
found nowhere; such documents contain nothing; items with one text are found alike; repeated rows of documents and
rows without a doc_id are searched like any other; empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import WordRows, ascii_words, chunks, map_batches, shared_folder, stored

SHINGLE = 5
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_FILTER_BITS = 20


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _FACTORS[0]
    for j in range(1, size):
        h += words[j : j + n] * _FACTORS[j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class ItemIndex:
    """Sketches of a block of items by size class, and the items' shingles for verification."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = 0.8):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must lie in (0, 1]")
        self.threshold = threshold
        rows = WordRows()
        self.items: list[tuple[int, int, int, dict[int, bytes]]] = []  # id, words in a shingle, least hits, hash -> words
        classes: dict[tuple[int, int], dict[int, list[int]]] = {}  # (words in a shingle, size class) -> hash -> items
        for item_id, text in items:
            words = ascii_words(text)
            if not words:
                continue
            size = min(SHINGLE, len(words))
            hashes = shingle_hashes(rows.hashed(words), size).tolist()
            shingles = {h: b" ".join(words[i : i + size]) for i, h in enumerate(hashes)}
            n = len(shingles)
            sketch = sorted(shingles)[: self.sketch_size(n.bit_length())]
            for h in sketch:
                classes.setdefault((size, n.bit_length()), {}).setdefault(h, []).append(len(self.items))
            self.items.append((item_id, size, max(1, len(sketch) - n + self.needed(n)), shingles))
        self.classes = classes
        # One look-up for all classes of a shingle size: a bit for each first part of a hash, then the hashes themselves.
        self.filters = {}
        for size in sorted({s for s, _ in classes}):
            known = np.unique(np.concatenate([np.array(list(table), dtype=np.uint64) for (s, _), table in classes.items() if s == size]))
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[known >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[size] = (bits, known, [table for (s, _), table in sorted(classes.items()) if s == size])

    def sketch_size(self, size_class: int) -> int:
        """Of items of 2^(size_class - 1) to 2^size_class - 1 shingles."""
        largest = 2**size_class - 1
        return largest - self.needed(largest) + 1

    def needed(self, n: int) -> int:
        return math.ceil(self.threshold * n - 1e-9)


class Searcher:
    def __init__(self, index: ItemIndex):
        self.index, self.rows = index, WordRows()

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text's place, item_id, its shingles, those in the text) of each containing pair."""
        out = []
        docs = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        for a, b in chunks(docs):
            words = [t.split() for t in docs[a:b]]
            starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            flat = [w for ws in words for w in ws]
            hashed = self.rows.hashed(flat)
            doc_of = np.repeat(np.arange(b - a), np.diff(starts))
            for size, (bits, known, tables) in self.index.filters.items():
                h = shingle_hashes(hashed, size)
                maybe = np.flatnonzero(bits[h >> np.uint64(64 - _FILTER_BITS)])
                maybe = maybe[doc_of[maybe] == doc_of[maybe + size - 1]]
                place = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
                hits = maybe[known[place] == h[maybe]]
                met = set(zip(doc_of[hits].tolist(), h[hits].tolist(), strict=True))
                pairs = Counter((d, item) for d, x in met for table in tables for item in table.get(x, ()))
                by_doc: dict[int, list[int]] = {}
                for (d, item), n in sorted(pairs.items()):
                    if n >= self.index.items[item][2]:
                        by_doc.setdefault(d, []).append(item)
                for d, items in by_doc.items():
                    own = {}
                    for i, x in enumerate(h[starts[d] : max(starts[d], starts[d + 1] - size + 1)].tolist(), int(starts[d])):
                        own.setdefault(x, i)
                    for item in items:
                        item_id, _, _, shingles = self.index.items[item]
                        shared = sum(1 for x, s in shingles.items() if x in own and b" ".join(flat[own[x] : own[x] + size]) == s)
                        if shared >= self.index.needed(len(shingles)):
                            out.append((a + d, item_id, len(shingles), shared))
        return out


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_bytes: int = 4_000_000, keys: tuple[str, ...] = ("doc_id",), folder: str | None = None) -> DataFrame:
    """``keys`` of ``docs`` with item_id, n_item (shingles of the item), n_shared and containment of every containing pair.

    Found pairs are stored under ``folder`` block by block, which is when the documents are read.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    texts = docs.select(*keys, F.col("text").alias("__text"))
    schema = "".join(f"`{k}` {texts.schema[k].dataType.simpleString()}, " for k in keys) + "item_id bigint, n_item bigint, n_shared bigint, containment double"

    def one(block: int) -> DataFrame:
        # Of bounded size: about block_bytes of text.
        index = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in items.where(of == block).collect()], threshold))

        def make():
            searcher = Searcher(index.value)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = searcher.search(batch.column("__text").to_pylist())
                at = pa.array([f[0] for f in found], pa.int64())
                columns = [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3)]
                share = pa.array([f[3] / f[2] for f in found], pa.float64())
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *columns, share], names=[*keys, "item_id", "n_item", "n_shared", "containment"])

            return run

        out = stored(map_batches(texts, make, schema), folder, f"found-{block}")
        index.destroy()
        return out

    found = [one(b) for b in range(blocks)]
    return spark.read.schema(found[0].schema).parquet(*(f"{folder}/found-{b}" for b in range(blocks)))
