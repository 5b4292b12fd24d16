"""SimHash near-dedup: a positional byte index with count filtering, and components of the links.

A fingerprint has 64 bits, each set if it is set in over half of the XXH64 hashes (seed 42) of the text's 4-word shingles,
repeats counted. Fingerprints that differ in 4 bits or fewer agree in 4 of their 8 bytes at least. The index posts each
distinct fingerprint under 20 triples of (position, byte): the triples are chosen so that any 4 positions hold one
whole triple (Turan's construction on groups of 3, 3 and 2 positions), so every such pair meets. A bucket of more than
``block`` fingerprints is posted once more, under each fourth position added to its triple: pairs that share
their three bytes by chance part there, and pairs that share four still meet.

For every pair that meets, the shared positional bytes are tallied over all 8 positions; pairs under the guaranteed
minimum of 4 go, and only what is left is verified by counting bits.

No bucket is held by one task and no bucket gives all of its pairs: a bucket of two is an aggregate; a larger one is cut
into blocks of ``block`` fingerprints, every two of which meet in one task that compares them and returns a spanning
forest of their links only. So components are exact, and links stay in proportion to the postings.

Words are runs of other than ASCII white space, A-Z lower-cased. Fewer than 4 words are one shingle; none (NULL, empty and
blank texts) is fingerprint 0, which is linked like any other. A NULL doc_id joins in, but a component's id is its
smallest doc_id that is not NULL. Repeated rows have a row each in the result; an empty table gives none; columns
beside doc_id and text do not matter to ``near_duplicates`` and pass through ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.components import components
from tessel.llm.shared import ascii_words, fresh, map_batches, shared_folder, stored

SHINGLE, BITS, LEAST_BYTES = 4, 4, 4


def _triples() -> list[tuple[int, int, int]]:
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [g for g in groups if len(g) == 3]
    for g, nxt in zip(groups, groups[1:] + groups[:1], strict=True):
        out += [(a, b, c) for i, a in enumerate(g) for b in g[i + 1 :] for c in nxt]
    return out


TRIPLES = _triples()


def fingerprint(text: str | None) -> int:
    words = ascii_words(text)
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:], words[3:], strict=False)))
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_digest
    for a in range(0, len(shingles), 4096):
        part = b"".join([digest(s, 42) for s in shingles[a : a + 4096]])
        counts += np.unpackbits(np.frombuffer(part, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``fp`` (the fingerprint's bits as BIGINT) of each row."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(fps)], names=[*keys, "fp"])

        return run

    rows = docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).select(*keys, F.col("text").alias("text"))
    return map_batches(rows, make, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", fp bigint")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def posted(prints: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under its 20 triples of positional bytes."""
    fp = F.col("fp")
    keys = [
        F.lit(i << 24).cast("bigint").bitwiseOR(F.shiftleft(_byte(fp, a), 16)).bitwiseOR(F.shiftleft(_byte(fp, b), 8)).bitwiseOR(_byte(fp, c))
        for i, (a, b, c) in enumerate(TRIPLES)
    ]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _linked(a: Column, b: Column) -> Column:
    """Count filter, then verification."""
    x = a.bitwiseXOR(b)
    shared = sum((F.when(_byte(x, i) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))
    return (shared >= LEAST_BYTES) & (F.bit_count(x) <= BITS)


def near_pairs(fps: np.ndarray) -> np.ndarray:
    """Boolean matrix of the links among int64 fingerprints: a tally of shared positional bytes, then counted bits."""
    x = fps.view(np.uint64)
    octets = fps.view(np.uint8).reshape(-1, 8)
    tally = np.zeros((len(fps), len(fps)), dtype=np.uint8)
    for p in range(8):
        column = octets[:, p]
        tally += column[:, None] == column[None, :]
    near = tally >= LEAST_BYTES
    a, b = np.nonzero(near)
    near[a, b] = np.bitwise_count(x[a] ^ x[b]) <= BITS
    return near


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among int64 fingerprints: (member, smallest member) pairs, as stars."""
    near = near_pairs(fps)
    out, left = [], np.ones(len(fps), dtype=bool)
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i] = False
        reached, front = [i], [i]
        while front:
            new = np.flatnonzero(near[front].any(axis=0) & left)
            left[new] = False
            front = new.tolist()
            reached += front
        if len(reached) > 1:
            members = fps[reached]
            root = members.min()
            out += [(int(m), int(root)) for m in members if m != root]
    return out


def _forests(batches):
    """Forests of the groups (key, lo, hi) of sorted rows; a group may run over several batches."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    kept: list[np.ndarray] = []
    at = None
    out: list[tuple[int, int]] = []

    def emit():
        rows = pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], schema=schema)
        out.clear()
        return rows

    for batch in batches:
        ids = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi")])
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.any(ids[1:] != ids[:-1], axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            if a == b:
                continue
            key = tuple(ids[a].tolist())
            if key != at and kept:
                out += forest(np.unique(np.concatenate(kept)))
                kept = []
            at = key
            kept.append(fps[a:b])
        if len(out) > 20_000:
            yield emit()
    if kept:
        out += forest(np.unique(np.concatenate(kept)))
    yield emit()


def _bytes_at(mask: Column, fp: Column) -> Column:
    """``fp`` with only the bytes whose positions are set in ``mask``."""
    out = F.lit(0).cast("bigint")
    for p in range(8):
        chosen = F.shiftright(mask, p).bitwiseAND(F.lit(1)) == 1
        out = out.bitwiseOR(F.when(chosen, F.shiftleft(_byte(fp, p), 8 * p)).otherwise(F.lit(0).cast("bigint")))
    return out


def reposted(rows: DataFrame) -> DataFrame:
    """(key, fp): rows of large buckets under each fourth position added to their triple, each choice of 4 once.

    A key is a hash of the positions and their bytes; keys that collide only make pairs meet that are then turned down.
    """
    mask = F.element_at(F.array(*(F.lit(sum(1 << p for p in t)) for t in TRIPLES)), (F.shiftrightunsigned("key", 24) + 1).cast("int"))
    more = rows.select("fp", mask.alias("mask")).select("fp", "mask", F.explode(F.array(*(F.lit(1 << p) for p in range(8)))).alias("bit"))
    four = more.where(F.col("mask").bitwiseAND(F.col("bit")) == 0).select("fp", F.col("mask").bitwiseOR(F.col("bit")).alias("mask"))
    return four.select(F.xxhash64("mask", _bytes_at(F.col("mask"), F.col("fp"))).alias("key"), "fp").distinct()


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Links of the buckets in (key, fp, n); every two blocks of a bucket meet in a task."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")
    met = rows.withColumn("own", own).select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = met.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    grouped = tasks.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return grouped.mapInArrow(_forests, "u bigint, v bigint")


def _bucket_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")


def links(prints: DataFrame, folder: str, block: int = 512) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of distinct ``fp`` within 4 bits."""
    rows = posted(prints)
    sizes = stored(_bucket_sizes(rows), folder, "buckets")
    pair = _linked(F.col("u"), F.col("v"))
    out = sizes.where("n = 2").where(pair).select("u", "v")
    middle = rows.join(sizes.where((F.col("n") > 2) & (F.col("n") <= block)).select("key", "n"), "key")
    out = out.union(_in_blocks(middle, block))
    large = sizes.where(F.col("n") > block).select("key")
    if large.isEmpty():
        return out
    again = stored(reposted(rows.join(large, "key")), folder, "reposted")
    sizes = stored(_bucket_sizes(again), folder, "smaller")
    pairs = sizes.where("n = 2").where(pair).select("u", "v")
    return out.union(pairs).union(_in_blocks(again.join(sizes.where("n > 2").select("key", "n"), "key"), block))


def near_duplicates(docs: DataFrame, folder: str | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and fp, component_id (the smallest doc_id that its links reach) and root (the smallest such fp) of each row."""
    folder = folder or shared_folder(docs.sparkSession)
    prints = stored(fingerprints(docs, keys), folder, "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), folder, "distinct")
    roots = stored(components(links(distinct, folder), folder), folder, "roots")
    members = stored(roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "first"), folder, "members")
    lowest = stored(members.groupBy("root").agg(F.min("first").alias("component")), folder, "lowest")
    found = stored(members.join(lowest, "root").select("fp", "component", "root"), folder, "found")
    ids = distinct.join(found, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints.join(stored(ids, folder, "ids"), "fp").select(*keys, "fp", "component_id", "root")


def keep_one(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row of ``docs`` for each component: of smallest doc_id (rows without one come last), then of smallest text hash.

    Of rows that are equal in doc_id and text one stays. The keys that go are stored first, so their size is known:
    Spark sends them to every task only if they are small (spark.sql.autoBroadcastJoinThreshold) and moves the texts to
    meet them otherwise.
    """
    folder = folder or shared_folder(docs.sparkSession)
    at, rank, g_id, g_nobody, g_at = fresh(docs, "text_hash", "rank", "id", "nobody", "at")
    keyed = docs.withColumn(at, F.xxhash64("text"))
    found = near_duplicates(keyed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", at), folder, ("doc_id", at))
    # A NULL id is two columns, so that joins on it are plain.
    found = found.select(F.coalesce("doc_id", F.lit(0)).alias(g_id), F.col("doc_id").isNull().alias(g_nobody), F.col(at).alias(g_at), "root")
    rows = stored(found.groupBy("root", g_nobody, g_id, g_at).agg(F.count("*").alias("n")), folder, "rows")
    first = stored(rows.groupBy("root").agg(F.min(F.struct(g_nobody, g_id, g_at)).alias("first")), folder, "first")
    judged = rows.join(first, "root").withColumn("stays", F.struct(g_nobody, g_id, g_at) == F.col("first"))
    judged = stored(judged.where("not stays or n > 1").select(g_id, g_nobody, g_at, "stays"), folder, "judged")
    mine = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)) == F.col(g_id), F.col("doc_id").isNull() == F.col(g_nobody), F.col(at) == F.col(g_at)]
    left = keyed.join(judged.where("not stays").drop("stays"), mine, "left_anti")
    again = judged.where("stays").drop("stays")
    if again.isEmpty():
        return left.select(*docs.columns)
    several = left.join(again, mine, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", at).orderBy(at)))
    return left.join(again, mine, "left_anti").select(*docs.columns).union(several.where(F.col(rank) == 1).select(*docs.columns))
