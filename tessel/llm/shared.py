"""What the operators share: stored intermediate tables, row names and bounded samples."""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.sources.tables import shared_base

#: Bytes of text that numpy works on at once.
CHUNK_BYTES = 4_000_000
#: Rows of an Arrow batch: whole texts may be long, so batches have few rows.
BATCH_ROWS = 512


#: Characters of texts that a worker's table keeps, so that its memory is bounded whatever the words are.
TABLE_CHARS = 4_000_000
#: Bytes of a batch that an operator works on at once.
PART_BYTES = 8_000_000

_TEMPORARY: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a temporary one on a local master only."""
    path = f"{shared_base(spark)}/tessel-{uuid.uuid4().hex}"
    if _TEMPORARY:
        _TEMPORARY[-1].append(path)
    return path


@contextmanager
def temporary_folders(spark: SparkSession) -> Iterator[None]:
    """Folders that operators ask for inside are deleted at the end; what is read later has to be stored elsewhere."""
    _TEMPORARY.append([])
    try:
        yield
    finally:
        discard(spark, *_TEMPORARY.pop())


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, i = {c.lower() for c in df.columns}, 0
    while any(f"__{n}_{i}" in taken for n in names):
        i += 1
    return tuple(f"__{n}_{i}" for n in names)


def stored(df: DataFrame, folder: str, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet under ``folder`` and read again: its lineage ends at files all executors see."""
    path = f"{folder}/{name}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more, through the file system that holds them."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's bound of the rows of a batch sent to Python to ``rows``; a lower one stays.

    Spark reads the setting when a query runs, so it can't be put back here; it changes no result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; NULL for a NULL id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of ``texts`` of about ``limit`` bytes each; a longer text is alone."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def row_sums(values: np.ndarray, counts: Iterable[int]) -> np.ndarray:
    """Sums of consecutive groups of rows of ``values``; an empty group sums to 0."""
    counts = np.asarray(counts, dtype=np.int64)
    out = np.zeros((len(counts), *values.shape[1:]), dtype=np.result_type(values.dtype, np.float32) if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=out.dtype)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, least: int = 40) -> list[tuple]:
    """(text, label) pairs of a bounded sample of ``labels`` (doc_id, label), joined to ``docs``' whole texts.

    The sample is ``max_rows`` ids of smallest xxhash64, among which ``least`` of each label come first, so that rare labels
    are learned too; and of those the first whose texts add up to ``max_bytes`` at most (one at least). An id
    with several labels or texts has the smallest. Sizes are looked at before any text comes to the driver, which
    holds no more than the two bounds. Equal pairs count once.
    """
    spark = docs.sparkSession
    path = shared_folder(spark)
    keys = stored(labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label")), path, "keys")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # Spark limits ranks of up to 1000 in every task before the exchange, so a frequent label sends ``least`` rows a task.
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("rank") <= least)
    first = [(r["doc_id"], r["label"]) for r in ranked.orderBy("rank", *order).limit(max_rows).collect()]
    # A heap of max_rows in each task. At most len(first) of them are there already, so what is missing is among them.
    rest = [(r["doc_id"], r["label"]) for r in keys.orderBy(*order).limit(max_rows).collect()]
    taken = {i for i, _ in first}
    first = [*first, *(r for r in rest if r[0] not in taken)][:max_rows]
    if not first:
        discard(spark, path)
        return []
    # max_rows rows: small enough to broadcast whatever the input is.
    chosen = F.broadcast(spark.createDataFrame([(i, r[0]) for i, r in enumerate(first)], "at int, __id bigint"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    picked = texts.join(chosen, F.col("doc_id") == F.col("__id")).groupBy("at").agg(F.min("text").alias("text"))
    picked = stored(picked, path, "sample")
    sizes = picked.select("at", F.octet_length("text").alias("n")).orderBy("at").collect()
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if last is not None and total > max_bytes:
            break
        last = r["at"]
    got = picked.where(F.col("at") <= last).collect() if last is not None else []
    discard(spark, path)
    return list(dict.fromkeys((r["text"], first[r["at"]][1]) for r in sorted(got, key=lambda r: r["at"])))


def parts(batch: pa.RecordBatch, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows of ``limit`` bytes at most; a larger row is alone."""
    if batch.num_rows > 1 and batch.nbytes > limit:
        half = batch.num_rows // 2
        yield from parts(batch.slice(0, half), limit)
        yield from parts(batch.slice(half), limit)
    elif batch.num_rows:
        yield batch


def map_batches(docs: DataFrame, make, schema: str) -> DataFrame:
    """``docs`` through a function of Arrow batches. ``make()`` runs once for each task and gives the function,
    so a model or table is set up once; batches are bounded in rows and in bytes.
    """
    arrow_batches(docs.sparkSession)

    def run(batches):
        f = make()
        for batch in batches:
            for part in parts(batch):
                yield f(part)

    return docs.mapInArrow(run, schema)


class WordRows(dict):
    """bytes word -> its row in ``hashes`` (XXH64 of the word), added when first asked for."""

    def __init__(self, limit: int = 400_000, limit_bytes: int = TABLE_CHARS):
        super().__init__()
        self.hashes = array("Q")
        self.limit, self.limit_bytes, self.bytes = limit, limit_bytes, 0

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.bytes += len(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return at

    def hashed(self, words: list[bytes]) -> np.ndarray:
        """uint64 hash of each word. The table is emptied first if it is over one of its limits."""
        if len(self) > self.limit or self.bytes > self.limit_bytes:
            self.clear()
            del self.hashes[:]
            self.bytes = 0
        rows = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return np.frombuffer(self.hashes, dtype=np.uint64).copy()[rows]


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z lower-cased, as UTF-8: what bytes.lower and bytes.split do."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
