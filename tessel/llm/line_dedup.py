"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

An index is a set of runs. A run is a Parquet table of (h1, h2, owner): 128 bits of hash of a line's key and the
smallest doc_id that held it, in buckets by hash (as many in every run) and sorted inside them. The new keys of a batch are
shuffled once into the same buckets and merge-anti-joined with one run after the other, whose rows are neither moved nor
sorted again: keys that a run has belong to the run's owner, the others become a run of level 0. When a level holds
``fanout`` runs they are merged into one run of the next level, so there are O(log batches) runs. Batches go in
order of doc_id, so the owner of a key never changes later. A manifest lists the runs, so that a later session can
open the index and add to it; a batch that was cut off before its manifest has left nothing that counts.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased; keys shorter than
``min_chars`` code points are never compared.

Edge cases: a NULL or empty text is one empty line and stays; a NULL doc_id owns nothing and loses nothing;
rows that repeat a doc_id count as the same document, each text being cut by its own lines; an empty table
gives an empty result; columns beside doc_id and text pass through untouched, but for those that ``names`` replaces.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.shared import discard, shared_folder, stored

SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped and lower-cased. lower() equals translate() on ASCII and has a fast path there."""
    line = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


_RUN = "h1 bigint, h2 bigint, owner bigint"


class LineIndex:
    """Runs of line hashes under ``folder``; ``levels[i]`` names the runs of level i.

    ``buckets`` is how many parts each run has, the session's shuffle partitions if not given; it stays what it was when
    the index was made.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.made, self._prefix, self._tables = 0, f"line_run_{uuid.uuid4().hex}", set()

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineIndex:
        """The index that the newest manifest under ``folder`` describes."""
        fs, root = _file_system(spark, folder)
        names = sorted(f.getPath().getName() for f in (fs.listStatus(root) if fs.exists(root) else []) if f.getPath().getName().startswith("manifest-"))
        if not names:
            raise FileNotFoundError(f"no line index under {folder}")
        said = json.loads(spark.read.text(f"{folder}/{names[-1]}", wholetext=True).first()[0])
        index = cls(spark, folder, said["fanout"], said["buckets"])
        index.levels, index.made = said["levels"], said["made"]
        return index

    def _save(self) -> None:
        """Write the manifest under a name of its own, at once; then the ones before it can go."""
        fs, root = _file_system(self.spark, self.folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        part, name = path(root, ".manifest"), f"manifest-{self.made:012d}"
        out = fs.create(part, True)
        out.write(json.dumps({"fanout": self.fanout, "buckets": self.buckets, "levels": self.levels, "made": self.made}).encode())
        out.close()
        if not fs.rename(part, path(root, name)):
            raise OSError(f"cannot write {self.folder}/{name}")
        older = [f.getPath().getName() for f in fs.listStatus(root)]
        discard(self.spark, *(f"{self.folder}/{n}" for n in older if n.startswith("manifest-") and n < name))

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def runs(self) -> DataFrame | None:
        """All runs together, read as plain files; no key is in two of them."""
        paths = [f"{self.folder}/{name}" for name in self.names()]
        return self.spark.read.schema(_RUN).parquet(*paths) if paths else None

    def run(self, name: str) -> DataFrame:
        """One run with its buckets and order, which Spark knows of tables in its catalogue only."""
        table = self._table(name)
        if table not in self._tables:
            self.spark.sql(f"create table {table} ({_RUN}) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{self.folder}/{name}'")
            self._tables.add(table)
        return self.spark.table(table)

    def _table(self, name: str) -> str:
        return f"{self._prefix}_{name.replace('-', '_')}"

    def _forget(self, tables: set[str]) -> None:
        for table in tables:
            self.spark.sql(f"drop table if exists {table}")
        self._tables -= tables

    def close(self) -> None:
        """Take the runs out of the session's catalogue; their files stay."""
        self._forget(set(self._tables))

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"run-{self.made}"
        table = self._table(name)
        rows.write.mode("overwrite").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(table)
        self._tables.add(table)
        return name

    @contextmanager
    def _settings(self) -> Iterator[None]:
        """As many shuffle partitions as buckets, and scans that vouch for the order inside a bucket's single file."""
        wanted = {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
        before = {k: self.spark.conf.get(k) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def unknown(self, lines: DataFrame) -> DataFrame:
        """(h1, h2, owner) of the keys of ``lines`` that no run has."""
        new = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        return reduce(lambda left, name: left.join(self.run(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), self.names(), new)

    def add(self, lines: DataFrame) -> None:
        """Add the keys of a batch, (doc_id, h1, h2, ...) in which every doc_id is above those added before."""
        with self._settings():
            self.levels[0].append(self._write(self.unknown(lines)))
            merged = self._compact()
        self._save()
        self._forget({self._table(name) for name in merged})
        discard(self.spark, *(f"{self.folder}/{name}" for name in merged))

    def _compact(self) -> list[str]:
        """Merge full levels; gives the names of the runs that went into others."""
        merged: list[str] = []
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            rows = reduce(DataFrame.unionByName, (self.run(name) for name in level))
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._write(rows.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))))
            merged += level
            level.clear()
        return merged

    def drops(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (of batches added already) whose key belongs to a smaller doc_id.

        Both sides are stored tables, so a key that holds a large share of all lines is split by Spark's skew join.
        """
        owners = self.runs()
        if owners is None:
            return lines.limit(0)
        return lines.join(owners, ["h1", "h2"]).where(F.col("owner") < F.col("doc_id")).select(*lines.columns)


def _file_system(spark: SparkSession, folder: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of every line whose key has ``min_chars`` code points at least."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    long = keyed.where(F.char_length("key") >= min_chars)
    return long.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, min_chars: int = 10, folder: str | None = None, names: tuple[str, str, str] = ("kept", "n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the array of lines that stay, and how many there were and went, under ``names``.

    ``docs`` needs doc_id BIGINT and text; ``batches`` (of about equal size, by approximate quantiles of doc_id)
    does not change the result. Text is read twice and moved once, to meet the positions that it loses.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    ids = docs.select("doc_id", "text")
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    batch = reduce(lambda a, c: a + F.when(F.col("doc_id") > F.lit(int(c)), 1).otherwise(0), cuts, F.lit(0))
    lines = stored(line_hashes(ids, min_chars).withColumn("batch", batch), folder, "lines", ("batch",))
    index = LineIndex(spark, folder, fanout)
    try:
        for i in range(len(cuts) + 1):
            index.add(lines.where(F.col("batch") == i))
    finally:
        index.close()
    drops = index.drops(lines.drop("batch"))
    lost = drops.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    lost = lost.select(F.col("doc_id").alias("__ld_doc"), F.col("text_hash").alias("__ld_text"), F.col("lost").alias("__ld_lost"))
    marked = docs.join(lost, (docs["doc_id"] == F.col("__ld_doc")) & (F.xxhash64(docs["text"]) == F.col("__ld_text")), "left")
    all_lines = split_lines(docs["text"])
    out = marked.withColumns({"__ld_lines": all_lines, "__ld_lost": F.coalesce("__ld_lost", F.array().cast("array<int>"))})
    values = (_without("__ld_lines", "__ld_lost"), F.size("__ld_lines").cast("bigint"), F.size("__ld_lost").cast("bigint"))
    return out.withColumns(dict(zip(names, values, strict=True))).drop("__ld_doc", "__ld_text", "__ld_lost", "__ld_lines")


def _without(lines: str, lost: str) -> Column:
    """Array ``lines`` without the ascending 0-based positions ``lost``, in time linear in its length.

    The kept lines are the slices between lost positions.
    """
    return F.when(F.size(lost) == 0, F.col(lines)).otherwise(
        F.expr(
            f"flatten(zip_with(concat(array(-1), {lost}), concat({lost}, array(size({lines}))),"
            f" (a, b) -> slice({lines}, a + 2, b - a - 1)))"
        )
    )
