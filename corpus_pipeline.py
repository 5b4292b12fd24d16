"""From raw documents to token digests: five stages, each over all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, whatever
their names. Texts may be NULL, empty or very long, rows may repeat, and a doc_id may be NULL or repeat: each stage says
what it does then. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import decontamination, language_id, line_dedup, queries, sentencepieces, simhash
from tessel.llm.shared import discard, fresh, remainder, shared_folder, stored, temporary_folders


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: those without a letter (NULL and empty texts too), and those of a score far
    under all it knows. Rows go by their texts alone, so repeated rows and those without a doc_id are treated alike.
    """
    known = docs.select("doc_id", "text", "lang")
    model = language_id.train(known, language_id.labels_of(known.where(remainder(F.col("doc_id"), 4) != 2)))
    names = fresh(docs, "lang_pred", "score", "rejected")
    return language_id.predict(docs, model, names).where(~F.col(names[2])).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines go, but for those in the smallest doc_id; n_chars follows the text.

    No row goes: one that loses all its lines keeps an empty text. A row without a doc_id loses none. Rows that repeat a
    doc_id are one document, so that they keep the lines they share.
    """
    names = fresh(docs, "kept", "n_lines", "n_dropped")
    out = line_dedup.dedup_lines(docs, names=names)
    changed, text = F.col(names[2]) > 0, F.array_join(names[0], "\n")
    cut = out.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays: of the smallest doc_id, or without one if none has any.

    Repeated rows, and near copies under one doc_id, are a group like any other. Texts without a word are one group.
    """
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, with a doc_id or without: texts are told apart by 128 bits of hash.

    The hashes of what goes are stored first: Spark then knows their size, and moves no text to meet a small table.
    """
    marks = fresh(docs, "t1", "t2")
    marked = docs.withColumns({marks[0]: F.xxhash64("text"), marks[1]: F.xxhash64(F.lit(1), "text")})
    found = decontamination.contained_items(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keys=marks)
    leaked = stored(found.select(*marks).distinct(), shared_folder(spark), "leaked")
    return marked.join(leaked, list(marks), "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of ids and decoded text of every row; a NULL text is the empty one."""
    return sentencepieces.digests(sentencepieces.encode_decode(docs, queries.model_bytes()))


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("SentencePiece encoding and decoding", tokens)]

#: SQL has neither the models nor the fingerprints; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = shared_folder(spark), []
    for i, (_, stage) in enumerate(STAGES[:-1]):
        # What a stage stored for itself, and the stage before it, are not read again.
        with temporary_folders(spark):
            docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{i}")
        discard(spark, *before)
        before = [f"{folder}/stage-{i}"]
    return STAGES[-1][1](spark, docs, sf_dir)
