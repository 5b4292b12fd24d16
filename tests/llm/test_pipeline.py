"""The pipeline's rows against a brute-force version of its stages."""

import hashlib
from pathlib import Path

import corpus_pipeline
import sentencepiece
from test_line_dedup import brute as brute_lines
from test_near_copies import brute_components, brute_contained, brute_fingerprint

from tessel.llm import queries
from tessel.sources.tables import shared_base

SF = "/root/testdata/sf0.01"
MODEL = queries.model_bytes()


def brute(docs, items):
    kept = [(i, "\n".join(t.split("\n")) if not n else t_new) for (i, t), (_, _, n, t_new) in zip(docs, [brute_line(docs, i) for i, _ in docs], strict=True)]
    fps = [(i, brute_fingerprint(t)) for i, t in kept]
    first = {d for d, _, c in brute_components(fps) if d == c}
    kept = [(i, t) for i, t in kept if i in first]
    leaked = {d for d, *_ in brute_contained(kept, items)}
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    out = set()
    for i, t in kept:
        if i not in leaked:
            ids = sp.encode(t)
            out.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return out, leaked


_LINES = {}


def brute_line(docs, i):
    if not _LINES:
        _LINES.update({r[0]: r for r in brute_lines(docs)})
    return _LINES[i]


def test_run(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [(10**6, "12345 !!! 99", "en", "x", 12), (10**6 + 1, None, "en", "x", 0), (10**6 + 2, "", "de", "x", 0)]
    source.unionByName(spark.createDataFrame(junk, source.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [tuple(r) for r in source.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want, leaked = brute(docs, items)
    got = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert leaked and len(want) < len(docs)
    # The language model may turn down a doubtful text; here it turns down the three that have no letter.
    assert got == want


def test_stages_keep_the_columns(spark):
    rows = [(1, "a line of good words here\nsame long line", "en", "s", 40, "x"), (2, "ein anderer Satz und mehr\nsame long line", "de", "s", 40, "y"), (None, "a line of good words here", "en", "s", 25, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert {r.doc_id: (r.text, r.n_chars, r.kept) for r in docs.collect()} == {1: (rows[0][1], 40, "x"), 2: ("ein anderer Satz und mehr", 25, "y"), None: (rows[2][1], 25, "z")}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []


def test_clashes_repeats_and_leaks(spark):
    """Columns named like the operators' own, repeated rows, leaked rows without a doc_id, a very long text."""
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    long = "a very long text of one line and of plain words " * 60_000
    texts = [(1, "the first of the texts here is short"), (1, "the first of the texts here is short"), (2, "the first of the texts here is short"), (None, f"before it {leak} and after"), (4, f"so it is: {leak}"), (5, long), (6, ""), (7, None), (8, "the second of the texts is also short")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 42.0, "mine", "x", "k") for d, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, rejected string, lang_pred string, `__t1_0` string")
    own = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        own[name] = rows = docs.collect()
        assert docs.columns[5:] == ["score", "rejected", "lang_pred", "__t1_0"]
        assert all(tuple(r)[5:] == (42.0, "mine", "x", "k") for r in rows)
    ids = {name: sorted((r.doc_id or 0) for r in rows) for name, rows in own.items()}
    assert ids["language ID"] == [0, 1, 1, 2, 4, 5, 8]
    assert ids["line dedup"] == [0, 1, 1, 2, 4, 5, 8]
    assert ids["SimHash near-dedup"] == [0, 1, 2, 4, 5, 8]  # the text of 2 went with its line: a group of its own
    assert ids["benchmark decontamination"] == [1, 2, 5, 8]
    assert {r.doc_id: r.text for r in own["line dedup"] if r.doc_id in (2, 5)} == {2: "", 5: long}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {r.doc_id: len(sentencepiece.SentencePieceProcessor(model_proto=MODEL).encode(r.text)) for r in own["benchmark decontamination"]}


def test_stored_tables_go(spark):
    """A run leaves its last stage's input and nothing else."""
    root = Path(shared_base(spark).removeprefix("file://").removeprefix("file:"))
    before = set(root.glob("*/*"))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [p.name for p in set(root.glob("*/*")) - before] == ["stage-3"]
