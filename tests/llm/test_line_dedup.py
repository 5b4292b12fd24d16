import hashlib
from collections import defaultdict

import pytest
from oracle import assert_same, connect

from tessel.llm import line_dedup, queries

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    owner = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                owner[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or min(owner[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


CASES = [
    (1, "A common Line here\nshort\nown line number one\n"),
    (2, "  a common line HERE\t\nshort\n\nshort"),
    (3, None),
    (4, ""),
    (5, "a common line here"),
    (6, "own line number one\rx\nÉtÉ is a long line\nétÉ is a long line"),
    (7, "éTÉ is a LONG line\nÉtÉ is a long line\n a common line here"),
    (7, "a second row of seven\na common line here"),
    (7, "a second row of seven\na common line here"),
    (None, "a common line here\nnobody owns this"),
    (8, "nobody owns this\n" + "a common line here\n" * 500),
    (0, "a second row of seven\na second row of seven"),
]


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_against_brute_force(spark, batches):
    docs = spark.createDataFrame([(*r, "x", 5) for r in CASES], "doc_id bigint, text string, lost string, pos int")
    got = line_dedup.dedup_lines(docs, batches=batches, fanout=2)
    assert got.columns == ["doc_id", "text", "lost", "pos", "kept", "n_lines", "n_dropped"]
    rows = [(r.doc_id, r.n_lines, r.n_dropped, "\n".join(r.kept)) for r in got.collect()]
    assert sorted(rows, key=repr) == brute(CASES)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.dedup_lines(docs).collect() == []


def test_levels(spark, tmp_path):
    index = line_dedup.LineIndex(spark, f"file://{tmp_path}/i", fanout=2)
    for i in range(5):
        docs = spark.createDataFrame([(i, f"line of batch {i}\nline of all batches")], "doc_id bigint, text string")
        index.add(line_dedup.line_hashes(docs))
    assert [len(x) for x in index.levels] == [1, 0, 1]
    assert sorted(r.owner for r in index.runs().collect()) == [0, 0, 1, 2, 3, 4]
    index.close()
    with pytest.raises(ValueError):
        line_dedup.LineIndex(spark, "x", 1)


def test_runs_are_merged_where_they_lie(spark, tmp_path):
    """A batch is shuffled once; runs are neither moved nor sorted. A hot key is combined before it moves."""
    index = line_dedup.LineIndex(spark, f"file://{tmp_path}/i", fanout=3, buckets=7)
    docs = [spark.createDataFrame([(100 * i + j, f"line {j} of batch {i}\nline of all batches") for j in range(50)], "doc_id bigint, text string") for i in range(3)]
    for batch in docs[:2]:
        index.add(line_dedup.line_hashes(batch))
    with index._settings():
        unknown = index.unknown(line_dedup.line_hashes(docs[2]))
        rows = unknown.collect()
        plan = unknown._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(rows) == 50
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count(" Sort ") == 1
    assert plan.count("HashAggregate") == 2 and plan.count("Bucketed: true") == 2
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    index.close()


def test_open_and_add(spark, tmp_path):
    folder = f"file://{tmp_path}/i"
    batches = [spark.createDataFrame([(i, f"line of batch {i}\nline of all batches")], "doc_id bigint, text string") for i in range(5)]
    index = line_dedup.LineIndex(spark, folder, fanout=2, buckets=3)
    for batch in batches[:3]:
        index.add(line_dedup.line_hashes(batch))
    index.close()
    # A batch that was cut off: its run is there, no manifest names it.
    (tmp_path / "i" / "run-5").mkdir()
    (tmp_path / "i" / "run-5" / "part-0.parquet").write_bytes(b"cut off")
    again = line_dedup.LineIndex.open(spark, folder)
    assert (again.levels, again.made, again.buckets, again.fanout) == (index.levels, index.made, 3, 2)
    for batch in batches[3:]:
        again.add(line_dedup.line_hashes(batch))
    assert [len(x) for x in again.levels] == [1, 0, 1]
    assert sorted(r.owner for r in again.runs().collect()) == [0, 0, 1, 2, 3, 4]
    lost = again.drops(line_dedup.line_hashes(batches[4])).collect()
    assert [(r.doc_id, r.pos) for r in lost] == [(4, 1)]
    again.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    with pytest.raises(FileNotFoundError):
        line_dedup.LineIndex.open(spark, f"file://{tmp_path}/none")


def test_query(spark):
    assert_same(queries.op1_line_dedup(spark, SF), connect(SF), queries.oracle_sql()["op1_line_dedup"])


def test_sha_of_kept(spark, tmp_path):
    spark.createDataFrame(CASES[:3], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got[3] == hashlib.sha256(b"").hexdigest()
