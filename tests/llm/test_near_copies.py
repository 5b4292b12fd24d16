"""Decontamination, SimHash and components against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from oracle import assert_same, connect

from tessel.llm import components, decontamination, queries, simhash

SF = "/root/testdata/sf0.01"


def shingles(text, n):
    w = (text or "").encode().lower().split()
    m = min(n, len(w))
    return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set(), m


def brute_contained(docs, items, threshold=0.8):
    out = set()
    for d, text in docs:
        w = (text or "").encode().lower().split()
        for i, item in items:
            s, m = shingles(item, 5)
            shared = len(s & {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}) if s else 0
            if s and shared >= threshold * len(s) - 1e-9:
                out.add((d, i, len(s), shared))
    return out


def test_contained_items(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 8, 14, 40])))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "  "), (103, items[0][1]), (0, "again W1")]
    docs = [(0, None), (1, ""), (None, items[4][1])]
    for d in range(2, 120):
        text = rng.choices(words, k=rng.choice([0, 2, 30, 400]))
        item = rng.choice(items[:30])[1].split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            item[rng.randrange(len(item))] = rng.choice([*words, "X"])
        at = rng.randrange(len(text) + 1)
        docs.append((d, "\n".join([*text[:at], *item, *text[at:]]).upper()))
    docs += [docs[5], (7, docs[9][1])]
    t = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_contained(docs, items)
    assert len(want) > 60
    for block_bytes in (10**6, 700):
        got = decontamination.contained_items(t, b, block_bytes=block_bytes).collect()
        assert {tuple(r)[:4] for r in got} == want
        assert all(r.containment == r.n_shared / r.n_item for r in got)
    assert decontamination.contained_items(t.limit(0), b).collect() == []
    assert decontamination.contained_items(t, b.limit(0)).collect() == []
    with pytest.raises(ValueError):
        decontamination.ItemIndex([], 0)


def test_size_classes():
    """A document with the fewest shingles that still contain an item is found, whatever the item's size."""
    for n in [1, 2, 3, 4, 5, 6, 7, 9, 12, 13, 20, 36, 37, 68, 131]:
        words = [f"i{n}w{k}" for k in range(n)]
        index = decontamination.ItemIndex([(n, " ".join(words))], 0.8)
        _, size, least, shingles = index.items[0]
        hits = [h for table in index.classes.values() for h in table]
        assert 1 <= least <= len(hits) <= len(shingles) and list(index.classes) == [(size, len(shingles).bit_length())]
        missing = len(shingles) - index.needed(len(shingles))
        assert len(hits) - missing <= least
        # Cut from the front, so that the first shingles are missing; then one more.
        found = decontamination.Searcher(index).search(["x " * 50 + " ".join(words[missing:]) + " y" * 20_000, "x " * 50 + " ".join(words[missing + 1 :])])
        assert [f[:2] for f in found] == [(0, n)]


def test_decontamination_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {tuple(r)[:4] for r in queries.op8_decontamination(spark, SF).collect()}
    assert got == brute_contained(docs, items) and got
    assert_same(queries.op8_decontamination(spark, SF), connect(SF), queries.oracle_sql()["op8_decontamination"])


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    """rows: (doc_id, fp). Union of everything within 4 bits."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4):
            a, b = find(f), find(fps[i + 1 + int(j)])
            parent[max(a, b)] = min(a, b)
    first = {}
    for d, f in rows:
        if d is not None:
            first[find(f)] = min(d, first.get(find(f), d))
    return {(d, f"{f:016x}", first.get(find(f))) for d, f in rows}


def linked(a, b):
    return (a ^ b).bit_count() <= 4


def test_one_row_of_a_group_stays(spark):
    """Repeated rows, near copies under one doc_id, rows without a doc_id, and columns named like ours."""
    words = [f"w{i}" for i in range(300)]
    long, near = " ".join(words), " ".join([*words[:-1], "x"])
    assert 0 < (brute_fingerprint(long) ^ brute_fingerprint(near)).bit_count() <= 4
    rows = [(1, long), (1, long), (2, long), (1, near), (None, near), (5, "quite another text here"), (5, "quite another text here"), (None, "nobody wrote this one"), (None, "nobody wrote this one")]
    docs = spark.createDataFrame([(*r, 7, "a", True) for r in rows], "doc_id int, text string, id int, at string, nobody boolean")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    first = min((long, near), key=lambda x: spark.sql("select xxhash64(:t)", args={"t": x}).first()[0])
    assert got == sorted([(1, first), (5, rows[5][1]), (None, rows[7][1])], key=repr)
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_tally_comes_first():
    """Pairs that share three bytes are turned down by the tally, before bits are counted."""
    fps = np.array([0, 0x0101010100000000 >> 8, 0x0303000000000000, 0xFF, 0x0F, 0x1F], dtype=np.uint64).view(np.int64)
    near = simhash.near_pairs(fps)
    for i, a in enumerate(fps.view(np.uint64).tolist()):
        for j, b in enumerate(fps.view(np.uint64).tolist()):
            assert near[i, j] == linked(a, b)


def test_every_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in itertools.combinations(range(8), 4))


def test_simhash_query(spark, tmp_path):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op6_simhash(spark, SF).collect()} == brute_components(rows)
    texts = [None, "", " ", "One", "one", "one two", "a b c d", "a b\nc\td", "É b c d e", "x " * 3000]
    docs = [*enumerate(texts), (3, "a b c d"), (3, "a b c d"), (None, "one"), (None, "alone")]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op6_simhash(spark, str(tmp_path)).collect()]
    assert len(got) == len(docs) and set(got) == brute_components([(d, brute_fingerprint(t)) for d, t in docs])
    kept = simhash.keep_one(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "fp"]
    groups = {}
    for d, text in docs:
        groups.setdefault(min(f for f in map(brute_fingerprint, texts + ["one", "alone"]) if linked(f, brute_fingerprint(text))), []).append((d is None, d or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(map(min, groups.values()))
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_large_buckets(spark, tmp_path):
    """Near fingerprints in dense groups: blocks, forests and chains give the exact components."""
    rng = random.Random(9)
    fps = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(700):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
            fps.add(x)
    chain = rng.getrandbits(64)
    for b in range(0, 40, 3):
        chain ^= 0b111 << b
        fps.add(chain)
    rows = list(enumerate(sorted(fps)))
    table = spark.createDataFrame([(d, f - 2**64 if f >= 2**63 else f) for d, f in rows], "first bigint, fp bigint")
    edges = simhash.links(table, f"file://{tmp_path}/l", block=50)
    assert edges.count() < 25 * 90 * len(rows)
    roots = {r.node: r.root for r in components.components(edges, f"file://{tmp_path}/c").collect()}
    groups = {}
    for d, f in rows:
        s = f - 2**64 if f >= 2**63 else f
        groups.setdefault(roots.get(s, s), []).append(d)
    want = {}
    for d, _, c in brute_components(rows):
        want.setdefault(c, []).append(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path(spark, tmp_path):
    nodes = list(range(200))
    random.Random(2).shuffle(nodes)
    edges = [*zip(nodes, nodes[1:], strict=False), (500, 501), (501, 500), (7, 7)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint"), f"file://{tmp_path}").collect()}
    assert got == {*((n, 0) for n in nodes), (500, 500), (501, 500)}
