import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import lm_scoring, queries
from tessel.llm.shared import remainder
from tessel.llm.vocabulary import Vocabulary

SF = "/root/testdata/sf0.01"
MODEL = queries.model_bytes()


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def base_rows(docs):
    train = [(i, words_of(t)) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for _, ws in train for w in [*ws, ""])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        ws = [*words_of(t), ""]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n, base))
    return out


def check(got, docs):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    plain = lm_scoring.Lattice.initial(Vocabulary(MODEL), 1)
    got, want = sorted(map(tuple, got), key=key), sorted(base_rows(docs), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] < 0 and math.isfinite(r[6]) for r in got)
    distinct = sorted({w for _, t in docs for w in [*words_of(t), ""]})
    spelled = dict(zip(distinct, plain.spelling(distinct)[:, 0] / math.log(10), strict=True))
    marginal = sorted(sum(spelled[w] for w in [*words_of(t), ""]) for _, t in docs)
    assert np.allclose(sorted(r[7] for r in got), marginal, rtol=1e-5)
    return got


def brute_scores(docs, label_of, em_steps=2):
    """``score`` word by word in plain Python; only the fitted lattice comes from the module."""
    train = [(label_of[i], [*words_of(t), ""]) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    freq = Counter(x for x, _ in train if x)
    labels = [""] + sorted(freq, key=lambda x: (-freq[x], x))[:5]
    n = [Counter(w for x, ws in train if (x if x in labels else "") == k for w in ws) for k in labels]
    words = sorted({w for _, t in docs for w in [*words_of(t), ""]})
    lattice = lm_scoring.Lattice.initial(Vocabulary(MODEL), len(labels))
    seen = [w for w in words if any(c[w] for c in n)]
    weights = np.array([[float(c[w] > 0) for c in n] for w in seen])
    for _ in range(em_steps):
        lattice = lattice.refit(np.round(lattice.expected(seen, weights), 6), weights.sum(axis=0))
    spelled = dict(zip(words, lattice.spelling(words), strict=True))
    everything = sum((c for c in n), Counter())
    total = sum(everything.values())

    def p(w, k):
        own, size = n[k], sum(n[k].values())
        rest = 0.7 * len(own) / size if size else 1.0
        return max(own[w] - 0.7, 0) / max(size, 1) + rest * (0.3 * everything[w] / total + 0.7 * math.exp(spelled[w][k]))

    prior = [c[""] + 1 for c in n]
    out = []
    for _, t in docs:
        joint = [math.log(prior[k] / sum(prior)) + sum(math.log(p(w, k)) for w in [*words_of(t), ""]) for k in range(len(labels))]
        best = max(joint)
        out.append((best + math.log(sum(math.exp(j - best) for j in joint))) / math.log(10))
    return out


def test_score_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10**6 + i, t, x) for i, (t, x) in enumerate([(None, "en"), ("", None), ("a b a", "rare"), ("x" * 200, "en")])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = lm_scoring.score(table, MODEL, remainder(F.col("doc_id"), 10) == 0, F.col("lang")).collect()
    want = brute_scores([r[:2] for r in rows], {r[0]: r[2] for r in rows})
    assert np.allclose(sorted(r.score for r in got), sorted(want), rtol=1e-5)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = check(queries.op7_lm_scoring(spark, SF).collect(), docs)
    held = [r for r in got if r[1]]
    tokens = sum(r[2] for r in held)
    score, lattice = (sum(r[k] for r in held) / tokens for k in (6, 7))
    print("held out, log10 a token: base", sum(r[5] for r in held) / tokens, "score", score, "own lattice", lattice, "unknown", 1 - sum(r[3] for r in held) / tokens)
    # A model of words that can spell unknown ones beats the vocabulary's own lattice by far on texts not learned from.
    assert score > -4.5 and score > lattice + 1


def test_edge_cases_and_blocks(spark):
    docs = [(i, t) for i, t in enumerate([None, "", " ", "A b a", "a 😀 b", "x" * 500, "a b " * 3000, "new words", "a", "a", "b c"])] + [(None, "a b"), (3, "other a")]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, word int")
    held = remainder(F.col("doc_id"), 10) == 0
    a = check(lm_scoring.score(table, MODEL, held, block_bytes=4).collect(), docs)
    b = check(lm_scoring.score(table, MODEL, held).collect(), docs)
    assert np.allclose([r[6] for r in a], [r[6] for r in b], rtol=1e-6)
    assert lm_scoring.score(table.limit(0), MODEL, held).collect() == []
    alone = lm_scoring.score(table, MODEL, F.lit(True)).collect()
    assert len(alone) == len(docs) and all(math.isfinite(r.score) and r.train_tokens == 0 for r in alone)


def brute_spelling(word, lattice, k):
    v, total = lattice.vocabulary, {0: [0.0]}
    for end in range(1, len(word) + 1):
        terms = []
        for start in range(end):
            piece = word[start:end]
            if piece in v.piece_id:
                terms += [x + lattice.log_p[v.piece_id[piece], k] for x in total[start]]
            elif end - start == 1:
                terms += [x + sum(lattice.log_p[b, k] for b in v.byte_ids(piece)) for x in total[start]]
        total[end] = terms
    return math.log(sum(math.exp(x) for x in total[len(word)])) + lattice.stop[k]


def test_lattice_sums_all_segmentations():
    lattice = lm_scoring.Lattice.initial(Vocabulary(MODEL), 2)
    words = ["the", "straße", "a😀漢b", "", "thenandhe"]
    lattice = lattice.refit(lattice.expected(words, np.array([[1.0, 0], [0, 1], [1, 1], [1, 0], [0, 2]])), np.array([3.0, 4]))
    assert np.allclose(np.exp(lattice.log_p).sum(axis=0) + np.exp(lattice.stop), 1)
    got = lattice.spelling(words)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(brute_spelling("▁" + w, lattice, k), abs=1e-9)


def test_expectations_are_segment_counts():
    lattice = lm_scoring.Lattice.initial(Vocabulary(MODEL), 1)
    uses = lattice.expected(["abc"], np.ones((1, 1)))
    # d log P / d log p of a piece is its expected use.
    for piece in ("▁a", "b", "bc", "c"):
        at = lattice.vocabulary.piece_id[piece]
        more = lm_scoring.Lattice(lattice.vocabulary, lattice.log_p.copy(), lattice.stop)
        more.log_p[at] += 1e-5
        slope = (more.spelling(["abc"]) - lattice.spelling(["abc"]))[0, 0] / 1e-5
        assert uses[at, 0] == pytest.approx(slope, rel=1e-3, abs=1e-8)
