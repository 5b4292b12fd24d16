"""Operators that work on one text at a time: against the library, brute force, round trips, held-out accuracy."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import language_id, media, quality, queries, sentencepieces, token_counts
from tessel.llm.vocabulary import Vocabulary

SF = "/root/testdata/sf0.01"
MODEL = queries.model_bytes()
SP = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "   a   b   ", "▁", "▁▁x ▁", "\n", "a\n b\t", "\x00 x", "ﬁ ñ̃ 😀 漢字", "<s> </s> <unk> <0x0A>", "x" * 3000, " " * 100, "\xa0a　b", "word " * 2000]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, score int")


def library(text):
    ids = SP.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest()


def test_sentencepiece_equals_the_library(spark):
    got = sentencepieces.digests(sentencepieces.encode_decode(docs_of(spark, ODD), MODEL)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: library(t) for i, t in enumerate(ODD)}
    assert sentencepieces.encode_decode(docs_of(spark, []), MODEL).collect() == []
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op9_sentencepiece(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: library(t) for i, t in docs.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab.\n<0x>s\x00"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_are_exact(text):
    ids, decoded = sentencepieces.table(MODEL).encode([text])
    assert list(ids[0]) == SP.encode(text)
    assert decoded[0] == SP.decode(SP.encode(text))


def best_count(word, v):
    """All prefixes, every split: worth is in millionths, fewer pieces break ties."""
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[i][0] + round(v.log_p[v.piece_id[word[i:end]]] * 1e6), best[i][1] - 1) for i in range(end) if word[i:end] in v.piece_id]
        if word[end - 1] not in v.piece_id:
            spelled = v.byte_ids(word[end - 1])
            options.append((best[end - 1][0] + sum(round(v.log_p[k] * 1e6) for k in spelled), best[end - 1][1] - len(spelled)))
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(spark):
    v = Vocabulary(MODEL)
    assert math.isclose(np.exp(v.log_p).sum(), 1)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_of(spark, ODD), MODEL).collect()}
    assert got == {i: sum(best_count("▁" + w.decode(), v) for w in (t or "").encode().split()) for i, t in enumerate(ODD)}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, MODEL).collect()}
    assert got == {r.doc_id: sum(best_count("▁" + w.decode(), v) for w in r.text.encode().split()) for r in docs.collect() if r.doc_id in got}
    assert token_counts.token_counts(docs_of(spark, []), MODEL).collect() == []


def slow_adpcm(block):
    value, row = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            s = int(media._STEPS[row])
            d = (s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            row = max(0, min(88, row + (-1, -1, -1, -1, 2, 4, 6, 8)[n & 7]))
            out.append(value)
    return out


def test_codecs():
    assert [int(media.MULAW[c]) for c in (0, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(media.ALAW[c]) for c in (0x55, 0xD5, 0xAA, 0x2A)] == [-8, 8, 32256, -32256]
    blocks = np.frombuffer(random.Random(1).randbytes(192 * 9), dtype=np.uint8).reshape(-1, 192)
    assert media.decode_adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]
    assert media.resample_double(np.array([[0, 10, -4]], np.int16)).tolist() == [[0, 5, 10, 3, -4, -4]]
    for codec in media.FORMATS:
        stored = media.wave(b"\x01\x02" * 96, codec)
        assert media.read_wave(stored) == (codec, 8000, b"\x01\x02" * 96)
        assert media.read_wave(media.transcode(stored))[:2] == ("pcm", 16000)
    with pytest.raises(ValueError):
        media.read_wave(b"nothing")


def test_media(spark):
    texts = [*ODD, "b" * 192, "b" * 193, "b" * 384, "a"]
    rows = {r.doc_id: r for r in media.digests(media.to_media(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes == len(media.wave(padded)) and r.media_sha256 == hashlib.sha256(media.wave(padded)).hexdigest()
        assert r.feature == media.features([padded])[0]
        pcm = media.transcode(media.wave(padded))
        assert (r.pcm_bytes, r.pcm_sha256) == (len(pcm), hashlib.sha256(pcm).hexdigest())
    assert rows[4][1:] == rows[len(texts) - 1][1:]
    pcm = media.to_pcm(media.to_media(docs_of(spark, ["a" * 10]))).first().pcm
    assert media.decode(pcm)[1].tolist()[:20:2] == [int(media.MULAW[97])] * 10
    assert queries.op2_media(spark, SF).count() == 1000


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_edge_cases(spark):
    sample = [("the thing of that and with", "en"), ("der die das und nicht ein", "de")] * 40
    model = language_id.fit(sample)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "nicht das"), (5, "the thing " * 5000), (None, "Die")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["und"] * 3 + ["de", "en", "de"]
    assert [got[i].rejected for i in (1, 2, 3, 4, 5)] == [True] * 3 + [False] * 2
    assert got[1].score == 0
    nothing = language_id.train(docs, docs.selectExpr("doc_id", "cast(null as string) as label"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).collect() == []
    assert np.array_equal(language_id.fit(sample).table, model.table)


def auc(pairs):
    good, bad = [s for s, q in pairs if q], [s for s, q in pairs if not q]
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op3_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    pairs = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    print("auc", auc(pairs), "accuracy", np.mean([(s >= 0.5) == q for s, q in pairs]))
    assert auc(pairs) > 0.9


def test_quality_edge_cases(spark):
    model = quality.fit([("fine words here and there", 1), ("JUNK!! JUNK!! $$$ ###", 0)] * 40)
    docs = docs_of(spark, [*ODD, "fine words", "$$$ JUNK!!"])
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == len(ODD) + 2 and got[len(ODD)] > 0.5 > got[len(ODD) + 1] and got[0] == got[1] == got[2]
    assert {r.score for r in quality.score(docs, quality.train(docs, docs.selectExpr("doc_id", "cast(null as int) as label"))).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []
