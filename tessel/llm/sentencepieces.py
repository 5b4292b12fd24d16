"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a vocabulary has a white space marker after another character, no merge crosses the place
before a marker. A text is then the sequence of its marked words (a run of markers and what follows up to the
next marker), each of which can be segmented alone: once for each distinct one, by the sentencepiece library itself.
Ids and decoded text are joined by position. ``ChunkTable`` refuses vocabularies or normalizers for which this fails.

Every worker keeps its own table, which is emptied at ``limit`` chunks or ``limit_chars`` characters; a chunk of more than
``longest`` characters (a whole text of a script without spaces) is segmented anew each time. So memory is bounded,
nothing is shuffled, and a lost executor costs only its own tasks.

NULL and empty texts have no ids and decode to the empty text; repeated rows, and rows with a NULL doc_id, are encoded
like any other; an empty table gives no rows; ``keep`` columns pass through and may not be named like the output.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import TABLE_CHARS, map_batches

MARK = "▁"
_TABLES: dict[bytes, ChunkTable] = {}


class ChunkTable:
    def __init__(self, model: bytes, limit: int = 300_000, limit_chars: int = TABLE_CHARS, longest: int = 256):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.limit, self.limit_chars, self.longest, self.chars = limit, limit_chars, longest, 0
        self.rows: dict[str, tuple[array, str]] = {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses white space markers: words can't be segmented alone")
        probe = " a  b ﬁ\n "
        if self.sp.decode(self.sp.encode(probe)) != probe or not self.sp.encode("a", out_type=str)[0].startswith(MARK):
            raise ValueError("the model's normalizer changes white space or characters, or adds no leading marker")
        self.mark = array("i", [self.sp.piece_to_id(MARK)])

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The marked words of a text, each without its first marker and with spaces for the others."""
        if not text:
            return []
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts:
            if p:
                out.append(" " * spaces + p)
                spaces = 0
            else:
                spaces += 1
        if spaces:  # a run of markers at the end
            out.append(" " * (spaces - 1))
        return out

    def look_up(self, chunks: list[str]) -> list[tuple[array, str]]:
        rows = self.rows
        if len(rows) > self.limit or self.chars > self.limit_chars:
            rows.clear()
            self.chars = 0
        new = list({c for c in chunks if c not in rows})
        ids = self.sp.encode(new, num_threads=1)
        once: dict[str, tuple[array, str]] = {}  # too long to keep
        for c, x, text in zip(new, ids, self.sp.decode(ids, num_threads=1) if new else [], strict=True):
            # The library gives nothing for the empty text; here it stands for one marker.
            row = (array("i", x), text) if c else (self.mark, "")
            if len(c) <= self.longest:
                rows[c] = row
                self.chars += len(c)
            else:
                once[c] = row
        return [rows[c] if len(c) <= self.longest else once[c] for c in chunks]

    def encode(self, texts: list[str | None]) -> tuple[list[array], list[str]]:
        """Ids and decoded text of each text."""
        split = [self.chunks(t or "") for t in texts]
        found = iter(self.look_up([c for s in split for c in s]))
        all_ids, all_texts = [], []
        for s in split:
            ids, parts = array("i"), []
            for _ in s:
                x, text = next(found)
                ids.extend(x)
                parts.append(text)
            all_ids.append(ids)
            # Each chunk's first marker decodes to a space, but for the text's first.
            all_texts.append(" ".join(parts))
        return all_ids, all_texts


def table(model: bytes) -> ChunkTable:
    """This worker's table, kept between tasks."""
    if model not in _TABLES:
        _TABLES[model] = ChunkTable(model)
    return _TABLES[model]


def encode_decode(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``ids`` (array of INT) and ``decoded`` for each row's text.

    ``model``: the bytes of a model file (a few MB at most, sent with each task).
    """
    if clash := [c for c in keep if c in ("ids", "decoded", "__text")]:
        raise ValueError(f"columns clash with the output: {', '.join(clash)}")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("__text"))

    def make():
        encoder = table(model)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, decoded = encoder.encode(batch.column("__text").to_pylist())
            flat, offsets = array("i"), [0]
            for x in ids:
                flat.extend(x)
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

        return run

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(rows, make, f"{kept}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode_decode``'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
