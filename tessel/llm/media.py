"""Telephony audio as media columns: mu-law and A-law by lookup tables, IMA ADPCM blocks, resampled PCM.

A text's bytes, padded with spaces to a positive multiple of 192, are the 8-bit samples of a mu-law WAVE file:
lossless, since a mu-law code is any byte. 192 samples are a frame of 24 ms at 8 kHz, and also one ADPCM block
(4 bytes of header, 376 nibbles), so every step works on whole frames of all documents of a batch at once:
a very long text is just many frames. All arithmetic is in integers: equal texts have equal values.

NULL is the empty text, which is one frame of spaces. Rows with a NULL doc_id and repeated rows are stored like any other,
an empty table gives no rows, and columns beside doc_id and text do not matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import map_batches, row_sums

FRAME = 192
RATE = 8000
#: Frames that numpy decodes at once.
FRAMES_AT_ONCE = 8192
FORMATS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 0x11, "pcm": 1}

_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
# Of step index and nibble: the signed change of the sample, and the next index.
_NIBBLE = np.arange(16)
_DELTA = np.array([[(s >> 3) + (s >> 2) * (n & 1) + (s >> 1) * (n >> 1 & 1) + s * (n >> 2 & 1) for n in _NIBBLE] for s in _STEPS.tolist()], dtype=np.int32)
_DELTA = np.where(_NIBBLE & 8, -_DELTA, _DELTA).astype(np.int32).ravel()
_NEXT = np.clip(np.arange(89)[:, None] + np.where(_NIBBLE & 4, ((_NIBBLE & 3) + 1) * 2, -1), 0, 88).astype(np.int32).ravel() * 16


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples of IMA ADPCM blocks, (blocks, bytes) -> (blocks, 1 + 2 * (bytes - 4)).

    The recursion runs along a block; each of its steps is one numpy operation across all blocks. Step indexes of
    damaged headers are clipped to the table.
    """
    blocks = np.ascontiguousarray(blocks, dtype=np.uint8)
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    row = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int32)
    out = np.empty((1 + 2 * (size - 4), n), dtype=np.int16)
    out[0] = value
    for i, both in enumerate(codes):
        for j, nibble in enumerate((both & 15, both >> 4)):
            at = row + nibble
            value = np.clip(value + _DELTA.take(at), -32768, 32767)
            row = _NEXT.take(at)
            out[1 + 2 * i + j] = value
    return out.T


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation along the last axis; the last sample is held."""
    ahead = np.concatenate([pcm[..., 1:], pcm[..., -1:]], axis=-1)
    out = np.empty((*pcm.shape[:-1], 2 * pcm.shape[-1]), dtype=np.int16)
    out[..., 0::2] = pcm
    out[..., 1::2] = (pcm.astype(np.int32) + ahead) >> 1
    return out


def pad(data: bytes) -> bytes:
    """With bytes 32 up to a positive multiple of 192."""
    return data + b" " * (-len(data) % FRAME if data else FRAME)


def wave(data: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A RIFF/WAVE file with ``data`` as its samples. Its payload has an even number of bytes in all uses here."""
    if codec not in FORMATS:
        raise ValueError(f"unknown codec {codec!r}")
    bits = {"pcm": 16, "ima_adpcm": 4}.get(codec, 8)
    align = {"pcm": 2, "ima_adpcm": FRAME}.get(codec, 1)
    per_second = rate * FRAME // (2 * (FRAME - 4) + 1) if codec == "ima_adpcm" else rate * align
    extra = b"" if codec == "pcm" else struct.pack("<HH", 2, 2 * (FRAME - 4) + 1) if codec == "ima_adpcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, per_second, align, bits) + extra
    fact = b"" if codec == "pcm" else b"fact" + struct.pack("<II", 4, len(data))
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, payload) of a stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, None, 0
    names = {v: k for k, v in FORMATS.items()}
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = names.get(tag)
        elif kind == b"data":
            if codec is None or len(media) < at + 8 + size:
                raise ValueError("damaged WAVE file")
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the WAVE file")


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, int16 samples) of a stored file of any of the codecs."""
    codec, rate, payload = read_wave(media)
    codes = np.frombuffer(payload, dtype=np.uint8)
    if codec == "ima_adpcm":
        return rate, decode_adpcm(codes.reshape(-1, FRAME)).ravel()
    return rate, codes.view("<i2") if codec == "pcm" else (MULAW if codec == "mulaw" else ALAW)[codes]


def transcode(media: bytes) -> bytes:
    """The stored file as 16-bit PCM at twice its rate."""
    rate, pcm = decode(media)
    return wave(resample_double(pcm).tobytes(), "pcm", 2 * rate)


def _crossings(pcm: np.ndarray) -> np.ndarray:
    negative = pcm < 0
    return np.count_nonzero(negative[:, 1:] != negative[:, :-1], axis=1)


def frame_features(frames: np.ndarray) -> np.ndarray:
    """For each frame of 192 payload bytes, int64: energy, sign changes and sum of the resampled mu-law signal,
    absolute sum of the same codes under A-law, energy and sign changes of the frame as an ADPCM block."""
    out = np.empty((len(frames), 6), dtype=np.int64)
    for a in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[a : a + FRAMES_AT_ONCE]
        mu = resample_double(MULAW[part])
        wide = mu.astype(np.int32)
        out[a : a + len(part), 0] = np.einsum("ij,ij->i", wide, wide, dtype=np.int64)
        out[a : a + len(part), 1] = _crossings(mu)
        out[a : a + len(part), 2] = wide.sum(axis=1, dtype=np.int64)
        out[a : a + len(part), 3] = np.abs(ALAW[part].astype(np.int32)).sum(axis=1, dtype=np.int64)
        ad = decode_adpcm(part)
        wide = ad.astype(np.int32)
        out[a : a + len(part), 4] = np.einsum("ij,ij->i", wide, wide, dtype=np.int64)
        out[a : a + len(part), 5] = _crossings(ad)
    return out


def features(payloads: list[bytes]) -> list[str]:
    """One line for each payload: whole numbers of its frames' sums, so no rounding depends on the batch."""
    counts = [len(p) // FRAME for p in payloads]
    sums = row_sums(frame_features(np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, FRAME)), counts)
    return [f"frames={n};mu_energy={s[0]};mu_cross={s[1]};mu_sum={s[2]};a_abs={s[3]};adpcm_energy={s[4]};adpcm_cross={s[5]}" for n, s in zip(counts, sums.tolist(), strict=True)]


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text as a mu-law WAVE file in a BINARY column."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [x or b"" for x in batch.column("data").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([wave(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

        return run

    return map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("data")), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def to_pcm(media: DataFrame) -> DataFrame:
    """``media`` rows with ``pcm``: the 16 kHz, 16-bit WAVE file of each stored one."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.append_column("pcm", pa.array([transcode(m) for m in batch.column("media").to_pylist()], pa.binary()))

        return run

    return map_batches(media, make, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in media.schema)}, pcm binary")


def digests(media: DataFrame) -> DataFrame:
    """What can be read back from the stored bytes: payload digests, media digest and features, and the size and
    digest of the resampled PCM file that ``to_pcm`` stores."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            stored = batch.column("media").to_pylist()
            payloads = [read_wave(m)[2] for m in stored]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_bytes": batch.column("n_bytes"),
                "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                "media_bytes": pa.array([len(m) for m in stored], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
                "feature": pa.array(features(payloads)),
            }
            pcm = [(len(x), hashlib.sha256(x).hexdigest()) for x in map(transcode, stored)]
            columns |= {"pcm_bytes": pa.array([n for n, _ in pcm], pa.int64()), "pcm_sha256": pa.array([h for _, h in pcm])}
            return pa.RecordBatch.from_pydict(columns)

        return run

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_batches(media, make, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pcm_bytes bigint, pcm_sha256 string")
