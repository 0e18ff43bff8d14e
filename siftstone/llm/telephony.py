"""Operator 9: telephony audio in media columns.

Mu-law and A-law bytes are expanded by tables of 256 values (ITU-T G.711). IMA
ADPCM blocks depend on nothing but their own header, so all blocks of a batch
are decoded side by side: one step for each place in a block, over all blocks at
once. The samples are resampled by a windowed-sinc polyphase filter, all
recordings of a batch in one array with silence between, and stored as
little-endian 16-bit PCM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.textbatch import buffers, chunks, plain

CODECS = ("mulaw", "alaw", "ima_adpcm")
#: Bytes of an ADPCM block, its 4 bytes of header among them.
BLOCK = 256
RATE, TARGET_RATE = 8000, 16000
#: Samples on either side of a new one that it is made of.
TAPS = 8
#: Payload bytes that are decoded at a time; PCM is up to eight times as much.
PAYLOAD_BYTES = 1 << 20

SCHEMA = "media_id bigint, codec string, sample_rate int, n_samples bigint, pcm binary"

_STEP = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
_NEXT = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    b = ~np.arange(256, dtype=np.int32) & 255
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    b = np.arange(256, dtype=np.int32) ^ 0x55
    low, part = (b & 15) << 4, b >> 4 & 7
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(b & 128, size, -size).astype(np.int16)


_TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def _moves() -> np.ndarray:
    """Change of the predictor by step number and nibble."""
    nibble = np.arange(16)
    out = np.zeros((len(_STEP), 16), np.int32)
    for bit, shift in ((4, 0), (2, 1), (1, 2)):
        out += np.where(nibble & bit, _STEP[:, None] >> shift, 0)
    out += _STEP[:, None] >> 3
    return np.where(nibble & 8, -out, out)


_MOVES = _moves()


def adpcm(raw: np.ndarray, at: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Samples of recordings of IMA ADPCM blocks, and len + 1 offsets.

    A block is a 16-bit predictor, a step number (88 at most), a byte that isn't
    used, and nibbles, low ones first; the predictor is the first sample. The
    last block may be short; without a whole header it gives no sample.
    """
    size = np.diff(at)
    blocks = -(-size // block)
    first = np.concatenate([[0], np.cumsum(blocks)])
    owner = np.repeat(np.arange(len(size)), blocks)
    begin = at[owner] + (np.arange(first[-1]) - first[owner]) * block
    held = np.minimum(at[owner + 1] - begin, block)
    samples = np.where(held >= 4, 1 + 2 * (held - 4), 0)
    padded = np.concatenate([raw, np.zeros(block, np.uint8)])
    table = padded[begin[:, None] + np.arange(block)] if len(begin) else np.zeros((0, block), np.uint8)
    out = np.empty((1 + 2 * (block - 4), len(begin)), np.int16)
    now = (table[:, 0].astype(np.int32) | table[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    step = np.minimum(table[:, 2].astype(np.int32), 88)
    out[0] = now
    for k in range(4, block):
        for half, nibble in enumerate((table[:, k] & 15, table[:, k] >> 4)):
            now = np.clip(now + _MOVES[step, nibble], -32768, 32767)
            step = np.clip(step + _NEXT[nibble], 0, 88)
            out[1 + 2 * (k - 4) + half] = now
    kept = np.arange(out.shape[0])[None, :] < samples[:, None]
    total = np.concatenate([[0], np.cumsum(samples)])
    return np.ascontiguousarray(out.T)[kept], total[first]


def kernel(rate: int, target: int, taps: int = TAPS) -> tuple[np.ndarray, int, int]:
    """Filter values by phase and tap, and the whole numbers up and down of the two rates."""
    g = int(np.gcd(rate, target))
    up, down = target // g, rate // g
    cut = min(1.0, up / down)
    half = int(np.ceil(taps / cut))
    t = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    h = cut * np.sinc(cut * t) * np.cos(np.pi * t / (2 * half + 2)) ** 2
    return (h / h.sum(1, keepdims=True)).astype(np.float32), up, down


def resampled(samples: np.ndarray, at: np.ndarray, rate: int, target: int, taps: int = TAPS) -> tuple[np.ndarray, np.ndarray]:
    """Every recording at the ``target`` rate, ceil(n * target / rate) samples, with silence before and after it; and len + 1 offsets."""
    n = np.diff(at)
    if rate == target:
        return samples, at
    h, up, down = kernel(rate, target, taps)
    half = h.shape[1] // 2
    room = -(-(n + 2 * half) // down) * down  # a whole number of periods, so that every recording begins with the first phase
    begins = np.concatenate([[0], np.cumsum(room)])
    x = np.zeros(int(begins[-1]) + 3 * half + down, np.float32)
    place = np.arange(len(samples)) + np.repeat(begins[:-1] + half - at[:-1], n)
    x[place] = samples
    periods = int(begins[-1]) // down
    y = np.zeros(periods * up, np.float32)
    for r in range(up):
        phase, start = r * down % up, r * down // up
        own = y[r::up]
        for k in range(h.shape[1]):
            if h[phase, k] != 0:
                own += h[phase, k] * x[start + k + 1 : start + k + 1 + periods * down : down]
    size = -(-n * up // down)
    out_at = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(out_at[-1]) + np.repeat(begins[:-1] // down * up - out_at[:-1], size)
    return np.clip(np.rint(y[take]), -32768, 32767).astype(np.int16), out_at


def pcm(payload: pa.Array, codec: str, *, rate: int = RATE, target: int = TARGET_RATE, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """16-bit samples of the payloads of one codec, and len + 1 offsets."""
    raw, at = buffers(payload)
    samples, at = adpcm(raw, at, block) if codec == "ima_adpcm" else (_TABLES[codec][raw], at)
    return resampled(samples, at, rate, target)


def decoded(media: DataFrame, *, rate: int = RATE, target: int = TARGET_RATE, block: int = BLOCK) -> DataFrame:
    """``(media_id, codec, sample_rate, n_samples, pcm)``, a row for every row of ``media(media_id, codec, payload)``.

    ``codec`` is mulaw, alaw or ima_adpcm in any case; ``pcm`` is little-endian
    16-bit PCM at the ``target`` rate. A null payload, or a codec that is null or
    none of these, has null samples; an empty payload has no samples and empty
    PCM. Recordings of any length are decoded whole, repeated rows give equal
    rows, and other columns may have any name. An empty table gives no rows.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array([x.lower() if x is not None else None for x in batch.column(1).to_pylist()], object)
            there = np.asarray(batch.column(2).is_valid())
            for codec in CODECS:
                own = pa.array(np.flatnonzero((names == codec) & there))
                some = batch.take(own)
                for begin, part in chunks(plain(some.column(2)), PAYLOAD_BYTES):
                    samples, at = pcm(part, codec, rate=rate, target=target, block=block)
                    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(np.ascontiguousarray(at * 2)), pa.py_buffer(np.ascontiguousarray(samples.astype("<i2")))]).cast(pa.binary())
                    yield _rows(some.column(0).slice(begin, len(part)), some.column(1).slice(begin, len(part)), pa.array(np.diff(at)), data, target)
            rest = batch.take(pa.array(np.flatnonzero(~(np.isin(names.astype(str), CODECS) & there))))
            if rest.num_rows:
                yield _rows(rest.column(0), rest.column(1), pa.nulls(rest.num_rows, pa.int64()), pa.nulls(rest.num_rows, pa.binary()), target)

    slim = media.select(F.col("media_id").cast("bigint").alias("media_id"), F.col("codec").cast("string").alias("codec"), F.col("payload").cast("binary").alias("payload"))
    return slim.mapInArrow(decode, SCHEMA)


def _rows(ids: pa.Array, codec: pa.Array, n: pa.Array, data: pa.Array, rate: int) -> pa.RecordBatch:
    return pa.record_batch([ids, codec, pa.array(np.full(len(ids), rate, np.int32)), n, data], ["media_id", "codec", "sample_rate", "n_samples", "pcm"])


def payloads(docs: DataFrame) -> DataFrame:
    """Stand-in for a media table where there is none: the UTF-8 bytes of every document as a recording, codecs in turn by a hash of the id."""
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(len(CODECS))).cast("int")
    return docs.select(F.col("doc_id").cast("bigint").alias("media_id"), F.element_at(F.array(*[F.lit(c) for c in CODECS]), turn + 1).alias("codec"), F.col("text").cast("string").cast("binary").alias("payload"))
