import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftstone.llm.telephony import BLOCK, _NEXT, _STEP, adpcm, decoded, kernel, payloads, pcm, resampled

from .cases import docs, same


def mulaw(b):
    b = ~b & 255
    sign, part, low = b & 128, b >> 4 & 7, b & 15
    size = ((2 * low + 33) << part) - 33
    return 4 * (-size if sign else size)


def alaw(b):
    b ^= 0x55
    part, low = b >> 4 & 7, b & 15
    size = 2 * low + 1 if part == 0 else (2 * low + 33) << (part - 1)
    return 8 * (size if b & 128 else -size)


def ima(block):
    """A nibble at a time."""
    if len(block) < 4:
        return []
    now, step = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            s = int(_STEP[step])
            move = s >> 3
            move += s if nibble & 4 else 0
            move += s >> 1 if nibble & 2 else 0
            move += s >> 2 if nibble & 1 else 0
            now = max(-32768, min(32767, now - move if nibble & 8 else now + move))
            step = max(0, min(88, step + int(_NEXT[nibble])))
            out.append(now)
    return out


def test_tables_equal_the_formulas():
    every = pa.array([bytes(range(256))])
    assert pcm(every, "mulaw", target=8000)[0].tolist() == [mulaw(b) for b in range(256)]
    assert pcm(every, "alaw", target=8000)[0].tolist() == [alaw(b) for b in range(256)]


def test_adpcm_blocks_equal_one_by_one():
    draw = np.random.RandomState(3)
    some = [draw.bytes(n) for n in (0, 1, 3, 4, 5, BLOCK, BLOCK + 1, BLOCK + 4, 5 * BLOCK + 77)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in some])])
    samples, out = adpcm(np.frombuffer(b"".join(some), np.uint8), at)
    for k, x in enumerate(some):
        want = [v for b in range(0, len(x), BLOCK) for v in ima(x[b : b + BLOCK])]
        assert samples[out[k] : out[k + 1]].tolist() == want


@pytest.mark.parametrize("target", [4000, 11025, 16000, 44100, 48000])
def test_resampling_equals_the_sum_and_keeps_a_tone(target):
    draw = np.random.RandomState(target)
    h, up, down = kernel(8000, target)
    half = h.shape[1] // 2
    parts = [draw.randint(-9000, 9000, n) for n in (1, 50, 333)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    got, out = resampled(np.concatenate(parts).astype(np.int16), at, 8000, target)
    for k, x in enumerate(parts):
        padded = np.concatenate([np.zeros(half), x, np.zeros(3 * half + down)])
        want = [sum(h[m * down % up, j] * padded[m * down // up + j + 1] for j in range(2 * half)) for m in range(-(-len(x) * up // down))]
        assert np.abs(got[out[k] : out[k + 1]] - np.clip(np.rint(want), -32768, 32767)).max() <= 1
    t = np.arange(4000) / 8000
    y, _ = resampled(np.rint(8000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16), np.array([0, 4000]), 8000, target)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(len(y)) / target)
    assert np.abs(y - want)[200:-200].max() < 100


def test_every_case(spark):
    rows = [(1, "mulaw", b"\x00\xff" * 100), (1, "mulaw", b"\x00\xff" * 100), (2, "ALAW", b"abc"), (3, "ima_adpcm", b"a" * 1000), (4, "opus", b"abc"), (5, None, b"abc"), (6, "alaw", None), (7, "alaw", b""), (None, "alaw", b"z"), (8, "ima_adpcm", b"ab"), (9, "mulaw", b"x" * 3_000_000)]
    media = spark.createDataFrame(rows, "media_id bigint, codec string, payload binary")
    got = decoded(media)
    by = {r.media_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [by[k].n_samples for k in (1, 2, 3, 4, 5, 6, 7, None, 8, 9)] == [400, 6, 2 * (3 * 505 + 2 * 228 + 1), None, None, None, 0, 2, 0, 6_000_000]
    assert all(r.pcm is None if r.n_samples is None else len(r.pcm) == 2 * r.n_samples for r in by.values())
    assert np.frombuffer(by[2].pcm, "<i2")[::2].tolist() == [alaw(b) for b in b"abc"]
    clash = media.select("*", *[F.lit("x").alias(c) for c in ("pcm", "n_samples", "sample_rate", "doc_id")])
    assert same(got, decoded(clash))
    assert decoded(media.limit(0)).count() == 0
    assert decoded(payloads(docs(spark, clash=True))).count() == 11
