import hashlib
import math
import statistics
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import media


def filtered(image, kinds, step):
    """A PNG's rows filtered byte by byte as its specification says."""
    out, above = [], [0] * len(image[0])
    for row, kind in zip(image, kinds, strict=True):
        line = [kind]
        for i, x in enumerate(row):
            left, up, corner = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = left + up - corner
            paeth = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
            line.append((x - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        out.append(bytes(line))
        above = row
    return b"".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_reads_all_filters(seed):
    r = np.random.default_rng(seed)
    image = r.integers(0, 256, (9, 12)).tolist()
    data = filtered(image, r.integers(0, 5, 9).tolist(), 3)
    png = media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 9, 8, 2, 0, 0, 0)) + media.chunk(b"tEXt", b"x") + media.chunk(b"IDAT", zlib.compress(data)[:20]) + media.chunk(b"IDAT", zlib.compress(data)[20:]) + media.chunk(b"IEND", b"")
    assert media.decode_png(png).tolist() == image


def test_broken_files_are_refused():
    good = media.encode_png(media.padded(b"hello"))
    for bad in (b"x" + good[1:], good[:40] + bytes([good[40] ^ 1]) + good[41:], good[:-5], good[:33] + good[-12:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


@pytest.mark.parametrize("text", [b"", b"a", b"x" * 192, bytes(range(256)) * 50])
def test_round_trip(text):
    payload = media.padded(text)
    assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.startswith(text) and not payload[len(text) :].strip()
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload


def plain_feature(payload):
    """The hash by the transform's definition, in plain loops."""
    rows = [payload[k : k + 192] for k in range(0, len(payload), 192)]
    grey = [[sum(row[3 * x : 3 * x + 3]) / 3 for x in range(64)] for row in rows]

    def parts(n):
        return [range(k * n // 32, k * n // 32 + 1) if n < 32 else range(k * n // 32, (k + 1) * n // 32) for k in range(32)]

    cells = [[sum(grey[y][x] for y in ys for x in xs) / (len(ys) * len(xs)) for xs in parts(64)] for ys in parts(len(grey))]
    wave = [[math.cos(math.pi * k * (2 * i + 1) / 64) for i in range(32)] for k in range(9)]
    low = [round(sum(wave[u][y] * wave[v][x] * cells[y][x] for y in range(32) for x in range(32)), 6) for u in range(1, 9) for v in range(1, 9)]
    middle = statistics.median(low)
    return f"{int(''.join(str(int(x > middle)) for x in low), 2):016x}"


def test_rows_are_read_from_the_stored_files(spark, odd, nothing):
    stored = media.store_media(odd)
    assert stored.inputFiles()
    files = {r["media"] for r in stored.collect()}
    out = media.media_features(stored.withColumn("feature", F.lit(1))).collect()
    by_payload = {hashlib.sha256(p := media.padded((r["text"] or "").encode())).hexdigest(): (len((r["text"] or "").encode()), len(p), zlib.crc32(p[-16:]), plain_feature(p)) for r in odd.collect()}
    assert len(out) == odd.count() and {r["payload_sha256"] for r in out} == set(by_payload)
    for r in out:
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == by_payload[r["payload_sha256"]][:3]
        assert bin(int(r["feature"], 16) ^ int(by_payload[r["payload_sha256"]][3], 16)).count("1") <= 2  # sums differ in their last digits
    assert {r["media_sha256"] for r in out} == {hashlib.sha256(m).hexdigest() for m in files}
    assert {r["media_bytes"] for r in out} == set(map(len, files))
    assert media.media_features(media.store_media(nothing)).count() == 0
    assert media.media_features(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()["feature"] is None


def test_hash_is_of_low_frequencies():
    noise = np.random.default_rng(1).integers(0, 256, (64, 192), dtype=np.uint8)
    low = media.cosine_hash(noise)
    nudged = noise.copy()
    nudged[5, 7] ^= 1
    assert bin(int(low, 16) ^ int(media.cosine_hash(nudged), 16)).count("1") <= 4
    assert bin(int(low, 16) ^ int(media.cosine_hash(noise[::-1].copy()), 16)).count("1") > 10
