"""Media columns: PNG files in binary columns, read back chunk by chunk, and cosine-transform hashes of them."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_arrow, saved, texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW_BYTES = 192
PIXEL_BYTES = 3
HASH_SIDE, GRID_SIDE = 8, 32
_k, _n = np.arange(HASH_SIDE + 1)[:, None], np.arange(GRID_SIDE)[None, :]
COSINES = np.cos(np.pi * _k * (2 * _n + 1) / (2 * GRID_SIDE))
COLOUR_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def padded(data: bytes) -> bytes:
    """data with spaces up to the next positive multiple of a row's bytes."""
    return data + b" " * (max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES - len(data))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """An RGB image of 64 pixels a row whose samples are the payload; the row filter None or Up, whichever sums lower."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    up = rows.copy()
    up[1:] -= rows[:-1]
    plain_cost, up_cost = (np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (rows, up))
    use = up_cost < plain_cost
    lines = np.empty((len(rows), ROW_BYTES + 1), np.uint8)
    lines[:, 0] = np.where(use, 2, 0)
    lines[:, 1:] = np.where(use[:, None], up, rows)
    header = struct.pack(">IIBBBBB", ROW_BYTES // PIXEL_BYTES, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered rows (first byte: the filter). Runs of None and Up rows are undone at once."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    starts = np.flatnonzero(kinds != 2)
    for first, last in zip([0, *starts], [*starts, len(out)], strict=True):
        if first == last:
            continue
        kind = kinds[first]
        above = out[first - 1] if first else np.zeros_like(out[0])
        if kind == 1:
            out[first] = np.cumsum(out[first].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind > 2:
            row, up = out[first].tolist(), above.tolist()
            for i, x in enumerate(row):
                left, corner = (row[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    row[i] = (x + (left + up[i]) // 2) & 255
                else:
                    guess = left + up[i] - corner
                    near = min((abs(guess - left), 0, left), (abs(guess - up[i]), 1, up[i]), (abs(guess - corner), 2, corner))
                    row[i] = (x + near[2]) & 255
            out[first] = row
        elif kind == 2:
            out[first] += above
        np.cumsum(out[first:last], axis=0, dtype=np.uint8, out=out[first:last])
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Samples (rows x bytes) of an 8-bit PNG that is not interlaced or palette-coded.

    Raises ValueError on a wrong signature, a chunk's wrong checksum, a missing or misplaced chunk, or a wrong size.
    """
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, header, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("a chunk is cut off")
        (length,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body, check = media[at + 8 : at + 8 + length], media[at + 8 + length : at + 12 + length]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(kind + body):
            raise ValueError(f"wrong checksum of chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended, at = kind == b"IEND", at + 12 + length
    if header is None or not data or not ended:
        raise ValueError("a chunk is missing")
    width, height, depth, colour, _, _, interlaced = header
    if depth != 8 or interlaced or colour not in COLOUR_SAMPLES:
        raise ValueError("only plain 8-bit images are read")
    step = COLOUR_SAMPLES[colour]
    raw = zlib.decompress(b"".join(data))
    if len(raw) != height * (width * step + 1):
        raise ValueError("the samples do not fill the image")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width * step + 1), step)


def grid_means(image: np.ndarray) -> np.ndarray:
    """Brightness of the image in GRID_SIDE x GRID_SIDE cells of (nearly) equal size; small images repeat rows."""
    grey = image.reshape(len(image), -1, PIXEL_BYTES).mean(axis=2)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n < GRID_SIDE:
            grey = np.take(grey, np.arange(GRID_SIDE) * n // GRID_SIDE, axis=axis)
            continue
        edges = np.arange(GRID_SIDE) * n // GRID_SIDE
        grey = np.add.reduceat(grey, edges, axis=axis) / np.expand_dims(np.diff([*edges, n]), 1 - axis)
    return grey


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine frequencies (constant ones left out) exceed their median."""
    low = (COSINES @ grid_means(image) @ COSINES.T)[1:, 1:].round(6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


FEATURES = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
KINDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text, without padding) and media, the text's PNG file.

    Null and empty texts are one row of spaces with n_bytes 0. Equal texts give equal files; repeated rows stay repeated; an
    empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = texts(b)
            media = pa.array([encode_png(padded(t)) for t in batch], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, batch), pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def features_of(media: bytes) -> tuple:
    """The values of FEATURES of one file, from its samples."""
    image = decode_png(media)
    back = image.tobytes()
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)


def media_features(stored: DataFrame) -> DataFrame:
    """stored (any columns, with media) with the features of its files in place of media; a null file has null features.

    A file that is broken or of a kind that is not read raises ValueError. Columns named as the new ones are replaced.
    """
    held = stored.drop(*(f for f, _ in FEATURES))
    kept = [c for c in held.columns if c != "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(None,) * len(FEATURES) if m is None else features_of(m) for m in b.column(b.schema.get_field_index("media")).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FEATURES]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *(pa.array(c, kind) for c, (_, kind) in zip(columns, FEATURES, strict=True))], names=[*kept, *(f for f, _ in FEATURES)])

    return map_arrow(held, run, ", ".join(f"`{c}` {t}" for c, t in held.dtypes if c != "media") + ", " + KINDS)


def store_media(docs: DataFrame) -> DataFrame:
    """The table of `encode_media`, written to the shared folder and read again."""
    return saved(encode_media(docs), "media")


def op9_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of every document's file, from the stored table; cases as in `encode_media`."""
    return media_features(store_media(documents(spark, sf_dir)))


QUERIES = {"op9_png_media": op9_png_media}
SQL: dict[str, str] = {}
