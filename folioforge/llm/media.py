"""Media columns: texts as 8-bit grey PNG images, read back chunk by chunk, hashed by low-frequency cosine terms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extend, spread, text_of

#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes in an IDAT chunk at most.
CHUNK = 1 << 16
#: Side of the reduced image and of the block of low frequencies that the hash keeps.
SIDE, LOW = 32, 8
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey image. Each row takes the filter of None, Sub and Up whose residues are smallest in sum."""
    height, width = pixels.shape
    sub, up = pixels.copy(), pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    cost = np.stack([np.abs(r.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for r in (pixels, sub, up)])
    chosen = cost.argmin(axis=0).astype(np.uint8)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = chosen
    rows[:, 1:] = np.where(chosen[:, None] == NONE, pixels, np.where(chosen[:, None] == SUB, sub, up))
    packed = zlib.compress(rows.tobytes(), level)
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    parts = [SIGNATURE, _chunk(b"IHDR", header)]
    parts += [_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo PNG row filters, one byte a pixel. Sub rows and runs of Up rows are running sums; the others go pixel by pixel."""
    out = rows.copy()
    subs = kinds == SUB
    out[subs] = np.cumsum(rows[subs], axis=1, dtype=np.uint8)
    height, width = rows.shape
    starts = np.flatnonzero((kinds >= UP) & np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (kinds[1:] > UP)]))
    for first in starts:
        above = out[first - 1] if first else np.zeros(width, np.uint8)
        if kinds[first] == UP:
            last = first
            while last < height and kinds[last] == UP:
                last += 1
            out[first:last] = np.cumsum(np.vstack([above[None], rows[first:last]]), axis=0, dtype=np.uint8)[1:]
            continue
        left = corner = 0
        line, b = rows[first].tolist(), above.tolist()
        for x in range(width):
            if kinds[first] == AVERAGE:
                guess = (left + b[x]) >> 1
            else:
                p = left + b[x] - corner
                pa_, pb, pc = abs(p - left), abs(p - b[x]), abs(p - corner)
                guess = left if pa_ <= pb and pa_ <= pc else b[x] if pb <= pc else corner
            corner, left = b[x], (line[x] + guess) & 255
            line[x] = left
        out[first] = line
    return out


def read_png(stored: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey, not interlaced PNG. ValueError for all that is damaged, cut short or of another kind."""
    if stored[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, shape, ended = 8, [], None, False
    while at < len(stored) and not ended:
        if len(stored) < at + 12:
            raise ValueError(f"chunk at {at} is cut short")
        length, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + length]
        if len(stored) < at + 12 + length or zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + length)[0]:
            raise ValueError(f"chunk {kind!r} at {at} fails its checksum")
        if kind == b"IHDR":
            if length != 13:
                raise ValueError("IHDR is not of 13 bytes")
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError(f"only 8-bit grey without interlace is read, not {form}")
            shape = (height, width)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if shape is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as error:
        raise ValueError(f"image data is damaged: {error}") from error
    if raw.size != shape[0] * (shape[1] + 1):
        raise ValueError("image data and header differ in size")
    raw = raw.reshape(shape[0], shape[1] + 1)
    if (raw[:, 0] > PAETH).any():
        raise ValueError("a row has an unknown filter")
    return unfilter(raw[:, 0], raw[:, 1:])


@cache
def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


def _reduce(lines: np.ndarray) -> np.ndarray:
    """Axis 0 brought to SIDE rows: means of equal shares, or nearest rows where there are fewer than SIDE."""
    n = lines.shape[0]
    if n < SIDE:
        return lines[np.arange(SIDE) * n // SIDE].astype(np.float64)
    cuts = np.arange(SIDE) * n // SIDE
    sizes = np.diff(np.append(cuts, n))
    return np.add.reduceat(lines, cuts, axis=0, dtype=np.float64) / sizes[:, None]


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: which low-frequency cosine terms of the reduced image exceed their median; the mean is left out."""
    small = _reduce(_reduce(pixels).T).T
    terms = (_cosines() @ small @ _cosines().T).round(6).ravel()
    return np.packbits(terms > np.median(terms[1:])).tobytes().hex()


def to_payload(text: str) -> tuple[int, bytes]:
    """(bytes without padding, UTF-8 bytes padded with 0 to a positive multiple of WIDTH)."""
    plain = text.encode()
    return len(plain), plain + bytes(-len(plain) % WIDTH if plain else WIDTH)


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text as a PNG in a binary column.

    Null and empty texts give one row of zeros. A text's image depends on the text alone. Repeated rows give repeated
    results, an empty table none; other columns of docs are not read.
    """
    schema = docs.select(F.col(key), F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for t in batch.column(1):
                size, payload = to_payload(t.as_py())
                sizes.append(size)
                media.append(write_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(F.col(key), text_of(text).alias("__text")).mapInArrow(run, schema)


MEASURED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, MEASURED): what the stored images hold. Null media give nulls; damaged ones raise ValueError."""
    schema = extend(media.select(F.col(key), "n_bytes").schema, MEASURED)

    def measure(stored: bytes | None) -> tuple:
        if stored is None:
            return (None,) * 6
        pixels = read_png(stored)
        payload = pixels.tobytes()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return len(payload), sha(payload), zlib.crc32(payload[-64:]), len(stored), sha(stored), cosine_hash(pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [measure(m.as_py()) for m in batch.column(2)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=schema.names)

    return media.select(F.col(key), "n_bytes", "media").mapInArrow(run, schema)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(encode_media(spread(documents(spark, sf_dir))))
