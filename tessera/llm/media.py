"""Media columns: texts as PNG images in a binary column, read back through every checksum, hashed by low cosine frequencies.

The samples are 8-bit greyscale, 192 to a row. Encoding filters each row by the smallest sum of absolute differences among
no filter, left and up, then deflates; decoding tests the signature and each chunk's CRC-32, inflates (which tests Adler-32)
and undoes all five filter kinds in numpy. The feature is the usual 64-bit perceptual hash: area-averaged to 32 x 32, DCT-II,
the 8 x 8 lowest frequencies against their median, in integers throughout.

Defined results: null text is empty; an empty text is one row of 192 spaces; repeated rows give repeated results; an empty
table gives no rows; columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by PNG colour type, 8 bits each.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def png_encode(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG of the payload, whose length is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    tried = np.empty((3, *rows.shape), np.uint8)
    tried[0] = tried[1] = tried[2] = rows
    tried[1, :, 1:] -= rows[:, :-1]
    tried[2, 1:] -= rows[:-1]
    best = np.abs(tried.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64).argmin(0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, channels: int) -> np.ndarray:
    """Undoes PNG row filters: lines has the filter kind and then the samples in each row; uint8 arithmetic wraps as PNG wants."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    height, size = rows.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    left = np.flatnonzero(kinds == 1)
    if len(left):  # depends on its own row only
        rows[left] = np.add.accumulate(rows[left].reshape(len(left), -1, channels), axis=1, dtype=np.uint8).reshape(len(left), size)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), height], strict=True):
        if b > a and kinds[a] == 2:  # a run of rows that lean on the row above is one running sum
            if a:
                rows[a] += rows[a - 1]
            np.add.accumulate(rows[a:b], axis=0, dtype=np.uint8, out=rows[a:b])
        elif b > a and kinds[a] > 2:
            for y in range(a, b):
                _lean(rows, y, channels, int(kinds[a]))
    return rows


def _lean(rows: np.ndarray, y: int, channels: int, kind: int) -> None:
    """Average (3) and Paeth (4): each pixel needs the one before it."""
    pixels = rows[y].reshape(-1, channels).astype(np.int32)
    above = (rows[y - 1] if y else np.zeros_like(rows[y])).reshape(-1, channels).astype(np.int32)
    a = c = np.zeros(channels, np.int32)
    for x, b in enumerate(above):
        if kind == 3:
            guess = (a + b) >> 1
        else:
            p = a + b - c
            pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
            guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        a = pixels[x] = (pixels[x] + guess) & 255
        c = b
    rows[y] = pixels.reshape(-1)


def png_decode(data: bytes) -> np.ndarray:
    """The samples as (height, width * channels) uint8; ValueError or zlib.error if any part of the file does not hold."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"broken chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("header or end missing")
    width, height, depth, colour, *rest = head
    if depth != 8 or colour not in CHANNELS or any(rest):
        raise ValueError("only 8-bit, non-interlaced samples are read")
    size = width * CHANNELS[colour]
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != height * (size + 1):
        raise ValueError("wrong amount of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, size + 1), CHANNELS[colour])


@lru_cache(8)
def _cosines(n: int = 32, low: int = 8) -> np.ndarray:
    """The lowest cosine waves in units of 2^-14; each but the first adds up to exactly 0."""
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.rint(np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * (1 << 14)).astype(np.int64)


def _shrink(rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the first axis over n equal stretches, in n-ths of a row: len(rows) times the average, exactly."""
    sums = np.zeros((len(rows) + 1, rows.shape[1]), np.int64)
    np.cumsum(rows, axis=0, out=sums[1:])
    whole, part = np.divmod(np.arange(n + 1) * len(rows), n)
    return np.diff(n * sums[whole] + part[:, None] * rows[np.minimum(whole, len(rows) - 1)], axis=0)


#: What a frequency must lie over the median by, in sample values added over the 32 x 32 cells: less is not told from flat.
TOLERANCE = 2


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as 16 hex digits, first bit highest: which of the 8 x 8 lowest frequencies lie over their median by TOLERANCE.

    All in integers (cells in 64ths of a sample value, rounded down), so equal samples hash alike on every machine.
    """
    height, width = samples.shape
    wide = 32 * samples.reshape(height, 32, -1).sum(2, dtype=np.int64) if width % 32 == 0 else _shrink(samples.T.astype(np.int64), 32).T
    cells = _shrink(wide, 32) * 64 // (height * width)
    c = _cosines()
    low = (c @ cells @ c.T).ravel()
    middle = np.sort(low)[len(low) // 2 - 1 : len(low) // 2 + 1].sum()
    return np.packbits(2 * low > middle + 2 * TOLERANCE * 64 * (1 << 28)).tobytes().hex()


def media_row(text: bytes, width: int = WIDTH) -> tuple:
    """n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media of one text."""
    padded = text + b" " * (-len(text) % width or (0 if text else width))
    media = png_encode(padded, width)
    samples = png_decode(media)
    back = samples.tobytes()
    if back != padded:
        raise ValueError("the image does not hold the payload")
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples), media


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the digests of FIELDS and the PNG itself in the binary column media. One narrow pass, no shuffle."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # the images of a slice only
                part = batch.slice(at, 512)
                rows = [media_row(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id long, {FIELDS}")
