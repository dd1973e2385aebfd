"""Media columns: bytes as grey PNG images in a binary column, read back, with a cosine-transform hash.

`encode` writes rows of 64 samples of 8 bits as PNG (signature, IHDR, IDAT, IEND, each chunk with its
CRC), each row under the filter of the least sum of absolute differences, the first of equals; `decode`
reads any grey or colour PNG of 8 bits without interlacing: it tests every chunk's CRC, joins the IDAT
data, inflates it and undoes all five filters: rows that depend on their left neighbours only by sums with
numpy, blocks of Average and Paeth rows by anti-diagonals, whose pixels don't depend on each other, or
pixel by pixel where a block is too small for that to pay. `dct_hash` averages the image to 32 x 32, takes
the 8 x 8 lowest frequencies of the cosine transform and sets a bit for each that is above their median.
Images are handled one at a time, so memory is bounded by the largest one.

`stored` puts the images in a binary column, and `described` computes all else from that column alone.

Defined results: null and empty texts are 64 bytes 0; equal texts give equal values in all columns; null
identifiers and repeated rows pass through; a very long text is one image of as many rows as it takes, held
once by its task; other columns aren't read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # by colour type
STORED = "doc_id bigint, n_bytes bigint, media binary"
SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media binary"


DIAGONAL = 130  # pixels that take as long one by one as a diagonal does


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _filter(rows: np.ndarray) -> np.ndarray:
    """A filter type and the filtered bytes of each grey row."""
    x = np.zeros((len(rows) + 1, WIDTH + 1), np.int16)
    x[1:, 1:] = rows
    left, up, corner = x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    p = left + up - corner
    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    choices = np.stack([rows, *[(rows - guess).astype(np.uint8) for guess in (left, up, (left + up) >> 1, paeth)]])
    kinds = np.abs(choices.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    return np.concatenate([kinds[:, None].astype(np.uint8), choices[kinds, np.arange(len(rows))]], axis=1)


def encode(payload: bytes, level: int = 6) -> bytes:
    """A grey PNG of 64 columns; the payload's length is a positive multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = _filter(rows)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _by_pixel(kinds: list[int], rows: np.ndarray, above: np.ndarray, step: int) -> None:
    for kind, row in zip(kinds, rows, strict=True):
        done, over = [0] * step, above.tolist()
        if kind == 3:
            for x, up in zip(row.tolist(), over, strict=True):
                done.append((x + ((done[-step] + up) >> 1)) & 255)
        else:
            for x, up, corner in zip(row.tolist(), over, [0] * step + over, strict=False):
                left = done[-step]
                a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                done.append((x + (left if a <= b and a <= c else up if b <= c else corner)) & 255)
        row[:] = done[step:]
        above = row


def _by_diagonal(kinds: list[int], rows: np.ndarray, above: np.ndarray, step: int) -> None:
    high, wide = len(rows), rows.shape[1] // step
    pixels, average = rows.reshape(high, wide, step), np.array(kinds)[:, None] == 3
    out = np.zeros((high + 1, wide + 1, step), np.int16)
    out[0, 1:] = above.reshape(wide, step)
    for k in range(high + wide - 1):
        y = np.arange(max(0, k - wide + 1), min(high, k + 1))
        x = k - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[y + 1, x + 1] = (pixels[y, x] + np.where(average[y], (left + up) >> 1, paeth)) & 255
    pixels[:] = out[1:, 1:]


def _unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """lines: a filter type and the filtered bytes in each row; step: bytes a pixel."""
    kinds, out = lines[:, 0].tolist(), lines[:, 1:].copy()
    if max(kinds, default=0) > 4:
        raise ValueError(f"unknown filter {max(kinds)}")
    above, y = np.zeros(out.shape[1], np.uint8), 0
    while y < len(out):
        kind, row, end = kinds[y], out[y], y + 1
        if kind == 1:
            pixels = row.reshape(-1, step)
            np.cumsum(pixels, axis=0, dtype=np.uint8, out=pixels)
        elif kind == 2:
            row += above
        elif kind > 2:
            while end < len(out) and kinds[end] > 2:
                end += 1
            high, wide = end - y, len(row) // step
            (_by_diagonal if high * wide > DIAGONAL * (high + wide) else _by_pixel)(kinds[y:end], out[y:end], above, step)
        above, y = out[end - 1], end
    return out


def decode(png: bytes) -> np.ndarray:
    """Samples as (height, width, channels)."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, idat, ended = 8, None, [], False
    while at < len(png) and not ended:
        (size,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + size]
        if len(data) != size or png[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            idat.append(data)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("not a whole PNG of 8-bit samples without palette or interlacing")
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8)
    if lines.size != height * (width * n + 1):
        raise ValueError("wrong number of samples")
    return _unfilter(lines.reshape(height, width * n + 1), n).reshape(height, width, n)


_K = np.arange(32)
_COSINES = np.cos(np.pi * (2 * _K[None, :] + 1) * np.arange(8)[:, None] / 64)


def _averaged(x: np.ndarray, to: int) -> np.ndarray:
    """Means over `to` even slices of the first axis; slices shorter than one row repeat it."""
    edges = np.arange(to + 1) * len(x) // to
    low, high = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
    return (sums[high] - sums[low]) / (high - low)[:, None]


def dct_hash(image: np.ndarray) -> str:
    """16 hex digits: bit (v, u) tells if that low frequency is above the median of all 64."""
    grey = image.astype(np.float64).mean(axis=2) if image.shape[2] > 1 else image[:, :, 0]
    small = _averaged(_averaged(grey, 32).T, 32).T
    low = np.round(_COSINES @ small @ _COSINES.T, 6)
    return np.packbits(low.ravel() > np.median(low)).tobytes().hex()


def _rows(one, schema: str, columns: int):
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [one(*x) for x in zip(*(part.column(i).to_pylist() for i in range(columns)), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _image(doc: int | None, text: str | None) -> tuple:
    raw = (text or "").encode()
    return doc, len(raw), encode(padded(raw))


def _description(doc: int | None, n_bytes: int, png: bytes) -> tuple:
    image = decode(png)
    payload = image.tobytes()
    return doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), dct_hash(image), png


def stored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes of the text and its image in the column media. No shuffle."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_rows(_image, STORED, 2), STORED)


def described(images: DataFrame) -> DataFrame:
    """Per row of `stored`: sizes, digests and the hash, from the samples read back, and the image. No shuffle."""
    return images.select("doc_id", "n_bytes", "media").mapInArrow(_rows(_description, SCHEMA, 3), SCHEMA)


def media_columns(docs: DataFrame, **columns) -> DataFrame:
    """Per row: the image of the text as a binary column, and its description."""
    return described(stored(docs, **columns))
