"""Media columns: Netpbm and BMP to numpy arrays, area resize, NPY tiles, difference hashes.

An image is decoded to an array (height, width, channels) of 8-bit samples. A tile is its area average
over a fixed grid, from an integral image: the sum over any box, with fractional edges, is four
look-ups, so cost does not depend on the box. Tiles are written as NPY bytes; the difference hash tells for
8 x 8 cells of the luma whether a cell is brighter than its right neighbour.

For texts, ``store_bytes`` keeps the UTF-8 bytes, padded with 0 to a positive multiple of 64, as a
grey Netpbm image 64 samples wide, without loss; features are computed from the stored image only.

Defined cases: null is the empty text: 64 zero bytes; null, empty or broken media bytes decode to null features,
never to an error; equal texts give equal values; extra columns are ignored.
"""

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.llm.common import as_bytes, bound_batches, in_slices

WIDTH, TILE = 64, 16
_HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*(\S+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: bitmaps, grey maps and pixel maps, plain or raw, up to 8 or 16 bits (scaled to 8)."""
    kind, at, numbers = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _HEADER.match(data, at)
        numbers.append(int(m[1]))
        at = m.end()
    width, height, most = numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    shape, n = (height, width, channels), height * width * channels
    if width < 1 or height < 1 or not 0 < most < 65536:
        raise ValueError("size")
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = [c - 48 for c in body if c in b"01"] if kind == b"P1" else [int(x) for x in body.split()]
        raw = np.array(values[:n], np.int64)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * (-(-width // 8)), at + 1).reshape(height, -1)
        raw = np.unpackbits(rows, axis=1)[:, :width].astype(np.int64)
    elif kind in (b"P5", b"P6"):
        raw = np.frombuffer(data, np.uint8 if most < 256 else np.dtype(">u2"), n, at + 1)
    else:
        raise ValueError("not Netpbm")
    if raw.size != n:
        raise ValueError("short")
    if kind in (b"P1", b"P4"):
        return ((1 - raw) * 255).astype(np.uint8).reshape(shape)
    return (raw if most == 255 else (raw.astype(np.int64) * 255 + most // 2) // most).astype(np.uint8).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits."""
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if data[:2] != b"BM" or packed or bits not in (8, 24, 32) or width < 1 or height == 0:
        raise ValueError("not this kind of BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        return palette[rows]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode_media(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of every cell of a height x width grid over the image, as floats (height, width, channels)."""
    h, w, c = image.shape
    total = np.zeros((h + 1, w + 1, c))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def along(table: np.ndarray, cells: int, size: int, axis: int) -> np.ndarray:
        edge = np.arange(cells + 1) * (size / cells)
        low = np.minimum(edge.astype(int), size - 1)
        part = (edge - low).reshape([-1 if a == axis else 1 for a in range(3)])
        a = np.take(table, low, axis)
        return np.diff(a + (np.take(table, low + 1, axis) - a) * part, axis=axis)

    return along(along(total, height, h, 0), width, w, 1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: bit is 1 where a cell of the 8 x 9 luma grid is brighter than the one to its right."""
    luma = image if image.shape[2] == 1 else image @ np.array([[0.299], [0.587], [0.114]])
    grid = np.round(area_resize(luma, 8, 9)[:, :, 0], 6)
    return np.packbits(grid[:, :-1] > grid[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to side x side, as bytes of an NPY file of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def to_netpbm(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a raw grey map."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def padded(text: bytes) -> bytes:
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def store_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, media``: every text as a stored image."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(batch.column(1))
        media = pa.array([to_netpbm(padded(t)) for t in texts], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return bound_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(in_slices(500, make), f"doc_id {kind}, n_bytes long, media binary")


FEATURES = "height int, width int, channels int, tile binary, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def features_of(media: bytes | None) -> tuple:
    try:
        image = decode_media(media)
        samples = image.tobytes()
    except (TypeError, ValueError, IndexError, OverflowError, struct.error):
        return (None,) * 10
    h, w, c = image.shape
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return h, w, c, npy_tile(image), difference_hash(image), len(samples), sha(samples), zlib.crc32(samples[-WIDTH:]), len(media), sha(media)


def describe(rows: DataFrame, media: str = "media") -> DataFrame:
    """Rows with what their stored image holds: size, NPY tile, difference hash (``feature``) and digests.

    The samples are those read back from the stored bytes. Columns of the same names are replaced.
    """
    names = [f.split()[0] for f in FEATURES.split(", ")]

    @F.pandas_udf(FEATURES)
    def ask(column: pd.Series) -> pd.DataFrame:
        got = pd.DataFrame([features_of(x) for x in column], columns=names, dtype=object)
        return got

    kept = [F.col(f"`{c}`") for c in rows.columns if c not in names]
    return bound_batches(rows).select(*kept, ask(F.col(media)).alias("told")).select(*kept, "told.*")
