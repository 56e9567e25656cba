"""Media columns: Netpbm and BMP images to arrays, area-resized tiles and difference hashes.

An image is decoded to a (height, width, channels) array of 8-bit samples. Its tile is an area-weighted resize read from
an integral image: the sum over any box with fractional edges is a difference of four interpolated cells. The integral is
accumulated over bands of rows and only kept at the edges of the boxes, so an image of any size takes its own bytes and one
band. The tile is kept as NPY bytes. The difference hash compares horizontal neighbours of a 9 x 8 grey resize.

``stored_payload`` wraps any bytes losslessly as an image 64 pixels wide: padded with blanks to whole rows of 192 bytes.
``text_media`` writes these images to a Parquet data set in the shared folder, reads them back, writes their tiles and hashes
to a second one, and returns what that holds.

Defined results: a null or empty payload is padded to one row; equal payloads give equal forms and features; malformed
images raise ``ValueError`` in ``decode``, and give nulls in ``media_columns``; rows that repeat are images of their own; a
null doc_id is kept as null; neighbours of equal brightness give a 0 bit; columns of ``rows`` named like the new ones give way
in ``media_columns``, others are ignored in ``text_media``. A text of any length is one image, and a worker holds one at a time.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, written

ROW = 192
_NETPBM = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?(?:\s*#[^\n]*\n|\s)")
_BITMAP = re.compile(rb"P([14])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 .. P6. Bitmaps give 0 for black and 255 for white; samples up to 255 are unchanged, wider ones keep the high byte."""
    bits = data[1:2] in b"14"
    m = (_BITMAP if bits else _NETPBM).match(data)
    if not m:
        raise ValueError("not a Netpbm image")
    kind, width, height = int(m[1]), int(m[2]), int(m[3])
    channels = 3 if kind in (3, 6) else 1
    most, n = 1 if bits else int(m[4] or 0), width * height * channels
    if not bits and not 0 < most < 65536 or not n:
        raise ValueError("bad Netpbm header")
    body = data[m.end() :]
    if kind == 1:
        values = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", body)[:n], np.uint8) - ord("0")
    elif kind == 4:
        rows = np.frombuffer(body, np.uint8, height * (-(-width // 8))).reshape(height, -1)
        values = np.unpackbits(rows, axis=1)[:, :width].ravel()
    elif kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n]*", b"", body).split()[:n], np.int64)
    else:
        values = np.frombuffer(body, np.uint8 if most < 256 else ">u2", n)
    if len(values) < n:
        raise ValueError("Netpbm image is cut off")
    if bits:
        values = (1 - values) * 255
    elif most > 255:
        values = values >> 8
    return values.astype(np.uint8).reshape(height, width, channels)


def encode_netpbm(image: np.ndarray) -> bytes:
    height, width, channels = image.shape
    return b"P%d\n%d %d\n255\n" % (6 if channels == 3 else 5, width, height) + np.ascontiguousarray(image).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits, bottom-up or top-down."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    offset, header, width, height, planes, bits, compression = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (8, 24, 32) or compression not in (0, 3) or width <= 0 or height == 0 or planes != 1:
        raise ValueError("BMP kind isn't supported")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    if offset + rows * stride > len(data):
        raise ValueError("BMP image is cut off")
    image = np.frombuffer(data, np.uint8, rows * stride, offset).reshape(rows, stride)[:, : width * bits // 8].reshape(rows, width, bits // 8)
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(-1, 4)
        image = palette[image[:, :, 0]]
    image = image[:, :, 2::-1]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit, bottom-up."""
    if image.shape[2] == 1:
        image = np.repeat(image, 3, axis=2)
    height, width, _ = image.shape
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    size = 54 + rows.size
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int, band: int = 4_096) -> np.ndarray:
    """Means over the boxes of an even grid, as doubles; edges may cut pixels."""
    h, w, channels = image.shape

    def edges(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(cells + 1) * n / cells
        low = np.minimum(edge.astype(np.int64), n - 1)
        return low, edge - low

    # sums over the rows above each edge: whole rows, then the part of the row that the edge cuts
    low, part = edges(h, height)
    above, carry = np.empty((height + 1, w, channels)), np.zeros((w, channels), np.int64)
    for lo in range(0, h, band):
        sums = np.concatenate([carry[None], carry + image[lo : lo + band].cumsum(0, dtype=np.int64)])
        at = np.flatnonzero((low >= lo) & (low < lo + band))
        whole = sums[low[at] - lo]
        above[at] = whole + (sums[low[at] - lo + 1] - whole) * part[at, None, None]
        carry = sums[-1]
    integral = np.concatenate([np.zeros((height + 1, 1, channels)), above.cumsum(1)], axis=1)
    low, part = edges(w, width)
    grid = integral[:, low] * (1 - part)[:, None] + integral[:, low + 1] * part[:, None]
    boxes = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return boxes / (h / height * (w / width))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.shape[2] == 1 else (image.astype(np.int64) @ np.array([299, 587, 114]) // 1000).astype(np.uint8)[:, :, None]


def difference_hash(image: np.ndarray) -> int:
    """64 bits: is a cell of the 8 x 9 grey resize darker than its right neighbour? Row by row, first bit highest."""
    small = np.round(area_resize(grey(image), 8, 9)[:, :, 0], 6)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(image, side, side)).astype(np.uint8))
    return out.getvalue()


def stored_payload(raw: bytes) -> tuple[bytes, str]:
    """An image that holds ``raw`` and its padding as samples: PPM or BMP, by the parity of its checksum."""
    payload = raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return (encode_bmp(image), "bmp") if zlib.crc32(payload) & 1 else (encode_netpbm(image), "ppm")


def media_columns(rows: DataFrame, media: str = "media", side: int = 16) -> DataFrame:
    """``rows`` with height, width, tile (NPY bytes) and dhash (16 hex digits) of the images in ``media``."""
    names = [c for c in rows.columns if c not in ("height", "width", "tile", "dhash")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", height int, width int, tile binary, dhash string"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for data in batch.column(media).to_pylist():
                try:
                    image = decode(data or b"")
                    out.append((image.shape[0], image.shape[1], npy_tile(image, side), f"{difference_hash(image):016x}"))
                except ValueError:
                    out.append((None, None, None, None))
            new = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
            return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "height", "width", "tile", "dhash"])

        return step

    return map_text(rows.select(*names), make, schema, media)


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, format: the texts as images."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [(text or "").encode() for text in batch.column("text").to_pylist()]
            media, kinds = zip(*map(stored_payload, raw))
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(list(map(len, raw)), pa.int64()), "media": pa.array(media, pa.binary()), "format": pa.array(kinds)})

        return step

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_bytes long, media binary, format string")


def read_media(stored: DataFrame, keep: bool = False) -> DataFrame:
    """What the stored images hold: digests of payload and form, the tile (NPY bytes) and the feature; with ``keep`` also media."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, format string, tile binary" + ", media binary" * keep

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for media in batch.column("media"):
                data = media.as_py()
                image = decode(data)
                back, tile = image.tobytes(), npy_tile(image)
                feature = f"{difference_hash(image):016x}:{zlib.crc32(tile):08x}"
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, tile))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
            new = dict(zip(names, [pa.array(x, t) for x, t in zip(zip(*out), kinds)]))
            kept = {c: batch.column(c) for c in ("doc_id", "n_bytes", "format", "media")}
            return pa.RecordBatch.from_pydict({f.split()[0]: (kept | new)[f.split()[0]] for f in schema.split(", ")})

        return step

    return map_text(stored, make, schema, "media")


def text_media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Texts as images: what is stored, what is read back from it, and the features of that image.

    ``keep_media`` adds media (binary) and tile (NPY bytes), which are stored in any case.
    """
    stored = written(stored_media(docs), "media")
    found = written(read_media(stored, keep_media), "tiles")
    return found if keep_media else found.drop("tile")
