"""Media columns: Netpbm and BMP images decoded to arrays, resized by area, written as NPY tiles with difference hashes.

Images are bytes in a binary column. decode_image() reads P1 to P6 and uncompressed BMP of 8, 24 or 32 bits.
An image becomes tiles of at most TILE by TILE pixels, each written as one NPY file; reading the tiles back in
order gives the samples again, bit for bit. Means over areas come from an integral image, which is bilinear
between its points, so fractional areas are exact.

Defined cases: null or broken images, also those whose header asks for more samples than there are, give null results
and the reason; a null or empty text is stored like an empty payload (one unit of padding); a very long text becomes a
high image of many tiles; repeated rows give equal values; an empty table gives no rows; columns named like a result are
replaced, others are kept.
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

from .common import releasing

TILE = 256
#: A text's payload is padded to a multiple of this: 24 rows of 24 grey pixels, or 8 rows of 24 pixels of three samples.
UNIT = 576
WIDTH = 24


# ---------------------------------------------------------------- formats


def encode_netpbm(image: np.ndarray) -> bytes:
    kind = b"P5" if image.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom, each padded to four bytes."""
    h, w = image.shape[:2]
    rgb = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
    rows = np.zeros((h, -(-w * 3 // 4) * 4), dtype=np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)").match(data, at)
        numbers.append(int(m[1]))
        at = m.end()
    w, h, top = (*numbers, 1)[:3]
    deep = 3 if kind in (3, 6) else 1
    least = -(-w // 8) * h if kind == 4 else w * h * deep * (2 if kind > 4 and top > 255 else 1)
    if w < 1 or h < 1 or not 0 < top < 1 << 16 or least > len(data) - at:
        raise ValueError("the header asks for more than there is")
    if kind <= 3:
        body = data[at:].split() if kind > 1 else list(re.sub(rb"\s", b"", data[at:]).decode())
        out = np.array([int(x) for x in body[: w * h * deep]])
    elif kind == 4:
        out = np.unpackbits(np.frombuffer(data, np.uint8, -(-w // 8) * h, at + 1).reshape(h, -1), axis=1)[:, :w]
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * deep, at + 1)
    if kind in (1, 4):
        out = (1 - out) * 255
    elif top != 255:
        out = out.astype(np.int64) * 255 // top
    return out.astype(np.uint8).reshape((h, w, 3) if deep == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    at, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    stride = -(-w * bits // 32) * 4
    if w < 1 or h == 0 or stride * abs(h) > len(data) - at:
        raise ValueError("the header asks for more than there is")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, min(1024, at - 14 - head), 14 + head).reshape(-1, 4)[:, 2::-1]
        return colours[rows[:, :w]]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode_image(data: bytes) -> np.ndarray:
    """Height by width of grey samples, or height by width by red, green and blue."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


# ---------------------------------------------------------------- areas and hashes


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over height by width equal areas of the grey image."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(grey, axis=0, out=sums[1:, 1:], dtype=np.float64)
    np.cumsum(sums[1:, 1:], axis=1, out=sums[1:, 1:])

    def between(table, edges):
        low = np.minimum(edges.astype(np.int64), table.shape[0] - 2)
        part = (edges - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    ys, xs = np.linspace(0, grey.shape[0], height + 1), np.linspace(0, grey.shape[1], width + 1)
    grid = between(between(sums, ys).T, xs).T
    return np.diff(np.diff(grid, axis=0), axis=1) / ((grey.shape[0] / height) * (grey.shape[1] / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each of 8 by 8 area means is less than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


# ---------------------------------------------------------------- NPY tiles


def to_tiles(image: np.ndarray, tile: int = TILE) -> list[bytes]:
    """NPY files of the image's tiles, row by row of tiles; those at the edges are smaller."""
    out = []
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            buffer = io.BytesIO()
            np.lib.format.write_array(buffer, np.ascontiguousarray(image[y : y + tile, x : x + tile]), version=(1, 0), allow_pickle=False)
            out.append(buffer.getvalue())
    return out


def from_tiles(tiles: list[bytes], width: int) -> np.ndarray:
    """The image again from its tiles, given its width."""
    rows, row, wide = [], [], 0
    for blob in tiles:
        part = np.lib.format.read_array(io.BytesIO(blob), allow_pickle=False)
        row.append(part)
        wide += part.shape[1]
        if wide >= width:
            rows.append(np.concatenate(row, axis=1) if len(row) > 1 else row[0])
            row, wide = [], 0
    return np.concatenate(rows, axis=0) if len(rows) > 1 else rows[0]


# ---------------------------------------------------------------- operators


def _mapped(df: DataFrame, column: str, one, schema: str, drop: bool = False) -> DataFrame:
    """df with the fields that one() returns for each value of a column, which may be dropped."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(schema)
    keep = [f for f in df.schema.fields if f.name not in extra.fieldNames() and not (drop and f.name == column)]
    whole = StructType(keep + extra.fields)
    fields = to_arrow_schema(extra)

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(column)
            made = [one(v.as_py()) for v in batch.column(at)]
            new = [pa.array([m[i] for m in made], type=f.type) for i, f in enumerate(fields)]
            kept = [batch.column(batch.schema.names.index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=whole.fieldNames())

    return df.mapInArrow(releasing(run), whole)


def _decoded(data: bytes | None) -> tuple:
    """height, width, channels, thumbnail, tiles, dhash and error of an image."""
    if data is None:
        return (None,) * 7
    try:
        image = decode_image(data)
        return (image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, to_tiles(area_resize(image, 8, 9))[0], to_tiles(image), difference_hash(image), None)
    except (ValueError, IndexError, struct.error, TypeError, ArithmeticError) as e:
        return (None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])


def decode_media(df: DataFrame, column: str = "media") -> DataFrame:
    """df with height, width, channels, thumbnail (8 by 9 area means as an NPY file), tiles (NPY files), dhash and error.

    Keeps df's other columns. Rows of broken images get nulls and the reason in error.
    """
    return _mapped(df, column, _decoded, "height int, width int, channels int, thumbnail binary, tiles array<binary>, dhash string, error string")


def text_payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8")
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def payload_image(payload: bytes) -> bytes:
    """The payload's bytes as the samples of an image: grey Netpbm, colour Netpbm or BMP by its number of units."""
    kind = len(payload) // UNIT % 3
    data = np.frombuffer(payload, np.uint8)
    if kind == 0:
        return encode_netpbm(data.reshape(-1, WIDTH))
    image = data.reshape(-1, WIDTH, 3)
    return encode_netpbm(image) if kind == 1 else encode_bmp(image)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id with n_bytes and media: the text's bytes, unpadded, and the image that holds them."""
    text = F.coalesce(docs["text"], F.lit(""))
    lean = docs.select("doc_id", text.alias("_text"))
    return _mapped(lean, "_text", lambda t: (len(t.encode("utf-8")), payload_image(text_payload(t))), "n_bytes long, media binary", drop=True)


def _digests(blobs: list[bytes], width: int) -> tuple:
    payload = from_tiles(blobs, width).tobytes()
    whole = b"".join(blobs)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(whole), hashlib.sha256(whole).hexdigest()


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and digests of what the tiles of each text's image hold when read back, of the tiles, and their hash.

    Storing, decoding, tiling and reading back happen in one pass: an image never goes back to the JVM.
    """

    def one(text: str) -> tuple:
        data = payload_image(text_payload(text))
        _, width, _, _, tiles, feature, _ = _decoded(data)
        return len(text.encode("utf-8")), *_digests(tiles, width), feature

    lean = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("_text"))
    return _mapped(lean, "_text", one, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", drop=True)


def media_digests(stored: DataFrame, column: str = "media") -> DataFrame:
    """doc_id, n_bytes, the digests that text_digests gives, and feature, from stored images; broken ones give nulls."""

    def one(data: bytes | None) -> tuple:
        _, width, _, _, tiles, feature, _ = _decoded(data)
        return (*_digests(tiles, width), feature) if tiles else (None,) * 6

    lean = stored.select("doc_id", "n_bytes", F.col(column).alias("_media"))
    return _mapped(lean, "_media", one, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", drop=True)
