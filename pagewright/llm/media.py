"""Media columns: Netpbm and BMP images as binary values, decoded, resized, hashed and tiled.

Images are decoded to numpy arrays, shrunk by exact area means read off an integral image, written as NPY tiles,
and given a 64-bit difference hash (does each cell of a 9 x 8 thumbnail grow to the right?).
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
TILE = 32


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An 8-bit BMP with a grey palette, rows from the bottom up and padded to four bytes."""
    h, w = pixels.shape
    rows = np.pad(pixels[::-1], ((0, 0), (0, -w % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", 1078 + rows.size, 0, 0, 1078)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """The next ``count`` numbers of a Netpbm header and where the samples start; # starts a comment."""
    numbers, i = [], 2
    while len(numbers) < count:
        while data[i : i + 1].isspace():
            i += 1
        if data[i : i + 1] == b"#":
            i = data.index(b"\n", i)
            continue
        j = i
        while data[j : j + 1].isdigit():
            j += 1
        if i == j:
            raise ValueError("a Netpbm header must hold decimal numbers")
        numbers.append(int(data[i:j]))
        i = j
    return numbers, i + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as height x width (x 3) samples; one- and two-byte samples, plain and raw."""
    kind = data[1] - 48
    (w, h, *top), at = _header(data, 2 if kind in (1, 4) else 3)
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
        return ((1 - bits) * 255).astype(np.uint8)
    planes = 3 if kind in (3, 6) else 1
    if kind == 1:
        digits = np.frombuffer(data[at:], np.uint8)
        return ((49 - digits[(digits == 48) | (digits == 49)][: w * h]) * 255).astype(np.uint8).reshape(h, w)
    if kind in (2, 3):
        flat = np.array(data[at:].split()[: w * h * planes], np.uint16)
        flat = flat.astype(np.uint8) if top[0] < 256 else flat
    else:
        flat = np.frombuffer(data, np.uint8 if top[0] < 256 else ">u2", w * h * planes, at)
    return flat.reshape((h, w, 3) if planes == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (palette) and 24-bit BMP; grey palettes give height x width, else height x width x 3."""
    start, size, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or depth not in (8, 24):
        raise ValueError(f"BMP of depth {depth} and compression {packed} isn't read")
    step = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, step * abs(h), start).reshape(abs(h), step)[:, : w * depth // 8]
    rows = rows[::-1] if h > 0 else rows
    if depth == 24:
        return rows.reshape(abs(h), w, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
    if (palette == np.arange(len(palette))[:, None]).all():
        return np.ascontiguousarray(rows)
    return palette[rows]


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _edges(n: int, cells: int) -> np.ndarray:
    return np.arange(cells + 1) * (n / cells)


def resize(pixels: np.ndarray, height: int, width: int, held: int = 1 << 20) -> np.ndarray:
    """Area means on a height x width grid, read off an integral image.

    A cell's sum is the integral image at its four corners, interpolated between samples: exact for samples that
    are constant squares. Cells may be smaller than a sample. Rows of cells are taken together while they span at
    most ``held`` samples, and each such band has an integral image of its own, so memory doesn't follow the image.
    """
    grey = pixels.mean(axis=2) if pixels.ndim == 3 else pixels
    h, w = grey.shape
    ys, xs = _edges(h, height), _edges(w, width)
    x0 = np.minimum(xs.astype(np.int64), w - 1)
    together = max(1, min(height, height * held // (h * w)))
    out = np.empty((height, width))
    for r in range(0, height, together):
        cut = ys[r : r + together + 1]
        top = min(int(cut[0]), h - 1)
        band = grey[top : max(min(h, int(np.ceil(cut[-1]))), top + 1)]
        sums = np.zeros((len(band) + 1, w + 1))
        np.cumsum(np.cumsum(band, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
        k = np.minimum((cut - top).astype(np.int64), len(band) - 1)
        lines = sums[k] + (cut - top - k)[:, None] * (sums[k + 1] - sums[k])
        corners = lines[:, x0] + (xs - x0) * (lines[:, x0 + 1] - lines[:, x0])
        out[r : r + together] = np.diff(np.diff(corners, axis=0), axis=1)
    return out / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray) -> str:
    small = np.round(resize(pixels, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """A side x side thumbnail as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def payload_image(text: bytes) -> bytes:
    """A text as an image 64 samples wide: zero bytes fill it up to a positive multiple of 64.

    The checksum of the payload picks the format, so equal texts give equal images.
    """
    payload = text + bytes(-len(text) % WIDTH if text else WIDTH)
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_bmp(pixels) if zlib.crc32(payload) & 1 else encode_pgm(pixels)


def text_images(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add a binary column with each whole text as an image; null is the empty text (one row of zeros).

    A column already called ``media`` is replaced; others stay. Equal texts give equal images, no rows give none.
    """

    def draw(column: pa.Array) -> pa.Array:
        return pa.array([payload_image((x.as_py() or "").encode()) for x in column], pa.binary())

    return df.withColumn(media, F.arrow_udf(draw, "binary")(F.col(text)))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def media_features(df: DataFrame, media: str = "media", out: str = "features") -> DataFrame:
    """Decode each image and add a struct: digests of its samples and of its stored form, hash and NPY tile.

    A null image gives a null struct; bytes that are no readable image give a struct with null fields but
    media_bytes and media_sha256. Equal images give equal structs, whatever the row's other columns. A
    column already called ``out`` is replaced; others stay. No rows give none.
    """
    fields = [f.split() for f in FEATURES.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    shape = pa.struct([(n, kinds[k]) for n, k in fields])

    def one(data: bytes | None) -> dict | None:
        if data is None:
            return None
        row = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            pixels = decode(data)
        except (ValueError, struct.error, IndexError):
            return row
        samples = np.ascontiguousarray(pixels).tobytes()
        return row | {
            "payload_bytes": len(samples),
            "payload_sha256": hashlib.sha256(samples).hexdigest(),
            "tail_crc32": zlib.crc32(samples[-WIDTH:]),
            "feature": difference_hash(pixels),
            "tile": npy_tile(pixels),
        }

    def read(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([one(x.as_py()) for x in column], shape)

    return df.withColumn(out, F.arrow_udf(read, f"struct<{FEATURES.replace(' ', ':').replace(',:', ',')}>")(F.col(media)))
