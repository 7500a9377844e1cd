"""Media columns: Netpbm and BMP bytes to arrays, area resize, NPY tiles, difference hashes.

Codecs are pure numpy. Images are uint8 arrays, (height, width) or (height, width, 3) in RGB.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text, spread, table

#: Payload samples in a row of the stored image, and the multiple to which payloads are padded.
ROW = 64


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 (grey) or P6 (RGB) with 8-bit samples."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, dtype=np.uint8).tobytes()


_GAP = rb"(?:\s|#[^\n\r]*[\n\r])+"


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to uint8 samples scaled to 0..255; 16-bit samples keep their higher byte's scale."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    n_fields = 2 if kind in (b"P1", b"P4") else 3
    head = re.match(rb"P\d" + (_GAP + rb"(\d+)") * n_fields, data)
    if not head:
        raise ValueError("bad Netpbm header")
    width, height, *rest = map(int, head.groups())
    most = rest[0] if rest else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not 0 < most < 65536 or not width or not height:
        raise ValueError("bad Netpbm header")
    n = width * height * channels
    if kind == b"P1":
        digits = re.sub(rb"[^01]", b"", re.sub(rb"#[^\n\r]*", b"", data[head.end() :]))
        values = np.frombuffer(digits, dtype=np.uint8)[:n] == 0x30
        samples, most = values.astype(np.int64), 1
    elif kind in (b"P2", b"P3"):
        samples = np.array([int(x) for x in re.sub(rb"#[^\n\r]*", b"", data[head.end() :]).split()[:n]], dtype=object)
    elif kind == b"P4":
        stride = -(-width // 8)
        raw = np.frombuffer(data, dtype=np.uint8, count=stride * height, offset=head.end() + 1).reshape(height, stride)
        samples = 1 - np.unpackbits(raw, axis=1)[:, :width].astype(np.int64).ravel()
    else:
        samples = np.frombuffer(data, dtype=np.uint8 if most < 256 else ">u2", count=n, offset=head.end() + 1)
    if len(samples) != n:
        raise ValueError("Netpbm image is cut short")
    if n and not 0 <= samples.min() <= samples.max() <= most:
        raise ValueError("Netpbm sample out of range")
    if most != 255:
        samples = (samples.astype(np.int64) * 255 + most // 2) // most
    image = samples.astype(np.uint8)
    return image.reshape((height, width, 3) if channels == 3 else (height, width))


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey (with a palette) or 24-bit BMP, bottom row first."""
    height, width = image.shape[:2]
    grey = image.ndim == 2
    line = width * (1 if grey else 3)
    rows = np.zeros((height, -(-line // 4) * 4), dtype=np.uint8)
    rows[:, :line] = (image if grey else image[:, :, ::-1].reshape(height, line))[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    offset = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", offset + rows.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette + rows.tobytes()


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The channel under a mask, scaled to 0..255; 0 without a mask."""
    shift = (mask & -mask).bit_length() - 1 if mask else 0
    most = mask >> shift
    return (((pixels & mask) >> shift) * 255 // max(most, 1)).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel, of 32 also with colour masks."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    offset, size = struct.unpack_from("<II", data, 10)
    width, height, _, depth, packed, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
    if packed not in (0, 3) or (packed and depth != 32) or depth not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("this kind of BMP is not read")
    stride = -(-width * depth // 32) * 4
    raw = np.frombuffer(data, dtype=np.uint8, count=stride * abs(height), offset=offset).reshape(abs(height), stride)
    if height > 0:
        raw = raw[::-1]
    if packed:
        pixels = np.ascontiguousarray(raw[:, : width * 4]).view("<u4").astype(np.int64)
        return np.stack([_masked(pixels, m) for m in struct.unpack_from("<III", data, 54)], axis=-1)
    if depth >= 24:
        return np.ascontiguousarray(raw[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1])
    bits = np.unpackbits(raw, axis=1)[:, : width * depth].reshape(abs(height), width, depth)
    index = bits @ (1 << np.arange(depth)[::-1])
    palette = np.frombuffer(data, dtype=np.uint8, count=4 * (used or 1 << depth), offset=14 + size).reshape(-1, 4)[:, 2::-1]
    image = palette[index]
    return np.ascontiguousarray(image[:, :, 0] if (palette == palette[:, :1]).all() else image)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, from the integral image with linear interpolation."""
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]), dtype=np.float64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])

    def at(edge: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(np.floor(edge).astype(int), table.shape[0] - 2)
        part = (edge - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    rows = at(np.linspace(0, image.shape[0], height + 1), sums)
    both = at(np.linspace(0, image.shape[1], width + 1), rows.swapaxes(0, 1)).swapaxes(0, 1)
    total = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return total * (height * width / (image.shape[0] * image.shape[1]))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """Hex of size x size bits: is a cell of the resized grey image darker than its right one."""
    small = np.round(area_resize(grey(image), size, size + 1), 6)
    bits = small[:, :-1] < small[:, 1:]
    return np.packbits(bits.ravel()).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 32) -> bytes:
    """The image resized to side x side, rounded to uint8, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


_TILE_FIELDS = [T.StructField(n, t) for n, t in (("height", T.IntegerType()), ("width", T.IntegerType()), ("dhash", T.StringType()), ("tile", T.BinaryType()), ("error", T.StringType()))]


def tiles(images: DataFrame, data: str = "image", side: int = 32) -> DataFrame:
    """images with height, width, dhash, tile (NPY bytes) and error appended.

    `data` is a binary column. A null or unreadable image has nulls and says why in `error`. Other
    columns stay, but for those named like an output, which it replaces.
    """

    def make():
        def work(blobs):
            out = [[], [], [], [], []]
            for blob in blobs:
                try:
                    if blob is None:
                        raise ValueError("no image")
                    image = decode(bytes(blob))
                    row = (*image.shape[:2], difference_hash(image), npy_tile(image, side), None)
                except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:
                    row = (None, None, None, None, str(e))
                for to, x in zip(out, row, strict=True):
                    to.append(x)
            return out

        return work

    return map_text(images, data, _TILE_FIELDS, make)


def pack_text(text: str | None) -> tuple[int, bytes]:
    """Length of the text's UTF-8 bytes, and the grey Netpbm image that stores them, ROW samples a
    row, padded by zeros to a positive multiple of ROW."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + bytes(ROW - len(raw) if len(raw) < ROW else -len(raw) % ROW)
    return len(raw), encode_netpbm(np.frombuffer(padded, dtype=np.uint8).reshape(-1, ROW))


_STORED = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]


def stored_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes and media (a grey Netpbm image of the text's bytes) appended."""

    def make():
        def work(texts):
            both = [pack_text(t) for t in texts]
            return [[n for n, _ in both], [m for _, m in both]]

        return work

    return map_text(docs, text, _STORED, make)


_DIGESTS = [
    T.StructField(n, T.LongType() if n in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes") else T.StringType())
    for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256")
]


def text_media_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stores each text as an image, reads the stored bytes back and describes both.

    Null texts count as empty: 64 zero bytes. Equal texts give equal values. The features are the
    difference hash of the decoded image and the digest of its NPY tile.
    """

    def make():
        def work(texts):
            out = [[] for _ in _DIGESTS]
            for t in texts:
                n, media = pack_text(t)
                image = decode(media)
                payload = image.tobytes()
                row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(npy_tile(image)).hexdigest())
                for to, x in zip(out, row, strict=True):
                    to.append(x)
            return out

        return work

    return map_text(docs, text, _DIGESTS, make)


def op2_media(spark, sf_dir: str) -> DataFrame:
    """The digests of text_media_digests() of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return text_media_digests(docs).drop("text")
