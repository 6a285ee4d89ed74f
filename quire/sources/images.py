"""Image files: PNG and PNM decoded and written with numpy and zlib, resolutions from file headers.

An image column is struct<h, w, c, data> as in operators.raster. What can't be decoded
(other formats, damaged files) gives null, so that one file never stops a job; a
`decoder` of the caller's, if given, is tried on it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.operators.raster import IMAGE, pack, unpack

PNG = b"\x89PNG\r\n\x1a\n"
USUAL_DPI = 230
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG)
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfilter(raw: np.ndarray, h: int, stride: int, step: int) -> np.ndarray:
    """Scan lines without their filters; raw has a filter byte before each."""
    rows = raw[: h * (stride + 1)].reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + above
        elif kind == 1:
            for k in range(step):
                out[y, k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        else:
            got, up, src = bytearray(stride), above.tolist(), line.tolist()
            for i in range(stride):
                a = got[i - step] if i >= step else 0
                b, c = up[i], up[i - step] if i >= step else 0
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                got[i] = (src[i] + guess) & 255
            out[y] = np.frombuffer(bytes(got), np.uint8)
        above = out[y]
    return out


def _samples(lines: np.ndarray, w: int, channels: int, depth: int) -> np.ndarray:
    """[h, w, channels] of scan lines; sixteen bits lose their lower byte, fewer than eight stay as they are."""
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
        lines = (bits * (1 << np.arange(depth)[::-1])).sum(2).astype(np.uint8)
    return lines[:, : w * channels].reshape(len(lines), w, channels)


def decode_png(data: bytes) -> np.ndarray:
    """[h, w, 3] of gray, palette and true-colour files of any depth, interlaced or not; transparent pixels are laid over white."""
    head, body, palette, clear = b"", [], None, b""
    for kind, chunk in png_chunks(data):
        if kind == b"IHDR":
            head = chunk
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body.append(chunk)
    w, h, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    channels, raw = _CHANNELS[color], np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    step = max(1, channels * depth // 8)

    def part(at: int, ph: int, pw: int) -> tuple[np.ndarray, int]:
        stride = -(-pw * channels * depth // 8)
        return _samples(_unfilter(raw[at:], ph, stride, step), pw, channels, depth), at + ph * (stride + 1)

    if interlaced:
        a, at = np.zeros((h, w, channels), np.uint8), 0
        for y0, x0, dy, dx in _PASSES:
            ph, pw = -(-(h - y0) // dy), -(-(w - x0) // dx)
            if ph > 0 and pw > 0:
                a[y0::dy, x0::dx], at = part(at, ph, pw)
    else:
        a, _ = part(0, h, w)
    alpha = None
    if color == 3:
        if clear:
            alpha = np.append(np.frombuffer(clear, np.uint8), np.full(256 - len(clear), 255, np.uint8))[a[..., 0]]
        a = palette[a[..., 0]]
    else:
        if depth < 8:
            a = (a.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        if color in (4, 6):
            a, alpha = a[..., :-1], a[..., -1]
        a = np.repeat(a, 3, 2) if a.shape[2] == 1 else a
    if alpha is not None:
        k = alpha[..., None].astype(np.int32)
        a = ((a * k + 255 * (255 - k)) // 255).astype(np.uint8)
    return np.ascontiguousarray(a)


def encode_png(a: np.ndarray, dpi: int | None = None) -> bytes:
    """A gray (one channel) or true-colour file."""
    a = a if a.ndim == 3 else a[:, :, None]
    h, w, c = a.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(a, np.uint8).reshape(h, w * c)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    density = chunk(b"pHYs", struct.pack(">IIB", round(dpi / 0.0254), round(dpi / 0.0254), 1)) if dpi else b""
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if c == 1 else 2, 0, 0, 0)) + density + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def decode_pnm(data: bytes) -> np.ndarray:
    """[h, w, 3] of PBM, PGM and PPM files, plain or raw."""
    kind, at = data[1] - 48, 2
    fields: list[int] = []
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)").match(data, at)
        fields.append(int(m[1]))
        at = m.end()
    w, h, most = (*fields, 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    if kind == 1:
        a = np.array([c - 48 for c in data[at:] if c in b"01"], np.int32)
    elif kind in (2, 3):
        a = np.array(data[at:].split(), np.int32)
    elif kind == 4:
        stride = -(-w // 8)
        a = np.unpackbits(np.frombuffer(data, np.uint8, stride * h, at + 1).reshape(h, stride), axis=1)[:, :w].astype(np.int32)
    else:
        a = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * channels, at + 1).astype(np.int32)
    a = a.ravel()[: w * h * channels].reshape(h, w, channels)
    a = (1 - a) * 255 if kind in (1, 4) else a * 255 // most
    return np.repeat(a, 3 // channels, 2).astype(np.uint8)


def decode(data: bytes, decoder: Callable[[bytes], np.ndarray] | None = None) -> np.ndarray | None:
    try:
        if data.startswith(PNG):
            return decode_png(data)
        if re.match(rb"P[1-6]\s", data):
            return decode_pnm(data)
        return None if decoder is None else decoder(data)
    except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
        return None


def _tiff_resolution(data: bytes) -> tuple[float, int] | None:
    """(resolution, unit) of the first directory of TIFF data; unit 2 is inch, 3 centimetre."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return None
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    found, unit = None, 2
    for i in range(n):
        tag, kind, _, value = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
        if tag == 282 and kind == 5:
            top, by = struct.unpack_from(order + "II", data, value)
            found = top / by if by else None
        elif tag == 296:
            (unit,) = struct.unpack_from(order + "H", data, at + 2 + 12 * i + 8)
    return None if found is None else (found, unit)


def dpi(data: bytes | None) -> int:
    """Dots per inch that a PNG, JPEG or TIFF header tells; 230 where it tells none, 1, or can't be read."""
    try:
        got: tuple[float, int] | None = None
        if data.startswith(PNG):
            for kind, chunk in png_chunks(data):
                if kind == b"pHYs" and chunk[8] == 1:
                    got = round(struct.unpack_from(">I", chunk)[0] * 0.0254), 2
        elif data[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
                (n,) = struct.unpack_from(">H", data, at + 2)
                body = data[at + 4 : at + 2 + n]
                if data[at + 1] == 0xE0 and body[:5] == b"JFIF\0" and body[7] in (1, 2):
                    got = struct.unpack_from(">H", body, 8)[0], body[7] + 1
                elif data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
                    got = _tiff_resolution(body[6:]) or got
                at += 2 + n
        else:
            got = _tiff_resolution(data)
        if got is None or got[0] == 1:
            return USUAL_DPI
        return int(got[0] / 2.54 if got[1] == 3 else got[0])
    except (AttributeError, TypeError, IndexError, struct.error):
        return USUAL_DPI


def with_images(files: DataFrame, content: str = "content", decoder: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """Files with `image` and `dpi`; files are decoded where they are read."""
    others = [c for c in files.columns if c != content]
    schema = T.StructType([*(files.schema[c] for c in others), T.StructField("image", IMAGE), T.StructField("dpi", T.IntegerType())])
    kind = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(len(others)).to_pylist()
            images = pa.array([None if r is None else pack(decode(bytes(r), decoder)) for r in raw], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], images, pa.array([dpi(r) for r in raw], pa.int32())], names=schema.names)

    return files.select(*others, content).mapInArrow(run, schema)


def as_png(images: DataFrame, column: str = "image", out: str = "png") -> DataFrame:
    """Images with `out`, the file that holds them."""
    schema = T.StructType([*images.schema, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if v is None else encode_png(unpack(v)) for v in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=schema.names)

    return images.mapInArrow(run, schema)


def swap_channels(a: np.ndarray) -> np.ndarray:
    """Blue, green, red from red, green, blue and back; one channel becomes three."""
    a = a if a.ndim == 3 else a[:, :, None]
    return np.repeat(a, 3, 2) if a.shape[2] == 1 else a[..., ::-1]
