"""Sorted-string-table shards: documents by identifier, in prefix-compressed blocks.

A shard is one binary value, laid out like the files of a log-structured store:

    block*  each zstd-compressed: entries of varint(shared), varint(unshared),
            varint(value size), rest of the key, value; the first entry of every
            `restart` shares nothing
    index   zstd-compressed: for each block its last key, offset and size
    bloom   bit array, probed k times by double hashing
    footer  fixed 48 bytes: offsets and sizes of index and bloom, number of
            entries, probes, magic

so a reader needs the footer, the index and the filter to find the one block that
can hold a key, and searches it by its restarts.

Keys order like the identifiers: a null is the empty key, an integer 0x00 and its
eight big-endian bytes with the sign flipped, a string 0x01 and its UTF-8 bytes. The
value is the UTF-8 text after a 0x01, or empty for a null text.

Shards are cut from range partitions of the whole key and a hash of the value, so that
neither a common prefix nor one hot key fills a partition. A partition is sorted by
Spark (it spills) and written as it streams past, one shard at a time, so memory holds
one shard, and no document is cut. A document larger than a shard is a shard of its own.

Results for odd input: repeated keys are all kept, by a hash of their text and then by
text; rows with equal key and text are kept as often as they occur; a null or empty
text is kept as such; an empty table gives no shard; extra columns are left out. `get`
of an unknown key finds nothing.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import col, need, slots

MAGIC = 0x53535451_00000001
FOOTER = struct.Struct("<QQQQQII")


@dataclass(frozen=True)
class Config:
    shard: int = 8 << 20  # bytes of text in a shard, about
    block: int = 32 << 10  # bytes of entries in a block, about
    restart: int = 16
    bits: int = 10  # of the filter for each key
    level: int = 1


SCHEMA = "shard_key binary, last_key binary, entries bigint, blocks int, size bigint, data binary"


def key_of(x: int | str | None) -> bytes:
    if x is None:
        return b""
    return b"\0" + struct.pack(">Q", x + (1 << 63)) if isinstance(x, int) else b"\1" + x.encode()


def id_of(key: bytes) -> int | str | None:
    if not key:
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] == 0 else key[1:].decode()


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        n |= (x & 127) << shift
        at += 1
        if x < 128:
            return n, at
        shift += 7


def _two_hashes(key: bytes) -> tuple[int, int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return a, b | 1


def bloom(keys: list[bytes], bits: int) -> tuple[bytes, int]:
    """(bit array, number of probes) over the distinct keys."""
    keys = list(dict.fromkeys(keys))
    m, k = max(64, -(-len(keys) * bits // 8) * 8), max(1, round(bits * 0.69))
    h = np.array([_two_hashes(x) for x in keys], np.uint64).reshape(-1, 2)
    array = np.zeros(m, bool)
    for i in range(k):
        array[((h[:, 0] + np.uint64(i) * h[:, 1]) % np.uint64(m)).astype(np.int64)] = True
    return np.packbits(array, bitorder="little").tobytes(), k


def may_hold(bits: bytes, k: int, key: bytes) -> bool:
    a, b = _two_hashes(key)
    m, wrap = len(bits) * 8, (1 << 64) - 1
    return all(bits[(p := ((a + i * b) & wrap) % m) >> 3] >> (p & 7) & 1 for i in range(k))


class Builder:
    """Collects sorted entries into one shard."""

    def __init__(self, config: Config):
        self.config, self.zstd = config, zstandard.ZstdCompressor(level=config.level)
        self.parts: list[bytes] = []
        self.index = bytearray()
        self.keys: list[bytes] = []
        self.offset = self.taken = self.blocks = 0
        self._open()

    def _open(self) -> None:
        self.body, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % self.config.restart == 0:
            self.restarts.append(len(self.body))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.body += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.count, self.taken = key, self.count + 1, self.taken + len(key) + len(value)
        self.keys.append(key)
        if len(self.body) >= self.config.block:
            self._close()

    def _close(self) -> None:
        if not self.count:
            return
        self.body += struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        packed = self.zstd.compress(bytes(self.body))
        self.index += varint(len(self.last)) + self.last + varint(self.offset) + varint(len(packed))
        self.parts.append(packed)
        self.offset += len(packed)
        self.blocks += 1
        self._open()

    def finish(self) -> tuple[bytes, bytes, int, int, int, bytes]:
        self._close()
        index = self.zstd.compress(bytes(self.index))
        bits, k = bloom(self.keys, self.config.bits)
        foot = FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bits), len(self.keys), k, MAGIC & 0xFFFFFFFF)
        data = b"".join([*self.parts, index, bits, foot])
        return self.keys[0], self.keys[-1], len(self.keys), self.blocks, len(data), data


class Reader:
    """Looks keys up in one shard."""

    def __init__(self, data: bytes):
        self.data, self.zstd = data, zstandard.ZstdDecompressor()
        i, ni, b, nb, self.entries, self.k, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC & 0xFFFFFFFF:
            raise ValueError("not a shard")
        self.bits = data[b : b + nb]
        raw, at = self.zstd.decompress(data[i : i + ni]), 0
        self.last: list[bytes] = []
        self.place: list[tuple[int, int]] = []
        while at < len(raw):
            n, at = read_varint(raw, at)
            self.last.append(raw[at : at + n])
            off, at = read_varint(raw, at + n)
            size, at = read_varint(raw, at)
            self.place.append((off, size))

    def _block(self, i: int) -> tuple[bytes, tuple[int, ...]]:
        off, size = self.place[i]
        raw = self.zstd.decompress(self.data[off : off + size])
        (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 - 4 * n
        return raw[:end], struct.unpack_from(f"<{n}I", raw, end)

    @staticmethod
    def _walk(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.place)):
            yield from self._walk(self._block(i)[0], 0)

    def get(self, key: bytes) -> list[bytes]:
        """The values of the key: filter, index, restarts, then a short walk."""
        found: list[bytes] = []
        if not may_hold(self.bits, self.k, key):
            return found
        for i in range(bisect_left(self.last, key), len(self.place)):
            raw, restarts = self._block(i)
            at = max(0, bisect_left(restarts, key, key=lambda r: next(self._walk(raw, r))[0]) - 1)
            for k, v in self._walk(raw, restarts[at]):
                if k > key:
                    return found
                if k == key:
                    found.append(v)
        return found


def build(docs: DataFrame, key: str = "doc_id", value: str = "text", config: Config = Config(), parts: int | None = None) -> DataFrame:
    """One row for each shard: its first and last key, counts and bytes."""
    need(docs, key, value)
    spark = docs.sparkSession
    rows = docs.select(col(key).alias("k"), col(value).alias("v"))
    if not isinstance(rows.schema["k"].dataType, T.StringType):
        rows = rows.withColumn("k", F.col("k").cast("bigint"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("v")]
    sent = rows.repartitionByRange(parts or slots(spark), *order).sortWithinPartitions(*order, F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: Builder | None = None

        def shard(b: Builder) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(b.finish(), (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["shard_key", "last_key", "entries", "blocks", "size", "data"])

        for batch in batches:
            values = pc.cast(batch.column(1), pa.large_string()).cast(pa.large_binary())
            for k, v in zip(batch.column(0).to_pylist(), values):
                v = v.as_py()
                if open_ is not None and open_.taken and open_.taken + len(v or b"") > config.shard:
                    yield shard(open_)
                    open_ = None
                open_ = open_ or Builder(config)
                open_.add(key_of(k), b"" if v is None else b"\1" + v)
        if open_ is not None:
            yield shard(open_)

    return sent.select("k", "v").mapInArrow(run, SCHEMA)


def lookup(shards: DataFrame, keys: list[int | str | None]) -> DataFrame:
    """(key, value) of the keys; shards whose range holds none of them are not read."""
    coded = sorted({key_of(k) for k in keys})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = [k for k in coded if first <= k <= last]
                if own:
                    reader = Reader(data)
                    found = [(k, v) for k in own for v in reader.get(k)]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([v[1:].decode() if v else None for _, v in found], pa.string())], names=["key", "value"])

    if not coded:
        return shards.sparkSession.createDataFrame([], "key binary, value string")
    near = shards.where((F.col("shard_key") <= F.lit(bytearray(coded[-1]))) & (F.col("last_key") >= F.lit(bytearray(coded[0]))))
    return near.select("shard_key", "last_key", "data").mapInArrow(run, "key binary, value string")


def scan(shards: DataFrame) -> DataFrame:
    """(key, value) of every entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = list(Reader(data).scan())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([v[1:].decode() if v else None for _, v in found], pa.string())], names=["key", "value"])

    return shards.select("data").mapInArrow(run, "key binary, value string")
