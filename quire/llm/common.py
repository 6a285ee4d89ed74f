"""What the operators share: shared folder, output columns, Arrow types."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the session's checkpoint directory; one of this machine's own only where neither is set and executors are threads of the driver."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(spark.sparkContext, "_quire_folder", None)
        if not at:
            at = spark.sparkContext._quire_folder = tempfile.mkdtemp(prefix="quire-")
            atexit.register(shutil.rmtree, at, True)
    return at


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, and losing an executor loses nothing. `drop` removes it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._quire_tables = [*getattr(spark.sparkContext, "_quire_tables", []), path]
    got = spark.read.schema(df.schema).parquet(path)
    got._quire_path = path
    return got


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)
    spark.sparkContext._quire_tables.remove(path)


def drop(*tables: DataFrame) -> None:
    """Removes tables of `written` that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._quire_path)


def sweep(spark: SparkSession) -> None:
    """Removes all tables of `written`: for when the results that read them have been written or collected."""
    for path in list(getattr(spark.sparkContext, "_quire_tables", [])):
        _delete(spark, path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of the frame has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bounded_texts(docs: DataFrame, picked: DataFrame, most: int, columns: list[str]) -> list:
    """Rows (doc_id, label, text, columns) of the picked ids (doc_id, label), one a document: by a hash of the id, as many as fit into `most` bytes of text.

    picked must be of bounded size. Of rows of equal doc_id the one with the smallest hash
    of its text is taken. Sizes are gathered first, so neither a hot id nor long texts can
    bring more to the driver.
    """
    size = F.struct(F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    sizes = docs.select("doc_id", size.alias("s")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("s").alias("s"), F.min(F.xxhash64("doc_id")).alias("place")).collect()
    chosen, left = [], most
    for r in sorted(sizes, key=lambda r: (r.place, r.doc_id)):
        if r.s.n <= left:
            left -= r.s.n
            chosen.append((r.doc_id, r.label, r.s.h))
    ids = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("h", T.LongType())]))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"), *columns).join(F.broadcast(ids), ["doc_id", "h"])
    return rows.dropDuplicates(["doc_id"]).collect()


def vocabulary(spark: SparkSession, name: str) -> str:
    """The path of a tokenizer's file: in the folder of spark.quire.vocabularies or QUIRE_VOCABULARIES, else where this environment keeps them."""
    return f"{spark.conf.get('spark.quire.vocabularies', None) or os.environ.get('QUIRE_VOCABULARIES', '/opt/tokenizers')}/{name}"


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def col(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def slots(spark: SparkSession) -> int:
    """Partitions for shuffled blobs: what the session says."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


@dataclass(frozen=True)
class Blocks:
    """Work dealt by hash to parts x subs blocks: a partition takes its blocks one after another, so memory holds one block whatever the input."""

    parts: int
    subs: int

    @property
    def all(self) -> int:
        return self.parts * self.subs


def blocks_for(docs: DataFrame, column: str, most: int) -> Blocks:
    """As many blocks as leave each about `most` bytes of the column, over the session's partitions."""
    total = docs.agg(F.sum(F.octet_length(column).cast("bigint"))).first()[0] or 0
    parts = slots(docs.sparkSession)
    return Blocks(parts, -(-int(total) // (most * parts)) or 1)


def binary(views: list[bytes]) -> pa.Array:
    return pa.array(views, pa.large_binary()).cast(pa.binary())


def longs(a: np.ndarray) -> pa.Array:
    """uint64 hashes as the signed integers of a bigint column."""
    return pa.array(np.ascontiguousarray(a).view(np.int64))


LONG, INT, DOUBLE, STRING, BOOL, BYTES = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.BinaryType()


def planes(a: np.ndarray) -> bytes:
    """The integers byte plane by byte plane: planes of zeros shrink to nothing in a compressed shuffle."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    head = np.array([x for a in arrays for x in (len(a), a.itemsize)], np.int64)
    return np.int64(len(arrays)).tobytes() + head.tobytes() + b"".join(planes(a) for a in arrays)


def unpack_arrays(raw: bytes, *kinds: type) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for i, kind in enumerate(kinds):
        size = int(head[2 * i] * head[2 * i + 1])
        out.append(unplanes(raw[at : at + size], kind, int(head[2 * i])))
        at += size
    return out


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def release() -> None:
    """Gives freed memory back: Python workers live on after a task, and what they keep counts beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def squeezed(raw: bytes) -> bytes:
    """The bytes, compressed, so that a batch of large rows stays small on its way through the JVM."""
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(raw: bytes) -> bytes:
    return pa.decompress(memoryview(raw)[8:], int(np.frombuffer(raw, np.int64, 1)[0]), codec="zstd", asbytes=True)


def exchange(df: DataFrame, blocks: Blocks) -> DataFrame:
    """Sends rows (part int, blob binary), part being a block's number, to the block's partition, block after block."""
    sent = df.repartitionById(blocks.parts, (F.col("part") / blocks.subs).cast("int"))
    return sent.sortWithinPartitions("part") if blocks.subs > 1 else sent


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[bytes]]:
    """The blobs of (part, blob) batches, block after block; each block must be read to its end before the next."""
    rows = ((p, raw.as_py()) for b in batches for p, raw in zip(b.column(0).to_pylist(), b.column(1)))  # one blob at a time: a batch can be a partition
    for _, own in groupby(rows, key=lambda r: r[0]):
        yield (raw for _, raw in own)
        release()


class Seen:
    """A growing set of hashes: sorted runs of doubling size, merged as they meet, so that adding stays cheap."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def new(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the distinct, ascending hashes are new; they are taken in."""
        fresh = np.ones(len(hashes), bool)
        for r in self.runs:
            at = np.minimum(np.searchsorted(r, hashes), len(r) - 1)
            fresh &= r[at] != hashes
        run = hashes[fresh]
        while len(run) and self.runs and len(self.runs[-1]) <= len(run):
            run = np.sort(np.concatenate([run, self.runs.pop()]))
        if len(run):
            self.runs.append(run)
        return fresh


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each 64-bit hash, by its upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def plain(df: DataFrame) -> DataFrame:
    """The frame with names that mapInArrow can take: columns with a dot or backtick get another; undo with toDF."""
    return df.toDF(*(n if "." in c or "`" in c else c for c, n in zip(df.columns, free_names(df, *(f"__plain_{i}" for i in range(len(df.columns)))))))
