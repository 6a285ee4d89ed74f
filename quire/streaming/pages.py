"""Structured Streaming: new files as they come, sessions by gap, running agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import is_image, is_xml, stem


def new_files(spark: SparkSession, folder: str, kind: str = "image", per_trigger: int = 1000) -> DataFrame:
    """Files that appear in a folder, each once: the checkpoint remembers them, so what is done is skipped."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)
    return raw.where((is_image if kind == "image" else is_xml)(F.col("path"))).withColumn("stem", stem(F.col("path")))


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of events whose neighbours are less than the gap apart."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    s = src.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def windows(events: DataFrame, ts: str, width: str, value: str, keys: list[str], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(keys, start, n, total) in tumbling or sliding windows."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    g = src.groupBy(*keys, F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(*keys, F.col("w.start").alias("start"), "n", "total")


def running_confusion(pairs: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n), for output mode `complete` or `update`."""
    return pairs.groupBy(truth, pred).agg(F.count("*").alias("n"))
