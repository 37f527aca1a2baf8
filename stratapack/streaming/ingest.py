"""Watching a directory: files that arrive are inspected and appended to a table of chunks exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import exprs
from ..operators.pipeline import encode_chunks, split_chunks

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (file_id, path, modified, content) of the files in a folder; the id is a hash of the path."""
    src = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return src.select(F.xxhash64("path").alias("file_id"), "path", F.col("modificationTime").alias("modified"), "content")


def inspected(files: DataFrame) -> DataFrame:
    """Type, size and CRC of each file of a stream or table."""
    typed = exprs.detect_types(files.withColumn("head", F.substring("content", 1, 4096)))
    return typed.select("file_id", "path", "modified", "type", "type_detail", F.octet_length("content").alias("size"), F.crc32("content").alias("crc"))


def volume_by_type(files: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Files and bytes by type and window of modification time; later arrivals than `late` are dropped by the watermark."""
    rows = inspected(files).withWatermark("modified", late)
    return rows.groupBy(F.window("modified", every).alias("window"), "type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, algo: str = "huffman", level: int = 1, chunk_size: int = 1 << 20) -> StreamingQuery:
    """Encodes what is in the folder into Parquet chunk rows and stops; a restart goes on where it ended."""
    chunks = encode_chunks(split_chunks(watch(spark, folder), chunk_size), algo, level)
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
