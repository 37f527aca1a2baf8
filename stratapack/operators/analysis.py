"""Inspection of bytes, and the analyzer that chooses a codec by measured ratio and known cost."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import exprs
from ..functions.bits import varint
from ..functions.codecs import CODECS, STRIDES, best_stride, code_lengths, deltas, entropy, runs

#: Candidates of each priority in order, the level, and how much worse than the best ratio a faster codec may be (fixed values).
CANDIDATES = {
    "max-speed": ("rle huffman lz77", 1, 1.15),
    "balanced": ("lz77 lzw huffman delta-rle", 6, 1.05),
    "max-ratio": ("lz77 lzw bwt-mtf-ari delta-rle huffman", 9, 1.0),
}
#: From this ratio on data counts as incompressible.
VAIN = 0.98


def byte_counts(files: DataFrame) -> DataFrame:
    """(byte, n) over all content: counted by numpy in each batch, so a partition sends at most 256 rows a batch."""

    def count(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_buffer(), np.uint8), minlength=256)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["byte", "n"])

    return files.select("content").mapInArrow(count, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))


def byte_stats(files: DataFrame) -> DataFrame:
    """(file_id, n_bytes, entropy, rle_pairs, stride, stride_entropy, delta_pairs): one pass over each content, no shuffle."""
    fields = [("file_id", pa.int64()), ("n_bytes", pa.int64()), ("entropy", pa.float64()), ("rle_pairs", pa.int64()), ("stride", pa.int32()), ("stride_entropy", pa.float64()), ("delta_pairs", pa.int64())]

    def measure(batches):
        for batch in batches:
            rows = []
            for file_id, data in zip(batch.column("file_id").to_pylist(), batch.column("content"), strict=True):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                by_stride = [(round(entropy(deltas(raw, s)), 6), s) for s in STRIDES]
                best, stride = min(by_stride)
                rows.append((file_id, len(raw), entropy(raw), rle_bytes(raw) // 2, stride, best, rle_bytes(deltas(raw, stride)) // 2))
            cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

    return files.select("file_id", "content").mapInArrow(measure, "file_id bigint, n_bytes bigint, entropy double, rle_pairs bigint, stride int, stride_entropy double, delta_pairs bigint")


def varint_size(n: Column) -> Column:
    """Bytes of a length prefix."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("bigint")


def rle_bytes(raw: np.ndarray) -> int:
    """Bytes of the pairs of a run-length code."""
    return 2 * int((-(-runs(raw)[1] // 255)).sum()) if len(raw) else 0


def trial_size(name: str, data: bytes, level: int) -> int:
    """Bytes of a block under a codec; huffman, rle and delta-rle are counted instead of made."""
    raw, head = np.frombuffer(data, np.uint8), len(varint(len(data)))
    if name == "huffman":
        counts = np.bincount(raw, minlength=256)
        return head + 256 + (int((counts * code_lengths(counts)).sum()) + 7 >> 3)
    if name == "rle":
        return head + rle_bytes(raw)
    if name == "delta-rle":
        return head + (1 + rle_bytes(deltas(raw, best_stride(raw))) if len(raw) else 0)
    return len(CODECS[name].encode(data, level))


TRIAL = "array<struct<algo:string,ord:int,sample_bytes:bigint,compressed_bytes:bigint,ratio:double,elapsed_ms:double>>"


def measure(files: DataFrame, priority: str = "balanced", content: str = "content", vain: str = "dense") -> DataFrame:
    """Replaces `content` by sample_size, entropy and trials: each candidate of `priority` over the content as one block.  One pass, no shuffle.

    Rows where `vain` is true, and empty ones, have no trials; a codec that fails on a sample has none.  All other columns pass unchanged.
    """
    words, level, _ = CANDIDATES[priority]
    schema = T.StructType([*(f for f in files.schema.fields if f.name != content), T.StructField("sample_size", T.LongType()), T.StructField("entropy", T.DoubleType()), T.StructField("trials", T._parse_datatype_string(TRIAL))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                sizes, entropies, found = [], [], []
                for data, skip in zip(part.column(content).to_pylist(), part.column(vain).to_pylist(), strict=True):
                    data, own = data or b"", []
                    for ord_, name in enumerate(words.split()) if data and not skip else ():
                        began = time.perf_counter()
                        try:
                            n = trial_size(name, data, level)
                        except (ValueError, MemoryError):
                            continue
                        own.append({"algo": name, "ord": ord_, "sample_bytes": len(data), "compressed_bytes": n, "ratio": n / len(data), "elapsed_ms": (time.perf_counter() - began) * 1000})
                    sizes.append(len(data))
                    entropies.append(entropy(np.frombuffer(data, np.uint8)))
                    found.append(own)
                cols = [part.column(f.name) for f in schema.fields[:-3]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(entropies, pa.float64()), pa.array(found, arrow.field("trials").type)], schema=arrow)

    return files.mapInArrow(run, schema)


def speed_of(algo: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for c in CODECS.values():
        out = out.when(algo == c.name, F.lit(float(c.typical_speed_mbps)))
    return out


def chosen(trials: Column, tolerance: float, by_time: bool = False) -> Column:
    """struct(algo, ratio, best_ratio) of an array of trials: of the codecs within `tolerance` of the best ratio the fastest, of equals the first candidate; null without trials.

    Speed is the registry's figure, so the choice is repeatable; `by_time` takes the measured time.
    """
    best = F.array_min(F.transform(trials, lambda t: t["ratio"]))
    cost = (lambda t: t["elapsed_ms"]) if by_time else (lambda t: -speed_of(t["algo"]))
    order = (lambda t: [t["ratio"], t["ord"].cast("double")]) if tolerance <= 1 else (lambda t: [cost(t), t["ratio"], t["ord"].cast("double")])
    near = F.filter(trials, lambda t: t["ratio"] <= best * tolerance)
    first = F.array_min(F.transform(near, lambda t: F.struct(F.array(*order(t)).alias("order"), t["algo"].alias("algo"), t["ratio"].alias("ratio"))))
    return F.when(first.isNotNull(), F.struct(first["algo"].alias("algo"), first["ratio"].alias("ratio"), best.alias("best_ratio")))


def analyze(files: DataFrame, priority: str = "balanced", sample_bytes: int = 1 << 20, by_time: bool = False, strict: bool = False) -> DataFrame:
    """One row for each file (file_id, path, content): type, entropy, recommended codec and level, and why.

    One pass without a shuffle.  Compressed formats and empty files are stored without trials.  A null content is a file that is not there: it is stored too, with a reason.  Ids may be null or repeat.
    """
    head = files.select("file_id", "path", F.substring("content", 1, sample_bytes).alias("content"))
    typed = exprs.detect_types(head.withColumn("head", F.substring("content", 1, 4096)), "path", "head").drop("head")
    typed = typed.withColumn("dense", exprs.is_dense(F.col("type"), F.col("type_detail"), strict)).withColumn("missing", F.col("content").isNull())
    _, level, tolerance = CANDIDATES[priority]
    out = measure(typed, priority).withColumn("x", chosen(F.col("trials"), tolerance, by_time))
    vain = F.col("x.best_ratio") >= VAIN
    why = (
        F.when(F.col("missing"), "the file is not there")
        .when(F.col("dense"), F.format_string("%s is compressed already", F.col("type_detail")))
        .when(F.col("sample_size") == 0, "the file is empty")
        .when(F.col("x").isNull(), "no codec took the sample")
        .when(vain, F.concat(F.lit("no codec gets below "), exprs.format_ratio(F.col("x.best_ratio"))))
        .otherwise(F.concat(F.col("x.algo"), F.lit(": ratio "), exprs.format_ratio(F.col("x.ratio")), F.lit(", the best is "), exprs.format_ratio(F.col("x.best_ratio"))))
    )
    raw = F.col("dense") | F.col("x").isNull() | F.coalesce(vain, F.lit(False))
    return out.select(
        "file_id", "path", "type", "type_detail", "sample_size", "entropy", raw.alias("store_raw"),
        F.when(raw, "store").otherwise(F.col("x.algo")).alias("algo"), F.lit(level).alias("level"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("x.best_ratio", F.lit(1.0)))).alias("compressibility"), why.alias("rationale"),
    )


def inspect(files: DataFrame, sample_bytes: int = 1 << 20) -> DataFrame:
    """One row a file (file_id, path, content): size, type, and entropy and CRC of its first `sample_bytes`."""
    head = files.select("file_id", "path", F.octet_length("content").cast("bigint").alias("size"), F.substring("content", 1, sample_bytes).alias("content"))
    typed = exprs.detect_types(head.withColumn("head", F.substring("content", 1, 4096)), "path", "head").drop("head")
    out = measure(typed.withColumn("crc", F.crc32("content")).withColumn("dense", F.lit(True)))
    return out.select("file_id", "path", "size", "type", "type_detail", "sample_size", "entropy", "crc")


def benchmark(files: DataFrame, level: int = 6, limit: int | None = None, algos: list[str] | None = None) -> DataFrame:
    """(algo, n_blocks, in_bytes, out_bytes, ratio, seconds, mbps, rank, best_ratio, best_speed): every codec over every block.

    Blocks have the codec's own cap; those that don't shrink count as raw.  The pairs of codec and block are dealt evenly, and sums are made
    before the shuffle.
    """
    names = algos or list(CODECS)
    src = files.select("file_id", F.substring("content", 1, limit).alias("content") if limit else F.col("content"))
    pairs = src.withColumn("algo", F.explode(F.array(*[F.lit(n) for n in names])))
    fields = pa.schema([("algo", pa.string()), ("n_blocks", pa.int64()), ("in_bytes", pa.int64()), ("out_bytes", pa.int64()), ("seconds", pa.float64())])

    def run(batches):
        total: dict[str, list] = {}
        for batch in batches:
            for name, data in zip(batch.column("algo").to_pylist(), batch.column("content").to_pylist(), strict=True):
                codec = CODECS[name]
                for k in range(0, max(1, len(data)), codec.block_cap):
                    block, began = data[k : k + codec.block_cap], time.perf_counter()
                    try:
                        n = min(len(codec.encode(block, level)), len(block))
                    except (ValueError, MemoryError):
                        n = len(block)
                    t = total.setdefault(name, [0, 0, 0, 0.0])
                    for i, v in enumerate((1, len(block), n, time.perf_counter() - began)):
                        t[i] += v
        yield pa.RecordBatch.from_pylist([dict(zip(fields.names, (k, *v), strict=True)) for k, v in total.items()], schema=fields)

    made = pairs.select("algo", "content").mapInArrow(run, "algo string, n_blocks bigint, in_bytes bigint, out_bytes bigint, seconds double")
    return rank_codecs(made.groupBy("algo").agg(*[F.sum(c).alias(c) for c in ("n_blocks", "in_bytes", "out_bytes", "seconds")]))


def rank_codecs(totals: DataFrame) -> DataFrame:
    """Adds ratio, mbps (decimal), rank by ratio, and marks the best ratio and speed; `totals` has one row a codec."""
    every = Window.partitionBy(F.lit(1))
    out = totals.withColumn("ratio", F.when(F.col("in_bytes") > 0, F.col("out_bytes") / F.col("in_bytes")).otherwise(1.0))
    out = out.withColumn("mbps", F.when(F.col("seconds") > 0, F.col("in_bytes") / F.col("seconds") / 1e6).otherwise(0.0))
    out = out.withColumn("rank", F.row_number().over(every.orderBy("ratio", "algo")))
    return out.withColumns({"best_ratio": F.col("rank") == 1, "best_speed": F.col("mbps") == F.max("mbps").over(every)})
