"""The chunk pipeline: files become tables of chunks that are encoded, kept, decoded and verified independently.

A file is a row (file_id, content), or chunks from the beginning (sources.container.ByteRanges).  A chunk is a row (file_id, chunk_id, ...).  Only kernels that make bytes run in Python; sizes, flags, offsets,
totals and checks are DataFrame expressions.  Secrets are derived on the driver and reach the tasks in closures, never in plans.
"""

from __future__ import annotations

import os
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.bits import FormatError
from ..functions.codecs import CODECS, clamp_level
from ..functions.crypto import KDF_ITERATIONS, chacha20_all, chunk_nonce, crc32_combine, derive_keys, hmac_sha256, same

#: A batch that a kernel emits holds at most about so many bytes.
BATCH_BYTES = 16 << 20


def _emit(rows, schema: pa.Schema, weight: str):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[weight] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(batches, step: int = 256):
    for batch in batches:
        for k in range(0, len(batch), step):
            yield from batch.slice(k, step).to_pylist()


def as_files(df: DataFrame, file_id: str, content: str) -> DataFrame:
    """(file_id, content) of any table with an id and a text or binary column; null content is empty."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return df.select(F.col(file_id).cast("bigint").alias("file_id"), data.alias("content"))


CHUNK = "file_id bigint, chunk_id int, data binary"


def split_chunks(files: DataFrame, chunk_size: int) -> DataFrame:
    """(file_id, chunk_id, data); an empty file has one empty chunk.  No chunk row carries the whole content with it."""
    schema = to_arrow_schema(T._parse_datatype_string(CHUNK))

    def split(batches):
        def rows():
            for batch in batches:
                for file_id, data in zip(batch.column("file_id").to_pylist(), batch.column("content"), strict=True):
                    view = memoryview(data.as_buffer())
                    for k in range(max(1, -(-len(view) // chunk_size))):
                        yield {"file_id": file_id, "chunk_id": k, "data": bytes(view[k * chunk_size : (k + 1) * chunk_size])}

        yield from _emit(rows(), schema, "data")

    return files.select("file_id", "content").mapInArrow(split, CHUNK)


ENCODED = "file_id bigint, chunk_id int, algo string, orig_size bigint, comp_size bigint, raw boolean, crc bigint, payload_crc bigint, salt binary, payload binary"
#: Chunks that a kernel works on side by side, in rows and in bytes.
_ROWS, _BYTES = 256, 8 << 20


class Secret:
    """Keys of one password for many files.  A nonce follows from the file's id, the chunk's number and a salt that is drawn anew for each table that is made, and which its rows carry."""

    def __init__(self, password: str, salt: bytes | None = None, iterations: int = KDF_ITERATIONS):
        self.salt = salt or os.urandom(16)
        self.cipher_key, self.mac_key = derive_keys(password, self.salt, iterations)

    def nonce(self, file_id: int, chunk_id: int, salt: bytes) -> bytes:
        return chunk_nonce(hmac_sha256(self.cipher_key, b"nonce", salt, str(file_id).encode())[:12], chunk_id)

    def apply(self, rows: list[dict], texts: list[bytes]) -> list[bytes]:
        """The texts under the key streams of their chunks."""
        return chacha20_all(self.cipher_key, [self.nonce(r["file_id"], r["chunk_id"], r["salt"] or b"") for r in rows], texts)

    def __repr__(self) -> str:
        return "Secret(...)"


def _parts(batches, column: str):
    """Rows of some chunks at a time."""
    held, size = [], 0
    for r in _rows(batches):
        held.append(r)
        size += len(r[column] or b"")
        if len(held) >= _ROWS or size >= _BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_chunks(chunks: DataFrame, algo: str = "lz77", level: int = 6, secret: Secret | None = None) -> DataFrame:
    """The chunk table: each chunk encoded, or kept raw where that isn't smaller, then encrypted if there is a secret.

    A column `algo` of `chunks` chooses the codec by row; `algo` holds for rows without.  The salt of the nonces is drawn here, once: a table that is computed again is the same, a new table of
    the same files has other key streams.
    """
    schema, level, salt = to_arrow_schema(T._parse_datatype_string(ENCODED)), clamp_level(level), None if secret is None else os.urandom(16)

    def encode(batches):
        def rows():
            for part in _parts(batches, "data"):
                made, out = [], []
                for r in part:
                    data, codec = r["data"] or b"", CODECS[r.get("algo") or algo]
                    packed = codec.encode(data, level)
                    raw = len(packed) >= len(data)
                    out.append(data if raw else packed)
                    made.append({"file_id": r["file_id"], "chunk_id": r["chunk_id"], "algo": codec.name, "orig_size": len(data), "comp_size": len(out[-1]), "raw": raw, "crc": zlib.crc32(data), "salt": salt})
                if secret is not None:
                    out = secret.apply(made, out)
                for r, payload in zip(made, out, strict=True):
                    yield r | {"payload_crc": zlib.crc32(payload), "payload": payload}

        yield from _emit(rows(), schema, "payload")

    return chunks.mapInArrow(encode, ENCODED)


def chunk_offsets(encoded: DataFrame, size: str = "comp_size") -> DataFrame:
    """Adds `offset`: where each chunk's payload begins in its file."""
    before = Window.partitionBy("file_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return encoded.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint"))


DECODED = "file_id bigint, chunk_id int, data binary, error string"


def decode_chunks(encoded: DataFrame, secret: Secret | None = None) -> DataFrame:
    """(file_id, chunk_id, data, error); a chunk that can't be decoded, or whose checksums differ, has an error and no data."""
    schema = to_arrow_schema(T._parse_datatype_string(DECODED))

    def decode(batches):
        def rows():
            for part in _parts(batches, "payload"):
                payloads = [r["payload"] or b"" for r in part]
                whole = [len(p) == r["comp_size"] and zlib.crc32(p) == r["payload_crc"] for r, p in zip(part, payloads, strict=True)]
                if secret is not None:
                    payloads = secret.apply(part, payloads)
                for r, payload, ok in zip(part, payloads, whole, strict=True):
                    out = {"file_id": r["file_id"], "chunk_id": r["chunk_id"], "data": None, "error": None}
                    if not ok:
                        yield out | {"error": "payload checksum differs"}
                        continue
                    try:
                        data = payload if r["raw"] else CODECS[r["algo"]].decode(payload, r["orig_size"])
                    except (FormatError, KeyError) as e:
                        yield out | {"error": str(e)}
                        continue
                    if len(data) != r["orig_size"] or zlib.crc32(data) != r["crc"]:
                        yield out | {"error": "checksum differs"}
                        continue
                    yield out | {"data": data}

        yield from _emit(rows(), schema, "data")

    return encoded.select("file_id", "chunk_id", "algo", "orig_size", "comp_size", "raw", "crc", "payload_crc", "salt", "payload").mapInArrow(decode, DECODED)


def join_chunks(decoded: DataFrame) -> DataFrame:
    """(file_id, content, error): files whose rows fit in memory, put together again; content is null if a chunk has an error."""
    out = decoded.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "data", "error"))).alias("parts"))
    schema = to_arrow_schema(T._parse_datatype_string("file_id bigint, content binary, error string"))

    def join(batches):
        def rows():
            for r in _rows(batches, 16):
                error = next((p["error"] for p in r["parts"] if p["error"]), None)
                gap = [p["chunk_id"] for p in r["parts"]] != list(range(len(r["parts"])))
                error = error or ("chunks are missing" if gap else None)
                yield {"file_id": r["file_id"], "content": None if error else b"".join(p["data"] for p in r["parts"]), "error": error}

        yield from _emit(rows(), schema, "content")

    return out.mapInArrow(join, "file_id bigint, content binary, error string")


#: Chunks whose checks are folded in one group: a file of more chunks is folded group by group, and then its groups.
FOLD = 4096


def manifest(encoded: DataFrame) -> DataFrame:
    """One row a file: totals, ratio, and the CRCs of content and payload, folded from the chunks' own without reading payloads again.

    CRCs of neighbours combine to the CRC of both, so groups of FOLD chunks are folded first, and then the groups of a file: no row holds more than FOLD checks, or one for each FOLD chunks.
    """
    folded = encoded.select(
        "file_id", F.floor(F.col("chunk_id") / FOLD).alias("part"), "chunk_id", F.lit(1).cast("bigint").alias("chunk_count"), "orig_size", "comp_size", F.col("raw").cast("bigint").alias("raw_chunks"), "algo", "crc", "payload_crc"
    )
    for by in (["file_id", "part"], ["file_id"]):
        place = "chunk_id" if len(by) == 2 else "part"
        checks = F.sort_array(F.collect_list(F.struct(place, "crc", "orig_size", "payload_crc", "comp_size")))
        grouped = folded.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("chunk_count", "raw_chunks", "orig_size", "comp_size")], F.min("algo").alias("algo"), checks.alias("checks"))
        folded = _fold(grouped)
    out = folded.select("file_id", F.col("chunk_count").cast("int").alias("chunk_count"), "orig_size", "comp_size", F.col("raw_chunks").cast("int").alias("raw_chunks"), "algo", "crc", "payload_crc")
    return out.withColumn("ratio", F.when(F.col("orig_size") > 0, F.col("comp_size") / F.col("orig_size")).otherwise(1.0))


def _fold(grouped: DataFrame) -> DataFrame:
    """Replaces `checks` by crc and payload_crc of what they stand for together."""
    schema = T.StructType([f for f in grouped.schema.fields if f.name != "checks"]).add("crc", T.LongType()).add("payload_crc", T.LongType())
    arrow = to_arrow_schema(schema)

    def fold(batches):
        for batch in batches:
            crcs = []
            for checks in batch.column("checks").to_pylist():
                crc = payload_crc = 0
                for c in checks:
                    crc, payload_crc = crc32_combine(crc, c["crc"], c["orig_size"]), crc32_combine(payload_crc, c["payload_crc"], c["comp_size"])
                crcs.append((crc, payload_crc))
            cols = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([a for a, _ in crcs], pa.int64()), pa.array([b for _, b in crcs], pa.int64())], schema=arrow)

    return grouped.mapInArrow(fold, schema)


def macs(encoded: DataFrame, secret: Secret) -> DataFrame:
    """(file_id, mac): a tree of HMACs.  Each chunk has one over its row and payload, each group of FOLD chunks one over theirs in order, and the file one over its groups' with the number of chunks.

    Payloads are not shuffled and a file of any size is many tasks: only 32 bytes a chunk are.
    """

    def leaves(batches):
        for part in _parts(batches, "payload"):
            made = [hmac_sha256(secret.mac_key, f"{r['file_id']},{r['chunk_id']},{r['algo']},{r['orig_size']},{r['comp_size']},{r['raw']};".encode(), r["salt"] or b"", r["payload"] or b"") for r in part]
            yield pa.record_batch([pa.array([r["file_id"] for r in part], pa.int64()), pa.array([r["chunk_id"] for r in part], pa.int64()), pa.array(made, pa.binary())], names=["file_id", "place", "mac"])

    def fold(batches):
        for batch in batches:
            made = [hmac_sha256(secret.mac_key, b"".join(f"{x['place']},{x['n']};".encode() + x["mac"] for x in found)) for found in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("place"), batch.column("n"), pa.array(made, pa.binary())], names=["file_id", "place", "n", "mac"])

    out = encoded.select("file_id", "chunk_id", "algo", "orig_size", "comp_size", "raw", "salt", "payload").mapInArrow(leaves, "file_id bigint, place bigint, mac binary").withColumn("n", F.lit(1).cast("bigint"))
    for above in (F.floor(F.col("place") / FOLD), F.lit(0)):
        grouped = out.withColumn("above", above.cast("bigint")).groupBy("file_id", "above").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "n", "mac"))).alias("found"))
        out = grouped.withColumnRenamed("above", "place").mapInArrow(fold, "file_id bigint, place bigint, n bigint, mac binary")
    return out.select("file_id", "mac")


def authenticate(encoded: DataFrame, expected: DataFrame, secret: Secret) -> DataFrame:
    """(file_id, authentic).  Run it as an action of its own before anything is written."""
    found = macs(encoded, secret).withColumnRenamed("mac", "found").join(expected, "file_id", "full")

    def compare(batches):
        for batch in batches:
            ok = [a is not None and b is not None and same(a, b) for a, b in zip(batch.column("found").to_pylist(), batch.column("mac").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("file_id"), pa.array(ok, pa.bool_())], names=["file_id", "authentic"])

    return found.select("file_id", "found", "mac").mapInArrow(compare, "file_id bigint, authentic boolean")


def verify(encoded: DataFrame, manifests: DataFrame, decoded: DataFrame) -> DataFrame:
    """One row a file: whether totals, count and checksums agree with its manifest, and the first error."""
    totals = encoded.groupBy("file_id").agg(F.count("*").alias("n"), F.sum("orig_size").alias("o"), F.sum("comp_size").alias("c"))
    errors = decoded.groupBy("file_id").agg(F.sum(F.col("error").isNotNull().cast("int")).alias("bad"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chunk_id"))).alias("error"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("d"))
    out = manifests.join(totals, "file_id", "left").join(errors, "file_id", "left")
    consistent = F.coalesce((F.col("n") == F.col("chunk_count")) & (F.col("o") == F.col("orig_size")) & (F.col("c") == F.col("comp_size")), F.lit(False))
    ok = consistent & F.coalesce(F.col("bad") == 0, F.lit(False)) & F.coalesce(F.col("d") == F.col("orig_size"), F.lit(False))
    return out.select("file_id", consistent.alias("consistent"), ok.alias("ok"), "error")


#: Codecs below this many MB/s (by the registry) take much longer than an exchange, so their chunks are dealt evenly: a file with many chunks is many tasks' work.
SLOW = 100


def compress(files: DataFrame, algo: str = "lz77", level: int = 6, chunk_size: int = 1 << 20, secret: Secret | None = None) -> DataFrame:
    """The chunk table of whole files."""
    chunks = split_chunks(files, min(chunk_size, CODECS[algo].block_cap))
    if CODECS[algo].typical_speed_mbps < SLOW:
        chunks = chunks.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id", "chunk_id")
    return encode_chunks(chunks, algo, level, secret)


def decompress(encoded: DataFrame, secret: Secret | None = None) -> DataFrame:
    return join_chunks(decode_chunks(encoded, secret))
