"""Shared kernels: words and hashes over Arrow buffers, and blocked exchanges.

Everything works on whole texts.  A null text counts as empty.  Words are the
maximal runs of bytes other than 0x20 and 0x09-0x0D, so no Unicode rule is
involved and UTF-8 sequences are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import cut, delete, shared_folder, spread  # noqa: F401  the other modules take these from here

U64 = np.uint64
#: Texts are worked on in chunks of about so many bytes; the arrays made of them take dozens of times as much memory.
CHUNK_BYTES = 1 << 20
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93
_Q_INV = pow(_Q, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables grow by doubling and are kept, but for those of very long texts."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.full(size, base, dtype=np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        if size <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x *= U64(0xFF51AFD7ED558CCD)
        x ^= x >> U64(33)
        x *= U64(0xC4CEB9FE1A85EC53)
        x ^= x >> U64(33)
    return x


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `limit` bytes of text; a longer text stands alone."""
    col = batch.column(column)
    if not len(col):
        return
    _, offsets = text_buffers(col)
    start = 0
    while start < len(col):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words of a chunk of texts: byte spans, the word range of every text, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        is_word = np.zeros(len(data) + 1, dtype=bool)
        is_word[:-1] = _IS_WORD[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True  # a text's end is the next one's start
        before = np.empty_like(is_word)
        before[0], before[1:] = False, is_word[:-1]
        self.starts = np.flatnonzero(is_word & (~before | first))
        self.ends = np.flatnonzero(before & (~is_word | first))
        #: words of text i are first[i] .. first[i + 1]
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of every word; `lower` maps A-Z to a-z first."""
        n = len(self.data)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            table = _BYTE[_LOWER] if lower else _BYTE
            np.cumsum(table[self.data] * powers(_P, n), out=total[1:])
            h = (total[self.ends] - total[self.starts]) * powers(_P_INV, n + 1)[self.starts]
            return mix(h ^ ((self.ends - self.starts).astype(np.uint64) << U64(48)))

    def text_of(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def run_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int, salt: int = 0) -> np.ndarray:
    """Hash of the word runs that begin at `starts`; equal runs have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, dtype=np.uint64)
        base, inverse = (_Q, _Q_INV) if not salt else (_P, _P_INV)
        np.cumsum((words if not salt else mix(words ^ U64(salt))) * powers(base, len(words)), out=total[1:])
        h = (total[starts + lengths] - total[starts]) * powers(inverse, len(words) + 1)[starts]
        return mix(h + U64(0x632BE59BD9B4E019) * np.asarray(lengths, dtype=np.uint64))


def shingles(words: Words, size: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all shingles; a text of 1 to size-1 words has its whole sequence as one."""
    h = words.hashes(lower)
    n = np.maximum(words.counts - size + 1, (words.counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    starts = np.arange(first[-1]) - np.repeat(first[:-1] - words.first[:-1], n)
    lengths = np.repeat(np.minimum(words.counts, size), n)
    return run_hashes(h, starts, lengths), first


def distinct_per_text(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and their ranges."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, text))
    h = h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(first) - 1))]).astype(np.int64)


def join_spans(data: np.ndarray, starts: np.ndarray, size: np.ndarray, text: np.ndarray, n: int, separator: int) -> pa.Array:
    """n texts: the byte spans of each text (`text` ascends) joined by one separator byte."""
    last = np.ones(len(size), bool)
    last[:-1] = text[1:] != text[:-1]
    out_len = size + ~last
    to = np.concatenate([[0], np.cumsum(out_len)]).astype(np.int64)
    out = np.full(to[-1], separator, np.uint8)
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    every = np.arange(at[-1])
    out[every + np.repeat(to[:-1] - at[:-1], size)] = data[every + np.repeat(starts - at[:-1], size)]
    by_text = np.bincount(text, weights=out_len, minlength=n).astype(np.int64) if len(text) else np.zeros(n, np.int64)
    offsets = np.concatenate([[0], np.cumsum(by_text)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hash of byte spans; equal spans have equal hashes wherever they stand."""
    n, size = len(data), (ends - starts).astype(np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        values = (_BYTE[_LOWER] if lower else _BYTE)[data]
        np.cumsum(values * powers(_P, n), out=total[1:])
        h = mix((total[ends] - total[starts]) * powers(_P_INV, n + 1)[starts] + size * U64(0x632BE59BD9B4E019))
        np.cumsum((values ^ (values >> U64(29))) * powers(_Q, n), out=total[1:])
        g = mix((total[ends] - total[starts]) * powers(_Q_INV, n + 1)[starts] + size)
    return h, (g >> U64(32)).astype(np.uint32)


def sha256_of(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


# --- exchanges of numpy records -------------------------------------------------------------

BLOB = "bucket int, kind int, blob binary"
_BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def pack(records: np.ndarray) -> bytes:
    """Records by byte plane: high zero bytes of ids stand together, so that shuffle compression removes them."""
    return np.ascontiguousarray(records.view(np.uint8).reshape(len(records), records.dtype.itemsize).T).tobytes()


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(dtype)


def deal(records: np.ndarray, bucket: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row for each bucket that has records."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    parts = np.split(records, cuts) if len(records) else []
    keys = bucket[np.concatenate([[0], cuts])] if len(records) else bucket
    return pa.record_batch([pa.array(keys.astype(np.int32), pa.int32()), pa.array(np.full(len(parts), kind, np.int32)), pa.array([pack(p) for p in parts], pa.binary())], schema=_BLOB)


#: Text (and other strings) of a block: what a task holds at a time.
BLOCK_BYTES = 12 << 20
#: Partitions of an exchange at most; beyond, a partition holds several blocks, which are read one after the other.
MOST_PARTITIONS = 100_000


def dealt_by(frame: DataFrame, n: int, column: str) -> DataFrame:
    """Number k of `column` goes to partition k, so that no two numbers share one as long as there are partitions enough."""
    return frame.repartitionById(n, F.col(column)) if n <= MOST_PARTITIONS else frame.repartition(MOST_PARTITIONS, column)


def blocked(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """(block, id, text[, rest]) dealt by block, and the number of blocks, which follows from the measured bytes.

    Blocks come from a hash of id and text, so neither rows of one id nor rows without id meet in one block.  All other columns ride
    along in the struct `rest`, so their names can't clash.  The exchange is written once: plans that use the returned frame several
    times share it (ReusedExchange).
    """
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in docs.schema.fields if f.dataType.typeName() in ("string", "binary")]
    width = F.lit(16)
    for w in wide:
        width = width + w
    total = docs.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES), min(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // (2 << 20))))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)]
    own = [F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text")]
    block = F.pmod(F.xxhash64(*own), F.lit(n)).cast("int").alias("block")
    return dealt_by(docs.select(block, *own, *([F.struct(*rest).alias("rest")] if rest else [])), n, "block"), n


def unblocked(out: DataFrame, docs: DataFrame, doc_id: str, text: str, made: list[str]) -> DataFrame:
    """Back to the columns of `docs` in their order, then `made`; a made column replaces an input column of its name."""
    cols = [F.col("id").alias(doc_id) if c == doc_id else F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in made]
    return out.select(*cols, *made)


def free_name(name: str, taken: list[str]) -> str:
    """A column name like `name` that isn't taken (names don't tell case apart)."""
    taken = {c.lower() for c in taken}
    return next(x for k in range(len(taken) + 1) if (x := f"__{name}{k}") not in taken)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; the large ones are spread over the cores where they lie in few pieces."""
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(out) if name in ("documents", "pages", "conversations") else out
