"""Substring dedup by difference-cover anchors.

A match of `window` words at word i of one text and word j of another need not be aligned with any fixed
grid.  But the positions of a difference cover D modulo v have the property that for all i and j some k < v
has both (i + k) mod v and (j + k) mod v in D.  So it is enough to hash the windows of window - v + 1 words
that begin at positions p with p mod v in D (5 of 21 here): two equal long windows always share one such
anchor at equal distance from their starts.

1. Anchors are hashed and counted by hash.  Those that occur once are dropped.
2. Around the others the windows of full length that hold an anchor are hashed (128 bits: 96 are kept) and
   counted: this is the extension of an anchor match to a whole match.
3. Every word covered by a window that occurs twice goes.  Again only windows around repeated anchors are hashed.

Blocks of documents, not documents, own hashes: a block sends each of its hashes once, with a mark if it has it
twice, so a passage in a third of all documents costs one record a block.  Blocks have a fixed size, so tasks don't grow with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BLOB, U64, Words, blocked, chunks, deal, dealt_by, join_spans, run_hashes, sha256_of, table, text_buffers, unblocked, unpack

#: Perfect difference sets (fixed values): every residue modulo v is a difference of two members.
COVERS = {21: (0, 1, 4, 14, 16), 13: (0, 1, 3, 9), 7: (0, 1, 3), 3: (0, 1), 1: (0,)}

_KEY = np.dtype([("h", "<u8"), ("g", "<u4"), ("block", "<i4")])
_FLUSH = 4_000_000


def period(window: int) -> int:
    """The largest cover period that leaves anchors of about two fifths of a window."""
    return next(v for v in COVERS if v == 1 or window - v + 1 >= 2 * window // 5)


class _Sender:
    """Collects (h, g, block), keeps one record a key and block, and marks by a negative block what it met twice."""

    def __init__(self, n_buckets: int):
        self.n, self.parts, self.size = n_buckets, [], 0

    def add(self, h: np.ndarray, g: np.ndarray, block: np.ndarray):
        rec = np.empty(len(h), _KEY)
        rec["h"], rec["g"], rec["block"] = h, g, block
        self.parts.append(rec)
        self.size += len(rec)
        if self.size > _FLUSH:
            yield from self.flush()

    def flush(self):
        if not self.size:
            return
        rec = np.concatenate(self.parts)
        self.parts, self.size = [], 0
        order = np.lexsort((rec["block"], rec["g"], rec["h"]))
        rec = rec[order]
        new = np.ones(len(rec), bool)
        new[1:] = (rec["h"][1:] != rec["h"][:-1]) | (rec["g"][1:] != rec["g"][:-1]) | (rec["block"][1:] != rec["block"][:-1])
        at = np.flatnonzero(new)
        twice = np.diff(np.append(at, len(rec))) > 1
        rec = rec[at]
        rec["block"][twice] = -1 - rec["block"][twice]
        yield deal(rec, ((rec["h"] >> U64(20)) % U64(self.n)).astype(np.int32), 0)


#: Kinds of keys: of anchors and of windows.
ANCHORS, WINDOWS = range(2)


def _repeated(batches, kind: int):
    """Of one partition's buckets: the keys that occur twice anywhere, sent to every block that has them."""
    parts = [unpack(b, _KEY) for batch in batches for b in batch.column("blob").to_pylist()]
    if not parts:
        return
    rec = np.concatenate(parts)
    rec = rec[np.lexsort((rec["g"], rec["h"]))]
    new = np.ones(len(rec), bool)
    new[1:] = (rec["h"][1:] != rec["h"][:-1]) | (rec["g"][1:] != rec["g"][:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(rec)))
    twice = np.add.reduceat((rec["block"] < 0).astype(np.int64), at) + size > 1
    rec = rec[np.repeat(twice, size)].copy()
    rec["block"] = np.where(rec["block"] < 0, -1 - rec["block"], rec["block"])
    yield deal(rec, rec["block"].astype(np.int32), kind)


def _anchors(w: Words, h: np.ndarray, v: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes (in the chunk) at which anchors begin, and the anchors' hashes."""
    place = np.arange(len(h)) - np.repeat(w.first[:-1], w.counts)
    left = np.repeat(w.first[1:], w.counts) - np.arange(len(h))
    at = np.flatnonzero(np.isin(place % v, COVERS[v]) & (left >= length) & np.repeat(w.counts >= length + v - 1, w.counts))
    return at, run_hashes(h, at, length)


def _windows(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return run_hashes(h, at, window), (run_hashes(h, at, window, salt=0x51ED270B) >> U64(32)).astype(np.uint32)


def _words(t: pa.Table):
    for batch in t.combine_chunks().to_batches():
        for chunk in chunks(batch):
            w = Words(*text_buffers(chunk.column("text")))
            yield chunk, w, w.hashes()


def _keys(t: pa.Table, kind: int) -> np.ndarray:
    parts = [unpack(b, _KEY) for k, b in zip(t.column("kind").to_pylist(), t.column("blob").to_pylist(), strict=True) if k == kind]
    return np.concatenate(parts) if parts else np.zeros(0, _KEY)


def _cover(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places some run of `length` from a place in `at` covers."""
    d = np.zeros(n + length + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, at + length, -1)
    return np.cumsum(d[:n]) > 0


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return known[at] == keys


def _pairs_among(h: np.ndarray, g: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which (h, g) are among known records, which are sorted by h, then g."""
    out, kh, kg = np.zeros(len(h), bool), np.ascontiguousarray(known["h"]), known["g"]
    at = np.searchsorted(kh, h)
    left = np.arange(len(h))
    while len(left):  # records of equal h stand together
        left = left[at[left] < len(kh)]
        left = left[kh[at[left]] == h[left]]
        hit = kg[at[left]] == g[left]
        out[left[hit]] = True
        left = left[~hit]
        at[left] += 1
    return out


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """Removes every word covered by a window of `window` words that also begins elsewhere in `docs`.

    Returns the columns of `docs`, with the kept words joined by one space as text, and n_words and n_removed.
    A null or empty text has no words and becomes ''.  A text shorter than the window is kept.  Rows of equal id are
    separate texts, as are rows without id: repeated rows remove each other's windows.  Very long texts are read whole.  Input columns named n_words
    or n_removed are replaced; all others pass unchanged.  An empty table gives an empty table.
    """
    v = period(window)
    length = window - v + 1
    dealt, n = blocked(docs, doc_id, text)
    # all three passes read `dealt` with all its columns, so that they share one exchange of the texts

    def send_anchors(batches):
        out = _Sender(n)
        for batch in batches:
            for chunk, w, h in _words(pa.Table.from_batches([batch])):
                at, keys = _anchors(w, h, v, length)
                block = chunk.column("block").to_numpy()[w.text_of()[at]]
                yield from out.add(keys, np.zeros(len(at), np.uint32), block)
        yield from out.flush()

    def starts_near(w: Words, h: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Where the windows begin that hold a shared anchor: up to v - 1 words before it."""
        at, keys = _anchors(w, h, v, length)
        at = at[_among(keys, shared)]
        near = _cover(np.maximum(at - (v - 1), 0), v, len(h))
        room = np.repeat(w.first[1:], w.counts) - np.arange(len(h)) >= window
        return np.flatnonzero(near & room)

    def send_windows(key, left: pa.Table, right: pa.Table) -> pa.Table:
        shared, out = np.unique(_keys(right, ANCHORS)["h"]), _Sender(n)
        sent = []
        for _, w, h in _words(left) if len(shared) else ():
            starts = starts_near(w, h, shared)
            sent += out.add(*_windows(h, starts, window), np.full(len(starts), key[0].as_py(), np.int32))
        sent += out.flush()
        return pa.Table.from_batches(sent, pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())]))

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        shared, twice = np.unique(_keys(right, ANCHORS)["h"]), _keys(right, WINDOWS)
        twice = twice[np.lexsort((twice["g"], twice["h"]))]
        outs, counts = [], []
        for chunk, w, h in _words(left):
            gone = np.zeros(len(h), bool)
            if len(twice):
                starts = starts_near(w, h, shared)
                full, more = _windows(h, starts, window)
                gone = _cover(starts[_pairs_among(full, more, twice)], window, len(h))
            outs.append((chunk, _kept(w, ~gone)))
            counts.append((w.counts, np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) * (w.counts > 0)))
        cols = {c: pa.chunked_array([o.column(c) for o, _ in outs]) for c in left.column_names if c not in ("text", "block")}
        texts = pa.chunked_array([t for _, t in outs], type=pa.string())
        return pa.table({**cols, "text": texts, "n_words": np.concatenate([a for a, _ in counts]).astype(np.int64), "n_removed": np.concatenate([b for _, b in counts])}) if outs else empty

    fields = [f for f in dealt.schema.fields if f.name not in ("text", "block")]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    empty = to_arrow_schema(schema).empty_table()

    def repeated(keys: DataFrame, kind: int) -> DataFrame:
        """Deals keys by hash and keeps the repeated ones, for the blocks that have them."""
        found = dealt_by(keys, n, "bucket").mapInArrow(lambda batches: _repeated(batches, kind), BLOB)
        return found.select(F.col("bucket").alias("block"), "kind", "blob")

    anchors = repeated(dealt.mapInArrow(send_anchors, BLOB), ANCHORS)
    windows = repeated(dealt.groupBy("block").cogroup(dealt_by(anchors, n, "block").groupBy("block")).applyInArrow(send_windows, BLOB), WINDOWS)
    out = dealt.groupBy("block").cogroup(dealt_by(anchors.union(windows), n, "block").groupBy("block")).applyInArrow(remove, schema)
    return unblocked(out, docs, doc_id, text, ["n_words", "n_removed"])


def _kept(w: Words, keep: np.ndarray) -> pa.Array:
    return join_spans(w.data, w.starts[keep], (w.ends - w.starts)[keep], w.text_of()[keep], len(w.counts), 0x20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", sha256_of(F.col("text")).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM twice
), words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d
), marked AS (
  SELECT words.doc_id, words.p, word, gone.p IS NOT NULL AS gone FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM marked GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
