"""Line dedup over levelled sorted runs of line hashes.

A task with blocks of documents sends each line key of a block once, with the largest ids of the block's documents that hold it: as many as decide
whether a line is too common.  Where the keys of a hash range meet, they enter in batches.  A new batch is sorted and merge-anti-joined with the runs that are there: known keys
take up its ids where they stand, new keys become a run of level 0.  A level that holds `fanout` runs is compacted into one run of the next, so there are
never many runs to merge with.  When all batches are in, the blocks of the keys that must go are told the surviving document.

The runs can be kept as a table and given again with later documents, whose lines then count with those of all earlier ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BLOB, U64, Words, blocked, chunks, cut, deal, dealt_by, join_spans, sha256_of, span_hashes, table, text_buffers, unblocked, unpack

#: Keys wait until there are so many and then enter as one batch.
_BATCH = 1 << 16
#: Records that a task collects before it sends them.
_FLUSH = 1 << 20
#: Stands for no id in a list of ids, and for the id of rows without id: these count as one document, the one with the smallest id.
NONE, NO_ID = -(1 << 63), 1 - (1 << 63)
_KEY = [("h", "<u8"), ("g", "<u4"), ("block", "<i4")]
#: Kinds of rows in an exchange: keys of blocks, verdicts for blocks, and runs (their level is added).
KEYS, GONE, RUN = range(3)
_TOLD = np.dtype([*_KEY, ("top", "<i8")])


def record(min_docs: int) -> np.dtype:
    """A key, its block, and the largest ids of documents that hold it, falling."""
    return np.dtype([*_KEY, ("top", "<i8", (min_docs,))])


def merged(rec: np.ndarray, by_block: bool = False) -> np.ndarray:
    """Sorted, one record a key (with `by_block` a key and block), which has the largest distinct ids of all its records."""
    rec = rec[np.lexsort((rec["block"], rec["g"], rec["h"]) if by_block else (rec["g"], rec["h"]))]
    new = np.ones(len(rec), bool)
    new[1:] = (rec["h"][1:] != rec["h"][:-1]) | (rec["g"][1:] != rec["g"][:-1])
    if by_block:
        new[1:] |= rec["block"][1:] != rec["block"][:-1]
    at = np.flatnonzero(new)
    if len(at) == len(rec):
        return rec
    out, m = rec[at].copy(), rec["top"].shape[1]
    several = np.repeat(np.diff(np.append(at, len(rec))) > 1, np.diff(np.append(at, len(rec))))
    group, ids = np.repeat((np.cumsum(new) - 1)[several], m), rec["top"][several].ravel()
    group, ids = group[ids != NONE], ids[ids != NONE]
    order = np.lexsort((ids, group))[::-1]
    group, ids = group[order], ids[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])
    group, ids = group[keep], ids[keep]
    first = np.ones(len(ids), bool)
    first[1:] = group[1:] != group[:-1]
    rank = np.arange(len(ids)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    out["top"][np.unique(group)] = NONE
    out["top"][group[rank < m], rank[rank < m]] = ids[rank < m]
    return out


class Runs:
    """Levelled sorted runs of records by key."""

    def __init__(self, min_docs: int = 3, fanout: int = 8):
        self.kind, self.fanout, self.levels = record(min_docs), fanout, []

    @staticmethod
    def find(batch: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Index in `run` of each key of `batch`, or -1: a merge of two sorted sequences."""
        out = np.full(len(batch), -1)
        if not len(run):
            return out
        h, g = np.ascontiguousarray(run["h"]), run["g"]
        at = np.searchsorted(h, batch["h"])
        while True:  # keys of equal h stand together, by g
            ok = at < len(run)
            same = np.zeros(len(batch), bool)
            same[ok] = h[at[ok]] == batch["h"][ok]
            less = same.copy()
            less[same] = g[at[same]] < batch["g"][same]
            if not less.any():
                break
            at[less] += 1
        hit = np.flatnonzero(same)
        hit = hit[g[at[hit]] == batch["g"][hit]]
        out[hit] = at[hit]
        return out

    def add(self, batch: np.ndarray) -> None:
        """Merge-anti-joins a batch with the runs: known keys take up its ids where they stand, the new ones become a run."""
        batch = merged(batch)
        new = np.ones(len(batch), bool)
        for level in self.levels:
            for run in level:
                at = self.find(batch, run)
                hit = np.flatnonzero(at >= 0)
                if len(hit):
                    both = merged(np.concatenate([run[at[hit]], batch[hit]]))
                    run["top"][at[hit]] = both["top"]  # both are in the order of their keys
                    new[hit] = False
        if new.any():
            self.put(0, batch[new].copy())

    def put(self, k: int, run: np.ndarray) -> None:
        """A run of level k; a full level is compacted into a run of the next one."""
        while k >= len(self.levels):
            self.levels.append([])
        self.levels[k].append(run)
        if len(self.levels[k]) >= self.fanout:
            full, self.levels[k] = self.levels[k], []
            self.put(k + 1, merged(np.concatenate(full)))

    def whole(self) -> np.ndarray:
        runs = [r for level in self.levels for r in level]
        return merged(np.concatenate(runs)) if runs else np.zeros(0, self.kind)


class _Lines:
    """Lines of a chunk of texts and their keys."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_chars: int):
        w = Words(data, offsets)
        breaks = np.flatnonzero(data == 0x0A)
        text_of_break = np.searchsorted(offsets, breaks, side="right") - 1
        n_texts = len(offsets) - 1
        self.counts = np.bincount(text_of_break, minlength=n_texts) + 1
        # a text's first line begins at its offset; empty texts share offsets, so sort by text instead
        text = np.concatenate([np.arange(n_texts), text_of_break])
        begin = np.concatenate([offsets[:-1], breaks + 1])
        order = np.lexsort((begin, text))
        self.starts, self.text = begin[order], text[order]
        last = np.ones(len(self.starts), bool)
        last[:-1] = self.text[1:] != self.text[:-1]
        self.ends = np.where(last, offsets[1:][self.text], np.append(self.starts[1:], 0) - 1)
        a, b = np.searchsorted(w.starts, self.starts), np.searchsorted(w.starts, self.ends)
        some = b > a
        at = np.flatnonzero(some)
        key_start, key_end = w.starts[a[at]], w.ends[b[at] - 1]
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long = points[key_end] - points[key_start] >= min_chars
        #: lines that have a key, and the hashes of the keys
        self.keyed = at[long]
        self.h, self.g = span_hashes(data, key_start[long], key_end[long], lower=True)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, known: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """Drops lines whose key stands in at least `min_docs` documents, except in the one with the largest id.

    A key is the line without spaces, tabs and such (0x20, 0x09-0x0D) at its ends and with A-Z lower-cased; shorter ones than
    `min_chars` code points never go.  Returns the columns of `docs` with the other lines joined by \\n as text, and n_lines and
    n_dropped.  A null or empty text is one empty line and becomes ''.  Rows of equal id are one document, and so are all rows
    without id, whose id counts as the smallest.  Very long texts are read whole.  Input columns named n_lines or n_dropped are replaced; all others pass
    unchanged.  An empty table gives an empty table.

    `known` is a table of runs that an earlier call kept: its documents count too.  `keep` is a folder to which the runs of all documents so far are written.
    """
    dealt, n = blocked(docs, doc_id, text)
    kind = record(min_docs)
    ids = lambda t: np.maximum(t.column("id").fill_null(NO_ID).to_numpy().astype(np.int64), NO_ID)
    bucket = lambda rec: ((rec["h"] >> U64(20)) % U64(n)).astype(np.int32)

    def lines(batch: pa.RecordBatch):
        for chunk in chunks(batch):
            yield chunk, _Lines(*text_buffers(chunk.column("text")), min_chars)

    def send(batches):
        parts, size = [], 0
        for batch in batches:
            for chunk, x in lines(batch):
                rec = np.empty(len(x.keyed), kind)
                rec["h"], rec["g"], rec["top"] = x.h, x.g, NONE
                rec["top"][:, 0], rec["block"] = ids(chunk)[x.text[x.keyed]], chunk.column("block").to_numpy()[x.text[x.keyed]]
                parts.append(rec)
                size += len(rec)
                if size > _FLUSH:
                    rec = merged(np.concatenate(parts), True)
                    yield deal(rec, bucket(rec), KEYS)
                    parts, size = [], 0
        if size:
            rec = merged(np.concatenate(parts), True)
            yield deal(rec, bucket(rec), KEYS)

    def again(batches):
        """Runs of earlier calls, dealt to the buckets of this one."""
        for batch in batches:
            for level, blob in zip(batch.column("level").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                rec = unpack(blob, kind)
                yield deal(rec, bucket(rec), RUN + level)

    def settle(batches):
        runs, came, waiting, size = Runs(min_docs), [], [], 0

        def take():
            batch = np.concatenate(waiting)
            waiting.clear()
            held = np.empty(len(batch), _KEY)
            for c in ("h", "g", "block"):
                held[c] = batch[c]
            came.append(held)
            runs.add(batch)

        for batch in batches:
            for what, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                rec = unpack(blob, kind)
                if what >= RUN:
                    runs.put(what - RUN, merged(rec))
                    continue
                waiting.append(rec)
                size += len(rec)
                if size >= _BATCH:
                    take()
                    size = 0
        if waiting:
            take()
        total = runs.whole()
        total = total[total["top"][:, -1] != NONE]
        while came:  # the blocks that brought a key which is too common are told the id that keeps it
            rec = came.pop()
            at = Runs.find(rec, total)
            told = np.empty((at >= 0).sum(), _TOLD)
            for c in ("h", "g", "block"):
                told[c] = rec[c][at >= 0]
            told["top"] = total["top"][at[at >= 0], 0]
            yield deal(told, told["block"].astype(np.int32), GONE)
        if keep:
            for k, level in enumerate(runs.levels):
                for run in level:
                    yield deal(run, np.zeros(len(run), np.int32), RUN + k)

    def drop(key, left: pa.Table, right: pa.Table) -> pa.Table:
        gone = [unpack(b, _TOLD) for b in right.column("blob").to_pylist()]
        gone = np.concatenate(gone) if gone else np.zeros(0, _TOLD)
        gone = gone[np.lexsort((gone["g"], gone["h"]))]
        outs = []
        for batch in left.combine_chunks().to_batches():
            for chunk, x in lines(batch):
                stays = np.ones(len(x.starts), bool)
                rec = np.empty(len(x.keyed), _KEY)
                rec["h"], rec["g"] = x.h, x.g
                at = Runs.find(rec, gone)
                hit = at >= 0
                stays[x.keyed[hit]] = gone["top"][at[hit]] == ids(chunk)[x.text[x.keyed[hit]]]
                data, _ = text_buffers(chunk.column("text"))
                kept = join_spans(data, x.starts[stays], (x.ends - x.starts)[stays], x.text[stays], len(x.counts), 0x0A)
                outs.append((chunk, kept, x.counts, np.bincount(x.text[~stays], minlength=len(x.counts))))
        if not outs:
            return empty
        cols = {c: pa.chunked_array([o[0].column(c) for o in outs]) for c in left.column_names if c not in ("text", "block")}
        return pa.table({**cols, "text": pa.chunked_array([o[1] for o in outs], type=pa.string()), "n_lines": np.concatenate([o[2] for o in outs]).astype(np.int64), "n_dropped": np.concatenate([o[3] for o in outs]).astype(np.int64)})

    fields = [f for f in dealt.schema.fields if f.name not in ("text", "block")]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    empty = to_arrow_schema(schema).empty_table()
    keys = dealt.mapInArrow(send, BLOB)
    if known is not None:
        keys = keys.union(known.mapInArrow(again, BLOB))
    keys = dealt_by(keys, n, "bucket")
    if known is not None:
        keys = keys.sortWithinPartitions(F.desc("kind"))  # runs before keys
    found = keys.mapInArrow(settle, BLOB)
    if keep:
        found = cut(found)
        found.where(F.col("kind") >= RUN).select((F.col("kind") - RUN).alias("level"), "blob").write.parquet(keep)
    found = dealt_by(found.where(F.col("kind") == GONE).select(F.col("bucket").alias("block"), "blob"), n, "block")
    out = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(drop, schema)
    return unblocked(out, docs, doc_id, text, ["n_lines", "n_dropped"])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_of(F.col("text")).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), gone AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, i, line, coalesce(top <> l.doc_id, false) AS dropped FROM keyed l LEFT JOIN gone USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
