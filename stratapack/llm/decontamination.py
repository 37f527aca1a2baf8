"""Benchmark decontamination with SimHash over item-sized windows.

Every benchmark item of L words has a 256-bit SimHash of its weighted 5-word shingles, and so has every window of L
words of a text that can match it.  A shingle that occurs k times counts as k elements with hashes of their own, so that the share of equal elements, and
not their squares, decides how many bits differ.  Fingerprints are compared through 8 blocks of 32 bits: two that differ in at most RADIUS
bits differ in at most RADIUS // 8 bits of some block, so the block index finds all of them; about one in twenty-five of unrelated pairs passes it, and practically none the whole distance.
The candidates are then verified by the exact weighted (multiset) Jaccard similarity of the shingles.

A window whose similarity to an item is above 0 has a shingle of that item.  So windows without any shingle of the
benchmark are left out before hashing; this loses nothing, because they can't be verified.

One scan, no shuffle, if the benchmark is measured to be small.  A larger one is worked on in blocks of at most BLOCK_BYTES of text, one at a time: each is broadcast, the documents are scanned, and what
is found is written before the next one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import U64, Words, chunks, cut, free_name, mix, run_hashes, shingles, table, text_buffers

BLOCK_BYTES = 8 << 20
SIZE = 5
BITS, BLOCKS = 256, 8
#: Sets of similarity 0.75 share 6 of 7 elements, so their fingerprints differ in 44 bits on average, with a standard deviation of 6.1.
RADIUS = 71
#: Shingles of a text that are summed up at a time.
_STRETCH = 1 << 15
#: Pairs of windows and items that are compared at a time.
_PAIRS = 1 << 20
_SALTS = [U64(x) for x in (0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
MATCH = "array<struct<item_id:bigint,start:int,n_words:int,similarity:double,distance:int>>"


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each element."""
    parts = np.stack([mix(h ^ s) if s else h for s in _SALTS], axis=1)
    return np.unpackbits(parts.view(np.uint8).reshape(len(h), BITS // 8), axis=1).astype(np.int8) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """A row of BLOCKS words of 32 bits for each row of sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint32)


def _elements(h: np.ndarray) -> np.ndarray:
    """Hashes of the elements of one multiset: the k-th occurrence of a shingle is an element of its own."""
    h = np.sort(h)
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    k = np.arange(len(h)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return np.where(k == 0, h, mix(h ^ (k.astype(np.uint64) << U64(32))))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """The fingerprint of one multiset of shingles."""
    return _fingerprints(_signs(_elements(h)).sum(0, dtype=np.int32)[None])[0]


def near(windows: np.ndarray, items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(window, item, distance) of the fingerprints within the radius, and how many pairs the blocks admitted."""
    out, admitted = [], 0
    step = max(1, _PAIRS // max(1, len(items)))
    for a in range(0, len(windows), step):
        part = windows[a : a + step]
        found = np.zeros((len(part), len(items)), bool)
        for k in range(BLOCKS):
            found |= np.bitwise_count(part[:, k, None] ^ items[None, :, k]) <= radius // BLOCKS
        w, i = np.nonzero(found)
        admitted += len(w)
        distance = np.bitwise_count(part[w] ^ items[i]).sum(1, dtype=np.int64)
        ok = distance <= radius
        out.append((w[ok] + a, i[ok], distance[ok]))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return *cols, admitted


class Items:
    """Fingerprints and shingles of benchmark items, by number of words."""

    def __init__(self, ids: list, texts: list[str], radius: int):
        self.ids, self.radius = ids, radius
        w = Words(*text_buffers(pc.utf8_lower(pa.array([t or "" for t in texts], pa.string()))))
        h, first = shingles(w, SIZE)
        self.n_words = w.counts
        self.h, self.first = h, first
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        #: items of fewer words than a shingle are one shingle, so only equal windows match: (length, hash) -> items
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero((w.counts > 0) & (w.counts < SIZE)).tolist():
            self.short.setdefault(int(w.counts[i]), {}).setdefault(int(h[first[i]]), []).append(i)
        whole = w.counts[owner] >= SIZE
        self.all = np.unique(h[whole])
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.all >> U64(44)).astype(np.int64)] = True
        # lengths of the items that hold each shingle: those of shingle k are lengths[at[k] : at[k + 1]]
        pairs = np.unique(np.stack([np.searchsorted(self.all, h[whole]), w.counts[owner][whole]], axis=1), axis=0)
        self.lengths, self.at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.all) + 1))
        self.by_length = {}
        used = np.flatnonzero(w.counts >= SIZE)
        for n in np.unique(w.counts[used]).tolist():
            own = used[w.counts[used] == n]
            self.by_length[n] = own, np.stack([fingerprint(h[first[i] : first[i + 1]]) for i in own])

    def marks(self, h: np.ndarray) -> np.ndarray:
        """Indexes of the shingles that the benchmark has."""
        at = np.flatnonzero(self.bitmap[(h >> U64(44)).astype(np.int64)])
        return at[np.isin(h[at], self.all)]

    def match_short(self, w: Words, found: list[list[dict]]) -> None:
        """Adds the items of fewer than SIZE words: the first equal window of each text."""
        hashes = w.hashes(True) if self.short else None
        left = np.repeat(w.first[1:], w.counts) - np.arange(len(w.starts)) if self.short else None
        for n, items in self.short.items():
            starts = np.flatnonzero(left >= n)
            runs = run_hashes(hashes, starts, n)
            hit = np.flatnonzero(np.isin(runs, np.array(list(items), np.uint64)))
            seen = set()
            for s, k in zip(starts[hit].tolist(), runs[hit].tolist(), strict=True):
                text = int(np.searchsorted(w.first, s, side="right")) - 1
                if (text, k) not in seen:
                    seen.add((text, k))
                    found[text] += [{"item_id": self.ids[i], "start": s - int(w.first[text]), "n_words": n, "similarity": 1.0, "distance": 0} for i in items[k]]

    def match(self, h: np.ndarray, n_words: int, marked: np.ndarray, threshold: float) -> list[dict]:
        """Best window for each item, of one text with shingles h, where those at `marked` are the benchmark's."""
        k = np.searchsorted(self.all, h[marked])
        size = self.at[k + 1] - self.at[k]
        place = np.repeat(marked, size)
        length = self.lengths[np.arange(size.sum()) + np.repeat(self.at[k] - np.cumsum(size) + size, size)]
        again = _repeats(h)
        best: dict[int, dict] = {}
        for n in np.unique(length).tolist():
            size = min(n, n_words)
            span = max(size - SIZE + 1, 1)  # shingles in a window
            cover = np.zeros(len(h) + 1, np.int32)
            places = place[length == n]
            np.add.at(cover, np.maximum(places - span + 1, 0), 1)
            np.add.at(cover, places + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover)[: len(h) - span + 1] > 0)
            own, prints = self.by_length[n]
            while len(starts):
                part, starts = np.split(starts, [np.searchsorted(starts, starts[0] + _STRETCH)])
                at, item, distance, _ = near(_windows(h, part, span, again), prints, self.radius)
                for a, i, d in zip(part[at].tolist(), own[item].tolist(), distance.tolist(), strict=True):
                    similarity = self._similarity(h[a : a + span], i)
                    if similarity >= threshold and (i not in best or similarity > best[i]["similarity"]):
                        best[i] = {"item_id": self.ids[i], "start": a, "n_words": size, "similarity": similarity, "distance": d}
        return [best[i] for i in sorted(best)]

    def _similarity(self, h: np.ndarray, i: int) -> float:
        """Weighted Jaccard similarity of a window and an item."""
        need = self.h[self.first[i] : self.first[i + 1]]
        both = len(np.intersect1d(_elements(h), _elements(need), assume_unique=True))
        return both / (len(h) + len(need) - both)


def _repeats(h: np.ndarray) -> np.ndarray:
    """Of each shingle the place of its last occurrence before, or -1."""
    order = np.argsort(h, kind="stable")
    out = np.full(len(h), -1)
    same = h[order][1:] == h[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def _windows(h: np.ndarray, starts: np.ndarray, span: int, again: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows of `span` shingles at `starts`; windows that repeat a shingle are hashed one by one, equal ones once."""
    low, high = int(starts[0]), int(starts[-1]) + span
    signs = np.concatenate([np.zeros((1, BITS), np.int8), _signs(h[low:high])])
    sums = np.cumsum(signs, axis=0, dtype=np.int32)
    out = _fingerprints(sums[starts - low + span] - sums[starts - low])
    back = np.arange(low, high) - again[low:high]  # how far before the same shingle stands
    twice = (again[low:high] >= low) & (back < span)
    if twice.any():
        edge = np.zeros(high - low + 1, np.int32)  # a repeat at p lies in the windows from p - span + 1 to again[p]
        p = np.flatnonzero(twice)
        np.add.at(edge, np.maximum(p - span + 1, 0), 1)
        np.add.at(edge, again[low:high][p] - low + 1, -1)
        odd = np.flatnonzero(np.cumsum(edge)[starts - low] > 0)
        seen: dict[bytes, np.ndarray] = {}
        for k in odd.tolist():
            window = np.sort(h[starts[k] : starts[k] + span])
            key = window.tobytes()
            if key not in seen:
                seen[key] = fingerprint(window)
            out[k] = seen[key]
    return out


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.75, radius: int = RADIUS) -> DataFrame:
    """`docs` with a column `matches`: the items found in each text, each with its best window.

    Words are lower-cased (Unicode); a window has as many words as the item, or is the whole text where that is shorter.  Similarity is the
    weighted Jaccard of 5-word shingles (fewer words: the whole sequence).  Of equal windows the first is given.
    Null and empty texts and items match nothing; very long texts are searched whole; a repeated row is matched again; repeated items are all given, also those
    without id.  An input column named matches is replaced, all others pass unchanged.  Empty tables give no matches.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("length(t) > 0")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    docs = docs.drop("matches")
    if n_blocks == 1:
        return _scan(docs, _index(docs.sparkSession, items, radius), text, threshold)
    key, found = free_name("row", docs.columns), free_name("found", docs.columns)
    docs = cut(docs.withColumn(key, F.monotonically_increasing_id()))  # written, so that every block sees the same numbers
    made = None
    for b in range(n_blocks):
        index = _index(docs.sparkSession, items.where(F.pmod(F.xxhash64("t", "i"), F.lit(n_blocks)) == b), radius)
        part = cut(_scan(docs.select(key, F.col(f"`{text}`").alias("text")), index, "text", threshold).where(F.size("matches") > 0).select(F.col(key).alias(found), "matches"))
        index.destroy()
        made = part if made is None else made.union(part)
    made = made.groupBy(found).agg(F.flatten(F.collect_list("matches")).alias("matches"))  # a text's items
    out = docs.join(made, docs[key] == made[found], "left")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c != key), F.coalesce("matches", F.array().cast(MATCH)).alias("matches"))


def _index(spark: SparkSession, items: DataFrame, radius: int):
    """The broadcast index of items, of at most about BLOCK_BYTES of text."""
    rows = items.collect()
    return spark.sparkContext.broadcast(Items([r.i for r in rows], [r.t for r in rows], radius))


def _scan(docs: DataFrame, index, text: str, threshold: float) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField("matches", T._parse_datatype_string(MATCH))])
    arrow = to_arrow_schema(schema)

    def scan(batches):
        for batch in batches:
            for chunk in chunks(batch, text):
                w = Words(*text_buffers(pc.utf8_lower(chunk.column(text))))
                h, first = shingles(w, SIZE)
                at = index.value.marks(h)
                owner = np.searchsorted(first, at, side="right") - 1
                found: list[list[dict]] = [[] for _ in range(len(chunk))]
                for i in np.unique(owner).tolist():
                    found[i] = index.value.match(h[first[i] : first[i + 1]], int(w.counts[i]), at[owner == i] - first[i], threshold)
                index.value.match_short(w, found)
                yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(found, arrow.field("matches").type)], schema=arrow)

    return docs.mapInArrow(scan, schema)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every benchmark item found in a document, with its best window."""
    out = match_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.start", "m.n_words", "m.similarity")


OP10_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
), ish AS (
  SELECT item_id, g, count(*) AS c FROM (SELECT item_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i)) GROUP BY item_id, g
), dsh AS (
  SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)
), hit AS (
  SELECT DISTINCT doc_id, item_id FROM dsh JOIN ish USING (g)
), win AS (
  SELECT doc_id, item_id, size, unnest(range(1, nd - size + 2)) AS s
  FROM (SELECT doc_id, item_id, least(len(i.w), len(d.w)) AS size, len(d.w) AS nd FROM hit JOIN i USING (item_id) JOIN d USING (doc_id))
), wsh AS (
  SELECT win.doc_id, item_id, s, size, g, count(*) AS c FROM win JOIN dsh ON dsh.doc_id = win.doc_id AND p BETWEEN s AND s + size - 5 GROUP BY ALL
), sim AS (
  SELECT doc_id, item_id, s, size, sum(least(wsh.c, ish.c)) AS b FROM wsh JOIN ish USING (item_id, g) GROUP BY ALL
), r AS (
  SELECT doc_id, item_id, s, size, b::DOUBLE / (size - 4 + len(i.w) - 4 - b)::DOUBLE AS similarity FROM sim JOIN i USING (item_id)
)
SELECT doc_id, item_id, (arg_max(s, (similarity, -s)) - 1)::INTEGER AS start, any_value(size)::INTEGER AS n_words, max(similarity) AS similarity
FROM r WHERE similarity >= 0.75 GROUP BY doc_id, item_id
"""
