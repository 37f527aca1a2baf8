"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has a node at every code point and an edge for every piece.  A forward Viterbi pass gives each node the
score of its best prefix; a backward A* search from the end uses these scores as heuristic.  They are exact, so paths leave
the queue in the order of their scores and the first N are the N best.  Scores are logarithms of probabilities in steps of 2**-20, kept as integers, so that sums are exact and don't
depend on the order in which they are made.

No piece of the model joins two words (checked when it is loaded), so the lattice of a text is a chain of word lattices
which meet in one node.  The Viterbi pass runs over the distinct words of a batch at once and also gives the distance from the best to
the second path.  The N best paths of a text leave the best path at no more than N - 1 words, and only at
those with the smallest distances: the others already have N better paths before them.  A* searches the lattices of these words, and the N best sums of their paths are merged word by word.

A unigram model has log-probabilities.  A BPE model has none: its scores are the ranks of its merges.  They become log-probabilities by the law of Zipf and Mandelbrot, p(rank) ~ 1 / (rank + 2.7), over
all its pieces.  The segmentation is the most probable one under these, which is not what a sequence of merges gives: see README for how often they agree.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import U64, chunks, sha256_of, span_hashes, table, text_buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: An unknown character costs this much more than the worst piece, as the public trainer has it (fixed value).
UNKNOWN = 10.0
#: Scores are counted in steps of 1 / STEPS.
STEPS = 1 << 20
#: The offset of Mandelbrot's form of Zipf's law (fixed value).
OFFSET = 2.7
#: Worse than any path, and a distance that no second path has.
_NONE, _FAR = -(1 << 60), 1 << 59
_MUL, _SLOT_1, _SLOT_2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
_MASK, _BITS = 0xFFFFFFFFFFFFFFFF, 19
_SHIFT = U64(64 - _BITS)
#: Words kept from chunk to chunk; beyond, they are forgotten and segmented again.
_KEEP = 400_000
#: Ids of them that are kept at most, beside those of the chunk at hand; alternatives count too.
_KEEP_IDS = 8_000_000
#: Bytes of text worked on at once.
CHUNK = 1 << 19


def log_probabilities(pieces: list[tuple[int, str, float]]) -> list[tuple[int, str, int]]:
    """The pieces with log-probabilities in STEPS: those of a unigram model as they are, or those that follow from the ranks of a BPE model, whose scores are whole numbers."""
    if any(s != int(s) for _, _, s in pieces):
        return [(i, x, round(s * STEPS)) for i, x, s in pieces]
    ranked = sorted(pieces, key=lambda p: (-p[2], p[0]))
    total = math.log(sum(1 / (r + OFFSET) for r in range(len(ranked))))
    return sorted((i, x, round((-math.log(r + OFFSET) - total) * STEPS)) for r, (i, x, _) in enumerate(ranked))


class Model:
    """Pieces, scores and byte pieces of a SentencePiece model, and its segmenter."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(p.vocab_size())
        normal = [(i, p.id_to_piece(i), float(p.get_score(i))) for i in every if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.__setstate__((log_probabilities(normal), {int(p.id_to_piece(i)[3:5], 16): i for i in every if p.is_byte(i)}, p.unk_id(), len(every)))

    def __getstate__(self):
        return self.spec  # a task gets the vocabulary and builds its own tables

    def __setstate__(self, spec):
        self.spec = spec
        normal, self.byte_ids, self.unknown_id, n = spec
        self.pieces = {x: (i, s) for i, x, s in normal}
        #: what every id stands for in a decoded text
        self.bytes = [b""] * n
        for i, x, _ in normal:
            self.bytes[i] = x.replace(SPACE, " ").encode()
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        width = max(map(len, self.bytes))
        self.piece_bytes = np.array([list(x.ljust(width, b"\0")) for x in [*self.bytes, b""]], np.uint8)
        self.piece_size = np.array([len(x) for x in [*self.bytes, b""]])
        self.unknown = min(s for _, s in self.pieces.values()) - round(UNKNOWN * STEPS)
        self.longest = max(map(len, self.pieces))
        chars = set("".join(self.pieces))
        self.hard = "".join(c for c in map(chr, range(32)) if c not in chars)
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.pieces)
        self._table()

    def _table(self) -> None:
        """Open table from the hash of a piece to its number: a piece stands in one of two slots, which are looked up for whole arrays."""
        names = list(self.pieces)
        none = len(names)
        self.ids = np.array([self.pieces[x][0] for x in names] + [-1], np.int32)
        self.scores = np.array([self.pieces[x][1] for x in names] + [_NONE])
        self.keys = np.array([self._hash(x) for x in names] + [0], np.uint64)
        assert len(np.unique(self.keys)) == len(self.keys)
        slots = ((self.keys[:-1] * _SLOT_1) >> _SHIFT).astype(np.int64)
        _, first = np.unique(slots, return_index=True)
        self.one = np.full(1 << _BITS, none, np.int32)
        self.one[slots[first]] = first
        rest = np.setdiff1d(np.arange(none), first)
        for turn in range(1, 64, 2):  # until no two of the rest meet
            self.second = U64(int(_SLOT_2) * turn & _MASK)
            slots = ((self.keys[rest] * self.second) >> _SHIFT).astype(np.int64)
            if len(np.unique(slots)) == len(slots):
                break
        else:
            raise ValueError("two pieces share both slots")
        self.two = np.full(1 << _BITS, none, np.int32)
        self.two[slots] = rest

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_MUL) + ord(c) + 1) & _MASK
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash; the last number, with the score _NONE, where there is none."""
        k = self.one[((h * _SLOT_1) >> _SHIFT).astype(np.int64)]
        miss = self.keys[k] != h
        if miss.any():
            j = self.two[((h[miss] * self.second) >> _SHIFT).astype(np.int64)]
            k[miss] = np.where(self.keys[j] == h[miss], j, len(self.ids) - 1)
        return k

    # --- one word: forward Viterbi and backward A* --------------------------------------------

    def edges(self, word: str, j: int) -> list[tuple[int, int, int]]:
        """(start, id, score) of the pieces that end at j; id -1 is an unknown character."""
        out = []
        for i in range(max(0, j - self.longest), j):
            if p := self.pieces.get(word[i:j]):
                out.append((i, *p))
        if not out or out[-1][0] != j - 1:
            out.append((j - 1, -1, self.unknown))
        return out

    def forward(self, word: str) -> list[int]:
        best = [0]
        for j in range(1, len(word) + 1):
            best.append(max(best[i] + s for i, _, s in self.edges(word, j)))
        return best

    def nbest(self, word: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations; the first of equal ones is that with the longest last pieces.

        Every node in the queue stands for a path of its own whose score is known, so nodes that come behind n better ones are left out: the queue has n nodes at most, and each node
        keeps its last piece and its successor only.
        """
        best = self.forward(word)
        heap = [(-best[-1], len(word), 0, 0, None)]  # cost, place, number, score from here to the end, (id, place, its rest) chain
        costs, number, out = [-best[-1]], 0, []
        while heap and len(out) < n:
            cost, j, _, tail, chain = heapq.heappop(heap)
            if j == 0:
                out.append((tail, self.expand(word, chain)))
                continue
            inherited = False
            for i, piece, s in self.edges(word, j):
                c = -(best[i] + s + tail)
                if c == cost and not inherited:
                    inherited = True  # the path that the node stood for
                elif len(costs) == n and c >= costs[-1]:
                    continue
                else:
                    bisect.insort(costs, c)
                    del costs[n:]
                number += 1
                heapq.heappush(heap, (c, i, number, s + tail, (piece, i, j, chain)))
        return out

    def expand(self, word: str, chain: tuple | None) -> list[int]:
        """Ids in reading order; an unknown character becomes its bytes, or the unknown id in a model without byte pieces."""
        out = []
        while chain is not None:
            piece, i, j, chain = chain
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_ids[b] for b in word[i:j].encode()] if self.byte_ids else [self.unknown_id]
        return out

    # --- many words at once --------------------------------------------------------------------

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its best ids (all of them in one array), how many, the score, and the distance to the second path."""
        size, score, gap = (np.zeros(len(words), np.int64) for _ in range(3))
        ids: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, x in enumerate(words):
            by_length.setdefault(len(x), []).append(k)
        for n, at in by_length.items():
            step = max(1, 200_000 // n)
            for a in range(0, len(at), step):
                part = at[a : a + step]
                found, size[part], score[part], gap[part] = self._same_length([words[k] for k in part], n)
                cuts = np.concatenate([[0], np.cumsum(size[part])]).tolist()
                for r, k in enumerate(part):
                    ids[k] = found[cuts[r] : cuts[r + 1]]
        return np.concatenate(ids) if words else np.zeros(0, np.int32), size, score, gap

    def _same_length(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(m, n).T.astype(np.uint64) + U64(1)
        one, two = np.full((n + 1, m), _NONE), np.full((n + 1, m), _NONE)
        one[0] = 0
        back = np.zeros((n + 1, m), np.int32)
        last = np.zeros((n + 1, m), np.int32)
        h = np.zeros((n, m), np.uint64)
        cols = np.arange(m)
        with np.errstate(over="ignore"):
            for j in range(1, n + 1):
                lo = max(0, j - self.longest)
                h[lo:j] *= _MUL
                h[lo:j] += codes[j - 1]
                k = self.find(h[lo:j])
                s = self.scores[k]
                s[-1] = np.where(k[-1] == len(self.ids) - 1, self.unknown, s[-1])
                cand = one[lo:j] + s
                top = cand.argmax(0)  # the first: of equal paths the one with the longest last piece
                one[j] = cand[top, cols]
                cand[top, cols] = _NONE
                two[j] = np.maximum(np.maximum(cand.max(0), (two[lo:j] + s).max(0)), _NONE)
                back[j] = top + lo
                last[j] = self.ids[k[top, cols]]
        steps, cur = [], np.full(m, n)
        while (cur > 0).any():
            steps.append(np.where(cur > 0, last[cur, cols], -2))
            cur = np.where(cur > 0, back[cur, cols], 0)
        ids = np.stack(steps[::-1], axis=1)
        real = ids != -2
        size = real.sum(1)
        flat = ids[real]
        odd = np.flatnonzero((ids == -1).any(1))
        if len(odd):  # unknown characters become bytes
            parts = np.split(flat, np.cumsum(size)[:-1])
            for r in odd.tolist():
                parts[r] = np.array(self.nbest(words[r], 1)[0][1], np.int32)
                size[r] = len(parts[r])
            flat = np.concatenate(parts)
        return flat, size, one[n], np.where(two[n] > _NONE // 2, one[n] - two[n], _FAR)

    # --- texts ----------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 become U+FFFD, ids out of range nothing, and a leading space goes."""
        ids = np.where((ids < 0) | (ids >= len(self.bytes)), len(self.bytes), ids)
        size = self.piece_size[ids]
        flat = self.piece_bytes[ids, : max(1, size.max(initial=0))]
        flat = flat[np.arange(flat.shape[1]) < size[:, None]].tobytes()
        cuts = np.concatenate([[0], np.cumsum(size)])[first].tolist()
        return [flat[a + (flat[a : a + 1] == b" " and a < b) : b].decode("utf-8", errors="replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Encoder:
    """Encodes chunks of texts, with a bounded store of segmented words that are known by the hash of their bytes."""

    def __init__(self, model: Model, nbest: int):
        self.model, self.nbest = model, nbest
        self.hard = np.zeros(256, bool)
        self.hard[[ord(c) for c in model.hard]] = True
        self.forget()

    def forget(self):
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.gap = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.alternatives: dict[str, list[tuple[int, list[int]]]] = {}
        self.held = 0

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes with a space before each text, the spans of the words in them, and the word range of each text."""
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        if not self.model.splits:
            starts = offsets[:-1][full]
            return data, starts, offsets[1:][full], np.concatenate([[0], np.cumsum(full)])
        space, hard = data == 0x20, self.hard[data]
        start = hard | space
        start[1:] &= hard[1:] | ~space[:-1]
        start[1:] |= hard[:-1]
        start[offsets[:-1][full]] = True
        starts = np.flatnonzero(start)
        return data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)

    def _word(self, data: np.ndarray, a: int, b: int) -> str:
        return data[a:b].tobytes().decode().replace(" ", SPACE)

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row in the store of each word; new words are segmented."""
        keys, first, own = np.unique(span_hashes(data, starts, ends)[0], return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        ok = at < len(self.keys)
        new[ok] = self.keys[at[ok]] != keys[ok]
        if new.any():
            if (len(self.keys) + new.sum() > _KEEP or len(self.flat) > _KEEP_IDS) and len(self.keys):
                self.forget()
                new[:] = True
            which = first[new]
            flat, size, score, gap = self.model.segment([self._word(data, a, b) for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            rows = np.concatenate([self.row, np.arange(len(self.size), len(self.size) + len(size))])
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.row = merged[order], rows[order]
            self.at = np.concatenate([self.at, len(self.flat) + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)])
            self.flat, self.size = np.concatenate([self.flat, flat.astype(np.int32)]), np.concatenate([self.size, size])
            self.score, self.gap = np.concatenate([self.score, score]), np.concatenate([self.gap, gap])
            at = np.searchsorted(self.keys, keys)
        return self.row[at][own]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
        """All best ids, their ranges by text, and the N best paths of each text as (score, edits of the best ids)."""
        data, starts, ends, first = self._spans(data, offsets)
        row = self.rows(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
        size = self.size[row]
        place = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(place[-1]) + np.repeat(self.at[row] - place[:-1], size)]
        gap = self.gap[row]
        paths = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            best = int(self.score[row[a:b]].sum())
            paths.append(self._nbest(data, starts[a:b], ends[a:b], gap[a:b], place[a : b + 1], best, ids))
        return ids, place[first], paths

    def _alternatives(self, word: str) -> list[tuple[int, list[int]]]:
        if (paths := self.alternatives.get(word)) is None:
            paths = self.model.nbest(word, self.nbest)
            if self.held > _KEEP_IDS or len(self.alternatives) > 50_000:
                self.alternatives.clear()
                self.held = 0
            self.alternatives[word] = paths
            self.held += len(word) + sum(len(x) for _, x in paths)
        return paths

    def _nbest(self, data, starts, ends, gap, place, best: int, ids) -> list[dict]:
        near = np.flatnonzero(gap < _FAR)
        if self.nbest == 1 or not len(near):
            return [{"score": best / STEPS, "edits": []}]
        if len(near) > self.nbest - 1:
            own = gap[near]
            limit = np.partition(own, self.nbest - 2)[self.nbest - 2]
            less = near[own < limit]
            near = np.sort(np.concatenate([less, near[own == limit][: self.nbest - 1 - len(less)]]))
        # the best sums of the words so far, as (loss, edits, chain of (word, path)); a further word adds its paths, and only pairs (p, q) with (p + 1) * (q + 1) <= N can be among the N best
        sums: list[tuple] = [(0, 0, None)]
        choices = []
        for k, w in enumerate(near.tolist()):
            paths = self._alternatives(self._word(data, starts[w], ends[w]))
            choices.append((w, paths))
            grown = []
            for p, (loss, edits, chain) in enumerate(sums):
                for q in range(min(len(paths), self.nbest // (p + 1))):
                    grown.append((loss + paths[0][0] - paths[q][0], edits + (q > 0), p, q, chain if q == 0 else (k, q, chain)))
            grown.sort(key=lambda x: x[:4])
            sums = [(loss, edits, chain) for loss, edits, _, _, chain in grown[: self.nbest]]
        out = []
        for loss, _, chain in sums:
            made = []
            while chain is not None:
                k, q, chain = chain
                w, paths = choices[k]
                made.append(_edit(int(place[w] - place[0]), paths[0][1], paths[q][1]))
            out.append({"score": (best - loss) / STEPS, "edits": made[::-1]})
        return out


def _edit(at: int, old: list[int], new: list[int]) -> dict:
    """What turns the ids `old`, which begin at `at`, into `new`, without what both begin and end with."""
    a = next((k for k, (x, y) in enumerate(zip(old, new, strict=False)) if x != y), min(len(old), len(new)))
    b = next((k for k, (x, y) in enumerate(zip(old[a:][::-1], new[a:][::-1], strict=False)) if x != y), min(len(old), len(new)) - a)
    return {"at": at + a, "n": len(old) - a - b, "ids": new[a : len(new) - b]}


NBEST = "array<struct<score:double,edits:array<struct<at:int,n:int,ids:array<int>>>>>"


def encode(docs: DataFrame, text: str = "text", model: Model | str = MODEL, nbest: int = 4, decoded: str | None = None) -> DataFrame:
    """`docs` with `ids`, the best segmentation of the whole text, and `nbest`, its N best.

    Each of the N best has its score and the edits (n ids at index `at` become `ids`) that lead to it from the best one.  Texts with
    fewer segmentations have fewer.  Null and empty texts have no ids and one path of score 0.  Very long texts are encoded whole, also those without spaces, in time proportional to their length.  Equal rows give
    equal results.  Input columns named ids or nbest are replaced.  An empty table gives an empty table.  `decoded` names a further
    column for the text that decode() gives of the ids, made in the same pass.
    """
    docs = docs.drop("ids", "nbest", *([decoded] if decoded else []))
    shipped = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Model) else Model(model))  # one vocabulary: bounded
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("nbest", T._parse_datatype_string(NBEST)), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    arrow = to_arrow_schema(schema)

    def scan(batches):
        coder = Encoder(shipped.value, nbest)
        for batch in batches:
            for chunk in chunks(batch, text, CHUNK):
                col = pc.fill_null(chunk.column(text), "")
                if pc.any(odd := pc.match_substring(col, SPACE)).as_py():  # this character stands for a space in every model
                    col = pc.if_else(odd, pc.replace_substring(col, SPACE, " "), col)
                ids, first, paths = coder.encode(*text_buffers(col))
                made = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                more = [pa.array(coder.model.decode(ids, first), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*chunk.columns, made.cast(arrow.field("ids").type), pa.array(paths, arrow.field("nbest").type), *more], schema=arrow)

    return docs.mapInArrow(scan, schema)


def decode(encoded: DataFrame, ids: str = "ids", model: Model | str = MODEL, to: str = "decoded") -> DataFrame:
    """`encoded` with the text of `ids` in column `to`; null ids give null, no ids give ''."""
    encoded = encoded.drop(to)
    shipped = encoded.sparkSession.sparkContext.broadcast(model if isinstance(model, Model) else Model(model))
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())])
    arrow = to_arrow_schema(schema)

    def scan(batches):
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                col = part.column(ids)
                offsets = col.offsets.to_numpy()
                flat = pc.fill_null(col.values.slice(offsets[0], offsets[-1] - offsets[0]), -1).to_numpy()
                texts = pa.array(shipped.value.decode(flat, offsets - offsets[0]), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pc.if_else(col.is_valid(), texts, pa.scalar(None, pa.string()))], schema=arrow)

    return encoded.mapInArrow(scan, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, score and N-best scores of every document, a digest of its ids, and one of the text decoded from them."""
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.element_at("nbest", 1)["score"].alias("best_score"),
        F.transform("nbest", lambda p: p["score"]).alias("nbest_scores"),
        F.sha2(F.encode(F.array_join("ids", " "), "UTF-8"), 256).alias("ids_sha256"),
        sha256_of(F.col("decoded")).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
