"""Each operator against brute force on small tables."""

import collections
import hashlib
import html
import itertools
import json
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratapack.llm.common import text_buffers
from stratapack.llm import chat, decontamination, html_extraction, language_id, line_dedup, near_dedup, quality_rules, sentencepiece_nbest, substring_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def shingles(ws, n=5):
    return [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)] or ([tuple(ws)] if ws else [])


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, n):
    ws = text.split(" ")
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
    return " ".join(ws)


@pytest.fixture(scope="module")
def corpus(spark):
    """Passages, exact and near copies, repeated lines, nulls and odd texts."""
    rng = random.Random(3)
    passage, line = prose(rng, 60), "A line that many documents share, word for word"
    texts = [None, "", " \n\t ", "one", "Two words", "één ünï çodé 日本 \U0001f600", "a\tb\x0bc\x0cd\re", line, f"  {line.upper()}\t\n{line}"]
    for k in range(60):
        texts.append(prose(rng, rng.randrange(1, 200)))
        if k % 5 == 0:
            texts.append(f"{prose(rng, 30)} {passage}\n{line}\n{prose(rng, 20)}")
    base = prose(rng, 150)
    texts += [edited(rng, base, k % 12) for k in range(60)]
    texts += [texts[20]] * 4 + [texts[20].upper()] + [f"{passage} {passage}", f"{prose(rng, 5)} " * 40]
    rows = [(k * 3 - 7, t, None if k % 4 == 0 else "en", "s", None) for k, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).cache()


def test_substring_dedup(corpus):
    rows, docs = corpus
    for window in (35, 9, 3):
        all_words = {r[0]: words(r[1]) for r in rows}
        count = collections.Counter(tuple(w[i : i + window]) for w in all_words.values() for i in range(len(w) - window + 1))
        got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs, window=window).collect()}
        assert len(got) == len(rows)
        for i, w in all_words.items():
            gone = [False] * len(w)
            for k in range(len(w) - window + 1):
                if count[tuple(w[k : k + window])] > 1:
                    gone[k : k + window] = [True] * window
            kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            assert (got[i].n_words, got[i].n_removed, got[i].text) == (len(w), sum(gone), kept)


def test_difference_covers():
    for v, cover in substring_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_line_dedup(corpus):
    rows, docs = corpus
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    lines = {r[0]: (r[1] or "").split("\n") for r in rows}
    key = lambda x: x.strip(strip).translate(A_Z)
    holders = collections.defaultdict(set)
    for i, ls in lines.items():
        for x in ls:
            holders[key(x)].add(i)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for i, ls in lines.items():
        kept = [x for x in ls if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(ls), len(ls) - len(kept), "\n".join(kept))
    assert any(r.n_dropped for r in got.values())


def test_levelled_runs():
    rng, runs, want = np.random.default_rng(1), line_dedup.Runs(min_docs=3, fanout=3), collections.defaultdict(set)
    for _ in range(40):
        keys = rng.integers(0, 50, 12).astype(np.uint64)
        batch = np.zeros(len(keys), line_dedup.record(3))
        batch["h"], batch["g"], batch["top"] = keys // 2, keys % 2, line_dedup.NONE
        batch["top"][:, 0] = rng.integers(0, 9, len(keys))
        runs.add(batch)
        for r in batch:
            want[int(r["h"] * 2 + r["g"])].add(int(r["top"][0]))
    whole = runs.whole()
    assert {int(r["h"] * 2 + r["g"]): [i for i in r["top"].tolist() if i != line_dedup.NONE] for r in whole} == {k: sorted(v, reverse=True)[:3] for k, v in want.items()}
    assert all(len(level) < 3 for level in runs.levels)
    assert sum(len(r) for level in runs.levels for r in level) == len(want)  # every key stands once


def test_line_dedup_against_kept_runs(spark, corpus, tmp_path):
    """A second batch of documents is judged with the lines of the first, whose runs were kept."""
    rows, docs = corpus
    first, second = docs.where("doc_id < 200"), docs.where("doc_id >= 200")
    assert line_dedup.dedup_lines(first, keep=str(tmp_path / "a")).count() == first.count()
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(second, known=spark.read.parquet(str(tmp_path / "a")), keep=str(tmp_path / "b")).collect()}
    whole = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {k: whole[k] for k in got} and len(got) > 50  # later documents have larger ids here
    line = "a line that stands in one later document and two earlier ones, " * 2
    third = spark.createDataFrame([(k, line, None, None, None) for k in (-900, -901)], docs.schema)
    fourth = spark.createDataFrame([(-902, line, None, None, None)], docs.schema)
    line_dedup.dedup_lines(third, known=spark.read.parquet(str(tmp_path / "b")), keep=str(tmp_path / "c")).count()
    assert [r.n_dropped for r in line_dedup.dedup_lines(fourth, known=spark.read.parquet(str(tmp_path / "c"))).collect()] == [1]
    assert [r.n_dropped for r in line_dedup.dedup_lines(fourth, known=spark.read.parquet(str(tmp_path / "b"))).collect()] == [0]


def test_blocks(spark, corpus, monkeypatch):
    """Many small blocks, and more blocks than partitions, give the same rows."""
    from stratapack.llm import common

    rows, docs = corpus
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit(5).cast("long")).when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    ops = [lambda: sorted(map(str, substring_dedup.dedup_substrings(docs, window=9).collect())), lambda: sorted(map(str, line_dedup.dedup_lines(odd).collect()))]
    want = [op() for op in ops]
    monkeypatch.setattr(common, "BLOCK_BYTES", 900)
    assert common.blocked(docs, "doc_id", "text")[1] > 30
    assert [op() for op in ops] == want
    monkeypatch.setattr(common, "MOST_PARTITIONS", 3)
    assert [op() for op in ops] == want


def components(sets, percent=75):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_dedup(corpus):
    rows, docs = corpus
    sets = {r[0]: frozenset(shingles(words((r[1] or "").translate(A_Z)))) for r in rows}
    want = components(sets)
    got = {r.id: r for r in near_dedup.near_components(docs).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if want[i] == i)


def test_near_dedup_finds_links_inside_long_postings(spark, monkeypatch):
    """Copies of one text that differ from it by about the threshold: the leader links only part of them."""
    monkeypatch.setattr(near_dedup, "SHORT", 2)
    rng = random.Random(8)
    texts = []
    for _ in range(3):
        base = prose(rng, 120, 10**6)
        middle = [edited(rng, base, n) for n in (2, 3, 4, 5, 6) * 8]
        texts += [base, *middle, *[edited(rng, m, 2) for m in middle]]
    sets = {k: frozenset(shingles(t.split(" "))) for k, t in enumerate(texts)}
    want = components(sets)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in near_dedup.near_components(docs).collect()}
    assert got == want
    assert len(set(want.values())) > 3


def test_near_dedup_links_through_a_document_without_id(spark):
    """The middle text is near both others, which are near it only."""
    base = [f"w{k}" for k in range(100)]
    middle = [f"x{k}" if k in (10, 30) else w for k, w in enumerate(base)]
    last = [f"x{k}" if k in (60, 80) else w for k, w in enumerate(middle)]
    docs = spark.createDataFrame([(1, " ".join(base)), (None, " ".join(middle)), (3, " ".join(last)), (None, "some other text of six words"), (4, None)], "doc_id long, text string")
    got = near_dedup.near_components(docs).collect()
    assert sorted(((r.id, r.component_id, r.kept) for r in got), key=str) == [(1, 1, True), (3, 1, False), (4, 4, True), (None, 1, False), (None, None, True)]


def test_near_duplicates_go_by_row(spark):
    """An id with several texts keeps those that no smaller id has."""
    x, y = prose(random.Random(1), 40, 10**6), prose(random.Random(2), 40, 10**6)
    rows = [(3, x), (5, x), (5, y), (5, y), (6, y), (7, None), (7, ""), (7, x), (None, x)]
    docs = spark.createDataFrame([(i, t, "c", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, __node0 string, id long")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.id for r in kept.collect()) == [0, 2, 3, 5, 6, 8]


def test_rest_pairs_lose_no_link(spark):
    rng = random.Random(4)
    sets = {}
    for k in range(90):
        base = [rng.randrange(60) for _ in range(rng.randrange(3, 45))]
        sets[k] = frozenset(base)
        sets[k + 100] = frozenset(base[rng.randrange(4) :] + [1000 + rng.randrange(9) for _ in range(rng.randrange(4))])
    frame = spark.createDataFrame([(k, bytearray(np.array(sorted(s), np.int64).tobytes())) for k, s in sets.items() if s], "node long, shingles binary")
    labels = spark.createDataFrame([(k, k) for k in sets], "node long, label long")
    got = {(r.a, r.b) for r in near_dedup.rest_pairs(frame, labels, 75).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert want and want <= got


def test_decontamination(spark, corpus):
    rows, _ = corpus
    rng = random.Random(9)
    items = [(k, prose(rng, 14 + k)) for k in range(20)] + [(90, "just Four words here"), (91, None), (92, ""), (None, prose(rng, 30))]
    texts = [r[1] for r in rows][:40]
    for k, t in items[:20]:
        texts += [f"{prose(rng, 20)} {t.upper()}\n{prose(rng, 9)}", f"{prose(rng, 5)} {edited(rng, t, 1)} {prose(rng, 5)}", " ".join(t.split()[k % 4 :]) + " " + prose(rng, 30)]
    texts.append("so JUST four words here")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.m.item_id) for r in decontamination.match_benchmark(docs, bench).select("doc_id", F.explode("matches").alias("m")).collect()}
    want = set()
    for i, t in enumerate(texts):
        w = words((t or "").lower())
        for k, item in items:
            need = words((item or "").lower())
            n = min(len(need), len(w))
            a = collections.Counter(shingles(need))
            for s in range(len(w) - n + 1 if n else 0):
                b = collections.Counter(shingles(w[s : s + n]))
                if 4 * (a & b).total() >= 3 * (a | b).total():
                    want.add((i, k))
                    break
    assert got == want and len(want) >= 40


def test_decontamination_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "k l m n o p q r s t")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "k l m n o p q r s t"), (3, "zz yy xx")], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 20)
    got = decontamination.match_benchmark(docs, bench)
    assert got.columns == ["doc_id", "text", "matches"]
    assert {r.doc_id: [m.item_id for m in r.matches] for r in got.collect()} == {1: [1], 2: [2]}


def test_hamming_index():
    """Of pairs at the threshold all lie within the radius, and the blocks admit few unrelated pairs."""
    rng = np.random.default_rng(5)
    make = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    lost, total = 0, 0
    for n in (5, 6, 7, 13, 28, 70, 140, 400):
        change = max(k for k in range(n) if 4 * (n - k) >= 3 * (n + k))
        for _ in range(150):
            item = make(n)
            other = np.concatenate([item[: n - change], make(change)])
            d = int(np.bitwise_count(decontamination.fingerprint(item) ^ decontamination.fingerprint(other)).sum())
            lost, total = lost + (d > decontamination.RADIUS), total + 1
    assert lost == 0 and total == 1200
    prints = np.stack([decontamination.fingerprint(make(30)) for _ in range(300)])
    w, i, d, admitted = decontamination.near(prints, prints, decontamination.RADIUS)
    assert (w == i).all() and len(w) == 300 and (d == 0).all() and admitted < 0.06 * 300 * 300


def test_decontamination_with_runs(spark):
    """Runs of one word: weights, not their squares, decide the distance."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    items = [(k, " ".join([*base[: 88 + k], *["zero"] * 14])) for k in range(12)]
    docs = [(k, " ".join(["a", *base[: 88 + k], *["other"] * 14, "b"])) for k in range(12)]
    got = decontamination.match_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for r in got:
        want = set()
        w = r.text.split()
        for k, t in items:
            a = grams(t.split())
            n = len(t.split())
            if any(4 * (a & b).total() >= 3 * (a | b).total() for b in (grams(w[s : s + n]) for s in range(max(1, len(w) - n + 1)))):
                want.add(k)
        assert {m.item_id for m in r.matches} == want and r.doc_id in want


@pytest.fixture(scope="module")
def model():
    return sentencepiece_nbest.Model()


def segmentations(model, word, j):
    if j == 0:
        return [0]
    return [s + b for i, _, s in model.edges(word, j) for b in segmentations(model, word, i)]


def test_sentencepiece_words(model):
    cases = ["▁the", "▁retraction", "▁日本語x", "\n", "▁▁▁ab", "▁", "ab▁", "▁übergrößen"]
    flat, size, score, gap = model.segment(cases)
    ids = np.split(flat, np.cumsum(size)[:-1])
    for k, w in enumerate(cases):
        every = sorted(segmentations(model, w, len(w)), reverse=True)
        found = model.nbest(w, 5)
        assert [s for s, _ in found] == every[:5]
        assert score[k] == every[0] and ids[k].tolist() == found[0][1]
        assert gap[k] == (every[0] - every[1] if len(every) > 1 else sentencepiece_nbest._FAR)


def test_sentencepiece_scores(model):
    """Log-probabilities of all pieces: they sum to 1, and an earlier merge is more probable."""
    assert abs(sum(math.exp(s / sentencepiece_nbest.STEPS) for _, s in model.pieces.values()) - 1) < 1e-4
    assert model.pieces["▁t"][1] > model.pieces["▁the"][1] > model.pieces["梦"][1]
    unigram = [(3, "a", -1.5), (4, "ab", -2.25)]
    assert sentencepiece_nbest.log_probabilities(unigram) == [(3, "a", round(-1.5 * 2**20)), (4, "ab", round(-2.25 * 2**20))]


def test_sentencepiece_many_best(model):
    """Ten best of short texts of several words against all segmentations."""
    coder = sentencepiece_nbest.Encoder(model, 10)
    for t in ("the cat", "a b", "xyzzy q", "aa aa aa", "é", "naïve"):
        _, _, paths = coder.encode(*text_buffers(pa.array([t])))
        every = sorted(segmentations(model, "▁" + t.replace(" ", "▁"), len(t) + 1), reverse=True)
        assert [p["score"] for p in paths[0]] == [x / sentencepiece_nbest.STEPS for x in every[:10]]


def test_sentencepiece_long_word(model):
    """200,000 letters without a space: every path spells the text, and memory stays small."""
    import resource

    rng = random.Random(8)
    for t in ("".join(rng.choice("abcdefgh") for _ in range(200_000)), "a" * 50_000):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        ids, first, paths = sentencepiece_nbest.Encoder(model, 4).encode(*text_buffers(pa.array([t])))
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB
        assert len(paths[0]) == 4 and [p["score"] for p in paths[0]] == sorted((p["score"] for p in paths[0]), reverse=True)
        for p in paths[0]:
            made = list(ids)
            for e in reversed(p["edits"]):
                made[e["at"] : e["at"] + e["n"]] = e["ids"]
            assert model.decode(np.array(made, np.int64), np.array([0, len(made)])) == [t]


def test_sentencepiece_texts(corpus, model):
    rows, docs = corpus
    out = sentencepiece_nbest.decode(sentencepiece_nbest.encode(docs.select("doc_id", "text"), model=model), model=model)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out.collect():
        t = texts[r.doc_id]
        assert r.decoded == t
        whole = model.nbest(sentencepiece_nbest.SPACE + t.replace(" ", sentencepiece_nbest.SPACE), 4) if t and len(t) < 400 else None
        if whole:
            assert [p.score for p in r.nbest] == [s / sentencepiece_nbest.STEPS for s, _ in whole] and r.ids == whole[0][1]
        for p in r.nbest:  # every path spells the text
            ids = list(r.ids)
            for e in reversed(p.edits):
                ids[e.at : e.at + e.n] = e.ids
            assert model.decode(np.array(ids, np.int64), np.array([0, len(ids)])) == [t]


def test_decode_odd_ids(spark, model):
    a = model.byte_ids[0xE2]
    df = spark.createDataFrame([([a],), ([-5, 10**6, None],), ([],), (None,)], "ids array<int>")
    assert [r.decoded for r in sentencepiece_nbest.decode(df, model=model).collect()] == ["�", "", "", None]


def test_language_id(spark):
    rng = random.Random(2)
    syllables = {"en": "the th ing ion wh sh ea".split(), "fr": "é è ê ou eau que ç".split(), "de": "ß ö ü sch ch ung ei".split()}
    rows = [(k, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randrange(20, 400))), lang) for k, lang in enumerate(["en", "fr", "de"] * 150)]
    docs = spark.createDataFrame([*rows, (9001, None, "en"), (9002, "1 2 3 !", "en"), (9003, "", None), (None, "the thing", "en")], "doc_id long, text string, lang string")
    model = language_id.train(docs.where(~language_id.held_out()), max_windows=900)
    got = language_id.identify(docs, model).withColumn("held", language_id.held_out()).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (9001, 9002, 9003)} == {k: ("und", 0.0) for k in (9001, 9002, 9003)}
    held = [r for r in got if r.held and (r.doc_id or 0) < 9000]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    again = language_id.train(docs.where(~language_id.held_out()), max_windows=900)
    assert all((again.p[k] == model.p[k]).all() for k in model.p)
    x = np.frombuffer(rows[0][1].encode()[:256].ljust(256, b"\0"), np.uint8)[None]
    hidden = []
    for w in language_id.WIDTHS:  # tables against the convolution itself
        e = model.p["E"][x[0]]
        z = np.stack([e[i : i + w].ravel() @ model.p[f"W{w}"] for i in range(256 - w + 1)]) + model.p[f"B{w}"]
        hidden.append(np.maximum(z.max(0), 0))
    want = language_id._softmax((np.concatenate(hidden) @ model.p["V"] + model.p["C"])[None])
    assert np.allclose(model.predict(x), want, atol=1e-4)


def test_quality_rules(corpus):
    rows, docs = corpus
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = words(t)
        places = collections.defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        rep = {k + j for ks in places.values() if len(ks) > 1 for k in ks for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        base = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), base)
        assert r.kept == (r.rejected_by is None) and (not base or r.rejected_by == "base")


def test_cascade_order_is_free(spark):
    docs = spark.createDataFrame([(k, f"{'#' * (k % 7)} word " * 25) for k in range(30)], "doc_id long, text string")
    rules = quality_rules.standard_rules()
    verdicts = [{r.doc_id: r.kept for r in quality_rules.measures(docs).withColumn("kept", quality_rules.cascade(order).isNull()).collect()} for order in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1] and len(set(verdicts[0].values())) == 2
    ordered = quality_rules.estimate(docs, rules, sample=100)
    assert {r.name for r in ordered} == {r.name for r in rules}
    worth = [r.selectivity / r.cost for r in ordered]
    assert worth == sorted(worth, reverse=True)


def test_rule_costs(spark):
    """A rule that looks at nothing costs next to nothing, a slow one much more; the sample stays bounded whatever the texts are."""
    docs = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("some words of a text "), 30)).alias("text"), F.lit("own").alias("__m0"))
    slow = quality_rules.Rule("slow", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?:[a-z]+ )+?x", "")) < 0)
    cheap = quality_rules.Rule("cheap", F.col("n_symbols") < 0)
    got = {r.name: r for r in quality_rules.estimate(docs, [slow, cheap], sample=300)}
    assert got["slow"].cost > 20 * got["cheap"].cost
    half = quality_rules.Rule("null", F.col("word_chars") == 0)
    assert 0.35 < quality_rules.estimate(docs, [half], sample=1000)[0].selectivity < 0.65
    assert quality_rules.judge(docs.limit(50)).where("__m0 = 'own'").count() == 50


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="menu-open"><header><h2>Site</h2></header><nav><ul><li><a href="/a">{nav}</a></li></ul></nav>'
    '<div class="ad">Buy {nav}</div><article><header><h1>{title}</h1></header><p>First &amp; foremost\n &eacute; {body}<p>Second <b>bold</b>, <a href="x">link</a><br>line<ul><li>item one<li>item two</ul>'
    '<form><input>mail me</form><div id="comments"><p>I disagree</p></div><p>Tail &#65;&lt;</article><aside>Side {nav}</aside><div class="cookie-notice">We use cookies</div><footer>&copy; {nav}</footer></body></html>'
)


def test_html_extraction(spark):
    pages = [(k, f"http://host{k % 3}.example.com/{k}", PAGE.format(nav=f"n{k}", title=f"Title {k}", body=f"body {k}")) for k in range(12)]
    pages += [(100, "http://host0.example.com/x", pages[0][2][: pages[0][2].index("link</a>") + 3]), (101, None, None), (102, "nohost", ""), (103, "http://plain.example.com/", "<p>Only a paragraph<p>and more"), (104, "http://host1.example.com/z", "no markup at all")]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k] == f"Title {k}\nFirst & foremost é body {k}\nSecond bold, link line\nitem one\nitem two\nTail A<"
    assert got[100].endswith("Second bold, lin") and got[101] == "" and got[102] == ""
    assert got[103] == "Only a paragraph\nand more" or got[103].startswith("Only a paragraph")


def extracted(source):
    return html_extraction.Page(source, True).own_text()


def test_html_camel_case_and_inline_asides():
    page = html_extraction.Page('<article><p>One <span class="ad">buy <span>now</span></span>two</p><div class="siteNav">menu</div><div id="Sidebar">side</div><p>three <b class="x">bold</b><a class="shareLink">share<p>four</p></article><p>five</p>', True)
    assert page.own_text() == "One two\nthree bold\nfour"
    assert [t for e, t, _ in page.blocks if page.aside[e]] == ["menu", "side"]


def test_html_markup():
    """Forms of markup that pages have: each keeps what an article says, and nothing else."""
    art = "<html><body><nav>menu</nav><article>{}</article><footer>foot</footer></body></html>"
    cases = {
        "İ" * 10 + '<script>var a = "</p>"</script><p>abc': "İ" * 10 + "\nabc",
        "<p>one <script>x()</script>two <!-- <p> -->three</p>": "one two three",
        "<p title=don't>it</p><p title=\"it's\">is</p>": "it\nis",
        '<p>a</p><p class="x>b</p><p>c</p>': "a\nb\nc",
        '<section id="search-algorithms"><p>Binary search</p></section><h2 class="social">Social</h2><p class="legal-history">Law</p>': "Binary search\nSocial\nLaw",
        '<div class="user-comments">a</div><div class="for-you related">b</div><p class="reader">g</p><div class="adSlot1">h</div>': "g",
        '<div class="cookie-notice">c</div><div id="comments">d</div><div class="ad-banner top">e</div><p>f</p>': "f",
        "<p>x <math><mi>y</mi></math> <svg><text>z</text></svg><object>w</object>": "x y\nz\nw",
        "<p>a<br>b<br/>c</p>": "a b c",
        "<p>a &lt;b&gt; &amp;amp; &#x41;&nbsp;&copy</p>": "a <b> &amp; A ©",
        "<h1>T</h1>lead<ul><li>i<li>j</ul><table><tr><td>u<td>v</table>tail": "T\nlead\ni\nj\nu\nv\ntail",
        "<p>3 < 4 > 2 <</p></><p>end</ p>": "3 < 4 > 2 <\nend",
        "<!-- a --!><p>b<!--></p><p>c<!---></p><!-- open <p>d": "b\nc",
        "<SCRIPT>a</SCRIPT ><STYLE>b</style><p>c": "c",
    }
    for inner, want in cases.items():
        got = extracted(art.format(inner))
        assert got == want, (inner, got)
    assert extracted("<main><article class=a><p>" + "long " * 50 + "</p></article><article class=b><p>short</p></article><aside>x</aside></main>").split("\n")[1] == "short"
    assert extracted("<body><article class=a><p>one</p></article><div><article class=b><p>two</p></article></div><p>three</p></body>") == "one\ntwo"
    deep = "<body><p>out</p>" + "<div>" * 100 + "<article><p>in</p></article>" + "</div>" * 100 + "<p>side</p></body>"
    assert extracted(deep) == "in"
    assert extracted("<div>" * 20_000 + "deep") == "deep"
    assert extracted('<body><div role="main"><p>in</p></div><div class="x"><p>after</p></div></body>') == "in"
    began = time.perf_counter()
    for odd in ("<x>" * 50_000 + "<p>a" * 20_000, "<p><div>" + "<x>" * 50_000 + "<p>a" * 20_000, "<x>" * 50_000 + "</y>" * 50_000, "<a href='" * 20_000, "<ul>" * 30_000 + "<li>a" * 30_000, "<script>" * 50_000, "<!--" * 50_000):
        extracted(odd)
    assert time.perf_counter() - began < 60
    assert extracted('<body><div class="content-sidebar-wrap"><p>all</p></div></body>') == "all" and extracted('<body><div class="ad">buy</div><article></article></body>') == ""
    assert extracted('<body><div class="widget"><p>all of it</p><div class="ad">buy</div></div></body>') == "all of it"


TEMPLATE = "<html><body><div class='top'>Welcome to our long and friendly greeting, dear readers</div><div class='box'><h1>{0}</h1><p>{1}</p></div><div class='end'>{2}</div></body></html>"


def test_html_template_decides(spark, monkeypatch):
    """What the pages of a host share is known only from all of them: without vectors the greeting stays."""
    rng = random.Random(6)
    pages = [(k, "http://h.example.com/", TEMPLATE.format(prose(rng, 3, 10**6), prose(rng, 30, 10**6), prose(rng, 20, 10**6))) for k in range(9)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {k: "\n".join(re.findall(r"<(?:h1|p|div class='end')>(.*?)</", src)) for k, _, src in pages}
    assert {r.page_id: r.text for r in html_extraction.extract(docs).collect()} == want
    alone = {k: extracted(src) for k, _, src in pages}
    assert all(alone[k].startswith("Welcome") for k in alone)
    tokens, texts = host_tokens([p[2] for p in pages])
    assert len(html_extraction.main_slots(tokens, texts)["quiet"]) == 1
    shuffled = [t | {"vector": k + 7, "pages": 2} for k, t in enumerate(texts)]
    assert html_extraction.main_slots(tokens, shuffled)["quiet"] == []


def host_tokens(sources):
    """Tokens and repeated texts of pages of one host, with whole vectors."""
    tokens, texts = {}, {}
    for k, src in enumerate(sources):
        page = html_extraction.Page(src, True)
        for p, (n, up, name, size) in page.tokens().items():
            t = tokens.setdefault(p, {"parent": up, "name": name, "vector": [0] * len(sources), "chars": 0})
            t["vector"][k] = n
            t["chars"] += size
        for e, text, linked in page.blocks:
            if not page.aside[e]:
                t = texts.setdefault((page.path[e], text), {"path": page.path[e], "vector": [0] * len(sources), "chars": 0})
                t["vector"][k] += 1
                t["chars"] += len(text) - linked
    for t in (*tokens.values(), *texts.values()):
        t["vector"] = tuple(t["vector"])
        t["pages"] = sum(map(bool, t["vector"]))
    return {p: t for p, t in tokens.items() if t["pages"] > 1}, [t for t in texts.values() if t["pages"] > 1]


def test_html_distributed_vectors_equal_whole_ones(spark):
    """Sums of marks give the same slots as vectors that are written out."""
    rng = random.Random(12)
    make = lambda k: f"<html><body><div class=m{k % 2}>{'same words here ' * 3}</div><div id=c><h2>{prose(rng, 4, 10**6)}</h2>{''.join(f'<p>{prose(rng, 9, 10**6)}</p>' for _ in range(k % 4))}</div><div class=s>{prose(rng, 8, 10**6)}</div></body></html>"
    sources = {h: [make(k) for k in range(7)] for h in range(5)}
    rows = [(f"http://h{h}.example.com/", s) for h, ss in sources.items() for s in ss]
    got = {r.host: r.main.asDict() for r in html_extraction.templates(spark.createDataFrame(rows, "url string, html string").repartition(6)).collect()}
    for h, ss in sources.items():
        want = html_extraction.main_slots(*host_tokens(ss))
        assert {k: set(v) for k, v in got[f"h{h}.example.com"].items()} == {k: set(want[k]) for k in ("slots", "heads", "quiet")}


def test_html_without_article(spark):
    """The main slot is the one whose text changes; the constant text stands elsewhere."""
    page = "<html><body><div class='top'>Welcome to the site, dear reader of our pages</div><div class='box'><div class='inner'><p>{0}</p><p>{1}</p></div></div><div class='bottom'>All rights are ours</div></body></html>"
    rng = random.Random(5)
    pages = [(k, "http://h.example.com/", page.format(html.escape(prose(rng, 60, 10**6)), prose(rng, 40, 10**6))) for k in range(8)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k, _, src in pages:
        assert got[k] == "\n".join(re.findall(r"<p>(.*?)</p>", src))


def test_warc_derivatives(spark, tmp_path):
    pages = [(1, "http://a.example.com/", "<html><body><p>Hi &amp; bye<p>there</body></html>"), (2, None, None), (3, "http://b.example.com/é", "")]
    made = warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))
    out = warc.derivatives(made).collect()
    assert len(out) == 6
    by_id = {r.record_id: r for r in made.collect()}
    assert len({r.record_id for r in out} | set(by_id)) == 9
    for r in out:
        source = by_id[r.refers_to]
        assert (r.target_uri, r.refers_to_uri, r.refers_to_date) == (source.target_uri, source.target_uri, source.date)
        assert r.content_length == len(r.block)
        assert r.block_digest == warc.digest(bytes(r.block))
        if r.type == "metadata":
            fields = dict(x.split(": ", 1) for x in bytes(r.block).decode().strip().split("\r\n"))
            assert fields["source-payload-digest"] == source.payload_digest and fields["source-block-digest"] == source.block_digest
            assert fields["source-header-content-type"] == "text/html; charset=utf-8"
            assert fields["conversion-id"] == r.concurrent_to and r.concurrent_to in {x.record_id for x in out if x.type == "conversion"}
    assert [bytes(r.block).decode() for r in out if r.type == "conversion"] == ["Hi & bye\nthere", "", ""]
    warc.write_warc(made.unionByName(warc.derivatives(made)), str(tmp_path / "w"))
    back = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert len(back) == 9
    for r in (*out, *by_id.values()):
        assert bytes(back[r.record_id].block) == bytes(r.block) and back[r.record_id].refers_to == r.refers_to
        assert back[r.record_id].block_digest == r.block_digest


def test_warc_reader_stops_at_damage():
    one = warc.write_record(warc.response("1", "u", b"x", "2024-01-01T00:00:00Z"))
    assert len(list(warc.read_records(one + one))) == 2
    assert list(warc.read_records(b"nonsense")) == [] and list(warc.read_records(one[:20])) == []
    assert list(warc.read_records(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")) == []


def test_warc_damaged_members_and_coded_bodies():
    import gzip
    import zlib

    one, two = (warc.write_record(warc.response(k, f"http://a/{k}", b"<p>x</p>", "d")) for k in "ab")
    for bad in (one + two[:-9], one + b"\x1f\x8bjunk that is no member", one + b"trailing"):
        assert [r["target_uri"] for r in warc.read_records(bad)] == ["http://a/a"] or bad.startswith(one + two[:20])
        assert [r["type"] for r in warc.read_records(bad, errors=True)][-1] == "error"
    assert [r["type"] for r in warc.read_records(one + two + b"\0" * 9, errors=True)] == ["response"] * 2
    assert [r["type"] for r in warc.read_records(one + two[: len(two) // 2], errors=True)] == ["response", "error"]
    body = "<p>h\u00e9llo</p>".encode()
    chunked = lambda x: b"".join(b"%x\r\n%s\r\n" % (len(x[k : k + 7]), x[k : k + 7]) for k in range(0, len(x), 7)) + b"0\r\n\r\n"
    head = lambda *h: "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html", *h, "", ""]).encode()
    for block in (
        head() + body, head("Transfer-Encoding: chunked") + chunked(body), head("Content-Encoding: gzip") + gzip.compress(body), head("Content-Encoding: deflate") + zlib.compress(body),
        head("Content-Encoding: gzip", "Transfer-Encoding: chunked") + chunked(gzip.compress(body)), head("Content-Encoding: gzip") + body,
    ):
        assert warc.http(block)[2] == body


def test_warc_ranges(spark, tmp_path):
    """Files are read in ranges that cut records anywhere; damaged members cost themselves only."""
    import gzip

    rng = random.Random(4)
    made = [warc.response(str(k), f"http://a/{k}", rng.randbytes(rng.randrange(3000)) + b"\x1f\x8b\x08", "d") for k in range(60)]
    packed = [warc.write_record(r) for r in made]
    plain = b"".join(gzip.decompress(x) for x in packed)
    bad = bytearray(b"".join(packed[:3]))
    bad[len(packed[0]) + 40 : len(packed[0]) + 60] = bytes(20)
    files = {"many": b"".join(packed), "one": gzip.compress(plain), "plain": plain, "bad": bytes(bad), "length": b"WARC/1.1\r\nContent-Length: many\r\n\r\n", "negative": b"WARC/1.1\r\nContent-Length: -4\r\n\r\nabcd", "empty": b"", "odd": b"no record at all"}
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data)
    want = sorted((r["target_uri"], r["block"]) for r in made)
    for name in ("many", "one", "plain"):
        got = warc.read_warc(spark, str(tmp_path / name), split_bytes=1000).collect()
        assert sorted((r.target_uri, bytes(r.block)) for r in got) == want, name
    kinds = {name: sorted(r.type for r in warc.read_warc(spark, str(tmp_path / name), split_bytes=500).collect()) for name in files}
    assert kinds["bad"] == ["error", "response", "response"] and kinds["empty"] == []
    assert [kinds[k] for k in ("length", "negative", "odd")] == [["error"]] * 3
    for name, data in files.items():
        assert [r["type"] for r in warc.read_records(data)] == ["response"] * {"many": 60, "one": 60, "plain": 60, "bad": 1}.get(name, 0)


def test_warc_repeated_headers():
    r = warc._row(type="response", record_id="<a>", target_uri="u", date="d", block=b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nLink: a\r\nLink: b\r\n\r\nx", payload_digest=None)
    meta, text = warc.derive(r)
    assert meta["headers"]["Link"] == "a, b" and meta["block"].count(b"source-header-link: ") == 2 and text["block"] == b"x"


def test_chat_links(spark):
    call = '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":1.0,"b":"é"}},{"id":"b","function":{"name":"f","arguments":"{\\"y\\":2}"}}]}'
    rows = [
        (1, 0, "user", "hi"), (1, 3, "assistant", call), (1, 2, "tool", '{"tool_call_id":"b","content":"r"}'), (1, 4, "tool", '{"tool_call_id":"zz","content":"r"}'),
        (1, 5, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":2}}]}'), (2, 1, "tool", '{"tool_call_id":"a"}'), (None, None, None, None), (3, 0, "assistant", "{not json"), (3, 1, "tool", "x" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash")).withColumn("links", F.lit(1))
    got = chat.format_chat(df, {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}).collect()
    at = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert at[1, 3].message == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"b":"é","x":1},"id":"a","name":"f"},{"arguments":{"y":2},"id":"b","name":"f","violations":["$.x: missing"]}]}'
    assert (at[1, 3].status, at[1, 3].n_invalid, at[1, 5].status, at[1, 4].status, at[2, 1].status) == ("invalid_arguments", 1, "duplicate_id", "orphan", "orphan")
    assert (at[1, 2].links.turn, at[1, 2].links.k) == (3, 1) and at[1, 2].order_key > at[1, 3].order_key
    order = [t for _, t in sorted((r.order_key, r.turn) for r in got if r.conv_id == 1)]
    assert order == [0, 3, 2, 4, 5]


def test_chat_without_turn_links_with_nothing(spark):
    call, result = '{"tool_calls":[{"id":"a","name":"f","arguments":{}}]}', '{"tool_call_id":"a","content":"r"}'
    rows = [(1, 1, "assistant", call), (1, None, "tool", result), (1, None, "assistant", call), (1, 2, "tool", result), (None, 3, "tool", result), (None, 3, "assistant", call)]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    seen = {(r.conv_id, r.turn, r.role): (r.status, r.links and r.links.turn) for r in got}
    assert len(got) == len(rows)
    assert seen == {
        (1, 1, "assistant"): ("ok", None), (1, None, "tool"): ("orphan", None), (1, None, "assistant"): ("ok", None), (1, 2, "tool"): ("ok", 1), (None, 3, "tool"): ("orphan", None), (None, 3, "assistant"): ("ok", None),
    }


def test_chat_checks_arguments(spark):
    f = '{"name":"f","parameters":{"type":"object","required":["x"],"properties":{"x":{"type":"integer"},"any":true}}}'
    one = lambda name, args, at="a": json.dumps({"tool_calls": [{"id": at, "name": name, "arguments": args}]})
    rows = [
        (1, 0, "system", f'{{"tools":[{{"type":"function","function":{f}}},{{"name":"g"}},{{"name":"bad","parameters":{{"required":5}}}},7]}}'), (1, 9, "system", '{"tools":[{"name":"f","parameters":false}]}'),
        (1, 1, "assistant", one("f", {"x": 1, "any": []})), (1, 2, "assistant", one("f", {"x": "1"}, "b")), (1, 3, "assistant", one("f", "{x", "c")), (1, 4, "assistant", one("h", {}, "d")), (1, 5, "assistant", one("g", {"z": 1}, "e")),
        (1, 6, "assistant", one("bad", {}, "f")), (1, 7, "assistant", one(None, {}, "g")), (1, 8, "tool", '{"tool_call_id":"b","content":"r"}'),
        (2, 0, "system", "You call f."), (2, 1, "assistant", one("f", {"x": "1"})), (2, 2, "assistant", one("f", "{x", "b")),
        (3, 0, "system", '{"tools":[]}'), (3, 1, "assistant", one("f", {"x": 1})), (4, 0, "system", '{"tools":[{"name":"f","input_schema":{"maxProperties":0}}]}'), (4, 1, "assistant", one("f", {"x": 1})), (None, 0, "assistant", one("f", "{x")),
    ]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    bad = {(r.conv_id, r.turn): json.loads(r.message)["tool_calls"][0]["violations"] for r in got if r.status == "invalid_arguments"}
    assert bad == {
        (1, 2): ["$.x: not integer"], (1, 3): ["$: not JSON"], (1, 4): ["no such tool"], (1, 6): ["$: schema can't be used"], (1, 7): ["no such tool"],
        (2, 2): ["$: not JSON"], (3, 1): ["no such tool"], (4, 1): ["$: maxProperties 0"], (None, 0): ["$: not JSON"],
    }
    assert all(r.n_invalid == ((r.conv_id, r.turn) in bad) for r in got)
    assert [(r.status, r.links.turn) for r in got if r.role == "tool"] == [("ok", 2)]


def test_json_schema():
    s = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 3}, "b": {"type": "array", "items": {"enum": ["x", 1]}, "maxItems": 2}, "c": {"type": "string", "pattern": "^q", "minLength": 2}}}
    assert chat.violations({"a": 3, "b": ["x"], "c": "qq"}, s) == [] and chat.violations({"a": None}, s) == []
    for bad in ({}, {"a": 2}, {"a": True}, {"a": 3, "b": ["x", "x", "x"]}, {"a": 3, "b": ["y"]}, {"a": 3, "c": "z"}, {"a": 3, "c": "q"}, {"a": 3, "d": 1}, []):
        assert chat.violations(bad, s), bad
    assert chat.canonical({"b": 1.0, "a": [float("nan"), "é\n", True]}) == '{"a":[null,"é\\n",true],"b":1}'


def test_json_schema_keywords():
    """Pairs of a schema with values that fit it and values that don't."""
    tree = {"$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}, "v": {"type": "integer"}}, "required": ["v"]}}, "$ref": "#/$defs/n"}
    cases = [
        ({"multipleOf": 0.1}, [0.3, 1, 0], [0.25]), ({"enum": [1, "a", [1]]}, [1, 1.0, [1.0]], [True, "1", [True]]), ({"const": 0}, [0, 0.0], [False, None]), ({"not": {"type": "string"}}, [1], ["a"]),
        ({"prefixItems": [{"type": "integer"}, {"type": "string"}], "items": False}, [[1, "a"], [1], []], [["a"], [1, "a", 2]]), ({"patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": False}, [{"n_a": 1}], [{"n_a": "1"}, {"x": 1}]),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, [{"a": 1, "b": 1}, {"c": 1}], [{"a": 1}, {}]), ({"contains": {"const": 1}, "maxContains": 1}, [[1, 2]], [[], [2], [1, 1]]),
        ({"propertyNames": {"maxLength": 1}}, [{"a": 1}], [{"ab": 1}]), ({"dependentRequired": {"a": ["b"]}}, [{}, {"a": 1, "b": 2}], [{"a": 1}]), (tree, [{"v": 1, "next": {"v": 2}}], [{"v": 1, "next": {}}, {"next": {"v": 1}}]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 3}]}, [1, 3.5], [4, 2.5]), ({"uniqueItems": True}, [[1, True, "1"]], [[1, 1.0]]), (True, [1], []), (False, [], [1]),
    ]
    for schema, good, bad in cases:
        assert not any(chat.violations(v, schema) for v in good), schema
        assert all(chat.violations(v, schema) for v in bad), schema


def test_chat_odd_json(spark):
    """Nothing that a message can say stops the job."""
    deep = "[" * 1500 + "]" * 1500
    schema = lambda x: json.dumps({"tools": [{"name": "f", "parameters": x}]})
    one = lambda args: '{"tool_calls":[{"id":"a","name":"f","arguments":%s}]}' % args
    cases = [
        ({}, one('{"x":"\\ud800"}'), "ok"), ({}, one(f'{{"x":{deep}}}'), "ok"), ({}, one(json.dumps(deep)), "invalid_arguments"), ({"properties": {"x": {"multipleOf": 0}}}, one('{"x":1}'), "invalid_arguments"),
        ({"properties": {"x": {"pattern": "("}}}, one('{"x":"a"}'), "invalid_arguments"), ({"$ref": "#"}, one('{"x":1}'), "invalid_arguments"), ({"$ref": "http://other"}, one("{}"), "invalid_arguments"), ({}, one("NaN"), "ok"), ({}, '{"tool_calls":[{"id":{"a":[1]},"name":7,"arguments":null},3,null]}', "invalid_arguments"),
        ({}, one('"{\\"x\\":1e400}"'), "ok"), ({"minLength": "a"}, one('"\\"s\\""'), "invalid_arguments"), ({}, '{"tool_calls":{}}', "ok"),
    ]
    rows = [m for k, (s, call, _) in enumerate(cases) for m in ((k, 0, "system", schema(s)), (k, 1, "assistant", call), (k, 1, "assistant", call), (k, 2, "tool", '{"tool_call_id":"a"}'))]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for k, (_, call, want) in enumerate(cases):
        assert [r.status for r in got if r.conv_id == k and r.role == "assistant"] == [want] * 2, call
    message = next(r.message for r in got if r.conv_id == 0 and r.turn == 1)
    assert "\ufffd" in message and json.loads(message)


def test_chat_query_links(spark):
    """The query's replayed conversations have every status, and results before their calls are sorted behind them."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(14) for t in range(8)]
    made = chat.replayed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.format_chat(made).collect()
    assert {r.status for r in got} == {"ok", "invalid_arguments", "duplicate_id", "orphan"}
    moved = [r for r in got if r.links and r.links.turn >= r.turn]
    assert moved
    for r in moved:
        call = next(x for x in got if (x.conv_id, x.turn, x.role) == (r.conv_id, r.links.turn, "assistant"))
        assert call.order_key < r.order_key


def test_text_kernels_match_python():
    from stratapack.llm.common import Words

    texts = ["a b", "", None, " x\n\ny ", "Ab ab", "z" * 10_000, "é ü"]
    w = Words(*text_buffers(pa.array(texts)))
    h = w.hashes(lower=True)
    want = [x for t in texts for x in words((t or "").translate(A_Z))]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)] == [x for t in texts for x in words(t)]
    for i, j in itertools.combinations(range(len(want)), 2):
        assert (h[i] == h[j]) == (want[i] == want[j])
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_without_broadcasts(spark, corpus, monkeypatch):
    """The ways that larger lists take give the same results."""
    _, docs = corpus
    docs = docs.where("text is not null").limit(60).cache()
    pages = spark.createDataFrame([(k, f"http://h{k % 4}.example.com/", PAGE.format(nav=f"n{k}", title="t", body=f"b{k}")) for k in range(12)], "page_id long, url string, html string")
    few = [sorted(map(str, near_dedup.drop_near_duplicates(docs).collect())), sorted(map(str, html_extraction.extract(pages).collect()))]
    for module in (near_dedup, html_extraction):
        monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    assert few == [sorted(map(str, near_dedup.drop_near_duplicates(docs).collect())), sorted(map(str, html_extraction.extract(pages).collect()))]
