"""The corpus pipeline as a chain, and whole predictions of the language network, against brute force."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from stratapack.llm import language_id, queries

from .test_operators import A_Z, components, edited, prose, shingles, words

DATA = "/root/testdata/sf0.001"


def kept_lines(texts):
    """The line stage: keys of 20 code points or more in three documents stay in the largest id only."""
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda x: x.strip(strip).translate(A_Z)
    holders = collections.defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    return {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i) for i, t in texts.items()}


def contaminated(text, items):
    w = words(text.lower())
    for item in items:
        need = words(item.lower())
        n = min(len(need), len(w))
        a = collections.Counter(shingles(need))
        for s in range(len(w) - n + 1 if n else 0):
            b = collections.Counter(shingles(w[s : s + n]))
            if 4 * (a & b).total() >= 3 * (a | b).total():
                return True
    return False


def test_chain_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    items = [prose(rng, n) for n in (12, 30, 60)] + ["just four words here"]
    line = "A line that many documents share, word for word"
    texts = {}
    for k in range(40):
        body = prose(rng, rng.randrange(20, 120), 5000)
        texts[k] = "\n".join([body, line, prose(rng, 6)] if k % 4 == 0 else [body])
    for k in range(40, 60):
        texts[k] = edited(rng, texts[k - 40], k % 5)
    for k, item in enumerate(items):
        texts[60 + k] = f"{prose(rng, 15)} {item.upper() if k % 2 else edited(rng, item, 1)} {prose(rng, 9)}"
    texts[70], texts[71], texts[72] = "12 34 -- 56", line, f"  {line.upper()} "
    rows = [(k, t, "en" if k % 2 else "fr", "s", len(t)) for k, t in texts.items()]
    docs = spark.createDataFrame([*rows, (80, None, None, None, None), (81, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = kept_lines({k: t for k, t in texts.items() if k != 70})
    roots = components({k: frozenset(shingles(words(t.translate(A_Z)))) for k, t in want.items()})
    want = {k: t for k, t in want.items() if roots[k] == k and not contaminated(t, items)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.decoded for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(want[r.doc_id]) and r.n_pieces == len(r.ids) for r in got)
    assert 30 < len(want) < len(texts) - 10


def test_whole_predictions(spark):
    """Every window of a text, weighted by its bytes, through the convolutions written out."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(("the thing is", "été où ça") if k % 2 else ("sch ung über", "la de los")) for _ in range(rng.randrange(1, 150))), f"l{k % 2}") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, max_windows=200)

    def probabilities(window):
        hidden = []
        for w in language_id.WIDTHS:
            e = model.p["E"][window]
            z = np.stack([e[i : i + w].ravel() @ model.p[f"W{w}"] for i in range(len(window) - w + 1)]) + model.p[f"B{w}"]
            hidden.append(np.maximum(z.max(0), 0))
        return language_id._softmax((np.concatenate(hidden) @ model.p["V"] + model.p["C"])[None])[0]

    for r in language_id.identify(docs, model).collect():
        data, total = r.text.encode(), 0
        for k in range(0, len(data), language_id.LENGTH):
            part = data[k : k + language_id.LENGTH]
            total = total + probabilities(np.frombuffer(part.ljust(language_id.LENGTH, b"\0"), np.uint8)) * len(part) / len(data)
        assert r.lang_pred == model.langs[int(total.argmax())] and abs(r.score - total.max()) < 1e-3


def test_language_query_on_held_out_documents(spark):
    import os

    if not os.path.isdir(DATA):
        pytest.skip("the tables are not here")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in queries.QUERIES["op6_language_id"](spark, DATA).collect() if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9
