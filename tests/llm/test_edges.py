"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratapack.llm import chat, decontamination, html_extraction, language_id, line_dedup, near_dedup, quality_rules, sentencepiece_nbest, substring_dedup, warc

LONG = "lorem ipsum dolor sit amet consectetur " * 30_000
ROWS = [
    (1, "A plain text of some words about nothing in particular, long enough to be kept by rules that ask for twenty words at least.", "en", "a", 10),
    (1, "A plain text of some words about nothing in particular, long enough to be kept by rules that ask for twenty words at least.", "en", "a", 10),
    (2, None, None, None, None), (3, "", "en", "", 0), (None, "text without id and a few words more", "fr", "b", 1), (None, None, None, None, None), (4, LONG, "en", "c", None), (5, "\n\n \t", None, "c", 3), (6, "word", "de", "c", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "block", "rest", "bucket", "blob", "kind", "n_words", "n_removed", "n_lines", "n_dropped", "matches", "ids", "nbest", "decoded", "lang_pred", "score", "node", "signature", "kept", "label", "host", "__host", "main", "base_failed", "n_symbols", "rejected_by", "word_chars"]


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    odd = docs.withColumns({c: F.lit("clash") for c in CLASH if c not in docs.columns})
    bench = spark.createDataFrame([(1, "lorem ipsum dolor sit amet consectetur lorem ipsum"), (None, None), (2, "")], "item_id long, text string")
    return docs, odd, spark.createDataFrame([], SCHEMA), bench


def operators(spark, bench):
    model = sentencepiece_nbest.Model()
    return {
        "substring": substring_dedup.dedup_substrings,
        "lines": line_dedup.dedup_lines,
        "near": near_dedup.drop_near_duplicates,
        "components": near_dedup.near_components,
        "benchmark": lambda d: decontamination.match_benchmark(d, bench),
        "encode": lambda d: sentencepiece_nbest.decode(sentencepiece_nbest.encode(d, model=model), model=model),
        "language": lambda d: language_id.identify(d, language_id.train(d)),
        "quality": quality_rules.judge,
    }


@pytest.mark.parametrize("name", ["substring", "lines", "near", "components", "benchmark", "encode", "language", "quality"])
def test_operator(spark, frames, name):
    docs, odd, empty, bench = frames
    op = operators(spark, bench)[name]
    plain, clashing, none = op(docs), op(odd), op(empty)
    got = plain.collect()
    if name != "near":
        assert len(got) == len(ROWS)
    assert none.count() == 0 and none.columns == plain.columns
    assert clashing.count() == len(got)
    if name != "components":
        assert set(odd.columns) <= set(clashing.columns)
        made = set(plain.columns) - set(docs.columns)
        assert all(r[c] == "clash" for r in clashing.collect() for c in CLASH if c not in made)


def test_defined_results(spark, frames):
    docs, _, _, bench = frames
    near = sorted((str(r.id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_components(docs).collect())
    assert near == sorted([("1", 20, "1", True)] * 2 + [("2", 0, "2", True), ("3", 0, "3", True), ("4", 6, "4", True), ("5", 0, "5", True), ("6", 1, "6", True), ("None", 4, "None", True), ("None", 0, "None", True)])
    removed = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert removed == {(1, 24, 0), (2, 0, 0), (3, 0, 0), (4, 180_000, 180_000), (5, 0, 0), (6, 1, 0), (None, 8, 0), (None, 0, 0)}
    lines = {(r.doc_id, r.n_lines, r.n_dropped, r.text == "") for r in line_dedup.dedup_lines(docs).collect()}
    assert lines == {(1, 1, 0, False), (2, 1, 0, True), (3, 1, 0, True), (4, 1, 0, False), (5, 3, 0, False), (6, 1, 0, False), (None, 1, 0, False), (None, 1, 0, True)}
    found = {r.doc_id: [m.item_id for m in r.matches] for r in decontamination.match_benchmark(docs, bench).where("doc_id is not null").collect()}
    assert found == {1: [], 2: [], 3: [], 4: [1], 5: [], 6: []}
    kept = {r.doc_id: r.rejected_by for r in quality_rules.judge(docs).where("doc_id is not null").collect()}
    assert kept == {1: None, 2: "base", 3: "base", 4: "base", 5: "base", 6: "base"}


def test_no_training_rows(spark, frames):
    docs = frames[0]
    assert language_id.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, None).collect()} == {("und", 0.0)}


def test_pages_and_messages(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com", "<p>x</p>"), (1, "http://a.example.com", "<p>x</p>"), (None, None, None), (2, "", ""), (3, "http://b.example.com", "<div>" * 3000 + LONG)], "page_id long, url string, html string")
    mapped = pages.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert html_extraction.extract(mapped).count() == 5
    odd = pages.withColumns({c: F.lit(1) for c in ("text", "__host", "__main", "host", "record_id", "type", "block")})
    for df in (pages, odd):
        out = html_extraction.extract(df)
        assert out.count() == 5 and set(df.columns) <= set(out.columns)
        assert warc.derivatives(warc.responses(df)).count() == 10
    none = spark.createDataFrame([], pages.schema)
    assert html_extraction.extract(none).count() == 0 and warc.derivatives(warc.responses(none)).count() == 0
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    records = warc.responses(pages).withColumn("block", F.lit(None).cast("binary")).withColumn("block_digest", F.lit(None).cast("string"))
    assert warc.derivatives(records).count() == 10


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, frames, tmp_path, k):
    docs, _, empty, bench = frames
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    if k < 4:
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    got = [r.doc_id for r in out.collect()]
    assert got.count(1) == 2
    want = {"language_id": 5, "line_dedup": 9, "near_dedup": 9, "decontamination": 8, "sentencepiece": 9}
    assert len(got) == want[name]
    assert stage(spark, empty, str(tmp_path)).count() == 0
    odd = docs.withColumns({c: F.lit(f"own {c}") for c in [*CLASH, "Matches", "n_pieces", "__id0"] if c.lower() not in [x.lower() for x in docs.columns] and c != "matches"})
    out = stage(spark, odd, str(tmp_path))
    if k < 4:
        assert out.columns == odd.columns and all(r[c] == f"own {c}" for r in out.collect() for c in odd.columns if c not in docs.columns)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, got))


def test_language_stage_without_labels_keeps_all(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"a text of some words {k}", None, "s", 9) for k in range(5)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()) == list(range(5))


def test_run(spark, tmp_path):
    rows = [(k, f"doc{k} " + " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(40)), "en" if k % 2 else "fr", "s", 9) for k in range(20)] + [(50, "12 34", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(60).cast("long"))).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(rows[5][1].split()[3:33]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == [k for k in range(20) if k != 5]
    assert all(r.decoded == rows[r.doc_id][1] for r in got.collect())
