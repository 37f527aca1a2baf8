"""The subpackage's queries against their SQL at the smallest scale, and the shape of the others."""

import os

import pytest

import __spark_entry__ as entry
from stratapack.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    place = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)


def test_contract_columns(spark):
    want = {
        "op2_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op3_html_extraction": ["page_id", "url", "text", "n_chars"],
        "op4_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
        "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op7_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    for name, cols in want.items():
        df = queries.QUERIES[name](spark, DATA)
        assert df.columns == cols
        kinds = dict(df.dtypes)
        assert all(kinds[c] == "bigint" for c in cols if c.endswith("_id") or c.startswith("n_") and c != "n_removed")
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.QUERIES}
