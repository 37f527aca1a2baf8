"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns all documents that it keeps; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import delete, free_name, shared_folder, table
from stratapack.llm.decontamination import match_benchmark
from stratapack.llm.language_id import UNKNOWN, held_out, identify, train
from stratapack.llm.line_dedup import dedup_lines
from stratapack.llm.near_dedup import drop_near_duplicates
from stratapack.llm.sentencepiece_nbest import encode

#: Documents whose language gets less than this probability go; 'und' has 0.  Four languages give 0.25 by chance.
MIN_SCORE = 0.3


def _set_aside(docs: DataFrame, made: list[str]) -> tuple[DataFrame, list]:
    """`docs` without columns that are named like those that an operator makes, and what gives its columns back from the operator's result."""
    odd: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in made:
            odd[c] = free_name(c, [*docs.columns, *odd.values(), *made])
    return docs.withColumnsRenamed(odd), [F.col(f"`{odd.get(c, c)}`").alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those that fit no language; a missing lang is filled in.

    The network learns from the labelled texts of `docs` that aren't held out; without any all documents stay.  Null and empty texts have no letter and
    go.  Very long texts are judged whole.  Equal texts are judged alike, repeated rows and rows without id too.  Further columns pass unchanged, whatever their names.  An empty table gives
    an empty table.
    """
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    if model is None:
        return docs
    own, back = _set_aside(docs, ["lang_pred", "score"])
    found = identify(own, model)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every document stays, and n_chars is set to the length of its new text.

    A null text becomes '', as does one that loses all lines.  Very long texts are read whole.  Rows of one id count as one document, and all rows without id too; repeated rows are treated
    alike.  Further columns pass unchanged, whatever their names.  An empty table gives an empty table.
    """
    own, back = _set_aside(docs, ["n_lines", "n_dropped"])
    return dedup_lines(own).withColumn("n_chars", F.length("text").cast("bigint")).select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the rows with the smallest id.

    Null and empty texts are near nothing and stay; so do rows without id.  Very long texts are compared whole.  Rows of one id are judged each by its text, equal rows alike.  All columns pass
    unchanged, whatever their names.  An empty table gives an empty table.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts and items match nothing.  Very long texts are searched whole.  Repeated rows are judged alike, and so are rows without id.  All columns pass unchanged, whatever their
    names.  An empty table gives an empty table, an empty benchmark drops nothing.
    """
    own, back = _set_aside(docs, ["matches"])
    return match_benchmark(own, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select(*back)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, and decodes the ids again: doc_id, lang, source, n_chars, n_pieces, score, ids and decoded of every row.

    Null and empty texts have no ids and decode to ''.  Very long texts are encoded whole.  Equal rows give equal results.  Further columns are left out, whatever their names.  An empty
    table gives an empty table.
    """
    made = encode(docs.select("doc_id", "text", "lang", "source", "n_chars"), decoded="decoded")
    return made.select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_pieces"), F.element_at("nbest", 1)["score"].alias("score"), "ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL has no trained network and no lattice search; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read again, and its input is deleted when the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                delete(spark, before)
            before = f"{folder}/{name}"
    return docs
