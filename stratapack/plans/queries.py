"""Registered queries of the library and, where SQL can state the result, their DuckDB SQL."""

from __future__ import annotations

import hashlib
import itertools
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.codecs import CODECS
from ..operators import analysis, pipeline
from ..functions.crypto import Digest
from ..sources import archives, container
from ..sources.folders import cut, delete, mounted, shared_folder, spread
from ..streaming import ingest as streaming
from ..streaming import state
from . import jobs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CHUNK = 4096
#: Key of the queries that encrypt; a fixed salt and few rounds keep them repeatable and quick.
SECRET = ("correct horse battery staple", bytes(range(16)), 1000)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.as_files(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


BYTES = "SELECT doc_id, generate_subscripts(b, 1) AS i, unnest(b) AS b FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents)"

# --- inspection ---------------------------------------------------------------------------------


@query(f"SELECT ('0x' || b)::INTEGER AS byte, count(*)::BIGINT AS n FROM ({BYTES}) GROUP BY b")
def byte_histogram(spark, sf_dir):
    return analysis.byte_counts(documents(spark, sf_dir))


@query(
    f"""WITH h AS (SELECT doc_id, b, count(*) AS n FROM ({BYTES}) GROUP BY doc_id, b), t AS (SELECT doc_id, sum(n) AS total FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(max(total), 0)::BIGINT AS n_bytes, (round(coalesce(-sum(n / total * log2(n / total)), 0), 6) + 0)::DOUBLE AS entropy
FROM documents d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) GROUP BY d.doc_id"""
)
def byte_entropy(spark, sf_dir):
    return analysis.byte_stats(documents(spark, sf_dir)).select(F.col("file_id").alias("doc_id"), "n_bytes", (F.round("entropy", 6) + 0).alias("entropy"))


RUNS = f"""SELECT doc_id, g, count(*) AS n FROM (
  SELECT doc_id, i, sum(edge) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
    SELECT doc_id, i, (b IS DISTINCT FROM lag(b) OVER (PARTITION BY doc_id ORDER BY i))::INT AS edge FROM ({BYTES}))) GROUP BY doc_id, g"""


@query(
    f"""SELECT d.doc_id, (coalesce(pairs, 0) * 2 + greatest(1, ceil(length(bin(coalesce(octet_length(encode(d.text)), 0))) / 7)))::BIGINT AS rle_bytes
FROM documents d LEFT JOIN (SELECT doc_id, sum(ceil(n / 255)) AS pairs FROM ({RUNS}) GROUP BY doc_id) r USING (doc_id)"""
)
def rle_size(spark, sf_dir):
    s = analysis.byte_stats(documents(spark, sf_dir))
    return s.select(F.col("file_id").alias("doc_id"), (F.col("rle_pairs") * 2 + analysis.varint_size(F.col("n_bytes"))).alias("rle_bytes"))


def _stride(k: int) -> str:
    return f"""SELECT doc_id, {k} AS stride, round(coalesce(-sum(n / total * log2(n / total)), 0), 6) + 0 AS e FROM (
  SELECT doc_id, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM (
    SELECT doc_id, (b - coalesce(lag(b, {k}) OVER (PARTITION BY doc_id ORDER BY i), 0) + 256) % 256 AS v FROM v) GROUP BY doc_id, v) GROUP BY doc_id"""


@query(
    f"""WITH v AS (SELECT doc_id, i, ('0x' || b)::INTEGER AS b FROM ({BYTES})), s AS ({_stride(1)} UNION ALL {_stride(2)} UNION ALL {_stride(4)})
SELECT doc_id, arg_min(stride, (e, stride))::INTEGER AS stride, min(e)::DOUBLE AS stride_entropy FROM s GROUP BY doc_id"""
)
def delta_stride(spark, sf_dir):
    return analysis.byte_stats(documents(spark, sf_dir)).select(F.col("file_id").alias("doc_id"), "stride", "stride_entropy")


@query(
    """SELECT page_id, CASE WHEN NOT coalesce(regexp_matches(url, '\\.html?$'), false) AND coalesce(html, '') = '' THEN 'Binary' ELSE 'Text' END AS type,
CASE WHEN regexp_matches(url, '\\.html?$') THEN 'html' WHEN coalesce(html, '') = '' THEN 'binary' ELSE 'text' END AS type_detail FROM pages"""
)
def type_detect(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    out = exprs.detect_types(pages.select("page_id", F.col("url").alias("path"), F.substring(F.col("html").cast("binary"), 1, 4096).alias("head")))
    return out.select("page_id", "type", "type_detail")


@query(
    """SELECT ext, count(*)::BIGINT AS n, max(CASE WHEN ext IN ('html', 'htm') THEN 'Text' END) AS type FROM (
  SELECT CASE WHEN contains(url, '.') THEN lower(regexp_extract(url, '[^.]*$')) ELSE '' END AS ext FROM pages) GROUP BY ext"""
)
def ext_lookup(spark, sf_dir):
    ext = table(spark, sf_dir, "pages").select(exprs.extension(F.col("url")).alias("ext"))
    return ext.groupBy("ext").agg(F.count("*").alias("n")).join(F.broadcast(exprs.extensions(spark)), "ext", "left").select("ext", "n", F.col("ext_type").alias("type"))


HEADS = "CASE doc_id % 5 WHEN 0 THEN 'FFD8FF' WHEN 1 THEN '1F8B' WHEN 2 THEN '25504446' WHEN 3 THEN '504B0304' ELSE '' END"


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'gzip' WHEN 2 THEN 'pdf' WHEN 3 THEN 'zip' ELSE 'text' END AS type_detail,
doc_id % 5 IN (0, 1, 3) AS dense, doc_id % 5 IN (0, 3) AS dense_strict FROM documents"""
)
def veto_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    head = F.concat(F.unhex(F.expr(HEADS)), F.col("text").cast("binary"))
    out = exprs.detect_types(docs.select("doc_id", F.lit("noname").alias("path"), F.substring(head, 1, 4096).alias("head")))
    return out.select("doc_id", "type_detail", exprs.is_dense(F.col("type"), F.col("type_detail")).alias("dense"), exprs.is_dense(F.col("type"), F.col("type_detail"), strict=True).alias("dense_strict"))


# --- chunks -------------------------------------------------------------------------------------

CHUNKS_SQL = f"""SELECT doc_id, k::INTEGER AS chunk_id, unhex(substr(h, 1 + k * {2 * CHUNK}, {2 * CHUNK})) AS data FROM (
  SELECT doc_id, h, unnest(range(greatest(1, ceil(length(h) / {2 * CHUNK}))::BIGINT)) AS k FROM (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents))"""


@query(f"SELECT doc_id, chunk_id, octet_length(data)::BIGINT AS orig_size, sha256(data) AS sha FROM ({CHUNKS_SQL})")
def chunk_table(spark, sf_dir):
    out = pipeline.split_chunks(documents(spark, sf_dir), CHUNK)
    return out.select(F.col("file_id").alias("doc_id"), "chunk_id", F.octet_length("data").cast("bigint").alias("orig_size"), F.sha2("data", 256).alias("sha"))


@query(f"SELECT doc_id, chunk_id, coalesce(sum(octet_length(data)) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM ({CHUNKS_SQL})")
def chunk_offsets(spark, sf_dir):
    out = pipeline.split_chunks(documents(spark, sf_dir), CHUNK).withColumn("comp_size", F.octet_length("data").cast("bigint"))
    return pipeline.chunk_offsets(out.drop("data")).select(F.col("file_id").alias("doc_id"), "chunk_id", "offset")


@query(f"SELECT doc_id, true AS consistent, true AS ok, count(*)::INTEGER AS chunk_count, sum(octet_length(data))::BIGINT AS orig_size FROM ({CHUNKS_SQL}) GROUP BY doc_id")
def header_consistency(spark, sf_dir):
    chunks = pipeline.compress(documents(spark, sf_dir), "huffman", 6, CHUNK)
    made = pipeline.manifest(chunks)
    out = pipeline.verify(chunks, made, pipeline.decode_chunks(chunks)).join(made, "file_id")
    return out.select(F.col("file_id").alias("doc_id"), "consistent", "ok", "chunk_count", "orig_size")


@query(
    f"""SELECT level, algo, memory, threads, greatest(4096, CASE WHEN memory > 0 THEN least(size, memory // threads // 3) ELSE size END)::BIGINT AS chunk_size FROM (
  SELECT l::INTEGER AS level, algo, m::BIGINT AS memory, t::INTEGER AS threads, least((65536 * pow(2, l - 1))::BIGINT, 4194304, cap) AS size
  FROM (SELECT unnest(range(1, 10)) AS l), (VALUES {", ".join(f"('{c.name}', {c.block_cap})" for c in CODECS.values())}) c(algo, cap),
       (VALUES (0), (16777216), (1073741824)) m(m), (VALUES (1), (4), (16)) t(t))"""
)
def default_chunk_size(spark, sf_dir):
    codecs = spark.createDataFrame([(c.name,) for c in CODECS.values()], "algo string")
    grid = spark.range(1, 10).select(F.col("id").cast("int").alias("level")).join(F.broadcast(codecs))
    grid = grid.withColumn("memory", F.explode(F.array(*[F.lit(v).cast("bigint") for v in (0, 1 << 24, 1 << 30)]))).withColumn("threads", F.explode(F.array(F.lit(1), F.lit(4), F.lit(16))))
    return grid.withColumn("chunk_size", exprs.chunk_size(F.col("level"), exprs.block_cap(F.col("algo")), F.col("memory"), F.col("threads")))


# --- volumes ------------------------------------------------------------------------------------

PART = 2048
SIZES_SQL = "SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS size FROM documents"
VOLUMES_SQL = f"""SELECT doc_id, k::INTEGER AS num, 'doc-' || doc_id || '.' || lpad(k::VARCHAR, 3, '0') AS name, ((k - 1) * {PART})::BIGINT AS start, least(size, k * {PART})::BIGINT AS "end"
FROM (SELECT doc_id, size, unnest(range(1, greatest(1, ceil(size / {PART}))::BIGINT + 1)) AS k FROM ({SIZES_SQL}))"""


def _volumes(spark, sf_dir):
    size = F.octet_length(F.col("content")).cast("bigint")
    return archives.volumes_of(documents(spark, sf_dir).select("file_id", F.concat(F.lit("doc-"), "file_id").alias("name"), size.alias("size")), PART)


@query(VOLUMES_SQL)
def volume_split(spark, sf_dir):
    return _volumes(spark, sf_dir).select(F.col("file_id").alias("doc_id"), "num", "name", "start", "end")


@query(f'SELECT v.doc_id, o."offset"::BIGINT AS "offset", v.num FROM ({VOLUMES_SQL}) v JOIN (SELECT doc_id, size // 2 AS "offset" FROM ({SIZES_SQL})) o ON v.doc_id = o.doc_id AND o."offset" >= v.start AND o."offset" < v."end"')
def volume_lookup(spark, sf_dir):
    at = documents(spark, sf_dir).select("file_id", F.floor(F.octet_length("content") / 2).cast("bigint").alias("offset"))
    return archives.volume_lookup(_volumes(spark, sf_dir), at).select(F.col("file_id").alias("doc_id"), "offset", "num")


SERIES = "doc_id % 7 <> 3 OR num <> 2"


@query(f"""SELECT base, num, name AS path FROM (SELECT 'doc-' || doc_id AS base, num, name, row_number() OVER (PARTITION BY doc_id ORDER BY num) AS k FROM ({VOLUMES_SQL}) WHERE num < 1000 AND ({SERIES})) WHERE k = num""")
def volume_series(spark, sf_dir):
    some = _volumes(spark, sf_dir).withColumnRenamed("file_id", "doc_id").where("num < 1000").where(SERIES)
    return archives.volume_sets(some.select("name"), "name")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def split_join(spark, sf_dir):
    out = archives.join(archives.split(documents(spark, sf_dir), PART))
    return out.select(F.col("file_id").alias("doc_id"), F.sha2("content", 256).alias("sha"))


# --- choice and ranking -------------------------------------------------------------------------


def _differences(k: int) -> str:
    return f"SELECT doc_id, i, {k} AS stride, (b - coalesce(lag(b, {k}) OVER (PARTITION BY doc_id ORDER BY i), 0) + 256) % 256 AS d FROM v"


#: Bytes under store, rle and delta-rle of every document that has any.
TRIALS_SQL = f"""WITH v AS (SELECT doc_id, i, ('0x' || b)::INTEGER AS b FROM ({BYTES})), size AS (SELECT doc_id, max(i) AS n FROM v GROUP BY doc_id),
strides AS ({_stride(1)} UNION ALL {_stride(2)} UNION ALL {_stride(4)}), chosen AS (SELECT doc_id, arg_min(stride, (e, stride)) AS stride FROM strides GROUP BY doc_id),
dv AS (SELECT d.* FROM ({_differences(1)} UNION ALL {_differences(2)} UNION ALL {_differences(4)}) d JOIN chosen USING (doc_id, stride)),
r AS (SELECT doc_id, sum(ceil(n / 255)) * 2 AS body FROM ({RUNS}) GROUP BY doc_id),
dr AS (SELECT doc_id, sum(ceil(n / 255)) * 2 AS body FROM (
  SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, i, sum(edge) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
    SELECT doc_id, i, (d IS DISTINCT FROM lag(d) OVER (PARTITION BY doc_id ORDER BY i))::INT AS edge FROM dv)) GROUP BY doc_id, g) GROUP BY doc_id),
t AS (SELECT doc_id, 'store' AS algo, 1 AS ord, n::DOUBLE AS out, n, 3000 AS speed FROM size
      UNION ALL SELECT doc_id, 'rle', 0, body + ceil(length(bin(n)) / 7), n, 900 FROM r JOIN size USING (doc_id)
      UNION ALL SELECT doc_id, 'delta-rle', 2, body + 1 + ceil(length(bin(n)) / 7), n, 400 FROM dr JOIN size USING (doc_id))"""


@query(
    f"""{TRIALS_SQL}, best AS (SELECT doc_id, min(out / n) AS best FROM t GROUP BY doc_id)
SELECT doc_id, arg_min(algo, (-speed, out / n, ord)) AS algo, round(arg_min(out / n, (-speed, out / n, ord)), 6)::DOUBLE AS ratio, round(min(best), 6)::DOUBLE AS best_ratio
FROM t JOIN best USING (doc_id) WHERE out / n <= best * 1.15 GROUP BY doc_id
UNION ALL SELECT doc_id, 'store', 1.0, 1.0 FROM documents WHERE coalesce(text, '') = ''"""
)
def select_codec(spark, sf_dir):
    """The choice among the codecs whose sizes SQL can state; an empty document is stored."""
    s = analysis.byte_stats(documents(spark, sf_dir))
    n, head = F.col("n_bytes"), analysis.varint_size(F.col("n_bytes"))
    trial = lambda name, ord_, out: F.struct(F.lit(name).alias("algo"), F.lit(ord_).alias("ord"), (out / n).alias("ratio"))
    trials = F.array(trial("store", 1, n), trial("rle", 0, F.col("rle_pairs") * 2 + head), trial("delta-rle", 2, F.col("delta_pairs") * 2 + head + 1))
    x = s.select("file_id", F.when(n > 0, analysis.chosen(F.when(n > 0, trials), 1.15)).alias("x"))
    return x.select(F.col("file_id").alias("doc_id"), F.coalesce("x.algo", F.lit("store")).alias("algo"), F.coalesce(F.round("x.ratio", 6), F.lit(1.0)).alias("ratio"), F.coalesce(F.round("x.best_ratio", 6), F.lit(1.0)).alias("best_ratio"))


@query(
    f"""{TRIALS_SQL} SELECT algo, in_bytes, out_bytes, row_number() OVER (ORDER BY out_bytes / in_bytes, algo)::INTEGER AS rank FROM (SELECT algo, sum(n)::BIGINT AS in_bytes, sum(least(n, out))::BIGINT AS out_bytes FROM t GROUP BY algo)"""
)
def bench_rank(spark, sf_dir):
    return analysis.benchmark(documents(spark, sf_dir), algos=["store", "rle", "delta-rle"]).select("algo", "in_bytes", "out_bytes", "rank")


@query(
    """SELECT l_returnflag AS algo, sum(l_orderkey)::BIGINT AS in_bytes, sum(l_partkey)::BIGINT AS out_bytes, round(sum(l_partkey) / sum(l_orderkey), 6)::DOUBLE AS ratio, round(sum(l_orderkey) / sum(l_linenumber) / 1e6, 9)::DOUBLE AS mbps,
row_number() OVER (ORDER BY sum(l_partkey) / sum(l_orderkey), l_returnflag)::INTEGER AS rank, row_number() OVER (ORDER BY sum(l_partkey) / sum(l_orderkey), l_returnflag) = 1 AS best_ratio,
sum(l_orderkey) / sum(l_linenumber) = max(sum(l_orderkey) / sum(l_linenumber)) OVER () AS best_speed FROM lineitem GROUP BY l_returnflag"""
)
def rank_flags(spark, sf_dir):
    """Ranking, throughput and the flags of the best, of totals that don't depend on a clock."""
    totals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("algo")).agg(F.sum("l_orderkey").alias("in_bytes"), F.sum("l_partkey").alias("out_bytes"), F.sum("l_linenumber").cast("double").alias("seconds"))
    out = analysis.rank_codecs(totals)
    return out.select("algo", "in_bytes", "out_bytes", F.round("ratio", 6).alias("ratio"), F.round("mbps", 9).alias("mbps"), "rank", "best_ratio", "best_speed")


@query()
def benchmark_codecs(spark, sf_dir):
    """All seven codecs over every document; times differ from run to run, sizes don't."""
    return analysis.benchmark(documents(spark, sf_dir)).select("algo", "n_blocks", "in_bytes", "out_bytes", "ratio", "rank", "best_ratio")


@query()
def analyze_documents(spark, sf_dir):
    return analysis.analyze(documents(spark, sf_dir).withColumn("path", F.concat(F.lit("doc-"), "file_id")))


#: Every fifth document begins like a JPEG, gzip, PDF or zip file; of every eleventh there is no content at all, and every thirteenth is empty.
ODD_FILES = f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN ''::BLOB ELSE unhex({HEADS}) || encode(coalesce(text, '')) END AS content, 'doc-' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.PNG' ELSE '' END AS path FROM documents"""
TYPED_SQL = f"""SELECT doc_id, content, path, CASE WHEN starts_with(h, 'FFD8FF') THEN 'Image' WHEN starts_with(h, '504B0304') OR starts_with(h, '1F8B') THEN 'Archive' WHEN starts_with(h, '25504446') THEN 'Binary'
WHEN doc_id % 3 = 0 THEN 'Text' WHEN doc_id % 3 = 1 THEN 'Image' WHEN h = '' THEN 'Binary' ELSE 'Text' END AS type,
CASE WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, '504B0304') THEN 'zip' WHEN starts_with(h, '1F8B') THEN 'gzip' WHEN starts_with(h, '25504446') THEN 'pdf'
WHEN doc_id % 3 = 0 THEN 'csv' WHEN doc_id % 3 = 1 THEN 'png' WHEN h = '' THEN 'binary' ELSE 'text' END AS type_detail FROM (SELECT *, coalesce(hex(content), '') AS h FROM ({ODD_FILES}))"""


def _odd_files(spark, sf_dir) -> DataFrame:
    content = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 13 == 0, F.lit(b"")).otherwise(F.concat(F.unhex(F.expr(HEADS)), F.coalesce("text", F.lit("")).cast("binary")))
    path = F.concat(F.lit("doc-"), "doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.PNG' ELSE '' END"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), content.alias("content"))


@query(
    f"""SELECT doc_id, type, type_detail, coalesce(octet_length(content), 0)::BIGINT AS sample_size, 9::INTEGER AS level, 'store' AS algo, true AS store_raw, 0.0::DOUBLE AS compressibility,
CASE WHEN content IS NULL THEN 'the file is not there' WHEN type_detail IN ('jpeg', 'png', 'gzip', 'zip') THEN type_detail || ' is compressed already' ELSE 'the file is empty' END AS rationale
FROM ({TYPED_SQL}) WHERE content IS NULL OR octet_length(content) = 0 OR type_detail IN ('jpeg', 'png', 'gzip', 'zip')"""
)
def analyzer_vetoes(spark, sf_dir):
    """The files that the analyzer stores without trials: those that are not there, empty ones, and compressed formats."""
    out = analysis.analyze(_odd_files(spark, sf_dir), "max-ratio")
    some = out.where(F.col("rationale").rlike("not there|empty|compressed already"))
    return some.select(F.col("file_id").alias("doc_id"), "type", "type_detail", "sample_size", "level", "algo", "store_raw", "compressibility", "rationale")


@query(
    f"""WITH f AS ({TYPED_SQL}), b AS (SELECT doc_id, unnest(regexp_extract_all(substr(hex(content), 1, 2000), '..')) AS b FROM f), h AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY doc_id, b),
e AS (SELECT doc_id, -sum(n / total * log2(n / total)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM h) GROUP BY doc_id)
SELECT doc_id, octet_length(content)::BIGINT AS size, type, type_detail, least(1000, coalesce(octet_length(content), 0))::BIGINT AS sample_size, (round(coalesce(e, 0), 6) + 0)::DOUBLE AS entropy, content IS NOT NULL AS has_crc FROM f LEFT JOIN e USING (doc_id)"""
)
def inspect_files(spark, sf_dir):
    """Size, type, and entropy of the first 1000 bytes."""
    out = analysis.inspect(_odd_files(spark, sf_dir), 1000)
    return out.select(F.col("file_id").alias("doc_id"), "size", "type", "type_detail", "sample_size", (F.round("entropy", 6) + 0).alias("entropy"), F.col("crc").isNotNull().alias("has_crc"))


@query(
    f"""SELECT doc_id, CASE WHEN type = 'Image' THEN 2 WHEN type = 'Archive' THEN 6 WHEN type = 'Binary' THEN 7 ELSE 1 END::INTEGER AS type_id, CASE doc_id % 3 WHEN 0 THEN type END AS from_name,
CASE WHEN starts_with(hex(content), '504B0304') THEN 'extract' WHEN starts_with(hex(content), '1F8B') THEN 'extract' WHEN type = 'Image' THEN 'shrink' ELSE 'compress' END AS route FROM ({TYPED_SQL})"""
)
def type_names_and_routes(spark, sf_dir):
    """Numbers and names of types, and what is done with a file that is dropped on the engine."""
    f = _odd_files(spark, sf_dir).withColumn("head", F.substring("content", 1, 4096))
    out = exprs.detect_types(f)
    name = F.when(F.col("file_id") % 3 == 0, F.upper("type")).otherwise(F.lit("no type"))
    return out.select(F.col("file_id").alias("doc_id"), exprs.type_id(F.col("type")).alias("type_id"), exprs.type_from_name(name).alias("from_name"), exprs.drop_route(F.col("type"), exprs.archive_kind(F.col("head")), F.col("type_detail")).alias("route"))


# --- scalars ------------------------------------------------------------------------------------


@query(
    r"""SELECT page_id, p, (p <> '' AND NOT regexp_matches(p, '^/|\\|^.:|(^|/)\.\.(/|$)')) AS safe, NOT regexp_matches(p, '[/\\\x00-\x1f\x7f]') AND p NOT IN ('', '.', '..') AS safe_name FROM (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../' WHEN 1 THEN '/' WHEN 2 THEN 'a/' ELSE '' END || regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)"""
)
def safe_path(spark, sf_dir):
    p = F.concat(F.expr("CASE page_id % 4 WHEN 0 THEN '../' WHEN 1 THEN '/' WHEN 2 THEN 'a/' ELSE '' END"), F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, sf_dir, "pages").select("page_id", p.alias("p")).select("page_id", "p", exprs.safe_path(F.col("p")).alias("safe"), exprs.safe_name(F.col("p")).alias("safe_name"))


@query(r"SELECT doc_id, regexp_replace(text, '[\x00-\x1f\x7f]', '?', 'g') AS clean FROM documents")
def sanitize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", exprs.sanitize(F.col("text")).alias("clean"))


UNITS = "n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KiB', n / 1024) WHEN n < 1073741824 THEN printf('%.2f MiB', n / 1048576) WHEN n < 1099511627776 THEN printf('%.2f GiB', n / 1073741824) ELSE printf('%.2f TiB', n / 1099511627776)"


@query(f"SELECT o_orderkey, CASE WHEN {UNITS} END AS size, CASE WHEN r >= 1000 THEN printf('%.2f GB/s', r / 1000) ELSE printf('%.2f MB/s', r) END AS rate, printf('%.4f', r / 7) AS ratio FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 37 AS n, o_orderkey / 8 AS r FROM orders)")
def human_formats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("n"), (F.col("o_orderkey") / 8).alias("r"))
    return o.select("o_orderkey", exprs.human_size(F.col("n"), largest="TiB").alias("size"), exprs.human_rate(F.col("r")).alias("rate"), exprs.format_ratio(F.col("r") / 7).alias("ratio"))


SUFFIX = "CASE o_orderkey % 8 WHEN 0 THEN 'K' WHEN 1 THEN 'kb' WHEN 2 THEN 'MiB' WHEN 3 THEN 'm' WHEN 4 THEN 'GB' WHEN 5 THEN '' WHEN 6 THEN 'x' ELSE 'b' END"


@query(f"SELECT o_orderkey, (o_orderkey % 1000) * CASE o_orderkey % 8 WHEN 0 THEN 1024 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1048576 WHEN 4 THEN 1073741824 WHEN 5 THEN 1 END::BIGINT AS bytes FROM orders")
def parse_size(spark, sf_dir):
    text = F.concat((F.col("o_orderkey") % 1000).cast("string"), F.expr(SUFFIX))
    return table(spark, sf_dir, "orders").select("o_orderkey", exprs.parse_size(text).alias("bytes"))


NAMED_SIZES = "CASE o_orderkey % 7 WHEN 0 THEN 'CD' WHEN 1 THEN 'fat32' WHEN 2 THEN '10 MB' WHEN 3 THEN '1 mb' WHEN 4 THEN '100 MB' WHEN 5 THEN '64K' ELSE 'x' END"


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 734003200 WHEN 1 THEN 4294967295 WHEN 2 THEN 10485760 WHEN 3 THEN 1048576 WHEN 4 THEN 104857600 WHEN 5 THEN 65536 END::BIGINT AS bytes FROM orders")
def part_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", exprs.part_size(F.expr(NAMED_SIZES)).alias("bytes"))


@query(
    r"""SELECT page_id, url, length(f) - 3 AS gap FROM (SELECT page_id, url, regexp_extract(lower(url), '(e.*?x.*?m)') AS f FROM pages) WHERE f <> ''
UNION ALL SELECT page_id, url, length(f) - 3 + 100000 FROM (SELECT page_id, url, regexp_extract(lower(url), '(/.*?\..*?n)') AS f FROM pages) WHERE f <> ''"""
)
def fuzzy_names(spark, sf_dir):
    """Names that have the typed letters in their order, and how tightly."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    one = pages.withColumn("gap", exprs.fuzzy_rank(F.col("url"), F.lit("eXm")))
    two = pages.withColumn("gap", exprs.fuzzy_rank(F.col("url"), F.lit("/.n")) + 100000)
    return one.union(two).where("gap is not null").withColumn("gap", F.col("gap").cast("bigint"))


@query("SELECT item_id, lower(hex(encode(text))) AS digits, sha256(text) AS sha FROM benchmark")
def hex_round_trip(spark, sf_dir):
    digits = exprs.to_hex(F.col("text").cast("binary"))
    spaced = F.regexp_replace(digits, "(..)", "$1 ")
    return table(spark, sf_dir, "benchmark").select("item_id", digits.alias("digits"), F.sha2(exprs.from_hex(spaced), 256).alias("sha"))


WORDS = "CASE doc_id % 6 WHEN 0 THEN 'Max_Ratio' WHEN 1 THEN 'speed' WHEN 2 THEN 'DEFAULT' WHEN 3 THEN 'pack' WHEN 4 THEN 'x' ELSE 'b' END"


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'max-ratio' WHEN 1 THEN 'max-speed' WHEN 2 THEN 'balanced' END AS priority,
CASE doc_id % 6 WHEN 0 THEN 9 WHEN 1 THEN 1 WHEN 2 THEN 6 END::INTEGER AS level, CASE doc_id % 6 WHEN 3 THEN 'compress' WHEN 5 THEN 'benchmark' END AS mode FROM documents"""
)
def names_and_aliases(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.expr(WORDS).alias("w"))
    p = exprs.alias_of(F.col("w"), exprs.PRIORITIES)
    return w.select("doc_id", p.alias("priority"), exprs.level_of(p).alias("level"), exprs.alias_of(F.col("w"), exprs.MODES).alias("mode"))


@query(
    """SELECT page_id, folder, name, is_dir, row_number() OVER (PARTITION BY folder ORDER BY is_dir DESC, lower(name), name, page_id)::INTEGER AS place FROM (
  SELECT page_id, regexp_extract(url, '^(.*)/', 1) AS folder, regexp_extract(url, '[^/]*$') AS name, page_id % 3 = 0 AS is_dir FROM pages) WHERE NOT starts_with(name, '.')"""
)
def list_dir(spark, sf_dir):
    """Places in the listings of many folders."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^(.*)/", 1).alias("folder"), F.substring_index("url", "/", -1).alias("name"), (F.col("page_id") % 3 == 0).alias("is_dir"))
    order = Window.partitionBy("folder").orderBy(F.col("is_dir").desc(), F.lower("name"), "name", "page_id")
    return exprs.list_dir(rows).withColumn("place", F.row_number().over(order))


# --- round trips --------------------------------------------------------------------------------


def _round_trip(algo: str):
    def run(spark, sf_dir):
        # the encoded chunks pass through a shuffle, so the decoder has nothing but their bytes
        chunks = pipeline.compress(documents(spark, sf_dir), algo, 6, 1 << 16).repartition("file_id", "chunk_id")
        out = pipeline.decompress(chunks)
        return out.select(F.col("file_id").alias("doc_id"), F.sha2("content", 256).alias("sha"))

    run.__name__ = f"roundtrip_{algo.replace('-', '_')}"
    return run


for _name in CODECS:
    query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")(_round_trip(_name))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def encrypt_roundtrip(spark, sf_dir):
    secret = pipeline.Secret(*SECRET)
    out = pipeline.decompress(pipeline.compress(documents(spark, sf_dir), "huffman", 6, 1 << 14, secret).repartition("file_id", "chunk_id"), secret)
    return out.select(F.col("file_id").alias("doc_id"), F.sha2("content", 256).alias("sha"))


@query(f"SELECT count(*)::BIGINT AS chunks, (count(*) FILTER (octet_length(data) > 0))::BIGINT AS refused FROM ({CHUNKS_SQL})")
def tamper_detect(spark, sf_dir):
    """One bit of each payload that has any is flipped; every such chunk must be refused."""
    chunks = pipeline.compress(documents(spark, sf_dir), "huffman", 6, CHUNK)
    flipped = F.expr("concat(unhex(lpad(hex(conv(hex(substring(payload, 1, 1)), 16, 10) ^ 1), 2, '0')), substring(payload, 2))")
    bad = chunks.withColumn("payload", F.when(F.col("comp_size") > 0, flipped).otherwise(F.col("payload")))
    out = pipeline.decode_chunks(bad)
    return out.agg(F.count("*").alias("chunks"), F.count("error").alias("refused"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS orig_size, true AS whole_crc FROM documents")
def crc_manifest(spark, sf_dir):
    """The CRC folded from chunks against the CRC of the whole."""
    docs = documents(spark, sf_dir)
    made = pipeline.manifest(pipeline.encode_chunks(pipeline.split_chunks(docs, CHUNK), "store"))
    out = made.join(docs.select("file_id", F.crc32("content").alias("whole")), "file_id")
    return out.select(F.col("file_id").alias("doc_id"), "orig_size", (F.col("whole") == F.col("crc")).alias("whole_crc"))


@query("SELECT doc_id, doc_id % 10 <> 0 OR coalesce(text, '') = '' AS authentic FROM documents")
def hmac_manifest(spark, sf_dir):
    """Of every tenth file a byte is appended after the MAC was taken; those must fail."""
    secret = pipeline.Secret(*SECRET)
    chunks = pipeline.encode_chunks(pipeline.split_chunks(documents(spark, sf_dir), 1 << 16), "store", 6, secret)
    good = pipeline.macs(chunks, secret)
    changed = chunks.withColumn("payload", F.when((F.col("file_id") % 10 == 0) & (F.col("orig_size") > 0), F.concat("payload", F.unhex(F.lit("00")))).otherwise(F.col("payload")))
    return pipeline.authenticate(changed, good, secret).select(F.col("file_id").alias("doc_id"), "authentic")


def _conversation_files(spark, sf_dir) -> DataFrame:
    """(conv_id, entries): a small file for each turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))


def _archived(kind: str):
    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for turns in batch.column("t").to_pylist():
                files = [archives.Entry(f"turns/{x['turn']:04d}.txt", x["text"].encode()) for x in turns]
                out.append(archives.compress_bundle(files, algo="huffman", level=6) if kind == "bundle" else archives.pack(files, kind))
            yield pa.record_batch([pa.array([str(c) for c in batch.column("conv_id").to_pylist()]), pa.array(out, pa.binary())], names=["path", "content"])

    def run(spark, sf_dir):
        packed = _conversation_files(spark, sf_dir).mapInArrow(pack, "path string, content binary")
        found = archives.entries(packed)
        return found.select(F.col("archive").cast("bigint").alias("conv_id"), F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint").alias("turn"), F.sha2("data", 256).alias("sha"))

    run.__name__ = f"{kind.replace('.', '_')}_roundtrip"
    return run


for _kind in (*archives.PACKERS, "bundle"):
    query("SELECT conv_id, turn, sha256(coalesce(text, '')) AS sha FROM conversations")(_archived(_kind))


@query(
    """SELECT doc_id, true AS ok, octet_length(encode(coalesce(text, '')))::BIGINT AS orig_size, greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / 4096))::INTEGER AS chunk_count, 'doc-' || doc_id AS name FROM documents"""
)
def container_info(spark, sf_dir):
    """Every document as a container, and what its header says."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("file_id").to_pylist()
            out = [container.write(d, algo="rle", chunk_size=CHUNK, name=f"doc-{i}") for i, d in zip(ids, batch.column("content").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array([str(i) for i in ids]), pa.array(out, pa.binary())], names=["path", "content"])

    info = container.container_info(documents(spark, sf_dir).mapInArrow(pack, "path string, content binary"))
    out = info.join(container.check(info), "path")
    return out.select(F.col("path").cast("bigint").alias("doc_id"), "ok", "orig_size", F.size("chunks").alias("chunk_count"), "name")


@query("SELECT count(*)::BIGINT AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM benchmark")
def stream_ingest(spark, sf_dir):
    """Benchmark items as files in a shared folder, read by a stream into chunk rows, and decoded again."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf_dir, "benchmark").select("text", "item_id").repartition("item_id").select(F.regexp_replace("text", "\n", " ").alias("text")).write.option("lineSep", "\n").text(f"{root}/in")
    streaming.ingest(spark, f"{root}/in", f"{root}/out", f"{root}/state").awaitTermination()
    got = pipeline.decompress(spark.read.parquet(f"{root}/out")).select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    return got.agg(F.count("*").alias("files"), F.sum(F.octet_length("line")).cast("bigint").alias("bytes"))


@query("SELECT doc_id, greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / 4096))::BIGINT AS chunks, octet_length(encode(coalesce(text, '')))::BIGINT AS size, true AS whole, true AS right_crc FROM documents")
def stream_totals(spark, sf_dir):
    """Chunks that arrive in three batches and out of order: the stream's last word on each file, and its CRC against that of the whole."""
    root = f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    chunks = pipeline.encode_chunks(pipeline.split_chunks(docs, CHUNK), "store").select("file_id", "chunk_id", "orig_size", "crc")
    for part in (2, 0, 1):
        chunks.where(F.col("chunk_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    made = state.running_totals(stream).writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    made.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{root}/out")).start().awaitTermination()
    last = spark.read.parquet(f"{root}/out").groupBy("file_id").agg(F.max_by(F.struct("chunks", "size", "crc", "whole"), "chunks").alias("x")).select("file_id", "x.*")
    out = last.join(docs.select("file_id", F.crc32("content").alias("all")), "file_id")
    out = cut(out.select(F.col("file_id").alias("doc_id"), "chunks", "size", "whole", (F.col("crc") == F.col("all")).alias("right_crc")))
    delete(spark, root)
    return out


# --- archives and volumes as tables ----------------------------------------------------------------

LONG = "a-folder-with-a-name-of-some-length/" * 4


def _turns_packed(spark, sf_dir, kind: str, prefix: str = "", with_dir: bool = False) -> DataFrame:
    """(path, content): an archive for each conversation, with a file for each turn."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for turns in batch.column("t").to_pylist():
                files = [archives.Entry(f"{prefix}{x['turn']:04d}.txt", x["text"].encode(), mtime=x["turn"]) for x in turns]
                files += [archives.Entry(prefix.rstrip("/"), is_dir=True)] if with_dir else []
                out.append(archives.tar_write(files) if kind == "tar" else archives.pack(files, kind))
            yield pa.record_batch([pa.array([str(c) for c in batch.column("conv_id").to_pylist()]), pa.array(out, pa.binary())], names=["path", "content"])

    return _conversation_files(spark, sf_dir).mapInArrow(pack, "path string, content binary")


@query(
    f"""SELECT conv_id, '{LONG}' || lpad(turn::VARCHAR, 4, '0') || '.txt' AS path, false AS is_dir, octet_length(encode(coalesce(text, '')))::BIGINT AS size, turn AS mtime FROM conversations
UNION ALL SELECT DISTINCT conv_id, '{LONG.rstrip("/")}', true, 0, 0 FROM conversations"""
)
def archive_listing(spark, sf_dir):
    """Entries of tar files with long names and a directory."""
    found = archives.entries(_turns_packed(spark, sf_dir, "tar", LONG, True), with_data=False)
    return found.select(F.col("archive").cast("bigint").alias("conv_id"), "path", "is_dir", "size", "mtime")


@query("SELECT conv_id, conv_id % 5 <> 0 AS ok, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE count(*) END::BIGINT AS n_entries FROM conversations GROUP BY conv_id")
def archive_test(spark, sf_dir):
    """Every fifth zip file is cut off."""
    packed = _turns_packed(spark, sf_dir, "zip")
    cut_off = F.when(F.col("path").cast("bigint") % 5 == 0, F.expr("substring(content, 1, length(content) - 30)")).otherwise(F.col("content"))
    out = archives.test_archives(packed.withColumn("content", cut_off))
    return out.select(F.col("archive").cast("bigint").alias("conv_id"), "ok", "n_entries")


@query(
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'tar.gz' WHEN 1 THEN 'tar.gz' WHEN 2 THEN 'tar.xz' WHEN 3 THEN 'tar.bz2' WHEN 4 THEN 'zip' WHEN 5 THEN '7z' WHEN 6 THEN 'tar' END AS kind FROM pages"""
)
def archive_names(spark, sf_dir):
    suffix = "CASE page_id % 8 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.tgz' WHEN 2 THEN '.txz' WHEN 3 THEN '.tar.bz2' WHEN 4 THEN '.zip' WHEN 5 THEN '.7z' WHEN 6 THEN '.tar' ELSE '.gz' END"
    return table(spark, sf_dir, "pages").select("page_id", exprs.archive_kind_of_name(F.concat(F.coalesce("url", F.lit("")), F.expr(suffix))).alias("kind"))


@query(f"""SELECT doc_id, CASE WHEN starts_with(hex(content), '504B0304') THEN 'indexed' WHEN starts_with(hex(content), '1F8B') THEN 'stream' ELSE '' END AS kind FROM ({ODD_FILES})""")
def logical_kinds(spark, sf_dir):
    """How an archive would be read: forwards or by its index."""
    return _odd_files(spark, sf_dir).select(F.col("file_id").alias("doc_id"), archives.logical_kind_of(F.substring("content", 1, 512)).alias("kind"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(coalesce(text, '')) AS sha FROM documents")
def digest_by_pieces(spark, sf_dir):
    """SHA-256 of each document from its chunks, which come one after the other and are not put together."""

    def chain(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(batch.column("file_id").to_pylist(), batch.column("data").to_pylist(), strict=True)

        for file_id, parts in itertools.groupby(rows(), key=lambda r: r[0]):
            d = Digest()
            for _, data in parts:
                d.update(data)
            yield pa.record_batch([pa.array([file_id], pa.int64()), pa.array([d.size], pa.int64()), pa.array([d.sha256().hex()])], names=["doc_id", "size", "sha"])

    chunks = pipeline.split_chunks(documents(spark, sf_dir), CHUNK).repartition("file_id").sortWithinPartitions("file_id", "chunk_id")
    return chunks.select("file_id", "data").mapInArrow(chain, "doc_id bigint, size bigint, sha string")


@query("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":' || to_json(lang)::VARCHAR || ',\"text\":' || to_json(text)::VARCHAR || '}' AS line FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
def json_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang is not null and text is not null")
    return docs.select("doc_id", F.to_json(F.struct("doc_id", "lang", "text")).alias("line"))


@query(
    f"""SELECT strftime(time_bucket(INTERVAL '1 hour', t), '%Y-%m-%d %H') AS hour, type, count(*)::BIGINT AS files, sum(coalesce(octet_length(content), 0))::BIGINT AS bytes FROM (
SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 97) AS t FROM ({TYPED_SQL})) GROUP BY ALL"""
)
def window_totals(spark, sf_dir):
    """Files and bytes by type and hour, as the watching stream counts them."""
    stamp = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("file_id") * 97)
    out = streaming.volume_by_type(_odd_files(spark, sf_dir).withColumn("modified", stamp))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "type", "files", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))


# --- files in the shared folder ----------------------------------------------------------------------


def _write_files(rows: DataFrame, folder: str) -> None:
    """Writes (name, content) as files."""

    def put(batches):
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(data)
            yield batch.select(["name"])

    rows.select("name", "content").mapInArrow(put, "name string").count()


def _digests(paths: DataFrame) -> DataFrame:
    """(path, sha) of mounted files."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            shas = []
            for p in batch.column("path").to_pylist():
                with open(p, "rb") as f:
                    shas.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.record_batch([batch.column("path"), pa.array(shas, pa.string())], names=["path", "sha"])

    return paths.select("path").mapInArrow(read, "path string, sha string")


def _in_folder(name: str):
    """Gives a query a folder of its own in the shared one, and deletes it when the rows are written."""

    def wrap(f):
        def run(spark, sf_dir):
            root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
            out = cut(f(spark, sf_dir, mounted(root)))
            delete(spark, root)
            return out

        run.__name__ = name
        return run

    return wrap


@query("SELECT item_id, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha, true AS packed, true AS tested, true AS restored, true AS encrypted FROM benchmark WHERE text IS NOT NULL")
@_in_folder("file_jobs")
def file_jobs(spark, sf_dir, root):
    """Files compressed, tested and restored by the verbs, in folders below each other, under a password."""
    items = table(spark, sf_dir, "benchmark").where("text is not null")
    _write_files(items.select(F.format_string("%d/item-%d.txt", F.col("item_id") % 7, "item_id").alias("name"), F.col("text").cast("binary").alias("content")), f"{root}/in")
    packed = jobs.compress(spark, [f"{root}/in"], f"{root}/packed", "huffman", chunk_size=512, password=SECRET[0], iterations=SECRET[2])
    tested = jobs.test(spark, [f"{root}/packed"], SECRET[0])
    back = jobs.decompress(spark, [f"{root}/packed"], f"{root}/back", SECRET[0])
    number = lambda c: F.regexp_extract(c, r"item-(\d+)", 1).cast("bigint").alias("item_id")
    out = packed.select(number("input"), F.col("in_bytes").alias("size"), F.col("ok").alias("packed"), "encrypted")
    out = out.join(tested.select(number("path"), F.col("ok").alias("tested")), "item_id").join(back.select(number("output"), F.col("ok").alias("restored")), "item_id")
    return out.join(_digests(back.select(F.col("output").alias("path"))).select(number("path"), "sha"), "item_id")


@query("SELECT conv_id, true AS ok, count(*)::BIGINT AS n_entries, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS n_bytes, count(*)::BIGINT AS written FROM conversations GROUP BY conv_id")
@_in_folder("volume_archives")
def volume_archives(spark, sf_dir, root):
    """Archives in series of volumes of 1 KiB, tested and extracted without being joined."""
    packed = _turns_packed(spark, sf_dir, "tar.gz").select(F.col("path").cast("bigint").alias("file_id"), "content")
    parts = archives.split(packed, archives.MIN_PART)
    _write_files(parts.select(F.format_string("%d.tar.gz.%03d", "file_id", "num").alias("name"), F.col("data").alias("content")), f"{root}/v")
    tested = jobs.archives.test_files(jobs._archives(spark, [f"{root}/v"]))
    number = lambda c: F.regexp_extract(c, r"(\d+)\.tar", 1).cast("bigint").alias("conv_id")
    firsts = jobs._archives(spark, [f"{root}/v"])
    to = F.concat(F.lit(f"{root}/out/"), F.regexp_extract("path", r"(\d+)\.tar", 1))

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            counts = [sum(r["status"] == "written" for r in archives.extract_multipart(p, folder)) for p, folder in zip(batch.column("path").to_pylist(), batch.column("to").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("path"), pa.array(counts, pa.int64())], names=["path", "written"])

    written = firsts.select("path", to.alias("to")).mapInArrow(extract, "path string, written bigint")
    return tested.select(number("archive"), "ok", "n_entries", "n_bytes").join(written.select(number("path"), "written"), "conv_id")


@query(
    """SELECT conv_id, count(*) FILTER (turn % 3 <> 1)::BIGINT AS written, count(*) FILTER (turn % 3 = 1)::BIGINT AS unsafe, count(*) FILTER (turn % 3 <> 1)::BIGINT AS refused FROM conversations GROUP BY conv_id"""
)
@_in_folder("safe_extraction")
def safe_extraction(spark, sf_dir, root):
    """Every third name leads out of the folder; a second extraction finds the files and leaves them."""
    name = F.concat(F.col("conv_id").cast("string"), F.when(F.col("turn") % 3 == 1, "/../../out-").otherwise("/"), F.col("turn").cast("string"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("archive"), name.alias("path"), F.lit(False).alias("is_dir"), F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.lit(None).cast("string").alias("error"))
    once = cut(archives.write_entries(rows, f"{root}/x"))
    again = cut(archives.write_entries(rows, f"{root}/x"))
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    first = once.groupBy("archive").agg(count("written").alias("written"), count("unsafe path").alias("unsafe"))
    return first.join(again.groupBy("archive").agg(count("exists").alias("refused")), "archive").select(F.col("archive").cast("bigint").alias("conv_id"), "written", "unsafe", "refused")
