"""The chunk pipeline, the analyzer and the native expressions on Spark."""

import datetime
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapack.functions import exprs
from stratapack.operators import analysis, media, pipeline
from stratapack.sources import archives
from stratapack.streaming import ingest

NOISE = np.random.RandomState(3).bytes(30000)
TEXT = b"".join(f"row {k * k % 911} of the table\n".encode() for k in range(3000))


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, bytearray(TEXT)), (2, bytearray(NOISE)), (3, bytearray(b"")), (4, bytearray(b"A")), (5, None)]
    return pipeline.as_files(spark.createDataFrame(rows, "id long, data binary"), "id", "data").cache()


@pytest.mark.parametrize("secret", [None, pipeline.Secret("pw", b"s" * 16, 100)])
def test_round_trip_and_verify(files, secret):
    chunks = pipeline.compress(files, "huffman", 6, 4096, secret).cache()
    back = {r.file_id: r for r in pipeline.decompress(chunks, secret).collect()}
    want = {1: TEXT, 2: NOISE, 3: b"", 4: b"A", 5: b""}
    assert {k: bytes(r.content) for k, r in back.items()} == want
    made = pipeline.manifest(chunks)
    rows = {r.file_id: r for r in made.collect()}
    assert all(rows[k].crc == zlib.crc32(v) and rows[k].orig_size == len(v) and rows[k].chunk_count == max(1, -(-len(v) // 4096)) for k, v in want.items())
    assert rows[2].raw_chunks == rows[2].chunk_count and rows[1].ratio < 0.75
    assert all(r.ok and r.consistent for r in pipeline.verify(chunks, made, pipeline.decode_chunks(chunks, secret)).collect())
    lost = chunks.where("not (file_id = 1 and chunk_id = 3)")
    verdict = {r.file_id: r.ok for r in pipeline.verify(lost, made, pipeline.decode_chunks(lost, secret)).collect()}
    assert verdict == {1: False, 2: True, 3: True, 4: True, 5: True}
    assert {r.file_id: r.error for r in pipeline.decompress(lost, secret).collect()}[1] == "chunks are missing"


def test_result_does_not_depend_on_partitions(files):
    one, many = (sorted((r.file_id, r.chunk_id, bytes(r.payload)) for r in pipeline.compress(files.repartition(n), "lzw", 6, 5000).collect()) for n in (1, 7))
    assert one == many


def test_authentication(files):
    secret = pipeline.Secret("pw", b"s" * 16, 100)
    chunks = pipeline.compress(files, "store", 6, 4096, secret).cache()
    good = pipeline.macs(chunks, secret).cache()
    assert all(r.authentic for r in pipeline.authenticate(chunks, good, secret).collect())
    swapped = chunks.withColumn("chunk_id", F.when((F.col("file_id") == 1) & F.col("chunk_id").isin(0, 1), 1 - F.col("chunk_id")).otherwise(F.col("chunk_id")))
    assert {r.file_id for r in pipeline.authenticate(swapped, good, secret).collect() if not r.authentic} == {1}
    assert "pw" not in repr(secret) and not any(r.authentic for r in pipeline.authenticate(chunks, good, pipeline.Secret("no", b"s" * 16, 100)).collect())


def test_offsets(files):
    rows = pipeline.chunk_offsets(pipeline.compress(files, "rle", 6, 4096)).orderBy("file_id", "chunk_id").collect()
    at = {}
    for r in rows:
        assert r.offset == at.get(r.file_id, 0)
        at[r.file_id] = r.offset + r.comp_size


def test_analyzer(spark):
    jpeg = b"\xff\xd8\xff" + NOISE
    rows = [(1, "a.txt", bytearray(TEXT)), (2, "b.bin", bytearray(NOISE)), (3, "c.dat", bytearray(jpeg)), (4, "d.txt", bytearray(b"")), (5, "e.gz", bytearray(b"\x1f\x8b" + TEXT))]
    df = spark.createDataFrame(rows, "file_id long, path string, content binary")
    for priority, level in (("max-speed", 1), ("balanced", 6), ("max-ratio", 9)):
        got = {r.file_id: r for r in analysis.analyze(df, priority).collect()}
        assert not got[1].store_raw and got[1].level == level and got[1].compressibility > 0.3
        assert got[1].algo in analysis.CANDIDATES[priority][0].split()
        assert all(got[k].store_raw and got[k].algo == "store" for k in (2, 3, 4, 5))
        assert "compressed already" in got[3].rationale and "empty" in got[4].rationale
    strict = {r.file_id: r.store_raw for r in analysis.analyze(df, strict=True).collect()}
    assert strict[3] and not strict[5]


def test_selection_band(spark):
    rows = [(1, [("lz77", 0, 0.50), ("lzw", 1, 0.51), ("huffman", 2, 0.60)]), (2, [("lz77", 0, 0.5), ("delta-rle", 3, 0.5)]), (3, [])]
    m = spark.createDataFrame(rows, "file_id long, trials array<struct<algo:string,ord:int,ratio:double>>")
    pick = lambda t: {r.file_id: r.x and r.x.algo for r in m.select("file_id", analysis.chosen(F.col("trials"), t).alias("x")).collect()}
    assert pick(1.0) == {1: "lz77", 2: "lz77", 3: None} and pick(1.05) == {1: "lzw", 2: "delta-rle", 3: None} and pick(1.25)[1] == "huffman"


def test_trial_sizes_are_those_of_the_codecs():
    for data in (b"", b"a", b"aab" * 500, TEXT, NOISE, bytes(range(256)) * 9):
        for name in analysis.CODECS:
            if name != "bwt-mtf-ari" or len(data) < 5000:
                assert analysis.trial_size(name, data, 6) == len(analysis.CODECS[name].encode(data, 6)), name


def test_inspect_and_clashing_names(spark):
    rows = [(1, "a.txt", bytearray(TEXT)), (2, "b", None), (None, "c.spk", bytearray(b"SPACK..")), (4, "d", bytearray(b""))]
    got = {r.path: r for r in analysis.inspect(spark.createDataFrame(rows, "file_id long, path string, content binary"), 100).collect()}
    assert (got["a.txt"].size, got["a.txt"].sample_size, got["a.txt"].crc) == (len(TEXT), 100, zlib.crc32(TEXT[:100])) and got["b"].size is None and got["b"].crc is None
    assert got["c.spk"].type_detail == "spack" and got["d"].type_detail == "binary"
    odd = spark.createDataFrame([("a.py", bytearray(b"x"), 1, 2, 3)], "path string, head binary, ext int, found int, type int")
    assert exprs.detect_types(odd).first().asDict() == {"path": "a.py", "head": bytearray(b"x"), "ext": 1, "found": 2, "type": "Text", "type_detail": "python"}


def test_benchmark(spark, files):
    rows = analysis.benchmark(files, limit=2000).collect()
    assert len(rows) == 7 and sum(r.best_ratio for r in rows) == 1 and sorted(r["rank"] for r in rows) == list(range(1, 8))
    assert all(r.ratio <= 1 for r in rows) and {r.in_bytes for r in rows} == {4001}


def test_types(spark):
    cases = [
        ("x.txt", b"\x89PNG\r\n\x1a\n", "Image", "png"), ("x", b"RIFF1234WAVE", "Audio", "wav"), ("x", b"RIFF12", "Text", "text"), ("x", b"RIFF1234ABCD", "Binary", "riff"), ("x", b"\0\0\0\x18ftypmp42", "Video", "mp4"), ("x", b"MZ", "Executable", "pe"),
        ("a.b/C.PY", b"import x", "Text", "python"), ("x.kt", b"\0", "Text", "kotlin"), ("x.docx", b"no", "Archive", "zip"), ("x.unknown", b"plain", "Text", "text"), ("x", b"a\0b", "Binary", "binary"), ("x", b"", "Binary", "binary"), ("x", b"\x01" * 10 + b"a", "Binary", "binary"), ("x", "é".encode(), "Text", "text"), ("x", b"#!/bin/sh", "Text", "script"),
    ]
    df = spark.createDataFrame([(k, p, bytearray(h), t, d) for k, (p, h, t, d) in enumerate(cases)], "id int, path string, head binary, t string, d string")
    for r in exprs.detect_types(df).collect():
        assert (r.type, r.type_detail) == (r.t, r.d), r


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    sizes = {"64K": 65536, "4mib": 4 << 20, "1Gb": 1 << 30, "12": 12, "": None, "x": None, "5b": None, "1.5k": None, " 1": None}
    for text, want in sizes.items():
        assert one(exprs.parse_size(F.lit(text))) == want
    for n, want in {0: "0 B", 1023: "1023 B", 1536: "1.50 KiB", 1 << 20: "1.00 MiB", 5 << 30: "5.00 GiB", 3 << 40: "3.00 TiB", 2 << 50: "2.00 PiB"}.items():
        assert one(exprs.human_size(F.lit(n))) == want
    assert one(exprs.human_rate(F.lit(999.5))) == "999.50 MB/s" and one(exprs.human_rate(F.lit(1500.0))) == "1.50 GB/s" and one(exprs.format_ratio(F.lit(0.21244))) == "0.2124"
    for x, want in {1.015: "1.01", 1.035: "1.03", 2.675: "2.67", 0.125: "0.12", 0.375: "0.38", -1.015: "-1.01", 1e-9: "0.00"}.items():
        assert one(exprs.fixed(F.lit(x), 2)) == want == f"{x:.2f}"
    assert one(exprs.fuzzy_rank(F.lit("Report.Final.txt"), F.lit("rf.t"))) == 10 and one(exprs.fuzzy_rank(F.lit("abc"), F.lit("cb"))) is None and one(exprs.fuzzy_rank(F.lit("abc"), F.lit(""))) == 0
    assert one(exprs.part_size(F.lit("cd"))) == 700 << 20 and one(exprs.part_size(F.lit("3k"))) == 3072
    assert one(exprs.sanitize(F.lit("a\x1b[1m\x7f"))) == "a?[1m?"
    assert bytes(one(exprs.from_hex(F.lit("0a F f1")))) == b"\x0a\xff" and one(exprs.from_hex(F.lit("zz"))) is None
    for name, ok in {"a.txt": True, "..": False, "a/b": False, "a\nb": False, "": False}.items():
        assert one(exprs.safe_name(F.lit(name))) is ok
    for p, ok in {"a/b": True, "/a": False, "a/../b": False, "C:a": False, "..a": True}.items():
        assert one(exprs.safe_path(F.lit(p))) is ok
    head = F.lit(archives.pack([archives.Entry("a", b"b")], "tar"))
    assert one(exprs.archive_kind(head)) == "tar" and one(exprs.archive_kind_of_name(F.lit("x.tgz"))) == "tar.gz"
    routes = [one(exprs.drop_route(F.lit(k), F.lit(a))) for k, a in (("Archive", "zip"), ("Video", None), ("Text", None))] + [one(exprs.drop_route(F.lit("Archive"), F.lit(None), F.lit("spack")))]
    assert routes == ["extract", "shrink", "compress", "extract"]


def test_volumes(spark):
    df = spark.createDataFrame([(1, "f", 10000), (2, "e", 0), (3, "g", 4096)], "file_id long, name string, size long")
    rows = [(r.name, r.start, r.end) for r in archives.volumes_of(df, 4096).orderBy("name").collect()]
    assert rows == [("e.001", 0, 0), ("f.001", 0, 4096), ("f.002", 4096, 8192), ("f.003", 8192, 10000), ("g.001", 0, 4096)]
    with pytest.raises(ValueError):
        archives.volumes_of(df, 1000)
    sets = archives.volume_sets(spark.createDataFrame([("a.001",), ("a.002",), ("a.004",), ("b.002",), ("c",), ("a.000",)], "path string"))
    assert sorted(r.path for r in sets.collect()) == ["a.001", "a.002"]


def test_media_is_refused_without_encoder(spark, tmp_path):
    (tmp_path / "v.mp4").write_bytes(b"x")
    df = spark.createDataFrame([(str(tmp_path / "v.mp4"), "Video"), ("t.txt", "Text"), ("/nope.png", "Image")], "path string, type string")
    got = [r.status for r in media.shrink_media(df, encoder="no-such-encoder").collect()]
    assert got == ["no-such-encoder is not installed", "not a video or image", "no such file"]
    assert media.shrunk_name("a/b.mp4") == "a/b-shrunk.mp4" and "28" in media.arguments("a", "b", "Video", "low")
    with pytest.raises(ValueError):
        media.shrink_media(df, "best")


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes(TEXT)
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"))
    ingest.ingest(*args).awaitTermination()
    (folder / "b.bin").write_bytes(NOISE)
    ingest.ingest(*args).awaitTermination()
    ingest.ingest(*args).awaitTermination()
    got = [bytes(r.content) for r in pipeline.decompress(spark.read.parquet(str(tmp_path / "out"))).collect()]
    assert sorted(got, key=len) == [NOISE, TEXT] or sorted(got) == sorted([NOISE, TEXT])
    stamp = datetime.datetime(2024, 1, 1, 10, 30)
    rows = spark.createDataFrame([(1, "a.txt", stamp, bytearray(b"hi")), (2, "b.txt", stamp, bytearray(b"you"))], "file_id long, path string, modified timestamp, content binary")
    assert [(r.type, r.files, r.bytes) for r in ingest.volume_by_type(rows).collect()] == [("Text", 2, 5)]


def test_runs_of_chunks():
    import random

    from stratapack.streaming import state

    rng = random.Random(1)
    parts = [rng.randbytes(rng.randrange(0, 40)) for _ in range(30)]
    rows = [(k, k + 1, len(p), zlib.crc32(p)) for k, p in enumerate(parts)]
    whole = b"".join(parts)
    for _ in range(20):
        rng.shuffle(rows)
        runs = []
        for k in range(0, 30, 7):
            runs = state.joined(runs + rows[k : k + 7] + rows[:1])
        assert runs == [(0, 30, len(whole), zlib.crc32(whole))]
    assert len(state.joined(rows[:1] + [(99, 100, 1, 2)])) == 2


def test_totals_of_arriving_chunks(spark, tmp_path, files):
    from stratapack.streaming import state

    chunks = pipeline.compress(files, "rle", 6, 4096).select("file_id", "chunk_id", "orig_size", "crc")
    for part in (2, 0, 1):  # out of order, one file at a time
        chunks.where(F.col("chunk_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    state.running_totals(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: seen.append(df.collect())).start().awaitTermination()
    last = {r.file_id: r for batch in seen for r in batch}
    want = {1: TEXT, 2: NOISE, 3: b"", 4: b"A", 5: b""}
    assert len([b for b in seen if b]) >= 3
    assert {k: (r.size, r.crc, r.whole) for k, r in last.items()} == {k: (len(v), zlib.crc32(v), True) for k, v in want.items()}
    assert any(not r.whole for batch in seen for r in batch)


def test_small_tables_are_spread(spark, tmp_path):
    from stratapack.sources.folders import spread

    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(3 * cores).write.option("maxRecordsPerFile", 50).parquet(str(tmp_path / "many"))
    used = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    one = spread(spark.read.parquet(str(tmp_path / "one")))
    assert used(one) >= cores and one.count() == 1000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        many = spark.read.parquet(str(tmp_path / "many"))
        assert spread(many) is many
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spread(spark.createDataFrame([], "x int")).count() == 0
