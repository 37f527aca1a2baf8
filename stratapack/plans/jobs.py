"""The verbs of the engine over files on a file system that driver and executors mount; errors are data.

A file is many rows: its chunks are read at their positions, encoded by any tasks, written to a chunk table in the shared folder, and
from there to their positions in the container, whose header is known by then.  Restoring goes the other way.  So no task holds more than some chunks, whatever a file's size; only
MACs, which the format chains over the whole payload, are read through by one task a file, piece by piece.  Outputs are made beside their place and renamed when they are complete.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import os
import re
import tarfile
import time
import uuid
import zipfile
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import exprs
from ..functions.bits import FormatError
from ..functions.codecs import BY_INDEX, CODECS, clamp_level
from ..functions.crypto import chacha20_all, chunk_nonce, crc32_fold, derive_keys, hmac_sha256
from ..operators import analysis, media, pipeline
from ..sources import archives, container
from ..sources.folders import cut, delete, files_below, shared_folder

VERSION = "0.2.0"
RESULT = "input string, output string, ok boolean, error string, algo string, in_bytes bigint, out_bytes bigint, ratio double, chunks bigint, crc bigint, encrypted boolean, seconds double, mbps double"
SUFFIX = ".spk"


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_id, path, rel, size) of the files at and below mounted paths; `rel` is the place below the given path, and a path that isn't there has no size."""
    rows, seen = [], set()
    for root in (p.removeprefix("file://") for p in paths):
        found = files_below(root) if os.path.exists(root) else [root]
        for p in found:
            own = os.path.abspath(p)
            if own not in seen:
                seen.add(own)
                rows.append((own, os.path.relpath(p, root) if os.path.isdir(root) else os.path.basename(p), os.path.getsize(p) if os.path.isfile(p) else None))
    out = spark.createDataFrame(rows, "path string, rel string, size long")
    return out.select(F.xxhash64("path").alias("file_id"), "*")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _map(df: DataFrame, job, kind: str, several: bool = False) -> DataFrame:
    """Runs job(row) -> fields, or with `several` an iterator of them, on each row; an error of a file stands in its row's `error`."""
    schema = to_arrow_schema(T._parse_datatype_string(kind))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    made = job(r) if several else [job(r)]
                    for x in made:
                        yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | x], schema=schema)
                except (FormatError, OSError) as e:
                    text = (e.strerror or str(e)) if isinstance(e, OSError) else str(e)
                    yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | {k: v for k, v in r.items() if k in schema.names} | {"error": text}], schema=schema)

    return df.mapInArrow(run, kind)


def heads(files: DataFrame, n: int) -> DataFrame:
    """(file_id, path, rel, size, content): the first n bytes of each file; null where it can't be read."""

    def read(r):
        if r["size"] is None:
            return r
        with open(r["path"], "rb") as f:
            return r | {"content": f.read(n)}

    kind = "file_id bigint, path string, rel string, size bigint, content binary, error string"
    return _map(files.repartition(_tasks(files.sparkSession)), read, kind).drop("error")


# --- containers ------------------------------------------------------------------------------------


class _Keys:
    """Keys of one job: the password is stretched once, on the driver; each file has a nonce of its own."""

    def __init__(self, password: str, iterations: int):
        self.salt, self.iterations = os.urandom(16), iterations
        self.cipher_key, self.mac_key = derive_keys(password, self.salt, iterations)

    def nonce(self, file_id: int) -> bytes:
        return hmac_sha256(self.cipher_key, b"file", self.salt, str(file_id).encode())[:12]

    def apply(self, rows: list[dict], texts: list[bytes]) -> list[bytes]:
        return chacha20_all(self.cipher_key, [chunk_nonce(self.nonce(r["file_id"]), r["chunk_id"]) for r in rows], texts)

    def __repr__(self) -> str:
        return "_Keys(...)"


_TODO = "file_id bigint, path string, output string, size bigint, algo string, type string, type_detail string, error string"
_ONE = "file_id bigint, path string, output string, size bigint, algo string, type string, type_detail string, chunks bigint, out_bytes bigint, crc bigint, error string"


def _planned(todo: DataFrame, force: bool) -> DataFrame:
    """Adds to `error` what speaks against an output: it is the input, exists, or is another input's too (the first by path keeps it)."""
    first = todo.where("output is not null").groupBy("output").agg(F.min("path").alias("first"))
    found = todo.join(first, "output", "left")

    def check(r):
        error = r["error"]
        if not error and r["output"]:
            if os.path.abspath(r["output"]) == os.path.abspath(r["path"]):
                error = "the output is the input"
            elif r["first"] != r["path"]:
                error = "another input has this output"
            elif os.path.lexists(r["output"]) and not force:
                error = "the output exists"
        return {k: v for k, v in r.items() if k != "first"} | {"error": error}

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema.fields)
    return _map(found.select(*todo.columns, "first"), check, kind)


@lru_cache(64)
def _layout(path: str, version: int, magic: bytes) -> tuple[container.Header, list[int], list[int]]:
    """(header, where the chunks' payloads begin, where their contents do) of a container; `version` tells states of a file apart."""
    with open(path, "rb") as f:
        h, at = container.load_header(f, os.path.getsize(path), magic)
    offsets, begins = [at], [0]
    for o, n, _ in h.chunks:
        offsets.append(offsets[-1] + n)
        begins.append(begins[-1] + o)
    return h, offsets, begins


def _part(output: str, job: str) -> str:
    return f"{output}.{job}.part"


def _commit(output: str, job: str, force: bool) -> None:
    if os.path.lexists(output) and not force:  # it came while the job ran
        os.remove(_part(output, job))
        raise FormatError("the output exists")
    os.replace(_part(output, job), output)


def _pack(spark: SparkSession, todo: DataFrame, level: int, chunk_size: int, password: str | None, force: bool, magic: bytes, iterations: int, bundle: bool = False) -> DataFrame:
    """Makes containers of the files in `todo` (_TODO); results are complete when this returns."""
    began, job = time.time(), uuid.uuid4().hex
    staging = f"{shared_folder(spark)}/jobs-{job}"
    keys = None if password is None else _Keys(password, iterations)
    todo = cut(_planned(todo, force))
    good = todo.where("error is null")
    size = F.least(F.lit(chunk_size).cast("bigint"), exprs.block_cap(F.col("algo")))
    pieces = good.withColumn("chunk", size).withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("size") / F.col("chunk")) - 1, F.lit(0).cast("bigint")))))
    pieces = pieces.select("file_id", "path", "algo", "size", "chunk", F.col("chunk_id").cast("int").alias("chunk_id")).repartition(_tasks(spark) * 4, "file_id", "chunk_id")

    def read(r):
        with open(r["path"], "rb") as f:
            f.seek(r["chunk_id"] * r["chunk"])
            n = min(r["chunk"], r["size"] - r["chunk_id"] * r["chunk"])
            data = f.read(n)
        if len(data) < n:
            raise FormatError("the file became shorter")
        return {"file_id": r["file_id"], "chunk_id": r["chunk_id"], "algo": r["algo"], "data": data}

    chunks = _map(pieces, read, "file_id bigint, chunk_id int, algo string, data binary, error string")
    pipeline.encode_chunks(chunks.where("error is null").drop("error"), level=level, secret=keys).write.parquet(f"{staging}/chunks")
    staged = spark.read.parquet(f"{staging}/chunks")
    tables = staged.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "orig_size", "comp_size", "raw", "crc", "payload_crc"))).alias("chunks"))  # some bytes a chunk
    out = good.join(tables, "file_id", "left")

    def write_header(r):
        found = r.pop("chunks") or []
        want = max(1, -(-r["size"] // min(chunk_size, CODECS[r["algo"]].block_cap)))
        if [c["chunk_id"] for c in found] != list(range(want)) or sum(c["orig_size"] for c in found) != r["size"]:
            raise FormatError("the file could not be read whole")
        h = container.Header(
            algo=CODECS[r["algo"]].index, level=level, file_type=exprs.TYPE_NAMES.index(r["type"]) if r["type"] in exprs.TYPE_NAMES else 0, flags=container.BUNDLE * bundle, orig_size=r["size"],
            comp_size=sum(c["comp_size"] for c in found), orig_crc=crc32_fold((c["crc"], c["orig_size"]) for c in found), created=int(began), chunk_size=min(chunk_size, CODECS[r["algo"]].block_cap),
            name=os.path.basename(r["path"]), detail=r["type_detail"] or "", payload_crc=crc32_fold((c["payload_crc"], c["comp_size"]) for c in found), chunks=[(c["orig_size"], c["comp_size"], container.RAW * c["raw"]) for c in found],
        )
        if keys is not None:
            h.flags, h.salt, h.nonce, h.kdf_iterations = h.flags | container.ENCRYPTED, keys.salt, keys.nonce(r["file_id"]), keys.iterations
        head = h.pack(magic)
        os.makedirs(os.path.dirname(os.path.abspath(r["output"])), exist_ok=True)
        with open(_part(r["output"], job), "wb") as f:
            f.write(head)
            f.truncate(len(head) + h.comp_size)
        return r | {"chunks": len(found), "out_bytes": len(head) + h.comp_size, "crc": h.orig_crc}

    made = cut(_map(out.repartition(_tasks(spark)), write_header, _ONE))

    def put(r):
        part = _part(r["output"], job)
        with open(part, "r+b") as f:
            f.seek(_layout(part, 0, magic)[1][r["chunk_id"]])
            f.write(r["payload"])
        return {"file_id": r["file_id"]}

    payload = staged.select("file_id", "chunk_id", "payload").join(made.where("error is null").select("file_id", "output"), "file_id")
    wrong = cut(_map(payload, put, "file_id bigint, error string").where("error is not null").groupBy("file_id").agg(F.min("error").alias("late")))

    def finish(r):
        late, part = r.pop("late"), r["output"] and _part(r["output"], job)
        if r["error"] or late:
            if part and os.path.exists(part):
                os.remove(part)
            return r | {"error": r["error"] or late}
        if keys is not None:
            with open(part, "r+b") as f:
                h, at = container.load_header(f, r["out_bytes"], magic)
                h.mac = container.payload_digest(f, at, h.comp_size, keys.mac_key).update(h.pack(magic, with_mac=False)).mac()
                f.seek(0)
                f.write(h.pack(magic))
        _commit(r["output"], job, force)
        return r

    done = cut(_map(made.join(wrong, "file_id", "left").repartition(_tasks(spark)), finish, _ONE))
    delete(spark, staging)
    bad = todo.where("error is not null").select("file_id", "path", "output", "size", "algo", "type", "type_detail", F.lit(None).cast("bigint").alias("chunks"), F.lit(None).cast("bigint").alias("out_bytes"), F.lit(None).cast("bigint").alias("crc"), "error")
    return _results(done.union(bad), F.col("size"), time.time() - began, F.lit(password is not None))


def _results(done: DataFrame, in_bytes, seconds: float, encrypted) -> DataFrame:
    """RESULT rows; seconds are the job's."""
    out = done.select(
        F.col("path").alias("input"), "output", F.col("error").isNull().alias("ok"), "error", "algo", in_bytes.cast("bigint").alias("in_bytes"), "out_bytes",
        F.when((in_bytes > 0) & F.col("out_bytes").isNotNull(), F.col("out_bytes") / in_bytes).alias("ratio"), F.col("chunks").cast("bigint").alias("chunks"), "crc", encrypted.alias("encrypted"),
        F.lit(seconds).alias("seconds"), F.when(F.col("error").isNull(), in_bytes / F.lit(max(seconds, 1e-9)) / 1e6).alias("mbps"),
    )
    return out


def compress(spark: SparkSession, paths: list[str], folder: str, algo: str | None = None, priority: str = "balanced", level: int | None = None, chunk_size: int = 1 << 20, password: str | None = None, force: bool = False, magic: bytes = container.MAGIC, iterations: int = container.KDF_ITERATIONS) -> DataFrame:
    """Each file as a container in `folder`, in the place that it has below the given path.  Without `algo` the analyzer chooses by `priority`."""
    files = listing(spark, paths)
    output = F.concat(F.lit(folder.rstrip("/") + "/"), "rel", F.lit(SUFFIX))
    gone = F.when(F.col("size").isNull(), "no such file").alias("error")
    if algo:
        todo = files.select("file_id", "path", output.alias("output"), "size", F.lit(algo).alias("algo"), F.lit("Unknown").alias("type"), F.lit("").alias("type_detail"), gone)
    else:
        chosen = analysis.analyze(heads(files, 1 << 20), priority).select("file_id", "algo", "type", "type_detail")
        todo = files.join(chosen, "file_id").select("file_id", "path", output.alias("output"), "size", "algo", "type", "type_detail", gone)
    return _pack(spark, todo, clamp_level(level or (6 if algo else analysis.CANDIDATES[priority][1])), chunk_size, password, force, magic, iterations)


_HEAD = "file_id bigint, path string, output string, size bigint, algo string, orig_size bigint, orig_crc bigint, payload_crc bigint, encrypted boolean, chunks bigint, error string"


def decompress(spark: SparkSession, paths: list[str], folder: str, password: str | None = None, force: bool = False, verify: bool = True, magic: bytes = container.MAGIC) -> DataFrame:
    """Containers restored into `folder`, in the places that they have below the given path: without the suffix if they have it, else under their recorded names if those are safe, else with .out."""
    began, job = time.time(), uuid.uuid4().hex
    files = listing(spark, paths)

    def read_header(r):
        rel = r.pop("rel")
        if r["size"] is None:
            raise FormatError("no such file")
        with open(r["path"], "rb") as f:
            h, at = container.load_header(f, r["size"], magic)
            container.authenticate(f, h, at, password, magic)  # before anything is written
        if h.algo not in BY_INDEX and not all(c[2] & container.RAW for c in h.chunks):
            raise FormatError("unknown codec")
        base = os.path.basename(rel)
        safe = archives.safe_rel_path(h.name) and "/" not in h.name and h.name not in (".", "..") and h.name.isprintable()
        name = base[: -len(SUFFIX)] if base.endswith(SUFFIX) and base != SUFFIX else h.name if safe else base + ".out"
        return r | {"output": os.path.join(folder, os.path.dirname(rel), name), "algo": BY_INDEX[h.algo].name if h.algo in BY_INDEX else None, "orig_size": h.orig_size, "orig_crc": h.orig_crc, "payload_crc": h.payload_crc, "encrypted": h.encrypted, "chunks": len(h.chunks)}

    todo = cut(_planned(_map(files.repartition(_tasks(spark)), read_header, _HEAD), force))
    pieces = todo.where("error is null").withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).select("file_id", "path", "output", "size", "chunk_id")
    pieces = pieces.repartition(_tasks(spark) * 4, "file_id", "chunk_id")

    def restore(r):
        h, offsets, begins = _layout(r["path"], os.stat(r["path"]).st_mtime_ns, magic)
        k = r["chunk_id"]
        with open(r["path"], "rb") as f:
            f.seek(offsets[k])
            part = f.read(h.chunks[k][1])
        data = container.decode_chunk(h, k, part, password)
        os.makedirs(os.path.dirname(os.path.abspath(r["output"])), exist_ok=True)
        at = os.open(_part(r["output"], job), os.O_RDWR | os.O_CREAT, 0o644)
        try:
            os.pwrite(at, data, begins[k])
        finally:
            os.close(at)
        return {"file_id": r["file_id"], "chunk_id": k, "orig_size": len(data), "comp_size": len(part), "crc": zlib.crc32(data), "payload_crc": zlib.crc32(part)}

    kind = "file_id bigint, chunk_id bigint, orig_size bigint, comp_size bigint, crc bigint, payload_crc bigint, error string"
    parts = cut(_map(pieces, restore, kind))
    found = parts.where("error is null").select("file_id", "chunk_id", F.lit("").alias("algo"), "orig_size", "comp_size", F.lit(False).alias("raw"), "crc", "payload_crc")
    sums = pipeline.manifest(found).select("file_id", F.col("chunk_count").alias("n"), F.col("orig_size").alias("made"), F.col("crc").alias("found_crc"), F.col("payload_crc").alias("found_payload"))
    wrong = parts.where("error is not null").groupBy("file_id").agg(F.min("error").alias("late"))

    def finish(r):
        part = r["output"] and _part(r["output"], job)
        error = r["error"] or r["late"]
        if not error and (r["n"] != r["chunks"] or r["made"] != r["orig_size"]):
            error = "the content has another size"
        if not error and verify and r["found_payload"] != r["payload_crc"]:
            error = "the payload's checksum differs"
        if not error and verify and r["found_crc"] != r["orig_crc"]:
            error = "the content's checksum differs"
        out = {k: v for k, v in r.items() if k not in ("n", "made", "found_crc", "found_payload", "late")}
        if error:
            if part and os.path.exists(part):
                os.remove(part)
            return out | {"error": error}
        _commit(r["output"], job, force)
        return out | {"orig_crc": r["found_crc"]}

    done = cut(_map(todo.join(sums, "file_id", "left").join(wrong, "file_id", "left").repartition(_tasks(spark)), finish, _HEAD))
    out = done.select("path", "output", "size", "algo", "chunks", F.when(F.col("error").isNull(), F.col("orig_size")).alias("out_bytes"), F.col("orig_crc").alias("crc"), "error", "encrypted")
    return _results(out, F.col("size"), time.time() - began, F.col("encrypted"))


# --- bundles and archives ----------------------------------------------------------------------------


def _tree(roots: list[str]) -> list[tuple[str, str]]:
    """(name, path) of the directories and files at and below some paths, by name; each root gives its base name, and links are left out."""
    out = []
    for root in roots:
        top = os.path.dirname(os.path.abspath(root))
        out.append((os.path.relpath(root, top), root))
        for d, dirs, names in os.walk(root):
            out += [(os.path.relpath(os.path.join(d, n), top), os.path.join(d, n)) for n in dirs + names]
    return sorted((n, p) for n, p in out if not os.path.islink(p))


def _write_tar(f, roots: list[str], keep_mode: bool) -> int:
    tree = _tree(roots)
    with tarfile.open(fileobj=f, mode="w|", format=tarfile.GNU_FORMAT, bufsize=1 << 20) as t:
        for name, path in tree:
            st, is_dir = os.stat(path), os.path.isdir(path)
            info = tarfile.TarInfo(name)
            info.type, info.size, info.mtime = tarfile.DIRTYPE if is_dir else tarfile.REGTYPE, 0 if is_dir else st.st_size, int(st.st_mtime)
            info.mode = st.st_mode & 0o7777 if keep_mode else 0o755 if is_dir else 0o644
            if is_dir:
                t.addfile(info)
            else:
                with open(path, "rb") as src:
                    t.addfile(info, src)
    return len(tree)


def _write_zip(f, roots: list[str], level: int) -> int:
    tree = _tree(roots)
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
        for name, path in tree:
            is_dir = os.path.isdir(path)
            info = zipfile.ZipInfo(name + ("/" if is_dir else ""), (1980, 1, 1, 0, 0, 0))
            info.external_attr, info.compress_type = (0o40755 if is_dir else 0o100644) << 16, zipfile.ZIP_DEFLATED
            if is_dir:
                z.writestr(info, b"")
            else:
                with z.open(info, "w", force_zip64=os.path.getsize(path) >= 1 << 31) as to, open(path, "rb") as src:
                    while piece := src.read(1 << 20):
                        to.write(piece)
    return len(tree)


def bundle(spark: SparkSession, paths: list[str] | str, out: str, kind: str = "bundle", algo: str = "lz77", level: int = 6, password: str | None = None, force: bool = False, magic: bytes = container.MAGIC, iterations: int = container.KDF_ITERATIONS) -> dict:
    """Files and folders as one bundle or standard archive.

    An archive is one sequence of bytes, so it is written by the driver, piece by piece; a bundle's tar file is then compressed by all tasks.
    """
    roots = [paths] if isinstance(paths, str) else paths
    result = {"output": out, "entries": 0, "out_bytes": None, "ok": False, "error": None}
    gone = [p for p in roots if not os.path.exists(p)]
    if gone or (os.path.lexists(out) and not force):
        return result | {"error": f"no such file: {gone[0]}" if gone else "the output exists"}
    if kind not in (*archives.PACKERS, "bundle"):
        return result | {"error": f"no writer for {kind}"}
    part = f"{out}.{uuid.uuid4().hex}.part"
    os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
    try:
        with open(part, "wb") as f:
            if kind == "zip":
                n = _write_zip(f, roots, level)
            else:
                opened = {"tar.gz": lambda: gzip.GzipFile("", "wb", level, f, mtime=0), "tar.xz": lambda: lzma.LZMAFile(f, "wb", preset=level), "tar.bz2": lambda: bz2.BZ2File(f, "wb", compresslevel=level)}.get(kind, lambda: f)()
                n = _write_tar(opened, roots, kind == "bundle")
                if opened is not f:
                    opened.close()
        if kind != "bundle":
            os.replace(part, out)
            return result | {"entries": n, "out_bytes": os.path.getsize(out), "ok": True}
        todo = spark.createDataFrame([(1, part, out, os.path.getsize(part), algo, "Archive", "tar", None)], _TODO)
        r = _pack(spark, todo, clamp_level(level), 1 << 20, password, force, magic, iterations, bundle=True).first()
        return result | {"entries": n, "out_bytes": r.out_bytes, "ok": r.ok, "error": r.error}
    finally:
        if os.path.exists(part):
            os.remove(part)


def _archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The listed paths; of a series of volumes its first one."""
    later = F.col("path").rlike(r"\.\d{3}$") & ~F.col("path").endswith(".001")
    files = listing(spark, paths)
    return files.where(~later | F.col("size").isNull()).select("file_id", "path", "rel", "size").repartition(_tasks(spark))


def list_archives(spark: SparkSession, paths: list[str], password: str | None = None, magic: bytes = container.MAGIC) -> DataFrame:
    return archives.list_files(_archives(spark, paths), password, magic)


def extract(spark: SparkSession, paths: list[str], folder: str, password: str | None = None, force: bool = False, magic: bytes = container.MAGIC) -> DataFrame:
    """The entries of archives, containers and series of volumes below `folder`; results are complete when this returns."""
    return cut(archives.extract_files(_archives(spark, paths), folder, force, password, magic))


def info(spark: SparkSession, paths: list[str], magic: bytes = container.MAGIC, payload: bool = True) -> DataFrame:
    """What containers say of themselves; without `payload` only their headers are read."""
    return container.files_info(listing(spark, paths).repartition(_tasks(spark)), magic, payload)


def test(spark: SparkSession, paths: list[str], password: str | None = None, magic: bytes = container.MAGIC) -> DataFrame:
    """(path, ok, details) of containers, standard archives and series of volumes alike."""
    found = cut(heads(_archives(spark, paths), 5))
    own = F.coalesce(F.col("content") == F.lit(magic), F.lit(False)) & ~F.col("path").rlike(r"\.\d{3}$")
    others = archives.test_files(found.where(~own), password, magic)
    return container.check(container.files_info(found.where(own), magic)).unionByName(others.select(F.col("archive").alias("path"), "ok", F.coalesce("error", F.format_string("%d entries", "n_entries")).alias("details")))


# --- inspection ----------------------------------------------------------------------------------------


def analyze(spark: SparkSession, paths: list[str], priority: str = "balanced", by_time: bool = False) -> DataFrame:
    """A path that isn't there is a row with a reason."""
    return analysis.analyze(heads(listing(spark, paths), 1 << 20), priority, by_time=by_time).drop("file_id")


def inspect(spark: SparkSession, paths: list[str], sample_bytes: int = 1 << 20) -> DataFrame:
    """Size, type, entropy and CRC of the first bytes of each file."""
    files = heads(listing(spark, paths), sample_bytes)
    return analysis.inspect(files, sample_bytes).drop("size").join(files.select("file_id", "size"), "file_id").drop("file_id")


def bench(spark: SparkSession, paths: list[str], level: int = 6, limit: int | None = None) -> DataFrame:
    """All codecs over the files, in pieces of the largest block."""
    most = max(c.block_cap for c in CODECS.values() if c.name != "store")
    files = listing(spark, paths).where("size is not null").withColumn("size", F.least("size", F.lit(limit).cast("bigint")) if limit else F.col("size"))
    pieces = files.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("size") / most) - 1, F.lit(0).cast("bigint"))))).repartition(_tasks(spark) * 4, "file_id", "k")

    def read(r):
        with open(r["path"], "rb") as f:
            f.seek(r["k"] * most)
            return {"file_id": r["file_id"], "content": f.read(min(most, r["size"] - r["k"] * most))}

    return analysis.benchmark(_map(pieces, read, "file_id bigint, content binary, error string").where("error is null").drop("error"), level).orderBy("rank")


def shrink(spark: SparkSession, paths: list[str], quality: str = "medium", encoder: str = "ffmpeg") -> DataFrame:
    """Videos and images among the files in a smaller copy beside them, one file a task."""
    typed = exprs.detect_types(heads(listing(spark, paths), 4096), "path", "content").select("path", "type")
    return cut(media.shrink_media(typed, quality, encoder))


# --- volumes ---------------------------------------------------------------------------------------------


def split(path: str, part_size: int) -> list[str]:
    """Volumes of one file, next to it; a series that is there is not touched."""
    size = os.path.getsize(path)
    n = max(1, -(-size // part_size))
    if part_size < archives.MIN_PART or n > archives.MOST_PARTS:
        raise ValueError("a part has 1 KiB at least, and a series 999 parts at most")
    names = [f"{path}.{k:03d}" for k in range(1, n + 1)]
    if there := [p for p in names if os.path.lexists(p)]:
        raise FileExistsError(there[0])
    with open(path, "rb") as f:
        for name in names:
            with open(name, "wb") as out:
                left = part_size
                while left and (block := f.read(min(left, 1 << 20))):
                    left -= out.write(block)
    return names


def join(path: str, out: str, force: bool = False, reclaim: bool = False) -> int:
    """One file of a series; with `reclaim` the volumes are deleted once the file is complete."""
    parts = archives.series(path)
    if os.path.lexists(out) and not force:
        raise FileExistsError(out)
    n = 0
    with open(part := f"{out}.{uuid.uuid4().hex}", "wb") as f:
        src = archives.VolumeFile(parts)
        while block := src.read(1 << 20):
            n += f.write(block)
    os.replace(part, out)
    if reclaim:
        for p in parts:
            os.remove(p)
    return n


def part_size(text: str) -> int:
    """Bytes of a named part size, or of a written one such as 64K or 4MiB."""
    if (named := exprs.PART_SIZES.get(text.lower())) is not None:
        return named
    if not (m := re.fullmatch(r"(\d+)(?:([kmg])(?:i?b)?)?", text.lower())):
        raise ValueError(f"{text} is no size")
    return int(m[1]) << {"k": 10, "m": 20, "g": 30, None: 0}[m[2]]


def algorithms(spark: SparkSession) -> DataFrame:
    rows = [(c.index, c.name, float(c.typical_ratio), float(c.typical_speed_mbps), c.memory_bytes, c.block_cap, c.dictionary_size, list(c.types)) for c in CODECS.values()]
    return spark.createDataFrame(rows, "id int, name string, typical_ratio double, typical_speed_mbps double, memory_bytes long, block_cap long, dictionary_size long, types array<string>")
