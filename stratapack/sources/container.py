"""The self-describing container: header, chunk table, payload; as bytes and as a Spark data source.

The five magic bytes are a parameter: containers of other programs that have this layout are read and written with their magic.
Errors of a file are data: a row says what is wrong with it, and the other files go on.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.bits import FormatError
from ..functions.codecs import BY_INDEX, CODECS
from ..functions.crypto import KDF_ITERATIONS, KDF_MOST, Digest, chacha20, chunk_nonce, derive_keys, hmac_sha256, same

MAGIC = b"SPACK"
# --- fixed values: layout and limits of versions 1 and 2 ----------------------------------------
_HEAD = struct.Struct("<5sHBBBBQQIQQII16s12s")
_CHUNK = struct.Struct("<QQB")
ENCRYPTED, BUNDLE, RAW = 1, 2, 1
MAX_CHUNK, MAX_HEADER = 64 << 20, 64 << 20


@dataclass
class Header:
    version: int = 2
    algo: int = 0
    level: int = 6
    file_type: int = 0
    flags: int = 0
    orig_size: int = 0
    comp_size: int = 0
    orig_crc: int = 0
    created: int = 0
    chunk_size: int = 1 << 16
    kdf_iterations: int = 0
    salt: bytes = bytes(16)
    nonce: bytes = bytes(12)
    name: str = ""
    detail: str = ""
    payload_crc: int = 0
    mac: bytes = bytes(32)
    chunks: list[tuple[int, int, int]] = field(default_factory=list)  # original size, size in the payload, flags

    @property
    def encrypted(self) -> bool:
        return bool(self.flags & ENCRYPTED)

    @property
    def bundle(self) -> bool:
        return bool(self.flags & BUNDLE)

    def pack(self, magic: bytes = MAGIC, with_mac: bool = True) -> bytes:
        name, detail = self.name.encode(), self.detail.encode()
        out = _HEAD.pack(magic, self.version, self.algo, self.level, self.file_type, self.flags, self.orig_size, self.comp_size, self.orig_crc, self.created, self.chunk_size, len(self.chunks), self.kdf_iterations, self.salt, self.nonce)
        out += struct.pack("<H", len(name)) + name + struct.pack("<H", len(detail)) + detail
        out += b"".join(_CHUNK.pack(*c) for c in self.chunks) + struct.pack("<I", self.payload_crc)
        return out + (self.mac if with_mac and self.version >= 2 else b"")


class _More(FormatError):
    """The header goes on behind the bytes at hand."""


def parse(data: bytes, magic: bytes = MAGIC, total: int | None = None) -> tuple[Header, int]:
    """(header, where the payload begins); raises FormatError before anything is allocated by untrusted counts.  `data` may be the beginning of a file of `total` bytes."""
    total = len(data) if total is None else total
    if len(data) < _HEAD.size:
        raise FormatError("too short for a header")
    found, *v = _HEAD.unpack_from(data)
    if found != magic:
        raise FormatError("another magic")
    version, algo, level, kind, flags, orig, comp, crc, created, size, count, rounds, salt, nonce = v
    if version not in (1, 2):
        raise FormatError(f"unknown version {version}")
    if not count:
        raise FormatError("no chunks")
    if count * _CHUNK.size > min(MAX_HEADER, total):
        raise FormatError("the chunk table is longer than the file")
    if not 1 <= size <= MAX_CHUNK:
        raise FormatError("impossible chunk size")
    if flags & ENCRYPTED and not 1 <= rounds <= KDF_MOST:
        raise FormatError("impossible number of key rounds")
    at, texts = _HEAD.size, []
    for _ in range(2):
        if at + 2 > len(data):
            raise _More("a name is cut off")
        n = struct.unpack_from("<H", data, at)[0]
        if at + 2 + n > len(data):
            raise _More("a name is cut off")
        texts.append(data[at + 2 : at + 2 + n].decode(errors="replace"))
        at += 2 + n
    tail = 4 + (32 if version >= 2 else 0)
    if at + count * _CHUNK.size + tail > len(data):
        raise _More("the chunk table is cut off")
    chunks = [_CHUNK.unpack_from(data, at + k * _CHUNK.size) for k in range(count)]
    at += count * _CHUNK.size
    if any(o > size for o, _, _ in chunks):
        raise FormatError("a chunk is larger than the chunk size")
    if sum(o for o, _, _ in chunks) != orig or sum(c for _, c, _ in chunks) != comp:
        raise FormatError("totals differ from the chunk table")
    payload_crc = struct.unpack_from("<I", data, at)[0]
    mac = data[at + 4 : at + 36] if version >= 2 else bytes(32)
    return Header(version, algo, level, kind, flags, orig, comp, crc, created, size, rounds, salt, nonce, *texts, payload_crc, mac, chunks), at + tail


def write(data: bytes, algo: str = "lz77", level: int = 6, chunk_size: int = 1 << 16, name: str = "", detail: str = "", file_type: int = 0, created: int = 0, bundle: bool = False, password: str | None = None, salt: bytes = b"", nonce: bytes = b"", iterations: int = KDF_ITERATIONS, magic: bytes = MAGIC) -> bytes:
    """One file as a container; salt and nonce are random unless given."""
    codec = CODECS[algo]
    h = Header(algo=codec.index, level=level, file_type=file_type, flags=BUNDLE * bundle, orig_size=len(data), orig_crc=zlib.crc32(data), created=created, chunk_size=min(chunk_size, codec.block_cap), name=name, detail=detail)
    if password is not None:
        h = replace(h, flags=h.flags | ENCRYPTED, salt=salt or os.urandom(16), nonce=nonce or os.urandom(12), kdf_iterations=iterations)
        key, mac_key = derive_keys(password, h.salt, iterations)
    parts = []
    for k in range(max(1, -(-len(data) // h.chunk_size))):
        part = data[k * h.chunk_size : (k + 1) * h.chunk_size]
        out = codec.encode(part, level)
        raw = len(out) >= len(part)
        out = part if raw else out
        parts.append(chacha20(key, chunk_nonce(h.nonce, k), out) if password is not None else out)
        h.chunks.append((len(part), len(out), RAW * raw))
    payload = b"".join(parts)
    h.comp_size, h.payload_crc = len(payload), zlib.crc32(payload)
    if password is not None:
        h.mac = hmac_sha256(mac_key, payload, h.pack(magic, with_mac=False))
    return h.pack(magic) + payload


def read(data: bytes, password: str | None = None, magic: bytes = MAGIC, verify: bool = True) -> tuple[Header, bytes]:
    """(header, content).  An encrypted payload is authenticated before any of it is decoded; a wrong size always fails, a wrong CRC if `verify`."""
    h, at = parse(data, magic)
    payload = data[at : at + h.comp_size]
    if len(payload) < h.comp_size:
        raise FormatError("the payload is cut off")
    if h.encrypted:
        if password is None:
            raise FormatError("a password is needed")
        key, mac_key = derive_keys(password, h.salt, h.kdf_iterations, h.version)
        if h.version >= 2 and not same(hmac_sha256(mac_key, payload, h.pack(magic, with_mac=False)), h.mac):
            raise FormatError("wrong password, or the file was changed")
    if verify and zlib.crc32(payload) != h.payload_crc:
        raise FormatError("the payload's checksum differs")
    codec, place, out = BY_INDEX.get(h.algo), 0, []
    if codec is None and not all(f & RAW for _, _, f in h.chunks):
        raise FormatError("unknown codec")
    for k, (orig, comp, flags) in enumerate(h.chunks):
        part = payload[place : place + comp]
        place += comp
        part = chacha20(key, chunk_nonce(h.nonce, k), part) if h.encrypted else part
        out.append(part if flags & RAW else codec.decode(part, orig))
        if len(out[-1]) != orig:
            raise FormatError("a chunk has another size")
    content = b"".join(out)
    if len(content) != h.orig_size:
        raise FormatError("the content has another size")
    if verify and zlib.crc32(content) != h.orig_crc:
        raise FormatError("the content's checksum differs")
    return h, content


_PROBE, _PIECE = 128 << 10, 1 << 20


def load_header(f, size: int, magic: bytes = MAGIC) -> tuple[Header, int]:
    """(header, where the payload begins) of a file of `size` bytes, of which only the header is read; the payload must fit in the file."""
    f.seek(0)
    data = f.read(min(_PROBE, size))
    try:
        h, at = parse(data, magic, size)
    except _More:  # the fixed part says how much there can be
        count = _HEAD.unpack_from(data)[11]
        data += f.read(_HEAD.size + 2 * (2 + 65535) + count * _CHUNK.size + 36 - len(data))
        h, at = parse(data, magic, size)
    if at + h.comp_size > size:
        raise FormatError("the payload is cut off")
    return h, at


def payload_digest(f, at: int, size: int, key: bytes | None = None) -> Digest:
    """Digests of a payload, read piece by piece."""
    out, left = Digest(key), size
    f.seek(at)
    while left:
        piece = f.read(min(_PIECE, left))
        if not piece:
            raise FormatError("the payload is cut off")
        out.update(piece)
        left -= len(piece)
    return out


@lru_cache(256)
def keys_of(password: str, salt: bytes, rounds: int, version: int) -> tuple[bytes, bytes]:
    return derive_keys(password, salt, rounds, version)


def authenticate(f, h: Header, at: int, password: str | None, magic: bytes = MAGIC) -> None:
    """Raises FormatError unless a payload may be decoded: before any of it is."""
    if not h.encrypted:
        return
    if password is None:
        raise FormatError("a password is needed")
    if h.version >= 2:
        _, mac_key = keys_of(password, h.salt, h.kdf_iterations, h.version)
        made = payload_digest(f, at, h.comp_size, mac_key)
        if not same(made.update(h.pack(magic, with_mac=False)).mac(), h.mac):
            raise FormatError("wrong password, or the file was changed")


def decode_chunk(h: Header, k: int, part: bytes, password: str | None = None) -> bytes:
    """The content of the k-th chunk of a container."""
    orig, _, flags = h.chunks[k]
    if h.encrypted:
        part = chacha20(keys_of(password, h.salt, h.kdf_iterations, h.version)[0], chunk_nonce(h.nonce, k), part)
    codec = BY_INDEX.get(h.algo)
    if codec is None and not flags & RAW:
        raise FormatError("unknown codec")
    out = part if flags & RAW else codec.decode(part, orig)
    if len(out) != orig:
        raise FormatError("a chunk has another size")
    return out


class ContentFile(io.RawIOBase):
    """The content of a container as a file to be read forwards: one chunk is held at a time.  The end is reached only if sizes and, with `verify`, checksums are right."""

    def __init__(self, f, size: int, password: str | None = None, magic: bytes = MAGIC, verify: bool = True):
        self.h, self.at = load_header(f, size, magic)
        authenticate(f, self.h, self.at, password, magic)
        self.f, self.password, self.verify = f, password, verify
        self.k, self.held, self.seen, self.packed = 0, b"", Digest(), Digest()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held and self.k < len(self.h.chunks):
            n = self.h.chunks[self.k][1]
            self.f.seek(self.at + self.packed.size)
            part = self.f.read(n)
            if len(part) < n:
                raise FormatError("the payload is cut off")
            self.packed.update(part)
            self.held = decode_chunk(self.h, self.k, part, self.password)
            self.seen.update(self.held)
            self.k += 1
            if self.k == len(self.h.chunks) and self.verify and (self.packed.crc != self.h.payload_crc or self.seen.crc != self.h.orig_crc):
                raise FormatError("the content's checksum differs" if self.packed.crc == self.h.payload_crc else "the payload's checksum differs")
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


INFO = (
    "path string, version int, algo string, level int, file_type int, encrypted boolean, bundle boolean, orig_size bigint, comp_size bigint, orig_crc bigint, created bigint, "
    "chunk_size bigint, name string, detail string, payload_crc bigint, chunks array<struct<orig_size:bigint,comp_size:bigint,raw:boolean>>, payload_ok boolean, error string"
)


def inspect(path: str, f, size: int, magic: bytes = MAGIC, payload: bool = True) -> dict:
    """An INFO row; of a broken container only path and error.  Without `payload` only the header is read, and payload_ok is null."""
    empty = dict.fromkeys(x.split(" ")[0] for x in INFO.replace("<", " <").split(", ")) | {"path": path}
    try:
        h, at = load_header(f, size, magic)
        ok = payload_digest(f, at, h.comp_size).crc == h.payload_crc if payload else None
    except FormatError as e:
        return empty | {"error": str(e)}
    return empty | {
        "version": h.version, "algo": BY_INDEX[h.algo].name if h.algo in BY_INDEX else None, "level": h.level, "file_type": h.file_type, "encrypted": h.encrypted, "bundle": h.bundle,
        "orig_size": h.orig_size, "comp_size": h.comp_size, "orig_crc": h.orig_crc, "created": h.created, "chunk_size": h.chunk_size, "name": h.name, "detail": h.detail, "payload_crc": h.payload_crc,
        "chunks": [{"orig_size": o, "comp_size": c, "raw": bool(f & RAW)} for o, c, f in h.chunks], "payload_ok": ok,
    }


def files_info(paths: DataFrame, magic: bytes = MAGIC, payload: bool = True) -> DataFrame:
    """INFO of the containers at mounted paths (path): headers are read, and payloads piece by piece for their checksum."""
    schema = to_arrow_schema(T._parse_datatype_string(INFO))

    def scan(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                try:
                    with open(p, "rb") as f:
                        row = inspect(p, f, os.path.getsize(p), magic, payload)
                except OSError as e:
                    row = inspect(p, io.BytesIO(), 0, magic) | {"error": e.strerror}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return paths.select("path").mapInArrow(scan, INFO)


def container_info(files: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """INFO of each container in a table (path, content), such as spark.read.format('binaryFile') gives."""
    schema = to_arrow_schema(T._parse_datatype_string(INFO))

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([inspect(p, io.BytesIO(d or b""), len(d or b""), magic) for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(scan, INFO)


def check(info: DataFrame) -> DataFrame:
    """(path, ok, details): the verdict on containers, from their header tables and payload checksums."""
    total = lambda f: F.aggregate("chunks", F.lit(0).cast("bigint"), lambda a, c: a + c[f])
    consistent = F.coalesce((total("orig_size") == F.col("orig_size")) & (total("comp_size") == F.col("comp_size")), F.lit(False))
    ok = F.col("error").isNull() & consistent & F.coalesce("payload_ok", F.lit(False))
    return info.select("path", ok.alias("ok"), F.coalesce("error", F.when(~consistent, "totals differ").when(~F.col("payload_ok"), "the payload's checksum differs").otherwise("ok")).alias("details"))


# --- ranges of large files ----------------------------------------------------------------------


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, size: int):
        self.path, self.first, self.last, self.size = path, first, last, size


class ByteRanges(DataSource):
    """`spark.read.format('byte_ranges')`: (path, chunk_id, offset, data) of files on a file system that all executors mount.

    Options: path (a file, or a folder read through), chunk_size, chunks_per_task, limit (bytes from the start of each file).  A file is read by many
    tasks at their positions, so its size isn't bounded by a row's.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, chunk_id bigint, offset bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.chunk = int(self.options.get("chunk_size", 1 << 20))
        self.per_task = int(self.options.get("chunks_per_task", 32))
        self.limit = int(self.options["limit"]) if "limit" in self.options else None

    def partitions(self):
        root = self.options["path"]
        paths = [root] if os.path.isfile(root) else sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names)
        out = []
        for p in paths:
            size = os.path.getsize(p) if self.limit is None else min(self.limit, os.path.getsize(p))
            count = max(1, -(-size // self.chunk))
            out += [_Range(p, k, min(k + self.per_task, count), size) for k in range(0, count, self.per_task)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, part: _Range):
        if part.first == part.last:
            return
        with open(part.path, "rb") as f:
            for k in range(part.first, part.last):
                f.seek(k * self.chunk)
                yield part.path, k, k * self.chunk, f.read(min(self.chunk, max(0, part.size - k * self.chunk)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ByteRanges)
