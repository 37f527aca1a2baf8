"""Tar bundles and standard archives, in memory and as tables of entries, and volumes."""

from __future__ import annotations

import bisect
import bz2
import calendar
import gzip
import io
import itertools
import lzma
import os
import re
import shutil
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import exprs
from ..functions.bits import FormatError
from . import container

ENTRY = "archive string, path string, is_dir boolean, size bigint, mtime bigint, mode int, data binary, error string"
_ENTRY = pa.schema([("archive", pa.string()), ("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime", pa.int64()), ("mode", pa.int32()), ("data", pa.binary()), ("error", pa.string())])
PACKERS = ("zip", "tar", "tar.gz", "tar.xz", "tar.bz2")
UNPACKED_ONLY_ELSEWHERE = ("7z", "rar")


@dataclass(frozen=True)
class Entry:
    path: str
    data: bytes = b""
    is_dir: bool = False
    mtime: int = 0
    mode: int = 0o644
    size: int = 0


def safe_rel_path(path: str) -> bool:
    """Whether a path stays below the folder that it is put in."""
    return bool(path) and not re.search(r"^[/\\]|^.:|\\|\0", path) and ".." not in path.split("/")


def tar_write(entries: list[Entry], keep_mode: bool = True) -> bytes:
    """A tar file with entries sorted by path, so that equal trees give equal bytes; owners are 0, long names have GNU records."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as t:
        for e in sorted(entries, key=lambda e: e.path):
            info = tarfile.TarInfo(e.path)
            info.size, info.mtime, info.type = len(e.data), e.mtime, tarfile.DIRTYPE if e.is_dir else tarfile.REGTYPE
            info.mode = (e.mode if keep_mode else 0o755 if e.is_dir else 0o644) & 0o7777
            t.addfile(info, io.BytesIO(e.data))
    return out.getvalue()


def tar_read(data: bytes) -> Iterator[Entry]:
    """Files and directories; links and devices are left out."""
    yield from _whole(_guarded("tar", _tar(io.BytesIO(data))))


def pack(entries: list[Entry], kind: str, level: int = 6) -> bytes:
    """Entries as a standard archive; permissions are 0644 and 0755."""
    if kind == "zip":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
            for e in sorted(entries, key=lambda e: e.path):
                info = zipfile.ZipInfo(e.path + ("/" if e.is_dir else ""), (1980, 1, 1, 0, 0, 0))
                info.external_attr = (0o40755 if e.is_dir else 0o100644) << 16
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, e.data, compresslevel=level)
        return out.getvalue()
    if kind not in PACKERS:
        raise FormatError(f"no writer for {kind}")
    tar = tar_write(entries, keep_mode=False)
    if kind == "tar.gz":
        return gzip.compress(tar, level, mtime=0)
    return {"tar": lambda: tar, "tar.xz": lambda: lzma.compress(tar, preset=level), "tar.bz2": lambda: bz2.compress(tar, level)}[kind]()


#: What an archive begins with, in order of precedence (fixed values).
SIGNATURES = (
    (b"PK\3\4", "zip"), (b"PK\5\6", "zip"), (b"PK\7\10", "zip"), (b"7z\xbc\xaf'\x1c", "7z"), (b"Rar!\x1a\7", "rar"), (b"(\xb5/\xfd", "zst"), (b"\x1f\x8b", "gz"), (b"\xfd7zXZ\0", "xz"), (b"BZh", "bz2"),
    (b"\x04\x22\x4d\x18", "lz4"), (b"\x1f\x9d", "Z"), (b"]\0\0", "lzma"), (b"!<arch>\n", "ar"), (b"070701", "cpio"), (b"070702", "cpio"), (b"070707", "cpio"),
)


class _Pieces(io.RawIOBase):
    """Pieces of bytes as a file to be read forwards."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held:
            if (piece := next(self.pieces, None)) is None:
                return 0
            self.held = piece
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


def _lz4(f) -> Iterator[bytes]:
    """The blocks of LZ4 frames; checksums are passed over."""
    while head := f.read(4):
        if head != b"\x04\x22\x4d\x18":
            raise EOFError("no head of a frame")
        flags = _exactly(f, 2)[0]
        _exactly(f, 8 * (flags >> 3 & 1) + 4 * (flags & 1) + 1)
        window = b""
        while size := int.from_bytes(_exactly(f, 4), "little"):
            block = _exactly(f, size & 0x7FFFFFFF)
            if flags >> 4 & 1:
                _exactly(f, 4)
            out = block if size >> 31 else _lz4_block(block, b"" if flags >> 5 & 1 else window)
            window = (window + out)[-65536:]
            yield out
        if flags >> 2 & 1:
            _exactly(f, 4)


def _lz4_block(block: bytes, before: bytes) -> bytes:
    """Sequences of literals and matches; a length of 15 goes on in the bytes that follow, as long as they are 255."""
    out, at, end = bytearray(before), 0, len(block)

    def length(n: int, at: int) -> tuple[int, int]:
        while n >= 15:
            more, at = block[at], at + 1
            n += more
            if more < 255:
                break
        return n, at

    try:
        while at < end:
            token, at = block[at], at + 1
            n, at = length(token >> 4, at)
            if at + n > end:
                raise EOFError("literals are cut off")
            out += block[at : at + n]
            at += n
            if at >= end:
                break
            d, at = block[at] | block[at + 1] << 8, at + 2
            n, at = length(token & 15, at)
            n += 4
            if not 0 < d <= len(out):
                raise EOFError("a match begins before the block")
            part = bytes(out[len(out) - d : len(out) - d + n])
            out += part if d >= n else (part * (n // d + 1))[:n]
    except IndexError:
        raise EOFError("a sequence is cut off") from None
    return bytes(out[len(before) :])


def _compress(f) -> Iterator[bytes]:
    """The stream of the old compress program: LZW with codes of 9 bits and more, lowest bit first, in groups of eight."""
    _exactly(f, 2)
    flags = _exactly(f, 1)[0]
    most, clears = flags & 31, flags >> 7
    if not 9 <= most <= 16:
        raise EOFError("no such width")
    roots = [bytes((i,)) for i in range(256)] + ([b""] if clears else [])
    known, width, before, out = roots[:], 9, None, []
    while group := f.read(width):
        value, n = int.from_bytes(group, "little"), len(group) * 8 // width
        for k in range(n):
            code = value >> k * width & (1 << width) - 1
            if code == 256 and clears:
                known, width, before = roots[:], 9, None
                break  # the rest of the group is filling
            if before is None:
                if code > 255:
                    raise EOFError("the first code is no byte")
                entry = known[code]
            else:
                if code > len(known) or code == len(known) and len(known) >= 1 << most:
                    raise EOFError("a code that is not there yet")
                entry = known[code] if code < len(known) else before + before[:1]
                if len(known) < 1 << most:
                    known.append(before + entry[:1])
            out.append(entry)
            before = entry
            if len(known) >= 1 << width and width < most:
                width += 1
                break  # the width changes with a group
        if len(out) > 4096:
            yield b"".join(out)
            out = []
    yield b"".join(out)


STREAMS = {
    "lz4": lambda f: _Pieces(_lz4(f)), "Z": lambda f: _Pieces(_compress(f)),
    "gz": lambda f: gzip.GzipFile(fileobj=f), "xz": lzma.LZMAFile, "lzma": lzma.LZMAFile, "bz2": bz2.BZ2File, "zst": lambda f: zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True),
}
_BROKEN = (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError, zipfile.BadZipFile, tarfile.TarError, NotImplementedError, RuntimeError, KeyError)


def detect(data: bytes) -> str | None:
    """zip, 7z, rar, zst, gz, xz, bz2, lz4, Z (compress), lzma, ar, cpio or tar by the first 512 bytes."""
    for prefix, kind in SIGNATURES:
        if data.startswith(prefix):
            return kind
    return "tar" if data[257:262] == b"ustar" else None


Found = tuple[Entry, Callable[[], io.IOBase] | None]


def _guarded(kind: str, found: Iterator[Found]) -> Iterator[Found]:
    try:
        yield from found
    except FormatError:
        raise
    except _BROKEN as e:
        raise FormatError(f"{kind}: {e}") from None


def _zip(f) -> Iterator[Found]:
    with zipfile.ZipFile(f) as z:
        for i in z.infolist():
            stamp = calendar.timegm((*i.date_time, 0, 0, 0))
            yield Entry(i.filename.rstrip("/"), b"", i.is_dir(), stamp, i.external_attr >> 16 & 0o7777, i.file_size), None if i.is_dir() else lambda i=i: z.open(i)


def _tar(f) -> Iterator[Found]:
    with tarfile.open(fileobj=f, mode="r|") as t:
        for m in t:
            if m.isfile() or m.isdir():
                yield Entry(m.name, b"", m.isdir(), int(m.mtime), m.mode, m.size if m.isfile() else 0), None if m.isdir() else lambda m=m: t.extractfile(m)


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise EOFError("cut off")
    return data


class _Part(io.RawIOBase):
    """The next n bytes of a stream."""

    def __init__(self, f, n: int):
        self.f, self.left = f, n

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self.left)
        if n:
            data = self.f.read(n)
            if not data:
                raise EOFError("cut off")
            n = len(data)
            buffer[:n] = data
            self.left -= n
        return n

    def skip(self) -> None:
        while self.left and self.read(1 << 20):
            pass


def _ar(f) -> Iterator[Found]:
    """System V and BSD forms: 60-byte heads, long names in a table or before the data, even places."""
    _exactly(f, 8)
    names = b""
    while head := f.read(60):
        if len(head) < 60 or head[58:] != b"`\n":
            raise EOFError("no head of an entry")
        name, size = head[:16].rstrip(), int(head[48:58])
        odd = size % 2
        if name == b"//":
            names = _exactly(f, size)
        elif name in (b"/", b"__.SYMDEF", b"/SYM64/"):
            _exactly(f, size)
        else:
            if name.startswith(b"#1/"):
                n = int(name[3:])
                name, size = _exactly(f, n).rstrip(b"\0"), size - n
            elif name.startswith(b"/"):
                name = names[int(name[1:]) :].partition(b"\n")[0]
            part = _Part(f, size)
            yield Entry(name.rstrip(b"/").decode(errors="replace"), b"", False, int(head[16:28].strip() or 0), int(head[40:48].strip() or b"644", 8) & 0o7777, size), lambda part=part: part
            part.skip()
        if odd:
            f.read(1)


def _cpio(f) -> Iterator[Found]:
    """The portable forms, with numbers in octal or hexadecimal digits."""
    while True:
        magic = _exactly(f, 6)
        if magic == b"070707":
            v = [int(_exactly(f, n), 8) for n in (6, 6, 6, 6, 6, 6, 6, 11, 6, 11)]
            mode, mtime, n_name, size, align = v[2], v[7], v[8], v[9], 1
            head = 76
        elif magic in (b"070701", b"070702"):
            v = [int(_exactly(f, 8), 16) for _ in range(13)]
            mode, mtime, size, n_name, align = v[1], v[5], v[6], v[11], 4
            head = 110
        else:
            raise EOFError("no head of an entry")
        name = _exactly(f, n_name).rstrip(b"\0").decode(errors="replace")
        f.read(-(head + n_name) % align)
        if name == "TRAILER!!!":
            return
        part = _Part(f, size)
        kind = mode & 0o170000
        if kind in (0o100000, 0o040000):
            yield Entry(name.removeprefix("./"), b"", kind == 0o040000, mtime, mode & 0o7777, size), (lambda part=part: part) if kind == 0o100000 else None
        part.skip()
        f.read(-size % align)


def walk(f, size: int, name: str = "data", password: str | None = None, magic: bytes = container.MAGIC) -> Iterator[Found]:
    """(entry without data, what opens its data) of a container or a standard archive, of which only what is asked for is held; data must be read before the next entry is taken.

    A container holds a bundle or a file; a compressed stream holds a tar file or a file.
    """
    head = f.read(512)
    f.seek(0)
    own = head.startswith(magic)
    kind = "container" if own else detect(head)
    if own or kind in STREAMS:
        try:
            inner = container.ContentFile(f, size, password, magic) if own else STREAMS[kind](f)
            inner = io.BufferedReader(inner, 1 << 20) if not isinstance(inner, io.BufferedReader) else inner
            first = inner.peek(512)[:512] if own or kind != "zst" else b""
        except FormatError:
            raise
        except _BROKEN as e:
            raise FormatError(f"{kind}: {e}") from None
        if (own and inner.raw.h.bundle) or detect(first) == "tar":
            yield from _guarded(kind, _tar(inner))
        else:
            entry = Entry(inner.raw.h.name or "data", mtime=inner.raw.h.created) if own else Entry(re.sub(rf"\.{kind}$", "", name.rpartition("/")[2]) or "data")
            yield entry, lambda: inner
        return
    readers = {"zip": _zip, "tar": _tar, "ar": _ar, "cpio": _cpio}
    if kind not in readers:
        raise FormatError(f"no reader for {kind}" if kind else "no archive")
    yield from _guarded(kind, readers[kind](f))


def _whole(found: Iterator[Found]) -> Iterator[Entry]:
    for e, opened in found:
        try:
            data = b"" if opened is None else opened().read()
        except FormatError:
            raise
        except _BROKEN as x:
            raise FormatError(str(x)) from None
        yield replace(e, data=data, size=len(data))


def unpack(data: bytes, name: str = "data") -> Iterator[Entry]:
    """Entries of a standard archive, a tar under a stream compression, or one compressed stream."""
    return _whole(walk(io.BytesIO(data), len(data), name, magic=b"\0none"))


def compress_bundle(entries: list[Entry], **options) -> bytes:
    return container.write(tar_write(entries), bundle=True, **options)


def extract(data: bytes, password: str | None = None, magic: bytes = container.MAGIC, name: str = "data") -> Iterator[Entry]:
    """Entries of a container (bundle or single file) or of a standard archive."""
    return _whole(walk(io.BytesIO(data), len(data), name, password, magic))


# --- archives as files: nothing but a piece of an entry is held -----------------------------------

_PIECE = 1 << 20


def open_logical(path: str):
    """(file, size) of a mounted file, or of the volumes of a series if the path names one of them."""
    if re.search(r"\.\d{3}$", path):
        f = VolumeFile(series(path))
        return io.BufferedReader(f, _PIECE), f.ends[-1]
    return open(path, "rb"), os.path.getsize(path)


def series(path: str) -> list[str]:
    """The volumes of the series that a volume belongs to, from 001 to the first gap."""
    base, k, out = path[:-4], 1, []
    while os.path.exists(p := f"{base}.{k:03d}"):
        out.append(p)
        k += 1
    if path not in out:
        raise FileNotFoundError(f"{path} stands behind a gap")
    return out


def extract_file(path: str, folder: str, force: bool = False, password: str | None = None, magic: bytes = container.MAGIC, reader=None) -> Iterator[dict]:
    """Writes the entries of an archive below a folder; (archive, path, status, size).  Nothing leaves the folder, links in it are not followed, and nothing is overwritten without `force`."""
    f, size = (reader, reader.raw.ends[-1]) if reader is not None else open_logical(path)
    row = {"archive": path, "path": None, "status": "written", "size": 0}
    with f:
        try:
            for e, opened in walk(f, size, re.sub(r"\.\d{3}$", "", path), password, magic):
                status = _put(e, opened, folder, force)
                yield row | {"path": e.path, "status": status, "size": e.size}
        except (FormatError, *_BROKEN) as x:
            yield row | {"status": str(x)}


def _put(e: Entry, opened, folder: str, force: bool) -> str:
    if not safe_rel_path(e.path):
        return "unsafe path"
    to = os.path.join(folder, e.path)
    above = to if e.is_dir else os.path.dirname(to)
    if os.path.realpath(above) != os.path.normpath(os.path.join(os.path.realpath(folder), os.path.relpath(above, folder))):
        return "a link stands in the way"
    os.makedirs(above, exist_ok=True)
    if e.is_dir:
        return "written"
    if os.path.lexists(to) and not force:
        return "exists"
    part = f"{to}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as out, opened() as src:
            while piece := src.read(_PIECE):
                out.write(piece)
        os.replace(part, to)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return "written"


def test_file(path: str, password: str | None = None, magic: bytes = container.MAGIC) -> dict:
    """(archive, ok, n_entries, n_bytes, error) of an archive or a series of volumes: every block is read."""
    out = {"archive": path, "ok": True, "n_entries": 0, "n_bytes": 0, "error": None}
    try:
        f, size = open_logical(path)
        with f:
            for _, opened in walk(f, size, path, password, magic):
                out["n_entries"] += 1
                src = opened and opened()
                while src and (piece := src.read(_PIECE)):
                    out["n_bytes"] += len(piece)
    except (FormatError, *_BROKEN) as x:
        out |= {"ok": False, "error": str(x)}
    return out


TESTED = "archive string, ok boolean, n_entries bigint, n_bytes bigint, error string"
WRITTEN = "archive string, path string, status string, size bigint"
LISTED = "archive string, path string, is_dir boolean, size bigint, mtime bigint, mode int, error string"


def _each(paths: DataFrame, job: Callable[[str], Iterator[dict]], kind: str) -> DataFrame:
    """Runs job(path) -> rows on each mounted path (path), in batches of rows as they come."""
    schema = to_arrow_schema(T._parse_datatype_string(kind))

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                rows = iter(job(p))
                while held := list(itertools.islice(rows, 1000)):
                    yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | r for r in held], schema=schema)

    return paths.select("path").mapInArrow(run, kind)


def extract_files(paths: DataFrame, folder: str, force: bool = False, password: str | None = None, magic: bytes = container.MAGIC) -> DataFrame:
    return _each(paths, lambda p: _failing(p, lambda: extract_file(p, folder, force, password, magic), "status"), WRITTEN)


def test_files(paths: DataFrame, password: str | None = None, magic: bytes = container.MAGIC) -> DataFrame:
    return _each(paths, lambda p: [test_file(p, password, magic)], TESTED)


def list_files(paths: DataFrame, password: str | None = None, magic: bytes = container.MAGIC) -> DataFrame:
    """Entries without their data; a broken archive ends with a row that has an error."""

    def rows(p: str) -> Iterator[dict]:
        f, size = open_logical(p)
        with f:
            for e, _ in walk(f, size, p, password, magic):
                yield {"archive": p, "path": e.path, "is_dir": e.is_dir, "size": e.size, "mtime": e.mtime, "mode": e.mode, "error": None if safe_rel_path(e.path) else "unsafe path"}

    return _each(paths, lambda p: _failing(p, lambda: rows(p), "error"), LISTED)


def _failing(path: str, made: Callable[[], Iterator[dict]], column: str) -> Iterator[dict]:
    try:
        yield from made()
    except (FormatError, *_BROKEN) as x:
        yield {"archive": path, column: str(x)}


# --- volumes that hold an archive ----------------------------------------------------------------

#: How an archive is read: forwards, or by an index at its end.
LOGICAL = {"zip": "indexed", "7z": "indexed", "rar": "indexed", "gz": "stream", "bz2": "stream", "xz": "stream", "tar": "stream"}


def logical_kind(head: bytes, magic: bytes = container.MAGIC) -> str:
    """'stream', 'indexed', 'container' or '' by the first 512 bytes of the first volume."""
    return "container" if head.startswith(magic) else LOGICAL.get(detect(head) or "", "")


def logical_kind_of(head: Column) -> Column:
    """logical_kind() as an expression, without own containers."""
    kind = exprs.archive_kind(head)
    return F.when(kind.isin([k for k, v in LOGICAL.items() if v == "indexed"]), "indexed").when(kind.isin([k for k, v in LOGICAL.items() if v == "stream"]), "stream").otherwise("")


def preflight(paths: list[str], folder: str, keep_free: int = 0) -> tuple[int, int]:
    """(bytes that must be free to extract a series while its volumes are deleted, bytes that are): what the entries outgrow the volumes by, a reserve, and a margin."""
    f = VolumeFile(paths)
    with io.BufferedReader(f, _PIECE) as src:
        grown = sum(e.size for e, _ in walk(src, f.ends[-1], paths[0]))
    return max(0, grown - f.ends[-1]) + keep_free + KEEP_FREE, shutil.disk_usage(folder).free


def extract_multipart(path: str, folder: str, in_place: bool = False, keep_free: int = 0, force: bool = False, password: str | None = None, magic: bytes = container.MAGIC) -> list[dict]:
    """Extracts the archive in a series of volumes; rows (archive, path, status, size).

    With `in_place` volumes are deleted as soon as what they hold is written and KEEP_FREE bytes more are read, and the rest at the end; it needs an archive that is read forwards and room for what it grows by, which is
    seen to before anything is deleted.  This deletes data, so it runs on the driver, once.
    """
    paths = series(path)
    with open(paths[0], "rb") as f:
        kind = logical_kind(f.read(512), magic)
    if not kind:
        raise FormatError("the volumes hold no archive that is known")
    if in_place and kind != "stream":
        raise FormatError("in place only archives that are read forwards can be extracted")
    os.makedirs(folder, exist_ok=True)
    if in_place:
        need, have = preflight(paths, folder, keep_free)
        if have < need:
            raise FormatError(f"{need >> 20} MiB must be free, {have >> 20} MiB are")
    f = VolumeFile(paths, reclaim=in_place)
    out = list(extract_file(path, folder, force, password, magic, io.BufferedReader(f, _PIECE)))
    if in_place and all(r["status"] == "written" for r in out):
        for p in paths[f.gone :]:
            os.remove(p)
    return out


def entries(archives: DataFrame, password: str | None = None, magic: bytes = container.MAGIC, with_data: bool = True) -> DataFrame:
    """ENTRY rows of all archives in a table (path, content).  A broken archive ends with a row that has an error; unsafe paths have one too, and no data."""

    def scan(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for e in extract(data or b"", password, magic, path or "data"):
                        bad = None if safe_rel_path(e.path) else "unsafe path"
                        rows.append({"archive": path, "path": e.path, "is_dir": e.is_dir, "size": len(e.data), "mtime": e.mtime, "mode": e.mode, "data": e.data if with_data and not bad else None, "error": bad})
                except FormatError as x:
                    rows.append({"archive": path, "error": str(x)})
                yield pa.RecordBatch.from_pylist([dict.fromkeys(_ENTRY.names) | r for r in rows], schema=_ENTRY)

    return archives.select("path", "content").mapInArrow(scan, ENTRY)


def test_archives(archives: DataFrame, password: str | None = None, magic: bytes = container.MAGIC) -> DataFrame:
    """(archive, ok, n_entries, error): every block is read."""
    found = entries(archives, password, magic, with_data=False)
    return found.groupBy("archive").agg((F.count("error") == 0).alias("ok"), F.count(F.when(F.col("path").isNotNull(), 1)).alias("n_entries"), F.min("error").alias("error"))


def write_entries(found: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """Writes entries (archive, path, is_dir, data, error) below a folder that all executors mount; (archive, path, status)."""

    def put(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                entry = Entry(r["path"] or "", b"", bool(r["is_dir"]))
                status = r["error"] or _put(entry, lambda r=r: io.BytesIO(r["data"] or b""), folder, force)
                out.append({"archive": r["archive"], "path": r["path"], "status": status})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("archive", pa.string()), ("path", pa.string()), ("status", pa.string())]))

    return found.mapInArrow(put, "archive string, path string, status string")


# --- volumes ------------------------------------------------------------------------------------

MIN_PART, MOST_PARTS, KEEP_FREE = 1024, 999, 16 << 20


def volumes_of(sizes: DataFrame, part_size: int) -> DataFrame:
    """(file_id, num, name, start, end) of the volumes of files (file_id, name, size): three digits from 001, one for an empty file."""
    if part_size < MIN_PART:
        raise ValueError("a part has 1 KiB at least")
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / part_size)).cast("int")
    out = sizes.withColumn("n", n).withColumn("num", F.explode(F.sequence(F.lit(1), "n")))
    start = ((F.col("num") - 1) * F.lit(part_size).cast("bigint")).cast("bigint")
    return out.select("file_id", "num", F.format_string("%s.%03d", "name", "num").alias("name"), start.alias("start"), F.least(F.col("size"), start + part_size).alias("end"), (F.col("n") <= MOST_PARTS).alias("allowed"))


def split(files: DataFrame, part_size: int) -> DataFrame:
    """(file_id, num, data): contents (file_id, content) in parts."""
    from ..operators.pipeline import split_chunks

    return split_chunks(files, part_size).select("file_id", (F.col("chunk_id") + 1).alias("num"), "data")


def join(parts: DataFrame) -> DataFrame:
    """(file_id, content, error) of parts (file_id, num, data) in order; a missing part is an error."""
    from ..operators.pipeline import join_chunks

    return join_chunks(parts.select("file_id", (F.col("num") - 1).cast("int").alias("chunk_id"), "data", F.lit(None).cast("string").alias("error")))


def volume_sets(paths: DataFrame, path: str = "path") -> DataFrame:
    """(base, num, path) of the volumes that count: of each base those from 001 up to the first gap."""
    out = paths.select(F.col(path).alias("path"), F.regexp_extract(path, r"^(.*)\.(\d{3})$", 1).alias("base"), F.regexp_extract(path, r"^(.*)\.(\d{3})$", 2).alias("digits")).where("digits <> ''")
    out = out.withColumn("num", F.col("digits").cast("int")).where("num > 0")
    return out.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("num"))).where("k = num").select("base", "num", "path")


def volume_lookup(volumes: DataFrame, offsets: DataFrame) -> DataFrame:
    """(file_id, offset, num): the volume that holds each offset.  Equal parts make the volume's number a quotient, so the range join is an equi join."""
    size = volumes.groupBy("file_id").agg(F.max(F.col("end") - F.col("start")).alias("part"))
    at = offsets.join(size, "file_id").withColumn("num", (F.floor(F.col("offset") / F.greatest("part", F.lit(1))) + 1).cast("int"))
    return at.join(volumes, ["file_id", "num"]).where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end"))).select("file_id", "offset", "num")


class VolumeFile(io.RawIOBase):
    """A file-like view over volumes.  `reclaim` deletes volumes that lie behind the read position; use it on the driver only, after the output is committed."""

    def __init__(self, paths: list[str], reclaim: bool = False):
        self.paths, self.reclaim, self.at = paths, reclaim, 0
        self.sizes = [os.path.getsize(p) for p in paths]
        self.ends = [sum(self.sizes[: k + 1]) for k in range(len(paths))]
        self.gone = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.at, self.ends[-1] if self.ends else 0)[whence]
        if self.gone and to < self.ends[self.gone - 1]:
            raise OSError("that volume is reclaimed")
        self.at = max(0, to)
        return self.at

    def readinto(self, buffer) -> int:
        """Fills the buffer across volumes, as far as there are bytes."""
        view, done = memoryview(buffer), 0
        while done < len(view) and (k := bisect.bisect_right(self.ends, self.at)) < len(self.paths):
            with open(self.paths[k], "rb") as f:
                f.seek(self.at - (self.ends[k] - self.sizes[k]))
                n = f.readinto(view[done : done + self.ends[k] - self.at])
            self.at, done = self.at + n, done + n
        while self.reclaim and done and self.gone < len(self.paths) and self.ends[self.gone] + KEEP_FREE <= self.at:
            os.remove(self.paths[self.gone])
            self.gone += 1
        return done
