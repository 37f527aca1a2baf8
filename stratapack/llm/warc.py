"""WARC records: responses, the derivatives built from them, and a reader and writer of the format.

The derivative builder turns a response into two linked records: a `metadata` record (application/warc-fields) with the source's
HTTP status, headers and digests, and a `conversion` record with the plain text of the payload.  Both refer to the response
(WARC-Refers-To with its id, target and date); the metadata record names the conversion as concurrent.

Records are rows; building them is one scan without a shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .html_extraction import Page
from .common import table

VERSION = "WARC/1.1"
RECORD = (
    "record_id string, type string, target_uri string, date string, refers_to string, refers_to_uri string, refers_to_date string, concurrent_to string, "
    "content_type string, payload_digest string, block_digest string, content_length bigint, headers map<string,string>, block binary"
)
_FIELDS = [x.split(" ")[0] for x in RECORD.split(", ")]
#: Named header fields of a row, in the order in which they are written (fixed values of the format).
_NAMES = {
    "type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "refers_to_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date", "concurrent_to": "WARC-Concurrent-To",
    "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest", "content_type": "Content-Type", "content_length": "Content-Length",
}
_ARROW = pa.schema(
    [(f, pa.int64() if f == "content_length" else pa.map_(pa.string(), pa.string()) if f == "headers" else pa.binary() if f == "block" else pa.string()) for f in _FIELDS]
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str | None) -> str:
    """An id that depends on its parts only, so a repeated task gives the same record again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join('' if p is None else p for p in parts))}>"


def _row(**fields) -> dict:
    out = dict.fromkeys(_FIELDS) | fields
    out["block_digest"], out["content_length"] = digest(out["block"]), len(out["block"])
    return out


def response(key: str, uri: str | None, body: bytes, date: str, content_type: str = "text/html; charset=utf-8") -> dict:
    """A response record with an HTTP block."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return _row(record_id=record_id("response", key, uri, hashlib.sha256(body).hexdigest()), type="response", target_uri=uri, date=date, content_type="application/http;msgtype=response", payload_digest=digest(body), block=head + body)


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of an HTTP message; a block without a head is all body."""
    m = re.match(rb"(HTTP/[^\r\n]*)\r?\n((?:[^\r\n]+\r?\n)*)\r?\n", block)
    if not m:
        return "", [], block
    lines = re.sub(rb"\r?\n[ \t]+", b" ", m[2]).decode("latin-1").splitlines()
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
    return m[1].decode("latin-1"), headers, _decoded(block[m.end() :], headers)


def _decoded(body: bytes, headers: list[tuple[str, str]]) -> bytes:
    """A body without chunks, gzip, deflate and zstd; of a damaged one what stands before the damage.  Other codings stay, and so does a body that isn't coded as its headers say."""
    codings = [c.strip().lower() for name in ("content-encoding", "transfer-encoding") for k, v in headers if k.lower() == name for c in v.split(",")]
    for c in reversed(codings):
        if c == "chunked":
            out, at = [], 0
            while (m := re.compile(rb"\s*([0-9a-fA-F]{1,15})[^\r\n]*\r?\n").match(body, at)) and (n := int(m[1], 16)):
                out.append(body[m.end() : m.end() + n])
                at = m.end() + n
            body = b"".join(out) if out or m else body
        elif c in ("gzip", "x-gzip") and body[:2] == b"\x1f\x8b":
            body = _members(body)[0]
        elif c == "deflate":
            for bits in (15, -15):
                try:
                    body = zlib.decompressobj(bits).decompress(body)
                    break
                except zlib.error:
                    continue
        elif c == "zstd" and body[:4] == b"\x28\xb5\x2f\xfd":
            try:
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            except zstandard.ZstdError:
                break
        elif c not in ("identity", "", "gzip", "x-gzip", "zstd"):
            break
    return body


def _members(data: bytes) -> tuple[bytes, str | None]:
    """The content of gzip members up to the first damage, and what the damage is."""
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        if data[at] == 0 and not data[at:].strip(b"\0"):  # padding
            break
        d = zlib.decompressobj(31)
        try:
            while not d.eof:
                if at >= len(data):
                    return b"".join(out), "the last member is cut"
                piece = view[at : at + 65536]
                out.append(d.decompress(piece))
                at += len(piece) - len(d.unused_data)
        except zlib.error as e:
            return b"".join(out), str(e)
    return b"".join(out), None


def plain_text(body: bytes, content_type: str) -> str:
    """Text of a payload: all blocks of an HTML page outside scripts, styles and the head; other text as it is."""
    charset = re.search(r"charset=[\"']?([\w.:-]+)", content_type, re.I)
    try:
        source = body.decode(charset[1] if charset else "utf-8", errors="replace")
    except LookupError:
        source = body.decode("utf-8", errors="replace")
    if "html" not in content_type.lower():
        return source
    return "\n".join(text for _, text, _ in Page(source).blocks)


def derive(source: dict) -> list[dict]:
    """The metadata and conversion records of a response; other records have none."""
    if source["type"] != "response":
        return []
    status, headers, body = http(source["block"] or b"")
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    link = {"target_uri": source["target_uri"], "date": source["date"], "refers_to": source["record_id"], "refers_to_uri": source["target_uri"], "refers_to_date": source["date"]}
    converted = _row(**link, record_id=record_id("conversion", source["record_id"]), type="conversion", content_type="text/plain; charset=utf-8", block=plain_text(body, kind).encode(errors="replace"))
    converted["payload_digest"] = converted["block_digest"]
    fields = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers), ("source-payload-digest", source["payload_digest"] or digest(body)), ("source-block-digest", source["block_digest"] or digest(source["block"] or b"")), ("source-length", str(len(source["block"] or b""))), ("conversion-id", converted["record_id"]), ("conversion-digest", converted["block_digest"])]
    block = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    made = _row(**link, record_id=record_id("metadata", source["record_id"]), type="metadata", concurrent_to=converted["record_id"], content_type="application/warc-fields", block=block)
    for r in (made, converted):
        r["headers"] = _map(headers)
    return [made, converted]


def _map(fields: list[tuple[str, str]]) -> dict[str, str]:
    """Fields by name; the values of a repeated field are joined by commas, as HTTP has it."""
    out: dict[str, str] = {}
    for k, v in fields:
        out[k] = f"{out[k]}, {v}" if k in out else v
    return out


def _batches(rows: Iterator[dict], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most about `limit` bytes of blocks."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["block"] or b"")
        if size >= limit or len(held) >= 5000:
            yield pa.RecordBatch.from_pylist([_pairs(x) for x in held], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([_pairs(x) for x in held], schema=_ARROW)


def _pairs(r: dict) -> dict:
    return r | {"headers": None if r["headers"] is None else list(r["headers"].items())}


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record for each page.  A null page is an empty payload; a null URL gives a record without a target."""

    def scan(batches):
        for batch in batches:
            ids, urls, texts = (batch.column(k).to_pylist() for k in range(3))
            yield from _batches(response(str(i), u, (t or "").encode(errors="replace"), date) for i, u, t in zip(ids, urls, texts, strict=True))

    return pages.select(F.col(page_id).cast("bigint"), F.col(url).cast("string"), F.col(source).cast("string")).mapInArrow(scan, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all response records; other types give none.

    A null block counts as empty, missing digests are computed.  Ids follow from the response's id, so a
    repeated response gives repeated derivatives, and an interrupted task the same ones again.  Further columns are ignored.
    """

    def scan(batches):
        for batch in batches:
            for k in range(0, len(batch), 500):
                yield from _batches(r for x in batch.slice(k, 500).to_pylist() for r in derive(x | {"headers": None}))

    return records.where("type = 'response'").select(*_FIELDS).mapInArrow(scan, RECORD)


# --- the format ---------------------------------------------------------------------------------


def write_record(r: dict) -> bytes:
    """One record as a gzip member, without a time stamp: equal records give equal bytes."""
    head = "".join(f"{name}: {r[f]}\r\n" for f, name in _NAMES.items() if r.get(f) is not None)
    return gzip.compress(f"{VERSION}\r\n{head}\r\n".encode() + (r["block"] or b"") + b"\r\n\r\n", mtime=0)


_HEAD = re.compile(rb"\s*WARC/[\d.]+\r?\n((?:[^\r\n]+\r?\n)*)\r?\n")
_MEMBER = b"\x1f\x8b\x08"
_PIECE = 1 << 16
#: A head that is longer is no head.
_LONGEST_HEAD = 1 << 20


class _Source:
    """Bytes of a file from a place on, as they are or decompressed, with a place to look ahead."""

    def __init__(self, file, at: int = 0, packed: bool | None = None):
        self.file, self.held, self.damage, self.ended = file, bytearray(), None, False
        file.seek(at)
        self.packed = file.read(2) == b"\x1f\x8b" if packed is None else packed
        file.seek(at)
        self.at = at
        self._inflate, self._raw = None, b""

    def _more(self) -> bool:
        """Takes a further piece; False at the end or at a damage."""
        if not self.packed:
            piece = self.file.read(_PIECE)
            self.held += piece
            return bool(piece)
        while True:
            if not self._raw:
                self._raw = self.file.read(_PIECE)
                if not self._raw:
                    if self._inflate is not None:
                        self.damage = "the last member is cut"
                    return False
            if self._inflate is None:
                if not self._raw.strip(b"\0"):  # padding
                    self._raw = b""
                    continue
                self._inflate = zlib.decompressobj(31)
            try:
                out = self._inflate.decompress(self._raw)
            except zlib.error as e:
                self.damage = str(e)
                return False
            self._raw = self._inflate.unused_data if self._inflate.eof else b""
            if self._inflate.eof:
                self._inflate = None
            self.held += out
            if out:
                return True

    def need(self, n: int) -> bool:
        while len(self.held) < n and not self.ended:
            self.ended = not self._more()
        return len(self.held) >= n

    def drop(self, n: int) -> None:
        del self.held[:n]


def _records(source: _Source) -> Iterator[dict]:
    """Records of a source; one record is held at a time.  `source.damage` says why there are no more, if that is not the end."""
    fields = {v.lower(): k for k, v in _NAMES.items()}
    while True:
        m = _HEAD.match(source.held)
        while not m and not source.ended and len(source.held) <= _LONGEST_HEAD:
            source.need(max(1 << 12, 2 * len(source.held)))
            m = _HEAD.match(source.held)
        if not m:
            if bytes(source.held).strip():
                source.damage = source.damage or "not a record"
            return
        named = _map([(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in m[1].decode("utf-8", errors="replace").splitlines())])
        length = named.get("content-length", "0") or "0"
        if not re.fullmatch(r"\d{1,18}", length):
            source.damage = f"impossible length {length[:40]}"
            return
        n, start = int(length), m.end()
        out = dict.fromkeys(_FIELDS) | {fields[k]: v for k, v in named.items() if k in fields}
        out["headers"] = {k: v for k, v in named.items() if k not in fields}
        if not source.need(start + n):
            source.damage = source.damage or "the last record is cut"
            return
        out["block"], out["content_length"] = bytes(source.held[start : start + n]), n
        source.drop(start + n)
        yield out


def _error(what: str) -> dict:
    return dict.fromkeys(_FIELDS) | {"type": "error", "headers": {"error": what}}


def read_records(data: bytes, errors: bool = False) -> Iterator[dict]:
    """Records of a WARC file, compressed or not; what follows a broken record or gzip member is not read.  With `errors` a last row of type 'error' tells so, with header 'error'."""
    source = _Source(io.BytesIO(data))
    yield from _records(source)
    if errors and source.damage:
        yield _error(source.damage)


def _is_member(file, at: int) -> bool:
    """Whether a gzip member with a record begins at a place."""
    file.seek(at)
    try:
        begin = zlib.decompressobj(31).decompress(file.read(_PIECE), 16)
    except zlib.error:
        return False
    return begin.lstrip().startswith(b"WARC/")


def _member_starts(file, first: int, last: int) -> Iterator[int]:
    """Places from `first` up to `last` at which a gzip member with a record begins."""
    at, held = first, b""
    while at < last:
        file.seek(at)
        held = file.read(1 << 20)
        found = -1
        while (found := held.find(_MEMBER, found + 1)) >= 0 and at + found < last:
            if _is_member(file, at + found):
                yield at + found
        if len(held) < 3:
            return
        at += len(held) - 2


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, whole: bool):
        self.path, self.first, self.last, self.whole = path, first, last, whole


class WarcFiles(DataSource):
    """`spark.read.format('warc')`: records of the files under `path`, a folder that all executors mount; option `split_bytes`.

    A compressed file is read by many tasks: each takes the gzip members that begin in its range.  A file without members of its own for the records, or without compression, is read by one
    task, which holds one record at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _WarcReader(dict(self.options))


class _WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.split = options["path"].removeprefix("file://"), int(options.get("split_bytes", 64 << 20))

    def partitions(self):
        names = [self.root] if os.path.isfile(self.root) else sorted(os.path.join(d, n) for d, _, ns in os.walk(self.root) for n in ns if not n.startswith((".", "_")))
        out = []
        for p in names:
            size = os.path.getsize(p)
            with open(p, "rb") as f:
                split = _several_members(f)
            out += [_Range(p, a, min(a + self.split, size), False) for a in range(0, size, self.split)] if split else [_Range(p, 0, size, True)]
        return out or [_Range("", 0, 0, True)]

    def read(self, part: _Range):
        if not part.path:
            return
        with open(part.path, "rb") as f:
            yield from _batches(self._rows(f, part))

    def _rows(self, f, part: _Range) -> Iterator[dict]:
        if part.whole:
            source = _Source(f)
            yield from _records(source)
            if source.damage:
                yield _error(source.damage)
            return
        for at in _member_starts(f, part.first, part.last):
            member = _Member(f.name, at)
            source = _Source(member, 0, True)
            yield from _records(source)
            if source.damage:
                yield _error(f"{source.damage} (member at {at})")
            elif not _is_member(f, member.end):
                f.seek(member.end)
                if f.read(_PIECE).strip(b"\0"):
                    yield _error(f"no record at {member.end}")


class _Member(io.RawIOBase):
    """The bytes of one gzip member of a file."""

    def __init__(self, path: str, at: int):
        self.file, self.inflate = open(path, "rb"), zlib.decompressobj(31)  # noqa: SIM115
        self.file.seek(at)
        self.done, self.end = False, at

    def seek(self, at: int, whence: int = 0) -> int:
        return at

    def read(self, n: int = -1) -> bytes:
        """A further piece, up to the member's end."""
        if self.done:
            return b""
        piece = self.file.read(_PIECE)
        try:
            self.inflate.decompress(piece)
        except zlib.error:
            self.done = True  # the reader finds the damage itself
            return piece
        if self.inflate.eof:
            self.done = True
            piece = piece[: len(piece) - len(self.inflate.unused_data)]
        self.end += len(piece)
        if self.done or not piece:
            self.file.close()
        return piece


def _several_members(f) -> bool:
    """Whether a file's first gzip member ends early, so that others follow."""
    if f.read(2) != b"\x1f\x8b":
        return False
    f.seek(0)
    inflate = zlib.decompressobj(31)
    for _ in range(1 << 10):
        piece = f.read(_PIECE)
        try:
            inflate.decompress(piece)
        except zlib.error:
            return False
        if inflate.eof:
            return bool(inflate.unused_data.strip(b"\0") or f.read(1))
        if not piece:
            return False
    return False


def read_warc(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Rows of the WARC files under a path, and a row of type 'error' for what couldn't be read.

    Files on a folder that all executors mount are read in ranges, whatever their size.  Others come through Spark's own reader, a file in a row (2 GB at most).
    """
    if os.path.exists(path.removeprefix("file://")):
        spark.dataSource.register(WarcFiles)
        return spark.read.format("warc").option("path", path).option("split_bytes", split_bytes).load()

    def scan(batches):
        for batch in batches:
            for data in batch.column(0):
                yield from _batches(read_records(data.as_py(), errors=True))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, RECORD)


def write_warc(records: DataFrame, folder: str) -> None:
    """Writes a part file for each partition to a folder that all executors mount; a repeated task replaces its file whole."""
    os.makedirs(folder, exist_ok=True)

    def write(batches):
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        with open(temporary := f"{name}.{uuid.uuid4().hex}", "wb") as f:
            n = 0
            for batch in batches:
                for r in batch.to_pylist():
                    n += f.write(write_record(r))
        os.replace(temporary, name)
        yield pa.record_batch([pa.array([name]), pa.array([n])], names=["file", "n_bytes"])

    records.select(*_FIELDS).mapInArrow(write, "file string, n_bytes bigint").collect()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivative records of all pages' responses, with their texts and links."""
    out = derivatives(responses(table(spark, sf_dir, "pages")))
    return out.select("record_id", "type", "target_uri", "refers_to", "refers_to_uri", "refers_to_date", "concurrent_to", "content_type", "payload_digest", "block_digest", "content_length", F.decode("block", "UTF-8").alias("content"))


#: A SHA-1 in hexadecimal digits as base32: 20 bits at a time.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr({0}, 5 * (k // 4)::INTEGER + 1, 5))::INTEGER >> (15 - 5 * (k % 4))::INTEGER) % 32 + 1, 1)), '')"
#: A name-based identifier from the SHA-1 of the namespace of URLs and a name.
_UUID = "'<urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-5' || substr({0}, 14, 3) || '-' || substr('89ab', ('0x' || substr({0}, 17, 1))::INTEGER % 4 + 1, 1) || substr({0}, 18, 3) || '-' || substr({0}, 21, 12) || '>'"
_SHA1_NAME = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({0}))"

#: States the result for pages of the test tables' form: their elements and character references.
OP9_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS i, page_id, url, coalesce(html, '') AS body FROM pages
), r AS (
  SELECT *, octet_length(encode(body)) AS n, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(body)) || chr(13) || chr(10) || chr(13) || chr(10) || body AS block,
         {_SHA1_NAME.format("'response' || chr(31) || page_id || chr(31) || coalesce(url, '') || chr(31) || sha256(body)")} AS h FROM p
), x AS (
  SELECT i, string_split_regex(regexp_replace(regexp_replace(body, '(?s)<title>.*?</title>|<style>.*?</style>|<script>.*?</script>|<!--.*?-->', '', 'g'), '<br>', ' ', 'g'),
    '</?(?:html|head|body|nav|ul|li|article|h1|h2|p|footer|div)(?:\s[^>]*)?>|<meta[^>]*>') AS blocks FROM p
), t AS (
  SELECT i, array_to_string(list_filter(list_transform(blocks, lambda b: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(b, '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text FROM x
), ids AS (
  SELECT i, {_UUID.format("h")} AS response_id FROM r
), made AS (
  SELECT i, response_id, {_SHA1_NAME.format("'conversion' || chr(31) || response_id")} AS c, {_SHA1_NAME.format("'metadata' || chr(31) || response_id")} AS m FROM ids
), told AS (
  SELECT i, response_id, {_UUID.format("c")} AS conversion_id, {_UUID.format("m")} AS metadata_id FROM made
), sums AS (
  SELECT i, what, 'sha1:' || {_BASE32.format("h")} AS digest FROM (
    SELECT i, 'payload' AS what, sha1(encode(body)) AS h FROM r UNION ALL SELECT i, 'block', sha1(encode(block)) FROM r UNION ALL SELECT i, 'text', sha1(encode(text)) FROM t)
), w AS (
  SELECT r.i, url, response_id, conversion_id, metadata_id, text, a.digest AS text_digest,
    'source-status: HTTP/1.1 200 OK' || chr(13) || chr(10) || 'source-header-content-type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-header-content-length: ' || n || chr(13) || chr(10)
    || 'source-payload-digest: ' || b.digest || chr(13) || chr(10) || 'source-block-digest: ' || c.digest || chr(13) || chr(10) || 'source-length: ' || octet_length(encode(block)) || chr(13) || chr(10)
    || 'conversion-id: ' || conversion_id || chr(13) || chr(10) || 'conversion-digest: ' || a.digest || chr(13) || chr(10) AS fields
  FROM r JOIN t USING (i) JOIN told USING (i) JOIN sums a ON a.i = r.i AND a.what = 'text' JOIN sums b ON b.i = r.i AND b.what = 'payload' JOIN sums c ON c.i = r.i AND c.what = 'block'
), f AS (
  SELECT *, sha1(encode(fields)) AS h FROM w
)
SELECT metadata_id AS record_id, 'metadata' AS type, url AS target_uri, response_id AS refers_to, url AS refers_to_uri, '2024-01-01T00:00:00Z' AS refers_to_date, conversion_id AS concurrent_to, 'application/warc-fields' AS content_type,
       NULL AS payload_digest, 'sha1:' || {_BASE32.format("h")} AS block_digest, octet_length(encode(fields))::BIGINT AS content_length, fields AS content FROM f
UNION ALL
SELECT conversion_id, 'conversion', url, response_id, url, '2024-01-01T00:00:00Z', NULL, 'text/plain; charset=utf-8', text_digest, text_digest, octet_length(encode(text))::BIGINT, text FROM f
"""
