"""Containers, archives and volumes: round trips, hostile input, safe paths."""

import dataclasses
import io
import random
import struct
import tarfile

import pytest

from stratapack.functions.bits import FormatError
from stratapack.sources import archives, container
from stratapack.sources.archives import Entry


def damaged(data, at, value, fmt="<I"):
    return data[:at] + struct.pack(fmt, value) + data[at + struct.calcsize(fmt) :]


DATA = b"".join(f"line {k % 97} of a text\n".encode() for k in range(9000))


@pytest.mark.parametrize("algo", ["store", "rle", "huffman", "lz77", "lzw", "bwt-mtf-ari", "delta-rle"])
def test_container(algo):
    for data in (b"", b"A", DATA[:30000]):
        out = container.write(data, algo, chunk_size=4096, name="notes.txt", detail="text", file_type=1, created=1700000000)
        h, back = container.read(out)
        assert back == data and (h.name, h.detail, h.created, h.orig_size) == ("notes.txt", "text", 1700000000, len(data))
        assert len(h.chunks) == max(1, -(-len(data) // 4096))


def test_layout():
    out = container.write(DATA, "huffman", chunk_size=65536)
    assert struct.unpack_from("<Q", out, 11)[0] == len(DATA) and struct.unpack_from("<I", out, 47)[0] == 3
    assert container.read(container.write(DATA, "rle", magic=b"OTHER"), magic=b"OTHER")[1] == DATA
    with pytest.raises(FormatError):
        container.read(container.write(DATA, "rle", magic=b"OTHER"))


def test_hostile_headers():
    good = container.write(DATA, "huffman", chunk_size=65536, name="n")
    for bad in (
        b"", good[:50], b"XXXXX" + good[5:], damaged(good, 5, 3, "<H"), damaged(good, 47, 0), damaged(good, 47, 0xFFFFFFFF), damaged(good, 39, 0, "<Q"), damaged(good, 39, (64 << 20) + 1, "<Q"),
        damaged(good, 39, 100, "<Q"), damaged(good, 11, len(DATA) + 1, "<Q"), damaged(good, 19, 1, "<Q"), damaged(good, 83, 0xFFFF, "<H"), damaged(damaged(good, 10, 1, "<B"), 51, 0xFFFFFFFF), good[:-1],
    ):
        with pytest.raises(FormatError):
            container.read(bad)
    rng = random.Random(1)
    for _ in range(200):
        bad = bytearray(good)
        at = rng.randrange(len(bad))
        bad[at] ^= 1 << rng.randrange(8)
        try:
            h, back = container.read(bytes(bad))
            assert back == DATA  # only fields that don't touch the content: level, type, times, names
        except (FormatError, KeyError):
            pass


def test_encryption():
    out = container.write(DATA, "huffman", chunk_size=16384, password="secret", iterations=1000)
    assert DATA[:40] not in out and container.read(out, "secret")[1] == DATA
    h, at = container.parse(out)
    for password, bad in ((None, out), ("wrong", out), ("secret", out[:-1] + bytes([out[-1] ^ 1])), ("secret", damaged(out, 27, 5)), ("secret", out[:55] + b"\xff" + out[56:])):
        with pytest.raises(FormatError):
            container.read(bad, password)
    first, second = h.chunks[0][1], h.chunks[1][1]
    if first == second:
        swapped = out[:at] + out[at + first : at + 2 * first] + out[at : at + first] + out[at + 2 * first :]
        with pytest.raises(FormatError):
            container.read(swapped, "secret")
    assert container.write(DATA, "rle", password="p", salt=b"s" * 16, nonce=b"n" * 12, iterations=10) == container.write(DATA, "rle", password="p", salt=b"s" * 16, nonce=b"n" * 12, iterations=10)


def test_version_1():
    from stratapack.functions.crypto import chacha20, chunk_nonce, derive_keys

    salt, nonce = b"\x11" * 16, b"\x22" * 12
    payload = chacha20(derive_keys("pw", salt, 1000, 1)[0], chunk_nonce(nonce, 0), DATA[:500])
    import zlib

    h = container.Header(version=1, flags=1, orig_size=500, comp_size=500, orig_crc=zlib.crc32(DATA[:500]), kdf_iterations=1000, salt=salt, nonce=nonce, payload_crc=zlib.crc32(payload), chunks=[(500, 500, 1)])
    assert container.read(h.pack() + payload, "pw")[1] == DATA[:500]
    assert dataclasses.replace(h).encrypted


TREE = [Entry("a.txt", b"alpha", mtime=1700000000), Entry("sub", is_dir=True, mode=0o755), Entry("sub/b.txt", DATA[:3000]), Entry("empty.bin", b""), Entry("n" * 180 + ".txt", b"long")]


@pytest.mark.parametrize("kind", archives.PACKERS)
def test_standard_archives(kind):
    got = {e.path: e for e in archives.unpack(archives.pack(TREE, kind))}
    assert {p: e.data for p, e in got.items()} == {e.path: e.data for e in TREE} and got["sub"].is_dir
    packed = archives.pack(TREE, kind)
    assert packed == archives.pack(TREE[::-1], kind)  # the order of a listing doesn't show
    assert archives.detect(packed) == {"zip": "zip", "tar": "tar", "tar.gz": "gz", "tar.xz": "xz", "tar.bz2": "bz2"}[kind]
    if kind != "tar":
        with pytest.raises(FormatError):
            list(archives.unpack(packed[: len(packed) // 2]))


def test_single_streams():
    import bz2
    import gzip
    import lzma

    import zstandard

    for name, data in (("x.gz", gzip.compress(DATA)), ("x.xz", lzma.compress(DATA)), ("x.bz2", bz2.compress(DATA)), ("x.zst", zstandard.ZstdCompressor().compress(DATA))):
        assert [(e.path, e.data) for e in archives.unpack(data, name)] == [("x", DATA)]
    for kind in ("7z", "rar"):
        with pytest.raises(FormatError):
            archives.pack(TREE, kind)


def test_bundle():
    for password in (None, "pw"):
        out = archives.compress_bundle(TREE, algo="huffman", password=password, iterations=100)
        got = {e.path: (e.data, e.is_dir, e.mtime) for e in archives.extract(out, password)}
        assert got == {e.path: (e.data, e.is_dir, e.mtime) for e in TREE}
    assert container.parse(archives.compress_bundle(TREE, algo="store"))[0].bundle


def test_paths():
    for p in ("", "/etc/x", "../x", "a/../b", "a/..", "C:x", "a\\b", "\\x", "a\0b"):
        assert not archives.safe_rel_path(p)
    for p in ("a", "a/b", "..a/b..", "a/...", "é"):
        assert archives.safe_rel_path(p)


def hostile_tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, kind in (("../escape.txt", tarfile.REGTYPE), ("ok.txt", tarfile.REGTYPE), ("link", tarfile.SYMTYPE)):
            info = tarfile.TarInfo(name)
            info.type, info.size, info.linkname = kind, 2 if kind == tarfile.REGTYPE else 0, "/etc/passwd"
            t.addfile(info, io.BytesIO(b"hi"))
    return out.getvalue()


def test_extraction_stays_inside(spark, tmp_path):
    found = archives.entries(spark.createDataFrame([("x.tar", bytearray(hostile_tar())), ("bad", bytearray(b"nothing")), ("none", None)], "path string, content binary"))
    to = tmp_path / "out"
    status = {(r.archive, r.path): r.status for r in archives.write_entries(found.where("path is not null"), str(to)).collect()}
    assert status == {("x.tar", "../escape.txt"): "unsafe path", ("x.tar", "ok.txt"): "written"}
    assert (to / "ok.txt").read_bytes() == b"hi" and not (tmp_path / "escape.txt").exists()
    again = {r.path: r.status for r in archives.write_entries(found.where("path = 'ok.txt'"), str(to)).collect()}
    assert again == {"ok.txt": "exists"}
    tested = {r.archive: r.ok for r in archives.test_archives(spark.createDataFrame([("good", bytearray(archives.pack(TREE, "zip"))), ("bad", bytearray(b"x"))], "path string, content binary")).collect()}
    assert tested == {"good": True, "bad": False}


def test_volume_file(tmp_path):
    paths = []
    for k in range(3):
        (tmp_path / f"v.00{k + 1}").write_bytes(DATA[k * 4096 : (k + 1) * 4096])
        paths.append(str(tmp_path / f"v.00{k + 1}"))
    f = archives.VolumeFile(paths)
    assert f.read() == DATA[: 3 * 4096]
    for at in (0, 4095, 4096, 9000):
        f.seek(at)
        assert f.read(100) == DATA[at : at + 100]


def test_byte_ranges(spark, tmp_path):
    container.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(DATA)
    (tmp_path / "in" / "b.bin").write_bytes(b"")
    rows = spark.read.format("byte_ranges").option("path", str(tmp_path / "in")).option("chunk_size", 10000).option("chunks_per_task", 3).load().collect()
    a = sorted((r.chunk_id, bytes(r.data)) for r in rows if r.path.endswith("a.bin"))
    assert b"".join(d for _, d in a) == DATA and [bytes(r.data) for r in rows if r.path.endswith("b.bin")] == [b""]
    assert sum(len(r.data) for r in spark.read.format("byte_ranges").option("path", str(tmp_path / "in" / "a.bin")).option("limit", 15000).load().collect()) == 15000


def ar_file(files):
    out = b"!<arch>\n"
    table = b"".join(n.encode() + b"/\n" for n in files if len(n) > 15)
    if table:
        out += b"//".ljust(48) + str(len(table)).encode().ljust(10) + b"`\n" + table + b"\n" * (len(table) % 2)
    for name, data in files.items():
        short = f"/{table.index(name.encode())}" if len(name) > 15 else name + "/"
        out += short.encode().ljust(16) + b"1700000000".ljust(12) + b"0     0     100644  " + str(len(data)).encode().ljust(10) + b"`\n" + data + b"\n" * (len(data) % 2)
    return out


def cpio_file(files, magic):
    out = b""
    for name, data in [*files.items(), ("TRAILER!!!", b"")]:
        n = len(name) + 1
        if magic == b"070707":
            out += magic + b"".join(b"%0*o" % (w, v) for w, v in zip((6, 6, 6, 6, 6, 6, 6, 11, 6, 11), (0, 0, 0o100644, 0, 0, 1, 0, 7, n, len(data)), strict=True)) + name.encode() + b"\0" + data
        else:
            out += magic + b"".join(b"%08x" % v for v in (1, 0o100644, 0, 0, 1, 7, len(data), 0, 0, 0, 0, n, 0)) + name.encode() + b"\0"
            out += b"\0" * (-len(out) % 4)
            out += data
            out += b"\0" * (-len(out) % 4)
    return out


def test_further_formats():
    import lzma

    files = {"a.txt": b"alpha", "a-name-of-more-than-15-letters": b"x" * 1001, "empty": b""}
    for data in (ar_file(files), cpio_file(files, b"070701"), cpio_file(files, b"070707")):
        assert {e.path: e.data for e in archives.unpack(data)} == files
        for cut in (len(data) // 2, 30):
            with pytest.raises(FormatError):
                list(archives.unpack(data[:cut]))
    assert [e.data for e in archives.unpack(lzma.compress(DATA, format=lzma.FORMAT_ALONE), "x.lzma")] == [DATA]
    assert [e.data for e in archives.unpack(lzma.compress(archives.pack(TREE, "tar"), format=lzma.FORMAT_ALONE))][0] == b"alpha"


def volumes(folder, name, data, size=4096):
    folder.mkdir(exist_ok=True)
    for k in range(-(-len(data) // size)):
        (folder / f"{name}.{k + 1:03d}").write_bytes(data[k * size : (k + 1) * size])
    return str(folder / f"{name}.001")


@pytest.mark.parametrize("kind", [*archives.PACKERS, "bundle", "locked"])
def test_volumes_hold_an_archive(tmp_path, kind):
    noise = random.Random(2).randbytes(40000)
    tree = [*TREE, Entry("noise.bin", noise)]
    password = "pw" if kind == "locked" else None
    data = archives.pack(tree, kind) if kind in archives.PACKERS else archives.compress_bundle(tree, algo="huffman", password=password, iterations=100)
    first = volumes(tmp_path / "v", f"x.{kind}", data)
    want = {e.path: e.data for e in tree if not e.is_dir}
    tested = archives.test_file(first, password)
    assert tested["ok"] and tested["n_entries"] == len(tree) and tested["n_bytes"] == sum(map(len, want.values()))
    to = tmp_path / "out"
    rows = archives.extract_multipart(first, str(to), password=password)
    assert all(r["status"] == "written" for r in rows) and {p: (to / p).read_bytes() for p in want} == want
    assert {r["status"] for r in archives.extract_multipart(first, str(to), password=password) if r["path"] not in ("sub",)} == {"exists"}
    head = open(first, "rb").read(512)
    assert archives.logical_kind(head) == ("indexed" if kind == "zip" else "stream" if kind in archives.PACKERS else "container")
    if archives.logical_kind(head) != "stream":
        with pytest.raises(FormatError):
            archives.extract_multipart(first, str(tmp_path / "in-place"), in_place=True)
        assert archives.test_file(first, password)["ok"]
    else:
        need, have = archives.preflight(archives.series(first), str(to))
        assert need >= archives.KEEP_FREE and have > 0
        with pytest.raises(FormatError):
            archives.extract_multipart(first, str(tmp_path / "in-place"), in_place=True, keep_free=1 << 60)
        assert archives.test_file(first)["ok"]
        archives.extract_multipart(first, str(tmp_path / "in-place"), in_place=True)
        assert not list((tmp_path / "v").iterdir()) and (tmp_path / "in-place" / "noise.bin").read_bytes() == noise


def test_reclaim_keeps_what_is_not_read(tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "KEEP_FREE", 5000)
    first = volumes(tmp_path / "v", "x", DATA[:40960])
    f = archives.VolumeFile(archives.series(first), reclaim=True)
    assert f.read(20000) == DATA[:20000]
    assert sorted(p.name for p in (tmp_path / "v").iterdir())[0] == "x.004" and f.gone == 3
    with pytest.raises(OSError):
        f.seek(0)
    assert f.read() == DATA[20000:40960]


def test_damaged_volumes(spark, tmp_path):
    data = archives.pack([Entry("a", random.Random(1).randbytes(20000))], "tar.gz")
    first = volumes(tmp_path / "v", "x.tar.gz", data)
    (tmp_path / "v" / "x.tar.gz.003").write_bytes(b"\0" * 4096)
    (tmp_path / "v" / "plain.001").write_bytes(b"no archive")
    paths = spark.createDataFrame([(first,), (str(tmp_path / "v" / "plain.001"),), (str(tmp_path / "none"),)], "path string")
    got = {r.archive.rsplit("/")[-1]: r.ok for r in archives.test_files(paths).collect()}
    assert got == {"x.tar.gz.001": False, "plain.001": False, "none": False}
    assert all(r.status != "written" for r in archives.extract_files(paths, str(tmp_path / "out")).collect() if r.path is None)
    assert not list(tmp_path.glob("out/**/*.part"))
    with pytest.raises(FormatError):
        archives.extract_multipart(str(tmp_path / "v" / "plain.001"), str(tmp_path / "out"))


def test_links_in_the_folder_are_not_followed(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "out" / "sub").symlink_to(tmp_path / "elsewhere")
    (tmp_path / "x.zip").write_bytes(archives.pack([Entry("sub/a.txt", b"a"), Entry("b.txt", b"b"), Entry("dots../c", b"c")], "zip"))
    got = {r.path: r.status for r in archives.extract_files(spark.createDataFrame([(str(tmp_path / "x.zip"),)], "path string"), str(tmp_path / "out")).collect()}
    assert got == {"sub/a.txt": "a link stands in the way", "b.txt": "written", "dots../c": "written"} and not list((tmp_path / "elsewhere").iterdir())


def test_header_is_read_alone(tmp_path):
    data = container.write(DATA * 10, "store", chunk_size=16, name="n")
    assert len(data) > 128 << 10
    (tmp_path / "x").write_bytes(data)
    with open(tmp_path / "x", "rb") as f:
        h, at = container.load_header(f, len(data))
        assert h == container.parse(data)[0] and f.tell() <= at + (1 << 18)
        with pytest.raises(FormatError):
            container.load_header(f, len(data) - 1)
        back = container.ContentFile(f, len(data))
        assert io.BufferedReader(back).read() == DATA * 10
    broken = bytearray(data)
    broken[-3] ^= 1
    with pytest.raises(FormatError):
        io.BufferedReader(container.ContentFile(io.BytesIO(bytes(broken)), len(broken))).read()


def lz4_frame(data, linked=False):
    """Literals, and matches at distance 1 for runs; every other block is stored."""
    out = b"\x04\x22\x4d\x18" + bytes([0x40 | 0x20 * (not linked) | 0x04, 0x70, 0])
    for k in range(0, len(data), 5000):
        part, block, at = data[k : k + 5000], b"", 0
        if k % 10000:
            out += struct.pack("<I", len(part) | 1 << 31) + part
            continue
        size = lambda n: b"" if n < 15 else b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255])
        while at < len(part):
            run = next((i for i in range(at, len(part) - 12) if part[i : i + 9] == part[i : i + 1] * 9), None)
            if run is None:
                n = len(part) - at
                block += bytes([min(n, 15) << 4]) + size(n) + part[at:]
                break
            end = run + 1
            while end < len(part) - 5 and part[end] == part[run]:
                end += 1
            n, m = run + 1 - at, end - run - 1 - 4
            block += bytes([min(n, 15) << 4 | min(m, 15)]) + size(n) + part[at : run + 1] + b"\1\0" + size(m)
            at = end
        out += struct.pack("<I", len(block)) + block
    return out + bytes(4) + b"sums"


def z_file(data, most=12, clear_at=None):
    out, known, width, group, now, done = bytearray(b"\x1f\x9d" + bytes([0x80 | most])), {}, 9, [], None, 0

    def flush():
        out.extend(sum(c << k * width for k, c in enumerate(group)).to_bytes(-(-len(group) * width // 8) if done else width, "little"))
        group.clear()

    free = 257
    for i, c in enumerate(data):
        if now is None:
            now = c
            continue
        if (now, c) in known:
            now = known[now, c]
            continue
        group.append(now)
        if len(group) == 8:
            flush()
        if free < 1 << most:
            known[now, c] = free
            free += 1
            if free > 1 << width and width < most:
                if group:
                    flush()
                width += 1
        now = c
        if clear_at and i > clear_at:
            group.append(256)
            flush()
            known, width, free, clear_at = {}, 9, 257, None
    done = 1
    if now is not None:
        group.append(now)
    if group:
        flush()
    return bytes(out)


def test_lz4_and_compress_streams():
    runs = b"".join(bytes([k % 7 + 65]) * (k % 60) + b"text %d " % k for k in range(700))
    for data in (b"x", DATA[:30000], runs):
        for packed, name in ((lz4_frame(data), "x.lz4"), (lz4_frame(data, True), "x.lz4")):
            assert [(e.path, e.data) for e in archives.unpack(packed, name)] == [("x", data)]
    tar = archives.pack(TREE, "tar")
    assert {e.path: e.data for e in archives.unpack(lz4_frame(tar))}["a.txt"] == b"alpha"
    for data in (b"x", b"ab" * 2000, DATA[:60000]):
        for most in (9, 12, 16):
            assert [e.data for e in archives.unpack(z_file(data, most), "x.Z")] == [data], most
    assert [e.data for e in archives.unpack(z_file(DATA[:60000], 12, 30000), "x.Z")] == [DATA[:60000]]
    for bad in (lz4_frame(runs)[:200], lz4_frame(runs)[:5] + b"\0\0", z_file(DATA)[:3] + b"\xff" * 9, b"\x1f\x9d\x05abc"):
        with pytest.raises(FormatError):
            list(archives.unpack(bad))
