"""The verbs over files, and the command line."""

import json
import os

import pytest

from stratapack.__main__ import main
from stratapack.plans import jobs
from stratapack.sources import container

TEXT = b"".join(f"line {k % 50} of the report\n".encode() for k in range(4000))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(TEXT)
    (tmp_path / "in" / "b.bin").write_bytes(os.urandom(5000))
    (tmp_path / "in" / "empty").write_bytes(b"")
    return tmp_path


@pytest.mark.parametrize("password", [None, "pw"])
def test_there_and_back(spark, folder, password):
    src, packed, back = (str(folder / x) for x in ("in", "packed", "back"))
    done = {os.path.basename(r.input): r for r in jobs.compress(spark, [src], packed, password=password, iterations=100).collect()}
    assert all(r.ok for r in done.values()) and done["a.txt"].ratio < 0.5 and done["b.bin"].algo == "store" and done["empty"].algo == "store"
    assert all(r.ok for r in jobs.decompress(spark, [packed], back, password).collect())
    for name in ("a.txt", "b.bin", "empty"):
        assert (folder / "back" / name).read_bytes() == (folder / "in" / name).read_bytes()
    assert {r.error for r in jobs.decompress(spark, [packed], back, password).collect()} == {"the output exists"}
    assert all(r.ok for r in jobs.decompress(spark, [packed], back, password, force=True).collect())
    if password:
        assert {r.error for r in jobs.decompress(spark, [packed], str(folder / "no"), "wrong").collect()} == {"wrong password, or the file was changed"} and not (folder / "no").exists()
    assert all(r.ok for r in jobs.test(spark, [packed], password).collect())
    assert {r.name for r in jobs.info(spark, [packed]).collect()} == {"a.txt", "b.bin", "empty"}


def test_command_line(spark, folder, capsys):
    run = lambda *a: (main([str(x) for x in a], spark), [json.loads(x) for x in capsys.readouterr().out.splitlines()])
    assert run("bundle", folder / "in", "-o", folder / "x.spk", "--algo", "huffman")[0] == 0
    code, rows = run("list", folder / "x.spk")
    assert code == 0 and {r["path"] for r in rows} == {"in", "in/a.txt", "in/b.bin", "in/empty"}
    assert run("extract", folder / "x.spk", "-o", folder / "out")[0] == 0
    assert (folder / "out" / "in" / "a.txt").read_bytes() == TEXT
    assert run("extract", folder / "x.spk", "-o", folder / "out")[0] == 1
    assert run("bundle", folder / "in", "-o", folder / "x.zip", "--format", "zip")[0] == 0
    assert [r["ok"] for r in run("test", folder / "x.zip")[1]] == [True]
    assert run("split", folder / "in" / "a.txt", "--size", 10000)[0] == 0
    assert run("split", folder / "in" / "a.txt", "--size", 10000)[0] == 1
    assert run("join", folder / "in" / "a.txt.002", "-o", folder / "joined")[0] == 0
    assert (folder / "joined").read_bytes() == TEXT
    (folder / "in" / "a.txt.003").unlink()
    assert run("join", folder / "in" / "a.txt.005", "-o", folder / "joined2")[0] == 1
    assert len(run("algos")[1]) == 7
    assert run("bench", folder / "in" / "a.txt", "--limit", 3000)[1][0]["rank"] == 1
    assert {r["type_detail"] for r in run("analyze", folder / "in" / "a.txt", folder / "in" / "b.bin")[1]} == {"text", "raw"}
    assert run("compress", folder / "in", "-o", folder / "y.tar.gz", "--format", "tar.gz")[0] == 0
    assert {r["path"] for r in run("list", folder / "y.tar.gz")[1]} == {"in", *(f"in/{n}" for n in os.listdir(folder / "in"))}
    assert run("version")[1][0]["version"] and [r["status"] for r in run("shrink", folder / "in" / "b.bin")[1]] == ["not a video or image"]
    assert run("inspect", folder / "in" / "b.bin")[1][0]["size"] == 5000
    assert run("info", folder / "x.spk", "--header-only")[1][0]["bundle"] is True
    with pytest.raises(SystemExit) as e:
        main(["nonsense"])
    assert e.value.code == 2


def test_volumes_on_the_command_line(spark, folder, capsys):
    run = lambda *a: (main([str(x) for x in a], spark), [json.loads(x) for x in capsys.readouterr().out.splitlines()])
    assert run("compress", folder / "in", "-o", folder / "v" / "y.tar", "--format", "tar")[0] == 0
    assert run("split", folder / "v" / "y.tar", "--size", "10k")[0] == 0
    os.remove(folder / "v" / "y.tar")
    assert [(r["ok"], r["details"]) for r in run("test", folder / "v")[1]] == [(True, "4 entries")]
    assert run("extract", folder / "v" / "y.tar.001", "-o", folder / "one")[0] == 0
    assert run("extract", folder / "v" / "y.tar.001", "-o", folder / "two", "--in-place", "--keep-free", "1x")[0] == 1 and len(list((folder / "v").iterdir())) > 5
    assert run("extract", folder / "v" / "y.tar.001", "-o", folder / "two", "--in-place")[0] == 0 and not list((folder / "v").iterdir())
    for to in ("one", "two"):
        assert (folder / to / "in" / "a.txt").read_bytes() == TEXT
    assert run("extract", folder / "in" / "a.txt", "-o", folder / "three")[0] == 1


def test_text_progress_and_pipes(spark, folder, capsysbinary, monkeypatch):
    import io
    import sys

    main(["compress", str(folder / "in"), "-o", str(folder / "p"), "--text", "--progress"], spark)
    out = capsysbinary.readouterr()
    assert b"saved" in out.out and b"encrypted  no" in out.out
    events = [json.loads(x) for x in out.err.splitlines() if x.startswith(b'{"event"')]
    assert events[-1]["event"] == "end" and events[-1]["ok"] and events[-1]["tasks_done"] > 0
    for verb, path in (("analyze", "in/a.txt"), ("bench", "in/a.txt"), ("info", "p/a.txt.spk"), ("list", "p/a.txt.spk")):
        assert main([verb, str(folder / path), "--text"], spark) == 0 and b"a.txt" in capsysbinary.readouterr().out.replace(b"best ratio", b"a.txt")
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(TEXT)))
    assert main(["compress", "-", "-o", str(folder / "piped"), "--algo", "lz77"], spark) == 0
    capsysbinary.readouterr()
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO((folder / "piped" / "stdin.spk").read_bytes())))
    assert main(["decompress", "-", "-o", "-"], spark) == 0
    assert capsysbinary.readouterr().out == TEXT


def test_places_below_the_input_are_kept(spark, tmp_path):
    for d, data in (("a", b"one " * 100), ("b/c", b"two " * 100)):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "x.txt").write_bytes(data)
    (tmp_path / "in" / ".hidden").write_bytes(b"five")
    (tmp_path / "x.txt").write_bytes(b"three " * 50)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.txt").write_bytes(b"four")
    out = tmp_path / "out"
    rows = jobs.compress(spark, [str(tmp_path / "in"), str(tmp_path / "x.txt"), str(tmp_path / "other" / "x.txt"), str(tmp_path / "none")], str(out), "huffman").collect()
    got = {r.input[len(str(tmp_path)) + 1 :]: r.error for r in rows}
    assert got == {"in/.hidden": None, "in/a/x.txt": None, "in/b/c/x.txt": None, "other/x.txt": None, "x.txt": "another input has this output", "none": "no such file"}
    back = jobs.decompress(spark, [str(out)], str(tmp_path / "back")).collect()
    assert all(r.ok for r in back) and (tmp_path / "back" / "b" / "c" / "x.txt").read_bytes() == b"two " * 100
    assert not list(tmp_path.glob("**/*.part"))
    assert {r.rationale for r in jobs.analyze(spark, [str(tmp_path / "none")]).collect()} == {"the file is not there"}


@pytest.mark.parametrize("password", [None, "pw"])
def test_large_files_are_many_chunks(spark, tmp_path, password):
    """Chunks of 10,000 bytes stand for larger ones: no task holds a file."""
    data = bytes(k * k % 251 for k in range(300)) * 2000 + os.urandom(12345)
    (tmp_path / "big.bin").write_bytes(data)
    made = jobs.compress(spark, [str(tmp_path / "big.bin")], str(tmp_path / "out"), "lz77", chunk_size=10_000, password=password, iterations=50).first()
    assert made.ok and made.chunks == 62 and made.ratio < 0.5
    path = tmp_path / "out" / "big.bin.spk"
    h, back = container.read(path.read_bytes(), password)
    assert back == data and h.encrypted == (password is not None)
    again = jobs.compress(spark, [str(tmp_path / "big.bin")], str(tmp_path / "again"), "lz77", chunk_size=10_000, password=password, iterations=50).first()
    if password:  # other key streams each time
        assert again.ok and (tmp_path / "again" / "big.bin.spk").read_bytes()[-1000:] != path.read_bytes()[-1000:]
    assert jobs.decompress(spark, [str(path)], str(tmp_path / "back"), password).first().ok and (tmp_path / "back" / "big.bin").read_bytes() == data
    bad = bytearray(path.read_bytes())
    bad[-5] ^= 1
    path.write_bytes(bytes(bad))
    r = jobs.decompress(spark, [str(path)], str(tmp_path / "no"), password).first()
    assert not r.ok and r.out_bytes is None and not list((tmp_path).glob("no/**/big*"))
    path.write_bytes(bytes(bad[:-9]))
    assert jobs.decompress(spark, [str(path)], str(tmp_path / "no"), password).first().error == "the payload is cut off"
