"""Command line: python -m stratapack VERB ...; results are JSON lines, or text with --text.  Exit codes: 0 done, 1 something failed, 2 wrong usage.

A path `-` is the standard input, and an output `-` of compress and decompress the standard output.
"""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import shutil
import sys
import uuid

from .functions.bits import FormatError
from .plans import jobs, reports
from .sources import archives
from .sources.folders import mounted, shared_folder


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("stratapack")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *aliases: str, many: bool = True) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, aliases=list(aliases))
        v.set_defaults(verb=name)
        v.add_argument("paths", nargs="+" if many else 1)
        v.add_argument("--password", default=os.environ.get("STRATAPACK_PASSWORD"))
        v.add_argument("--force", action="store_true")
        v.add_argument("--magic", default="SPACK")
        v.add_argument("--text", action="store_true")
        v.add_argument("--progress", action="store_true")
        return v

    for v, default in ((verb("compress", "c", "pack"), None), (verb("bundle"), "bundle")):
        v.add_argument("-o", "--output", required=True)
        v.add_argument("--algo")
        v.add_argument("--level", type=int)
        v.add_argument("--priority", default="balanced", choices=["max-speed", "balanced", "max-ratio"])
        v.add_argument("--format", default=default, choices=["bundle", *archives.PACKERS])
    v = verb("decompress", "d", "unpack")
    v.add_argument("-o", "--output", required=True)
    v.add_argument("--no-verify", action="store_true")
    v = verb("extract")
    v.add_argument("-o", "--output", required=True)
    v.add_argument("--in-place", action="store_true")
    v.add_argument("--keep-free", default="0")
    verb("list", "ls")
    verb("info").add_argument("--header-only", action="store_true")
    verb("test")
    verb("analyze").add_argument("--priority", default="balanced", choices=["max-speed", "balanced", "max-ratio"])
    verb("inspect")
    v = verb("bench", "benchmark")
    v.add_argument("--level", type=int, default=6)
    v.add_argument("--limit", type=int)
    verb("shrink").add_argument("--quality", default="medium", choices=["high", "medium", "low"])
    verb("split", many=False).add_argument("--size", required=True)
    v = verb("join", many=False)
    v.add_argument("-o", "--output", required=True)
    v.add_argument("--in-place", action="store_true")
    verbs.add_parser("algos").set_defaults(text=False, progress=False)
    verbs.add_parser("version")
    return p


def _on_driver(a) -> dict:
    """Verbs that need no tasks."""
    if a.verb == "split":
        return {"ok": True, "result": jobs.split(a.paths[0], jobs.part_size(a.size))}
    if a.verb == "join":
        return {"ok": True, "result": jobs.join(a.paths[0], a.output, a.force, a.in_place)}
    rows = archives.extract_multipart(a.paths[0], a.output, True, jobs.part_size(a.keep_free), a.force, a.password, a.magic.encode())
    return {"ok": all(r["status"] == "written" for r in rows), "result": rows}


def _rows(a, spark) -> list[dict]:
    if a.verb == "algos":
        return [json.loads(x) for x in jobs.algorithms(spark).toJSON().collect()]
    magic = a.magic.encode()
    if a.verb == "bundle" or a.verb == "compress" and a.format:
        return [jobs.bundle(spark, a.paths, a.output, a.format, a.algo or "lz77", a.level or 6, a.password, a.force, magic)]
    df = {
        "compress": lambda: jobs.compress(spark, a.paths, a.output, a.algo, a.priority, a.level, password=a.password, force=a.force, magic=magic),
        "decompress": lambda: jobs.decompress(spark, a.paths, a.output, a.password, a.force, not a.no_verify, magic),
        "extract": lambda: jobs.extract(spark, a.paths, a.output, a.password, a.force, magic),
        "list": lambda: jobs.list_archives(spark, a.paths, a.password, magic),
        "info": lambda: jobs.info(spark, a.paths, magic, not a.header_only),
        "test": lambda: jobs.test(spark, a.paths, a.password, magic),
        "analyze": lambda: jobs.analyze(spark, a.paths, a.priority),
        "inspect": lambda: jobs.inspect(spark, a.paths),
        "bench": lambda: jobs.bench(spark, a.paths, a.level, a.limit),
        "shrink": lambda: jobs.shrink(spark, a.paths, a.quality),
    }[a.verb]()
    return (json.loads(x) for x in df.toJSON().toLocalIterator())


def _bad(r: dict) -> bool:
    return r.get("ok") is False or r.get("status", "written") != "written"


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "version":
        print(json.dumps({"version": jobs.VERSION}))
        return 0
    if a.verb in ("split", "join") or a.verb == "extract" and a.in_place:
        try:
            out = _on_driver(a)
        except (OSError, ValueError, FormatError) as e:
            out = {"ok": False, "error": str(e)}
        print(json.dumps(out))
        return int(not out["ok"])
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("stratapack").getOrCreate()
    with contextlib.ExitStack() as stack:
        paths, output = getattr(a, "paths", []), getattr(a, "output", None)
        if "-" in paths or output == "-":  # a pipe has no positions, so it is kept in a file beside the job
            spool = os.path.join(mounted(shared_folder(spark)), f"spool-{uuid.uuid4().hex}")
            os.makedirs(spool)
            stack.callback(shutil.rmtree, spool, ignore_errors=True)
            if "-" in paths:
                with open(os.path.join(spool, "stdin"), "wb") as f:
                    shutil.copyfileobj(sys.stdin.buffer, f, 1 << 20)
                a.paths = [os.path.join(spool, "stdin") if p == "-" else p for p in paths]
            if output == "-":
                a.output = os.path.join(spool, "out")
        if getattr(a, "progress", False):
            stack.enter_context(reports.Progress(spark))
        failed, held = False, []
        for r in _rows(a, spark):
            failed |= _bad(r)
            if output == "-" and not _bad(r):
                with open(r["output"], "rb") as f:
                    shutil.copyfileobj(f, sys.stdout.buffer, 1 << 20)
                sys.stdout.buffer.flush()
            elif getattr(a, "text", False) and a.verb != "bench":
                print(reports.render(a.verb, [r]) + "\n")
            elif getattr(a, "text", False):
                held.append(r)  # one row a codec
            else:
                print(json.dumps(r, ensure_ascii=False), file=sys.stderr if output == "-" else sys.stdout)
        if held:
            print(reports.render(a.verb, held))
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
