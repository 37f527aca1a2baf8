"""Results as text for people, and progress while a job runs."""

from __future__ import annotations

import json
import sys
import threading
import time


def size(n: int | None) -> str:
    if n is None:
        return "-"
    x = float(n)
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if x < 1024:
            return f"{n} B" if unit == "B" else f"{x:.2f} {unit}"
        x /= 1024
    return f"{x:.2f} PiB"


def rate(mbps: float | None) -> str:
    return "-" if mbps is None else f"{mbps / 1000:.2f} GB/s" if mbps >= 1000 else f"{mbps:.2f} MB/s"


def clean(text: str) -> str:
    """Text without control characters, which a terminal would obey."""
    return "".join("?" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def _lines(pairs: list[tuple[str, str | None]]) -> str:
    pairs = [(k, v) for k, v in pairs if v is not None]
    width = max(len(k) for k, _ in pairs)
    return "\n".join(f"{k:<{width}}  {clean(v)}" for k, v in pairs)


def stats(r: dict) -> str:
    """Of a packed or restored file."""
    ratio = r.get("ratio")
    return _lines(
        [
            ("input", r["input"]), ("output", r.get("output")), ("codec", r.get("algo")), ("size", f"{size(r.get('in_bytes'))} to {size(r.get('out_bytes'))}"),
            ("ratio", None if ratio is None else f"{ratio:.4f}, {100 * (1 - ratio):.1f} % saved"), ("chunks", None if r.get("chunks") is None else str(r["chunks"])),
            ("crc32", None if r.get("crc") is None else f"{r['crc']:08x}"), ("encrypted", "yes, authenticated" if r.get("encrypted") else "no"), ("speed", rate(r.get("mbps"))), ("error", r.get("error")),
        ]
    )


def analysis(r: dict) -> str:
    return _lines(
        [
            ("file", r["path"]), ("type", f"{r['type']} ({r['type_detail']})"), ("sample", size(r["sample_size"])), ("entropy", f"{r['entropy']:.3f} bits a byte"),
            ("compressible", f"{100 * r['compressibility']:.1f} %"), ("codec", f"{r['algo']} at level {r['level']}"), ("reason", r["rationale"]),
        ]
    )


def benchmark(rows: list[dict]) -> str:
    out = [f"{'codec':<12}  {'ratio':>7}  {'size':>11}  {'speed':>12}"]
    for r in rows:
        mark = "best ratio" if r.get("best_ratio") else "fastest" if r.get("best_speed") else ""
        out.append(f"{r['algo']:<12}  {r['ratio']:>7.4f}  {size(r['out_bytes']):>11}  {rate(r.get('mbps')):>12}  {mark}".rstrip())
    return "\n".join(out)


def info(r: dict) -> str:
    if r.get("error"):
        return _lines([("file", r["path"]), ("error", r["error"])])
    return _lines(
        [
            ("file", r["path"]), ("version", str(r["version"])), ("name", r["name"]), ("codec", f"{r.get('algo')} at level {r['level']}"), ("size", f"{size(r['comp_size'])} of {size(r['orig_size'])}"),
            ("chunks", f"{len(r['chunks'])} of {size(r['chunk_size'])}"), ("raw chunks", str(sum(c["raw"] for c in r["chunks"]))), ("bundle", "yes" if r["bundle"] else "no"), ("encrypted", "yes" if r["encrypted"] else "no"),
            ("crc32", f"{r['orig_crc']:08x}"), ("payload", None if r.get("payload_ok") is None else "right" if r["payload_ok"] else "damaged"),
        ]
    )


def render(verb: str, rows: list[dict]) -> str:
    if verb in ("bench", "benchmark"):
        return benchmark(rows)
    one = {"compress": stats, "decompress": stats, "analyze": analysis, "info": info}.get(verb, lambda r: _lines([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in r.items()]))
    return "\n\n".join(one(r) for r in rows)


class Progress:
    """Tells while a block runs how many tasks of its stages are done: one JSON line each time that this changes, at most every `every` seconds, and a last one."""

    def __init__(self, spark, out=None, every: float = 0.04):
        self.tracker, self.out, self.every = spark.sparkContext.statusTracker(), out or sys.stderr, every
        self.done, self.seen, self.began = threading.Event(), {}, time.time()

    def _state(self) -> dict:
        for s in self.tracker.getActiveStageIds():
            if found := self.tracker.getStageInfo(s):
                self.seen[s] = (found.numCompletedTasks, found.numTasks)
        active = set(self.tracker.getActiveStageIds())
        state = [(n if s not in active else k, n) for s, (k, n) in self.seen.items()]
        return {"tasks_done": sum(k for k, _ in state), "tasks": sum(n for _, n in state)}

    def _run(self) -> None:
        last = None
        while not self.done.wait(self.every):
            state = self._state()
            if state != last:
                last = state
                print(json.dumps({"event": "progress", "seconds": round(time.time() - self.began, 3)} | state), file=self.out, flush=True)

    def __enter__(self) -> Progress:
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self.done.set()
        self.thread.join()
        print(json.dumps({"event": "end", "seconds": round(time.time() - self.began, 3), "ok": kind is None} | self._state()), file=self.out, flush=True)
