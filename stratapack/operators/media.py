"""Shrinking media with an external encoder, one file a task."""

from __future__ import annotations

import os
import shutil
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame

#: Quality settings (fixed values): constant rate factors for video, q for images.
QUALITY = {"high": (18, 2), "medium": (23, 5), "low": (28, 10)}


def find_encoder(name: str = "ffmpeg") -> str | None:
    return shutil.which(name)


def shrunk_name(path: str) -> str:
    root, ext = os.path.splitext(path)
    return f"{root}-shrunk{ext}"


def arguments(path: str, out: str, kind: str, quality: str = "medium") -> list[str]:
    crf, q = QUALITY[quality]
    how = ["-c:v", "libx264", "-crf", str(crf), "-c:a", "copy"] if kind == "Video" else ["-q:v", str(q)]
    return ["-hide_banner", "-loglevel", "error", "-n", "-i", path, *how, out]


def shrink_media(files: DataFrame, quality: str = "medium", encoder: str = "ffmpeg") -> DataFrame:
    """(path, out, before, after, status) of files (path, type) on a shared file system; only video and images are touched, and nothing is overwritten."""
    if quality not in QUALITY:
        raise ValueError(f"quality is one of {', '.join(QUALITY)}")
    names = ["path", "out", "before", "after", "status"]

    def run(batches):
        tool = find_encoder(encoder)
        for batch in batches:
            rows = []
            for path, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = shrunk_name(path)
                row = {"path": path, "out": out, "before": os.path.getsize(path) if os.path.exists(path) else None, "after": None}
                if kind not in ("Video", "Image"):
                    status = "not a video or image"
                elif row["before"] is None:
                    status = "no such file"
                elif os.path.lexists(out):
                    status = "exists"
                elif tool is None:
                    status = f"{encoder} is not installed"
                else:
                    done = subprocess.run([tool, *arguments(path, out, kind, quality)], capture_output=True, text=True)
                    status = "written" if done.returncode == 0 else done.stderr.strip()[-300:]
                    row["after"] = os.path.getsize(out) if os.path.exists(out) else None
                rows.append(row | {"status": status})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.int64() if n in ("before", "after") else pa.string()) for n in names]))

    return files.select("path", "type").mapInArrow(run, "path string, out string, before bigint, after bigint, status string")
