"""State that files keep while their chunks arrive: size and CRC of what is there, in whatever order it comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.crypto import crc32_combine

#: Runs of chunks that have met: first chunk, chunk behind the last, bytes, CRC.
_STATE = "first array<bigint>, behind array<bigint>, size array<bigint>, crc array<bigint>"
TOTALS = "file_id bigint, chunks bigint, size bigint, crc bigint, whole boolean"


def joined(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs (first, behind, size, crc) with neighbours made one: the CRC of both follows from theirs.  A chunk that comes again is left out."""
    out: list[tuple[int, int, int, int]] = []
    for first, behind, size, crc in sorted(runs, key=lambda r: (r[0], -r[1])):
        if out and first < out[-1][1]:
            continue
        if out and first == out[-1][1]:
            a, _, n, c = out[-1]
            out[-1] = (a, behind, n + size, crc32_combine(c, crc, size))
        else:
            out.append((first, behind, size, crc))
    return out


def running_totals(chunks: DataFrame) -> DataFrame:
    """A stream (TOTALS) that tells of each file, each time that chunks (file_id, chunk_id, orig_size, crc) of it arrive, how many there are, their bytes, and the CRC of the run from the first chunk on.

    `whole` says that there is no gap.  Nothing but runs is kept, so a file that arrives in order costs one run however large it is.  Use it in update mode.
    """

    def update(key: tuple, found: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = list(zip(*state.get, strict=True)) if state.exists else []
        for part in found:
            runs = joined(runs + [(int(c), int(c) + 1, int(n), int(crc)) for c, n, crc in zip(part["chunk_id"], part["orig_size"], part["crc"], strict=True)])
        state.update(tuple([int(r[k]) for r in runs] for k in range(4)))
        whole = len(runs) == 1 and runs[0][0] == 0
        head = runs[0] if runs and runs[0][0] == 0 else (0, 0, 0, 0)
        yield pd.DataFrame({"file_id": [key[0]], "chunks": [sum(r[1] - r[0] for r in runs)], "size": [sum(r[2] for r in runs)], "crc": [head[3]], "whole": [whole]})

    keyed = chunks.select("file_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "orig_size", "crc").groupBy("file_id")
    return keyed.applyInPandasWithState(update, TOTALS, _STATE, "update", GroupStateTimeout.NoTimeout)
