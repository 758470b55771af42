"""Comparing all members of groups, large ones in pairs of blocks, with one group in memory at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, key: str, member: str, size: str, block: int, payload: list[str]) -> DataFrame:
    """Deals the members of each group out so that any two meet in one run of (key, i, j), i <= j.

    A group of up to `block` members is one run. A larger one is cut into blocks by a hash of the
    member, and a member goes to the run of its block with each block of the group; runs have about two
    blocks at most. Returns key, i, j, id, block and the payload, runs together and in order.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    dealt = rows.select(F.col(key).alias("key"), F.col(member).alias("id"), own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_with"), *payload)
    dealt = dealt.select("key", F.least("block", "_with").alias("i"), F.greatest("block", "_with").alias("j"), "id", "block", *payload)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where each run of equal keys begins, and the number of rows at the end."""
    change = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.array([0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])])


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, run_starts) with no run divided between two tables, from batches in order of the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = run_starts([batch.column(k).to_numpy() for k in keys])
        head, last = int(starts[1]), int(starts[-2])
        begins = bool(held) and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
        if not begins and held:
            yield _joined(held, keys)
            held = []
        if last == 0:  # one run
            held.append(batch)
            continue
        held.append(batch.slice(0, head if begins else last))
        yield _joined(held, keys)
        if begins and last > head:
            yield _joined([batch.slice(head, last - head)], keys)
        held = [batch.slice(last)]
    if held:
        yield _joined(held, keys)


def _joined(held: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    return table, run_starts([table.column(k).to_numpy() for k in keys])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, from batches in order of them; rows alone in their run are left out."""
    for table, starts in whole_runs(batches, keys):
        for start, end in zip(starts, starts[1:], strict=False):
            if end - start > 1:
                yield table.slice(start, end - start).combine_chunks()
