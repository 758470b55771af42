"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over row numbers."""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, with_rank

#: The round function works modulo this prime, so that products stay inside 64 bits.
PRIME = (1 << 31) - 1
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A multiplier and an addend for each round, drawn from the seed."""
    rng = np.random.default_rng(seed)
    return [(int(a), int(b)) for a, b in rng.integers(1, PRIME, size=(rounds, 2))]


def half_bits(n: int) -> int:
    """Bits of each half of the smallest even-width domain that holds n numbers; at most 31."""
    bits = max(1, (max(n, 2) - 1).bit_length())
    if bits > 62:
        raise ValueError("more than 2**62 rows")
    return (bits + 1) // 2


def _mix(half: np.ndarray, key: tuple[int, int], mask: int) -> np.ndarray:
    x = (half * key[0] + key[1]) % PRIME
    return (x ^ (x >> 13)) & mask


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each row number in a pseudo-random order of 0..n-1 (a bijection).

    Values that leave the range are enciphered again until they return (cycle walking).
    """
    return _walk(rows, n, seed, inverse=False)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number at each place: the inverse of permute()."""
    return _walk(places, n, seed, inverse=True)


def _walk(values: np.ndarray, n: int, seed: int, inverse: bool) -> np.ndarray:
    h, keys = half_bits(n), round_keys(seed)
    mask = (1 << h) - 1
    out = np.array(values, dtype=np.int64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> h, x & mask
        if inverse:
            for key in reversed(keys):
                left, right = right ^ _mix(left, key, mask), left
        else:
            for key in keys:
                left, right = right, left ^ _mix(right, key, mask)
        out[todo] = x = (left << h) | right
        todo = todo[x >= n]
    return out


def place(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of a row number, computed without reading any table."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number at a shard and slot."""
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals rows to shards by the place of their global row number: place % shards, place // shards.

    Row numbers follow (id, checksum, size), so reruns agree and any row's shard and slot can be
    computed from its number alone. Law `rows`: shard sizes differ by at most one row.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot, grown_shard (null: the
    law `key` doesn't hold), row_number. Null text: size 16, checksum 0. Null ids come first. Rows
    equal in all of id, checksum and size take neighbouring row numbers in any order. Other columns
    are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = save(rows)  # the range partitioning reads them twice
    numbered = with_rank(rows, [], ["doc_id", "text_crc32", "size"], "row_number")
    n = rows.count()

    @F.pandas_udf("long")
    def placed(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    at = numbered.withColumn("_place", placed("row_number"))
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(shards).cast("decimal(10,0)")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
