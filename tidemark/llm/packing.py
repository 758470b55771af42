"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, with_rank

CAPACITY = 2048
#: Chunks whose ids a task remembers before it starts anew.
CACHE = 600_000
#: ASCII marks that end a chunk, right behind an ASCII or Latin-1 letter; the tokenizers here divide before them anyway.
STOP = re.compile(rb"([!-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xC3[\x80-\x96\x98-\xB6\xB8-\xBF].))[!-/:-@\[-`{-~]*+)(?=[\x20\x09-\x0D]|\Z)")


def chunk_encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """Texts (UTF-8) -> their token ids as little-endian unsigned 32-bit numbers.

    For tokenizers that lower-case, divide words from marks, and drop white space: ids of a text are
    those of its chunks in turn, and a chunk seen before is not encoded again. Texts are lower-cased
    (A-Z) first, unless they may hold a special token, and marks after a word stand alone.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known: dict[bytes, bytes] = {}
    #: whether a token ends a word; words of plain letters are single pieces, so many go through at once
    last = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    for token, i in tokenizer.get_vocab().items():
        last[i] = token.endswith("</w>")

    def encode(texts: list[bytes]) -> list[bytes]:
        if len(known) > CACHE:
            known.clear()
        split = [(text if b"<|" in text else STOP.sub(rb" \1", text.lower())).split() for text in texts]
        plain, other = [], []
        for chunk in set().union(*split).difference(known):
            word = chunk.decode()
            if word.isalpha() and max(word) <= "\xff":
                plain.append((chunk, word))
            else:
                other.append((chunk, word))
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            [joined] = tokenizer.encode_batch_fast([" ".join(w for _, w in part)], add_special_tokens=False)
            ids = np.array(joined.ids, dtype="<u4")
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) != len(part):
                other += part
                continue
            data, at = ids.tobytes(), 0
            for (chunk, _), end in zip(part, (4 * ends).tolist(), strict=True):
                known[chunk] = data[at:end]
                at = end
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            for (chunk, _), e in zip(part, tokenizer.encode_batch_fast([w for _, w in part], add_special_tokens=False), strict=True):
                known[chunk] = array("I", e.ids).tobytes()
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]

    return encode


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Tokenises each document, ends it with id 0 and cuts it into pieces of at most `capacity` ids.

    Returns doc_id, piece, start, length, ids_crc32; and the ids themselves in `ids` (binary) unless they aren't asked for.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(tokenizer_path)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(d for at in range(0, len(texts), 64) for d in encode(texts[at : at + 64])):
                data += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = {"doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(pieces, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs pieces that are known by their lengths only: length -> number of pieces.

    One bin at a time: take the largest piece that fits until none fits; then, if the bin holds
    several pieces and isn't full, put its smallest back for the two unpacked pieces that together
    fill the widened gap most tightly, if they fill it better. Bins that come out alike while the
    pieces last are made together: (how many, [(length, pieces of it), ...]). The work depends on
    the number of different lengths (at most `capacity`), not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    bins = []
    while lengths:
        used: Counter[int] = Counter()
        gap = capacity
        while gap > 0:
            i = bisect.bisect_right(lengths, gap) - 1
            while i >= 0 and left[lengths[i]] <= used[lengths[i]]:
                i -= 1
            if i < 0:
                break
            n = lengths[i]
            take = min(gap // n, left[n] - used[n])
            used[n] += take
            gap -= take * n
        if gap > 0 and sum(used.values()) > 1:
            smallest = min(used)
            pair = _best_pair(lengths, left, used, smallest, gap + smallest)
            if pair:
                used[smallest] -= 1
                used.update(pair)
        used = +used
        times = min(left[n] // c for n, c in used.items())
        bins.append((times, sorted(used.items(), reverse=True)))
        for n, c in used.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
                lengths.pop(bisect.bisect_left(lengths, n))
    return bins


def _best_pair(lengths: list[int], left: dict[int, int], used: Counter[int], smallest: int, room: int) -> tuple[int, int] | None:
    """The two unpacked pieces whose sum is the largest above `smallest` and at most `room`."""
    free = [n for n in lengths[: bisect.bisect_right(lengths, room)] if left[n] > used[n]]
    best, pair, i, j = smallest, None, 0, len(free) - 1
    while i <= j:
        total = free[i] + free[j]
        if total > room or (i == j and left[free[i]] - used[free[i]] < 2):
            j -= 1
            continue
        if total > best:
            best, pair = total, (free[i], free[j])
            if total == room:
                break
        i += 1
    return pair


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) -> the same with sequence_id and offset.

    Only the histogram of lengths, at most `capacity` rows, comes to the driver, where best_two_fit()
    makes the plan. Pieces of one length are interchangeable, so the k-th of them takes the k-th
    place that the plan has for its length; ranks are found over all pieces in parallel. The plan
    has a few rows for each length, so its size doesn't grow with the number of pieces.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    taken: Counter[int] = Counter()
    places, sequence = [], 0
    for times, items in best_two_fit(counts, capacity):
        at = 0
        for n, c in items:
            places.append((n, taken[n], c, sequence, at))
            taken[n] += times * c
            at += n * c
        sequence += times
    plan = np.array(sorted(places), dtype=np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        starts = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = rows[np.searchsorted(starts, length << 48 | rank, "right") - 1]
            nth = rank - at[:, 1]
            columns = [*batch.columns[:-1], pa.array(at[:, 3] + nth // at[:, 2]), pa.array(at[:, 4] + nth % at[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = with_rank(pieces.select(*kept), ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(placed, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole documents into as few sequences of at most `capacity` ids as best-two-fit finds.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is the single id 0. Each row is a document of its own, repeated ids included. Only
    documents longer than `capacity` are cut. Pieces of equal length, id, number and checksum may
    swap places. Other columns are not read. An empty table gives an empty result.
    """
    return pack(save(cut(docs, tokenizer_path, capacity, id_col, text_col, with_ids=False)), capacity)


def sequences(placed: DataFrame, cut_pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids (binary, little-endian), from pack() and cut() of the same documents.

    A sequence has at most `capacity` ids, which bounds what each group collects.
    """
    both = placed.join(cut_pieces.select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"]), ["doc_id", "piece", "ids_crc32"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
