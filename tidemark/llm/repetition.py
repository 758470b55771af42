"""Quality rules from repetition: how much of a text stands in word sequences and lines that it holds more than once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Sequences of so many words are looked at, and a text breaks a rule with more than MOST percent of its word characters
#: inside duplicated sequences of one length, first occurrences included, or inside lines that equal an earlier one. Published
#: rules ask for 15 to 10 percent of later occurrences, about 30 to 20 with first ones; of 6,695 documents labelled good that
#: pass the base rule, 26 break those and 1 breaks 30 throughout: a shared line stands twice in a short text.
LENGTHS, MOST = range(5, 11), 30
#: The base rule: at least so many words, and at most this percentage of them in repeated windows of WINDOW words.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30

#: Texts are measured together until they have so many characters; a longer one is measured alone.
TOGETHER = 2_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = re.compile(r"[^#*$%&|<>]+")
_WORDS = re.compile(WORD)


def _duplicated(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once among those of the same text; texts come in order."""
    order = np.argsort(keys, kind="stable")
    k, t = keys[order], text[order]
    same = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    found = np.zeros(len(keys), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts of each text: words, word_chars, symbols, lines, dup_lines, line_chars, chars_n and words_n for each n.

    Every word gets a 64-bit hash, and the hash of n words grows from that of the first n - 1 by one
    multiplication and one addition over all texts at once. A sequence can only be a duplicate
    where its first and last n - 1 words are, so after the shortest length few starts are left to sort.
    chars_n and words_n tell how many characters and words lie in sequences of n words that the
    text holds twice or more, each counted once, the first occurrence included; of lines, all but the
    first of equal ones count (line_chars: characters of their words).
    """
    words = [_WORDS.findall(t) for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    total = int(n_words.sum())
    sizes = np.fromiter((len(w) for ws in words for w in ws), np.int64, total)
    hashes = np.fromiter((hash(w) for ws in words for w in ws), np.int64, total).view(np.uint64)
    ends = np.cumsum(n_words)
    text = np.repeat(np.arange(len(texts)), n_words)
    until = np.repeat(ends, n_words)
    per_text = lambda values: np.bincount(text, weights=values, minlength=len(texts)).astype(np.int64)
    out = {"words": n_words, "word_chars": per_text(sizes)}
    starts, grown, n = np.arange(total), hashes.copy(), 1
    for length in LENGTHS:
        while n < length:  # the hash of n + 1 words from that of n, for those that don't reach into the next text
            fits = starts + n < until[starts]
            starts, grown = starts[fits], grown[fits]
            grown = grown * _FACTOR + hashes[starts + n]
            n += 1
        twice = _duplicated(grown, text[starts])
        starts, grown = starts[twice], grown[twice]
        depth = np.zeros(total + 1, dtype=np.int64)
        depth[starts] += 1
        depth[starts + length] -= 1  # starts differ, and so do ends
        inside = np.cumsum(depth)[:total] > 0
        out[f"chars_{length}"], out[f"words_{length}"] = per_text(sizes * inside), per_text(inside.astype(np.int64))
    lines, dup_lines, line_chars = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
    for i, t in enumerate(texts):
        seen: set[str] = set()
        for line in t.split("\n"):
            if line in seen:
                lines[i] += 1
                dup_lines[i] += 1
                line_chars[i] += sum(map(len, _WORDS.findall(line)))
            elif _WORDS.search(line):
                lines[i] += 1
                seen.add(line)
    symbols = np.array([len(_SYMBOLS.sub("", t)) for t in texts], dtype=np.int64)
    return out | {"symbols": symbols, "lines": lines, "dup_lines": dup_lines, "line_chars": line_chars}


MEASURES = ["words", "word_chars", "symbols", "lines", "dup_lines", "line_chars", *[f"{what}_{n}" for n in LENGTHS for what in ("chars", "words")]]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of measure() for every row, over whole texts; a null text is empty.

    Rows are counted one by one: repeated rows and ids count alike, a null id stays. Other columns are not read.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and (not some or size < TOGETHER):
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1])
                found = measure(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *[pa.array(found[m], pa.int64()) for m in MEASURES]], ["doc_id", *MEASURES])
                at += len(some)

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(counted, ", ".join([f"doc_id {id_type}", *[f"{m} long" for m in MEASURES]]))


def base_failed() -> Column:
    """Whether the base rule fails the measured counts: too few words, or too many of them in repeated windows."""
    return (F.col("words") < LEAST_WORDS) | (100 * F.col(f"words_{WINDOW}") > MOST_REPEATED * F.col("words"))


def broken_rules() -> Column:
    """The names of the repetition rules that the measured counts break, in order, joined by commas."""
    chars = {f"ngrams_{n}": f"chars_{n}" for n in LENGTHS} | {"lines": "line_chars"}
    rules = {name: 100 * F.col(c) > MOST * F.col("word_chars") for name, c in chars.items()}
    return F.concat_ws(",", *[F.when(c, F.lit(name)) for name, c in rules.items()])


def judge_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measured() with base_failed, broken (names of broken rules) and kept: neither fails.

    A text without words fails the base rule and breaks no other.
    """
    judged = measured(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("broken", broken_rules())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))
