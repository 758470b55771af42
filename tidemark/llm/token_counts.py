"""Exact token counts at every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Unicode's White_Space property has it.
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Runs of white space (less a last one before other characters), or other characters with one space before.
CHUNK = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: How byte-level BPE vocabularies of this family divide a chunk that isn't white space.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+"
CONTRACTIONS = ("'re", "'ve", "'ll")
NEVER = 1 << 40
#: Chunks that a task remembers before it starts anew.
CACHE = 500_000
#: Characters above which a piece's table is kept while its text is worked on.
LONG = 200


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Token counts of a byte-level BPE vocabulary (a tokenizers .json file) at every prefix.

    For each prefix of a piece exactly one token can end its encoding: the token t for which the
    last token of the prefix before t followed by t is what the merges make of those two tokens'
    bytes. So the counts of all prefixes follow from one pass over the piece, trying the tokens
    that begin at each byte: count[i + len(t)] = count[i] + 1.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.size = max(ids.values(), default=0) + 1
        self.ranks: dict[int, int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            self.ranks[ids[a] * self.size + ids[b]] = rank
            made[ids[a + b]] = (rank, ids[a], ids[b])
        self.ends = {t: self._spine(t, made, 2) for t in ids.values()}
        self.starts = {t: self._spine(t, made, 1) for t in ids.values()}
        #: token of each vocabulary entry, and -1 for what only begins one
        self.tokens = {b[:k]: -1 for b in ids for k in range(1, len(b))} | ids
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.chunk, self.piece, self.blank = regex.compile(CHUNK), regex.compile(PIECE), regex.compile(f"[{SPACE}]+")
        self.pairs: dict[int, bool] = {}
        self.totals: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        #: tables of the current text's pieces that are too long to make twice
        self.tables: dict[str, list[int]] = {}

    @staticmethod
    def _spine(token: int, made: dict[int, tuple[int, int, int]], side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end of `token` as its merges go on, each with the rank of the merge that takes it in."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in made:
                return out
            until, token = made[token][0], made[token][side]

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b apart when their bytes stand together.

        They don't if some token at the end of a and some at the start of b have a merge that comes before
        the merges that take them into a and b; of equal merges the left one comes first.
        """
        ranks, size = self.ranks, self.size
        for x, until_x in self.ends[a]:
            for y, until_y in self.starts[b]:
                rank = ranks.get(x * size + y, NEVER)
                if rank < until_x and rank <= until_y and rank != NEVER:
                    return False
        return True

    def piece_counts(self, data: bytes) -> list[int]:
        """Tokens of data[:i] for i = 0..len(data), for bytes that the pre-tokenizer keeps together."""
        tokens, pairs, size, n = self.tokens, self.pairs, self.size, len(data)
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before = last[start] * size
            count = counts[start] + 1
            for end in range(start + 1, n + 1):
                token = tokens.get(data[start:end])
                if token is None:
                    break
                if token >= 0 and last[end] < 0:
                    if start:
                        fits = pairs.get(before + token)
                        if fits is None:
                            fits = pairs[before + token] = self._fits(last[start], token)
                        if not fits:
                            continue
                    last[end] = token
                    counts[end] = count
        if len(pairs) > 4 * CACHE:
            pairs.clear()
        return counts

    def pieces(self, chunk: str) -> list[str]:
        return [chunk] if self.blank.fullmatch(chunk) else self.piece.findall(chunk)

    def _total(self, chunk: str) -> int:
        """Tokens of a whole chunk, remembered; so are those of its pieces, which more chunks share."""
        if len(self.totals) > CACHE:
            self.totals.clear()
        if len(self.parts) > CACHE:
            self.parts.clear()
        total = 0
        for part in self.pieces(chunk):
            total += self._part(part)
        self.totals[chunk] = total
        return total

    def _part(self, part: str) -> int:
        known = self.parts.get(part)
        if known is None:
            known = self.parts[part] = self._table(part)[-1]
        return known

    def _table(self, part: str) -> list[int]:
        table = self.tables.get(part)
        if table is None:
            table = self.piece_counts(part.encode())
            if len(part) > LONG:
                self.tables[part] = table
        return table

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, part): special strings stand for themselves, as the library has it by default."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ends, counts): code point ends of all chunks and the tokens up to each, from 0."""
        self.tables.clear()
        ends, counts = [0], [0]
        for special, part in self.segments(text):
            if special:
                ends.append(len(part))
                counts.append(1)
                continue
            chunks = self.chunk.findall(part)
            ends += map(len, chunks)
            known = self.totals.get
            counts += [known(c) or self._total(c) for c in chunks]
        return np.cumsum(ends), np.cumsum(counts)

    def count(self, text: str) -> int:
        return int(self.boundaries(text)[1][-1])

    def prefix_counts(self, text: str, since: int = 0) -> np.ndarray:
        """Tokens of text[:i] for i = 0..len(text), each as if that prefix were the whole text.

        Prefixes that end in pieces up to `since` may be left at 0.

        Chunks before the last are final. Inside one, a piece's own table answers; a prefix that
        ends in white space has the run of white space as one piece, and a contraction that is
        still incomplete stands apart from its apostrophe. Inside a special string the letters
        so far are ordinary text and go with the plain text before.
        """
        out = np.zeros(len(text) + 1, dtype=np.int64)
        base = at = 0
        plain, plain_base = 0, 0  # where the plain text that ends here began, and the tokens before it
        for special, part in self.segments(text):
            if special:
                head = text[plain:at]
                for k in range(1, len(part)):
                    out[at + k] = plain_base + self.count_plain(head + part[:k])
                base += 1
                at += len(part)
                out[at] = base
                plain, plain_base = at, base
                continue
            start, inside = at, base
            run, run_base, run_table = at, base, [0]  # where the white space that ends here began, the tokens before it, its own table
            run_bytes = 0
            for chunk in self.chunk.findall(part):
                before, where = inside, start
                for piece in self.pieces(chunk):
                    if where + len(piece) <= since:
                        before += self._part(piece)
                        where += len(piece)
                        out[where] = before
                        continue
                    table = self._table(piece)
                    size = 0
                    for k, c in enumerate(piece, 1):
                        size += len(c.encode())
                        out[where + k] = before + table[size]
                    if piece in CONTRACTIONS:
                        out[where + 2] = before + 2
                    before += table[-1]
                    where += len(piece)
                for k in range(start, start + len(chunk)):  # prefixes that end in white space
                    if not self.blank.match(text[k]):
                        break
                    if k == at or not self.blank.match(text[k - 1]):
                        run, run_base, run_bytes = k, out[k] if k > at else base, 0
                        run_table = self.piece_counts(self.blank.match(text, k, at + len(part))[0].encode())
                    run_bytes += len(text[k].encode())
                    out[k + 1] = run_base + run_table[run_bytes]
                inside, start = before, start + len(chunk)
            base, at = inside, at + len(part)
        return out

    def count_plain(self, text: str) -> int:
        return sum(self.totals.get(c) or self._total(c) for c in self.chunk.findall(text))


def truncation(prefix_counts: np.ndarray, budget: int) -> int:
    """The most code points that a text can keep within a token budget.

    Counts needn't rise with every character, so the last prefix within the budget is meant.
    """
    return int(np.flatnonzero(prefix_counts <= budget)[-1])


def fitting(counter: PrefixCounter, text: str, limit: int, ends: np.ndarray, counts: np.ndarray) -> int:
    """truncation() for a budget without counting anew: from the table at chunk ends, and prefix_counts() of the one chunk it leaves open."""
    if counts[-1] <= limit:
        return len(text)
    k = int(np.searchsorted(counts, limit, "right"))  # the chunk in which the budget runs out ends at ends[k]
    base = k - 1
    if base and text[ends[base] : ends[k]] in counter.specials:
        base -= 1  # the beginning of a special string goes with the chunk before it
    while base and counter.blank.match(text[ends[base] - 1]):
        base -= 1
    start, end, total = int(ends[k - 1]), int(ends[k]), int(counts[k - 1])
    if text[start:end] not in counter.specials:
        for piece in counter.pieces(text[start:end]):  # later ones are beyond the budget at once
            total += counter._part(piece)
            if total > limit:
                end = start + len(piece)
                break
            start += len(piece)
    inside = counter.prefix_counts(text[ends[base] : end], start - int(ends[base]))
    return int(ends[base]) + truncation(inside, limit - int(counts[base]))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and fitting_chars of every whole text.

    fitting_chars is how many code points of the text stay within the limit, read off the table of
    prefixes that gives n_tokens. A null or empty text has 0 bytes, tokens and characters. Each row
    is counted by itself; no shuffle, and a task keeps one batch and its caches. Other columns are not read.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(tokenizer_path)
        for batch in batches:
            n, fits = [], []
            for text in batch.column(1).to_pylist():
                ends, counts = counter.boundaries(text or "")
                n.append(int(counts[-1]))
                fits.append(fitting(counter, text or "", limit, ends, counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fits, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    schema = f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), n_bytes.alias("n_bytes")).mapInArrow(counted, schema)


def prefix_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts array<long>: tokens of every prefix, for later truncation and budget questions."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(tokenizer_path)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([counter.prefix_counts(text or "")], pa.list_(pa.int64()))], ["doc_id", "counts"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tables, f"doc_id {id_type}, counts array<long>")
