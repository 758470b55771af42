"""Near-duplicate documents by a chosen-path set similarity join over word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, save
from .components import components
from .grouped import in_blocks, runs

WORDS = 5
#: Minwise tokens of a document: the first TREES * ROOTS start the trees, the others extend paths.
TOKENS, TREES, ROOTS, DEPTH = 128, 6, 2, 4
#: Nodes of at most SMALL documents are compared pair by pair at once; larger ones branch while they exceed LARGE.
SMALL, LARGE, BLOCK = 16, 256, 512
#: Nodes above HUGE whose members aren't of one component branch on, by two tokens each time.
HUGE, LEVELS, CHILDREN = 4096, 4, 2
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles; of fewer words, one of the whole; else none.

    known: word -> hash, filled on the way.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    try:
        h = np.array([known[w] for w in words], dtype=np.uint64)
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], dtype=np.uint64)
    factors = _odd(WORDS, 11)
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), dtype=np.uint64)
    for k in range(min(WORDS, len(h))):
        out += h[k : k + n] * factors[k]
    return np.unique(_mixed(out))


def minwise(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least product with each factor: one minwise token per factor."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(values), 4096):
        np.minimum(best, (factors[:, None] * values[None, i : i + 4096]).min(1), out=best)
    return best


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), sig (minwise tokens, 32 bits each) of every row."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _odd(TOKENS, 12)
        known: dict[bytes, int] = {}
        for batch in batches:
            n, d1, d2, sig = [], [], [], []
            for text in batch.column(1).to_pylist():
                if len(known) > 600_000:
                    known.clear()
                s = shingles(text or b"", known)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                n.append(len(s))
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                sig.append((minwise(s, factors) >> np.uint64(32)).astype(np.uint32).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(sketched, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def _paths(reps: DataFrame) -> DataFrame:
    """(rep, p0, p1, ..) for every tree and root token: the nodes that the document passes, from the root down.

    A node is named by the path of chosen tokens to it, and its name says which token its documents
    are divided by next, so each document finds all its paths alone.
    """

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, TOKENS).astype(np.uint64)
            every = np.arange(len(sig))
            levels: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
            for start in range(TREES * ROOTS):
                node = _mixed(sig[:, start] * _GOLD + np.uint64(start))
                levels[0].append(node)
                for depth in range(1, DEPTH):
                    chosen = (node % np.uint64(TOKENS - TREES * ROOTS)).astype(np.int64) + TREES * ROOTS
                    node = _mixed(node + (sig[every, chosen] + np.uint64(depth << 40)) * _GOLD)
                    levels[depth].append(node)
            ids = np.tile(batch.column(0).to_numpy(), TREES * ROOTS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(np.concatenate(x).view(np.int64)) for x in levels]], ["rep", *[f"p{k}" for k in range(DEPTH)]])

    return reps.select("rep", "sig").mapInArrow(walked, "rep long, " + ", ".join(f"p{k} long" for k in range(DEPTH)))


def _leaves(paths: DataFrame) -> DataFrame:
    """(node, rep, n) for each path's leaf: the first node of at most LARGE documents, or the deepest; none alone."""
    found, rest = [], save(paths)
    for depth in range(DEPTH):
        key = f"p{depth}"
        sizes = save(rest.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"))
        here = save(join_skewed(rest, sizes, [key], "n", "rep"))
        last = depth == DEPTH - 1
        found.append((here if last else here.where(F.col("n") <= LARGE)).select(F.col(key).alias("node"), "rep", "n"))
        if last:
            break
        rest = here.where(F.col("n") > LARGE).drop("n")
        if rest.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    # nodes with the same members need one visit
    same = out.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who")).groupBy("n", "who").agg(F.min("node").alias("node"))
    return save(join_skewed(out.drop("n"), save(same.select("node", "n")), ["node"], "n", "rep"))


def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of minwise tokens in which two signatures agree."""
    x, y = (np.frombuffer(b"".join(c), dtype=np.uint32).reshape(-1, TOKENS) for c in (a, b))
    return pd.Series((x == y).mean(1))


def _alike(small: DataFrame, large: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of small nodes, and of large nodes' members with two pivots, whose minwise tokens agree often enough.

    A pivot's tokens travel with its node, so a pivot of very many members is no one task's key.
    """
    agreement = F.pandas_udf(_agreement, "double")
    other = small.select("node", F.col("rep").alias("b"))
    pairs = small.select("node", F.col("rep").alias("a")).join(other, "node").where("a < b").select("a", "b").distinct()
    of = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    near = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(of, "b")
    pivots = large.groupBy("node").agg(F.count("*").alias("n"), F.array_distinct(F.array(F.min("rep"), F.min_by("rep", F.xxhash64("rep")))).alias("p"))
    pivots = pivots.select("node", "n", F.explode("p").alias("b")).join(of, "b").groupBy("node", "n").agg(F.collect_list(F.struct("b", "sb")).alias("p"))
    members = large.select("node", F.col("rep").alias("a")).join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
    to_pivot = join_skewed(members, save(pivots), ["node"], "n", "a").select("a", "sa", F.explode("p").alias("p")).select("a", "sa", "p.*").where("a <> b")
    return near.select("a", "b", "sa", "sb").unionByName(to_pivot).where(agreement("sa", "sb") >= least).select("a", "b").distinct()


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets have 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, by their full sets."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(a, b, strict=True)], dtype=bool)

    met = pairs.groupBy("b").agg(F.count("*").alias("n"))
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")).join(met, "b")
    fits = (F.least(F.length("sa"), F.length("sb")) * 100) >= F.greatest(F.length("sa"), F.length("sb")) * percent
    return join_skewed(pairs.join(left, "a"), right, ["b"], "n", "a").where(fits).where(linked("sa", "sb")).select("a", "b")


def _divided(rows: DataFrame) -> DataFrame:
    """(node, rep, root, sig, n) with nodes of more than HUGE members divided by further tokens.

    Each node's members go to CHILDREN nodes at a time, by tokens that the node's name chooses, so a pair that
    agrees in more than half its tokens is likely to stay together somewhere however deep it goes.
    Nodes of one component are left out; what is still large after LEVELS is compared as it is.
    """

    def branched(level: int):
        def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, TOKENS).astype(np.uint64)
                parent = batch.column("node").to_numpy().view(np.uint64)
                for k in range(CHILDREN):
                    name = _mixed(parent + np.uint64((DEPTH + level) * CHILDREN + k + 1))
                    chosen = (name % np.uint64(TOKENS - TREES * ROOTS)).astype(np.int64) + TREES * ROOTS
                    node = _mixed(name + sig[np.arange(len(sig)), chosen] * _GOLD)
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(batch.column(c) for c in ("rep", "root", "sig"))], ["node", "rep", "root", "sig"])

        return children

    done = []
    for level in range(LEVELS):
        large = rows.where(F.col("n") > HUGE)
        if large.isEmpty():
            break
        done.append(rows.where(F.col("n") <= HUGE))
        made = save(large.select("node", "rep", "root", "sig").mapInArrow(branched(level), "node long, rep long, root long, sig binary"))
        mixed = made.groupBy("node").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("node", "n")
        rows = save(join_skewed(made, save(mixed), ["node"], "n", "rep"))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _across(leaves: DataFrame, roots: DataFrame, sigs: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Links between different components in nodes too large to be compared at once: all pairs, in blocks.

    A first pass finds, by the tokens, the members that are close to one of another component; only
    their sets are fetched for the second, which confirms links and gives no more of them than it
    takes to join the members of a block.
    """
    known = save(leaves.where(F.col("n") > SMALL).select("node", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    mixed = known.groupBy("node").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("node", "n")
    rows = _divided(save(join_skewed(known, save(mixed), ["node"], "n", "rep").join(sigs, "rep")))

    def close(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """(member, the members after it that are close and of another component), by position."""
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, root = table.column("block").to_numpy(), table.column("root").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)
        every = np.arange(len(own))
        first, second = (every, every) if i == j else (every[own == i], every[own == j])
        for k in first:
            to = second[(second > k) | (i != j)]
            to = to[root[to] != root[k]]
            yield k, to[(sig[to] == sig[k]).mean(1) >= least]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["key", "i", "j"]):
            some = np.zeros(table.num_rows, dtype=bool)
            for k, to in close(table):
                some[to] = True
                some[k] |= len(to) > 0
            if some.any():
                yield from table.filter(pa.array(some)).combine_chunks().to_batches()

    schema = "key long, i int, j int, id long, block int, root long, sig binary"
    near = save(in_blocks(rows, "node", "rep", "n", BLOCK, ["root", "sig"]).mapInArrow(found, schema))
    near = near.join(sets, near["id"] == sets["rep"]).drop("rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["key", "i", "j"]):
            ids, root = table.column("id").to_numpy(), dict(enumerate(table.column("root").to_pylist()))
            shingles_of = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
            joined = {r: r for r in root.values()}

            def top(x: int, joined: dict[int, int] = joined) -> int:
                while joined[x] != x:
                    joined[x] = x = joined[joined[x]]
                return x

            a, b = [], []
            for k, to in close(table):
                for m in to.tolist():
                    if top(root[k]) != top(root[m]) and _linked(shingles_of[k], shingles_of[m], percent):
                        joined[top(root[k])] = top(root[m])
                        a.append(min(ids[k], ids[m]))
                        b.append(max(ids[k], ids[m]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return near.mapInArrow(confirmed, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents whose shingle sets have 100 * intersection >= percent * union.

    Documents with equal sets are one class. Six trees of chosen paths divide the classes by their
    minwise tokens: a tree starts with two tokens, and nodes of more than LARGE classes branch again
    by a further token, up to four levels. A pair at 0.85 shares one of the twelve starts with
    probability 1 - 0.15 ** 12, and one of their deepest nodes with 0.999. Nodes of up to SMALL classes
    are compared exhaustively. In larger ones every class is first compared with two pivots; what
    isn't of one component then branches on while it exceeds HUGE, by two tokens a level (a pair
    at 0.85 then shares a leaf with 0.9997), and is compared exhaustively, in blocks, however large it stays.
    Comparisons estimate by the tokens, with a margin of four deviations, and full sets confirm.

    Returns doc_id, n_shingles, component_id (the smallest id reached), kept (doc_id = component_id). Words
    are split at ASCII white space and lower-cased in A-Z. A null, empty or blank text has no
    shingle, is linked with nothing and is kept. Rows without an id join the component of their text,
    whose id is that of the others; alone they have none and are kept. Rows that repeat an id with
    another text count as texts of one document. Other columns are not read.
    """
    least = percent / 100 - 4 * math.sqrt(percent / 100 * (1 - percent / 100) / TOKENS)
    rows = save(_sketches(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    classes = save(rows.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")))
    sigs = classes.where("rep IS NOT NULL").select("rep", "sig")
    leaves = _leaves(_paths(sigs))

    small = leaves.where(F.col("n") <= SMALL)
    large = leaves.where(F.col("n") > SMALL)
    first = save(_alike(small, large, sigs, least))

    # full sets of the classes that may be linked; these ids grow with the corpus, so they are never broadcast
    wanted = first.select(F.col("a").alias("rep")).union(first.select("b")).union(large.select("rep")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("binary").alias("text")).where(F.col(text_col).isNotNull())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            if len(known) > 600_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, known).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["rep", "shingles"])

    sets = save(texts.join(wanted.hint("merge"), "rep", "left_semi").mapInArrow(listed, "rep long, shingles binary"))
    links = save(_verified(first, sets, percent))
    roots = components(links)
    more = save(_across(leaves, roots, sigs, sets, least, percent))
    if not more.isEmpty():
        roots = components(links.union(more))

    by_class = save(classes.join(roots, F.col("rep") == F.col("id"), "left").select("d1", "d2", "copies", F.coalesce("root", "rep").alias("root")))
    worded = join_skewed(rows.where("n_shingles > 0").drop("sig"), by_class, ["d1", "d2"], "copies", "_row").select("doc_id", "n_shingles", "root")
    joined = worded.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("root")))
    return joined.select("doc_id", "n_shingles", F.col("root").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("root")).alias("kept"))
