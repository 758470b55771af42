"""Prefix tries of conversations, by van Emde Boas recursion over their depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, save, with_rank
from .mixing import word_count

#: Conversations whose ids share c - c % SHARED start with turns of that one, h of them, h < MOST_BORROWED + 1.
SHARED, MOST_BORROWED = 20, 3
#: Positions of one sequence that may meet in one join key, as a power of two.
MEET = 16
#: Ids in one piece of a node's list of sequences that end there.
PIECE = 512
_NOTHING = hashlib.sha256(b"").hexdigest()


def named(*parts: Column) -> Column:
    """A 128-bit name: the head of a SHA-256 digest, so equal things have equal names without a look-up."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def borrowed(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % (MOST_BORROWED + 1)).cast("int")


def rebuilt_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((seq, pos, token, words), (seq, last)): the rebuilt conversations' turns by position from 0, and their numbers of turns.

    Conversation c gets the first h original turns of c - c % 20 and then its own after its first h, h being CRC-32 of
    its decimal id modulo 4. Turns go by turn, null first, equal ones by role and text. token names (role,
    text), nulls as empty texts. Rows without id belong to no conversation and are left out. A
    conversation of any length is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("seq"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    tied = not rows.groupBy("seq", "turn").count().where("count > 1").isEmpty()
    order = ["turn", "role", "text"] if tied else ["turn"]
    token = named(F.length("role").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("role").cast("binary"), F.col("text").cast("binary"))
    turns = rows.select("seq", *order, token.alias("token"), word_count(F.col("text")).cast("long").alias("words"))
    turns = save(with_rank(turns, ["seq"], order, "r").select("seq", "r", "token", "words"))
    heads = turns.where(F.col("r") < MOST_BORROWED).select(F.col("seq").alias("_of"), F.col("r").alias("_r"), "token", "words")
    of = F.col("seq") - F.pmod("seq", F.lit(SHARED))
    own = turns.groupBy("seq").agg(F.count("*").alias("n")).select("seq", "n", borrowed(F.col("seq")).alias("h"), of.alias("of"))
    given = heads.groupBy(F.col("_of").alias("_by")).agg(F.count("*").alias("_given"))
    own = own.join(given, F.col("of") == F.col("_by"), "left")
    own = save(own.select("seq", "n", "h", "of", F.least("h", F.coalesce("_given", F.lit(0))).cast("long").alias("got")))
    first = own.join(heads, (F.col("of") == F.col("_of")) & (F.col("_r") < F.col("h"))).select("seq", F.col("_r").alias("pos"), "token", "words")
    rest = join_skewed(turns, own, ["seq"], "n", "r").where("r >= h").select("seq", (F.col("got") + F.col("r") - F.col("h")).alias("pos"), "token", "words")
    last = own.select("seq", (F.col("got") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("last"))
    return save(first.unionByName(rest)), save(last)


def prefix_names(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(seq, pos, name): a name for each prefix of each sequence, equal for equal prefixes; pos turns long, 0 to the whole.

    turns (seq, pos, token) at positions 0 .. last - 1; lengths (seq, last). Sequences are cut at half
    depth, halves again, down to single turns. All cuts of one level are made together: blocks of 2 ** k
    turns are named from the two halves of each on the way up; on the way down the prefix that ends
    at a cut is named from the prefix before its block and the block's upper half. That is the name of
    the lower forest that hangs there, and both halves go on from their names apart. Level k has a
    block for 2 ** k turns, so all levels together are about twice the turns, and a join key is one block.
    """
    deepest = lengths.agg(F.max("last")).first()[0] or 0
    levels = int(deepest).bit_length()
    blocks = [turns.select("seq", F.col("pos").alias("j"), F.col("token").alias("digest"))]
    for _ in range(1, levels):
        half = lambda side: F.max(F.when(F.col("j") % 2 == side, F.col("digest")))
        pairs = blocks[-1].groupBy("seq", F.floor(F.col("j") / 2).cast("long").alias("_j")).agg(half(0).alias("a"), half(1).alias("b"))
        blocks.append(save(pairs.where("a IS NOT NULL AND b IS NOT NULL").select("seq", F.col("_j").alias("j"), named(F.col("a"), F.col("b")).alias("digest"))))
    height = F.length(F.bin("last")) - F.when(F.col("last") == 0, 1).otherwise(0)  # levels that a sequence needs
    starts = lengths.select("seq", F.lit(0).cast("long").alias("j"), F.lit(b"").alias("name"), height.alias("_height"))
    at = lambda k: starts.where(F.col("_height") == k).drop("_height")
    names = at(levels)
    for k in range(levels - 1, -1, -1):
        upper = blocks[k].select(F.col("seq").alias("_s"), F.col("j").alias("_j"), "digest").where("_j % 2 = 0")
        met = names.join(upper, (F.col("seq") == F.col("_s")) & (F.col("j") * 2 == F.col("_j")), "left")
        left = F.struct((F.col("j") * 2).alias("j"), F.col("name").alias("name"))
        right = F.struct((F.col("j") * 2 + 1).alias("j"), named(F.col("name"), F.col("digest")).alias("name"))
        parts = F.explode(F.when(F.col("digest").isNull(), F.array(left)).otherwise(F.array(left, right))).alias("_c")
        below = met.select("seq", parts).select("seq", "_c.j", "_c.name").unionByName(at(k))
        names = save(below)
    return names.select("seq", F.col("j").alias("pos"), "name")


def grafted(places: DataFrame, nodes: DataFrame, weights: list[str], deepest: int) -> DataFrame:
    """(name, weights): the sums of the weights over each node's subtree, itself included.

    places (seq, pos, last, name) is the node at each place of each sequence, nodes (name, depth, conv_id and
    weights) has a sequence through each node. Level by level, trees of height 2 ** k hang
    below trees of that height: the total of every lower tree is added to all nodes above it in its
    upper tree, which lie on one sequence through its top. After the last level every node has its subtree.
    """
    parts = [nodes.select("name", "depth", *weights)]
    for k in range(int(deepest).bit_length()):
        step, meet = 1 << k, min(k, MEET)
        hangs = F.col("depth").bitwiseAND(2 * step - 1) == step
        tops = parts[0].where(hangs)
        for p in parts[1:]:
            tops = tops.unionByName(p.where(hangs))
        tops = tops.groupBy("name").agg(*[F.sum(w).alias(w) for w in weights])
        tops = tops.join(nodes.where(hangs).select(F.col("name").alias("_n"), "conv_id", "depth"), F.col("name") == F.col("_n"))
        last_meet = F.shiftright(F.col("depth") - 1, meet)
        tops = tops.select(F.col("conv_id").alias("_s"), F.explode(F.sequence(F.shiftright(F.col("depth") - step, meet), last_meet)).alias("_m"), *weights)
        above = places.where((F.col("pos").bitwiseAND(step) == 0) & (F.col("last") >= (F.shiftright("pos", k) + 1) * step))
        above = above.select("seq", F.shiftright("pos", meet).alias("_at"), "name", F.col("pos").alias("depth"))
        met = above.join(tops, (F.col("seq") == F.col("_s")) & (F.col("_at") == F.col("_m")))
        parts.append(save(met.groupBy("name", "depth").agg(*[F.sum(w).alias(w) for w in weights])))
    whole = parts[0].drop("depth")
    for p in parts[1:]:
        whole = whole.unionByName(p.drop("depth"))
    return whole.groupBy("name").agg(*[F.sum(w).alias(w) for w in weights])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (seq, name): SHA-256 of each name's ids in numeric order, comma-joined.

    Ids are ranked over ranges and joined to pieces of PIECE ids in parallel; only the digest of a list of
    several pieces, which is sequential by nature, reads them one after another, a piece at a time.
    """
    ranked = with_rank(ends, ["name"], ["seq"], "_r").withColumn("_piece", F.floor(F.col("_r") / PIECE).cast("long"))
    ids = F.transform(F.array_sort(F.collect_list("seq")), lambda x: x.cast("string"))
    pieces = save(ranked.groupBy("name", "_piece").agg(F.array_join(ids, ",").alias("ids")))
    counts = pieces.groupBy("name").agg(F.max("_piece").alias("_last"))
    several = counts.where("_last > 0").select(F.col("name").alias("_n"))
    one = pieces.where("_piece = 0").join(several, F.col("name") == F.col("_n"), "left_anti").select("name", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    long = pieces.join(several, F.col("name") == F.col("_n"), "left_semi").repartition("name").sortWithinPartitions("name", "_piece").select("name", "ids")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda name, d: pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([d.hexdigest()])], ["name", "ends_sha256"])
        current, digest = None, None
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name == current:
                    digest.update(b",")
                else:
                    if digest is not None:
                        yield told(current, digest)
                    current, digest = name, hashlib.sha256()
                digest.update(ids.encode())
        if digest is not None:
            yield told(current, digest)

    return one.unionByName(long.mapInArrow(digested, "name binary, ends_sha256 string"))


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see rebuilt_turns), from the root of depth 0.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (words that members need not repeat, over the subtree) and ends_sha256. Members of a node
    are the conversations that start with its turns; turnless ones are members of the root alone. An
    empty table, or one without ids, has no node. Other columns are not read.
    """
    turns, lengths = rebuilt_turns(conversations, id_col, turn_col, role_col, text_col)
    deepest = lengths.agg(F.max("last")).first()[0] or 0
    names = prefix_names(turns, lengths)
    words = turns.select(F.col("seq").alias("_s"), F.col("pos").alias("_p"), "words")
    placed = join_skewed(names, lengths.withColumn("_n", F.col("last") + 1), ["seq"], "_n", "pos").drop("_n")
    places = save(placed.join(words, (F.col("seq") == F.col("_s")) & (F.col("pos") == F.col("_p")), "left").select("seq", "pos", "last", "name", "words"))
    found = places.groupBy("name").agg(F.min("seq").alias("conv_id"), F.first("pos").alias("depth"), F.count("*").alias("n_convs"))
    before = places.select(F.col("seq").alias("_s"), F.col("pos").alias("_p"), F.col("name").alias("parent"), "words")
    nodes = save(found.join(before, (F.col("conv_id") == F.col("_s")) & (F.col("depth") - 1 == F.col("_p")), "left").drop("_s", "_p"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("_n"))
    own = nodes.join(children, F.col("name") == F.col("_of"), "left").withColumn("n_children", F.coalesce("_n", F.lit(0))).drop("_of", "_n")
    saved = F.coalesce((F.col("n_convs") - 1) * F.col("words"), F.lit(0))
    own = save(own.select("name", "depth", "conv_id", "n_convs", "parent", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.alias("saved_tokens")))
    totals = grafted(places.drop("words"), own, ["n_leaves", "saved_tokens"], deepest).withColumnRenamed("name", "_t")
    ends = ends_digests(places.where("pos = last").select("seq", "name")).withColumnRenamed("name", "_e")
    whole = own.drop("n_leaves", "saved_tokens").join(totals, F.col("name") == F.col("_t")).join(ends, F.col("name") == F.col("_e"), "left")
    parents = own.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    lower = join_skewed(whole.where("parent IS NOT NULL").withColumnRenamed("n_children", "_own"), parents, ["parent"], "n_children", "name").drop("n_children").withColumnRenamed("_own", "n_children")
    root = whole.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    digest = F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256")
    return root.unionByName(lower).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)
