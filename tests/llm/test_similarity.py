import itertools
import math
import random
import struct

import numpy as np
import pytest
import xxhash

from tidemark.llm import components, embeddings, fingerprints, minhash
from tidemark.llm.common import join_skewed


def word_sets(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def roots_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = [None, "", " \n\t", "One two", "ONE  two", "one two three four", "a b c d e", "A B C D E", "ä Ä"]
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 160))]
        if k % 3 == 0:
            words[10:10] = passage
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            other = list(words)
            for _ in range(rng.randrange(0, 5)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append("\v".join(other))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(n // 2):  # one large group, parts of which are too far from each other
        other = list(base)
        for _ in range(rng.randrange(0, 9)):
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
        texts.append(" ".join(other).upper())
    return texts


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_all_pairs(spark, percent):
    texts = corpus(percent, 160)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS component_id", "3 AS node", "4 AS n")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, percent).collect()}
    sets = [word_sets(t) for t in texts]
    links = []
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    want = roots_of(range(len(texts)), links)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_near_duplicates_with_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "x y z"), (None, None), (3, None), (9, "q " * 30_000)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or -1), r["n_shingles"], (r["component_id"] or -1), r["kept"]) for r in got) == [
        (-1, 0, -1, True), (-1, 1, -1, True), (-1, 2, 7, False), (3, 0, 3, True), (7, 2, 7, True), (7, 2, 7, True), (9, 1, 9, True),
    ]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(120):
            x = rng.normal(size=64)
            rows.append((i, x.tolist(), label))
            i += 1
            for _ in range(rng.integers(0, 4)):
                y = x / np.linalg.norm(x) + rng.normal(size=64) * rng.choice([0.0, 0.005, 0.02, 0.03])
                rows.append((i, (y * 3).tolist(), label))
                i += 1
    rows += [(i, None, 1), (i + 1, [0.0] * 64, 1), (i + 2, [None] * 64, 1), (i + 3, [math.inf] + [1.0] * 63, 1), (i + 4, [], 1), (i + 5, [1.0, 2.0, 2.5], 1), (i + 6, [2.0, 4.0, 5.0], 1), (i + 7, [1e38] * 64, 0), (i + 8, [1e-38] * 64, 0)]
    rows += [(i + 20 + k, rows[0][1], 0) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("vec_id", "CAST(embedding AS array<float>) AS embedding", "label", "1 AS rep", "2 AS n")
    table = {r["vec_id"]: (np.array([np.nan if c is None else c for c in r["embedding"] or []], dtype=float), r["label"]) for r in df.collect()}
    ok = {k: v / np.linalg.norm(v) for k, (v, label) in table.items() if label is not None and len(v) and np.isfinite(v).all() and v.any()}
    links = [(a, b) for a, b in itertools.combinations(sorted(ok), 2) if table[a][1] == table[b][1] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.98]
    want, n = roots_of(table, links), dict.fromkeys(table, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df).collect()}
    assert got.keys() == table.keys()
    found = sum(r["n_links"] for r in got.values())
    assert all(got[k]["n_links"] <= n[k] for k in n) and found >= 0.99 * sum(n.values()) and len(links) > 500
    assert sum(got[k]["component_id"] == want[k] for k in want) >= 0.99 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert got[i + 6]["component_id"] == i + 5 and got[i + 8]["n_links"] == 1
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_list_decoding_finds_all_exceeding_filters():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 9))
    row, chosen = embeddings.decode(x / np.linalg.norm(x, axis=1, keepdims=True), 1, 16, 0.3)
    rotation, directions = embeddings.codes(10, 1, 16)
    want = set()
    for i, v in enumerate(np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, 1))) @ rotation):
        a, b = v[:5] / np.linalg.norm(v[:5]), v[5:] / np.linalg.norm(v[5:])
        want |= {(i, p * 16 + q) for p in range(16) for q in range(16) if (a @ directions[0, p] + b @ directions[1, q]) / 2 >= 0.3}
    assert set(zip(row.tolist(), chosen.tolist(), strict=True)) == want


@pytest.mark.parametrize("dim", [3, 16, 64, 128, 384, 768])
def test_vectors_of_any_width_meet(spark, dim):
    rng = np.random.default_rng(dim)
    x, y = rng.normal(size=(2, 300, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.981 * x + math.sqrt(1 - 0.981**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    df = spark.createDataFrame([(2 * i + k, v[i].tolist(), 1) for i in range(300) for k, v in enumerate((x, y))], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_vectors(df).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(300)) >= 0.99 * 300
    per_code = np.bincount(embeddings.decode(x, 0, embeddings.CODES, embeddings.cap(dim, 0.98), embeddings.FEWEST)[0], minlength=300)
    assert per_code.min() >= embeddings.FEWEST and (per_code.mean() < 60 or dim == 3)


def test_dense_groups_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)  # so that groups are compared in blocks
    rng = np.random.default_rng(11)
    base = rng.normal(size=(3, 24))
    rows = [(i, (base[i % 3] + rng.normal(size=24) * 0.14).tolist(), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= 0.98) & (np.arange(600)[:, None] % 2 == np.arange(600) % 2) & ~np.eye(600, dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df).collect()}
    want = close.sum(axis=1)
    assert 0.2 < want.mean() / 100 < 0.95 and all(got[i] <= want[i] for i in range(600))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_joins_of_skewed_keys(spark):
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(3000)], "id long, k long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").where("k <> 9").selectExpr("k", "n", "k * 2 AS v")
    inner, outer = (join_skewed(left, right, ["k"], "n", "id", how).collect() for how in ("inner", "left"))
    assert sorted(r["id"] for r in outer) == list(range(3000)) and len(inner) == 2999
    assert all(r["v"] == (None if r["k"] == 9 else 2 * r["k"]) for r in outer)
    assert join_skewed(left, right.limit(0), ["k"], "n", "id", "left").count() == 3000


def test_large_mixed_nodes_are_divided(spark, monkeypatch):
    for name, value in (("SMALL", 2), ("LARGE", 4), ("BLOCK", 8), ("HUGE", 8)):
        monkeypatch.setattr(minhash, name, value)
    test_near_duplicates_against_all_pairs(spark, 85)


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs just above the threshold that no other text links: nearly all are found, with no false one."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(20_000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for k in range(400):
        words = [rng.choice(vocabulary) for _ in range(150)]
        if k % 2:  # half of the pairs share a passage with each other pair
            words[40:40] = passage
        cut, new = (12, 20) if k % 2 else (8, 16)
        texts += [words, words[:-cut] + [rng.choice(vocabulary) for _ in range(new)]]
    texts = [" ".join(t) for t in texts]
    sets = [word_sets(t) for t in texts]
    linked = [100 * len(sets[2 * k] & sets[2 * k + 1]) >= 85 * len(sets[2 * k] | sets[2 * k + 1]) for k in range(400)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [got[2 * k + 1] == 2 * k for k in range(400)]
    assert sum(linked) == 400 and sum(found) >= 0.99 * 400
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_vectors_without_filters_get_their_best():
    x = np.random.default_rng(3).normal(size=(10, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, chosen = embeddings.decode(x, 0, 16, 2.0, 4)
    for i, (a, b) in enumerate(embeddings.products(x, 0, 16)):
        assert set(chosen[row == i].tolist()) == set(np.argsort(-(a[:, None] + b).ravel())[:4].tolist())


def brute_sketch(text):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return seed

    if len(h) < 5:
        acc = 0
        for v in h:
            acc = signed(chain([acc, v]))
        found = {acc} if h else set()
    else:
        found = {signed(chain(h[i : i + 5])) for i in range(len(h) - 4)}
    return sorted(x for x in found if 0 <= x < 1 << 62)


def test_fingerprints_against_brute_force(spark):
    import hashlib

    rng = random.Random(3)
    texts = [" ".join(rng.choice("alpha beta gamma Delta é 漢 x".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(0, 90))) for _ in range(70)] + ["", None, "one two", "abc"] * 2
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sketch", "2 AS edited", "3 AS _at")
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(df).collect()}
    order = sorted(dict(rows), reverse=True)
    text = {k: v or "" for k, v in rows}
    assert sorted(got) == sorted(text)
    form = lambda s: ",".join(f"{x:x}" for x in s)
    for k, following in zip(order, order[1:] + order[:1], strict=True):
        t, other, r = text[k], text[following], got[k]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + other[:cut]
        a, e, o = brute_sketch(t), brute_sketch(edited), brute_sketch(other)
        like = lambda x, y, same: 1.0 if same else len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0.0
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (form(a), form(e))
        assert r["near_edited"] == pytest.approx(like(a, e, t == edited)) and r["near_next"] == pytest.approx(like(a, o, t == other))


def test_fingerprints_of_odd_tables(spark):
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 6
    assert fingerprints.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "x y"), (None, "p q"), (4, "abcabc"), (4, "zzz"), (4, "zzz"), (6, None)], "doc_id long, text string")
    assert fingerprints.fingerprint_documents(rows).count() == 6


def test_sketches_merge_and_contain(spark):
    a, b = "a b c d e f g h " * 3, " ".join(f"t{i}" for i in range(400))
    df = spark.createDataFrame([(a, b, a + b)], "a string, b string, c string")
    for n in "abc":
        df = fingerprints.with_sketch(df, fingerprints.F.col(n), f"s{n}", 2)
    r = df.select(fingerprints.containment(fingerprints.F.col("sb"), fingerprints.F.col("sc")).alias("x"), fingerprints.containment(fingerprints.F.col("sb"), fingerprints.merged(fingerprints.F.col("sa"), fingerprints.F.col("sb"))).alias("y")).first()
    assert r["x"] > 0.95 and r["y"] == 1.0


def test_components_of_one_large_hub_and_one_long_chain(spark):
    hub = spark.range(1, 60_000).selectExpr("id AS a", "0L AS b")
    chain = spark.range(100_000, 101_000).selectExpr("id AS a", "id + 1 AS b")
    got = components.components(hub.union(chain)).groupBy("root").count().collect()
    assert {r["root"]: r["count"] for r in got} == {0: 60_000, 100_000: 1001}
