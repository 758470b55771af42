import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import mixing, packing, sharding, token_counts

ODD = [None, "", " ", "it's we've I'll 're ''re 'r", "a  b\n\n c \t d   ", "x<|endoftext|> y<|endo", "Ünïcödé ñandú 漢字 é́   z \x1c\x1f q", "7788 12,5 ---- !!!\r\n", "w" * 3000, "emoji 😀👍🏽 ퟿", "foo " * 2000]


def docs(spark, texts, **extra):
    return spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(spark, counter):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["the", "ing", " ", "  ", "\n", "'s", "é", "Ω", "9", "!", "tion", " "]) for _ in range(60)) for _ in range(100)]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs(spark, texts), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(texts):
        want = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len((t or "").encode()), want > 512), t


def test_every_prefix_equals_the_library(counter):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    texts = [t for t in ODD if t and len(t) < 200] + ["".join(rng.choice(["the", "ing", " ", "  ", "\n", "'s", "'re", "é", "9", "!", "tion", "'"]) for _ in range(40)) for _ in range(40)]
    for t in texts:
        table = counter.prefix_counts(t)
        assert table.tolist() == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], t
        cut = token_counts.truncation(table, 7)
        assert table[cut] <= 7 and (table[cut + 1 :] > 7).all()
        assert counter.count(t) == table[-1]


def test_special_strings_after_marks_and_long_blanks(counter):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("a!!<|endoftext|>!b", "x  <|endoftext|>  y", " " * 300 + "x" + "\n" * 90 + " y"):
        assert counter.prefix_counts(t).tolist() == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], t
    import time

    start = time.time()
    counter.prefix_counts(" " * 60_000 + "x")
    assert time.time() - start < 20


def test_fitting_characters_against_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(12)
    parts = ["the", "ing", " ", "  ", "\n", "'s", "'re", "é", "9", "!!", "tion", "<|endoftext|>", "   "]
    texts = [t for t in ODD if t is None or len(t) < 200] + ["".join(rng.choice(parts) for _ in range(60)) for _ in range(60)]
    for limit in (0, 5, 17):
        got = {r["doc_id"]: r for r in token_counts.count_tokens(docs(spark, texts), path, limit).collect()}
        for i, t in enumerate(texts):
            counts = [len(lib.encode((t or "")[:k], add_special_tokens=False).ids) for k in range(len(t or "") + 1)]
            assert got[i]["fitting_chars"] == max(k for k, c in enumerate(counts) if c <= limit), (limit, t)


def test_prefix_table(spark):
    rows = token_counts.prefix_table(docs(spark, ["a b", None]), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"], r["counts"]) for r in rows) == [(0, [0, 1, 2, 2]), (1, [0])]


def test_feistel_is_a_bijection_with_inverse():
    for n in (1, 2, 3, 10, 1000, 4097):
        p = sharding.permute(np.arange(n), n, 5)
        assert sorted(p) == list(range(n))
        assert (sharding.unpermute(p, n, 5) == np.arange(n)).all()
    assert sharding.row_at(*sharding.place(77, 1000, 40, 5), 1000, 40, 5) == 77


def brute_place(row, n, shards, seed):
    """Shard and slot of a row number: six Feistel rounds in whole numbers, again until the value is below n."""
    keys = np.random.default_rng(seed).integers(1, 2**31 - 1, size=(6, 2)).tolist()
    width = max(1, (max(n, 2) - 1).bit_length())
    half = -(-width // 2)
    x = row
    while True:
        left, right = divmod(x, 2**half)
        for a, b in keys:
            f = (right * a + b) % (2**31 - 1)
            left, right = right, left ^ ((f ^ (f >> 13)) % 2**half)
        x = left * 2**half + right
        if x < n:
            return x % shards, x // shards


def test_sharding(spark):
    texts = [None, "", "x", "x", "é"] * 41
    df = docs(spark, texts).union(docs(spark, ["x", "x"])).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS _part")
    df = df.unionByName(df.limit(1).selectExpr("CAST(NULL AS long) AS doc_id", "'z' AS text", "source", "1 AS shard", "2 AS slot", "3 AS _part"))
    rows = sharding.shard_documents(df).collect()
    table = [*enumerate(texts), (0, "x"), (1, "x"), (None, "z")]
    order = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), 16 + len((t or "").encode())) for i, t in table)
    want = sorted((k[1] if k[0] else -1, size, crc, *brute_place(row, len(table), 40, 20)) for row, (k, crc, size) in enumerate(order))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] is None and r["law"] == "rows"
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 40
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard_documents(df.limit(0)).count() == 0


def brute_mix(rows, seed="mix"):
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, free, budget = {}, list(order), 1.5 * sum(sizes.values())
    while free:
        level = budget / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
            free.remove(s)
    out = []
    for s in order:
        u = int(hashlib.md5(f"{seed}:{chr(0) + 'null' if s is None else s}".encode()).hexdigest()[:7], 16) / 2**28
        e = min(2.0, target[s] / sizes[s]) if sizes[s] else 0
        for i, (d, n, _) in enumerate(sorted((r for r in rows if r[2] == s), key=lambda r: (r[1], r[0]))):
            step = e - math.floor(e)
            copies = math.floor(e) + math.floor(u + step * (i + 1)) - math.floor(u + step * i)
            out.append((d, n, sizes[s], round(target[s], 6), copies * n))
    return sorted(out)


def test_mixing_matches_brute_force(spark):
    rng = random.Random(1)
    texts = [None if k % 50 == 0 else " \n\t" if k % 51 == 0 else " ".join(["w x"] * rng.choice([1, 1, 5, 40])) + "\x0b" for k in range(400)]
    rows = [(k, t, rng.choice(["a", "a", "a", "b", "Z", None, "é"]) if k != 100 else "empty") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS target", "2 AS size", "3 AS copies", "0 AS level")
    got = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix_sources(df).collect())
    want = brute_mix([(d, len((t or "").encode().split()), s) for d, t, s in rows])
    assert got == want
    assert mixing.mix_sources(df.limit(0)).count() == 0
    by = {}
    for d, n, size, target, taken in got:
        assert taken <= 2 * n
        by.setdefault((size, target), []).append(taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 80


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["Foo", "bar,", "naïve", "x1"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    df = docs(spark, texts).selectExpr("*", "1 AS length", "2 AS piece", "0 AS sequence_id")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(df, path).collect()
    want = []
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    n = check_packing(rows, 2048)
    assert n <= math.ceil(sum(w[3] for w in want) / 2048) + 1
    assert packing.pack_documents(df.limit(0), path).count() == 0
    cut = packing.cut(df, path)
    whole = packing.sequences(packing.pack(cut.drop("ids")), cut).collect()
    assert len(whole) == n and sum(len(r["ids"]) for r in whole) == 4 * sum(w[3] for w in want)


def brute_best_two_fit(pieces, capacity):
    left, bins = sorted(pieces, reverse=True), []
    while left:
        held, gap = [], capacity
        for n in list(left):
            if n <= gap:
                held.append(n)
                left.remove(n)
                gap -= n
        if gap and len(held) > 1:
            small = min(held)
            room = gap + small
            best = max(((a + b, b, a) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= room), default=None, key=lambda x: x[0])
            if best:
                held.remove(small)
                left.append(small)
                left.sort(reverse=True)
                for n in best[1:]:
                    left.remove(n)
                    held.append(n)
        bins.append(sum(held))
    return len(bins)


def test_best_two_fit_against_one_piece_at_a_time():
    rng = random.Random(7)
    for _ in range(60):
        pieces = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 120))]
        counts = {n: pieces.count(n) for n in set(pieces)}
        plan = packing.best_two_fit(counts, 100)
        made = {}
        for times, items in plan:
            assert sum(n * c for n, c in items) <= 100
            for n, c in items:
                made[n] = made.get(n, 0) + times * c
        assert made == counts
        assert abs(sum(t for t, _ in plan) - brute_best_two_fit(pieces, 100)) <= 1
    assert packing.best_two_fit({}, 100) == []


@pytest.mark.parametrize("points", [3, 1000])
def test_level_of_very_many_sources(spark, monkeypatch, points):
    monkeypatch.setattr(mixing, "POINTS", points)
    r = random.Random(points)
    sizes = [(f"s{i:04}", r.choice([0, 1, 5, r.randint(1, 100_000)])) for i in range(400)] + [(None, 77)]
    got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = {s: mixing.WEIGHTS[i % 3] for i, (s, _) in enumerate(sizes)}
    budget, left, target = 1.5 * sum(n for _, n in sizes), dict(sizes), {}
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s, n in left.items() if level * weight[s] > 2 * n]
        if not over:
            break
        target |= {s: 2 * left.pop(s) for s in over}
    target |= {s: level * weight[s] for s in left}
    assert got == pytest.approx(target)


def test_ids_with_marks_behind_letters_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, encode, rng = Tokenizer.from_file(path), packing.chunk_encoder(path), random.Random(5)
    parts = ["word", "Dog", "é", "É", "ß", "×", "÷", "s'", "'s", "'t", "'", ",", "***", "%%%", "!!", "…", "́", "<", "|>", "<|endoftext|>", "1", "_", "日本", " ", " ", " ", "\n", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for text, ids in zip(texts, encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text
