"""Repetition rules, prefix tries and whitening, against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import repetition, tries, whitening
from tidemark.llm.common import WORD, save

TEXTS = [None, "", " \n\t", "one", "a b c d e f g h " * 6, "x y " * 300, "same line here\n" * 5 + "another line", "a\n\nb\n\na", "# * $ % & | < >" * 3]


def brute_measures(text):
    words, spans = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "), {}
    words = [w for w in words if w]
    for n in repetition.LENGTHS:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        often = Counter(grams)
        spans[n] = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(n)}
    seen, dup, chars = set(), 0, 0
    for line in (text or "").split("\n"):
        own = [w for w in words_of(line)]
        if own and line in seen:
            dup, chars = dup + 1, chars + sum(map(len, own))
        seen.add(line)
    out = {"words": len(words), "word_chars": sum(map(len, words)), "symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "dup_lines": dup, "line_chars": chars}
    for n, inside in spans.items():
        out |= {f"chars_{n}": sum(len(words[i]) for i in inside), f"words_{n}": len(inside)}
    return out


def words_of(line):
    return re.findall(WORD, line)


def random_texts(seed, n):
    r = random.Random(seed)
    pool = [" ".join(r.choice("ab cde fgh ij klm é ß 漢字 😀".split()) for _ in range(r.randint(3, 15))) for _ in range(6)]
    return [r.choice(["\n", " ", "\x0b "]).join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(n)]


def test_repetition_against_brute_force(spark):
    texts = TEXTS + random_texts(1, 150)
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, "a null id", None, None), (0, texts[0], "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, kept int")
    got = repetition.judge_repetition(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r.asDict() for r in got}
    for i, t in enumerate(texts):
        want = brute_measures(t)
        assert {k: by_id[i][k] for k in want} == want
        base = want["words"] < 20 or 100 * want["words_8"] > 30 * want["words"]
        over = [f"ngrams_{n}" for n in repetition.LENGTHS if 100 * want[f"chars_{n}"] > 30 * want["word_chars"]] + ["lines"] * (100 * want["line_chars"] > 30 * want["word_chars"])
        assert (by_id[i]["base_failed"], by_id[i]["broken"], by_id[i]["kept"]) == (base, ",".join(over), not base and not over)


def test_texts_measured_together_or_apart_are_alike(monkeypatch):
    texts = [t or "" for t in TEXTS] + random_texts(2, 40)
    whole = repetition.measure(texts)
    for i, t in enumerate(texts):
        alone = repetition.measure([t])
        assert {k: v[i] for k, v in whole.items()} == {k: v[0] for k, v in alone.items()}


def test_long_text_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(repetition, "TOGETHER", 100)
    long = " ".join(str(i) for i in range(100_000)) + " " + " ".join(str(i) for i in range(50))
    docs = spark.createDataFrame([(1, long), (2, "a"), (3, long)], "doc_id int, text string")
    for r in repetition.measured(docs).collect():
        assert r["words_8"] == (0 if r["doc_id"] == 2 else 100)
    assert repetition.judge_repetition(docs.where("false")).collect() == []


def brute_trie(rows):
    """The trie by walking every conversation's prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(words_of(q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(convs), len(p), parent, len(convs), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, longest, texts=3):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * n), n):
        for t in range(r.randint(1, longest)):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", None, "bot"]), r.choice([None, "", "hello there you", "x y"][: texts + 1])))
    return rows


@pytest.mark.parametrize(("n", "longest", "texts"), [(120, 6, 3), (60, 1, 3), (25, 40, 1)])
def test_trie_against_walking(spark, n, longest, texts):
    rows = conversations(n, n, longest, texts)
    rows += [(None, 1, "user", "no conversation"), *rows[:3]]
    if longest == 40:  # long common stems that branch late, and equal conversations
        stem = [("user", "same words")] * 33
        rows += [(1000 + c, t, *x) for c in range(12) for t, x in enumerate([*stem, ("bot", f"end {c % 3}")][: 34 - c % 2])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, name string")
    assert sorted((tuple(r) for r in tries.conversation_trie(table).collect()), key=str) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert tries.conversation_trie(spark.createDataFrame([], schema)).collect() == []
    turnless = next(c for c in range(1000, 2000) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(turnless, 0, "a", "b")]
    assert [tuple(r) for r in tries.conversation_trie(spark.createDataFrame(rows, schema)).collect()] == brute_trie(rows) and len(brute_trie(rows)) == 1


def test_long_lists_of_ends_and_wide_keys(spark, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 7)
    monkeypatch.setattr(tries, "MEET", 2)
    rows = [(c, t, "u", f"{t % 2} w") for c in range(40, 140) for t in range(21)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert sorted((tuple(r) for r in tries.conversation_trie(table).collect()), key=str) == brute_trie(rows)


def exact(vectors, wanted=16):
    """(n, S, eigenvalues, eigenvectors, trace) of the distinct counted vectors."""
    x = np.unique(np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000, axis=0)
    c = (x * len(x) - x.sum(0)) / len(x)
    e, v = np.linalg.eigh(c.T @ c / len(x))
    return len(x), x.sum(0), e[::-1][:wanted], v[:, ::-1][:, :wanted], e.sum()


@pytest.mark.parametrize(("n", "d"), [(200, 5), (300, 24), (150, 90)])
def test_whitening_against_eigenvectors(spark, n, d):
    r = np.random.default_rng(d)
    vectors = (r.standard_normal((n, d)) * np.geomspace(1, 0.05, d)) @ np.linalg.qr(r.standard_normal((d, d)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))] + [(n, vectors[0].astype(np.float32).tolist())]
    odd = [(n + 1, None), (n + 2, [float("nan")] * d), (n + 3, [None] * d), (n + 4, [float("inf")] * d), (n + 5, []), (n + 6, [1e30] * d)]
    table = spark.createDataFrame([(*row, "clash") for row in rows + odd], "vec_id int, embedding array<float>, x string")
    got = {(g["vec_id"], g["component"]): g for g in whitening.whiten(table).collect()}
    kept = np.array([v for _, v in rows], dtype=np.float64)
    m, s, e, v, trace = exact(kept)
    k = min(16, d)
    assert len(got) == len(rows) * k
    x = np.floor(64 * kept).astype(np.int64) + 1_000_000
    want = ((x * m - s) / m) @ v / np.sqrt(e)
    for j in range(k):
        own = np.array([got[i, j + 1]["whitened"] for i in range(len(rows))])
        sign = np.sign(own @ want[:, j])
        assert np.abs(own * sign - want[:, j]).max() < 1e-7
        assert got[0, j + 1]["explained"] == pytest.approx(e[j] / trace, rel=1e-9)
    first = got[0, 1]
    assert first["n"] == m and first["deviation"] == sum((m * int(a) - int(b)) ** 2 for a, b in zip(x[0], s, strict=True))
    assert 0 <= first["identity_error"] < 1e-9


def test_repeated_and_vanishing_eigenvalues(spark):
    axes = [[1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, -1.0, 0.0, 0.0]]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(axes)] + [(9, [1.0, 2.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(table).collect()
    assert Counter(r["vec_id"] for r in rows) == {0: 2, 1: 2, 2: 2, 3: 2}  # rank two, and a width of one vector only
    assert all(r["explained"] == pytest.approx(0.5) and r["identity_error"] < 1e-9 for r in rows)
    assert sum(r["whitened"] ** 2 for r in rows if r["vec_id"] == 0) == pytest.approx(2)
    assert whitening.whiten(table.where("false")).collect() == []


def test_deviations_beyond_a_long_are_null(spark):
    table = spark.createDataFrame([(i, [float(i % 3) * 2.0**40, float(i) * 2.0**32]) for i in range(9)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(table).collect()
    assert len(rows) == 18 and any(r["deviation"] is None for r in rows)


def test_lanczos_stops_early_with_the_same_values():
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 300)) * np.geomspace(30, 0.1, 300)
    passes = []

    def product(q):
        passes.append(1)
        p = x @ q
        return float(p @ p), x.T @ p

    values, vectors = whitening.bidiagonalise(product, 300, 16)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert len(passes) < 200 and np.allclose(values[:16], s[:16], rtol=1e-12)
    assert all(math.isclose(abs(vectors[:, i] @ v[i]), 1, rel_tol=1e-9) for i in range(16))


def test_prefix_names_are_equal_for_equal_prefixes_only(spark):
    r = random.Random(5)
    seqs = {i: [r.choice("ab") for _ in range(r.randint(0, 9))] for i in range(60)}
    turns = spark.createDataFrame([(i, p, t.encode()) for i, s in seqs.items() for p, t in enumerate(s)], "seq long, pos long, token binary")
    lengths = spark.createDataFrame([(i, len(s)) for i, s in seqs.items()], "seq long, last long")
    names = save(tries.prefix_names(turns, lengths))
    got = {(n["seq"], n["pos"]): (n["pos"], bytes(n["name"])) for n in names.collect()}
    assert got.keys() == {(i, p) for i, s in seqs.items() for p in range(len(s) + 1)}
    by_name, by_prefix = defaultdict(set), defaultdict(set)
    for (i, p), name in got.items():
        by_name[name].add(tuple(seqs[i][:p]))
        by_prefix[tuple(seqs[i][:p])].add(name)
    assert all(len(x) == 1 for x in (*by_name.values(), *by_prefix.values()))
    assert names.where(F.col("pos") == 0).select("name").distinct().count() == 1
