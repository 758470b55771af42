"""The registered queries on the given tables, each against plain code."""

import base64
import hashlib
import math
import os
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from test_archives_pii_quality import brute_base, brute_terms
from test_counts_packing import brute_place, check_packing
from test_rules_tries_whitening import brute_measures, brute_trie, exact
from test_similarity import brute_sketch, roots_of, word_sets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    got = {r["page_id"]: tuple(r)[1:] for r in rows_of(spark, "op1_zstd_warc")}
    assert got == {p: (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), *(("response", None) if first[h] == p else ("revisit", first[h]))) for p, h in pages.items()}


def test_op2(spark, texts):
    ids = list(texts)
    extra = dict(zip(ids, brute_terms([texts[i] for i in ids]), strict=True))
    for r in rows_of(spark, "op2_disclosure_pii"):
        spans = brute_base(texts[r["doc_id"]] or "")
        form = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in x)
        assert r["base_sha256"] == hashlib.sha256(form(spans).encode()).hexdigest() and r["spans"] == form(spans + extra[r["doc_id"]])
        assert Counter(k for k, _, _ in spans) == Counter({k: r[f"n_{k}"] for k in ("email", "ip", "card", "phone")})


def test_op3(spark, texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    order = sorted((i, zlib.crc32(b), len(b) + 16) for i, b in raw.items())
    want = {i: (size, crc, "rows", *brute_place(k, len(order), 40, 20), None) for k, (i, crc, size) in enumerate(order)}
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows_of(spark, "op3_feistel_sharding")} == want


def test_op4(spark, texts):
    sets = {i: word_sets(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    roots = roots_of(sets, links)
    assert links and {r["doc_id"]: tuple(r)[1:] for r in rows_of(spark, "op4_chosen_path_minhash")} == {i: (len(s), roots[i], roots[i] == i) for i, s in sets.items()}


def test_op5(spark, texts):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for r in rows_of(spark, "op5_prefix_token_counts"):
        t, n = texts[r["doc_id"]] or "", r["n_tokens"]
        assert (r["n_bytes"], n, r["over_limit"]) == (len(t.encode()), count(t), n > 512)
        k = r["fitting_chars"]
        assert (k == len(t)) == (n <= 512) and count(t[:k]) <= 512 and all(count(t[: k + d]) > 512 for d in range(1, 4) if k + d <= len(t))


def test_op6(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in rows_of(spark, "op6_scaled_sketch")}
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        t, other = texts[i] or "", texts[following] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + other[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if t.isascii() and edited.isascii():
            a, b = brute_sketch(" ".join(t.split())), brute_sketch(" ".join(edited.split()))
            assert got[i]["fingerprint"] == ",".join(f"{x:x}" for x in a)
            assert got[i]["near_edited"] == pytest.approx(1.0 if t == edited else len(set(a) & set(b)) / max(1, len(set(a) | set(b))))


def test_op8(spark):
    table = {r["vec_id"]: (np.array([math.nan if c is None else c for c in r["embedding"] or []], dtype=float), r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ok = {k: v / np.linalg.norm(v) for k, (v, label) in table.items() if label is not None and len(v) and np.isfinite(v).all() and v.any()}
    links = [(a, b) for a, b in combinations(ok, 2) if table[a][1] == table[b][1] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.98]
    roots, n = roots_of(table, links), Counter(x for link in links for x in link)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows_of(spark, "op8_cap_filters")}
    wrong = [k for k in table if got[k] != (n[k], roots[k], roots[k] == k)]
    assert got.keys() == table.keys() and len(wrong) <= 0.01 * len(table)


def test_op9(spark, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in rows_of(spark, "op9_line_crf_quality")}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    known = [(got[i]["score"], y) for i, y in labels.items() if i in got and y in (0, 1)]
    good, bad = [s for s, y in known if y], [s for s, y in known if not y]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9


def test_op10(spark, texts):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = rows_of(spark, "op10_best_two_fit")
    want = []
    for i, t in texts.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    assert check_packing(rows, 2048) <= math.ceil(sum(w[3] for w in want) / 2048) + 1


def test_pipeline(spark):
    rows = rows_of(spark, "pipeline")
    assert rows and check_packing(rows, 2048)


def test_op11(spark, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, "op11_repetition_coverage")}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = brute_measures(t)
        r = got[i]
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [want[c] for c in ("words", "word_chars", "symbols", "dup_lines", "words_8")]


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in rows_of(spark, "op12_prefix_trie")), key=str) == brute_trie(rows)


def test_op13(spark):
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    fine = {k: v for k, v in table.items() if v and all(c is not None and math.isfinite(c) for c in v)}
    n, _, e, v, trace = exact(list(fine.values()))
    got = rows_of(spark, "op13_lanczos_whitening")
    assert {r["vec_id"] for r in got} == fine.keys() and len(got) == 16 * len(fine)
    for r in got:
        assert r["n"] == n and r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=1e-8) and r["identity_error"] < 1e-8
