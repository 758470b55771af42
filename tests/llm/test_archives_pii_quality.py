import base64
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import zstandard

from tidemark.llm import pii, quality, warc
from tidemark.llm.common import scratch


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS refers_to", "3 AS _sha1")


def test_archives_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}\r\nEvil: 1", None if i % 9 == 0 else "".join(rng.choice(["<p>", "é", "word ", "\r\n\r\n"]) for _ in range(rng.randrange(0, 400)))) for i in range(300)]
    rows += [(1000 + i, None, "same") for i in range(50)] + [(None, "u", "same"), (1000, "twice", "same"), (2000, "long", "x" * 3_000_000)]
    for least in (0, 5):
        path = scratch(spark)
        warc.write_archives(pages(spark, rows), path, min_bytes=least)
        got = warc.read_archives(spark, path).collect()
        first = {}
        for p, _, h in rows:
            data = (h or "").encode()
            if p is not None and len(data) >= least:
                first[data] = min(p, first.get(data, p))
        want = []
        for p, _, h in rows:
            data = (h or "").encode()
            refers = first.get(data)
            revisit = p is not None and refers is not None and refers != p
            want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", refers if revisit else None, None if revisit else data))
        key = lambda x: tuple((v is None, v) for v in x)
        assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got], key=key) == sorted(want, key=key)
        assert all(r["error"] is None for r in got)
    path = scratch(spark)
    noise = [(i, None, "".join(rng.choices("abcdefghij", k=900_000))) for i in range(40)]
    warc.write_archives(pages(spark, noise).repartition(1), path, chunks=3)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    assert len(files) >= 4 and all(struct.unpack_from("<I", f["content"])[0] in (warc.DICTIONARY_MAGIC, warc.FRAME_MAGIC) for f in files)
    back = warc.read_archives(spark, path).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in back) == [(i, h) for i, _, h in noise]
    path = scratch(spark)
    warc.write_archives(pages(spark, rows).limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def archive(n=60, size=4000):
    rng = random.Random(2)
    return b"".join(warc.frames(warc.record("response", f"urn:page:{i}", "http://x", "".join(rng.choice(["the ", "of ", "<p>"]) for _ in range(size)).encode(), None, "2020-01-01T00:00:00Z") for i in range(n)))


def test_archive_starts_with_its_dictionary_and_plain_readers_can_use_it():
    data = archive()
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    raw = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data, read_across_frames=True).read()
    assert raw == b"".join(warc.archive_frames(data)) and raw.count(b"WARC/1.1\r\n") == 60


def test_broken_archives_are_found(spark):
    good = warc.record("response", "urn:page:1", "http://x", b"payload", None, "2020-01-01T00:00:00Z")
    assert warc.page_of(good)["payload_bytes"] == 7
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"payload\r", b"paybone\r"), good.replace(b"WARC-Date", b"X-Date"), good + good, b"", good.replace(b"WARC-Type: r", b"WARC-Type r")):
        with pytest.raises(ValueError):
            warc.page_of(bad)
    data = archive()
    for bad in (data[:-5], data + b"xyzw1", data[:200], data[: len(data) // 2] + b"\0" + data[len(data) // 2 + 1 :]):
        with pytest.raises(ValueError):
            list(warc.archive_frames(bad))


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_patterns_against_plain_matching():
    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", "..", "x", "é", "4111 1111-1111 1111", "4111111111111111", "1", "255", "256", "0001", "+", "+1 (23) 456-7890", "-", " ", "a.b%c@d-e.f.g", "@h.i", "9" * 20, "1.2.3.4", "1.2.3.4.5.6.7.8", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert pii.base_spans(text) == brute_base(text), text
    for long in ("1" * 300_000, "a" * 300_000, "1." * 100_000, "+1" * 100_000, "@a" * 100_000, "1 " * 100_000):
        pii.base_spans(long)


def personal(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(200)]
    for k in range(6):  # a rare name stands by one address and nowhere else
        texts.append(" ".join(rng.choice(words) for _ in range(20)) + f" Zaphod met word1 at ann@example.org {k} " + " ".join(rng.choice(words) for _ in range(20)))
    texts += ["1.1.1.1-" * 10 + "secretname@x.yz and bob@q.rs", "other 1.1.1.1 secretname@x.yz with secretname here and bob@q.rs", "third +1 4111111111111111 secretname@x.yz has secretname"]
    texts += [None, "", "call +49 (30) 1234567 now", "ann@example.org"] + ["copy of bob@example.org by Onlyhere"] * 5
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS term", "'y' AS entity", "3 AS n"), texts


def brute_terms(texts, low=0.75, high=0.9):
    """Spans of disclosing terms by text, from plain counting over all rows: none of the module's functions."""
    import math

    texts = [t or "" for t in texts]
    terms = [set(re.findall(r"\w{3,}", t.lower())) for t in texts]
    base = [brute_base(t) for t in texts]

    def entities_of(t, spans):
        return {kind + ":" + (t[s:e].lower() if kind == "email" else t[s:e] if kind == "ip" else re.sub("[^0-9]", "", t[s:e])) for kind, s, e in spans}

    entities = [entities_of(t, spans) for t, spans in zip(texts, base, strict=True)]
    n, actions = len(texts), [{} for _ in texts]
    for entity in set().union(*entities):
        rows = [i for i in range(n) if entity in entities[i]]
        for term in set().union(*(terms[i] for i in rows)):
            both = [i for i in rows if term in terms[i]]
            if len({texts[i] for i in both}) < 2 or len(rows) == n:
                continue
            share = math.log2(n * len(both) / (sum(term in t for t in terms) * len(rows))) / math.log2(n / len(rows))
            if share >= low:
                for i in rows:
                    actions[i][term] = max(actions[i].get(term, ""), "remove" if share >= high else "generalise")
    out = []
    for t, spans, known in zip(texts, base, actions, strict=True):
        inside = {k for _, s, e in spans for k in range(s, e)}
        found = [(known.get(m[0].lower()), *m.span()) for m in re.finditer(r"\w{3,}", t)]
        out.append(sorted((a, s, e) for a, s, e in found if a and not inside & set(range(s, e))))
    return out


def test_personal_data_against_brute_force(spark):
    df, texts = personal(spark)
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    extra = brute_terms(texts)
    assert any(extra) and len(got) == len(texts)
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        form = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        r = got[i]
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(b[0] == k for b in base) for k in pii.KINDS)
        assert r["base_sha256"] == hashlib.sha256(form.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in base + extra[i])
        assert base or not r["spans"]
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_sanitised_texts(spark):
    df, texts = personal(spark)
    out = pii.sanitise(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    extra = brute_terms(texts)
    for i, t in enumerate(texts):
        assert got[i] == (t if t is None else pii.clean(t, brute_base(t) + extra[i]))
    assert "Zaphod" not in got[203] and "[EMAIL]" in got[203] and "word1" in got[203]
    assert pii.clean("a +1 4111111111 b", [("phone", 2, 15), ("card", 5, 15)]) == "a [PHONE] b"
    assert pii.sanitise(df.limit(0)).count() == 0


def test_disclosing_terms_anywhere_in_their_rows(spark):
    rng = random.Random(9)
    filler = lambda n: " ".join(f"word{rng.randrange(60)}" for _ in range(n))
    texts = [filler(50) for _ in range(300)]
    # the name stands near the address in one row, far from it in the others, and again far away in the first
    texts += [f"Trillian {filler(60)} eve@example.org {filler(60)} Trillian", f"{filler(3)} eve@example.org Trillian {filler(60)} Trillian", f"{filler(80)} Trillian {filler(40)} eve@example.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(df).where("doc_id >= 300").collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    for i in (300, 301, 302):
        places = [m.span() for m in re.finditer("Trillian", texts[i])]
        assert [tuple(map(int, x.split(":")[1:])) for x in spans[i].split(",") if x.startswith("remove")] == places
        assert "Trillian" not in clean[i] and "[EMAIL]" in clean[i] and "word" in clean[i]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    s, trans = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    fwd, bwd, z = quality.chains(np.pad(s, ((0, 0), (0, 2))), np.array([[True] * 5 + [False] * 2]), trans)
    weights = {}
    for y in np.ndindex(*[2] * 5):
        weights[y] = np.exp(sum(s[0, t] * y[t] for t in range(5)) + sum(trans[y[t], y[t + 1]] for t in range(4)))
    total = sum(weights.values())
    assert z[0] == pytest.approx(np.log(total))
    for t in range(5):
        assert np.exp(fwd[0, t, 1] + bwd[0, t, 1] - z[0]) == pytest.approx(sum(w for y, w in weights.items() if y[t]) / total)


def brute_score(model, text):
    """A document's score by listing all labellings of its lines."""
    lines = [x for x in text.encode().split(b"\n") if x.strip()] or [b""]
    features, _ = quality.line_features(text.encode())
    starts = np.cumsum([0, *[len(e) + 1 for e in model.edges]])
    width = int(starts[-1])
    evidence = []
    for t in range(len(lines)):
        total = 0.0
        for side, at in enumerate((t, t - 1, t + 1)):
            if 0 <= at < len(lines):
                for j, edges in enumerate(model.edges):
                    total += model.weights[side * width + starts[j] + sum(e <= features[at, j] for e in edges)]
            else:  # one weight a feature stands for the missing neighbour
                total += len(model.edges) * model.weights[3 * width + side - 1]
        evidence.append(total)
    weigh = lambda y: np.exp(sum(evidence[t] * y[t] for t in range(len(y))) + sum(model.trans[a, b] for a, b in zip(y, y[1:])))
    every = {y: weigh(y) for y in np.ndindex(*[2] * len(lines))}
    z = sum(every.values())
    good = [sum(w for y, w in every.items() if y[t]) / z for t in range(len(lines))]
    sizes = [len(x) + 1 for x in lines]
    p = sum(g * n for g, n in zip(good, sizes, strict=True)) / sum(sizes)
    raw = np.log((p + 1e-4) / (1 - p + 1e-4))
    return 1 / (1 + np.exp(-(model.scale[0] * raw + model.scale[1])))


def test_scores_against_enumeration(spark):
    rows, labels = make_quality(spark)
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "\n \n")], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in quality.score_documents(docs, model).collect()}
    for i, text in rows[:150] + [(1000, ""), (1001, "\n \n")]:
        want = brute_score(model, text)
        assert got[i]["score"] == pytest.approx(want) and got[i]["predicted"] == int(want >= 0.7)


def make_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        lines = []
        for _ in range(rng.randrange(1, 8)):
            words = [rng.choice(["tal", "ore", "min", "sev", "ung"]) + rng.choice(["ta", "re", "mo", "li"]) + str(rng.choice(["", "s"])) for _ in range(rng.randrange(5, 30))]
            bad = not good and rng.random() < 0.8
            lines.append(" ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + ".")
        rows.append((i, "\n".join(lines)))
        if rng.random() < 0.9:
            labels.append((i, int(good)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = make_quality(spark)
    odd = [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "x" * 200_000), (None, "words here."), (0, rows[0][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS quality", "3 AS size", "4 AS y")
    table = spark.createDataFrame(labels + [(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    model = quality.train(docs, table)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, r in by.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(by[i]["score"], y) for i, y in labels if by[i]["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    # labels of the held-out fold change nothing
    flipped = spark.createDataFrame([(i, 1 - y if by[i]["held_out"] else y) for i, y in labels], "doc_id long, quality int")
    other = quality.train(docs, flipped)
    assert np.array_equal(model.weights, other.weights) and model.scale == other.scale
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None and {r["score"] for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == 2 and quality.score_documents(docs.limit(0), none).count() == 0
