import itertools
import random
from collections import Counter

import pytest

import corpus_pipeline
from test_archives_pii_quality import brute_base, brute_terms
from test_counts_packing import brute_mix, check_packing
from test_similarity import corpus, roots_of, word_sets
from tidemark.llm import pii, quality
from tidemark.llm.common import scratch


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(9)
    texts = [t.lower() if t else t for t in corpus(9, 60)]
    texts += [f"Only {' '.join(rng.choice(['tal', 'ore']) for _ in range(30))} mail k{k}@example.org x" for k in range(20)]
    bad = ["!! ".join(rng.choice(["AA", "BB"]) for _ in range(40)) for _ in range(80)]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts + bad)]
    folder = scratch(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < len(texts))) for i in range(len(rows)) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_each_stage_against_brute_force(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    columns, model = docs.columns, quality.train(docs, spark.read.parquet(f"{made}/labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        path = scratch(spark)
        stage(spark, docs, made).write.parquet(path)
        docs = spark.read.parquet(path)
        after = [tuple(r) for r in docs.collect()]
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            want = [r for r in before if model.score((r[1] or "").encode()) >= quality.THRESHOLD]
            assert len(want) < len(before)
        elif k == 1:
            sets = {r[0]: word_sets(r[1]) for r in before}
            links = []
            for a, b in itertools.combinations(sets, 2):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
            roots = roots_of(sets, links)
            want = [r for r in before if roots[r[0]] == r[0]]
            assert len(want) < len(before)
        elif k == 2:
            terms = brute_terms([r[1] for r in before])
            want = []
            for r, more in zip(before, terms, strict=True):
                text = r[1] if r[1] is None else pii.clean(r[1], brute_base(r[1]) + more)
                want.append((r[0], text, r[2], r[3], r[4] if text is None else len(text)))
            assert any("[EMAIL]" in (r[1] or "") for r in want)
        elif k == 3:
            size = {r[0]: len((r[1] or "").encode().split()) for r in before}
            taken = {d: t // n if n else None for d, n, _, _, t in brute_mix([(r[0], size[r[0]], r[3]) for r in before])}
            got = Counter(r[0] for r in after)
            assert all(got[d] == c for d, c in taken.items() if c is not None)
            want = [r for r in before for _ in range(got[r[0]])]
        else:
            check_packing(docs.collect(), 2048)
            assert Counter((r["doc_id"]) for r in docs.where("piece = 0").collect()) == Counter(r[0] for r in before)
            continue
        assert sorted(map(repr, after)) == sorted(map(repr, want))


def test_run_and_odd_tables(spark, made):
    assert corpus_pipeline.run(spark, made).count() > 0
    schema = spark.read.parquet(f"{made}/documents.parquet").schema
    rows = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (None, "one two three four five six", "en", None, 27), (None, None, None, None, None), (None, "", None, "a", 0), (2, "other words stand here now", None, "a", None)]
    for part in (rows, []):
        folder = scratch(spark)
        spark.createDataFrame(part, schema).selectExpr("*", "1 AS score", "2 AS _part", "3 AS copies", "4 AS kept").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert (out.count() > 0) == bool(part)
