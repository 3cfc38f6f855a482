import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline isn't here", allow_module_level=True)

import corpus_pipeline
from inkdex.llm import quality
from tests.llm import test_simhash, test_suffixes


def words(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def documents(spark):
    shared = words(99, 60)
    rows = [(k, words(k, 60 + k % 40)) for k in range(60)]
    rows += [(k + 100, t) for k, t in rows[:10]]  # exact copies
    rows += [(k + 200, words(k + 500, 80) + " " + shared + " " + words(k + 600, 40)) for k in range(5)]
    rows += [(300, None), (301, ""), (302, "too short"), (303, "again and again " * 40)]
    return spark.createDataFrame([(k, t, "en", "src0", len(t or ""), k % 2) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, check int")


def test_stages_against_brute_force(spark, tmp_path):
    docs = documents(spark)
    columns, sizes = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / str(n)))
        out = spark.read.parquet(str(tmp_path / str(n)))
        after = [r.asDict() for r in out.collect()]
        if n == 0:
            verdict = {r.doc_id: r.kept for r in quality.assess(docs).collect()}
            assert sorted(r["doc_id"] for r in after) == sorted(k for k, kept in verdict.items() if kept)
            assert not {300, 301, 302, 303} & {r["doc_id"] for r in after} and set(range(60)) <= {r["doc_id"] for r in after}
        if n == 1:
            found = test_simhash.brute([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted(k for k, _, _, least in found if k == least)
            assert not set(range(100, 110)) & {r["doc_id"] for r in after}
        if n == 2:
            want = {k: kept.decode() for k, _, _, _, kept in test_suffixes.brute([(r["doc_id"], r["text"]) for r in before], corpus_pipeline.REPEAT_BYTES)}
            assert {r["doc_id"]: r["text"] for r in after} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after)
            assert all(words(99, 60) not in t for t in want.values())
        if n < 3:
            assert out.columns == columns
            assert {k: v for k, v in out.dtypes} == {k: v for k, v in docs.dtypes}
        else:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
        sizes.append(len(after))
        docs = out
    assert sizes[0] > sizes[1] == sizes[2]


def test_run_on_the_smallest_tables(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and "sequence_id" in got.columns


def test_multibyte_characters_cut_in_half(spark):
    from inkdex.llm import suffixes

    shared = "é" * 150
    df = spark.createDataFrame([(1, "a" + shared + "b", "x", 152), (2, "cc" + shared[:120] + "dd", "x", 124), (3, None, "x", 0)], "doc_id bigint, text string, text2 string, n_chars bigint")
    out = {r.doc_id: (r.text, r.n_chars) for r in suffixes.cut_repeats(df).collect()}
    assert out == {1: ("ab", 2), 2: ("ccdd", 4), 3: (None, 0)}
    assert suffixes.cut_repeats(df.limit(0)).collect() == []
