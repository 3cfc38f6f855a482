"""What a task sorts or holds follows its own share, not the size of a table over the session's number of shuffle partitions."""

import glob
import random
from dataclasses import replace
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkdex.operators import batch, mutate
from inkdex.operators.expand import within
from inkdex.operators.search import search
from inkdex.options import IndexOptions, SearchOptions
from inkdex.plans import index as plan
from inkdex.plans import storage
from inkdex.sources.persist import load, save
from inkdex.streaming.ingest import LiveIndex


def texts(n, words=40, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(words)), "head" if i % 2 else None) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, body string, head string")


OPTIONS = IndexOptions(fields=("body", "head"))


def files(df):
    """Rows of each file of a table that was written."""
    return [pq.ParquetFile(urlparse(f).path).metadata.num_rows for f in df.inputFiles()]


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(storage, "BYTES", 2000)
    monkeypatch.setattr(plan, "ROWS", 500)


def test_tables_of_an_index_are_parted_by_their_size(spark, small_tasks):
    index = plan.build(table(spark, texts(200)), OPTIONS)
    most = max(files(index.postings))
    assert index.postings.count() > 6000 and most < 1500  # before: a third of all, as the session has three shuffle partitions
    assert max(files(index.docs)) < 100
    assert index.dictionary.count() == index.postings.select("term").distinct().count()


def test_terms_are_counted_in_their_documents(spark):
    index = plan.build(table(spark, [(1, "b a B b, a c", None), (2, "", "x X x"), (3, None, None)]), OPTIONS)
    found = {(r.term, r.field, r.id, r.tf, r.length) for r in index.postings.join(index.docs, plan.NUMBER).collect()}
    assert found == {("a", 0, 1, 2, 4), ("b", 0, 1, 3, 4), ("c", 0, 1, 1, 4), ("x", 1, 2, 3, 2)}


def test_dead_documents_are_broadcast_as_bits(spark, small_tasks, monkeypatch):
    index = plan.build(table(spark, texts(300)), OPTIONS)
    gone = spark.range(0, 300, 2).select("id")
    dead = mutate.discard_all(replace(index, options=replace(OPTIONS, auto_vacuum=False)), gone)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many dead documents
    try:
        plans = dead.live_postings._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plans and "BroadcastHashJoin" in plans  # before: all postings were shuffled and sorted
        left = {r.id for r in dead.live_docs.collect()}
        assert left == set(range(1, 300, 2))
        rows = {tuple(r) for r in dead.live_postings.collect()}
        monkeypatch.setattr(plan, "MOST_WORDS", 0)  # the way for very many
        far = replace(dead)
        assert {tuple(r) for r in far.live_postings.collect()} == rows and {r.id for r in far.live_docs.collect()} == left
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_a_removal_leaves(spark, small_tasks):
    index = plan.build(table(spark, texts(200)), OPTIONS)
    clean = mutate.remove_all(index, table(spark, texts(200)[:50]))
    assert clean.n_docs == 150
    want = {(r.term, r.n) for r in index.live_postings.where(f"{plan.NUMBER} >= 50").groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert {(r.term, r.n) for r in clean.postings.groupBy("term").agg(F.count("*").alias("n")).collect()} == want
    assert {(r.term, sum(r.df)) for r in clean.dictionary.collect()} == want


def test_a_saved_index_is_parted_by_its_size(spark, small_tasks, tmp_path):
    index = plan.build(table(spark, texts(100)), OPTIONS)
    more = mutate.add(index, table(spark, [(i + 1000, b, h) for i, b, h in texts(100, seed=2)]))
    for name, made in (("one", index), ("two", more)):
        save(made, str(tmp_path / name))
        back = load(spark, str(tmp_path / name), OPTIONS)
        assert max(files(back.postings)) < 1500 and back.postings.count() == made.postings.count()
        assert {tuple(r) for r in back.postings.collect()} == {tuple(r) for r in made.postings.collect()}


def test_changed_terms_of_repeated_rows_are_told_once(spark, small_tasks):
    index = plan.build(table(spark, texts(30)), OPTIONS)
    rows = [(3, "w1 new new", None), (3, "new", None), (5, None, "head other"), (99, "unknown", None)]
    assert sorted(map(tuple, mutate.changed_terms(index, table(spark, rows)).where("term != 'w1'").collect())) == [(3, "new", "body"), (5, "other", "head")]


def test_a_batch_scores_documents_where_their_postings_are(spark, small_tasks, monkeypatch):
    index = plan.build(table(spark, texts(120)), OPTIONS)
    queries = spark.createDataFrame([(1, "w1 w2 w1 head"), (2, "w2 w7"), (3, "head w1"), (4, "nothing"), (5, "w1")], "q int, text string")
    for options in (SearchOptions(combine_with="and", prefix=True), SearchOptions(fields=("body",), combine_with="and_not"), SearchOptions(fields=("body",))):
        want = {}
        for q in queries.collect():
            want |= {(q.q, r.id): r.score for r in search(index, q.text, options).collect()}
        for most in (100_000, 0):  # few words, and as many as are joined by a shuffle
            monkeypatch.setattr(batch, "SMALL_ROWS", most)
            got = {(r.query, r.id): r.score for r in batch.search_batch(index, queries, "q", "text", options).collect()}
            assert got == pytest.approx(want, rel=1e-9), (options, most)
    monkeypatch.setattr(batch, "SMALL_ROWS", 100_000)
    plans = batch.search_batch(index, queries, "q", "text", top=3)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plans  # before: each hit was repeated for each distinct count


def test_many_terms_are_few_ranges_without_the_gaps(spark):
    terms = [f"tha{n:03}" for n in range(150)] + [f"src{n}" for n in range(50)] + ["étude"]
    rows = spark.createDataFrame([(t,) for t in [*terms, "t", "these", "srd", "a", "zz"]], "term string")
    assert {r.term for r in rows.where(within(terms)).collect()} == set(terms)
    assert str(within(terms)).count("AND") <= 8  # before: up to 64 ranges, each compared with every posting


def test_a_batch_without_repeated_ids_is_taken_as_it_is(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(type(spark.range(1)), "dropDuplicates", lambda self, *a, drop=type(spark.range(1)).dropDuplicates: asked.append(a) or drop(self, *a))
    live = LiveIndex(plan.empty(spark, OPTIONS, "id bigint, body string, head string"))
    live.take(table(spark, texts(6)), 0)
    assert not asked and live.index.document_count() == 6  # before: texts were sorted by their ids
    live.take(table(spark, [(9, "a", None), (9, "a", None)]), 1)
    assert asked and live.index.document_count() == 7
