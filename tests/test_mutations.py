import json
import logging
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from inkdex.operators import mutate
from inkdex.operators.search import search
from inkdex.operators.termmap import TermMap
from inkdex.options import WILDCARD, IndexOptions, SearchOptions
from inkdex.plans.index import NUMBER, build, empty
from inkdex.sources import snapshot
from inkdex.sources.documents import from_json_text, read
from inkdex.sources.persist import load, save, to_json
from inkdex.streaming.ingest import LiveIndex, ingest
from tests.oracle import Model, edits
from tests.test_search import corpus

SCHEMA = "id bigint, body string, head string"
FIELDS = IndexOptions(fields=("body", "head"), store_fields=("head",), auto_vacuum=False)


def model_of(rows):
    m = Model(["body", "head"])
    for key, *texts in rows:
        m.add(key, texts)
    return m


def check(index, rows):
    """The index answers as one that was built from these rows."""
    model = model_of(rows)
    assert index.document_count() == len(rows)
    assert index.averages == pytest.approx(model.average)
    for query, options, expected in (("the zen", SearchOptions(), {}), ("ar ete", SearchOptions(prefix=True, fuzzy=0.4), {"prefix": True, "fuzzy": 0.4})):
        got = {r.id: r.score for r in search(index, query, options).collect()}
        want = {k: v[0] for k, v in model.search(query, **expected).items()}
        assert got == pytest.approx(want)


def test_ways_to_the_same_index(spark):
    rows = corpus(3, 50)
    df = lambda part: spark.createDataFrame(part, SCHEMA)
    index = build(df(rows[:30]), FIELDS)
    check(index, rows[:30])
    index = mutate.add(index, df(rows[30:]))
    check(index, rows)
    odd, even = rows[1::2], rows[0::2]
    for gone in (mutate.discard_all(index, df(odd).select("id")), mutate.remove_all(index, df(odd))):
        check(gone, even)
        assert not gone.has(odd[0][0]) and gone.has(even[0][0])
    gone = mutate.discard_all(index, df(odd).select("id"))
    assert gone.n_dead == len(odd) and gone.term_count() == index.term_count()
    clean = mutate.vacuum(gone)
    check(clean, even)
    assert clean.dead is None and mutate.vacuum(clean) is clean
    assert clean.term_count() == len({t for d in model_of(even).docs.values() for f in d if f for t in f[1]})
    again = mutate.add(gone, df(odd))
    assert {r.id for r in search(again, WILDCARD).collect()} == {r[0] for r in rows}


def test_replaced_documents_are_numbered_anew(spark):
    index = build(spark.createDataFrame([(1, "same", ""), (2, "same", "")], SCHEMA), FIELDS)
    assert [r.id for r in search(index, "same").collect()] == [1, 2]
    index = mutate.replace_documents(index, spark.createDataFrame([(1, "same", "")], SCHEMA))
    assert [r.id for r in search(index, "same").collect()] == [2, 1]
    index = mutate.replace_documents(index, spark.createDataFrame([(2, "other", "")], SCHEMA))
    assert [r.id for r in search(index, "same").collect()] == [1] and index.document_count() == 2


def test_order_of_indexing_decides_ties(spark):
    df = spark.createDataFrame([(1, "x", "b"), (2, "x", "a")], SCHEMA)
    assert [r.id for r in search(build(df, FIELDS, order_by=["head"]), "x").collect()] == [2, 1]


def test_errors_and_single_documents(spark, caplog):
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    index = build(df((1, "a b", "h"), (2, "b c", None)), FIELDS)
    with pytest.raises(ValueError, match="duplicate ID 1"):
        mutate.add(index, df((1, "x", "y")))
    for f in (mutate.discard, mutate.replace_documents, mutate.remove):
        with pytest.raises(ValueError, match="not in the index"):
            f(index, 9 if f is mutate.discard else df((9, "x", "y")))
    assert index.stored_fields(1) == {"head": "h"} and index.stored_fields(2) == {} and index.stored_fields(3) is None
    index = mutate.discard(index, 1)
    assert index.stored_fields(1) is None
    with pytest.raises(ValueError, match="not in the index"):
        mutate.discard(index, 1)
    with caplog.at_level(logging.WARNING, "inkdex"):
        left = mutate.remove(index, df((2, "b changed", None)))
    assert "version_conflict" in caplog.text and left.document_count() == 0 and search(left, "b c").collect() == []
    none = mutate.remove_all(index)
    assert none.document_count() == 0 and none.term_count() == 0
    check(mutate.add(none, df((1, "the zen", "a"))), [(1, "the zen", "a")])


def test_automatic_vacuum(spark):
    rows = [(k, f"word{k}", "h") for k in range(30)]
    options = IndexOptions(fields=("body",), auto_vacuum=True, min_dirt_count=10, min_dirt_factor=0.2)
    index = build(spark.createDataFrame(rows, SCHEMA), options)
    ids = lambda a, b: spark.range(a, b).toDF("id")
    index = mutate.discard_all(index, ids(0, 5))
    assert index.n_dead == 5
    index = mutate.discard_all(index, ids(5, 12))
    assert index.n_dead == 0 and index.term_count() == 18


def test_saved_indexes(spark, tmp_path):
    rows = corpus(5, 40)
    index = mutate.discard_all(build(spark.createDataFrame(rows, SCHEMA), FIELDS), spark.range(0, 10).toDF("id"))
    save(index, str(tmp_path / "a"))
    loaded = load(spark, str(tmp_path / "a"), IndexOptions(fields=("body", "head")))
    check(loaded, rows[10:])
    assert loaded.n_dead == 10 and loaded.options.store_fields == ("head",)
    save(loaded, str(tmp_path / "c"), form="json")
    check(load(spark, str(tmp_path / "c"), FIELDS), rows[10:])
    save(mutate.vacuum(loaded), str(tmp_path / "b"))
    check(load(spark, str(tmp_path / "b"), FIELDS), rows[10:])
    with pytest.raises(ValueError, match="was built with"):
        load(spark, str(tmp_path / "a"), IndexOptions(fields=("body",)))
    spark.createDataFrame([('{"version": 99}',)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "a/manifest"))
    with pytest.raises(ValueError, match="version 99"):
        load(spark, str(tmp_path / "a"), FIELDS)
    assert to_json(index, "dictionary").count() == index.term_count()


def test_sources_and_streams(spark, tmp_path):
    docs = from_json_text(spark, '[{"id": 1, "body": "the zen", "head": null}, {"id": 2, "body": "art"}]', SCHEMA)
    check(build(docs, FIELDS), [(1, "the zen", None), (2, "art", None)])
    with pytest.raises(Exception):
        from_json_text(spark, "[{", SCHEMA).collect()
    rows = corpus(6, 20)
    for n, part in enumerate((rows[:12], rows[8:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(tmp_path / f"in/{n}"))
    assert read(spark, str(tmp_path / "in/0"), "json", SCHEMA).count() == 12
    live = LiveIndex(empty(spark, FIELDS, SCHEMA))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    ingest(stream, live, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r.id for r in search(live.index, WILDCARD).collect()} == set(range(20))
    before = live.index
    live.take(spark.createDataFrame(rows, SCHEMA), 0)
    assert live.index is before
    check(mutate.vacuum(live.index), sorted(rows, key=lambda r: live.index.live_docs.where(F.col("id") == r[0]).first()[NUMBER]))


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = corpus(9, 30)
    df = lambda part: spark.createDataFrame(part, SCHEMA)
    where = str(tmp_path / "live")
    live = LiveIndex(empty(spark, FIELDS, SCHEMA), folder=where)
    live.take(df(rows[:10]), 0)
    live.take(df(rows[10:20]), 1)
    again = LiveIndex.resume(spark, where, FIELDS)
    assert again.done == 1
    check(again.index, rows[:20])
    again.take(df(rows[:20]), 1)
    again.take(df(rows[20:]), 2)
    check(again.index, rows)
    again.discard(df(rows[::2]).select("id"))
    third = LiveIndex.resume(spark, where, FIELDS)
    check(third.index, rows[1::2])
    third.vacuum().result()
    assert third.index.dead is None and third.index.segments == 1
    check(LiveIndex.resume(spark, where, FIELDS).index, rows[1::2])
    with pytest.raises(ValueError, match="no state"):
        LiveIndex.resume(spark, str(tmp_path / "none"), FIELDS)


def test_segments_are_merged(spark, monkeypatch):
    rows = corpus(10, 12)
    monkeypatch.setattr(mutate, "MOST_SEGMENTS", 2)
    live = LiveIndex(empty(spark, FIELDS, SCHEMA))
    live.add_chunks(spark.createDataFrame(rows, SCHEMA), 4)
    assert live.index.segments <= 2 and live.done == 3
    assert {r.id for r in search(live.index, WILDCARD).collect()} == {r[0] for r in rows}


def test_vacuums_in_the_background(spark):
    import threading

    rows = [(k, f"word{k}", "h") for k in range(30)]
    index = build(spark.createDataFrame(rows, SCHEMA), IndexOptions(fields=("body",), min_dirt_count=4, min_dirt_factor=0.1))
    live, go, real = LiveIndex(index), threading.Event(), mutate.vacuum
    try:
        mutate.vacuum = lambda i: (go.wait(60), real(i))[1]
        assert not live.is_vacuuming
        live.discard(spark.range(0, 3).toDF("id"))
        assert not live.is_vacuuming and live.index.n_dead == 3  # not dirty enough
        live._turn.acquire()
        live._turn.release()
        live.discard(spark.range(3, 6).toDF("id"))  # dirty: one starts by itself
        assert live.is_vacuuming and live.index.n_dead == 6
        waiting = live.vacuum()
        assert live.vacuum() is waiting and len(live._vacuums) == 2
        assert search(live.index, "word9").count() == 1  # searches go on
        go.set()
        waiting.result()
    finally:
        mutate.vacuum = real
    assert live.index.n_dead == 0 and live.index.term_count() == 24 and not live.is_vacuuming
    assert live.vacuum(if_dirty=True).result() is None


def test_running_removal(spark):
    """Documents leave the running averages one by one, by the number of documents at the time."""
    rows = [(1, "a b c d", "x"), (2, None, "x y"), (3, "a b", None), (4, "a b c d e f", "x"), (5, None, "z")]
    index = build(spark.createDataFrame(rows, SCHEMA), replace(FIELDS, running_removal=True))
    gone = mutate.discard_all(index, spark.createDataFrame([(1,), (2,), (4,)], "id bigint"))
    want = []
    for n, before in enumerate(index.averages):
        average, count = before, 5
        for row in (rows[0], rows[1], rows[3]):
            if row[1 + n] is not None:
                average = (average * count - len(row[1 + n].split())) / (count - 1)
            count -= 1
        want.append(average)
    assert gone.averages == pytest.approx(want)
    none = mutate.discard_all(gone, spark.createDataFrame([(3,), (5,)], "id bigint"))
    assert none.averages[1] == 0.0


def test_indexes_as_one_object(spark):
    """An index in the first version of the exchanged form equals one that is built; so does a round trip."""
    docs = [(1, "Divina Commedia", "Nel mezzo del cammin di nostra vita", "poetry"), (2, "I Promessi Sposi", "Quel ramo del lago di Como", "fiction"),
            (3, "Vita Nova", "In quella parte del libro della mia memoria", "poetry")]
    df = spark.createDataFrame(docs, "id bigint, title string, text string, category string")
    options = IndexOptions(fields=("title", "text"), store_fields=("category",))
    built = build(df, options)
    two = snapshot.to_object(built)
    one = {k: v for k, v in two.items() if k != "serializationVersion"}
    one["index"] = [[t, {f: {"df": len(ds), "ds": ds} for f, ds in by.items()}] for t, by in two["index"]]
    assert two["fieldLength"] == {"0": [2, 7], "1": [3, 6], "2": [2, 8]} and two["averageFieldLength"] == pytest.approx([7 / 3, 7.0])
    for loaded in (snapshot.load_text(spark, json.dumps(one), options), snapshot.load_async(spark, json.dumps(two), options).result(), snapshot.load_object(spark, two, options)):
        assert snapshot.to_object(loaded) == two
        assert [(r.id, r.category) for r in search(loaded, "vita").collect()] == [(r.id, r.category) for r in search(built, "vita").collect()]
    assert snapshot.load_object(spark, two | {"documentCount": 99}, options).document_count() == 99
    with pytest.raises(ValueError, match="incompatible version"):
        snapshot.load_object(spark, two | {"serializationVersion": 3}, options)


def test_term_map(spark):
    words = {"zen": 1, "zenith": 2, "border": 3, "acquire": 4, "acqua": 5, "poisson": 6, "été": 7}
    m = TermMap.from_object(spark, words)
    pairs = lambda df: {r.key: r.value for r in df.collect()}
    assert m.size() == 7 and not m.is_empty() and TermMap.empty(spark).is_empty() and m.clear().size() == 0
    assert m.get("zen") == 1 and m.get("ze") is None and m.has("zenith") and not m.has("")
    assert pairs(m.prefix_entries("zen")) == {"zen": 1, "zenith": 2} and pairs(m.prefix_entries("")) == words
    assert pairs(m.set("zen", 9).set("", 0).entries) == words | {"zen": 9, "": 0}
    assert pairs(m.set_all(spark.createDataFrame([("zen", 5), ("new", 6)], "key string, value bigint")).entries) == words | {"zen": 5, "new": 6}
    assert pairs(m.update("zen", lambda v: v + 1).update("new", lambda v: F.coalesce(v, F.lit(0)) + 1).entries) == words | {"zen": 2, "new": 1}
    assert pairs(m.fetch("zen", 0).fetch("new", 0).delete("border").delete("none").entries) == {k: v for k, v in (words | {"new": 0}).items() if k != "border"}
    view = m.at_prefix("acq")
    assert view.size() == 2 and view.at_prefix("acqui").size() == 1
    with pytest.raises(ValueError):
        view.at_prefix("zen")
    seen = []
    m.for_each(lambda k, v: seen.append((k, v)))
    assert seen == sorted(words.items()) and [r.key for r in m.sorted_entries().collect()] == sorted(words)
    assert {r.key for r in m.keys().collect()} == set(words) and {r.value for r in m.values().collect()} == set(words.values())
    for bad in (lambda: TermMap.from_object(spark, {1: 2}), lambda: m.get(3), lambda: TermMap.of(spark.range(3).selectExpr("id", "id AS v"), "id", "v")):
        with pytest.raises(TypeError):
            bad()


def test_distances_against_a_plain_table(spark):
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(8))): k for k in range(150)} | {"a" * 70 + "b": 1, "a" * 70: 2}
    m = TermMap.from_object(spark, words)
    for key in ["", "a", "abba", "éab", "a" * 69]:
        for most in range(4):
            got = {(r.key, r.value, r.distance) for r in m.fuzzy_get(key, most).collect()}
            assert got == {(w, v, edits(w, key)) for w, v in words.items() if edits(w, key) <= most}


