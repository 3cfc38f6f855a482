import random

import pytest
from pyspark.sql import functions as F

from inkdex.functions import text as analysis
from inkdex.operators.batch import search_batch
from inkdex.operators.search import count, count_with, search, search_compact, search_joined, search_packed
from inkdex.operators.suggest import auto_suggest
from inkdex.options import WILDCARD, Bm25, IndexOptions, QueryNode, SearchOptions, Weights, get_default, max_distance
from inkdex.plans.index import NUMBER, build
from tests.oracle import Model

S = SearchOptions
BOOKS = [
    (1, "Moby Dick", "Call me Ishmael. Some years ago...", "fiction"), (2, "Zen and the Art of Motorcycle Maintenance", "I can see by my watch...", "fiction"),
    (3, "Neuromancer", "The sky above the port was...", "fiction"), (4, "Zen and the Art of Archery", "At first sight it must seem...", "non-fiction")]


@pytest.fixture(scope="module")
def books(spark):
    df = spark.createDataFrame(BOOKS, "id bigint, title string, text string, category string")
    return build(df, IndexOptions(fields=("title", "text"), store_fields=("title", "category")))


def scores(index, query, options=None):
    return [(r.id, round(r.score, 12)) for r in search(index, query, options).collect()]


@pytest.mark.parametrize("query,options,want", [
    ("zen art motorcycle", None, [(2, 9.926306505039), (4, 3.714422295825)]),
    ("moto", S(prefix=True), [(2, 0.488751162743)]),
    ("ismael", S(fuzzy=0.2), [(1, 0.711096437555)]),
    ("zen archery", S(combine_with="AND"), [(4, 5.083123012939)]),
    ("zen archery", S(combine_with="AND_NOT"), [(2, 0.885415921457)]),
    ("zen", S(boost={"title": 2}), [(4, 1.857211147913), (2, 1.770831842915)]),
    ("", None, []), ("zen nothing", S(combine_with="AND"), []), ("zen zen", S(combine_with="AND_NOT"), []),
    ("zen", S(fields=()), []), ("zen", S(fields=("text", "nowhere")), [])])
def test_absolute_scores(books, query, options, want):
    assert scores(books, query, options) == want


def corpus(seed, n, missing=0.0):
    rng = random.Random(seed)
    words = ["the", "The", "then", "them", "zen", "art", "arts", "été", "ete", "a", "ab", "abc", "abd", "x-y", "über", "uber", "don't"]
    text = lambda k: None if rng.random() < missing else " ".join(rng.choice(words) for _ in range(rng.randrange(k)))
    return [(i, text(12), text(5)) for i in range(n)]


def pair(spark, rows, **more):
    model = Model(["body", "head"])
    for key, *texts in rows:
        model.add(key, texts)
    df = spark.createDataFrame(rows, "id bigint, body string, head string")
    return build(df, IndexOptions(fields=("body", "head"), **more)), model


def same(index, model, query, options, **expected):
    rows = search(index, query, options).collect()
    want = model.search(query, **expected)
    assert {r.id for r in rows} == set(want), (query, expected)
    for r in rows:
        score, match, terms = want[r.id]
        assert r.score == pytest.approx(score, rel=1e-9), (query, expected, r)
        assert {t: set(f) for t, f in r.match.items()} == match and r.terms == sorted(match) and r.query_terms == terms
    order = [(-round(r.score, 9), r.id) for r in rows]
    assert order == sorted(order)


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_random_corpora_against_the_model(spark, missing):
    index, model = pair(spark, corpus(int(missing * 10), 60, missing))
    assert index.averages == pytest.approx(model.average, rel=1e-9)
    rng = random.Random(4)
    for _ in range(12):
        query = " ".join(rng.choice(["the", "zen", "ar", "abc", "été", "nothing", "a", "x", "them"]) for _ in range(rng.randrange(1, 4)))
        how, prefix, fuzzy = rng.choice(["or", "and", "and_not"]), rng.random() < 0.5, rng.choice([0, 0.2, True, 0.4, 1, 2.7, False])
        boosts, limit = rng.choice([None, {"head": 2.5}, {"body": 0.5, "head": 3}]), rng.choice([1, 6])
        weights, bm25 = rng.choice([(0.45, 0.375), (0.9, 0.1)]), rng.choice([(1.2, 0.7, 0.5), (0.5, 0.0, 0.0)])
        options = S(combine_with=how.upper(), prefix=prefix, fuzzy=fuzzy, boost=boosts, max_fuzzy=limit, weights=Weights(*weights), bm25=Bm25(*bm25))
        own = {0: (boosts or {}).get("body", 1.0), 1: (boosts or {}).get("head", 1.0)}
        same(index, model, query, options, how=how, prefix=prefix, fuzzy=fuzzy, boosts=own, max_fuzzy=limit, weights=weights, bm25=bm25)
    same(index, model, "the zen", S(fields=("head",)), boosts={1: 1.0})


def test_running_average_with_missing_fields(spark):
    for texts, want in ((["a b c d e f g h i j", None, "a b c d"], 8.0), ([None, "a b c d e f g h i j", "a b c d"], 14 / 3), ([None, None], 0.0)):
        df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
        assert build(df, IndexOptions(fields=("text",))).averages[0] == pytest.approx(want)
    df = spark.createDataFrame(list(enumerate(["a b", None])), "id bigint, text string")
    assert build(df, IndexOptions(fields=("text",), null_as_empty=True)).averages[0] == 1.0


def test_field_lengths_count_distinct_raw_tokens(spark):
    df = spark.createDataFrame([(1, "The the THE the"), (2, "a\tb a\nb"), (3, "...")], "id bigint, text string")
    index = build(df, IndexOptions(fields=("text",)))
    assert [r[0] for r in index.docs.orderBy(NUMBER).select("__length0").collect()] == [3, 3, 0]
    assert {r.term: r.tf for r in index.postings.where("length = 3").collect() if r.term == "the"} == {"the": 4}


def test_long_fields_are_clamped_in_scores_only(spark, monkeypatch):
    from inkdex.plans import index as plan

    monkeypatch.setattr(plan, "LONGEST", 3)
    index = build(spark.createDataFrame([(1, "a b c d e f"), (2, "a")], "id bigint, text string"), IndexOptions(fields=("text",)))
    assert index.averages == (3.5,) and {r.length for r in index.postings.where("term = 'a'").collect()} == {1, 3}


def test_nested_queries_and_wildcards(books):
    ids = lambda q, o=None: sorted(r.id for r in search(books, q, o).collect())
    assert ids(WILDCARD) == [1, 2, 3, 4] and ids("*") == []
    assert ids(QueryNode((WILDCARD, "zen"), "AND_NOT")) == [1, 3]
    assert ids(QueryNode((WILDCARD, "zen"), "AND")) == [2, 4]
    assert ids(QueryNode(("zen archery", QueryNode(("neuro",), options=S(prefix=True))), "OR", S(combine_with="OR"))) == [2, 3, 4]
    assert ids(QueryNode((QueryNode(("zen motorcycle",), options=S(combine_with="AND")), QueryNode(("sky port",), "AND")), "OR")) == [2, 3]
    assert ids(QueryNode((), "AND")) == []
    assert ids(WILDCARD, S(filter=F.col("category") == "fiction")) == [1, 2, 3]
    boosted = search(books, WILDCARD, S(boost_document=lambda key, term: F.when(F.col("category") == "fiction", 2.0))).collect()
    assert [(r.id, r.score) for r in boosted] == [(1, 2.0), (2, 2.0), (3, 2.0)]


def test_quality_is_applied_once_at_the_root(books):
    one = {r.id: r.score for r in search(books, "zen art", None).collect()}
    tree = {r.id: r.score for r in search(books, QueryNode((QueryNode(("zen",)), QueryNode(("art",))), "OR")).collect()}
    assert tree == pytest.approx(one)


def test_option_cascade(spark):
    df = spark.createDataFrame(BOOKS, "id bigint, title string, text string, category string")
    index = build(df, IndexOptions(fields=("title", "text"), search=S(prefix=True, combine_with="AND", boost={"title": 2.0}, bm25=Bm25(k=2.0))))
    assert [r.id for r in search(index, "ze archer").collect()] == [4]
    assert [r.id for r in search(index, "ze archer", S(combine_with="OR")).collect()] == [4, 2]
    assert search(index, "ze archer", S(), compat=True).collect() == []
    assert [r.id for r in search(index, "zen", S(boost={}), compat=True).collect()] == [4, 2]


def test_filters_and_boosts(books):
    plain = {r.id: r.score for r in search(books, "zen the").collect()}
    kept = {r.id: r.score for r in search(books, "zen the", S(filter=F.col("category") == "fiction")).collect()}
    assert kept == {k: plain[k] for k in (2, 3)}
    top = search(books, "zen the", S(filter=F.col("category") == "fiction"), limit=1).collect()
    assert [r.id for r in top] == [2]
    by_term = {r.id: r.score for r in search(books, "zen the", S(boost_term=lambda t, n, all: 3.0 if t == "zen" else 1.0)).collect()}
    assert by_term[2] > plain[2] and by_term[3] == pytest.approx(plain[3])
    dropped = search(books, "zen the", S(boost_document=lambda key, term: F.when(term == "zen", 0.0).when(key == 4, None).otherwise(2.0))).collect()
    assert {r.id for r in dropped} == {2, 3} and next(r.score for r in dropped if r.id == 3) == pytest.approx(2 * plain[3])


def test_result_forms(books):
    full = search(books, "zen art", limit=5).collect()
    assert full[0].asDict().keys() == {"id", "score", "terms", "query_terms", "match", "title", "category"}
    assert "match" not in search(books, "zen", include_match=False).columns
    small = search_compact(books, "zen art").collect()
    assert [(r.id, r.score, r.terms) for r in small] == [(r.id, r.score, r.terms) for r in full]
    packed = search_packed(books, "zen art").first()
    assert packed.ids == [r.id for r in full] and packed.scores == [r.score for r in full] and packed.terms == [r.terms for r in full]
    joined = search_joined(books, "zen art").first()
    assert joined["count"] == 2 and joined.ids == "4\n2" and joined.terms == "art zen\nart zen"
    assert search_joined(books, "nothing").first()["count"] == 0
    assert count(books, "zen") == 2 and count_with(books, "moto", True, False) == 1 and count_with(books, "ismael", False, True) == 1


def test_joined_keeps_the_configured_combination(spark):
    df = spark.createDataFrame(BOOKS, "id bigint, title string, text string, category string")
    index = build(df, IndexOptions(fields=("title",), search=S(combine_with="AND")))
    assert search_joined(index, "zen archery").first().ids == "4"
    assert search_joined(index, "zen archery", or_mode=True).first().ids == "4\n2"


def test_suggestions(books):
    got = [(r.suggestion, r.terms) for r in auto_suggest(books, "zen ar").collect()]
    assert got == [("zen archery art", ["zen", "archery", "art"]), ("zen art", ["zen", "art"])]
    assert auto_suggest(books, "nothing").collect() == []
    total = auto_suggest(books, "zen", S(filter=F.col("category") == "fiction"), total=True).collect()
    assert [r.suggestion for r in total] == ["zen"]


def test_batch_equals_single_searches(spark, books):
    texts = [(1, "zen art"), (2, "the sky"), (3, ""), (4, "ne mot"), (5, "zen zen art")]
    queries = spark.createDataFrame(texts, "qid bigint, q string")
    for options in (S(), S(prefix=True), S(combine_with="AND", prefix=True), S(combine_with="AND_NOT"), S(boost={"title": 3.0}, fields=("title",))):
        got = {(r.query, r.id): r.score for r in search_batch(books, queries, "qid", "q", options).collect()}
        want = {(k, r.id): r.score for k, q in texts for r in search(books, q, options).collect()}
        assert got == pytest.approx(want), options
    best = search_batch(books, queries, "qid", "q", top=1).collect()
    assert sorted((r.query, r.id) for r in best) == [(1, 4), (2, 3), (5, 4)]
    with pytest.raises(ValueError):
        search_batch(books, queries, "qid", "q", S(fuzzy=0.2))


def test_custom_analyzers(spark):
    rows = [(1, "node.js and C++ at .NET...", ["x", None, "y"], True), (2, "the end", None, False)]
    df = spark.createDataFrame(rows, "id bigint, title string, tags array<string>, flag boolean")
    job = build(df, IndexOptions(fields=("title",), tokenize=analysis.jobboard_tokens, process_term=analysis.jobboard_terms))
    for q in ("c++", ".net", "Node.js"):
        assert [r.id for r in search(job, q).collect()] == [1]
    values = build(df, IndexOptions(fields=("tags", "flag")))
    assert [r.id for r in search(values, "y").collect()] == [1] and [r.id for r in search(values, "false").collect()] == [2]
    stop = analysis.each(lambda t: F.when(~F.lower(t).isin("the", "and"), F.lower(t)))
    index = build(df, IndexOptions(fields=("title",), process_term=stop))
    assert search(index, "the and").collect() == [] and [r.id for r in search(index, "The end").collect()] == [2]
    both = build(df, IndexOptions(fields=("title",), process_term=analysis.expand(lambda t: F.array(F.lower(t), F.reverse(F.lower(t)))), search=S(process_term=analysis.default_terms)))
    assert [r.id for r in search(both, "dne").collect()] == [2]
    named = build(df, IndexOptions(fields=("first",), extract={"first": F.get("tags", F.lit(0))}))
    assert [r.id for r in search(named, "x").collect()] == [1]
    scripts = spark.createDataFrame([(1, "соль сахар"), (2, "りんご　みかん"), (3, "αλάτι, ζάχαρη"), (4, "٤ مل")], "id bigint, title string")
    index = build(scripts, IndexOptions(fields=("title",)))
    assert [[r.id for r in search(index, q).collect()] for q in ("сахар", "みかん", "Ζάχαρη", "٤")] == [[1], [2], [3], [4]]


def test_errors(spark, books):
    make = lambda rows, **o: build(spark.createDataFrame(rows, "id bigint, text string"), IndexOptions(fields=("text",), **o))
    for rows, options, text in (([(1, "a"), (1, "b")], {}, "duplicate ID 1"), ([(None, "a")], {}, "ID field"), ([(1, "a")], {"id_field": "key"}, "ID field")):
        with pytest.raises(ValueError, match=text):
            make(rows, **options)
    with pytest.raises(ValueError, match="Invalid combination operator: XOR"):
        search(books, "zen", S(combine_with="XOR"))
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            IndexOptions(fields=bad)
    with pytest.raises(ValueError):
        get_default("nothing")
    assert get_default("max_fuzzy") == 6
    clash = build(spark.createDataFrame([(1, "a")], "id bigint, score string"), IndexOptions(fields=("score",), store_fields=("score",)))
    with pytest.raises(ValueError, match="clash"):
        search(clash, "a")


def test_distances():
    assert [max_distance("abcde", f, 6) for f in (None, False, 0, -1, True, 0.2, 0.5, 0.9, 1, 2.9, 9)] == [0, 0, 0, 0, 1, 1, 3, 5, 1, 2, 9]
    assert max_distance("a" * 50, 0.9, 6) == 6 and max_distance("ab", 0.25, 6) == 1


def test_empty_index(spark):
    index = build(spark.createDataFrame([], "id bigint, text string"), IndexOptions(fields=("text",)))
    assert index.document_count() == 0 and index.term_count() == 0
    assert search(index, "a", S(prefix=True, fuzzy=0.3)).collect() == [] and search(index, WILDCARD).collect() == []


@pytest.mark.parametrize("dead", [False, True])
def test_expansions_too_many_to_fetch(spark, monkeypatch, dead):
    from inkdex.operators import expand, mutate

    rows = corpus(8, 40)
    index, model = pair(spark, rows if not dead else rows + [(99, "the then zen", "art")])
    if dead:
        index = mutate.discard(index, 99)
    monkeypatch.setattr(expand, "SMALL_ROWS", 1)
    model = Model(["body", "head"])
    for key, *texts in rows:
        model.add(key, texts)
    same(index, model, "the ar zen", S(prefix=True, fuzzy=0.4), prefix=True, fuzzy=0.4)
