"""Registered queries of the search engine, each over whole tables, with their SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkdex import oracles
from inkdex.functions import text as analysis
from inkdex.operators import mutate
from inkdex.operators.batch import search_batch
from inkdex.operators.expand import candidates, specs_of
from inkdex.operators.search import count, search, search_compact, search_joined, search_packed
from inkdex.operators.suggest import auto_suggest
from inkdex.operators.termmap import TermMap
from inkdex.options import WILDCARD, Bm25, CombineWith, IndexOptions, QueryNode, SearchOptions, Weights, get_default
from inkdex.plans.index import NUMBER, SearchIndex, build, empty
from inkdex.plans.storage import shared_folder
from inkdex.sources import snapshot
from inkdex.sources.documents import from_json_array
from inkdex.sources.persist import load, save, to_json
from inkdex.streaming.ingest import LiveIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_built: dict[tuple, SearchIndex] = {}

DOCUMENTS = IndexOptions(fields=("text", "source"), id_field="doc_id", store_fields=("lang",))
PARTS = IndexOptions(fields=("p_name", "p_brand", "p_type"), id_field="p_partkey", store_fields=("p_brand", "p_size"))
PAGES = IndexOptions(fields=("html", "url"), id_field="page_id", tokenize=analysis.jobboard_tokens, process_term=analysis.jobboard_terms)
TALKS = IndexOptions(fields=("text",), id_field="turn_id", store_fields=("role",))

D = ("documents", "doc_id", ["text", "source"])
P = ("part", "p_partkey", ["p_name", "p_brand", "p_type"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], SearchIndex]) -> SearchIndex:
    """Indexes are built once for each session and folder, and searched often."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def documents(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return _index(spark, sf_dir, "documents", lambda: build(table(spark, sf_dir, "documents"), DOCUMENTS))


def parts(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return _index(spark, sf_dir, "part", lambda: build(table(spark, sf_dir, "part"), PARTS))


def pages(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return _index(spark, sf_dir, "pages", lambda: build(table(spark, sf_dir, "pages"), PAGES))


def talks(spark: SparkSession, sf_dir: str) -> SearchIndex:
    turns = lambda: table(spark, sf_dir, "conversations").withColumn("turn_id", F.concat_ws(":", "conv_id", "turn"))
    return _index(spark, sf_dir, "conversations", lambda: build(turns(), TALKS))


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def flat(df: DataFrame) -> DataFrame:
    return df.select(df.columns[0], F.round("score", 6).alias("score"))


def _register_search(name: str, index, text, options: SearchOptions | None, sql: str) -> None:
    @query(sql, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(search(index(spark, sf_dir), text, options, include_match=False))


# analysis


@query(f"SELECT lower(t) AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {oracles.literal(oracles.DEFAULT_TOKEN)})) AS t FROM documents) GROUP BY 1")
def tok_default_documents(spark, sf_dir):
    terms = analysis.default_terms(analysis.default_tokens(F.col("text")))
    return table(spark, sf_dir, "documents").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT * FROM (SELECT rtrim(lower(t), '.') AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, {oracles.literal(oracles.JOBBOARD_TOKEN)})) AS t FROM pages) GROUP BY 1) WHERE term <> ''")
def tok_jobboard_pages(spark, sf_dir):
    terms = analysis.without_empty(analysis.jobboard_terms(analysis.jobboard_tokens(F.col("html"))))
    return table(spark, sf_dir, "pages").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {oracles.corpus(*D)} SELECT a.id AS doc_id, a.len AS text_length, b.len AS source_length FROM len a JOIN len b USING (id) WHERE a.field = 0 AND b.field = 1")
def field_length_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).docs
    return docs.select("doc_id", F.col("__length0").cast("bigint").alias("text_length"), F.col("__length1").cast("bigint").alias("source_length"))


@query(f"WITH {oracles.corpus(*P)} SELECT field::INT AS field, round(avg, 6) AS average FROM stats")
def field_stats_multi(spark, sf_dir):
    averages = parts(spark, sf_dir).averages
    return spark.createDataFrame([(n, float(a)) for n, a in enumerate(averages)], "field int, average double").withColumn("average", F.round("average", 6))


@query(f"WITH {oracles.corpus(*P)} SELECT id AS p_partkey, field::INT AS field, term, tf FROM post")
def term_freq(spark, sf_dir):
    index = parts(spark, sf_dir)
    return index.postings.join(index.docs, NUMBER).select("p_partkey", "field", "term", "tf")


@query(f"WITH {oracles.corpus(*D)} SELECT term, field::INT AS field, df::BIGINT AS df FROM df")
def doc_freq(spark, sf_dir):
    return documents(spark, sf_dir).dictionary.select("term", F.posexplode("df").alias("field", "df")).where("df > 0")


@query(f"WITH {oracles.corpus(*D)} SELECT count(*) AS n FROM terms")
def term_count(spark, sf_dir):
    return spark.createDataFrame([(documents(spark, sf_dir).term_count(),)], "n bigint")


@query("SELECT count(*) AS n FROM documents")
def document_count(spark, sf_dir):
    return spark.createDataFrame([(documents(spark, sf_dir).document_count(),)], "n bigint")


@query("SELECT p_partkey, p_size::VARCHAR AS number, CASE WHEN p_size > 10 THEN 'true' ELSE 'false' END AS flag, p_brand || ',' || p_size::VARCHAR || ',' AS list, '[object Object]' AS object FROM part")
def stringify_values(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("number"), (F.col("p_size") > 10).alias("flag"),
        F.array("p_brand", F.col("p_size").cast("string"), F.lit(None).cast("string")).alias("list"), F.struct("p_size").alias("object"))
    return df.select("p_partkey", *[analysis.stringify(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns[1:]])


@query("""WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, CASE WHEN lang <> 'de' THEN len(list_distinct(regexp_extract_all(text, '[^\\n\\r\\p{Z}\\p{P}]+'))) END AS x FROM documents),
f AS (SELECT k, x, sum(CASE WHEN x IS NOT NULL AND k > 1 THEN ln((k - 1) / k) ELSE 0 END) OVER (ORDER BY k) AS lg FROM l)
SELECT round(sum(x / k * exp((SELECT lg FROM f ORDER BY k DESC LIMIT 1) - lg)), 6) AS average FROM f WHERE x IS NOT NULL""")
def running_average(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("lang") != "de", F.col("text")))
    index = build(df, IndexOptions(fields=("text",), id_field="doc_id"))
    return spark.createDataFrame([(round(index.averages[0], 6),)], "average double")


# look-up


@query(f"WITH {oracles.corpus(*D)} SELECT id AS doc_id, field::INT AS field, tf FROM post WHERE term = 'that'")
def exact_lookup(spark, sf_dir):
    index = documents(spark, sf_dir)
    return index.postings.where("term = 'that'").join(index.docs, NUMBER).select("doc_id", "field", "tf")


@query(f"WITH {oracles.corpus(*D)} SELECT term FROM terms WHERE starts_with(term, 'tha')")
def prefix_terms(spark, sf_dir):
    return documents(spark, sf_dir).dictionary.where(F.col("term").startswith("tha")).select("term")


@query(f"WITH {oracles.corpus(*D)} SELECT term FROM terms WHERE levenshtein({oracles.plain('term')}, 'thatin') BETWEEN 1 AND 2")
def fuzzy_terms(spark, sf_dir):
    specs = specs_of(["thatin"], SearchOptions(fuzzy=2).resolved(), 0)
    return candidates(documents(spark, sf_dir), specs).where("term != 'thatin'").select("term")


@query(f"WITH {oracles.corpus(*D)} SELECT term AS key, sum(df)::BIGINT AS value, levenshtein({oracles.plain('term')}, 'onthe')::INT AS distance FROM df WHERE levenshtein({oracles.plain('term')}, 'onthe') <= 2 GROUP BY term")
def fuzzy_get_distances(spark, sf_dir):
    entries = documents(spark, sf_dir).dictionary.select(F.col("term").alias("key"), (F.get("df", F.lit(0)) + F.get("df", F.lit(1))).alias("value"))
    return TermMap(entries).fuzzy_get("onthe", 2)


@query(f"WITH {oracles.corpus(*D)},{oracles.hits([('tha', True, 1), ('onthe', True, 2)], {0: 1, 1: 1})} SELECT qi::INT AS place, term, round(weight, 6) AS weight FROM found")
def expand_weights_prefix_fuzzy(spark, sf_dir):
    specs = specs_of(["tha", "onthe"], SearchOptions(prefix=True, fuzzy=0.3).resolved(), 0)
    return candidates(documents(spark, sf_dir), specs).select("place", "term", F.round("weight", 6).alias("weight"))


# ranking and combination

S = SearchOptions
_register_search("bm25_single_term", documents, "that", None, oracles.search(*D, [("that",)]))
_register_search("bm25_multi_field", documents, "that src3 nicht", None, oracles.search(*D, [("that",), ("src3",), ("nicht",)]))
_register_search("bm25_params", documents, "that for", S(bm25=Bm25(2.0, 0.3, 0.1)), oracles.search(*D, [("that",), ("for",)], k=2.0, b=0.3, d=0.1))
_register_search("field_boost", documents, "that src3", S(boost={"source": 3.0}), oracles.search(*D, [("that",), ("src3",)], {0: 1, 1: 3}))
_register_search("field_select", documents, "that src3", S(fields=("source", "unknown")), oracles.search(*D, [("that",), ("src3",)], {1: 1}))
_register_search("prefix_search", documents, "tha fo", S(prefix=True), oracles.search(*D, [("tha", True), ("fo", True)]))
_register_search("fuzzy_search", documents, "thatin form", S(fuzzy=0.25), oracles.search(*D, [("thatin", False, 2), ("form", False, 1)]))
_register_search("prefix_fuzzy_search", documents, "that for", S(prefix=True, fuzzy=0.2), oracles.search(*D, [("that", True, 1), ("for", True, 1)]))
_register_search("max_fuzzy", documents, "thatinth", S(fuzzy=0.9, max_fuzzy=2), oracles.search(*D, [("thatinth", False, 2)]))
_register_search("weights_override", documents, "tha form", S(prefix=True, fuzzy=0.3, weights=Weights(0.2, 0.9)), oracles.search(*D, [("tha", True, 1), ("form", True, 1)], prefix_weight=0.9, fuzzy_weight=0.2))
_register_search("repeated_query_term", documents, "that that", None, oracles.search(*D, [("that",), ("that",)]))
_register_search("repeated_term_and_not", documents, "that that", S(combine_with="AND_NOT"), oracles.search(*D, [("that",), ("that",)], how="and_not"))
_register_search("or_search", documents, "aien aique al", S(prefix=True), oracles.search(*D, [(w, True) for w in ("aien", "aique", "al")]))
_register_search("and_search", documents, "a of", S(combine_with="AND", prefix=True), oracles.search(*D, [(w, True) for w in ("a", "of")], how="and"))
_register_search("and_fuzzy_search", documents, "thatin form", S(combine_with="and", fuzzy=0.25), oracles.search(*D, [("thatin", False, 2), ("form", False, 1)], how="and"))
_register_search("and_not_search", documents, "that nicht for", S(combine_with="AND_NOT", prefix=True), oracles.search(*D, [(w, True) for w in ("that", "nicht", "for")], how="and_not"))
_register_search("part_search", parts, "brand 2 small", S(prefix=True, fuzzy=0.2, boost={"p_name": 2.0}), oracles.search(*P, [("brand", True, 1), ("2", True), ("small", True, 1)], {0: 2, 1: 1, 2: 1}))
_register_search("empty_query", documents, " .,! ", S(combine_with="AND"), "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false")
_register_search("boost_term", documents, "that for", S(boost_term=lambda t, n, all: 2.5 if t == "for" else 1.0), oracles.search(*D, [("that",), ("for", False, 0, 2.5)]))
_register_search("per_term_fuzzy", documents, "that form", S(fuzzy=lambda t, n, all: 1 if t == "form" else False, prefix=lambda t, n, all: n == 0), oracles.search(*D, [("that", True), ("form", False, 1)]))
_register_search("jobboard_search", pages, "nav. The node.js c++ p", None, oracles.search(
    "pages", "page_id", ["html", "url"], [("nav",), ("the",), ("node.js",), ("c++",), ("p",)], corpus_options={"pattern": oracles.JOBBOARD_TOKEN, "term": "rtrim(lower(t), '.')"}))
_register_search("talk_search", talks, "that the", S(combine_with="AND"), oracles.search("(SELECT conv_id || ':' || turn AS turn_id, text FROM conversations)", "turn_id", ["text"], [("that",), ("the",)], how="and"))

_TREE = [("that",), ("for",), ("nicht", True), ("src3",)]
_PIVOT = ", ".join(f"sum(s) FILTER (qi = {n}) AS s{n}" for n in range(4))


@query(oracles.search(*D, _TREE, out=f""", wide AS (SELECT id, {_PIVOT} FROM hit GROUP BY id)
SELECT id AS doc_id, round((CASE WHEN s0 IS NOT NULL AND s1 IS NOT NULL THEN s0 + s1 ELSE 0 END + coalesce(s2, 0))
  * ((CASE WHEN s0 IS NOT NULL AND s1 IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN s2 IS NOT NULL THEN 1 ELSE 0 END)), 6) AS score
FROM wide WHERE ((s0 IS NOT NULL AND s1 IS NOT NULL) OR s2 IS NOT NULL) AND s3 IS NULL"""))
def nested_query_tree(spark, sf_dir):
    both = QueryNode(("that for",), options=S(combine_with="AND"))
    either = QueryNode((both, QueryNode(("nicht",), options=S(prefix=True))), "OR")
    return flat(search(documents(spark, sf_dir), QueryNode((either, "src3"), "AND_NOT"), include_match=False))


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents")
def wildcard(spark, sf_dir):
    return flat(search(documents(spark, sf_dir), WILDCARD, include_match=False))


@query(f"WITH {oracles.corpus(*D)} SELECT id AS doc_id, 1.0::DOUBLE AS score FROM d WHERE id NOT IN (SELECT id FROM post WHERE starts_with(term, 'that'))")
def wildcard_and_not(spark, sf_dir):
    return flat(search(documents(spark, sf_dir), QueryNode((WILDCARD, "that"), "AND_NOT", S(prefix=True)), include_match=False))


# results

_MATCH = """, m AS (SELECT id, term, string_agg(CASE field WHEN 0 THEN 'text' ELSE 'source' END, '+' ORDER BY field) AS f FROM (SELECT DISTINCT id, term, field FROM hit) GROUP BY ALL)
SELECT id AS doc_id, string_agg(term || '=' || f, ' ' ORDER BY term) AS matched FROM m GROUP BY id"""


@query(oracles.search(*D, [("tha", True), ("src", True)], out=_MATCH))
def match_map(spark, sf_dir):
    rows = search(documents(spark, sf_dir), "tha src", S(prefix=True))
    pairs = F.transform(F.map_entries("match"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+")))
    return rows.select("doc_id", F.array_join(pairs, " ").alias("matched"))


@query(oracles.search(*D, [("for",), ("that",), ("fo", True)], out=" SELECT id AS doc_id, string_agg(word, ' ' ORDER BY qi) AS words FROM (SELECT DISTINCT id, qi, word FROM hit) GROUP BY id"))
def query_terms(spark, sf_dir):
    rows = search(documents(spark, sf_dir), "for that fo", S(prefix=lambda t, n, all: t == "fo"))
    return rows.select("doc_id", F.array_join("query_terms", " ").alias("words"))


@query(oracles.search(*D, [("that",)], out=" SELECT id AS doc_id, round(score, 6) AS score, lang FROM res JOIN documents ON doc_id = id"))
def stored_fields(spark, sf_dir):
    return search(documents(spark, sf_dir), "that").select("doc_id", F.round("score", 6).alias("score"), "lang")


_COMPACT = " SELECT r.id AS doc_id, round(any_value(r.score), 6) AS score, string_agg(h.term, ' ' ORDER BY h.term) AS terms FROM res r JOIN (SELECT DISTINCT id, term FROM hit) h USING (id) GROUP BY r.id"


@query(oracles.search(*D, [("tha", True), ("for",)], out=_COMPACT))
def compact(spark, sf_dir):
    rows = search_compact(documents(spark, sf_dir), "tha for", S(prefix=lambda t, n, all: n == 0))
    return rows.select("doc_id", F.round("score", 6).alias("score"), F.array_join("terms", " ").alias("terms"))


_RANKED = " SELECT r.id, round(any_value(r.score), 6) AS score, string_agg(h.term, ' ' ORDER BY h.term) AS terms FROM res r JOIN (SELECT DISTINCT id, term FROM hit) h USING (id) GROUP BY r.id"


@query(oracles.search(*D, [("thatin",), ("src3",)], out=f", best AS ({_RANKED}) SELECT string_agg(id, ' ' ORDER BY id) AS ids, string_agg(terms, ',' ORDER BY id) AS terms, count(*) AS n FROM best"))
def packed(spark, sf_dir):
    """The arrays in the order of ids, as equal scores may differ in their last digits between engines."""
    row = search_packed(documents(spark, sf_dir), "thatin src3")
    rows = F.array_sort(F.arrays_zip("ids", "terms"))
    return row.select(
        F.array_join(F.transform(rows, lambda r: r["ids"].cast("string")), " ").alias("ids"),
        F.array_join(F.transform(rows, lambda r: F.array_join(r["terms"], " ")), ",").alias("terms"), F.size("ids").cast("bigint").alias("n"))


@query(oracles.search(*D, [("thatin",), ("src3",)], out=f", best AS ({_RANKED}) SELECT count(*)::INT AS count, list_aggregate(list_sort(string_split(string_agg(id, chr(10)), chr(10))), 'string_agg', ' ') AS ids, round(sum(score), 4) AS total FROM best"))
def joined(spark, sf_dir):
    row = search_joined(documents(spark, sf_dir), "thatin src3", or_mode=True)
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.round(x, 6))
    return row.select("count", F.array_join(F.array_sort(F.split("ids", "\n")), " ").alias("ids"), F.round(total, 4).alias("total"))


@query(oracles.search(*D, [("tha", True), ("for", True)], out=" SELECT count(*) AS n FROM res"))
def search_count(spark, sf_dir):
    return spark.createDataFrame([(count(documents(spark, sf_dir), "tha for", S(prefix=True)),)], "n bigint")


@query(oracles.search(*D, [("that",), ("for",)], out=" SELECT id AS doc_id, round(score, 6) AS score FROM res ORDER BY round(score, 9) DESC, id LIMIT 20"))
def topk(spark, sf_dir):
    return flat(search(documents(spark, sf_dir), "that for", limit=20, include_match=False))


# mutations

_LIVE = oracles.search(*D, [("that", True), ("un",)], where="lang <> 'de'")
_ANY = S(prefix=lambda t, n, all: n == 0)


def _german(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'de'")


@query(_LIVE)
def discard_search(spark, sf_dir):
    index = mutate.discard_all(documents(spark, sf_dir), _german(spark, sf_dir).select("doc_id"))
    return flat(search(index, "that un", _ANY, include_match=False))


@query(_LIVE)
def remove_search(spark, sf_dir):
    return flat(search(mutate.remove_all(documents(spark, sf_dir), _german(spark, sf_dir)), "that un", _ANY, include_match=False))


@query(oracles.search("(SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' that unthat' ELSE text END AS text, source FROM documents)", "doc_id", ["text", "source"], [("that", True), ("un",)]))
def replace_search(spark, sf_dir):
    changed = _german(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" that unthat")))
    return flat(search(mutate.replace_documents(documents(spark, sf_dir), changed), "that un", _ANY, include_match=False))


@query("SELECT 0::BIGINT AS docs, 0::BIGINT AS found")
def discard_every_document(spark, sf_dir):
    index = documents(spark, sf_dir)
    gone = mutate.discard_all(index, index.docs.select("doc_id"))
    return spark.createDataFrame([(gone.document_count(), count(gone, WILDCARD))], "docs bigint, found bigint")


@query(f"WITH {oracles.corpus(*D, where="lang <> 'de'")} SELECT (SELECT count(*) FROM d) AS docs, (SELECT count(*) FROM terms) AS terms, (SELECT count(*) FROM post) AS postings")
def vacuum_counts(spark, sf_dir):
    index = mutate.vacuum(mutate.discard_all(documents(spark, sf_dir), _german(spark, sf_dir).select("doc_id")))
    return spark.createDataFrame([(index.document_count(), index.term_count(), index.postings.count())], "docs bigint, terms bigint, postings bigint")


@query("SELECT doc_id, lang <> 'de' AS there FROM documents")
def has_ids(spark, sf_dir):
    index = mutate.discard_all(documents(spark, sf_dir), _german(spark, sf_dir).select("doc_id"))
    live = index.live_docs.select("doc_id", F.lit(True).alias("there"))
    return table(spark, sf_dir, "documents").select("doc_id").join(live, "doc_id", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("there"))


@query(oracles.search(*D, [("that", True), ("un",)]))
def incremental_equals_bulk(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    index = mutate.add(build(df.where("lang != 'de'"), DOCUMENTS), df.where("lang = 'de'"))
    return flat(search(index, "that un", _ANY, include_match=False))


@query(oracles.search(*D, [("that", True), ("un",)], where="lang <> 'de'"))
def saved_index(spark, sf_dir):
    index = mutate.discard_all(documents(spark, sf_dir), _german(spark, sf_dir).select("doc_id"))
    path = f"{shared_folder(spark)}/saved-{spark.sparkContext.applicationId}"
    save(index, path, mode="overwrite")
    return flat(search(load(spark, path, DOCUMENTS), "that un", _ANY, include_match=False))


@query(oracles.search("part", "p_partkey", ["p_name", "p_brand"], [("brand", True), ("small", True)]))
def json_ingest(spark, sf_dir):
    """Documents that come as JSON arrays, one for each brand."""
    arrays = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_brand"))).alias("value"))
    docs = from_json_array(arrays, "p_partkey bigint, p_name string, p_brand string")
    index = build(docs, IndexOptions(fields=("p_name", "p_brand"), id_field="p_partkey"))
    return flat(search(index, "brand small", S(prefix=True), include_match=False))


# options that take functions


@query(oracles.search(*D, [("that",), ("for",)], out=" SELECT id AS doc_id, round(score, 6) AS score FROM res JOIN documents ON doc_id = id WHERE lang = 'en'"))
def filter_search(spark, sf_dir):
    return flat(search(documents(spark, sf_dir), "that for", S(filter=F.col("lang") == "en"), include_match=False))


@query(oracles.search(*D, [("that",), ("for",)], out=""", boosted AS (SELECT h.id, h.word, h.s * CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 0.5 END AS s FROM hit h JOIN documents ON doc_id = h.id)
SELECT id AS doc_id, round(sum(s) * count(DISTINCT word), 6) AS score FROM boosted WHERE s IS NOT NULL GROUP BY id"""))
def boost_document(spark, sf_dir):
    by = lambda key, term: F.when(F.col("lang") == "en", 2.0).when(F.col("lang") == "fr", 0.5)
    return flat(search(documents(spark, sf_dir), "that for", S(boost_document=by), include_match=False))


_STOP = ("the", "of", "and")


@query(oracles.search(*D, [("that",), ("in",)], corpus_options={"keep": "term NOT IN ('the', 'of', 'and', '')"}))
def stopword_process_term(spark, sf_dir):
    process = analysis.each(lambda t: F.when(~F.lower(t).isin(*_STOP), F.lower(t)))
    index = _index(spark, sf_dir, "stopwords", lambda: build(table(spark, sf_dir, "documents"), replace(DOCUMENTS, process_term=process)))
    return flat(search(index, "the that of in", include_match=False))


@query(oracles.search("part", "p_partkey", ["p_name"], [("small",), ("lms",)], corpus_options={"term": "[lower(t), right(lower(t), 3)]", "keep": "true"}).replace(
    "unnest(list_transform(toks, lambda t: [lower(t), right(lower(t), 3)]))", "unnest(flatten(list_transform(toks, lambda t: [lower(t), right(lower(t), 3)])))"))
def expand_process_term(spark, sf_dir):
    """Each token is indexed whole and by its last three letters."""
    process = analysis.expand(lambda t: F.array(F.lower(t), F.right(F.lower(t), F.lit(3))))
    options = IndexOptions(fields=("p_name",), id_field="p_partkey", process_term=process, search=S(process_term=analysis.default_terms))
    index = _index(spark, sf_dir, "endings", lambda: build(table(spark, sf_dir, "part"), options))
    return flat(search(index, "small lms", include_match=False))


@query(oracles.search(*D, [("of",), ("thatin", True)], how="and", out=""", used AS (SELECT DISTINCT h.id, h.qi, h.term FROM hit h JOIN res USING (id)),
phrase AS (SELECT id, string_agg(term, ' ' ORDER BY qi, term) AS suggestion FROM used GROUP BY id)
SELECT suggestion, round(avg(score), 6) AS score FROM phrase JOIN res USING (id) GROUP BY suggestion"""))
def suggestions(spark, sf_dir):
    return auto_suggest(documents(spark, sf_dir), "of thatin").select("suggestion", F.round("score", 6).alias("score"))


@query(f"""WITH {oracles.corpus("documents", "doc_id", ["text"])},
w AS (SELECT item_id, lower(t) AS word FROM (SELECT item_id, unnest(regexp_extract_all(text, {oracles.literal(oracles.DEFAULT_TOKEN)})) AS t FROM benchmark)),
h AS (SELECT w.item_id, w.word, p.id, ln(1 + (n.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * (0.5::DOUBLE + p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * l.len / st.avg))) AS s
  FROM w JOIN post p ON p.term = w.word JOIN df ON df.term = p.term AND df.field = p.field JOIN len l ON l.id = p.id JOIN stats st ON st.field = p.field, n),
r AS (SELECT item_id, id, sum(s) * count(DISTINCT word) AS score FROM h GROUP BY ALL)
SELECT item_id AS query, id AS doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, id) AS k FROM r) WHERE k <= 10""", "search_batch")
def batch(spark, sf_dir):
    """The ten best documents for each benchmark passage."""
    index = _index(spark, sf_dir, "texts", lambda: build(table(spark, sf_dir, "documents"), IndexOptions(fields=("text",), id_field="doc_id")))
    rows = search_batch(index, table(spark, sf_dir, "benchmark"), "item_id", "text", top=10)
    return rows.select("query", "doc_id", F.round("score", 5).alias("score"))


# analysis, options and errors beyond the search queries

_CYRILLIC = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнοπρστурりんごみ")


@query(f"SELECT lower(t) AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(lower(text), '{_CYRILLIC[0]}', '{_CYRILLIC[1]}'), {oracles.literal(oracles.DEFAULT_TOKEN)})) AS t FROM documents) GROUP BY 1")
def tok_other_scripts(spark, sf_dir):
    """Texts in Cyrillic, Greek and kana letters."""
    texts = table(spark, sf_dir, "documents").select(F.translate(F.lower("text"), *_CYRILLIC).alias("text"))
    terms = analysis.default_terms(analysis.default_tokens(F.col("text")))
    return texts.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0::BIGINT AS docs, 0::BIGINT AS terms, (SELECT count(*) FROM documents WHERE false) AS found, (SELECT count(*) FROM documents) AS added")
def empty_index(spark, sf_dir):
    """An index without documents, searched, and then given all."""
    df = table(spark, sf_dir, "documents")
    none = empty(spark, DOCUMENTS, df.select("doc_id", "text", "source", "lang").schema)
    full = mutate.add(none, df)
    return spark.createDataFrame([(none.document_count(), none.term_count(), count(none, WILDCARD), full.document_count())], "docs bigint, terms bigint, found bigint, added bigint")


@query("SELECT * FROM (VALUES ('missing', 'document does not have ID field \"doc_id\"'), ('null', 'document does not have ID field \"doc_id\"'), ('repeated', 'duplicate ID'), ('added again', 'duplicate ID')) AS t(given, error)")
def id_errors(spark, sf_dir):
    """What tables without ids, or with ids that repeat, are told."""
    df = table(spark, sf_dir, "documents")
    made = documents(spark, sf_dir)
    tries = {
        "missing": lambda: build(df.drop("doc_id"), DOCUMENTS), "null": lambda: build(df.withColumn("doc_id", F.lit(None).cast("bigint")), DOCUMENTS),
        "repeated": lambda: build(df.unionByName(df), DOCUMENTS), "added again": lambda: mutate.add(made, df)}
    said = []
    for given, attempt in tries.items():
        try:
            attempt()
            said.append((given, "none"))
        except ValueError as e:
            said.append((given, re.sub(r" \d+$", "", str(e))))
    return spark.createDataFrame(said, "given string, error string")


@query("SELECT doc_id AS id, 'thatunknown' AS term, 'text' AS field FROM documents WHERE lang = 'de'")
def changed_documents(spark, sf_dir):
    """The terms that were never indexed, of documents that changed before they are removed."""
    return mutate.changed_terms(documents(spark, sf_dir), _german(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" ThatUnknown"))))


@query("SELECT doc_id, lang, true AS there FROM documents WHERE doc_id IN ((SELECT min(doc_id) FROM documents), (SELECT max(doc_id) FROM documents)) UNION ALL SELECT -1, NULL, false")
def stored_lookup(spark, sf_dir):
    """Stored fields by id: the first document's, the last one's, and those of one that isn't there."""
    index = documents(spark, sf_dir)
    ends = table(spark, sf_dir, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    found = [(key, index.stored_fields(key)) for key in {*ends, -1}]
    return spark.createDataFrame([(key, f and f.get("lang"), f is not None) for key, f in found], "doc_id bigint, lang string, there boolean")


_CASCADE = [oracles.search(*D, words, boosts, how) for words, boosts, how in (
    ([("tha", True), ("src3", True)], {0: 1, 1: 3}, "or"), ([("tha",), ("src3",)], {0: 1, 1: 3}, "or"))]


@query(f"SELECT 'merged' AS how, * FROM ({_CASCADE[0]}) UNION ALL SELECT 'narrow' AS how, * FROM ({_CASCADE[1]})")
def option_cascade(spark, sf_dir):
    """A search's options over the index's: all that is unset is taken from there, or in the narrower cascade fields, boosts and edit distance only."""
    index = documents(spark, sf_dir)
    index = replace(index, options=replace(index.options, search=S(prefix=True, boost={"source": 3.0}, combine_with="AND")))
    merged = search(index, "tha src3", S(combine_with="OR"), include_match=False)
    narrow = search(index, "tha src3", S(), include_match=False, compat=True)
    return flat(merged).withColumn("how", F.lit("merged")).unionByName(flat(narrow).withColumn("how", F.lit("narrow"))).select("how", "doc_id", "score")


@query("SELECT * FROM (VALUES ('auto_vacuum', 'True'), ('combine_with', 'or'), ('fuzzy', 'False'), ('id_field', 'id'), ('max_fuzzy', '6'), ('min_dirt_count', '20'), ('min_dirt_factor', '0.1'), ('prefix', 'False')) AS t(name, value)")
def option_defaults(spark, sf_dir):
    names = ("auto_vacuum", "combine_with", "fuzzy", "id_field", "max_fuzzy", "min_dirt_count", "min_dirt_factor", "prefix")
    text = lambda v: v.value if isinstance(v, CombineWith) else str(v)
    return spark.createDataFrame([(n, text(get_default(n))) for n in names], "name string, value string")


# ways in and out


@query(oracles.search(*D, [("that", True), ("un",)]))
def chunked_ingest(spark, sf_dir):
    """Documents that are added in four parts."""
    df = table(spark, sf_dir, "documents")
    live = LiveIndex(empty(spark, DOCUMENTS, df.schema))
    live.add_chunks(df, 4)
    return flat(search(live.index, "that un", _ANY, include_match=False))


@query(oracles.search(*P, [("brand", True), ("small",)]))
def json_saved_index(spark, sf_dir):
    path = f"{shared_folder(spark)}/json-{spark.sparkContext.applicationId}"
    save(parts(spark, sf_dir), path, mode="overwrite", form="json")
    return flat(search(load(spark, path, PARTS), "brand small", _ANY, include_match=False))


@query(f"WITH {oracles.corpus(*P)} SELECT term, sum(df)::BIGINT AS df FROM df GROUP BY term")
def json_dictionary(spark, sf_dir):
    """The dictionary as lines of JSON, read again."""
    read = F.from_json("value", "term string, df array<bigint>")
    rows = to_json(parts(spark, sf_dir), "dictionary").select(read.alias("r"))
    return rows.select("r.term", F.aggregate("r.df", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("df"))


@query(oracles.search("nation", "n_nationkey", ["n_name"], [("nation_1", True)], corpus_options={"pattern": r"[A-Za-z0-9_]+"}))
def exchanged_index(spark, sf_dir):
    """An index written as one JSON object of the first version and read again."""
    options = IndexOptions(fields=("n_name",), id_field="n_nationkey", store_fields=("n_name",), tokenize=lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    two = snapshot.to_object(build(table(spark, sf_dir, "nation"), options))
    one = {k: v for k, v in two.items() if k != "serializationVersion"}
    one["index"] = [[t, {f: {"df": len(ds), "ds": ds} for f, ds in by.items()}] for t, by in two["index"]]
    return flat(search(snapshot.load_text(spark, json.dumps(one), options, "int"), "nation_1", S(prefix=True), include_match=False))


# order of results


@query(oracles.search(*D, [("that",), ("for",)], out=" SELECT row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank, id AS doc_id FROM res ORDER BY 1 LIMIT 50"))
def rank_order(spark, sf_dir):
    """The order in which a search returns its rows."""
    rows = search(documents(spark, sf_dir), "that for", limit=50, include_match=False)
    return rows.select((F.monotonically_increasing_id() + 1).alias("rank"), "doc_id")  # one sorted partition


@query(oracles.search(*D, [("thatin",), ("src3",)], out=" SELECT string_agg(id, ' ' ORDER BY round(score, 9) DESC, id) AS ids FROM res"))
def packed_order(spark, sf_dir):
    row = search_packed(documents(spark, sf_dir), "thatin src3")
    return row.select(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(oracles.search(*D, [("thatin",), ("src3",)], out=" SELECT string_agg(id, ' ' ORDER BY round(score, 9) DESC, id) AS ids, count(*)::INT AS count FROM res"))
def joined_order(spark, sf_dir):
    return search_joined(documents(spark, sf_dir), "thatin src3", or_mode=True).select(F.translate("ids", "\n", " ").alias("ids"), "count")


# term map


@query("WITH k AS (SELECT DISTINCT repeat('x', 70) || p_name AS key FROM part) SELECT key, levenshtein(key, (SELECT repeat('x', 70) || p_name || 'y' FROM part WHERE p_partkey = 1))::INT AS distance FROM k WHERE levenshtein(key, (SELECT repeat('x', 70) || p_name || 'y' FROM part WHERE p_partkey = 1)) <= 4")
def fuzzy_long_keys(spark, sf_dir):
    """Edit distances of keys of over 64 characters."""
    keys = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.repeat(F.lit("x"), F.lit(70)), "p_name").alias("key"))
    given = keys.where("p_partkey = 1").first().key + "y"
    return TermMap.of(keys, "key", "p_partkey").fuzzy_get(given, 4).select("key", "distance")


@query("SELECT * FROM (VALUES ('size', (SELECT count(*) FROM nation)), ('empty', 0), ('get', (SELECT max(n_nationkey) FROM nation WHERE n_name = 'NATION_7')), ('get none', NULL), ('has', 1), ('has none', 0), ('cleared', 0), ('cleared is empty', 1), ('new is empty', 1), ('visited', (SELECT sum(n_nationkey) FROM nation)), ('in order', 1)) AS t(what, n)")
def termmap_reads(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("bigint").alias("n"))
    m, seen = TermMap.of(names, "n_name", "n"), []
    m.for_each(lambda k, v: seen.append((k, v)))
    rows = [
        ("size", m.size()), ("empty", int(m.is_empty())), ("get", m.get("NATION_7")), ("get none", m.get("NATION_")), ("has", int(m.has("NATION_7"))),
        ("has none", int(m.has("NATION_"))), ("cleared", m.clear().size()), ("cleared is empty", int(m.clear().is_empty())),
        ("new is empty", int(TermMap.empty(spark).is_empty())), ("visited", sum(v for _, v in seen)), ("in order", int(seen == sorted(seen)))]
    return spark.createDataFrame(rows, "what string, n bigint")


@query("SELECT n_name AS key, n_nationkey::BIGINT AS value FROM nation WHERE starts_with(n_name, 'NATION_1')")
def termmap_prefix(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("bigint").alias("n"))
    return TermMap.of(names, "n_name", "n").at_prefix("NATION_1").sorted_entries()


@query("SELECT key, value FROM (SELECT n_name AS key, CASE WHEN n_name = 'NATION_7' THEN 100 + n_nationkey WHEN n_name = 'NATION_12' THEN -1 ELSE n_nationkey END::BIGINT AS value FROM nation WHERE n_name <> 'NATION_3') UNION ALL SELECT 'ATLANTIS', 5::BIGINT")
def termmap_changes(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("bigint").alias("n"))
    m = TermMap.of(names, "n_name", "n").set("NATION_12", -1).update("NATION_7", lambda v: v + 100).delete("NATION_3").fetch("ATLANTIS", 5).fetch("NATION_7", 9)
    return m.entries.select("key", "value")
