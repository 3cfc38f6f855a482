"""Search: a plan from a query to ranked documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkdex.operators import combine
from inkdex.operators.expand import Spec, query_terms, searched_fields, specs_of
from inkdex.operators.score import hits
from inkdex.options import CombineWith, Query, QueryNode, SearchOptions, Wildcard
from inkdex.plans.index import NUMBER, SearchIndex

FEW = 1000  # up to this limit, the best hits are fetched before their documents are looked up


class _Tree:
    """A query tree turned to words and an expression that combines them."""

    def __init__(self, index: SearchIndex, compat: bool):
        self.index, self.compat, self.specs, self.wild = index, compat, [], []

    def part(self, query: Query, options: SearchOptions) -> combine.Part:
        if isinstance(query, Wildcard):
            self.wild.append(options)
            score = F.lit(1.0)
            if options.boost_document is not None:
                score = options.boost_document(F.col(self.index.options.id_field), F.lit("")).cast("double")
            fits = score.isNotNull() & (score != 0)
            return combine.Part(fits, F.when(fits, score).otherwise(0.0), ())
        if isinstance(query, QueryNode):
            own = query.options
            if query.combine_with is not None:
                own = replace(own, combine_with=query.combine_with)
            own = own.over(options)
            return combine.combine([self.part(q, own) for q in query.queries], CombineWith.parse(own.combine_with or "or"))
        options = options.resolved()
        own = specs_of(query_terms(self.index, query, options), options, len(self.specs))
        self.specs += own
        return combine.combine([combine.word(s.place) for s in own], options.combine_with)


def merged(index: SearchIndex, options: SearchOptions | None, compat: bool) -> SearchOptions:
    return (options or SearchOptions()).over(index.options.search, overwrite=compat)


def _documents(index: SearchIndex, options: SearchOptions) -> DataFrame:
    """Live documents that pass the filter, with id and stored fields."""
    keep = [NUMBER, index.options.id_field, *[c for c in index.options.store_fields if c != index.options.id_field]]
    docs = index.live_docs.select(*keep)
    return docs if options.filter is None else docs.where(options.filter)


def _words(specs: list[Spec], places: Column) -> Column:
    """Distinct terms of the used words, in the query's order."""
    terms = F.array(*[F.lit(s.term) for s in specs]) if specs else F.array().cast("array<string>")
    return F.array_distinct(F.transform(places, lambda p: F.get(terms, p)))


def ranked(index: SearchIndex, query: Query, options: SearchOptions | None = None, match: bool = True, limit: int | None = None, compat: bool = False) -> DataFrame:
    """(number, id, stored fields, score, terms, query_terms[, match]), not yet sorted unless limited."""
    options = merged(index, options, compat)
    tree = _Tree(index, compat)
    part = tree.part(query, options)
    specs = tree.specs
    places = F.array_compact(F.array(*part.places)) if part.places else F.array().cast("array<int>")
    limited = limit is not None and limit <= FEW and options.filter is None and not tree.wild
    if specs:
        found = hits(index, specs)
        sums = [F.sum(F.when(F.col("place") == s.place, F.col("score"))).alias(f"__s{s.place}") for s in specs]
        seen = F.collect_set(F.struct("place", "term", "field")).alias("__seen")
        if limited:  # the best are found by their scores alone; only their hits are gathered
            quality = F.greatest(F.lit(1), F.size(_words(specs, places)))
            first = found.groupBy(NUMBER).agg(*sums).where(part.present).select(NUMBER, (part.score * quality).alias("score"))
            best = [r[0] for r in first.orderBy(F.desc("score"), F.asc(NUMBER)).limit(limit).select(NUMBER).collect()]
            found = found.where(F.col(NUMBER).isin(best))
        rows = found.groupBy(NUMBER).agg(*sums, seen)
    else:
        rows = index.spark.createDataFrame([], f"`{NUMBER}` bigint, __seen array<struct<place: int, term: string, field: int>>")
    docs = _documents(index, options)
    if tree.wild:
        rows = docs.join(rows, NUMBER, "left")
    used = F.filter(F.coalesce("__seen", F.array().cast("array<struct<place: int, term: string, field: int>>")), lambda h: F.array_contains(F.col("__places"), h["place"]))
    rows = rows.withColumn("__places", places).where(part.present)
    rows = rows.withColumn("__hits", used).withColumn("query_terms", _words(specs, F.col("__places")))
    rows = rows.withColumn("score", part.score * F.greatest(F.lit(1), F.size("query_terms")))
    rows = rows.withColumn("terms", F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["term"]))))
    if match:
        rows = rows.withColumn("match", _match(index, options))
    outputs = ["score", "terms", "query_terms", *(["match"] if match else [])]
    clash = set(outputs) & set(docs.columns)
    if clash:
        raise ValueError(f"stored fields clash with results: {', '.join(sorted(clash))}")
    order = [F.desc("score"), F.asc(NUMBER)]
    inner = ["__places", "__hits"]
    if limited:
        # the best are fetched, and their numbers pushed into the scan of the documents, which are sorted by them
        best = rows.select(NUMBER, *outputs, *inner).orderBy(*order).limit(limit)
        found = best.toArrow()
        rows = F.broadcast(index.spark.createDataFrame(found, best.schema))
        return docs.where(F.col(NUMBER).isin(found[NUMBER].to_pylist())).join(rows, NUMBER).select(*docs.columns, *outputs, *inner)
    if not tree.wild:
        rows = rows.join(docs, NUMBER)
    rows = rows.select(*docs.columns, *outputs, *inner)
    return rows.orderBy(*order).limit(limit) if limit is not None else rows


def _match(index: SearchIndex, options: SearchOptions) -> Column:
    """Map from term to the names of the fields it was found in, in the order of the search."""
    order = [f for f, _, _ in searched_fields(index, options)]
    order += [n for n in range(len(index.fields)) if n not in order]
    rank = F.array(*[F.lit(order.index(n)) for n in range(len(index.fields))])
    names = F.array(*[F.lit(index.fields[n]) for n in order])
    at = lambda t: F.array_sort(F.array_distinct(F.transform(F.filter("__hits", lambda h: h["term"] == t), lambda h: F.get(rank, h["field"]))))
    return F.map_from_arrays(F.col("terms"), F.transform("terms", lambda t: F.transform(at(t), lambda n: F.get(names, n))))


def _sorted(rows: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    order = [F.desc("score"), F.asc(NUMBER)]
    if limit is not None and limit <= FEW:  # one task sorts few rows; a global sort would sample them first
        return rows.repartition(1).sortWithinPartitions(*order).select(*columns)
    return rows.orderBy(*order).select(*columns)


def search(index: SearchIndex, query: Query, options: SearchOptions | None = None, limit: int | None = None, include_match: bool = True, compat: bool = False) -> DataFrame:
    """All hits, best first, ties in the order of indexing: id, score, terms, query_terms, match, stored fields."""
    rows = ranked(index, query, options, include_match, limit, compat)
    key = index.options.id_field
    return _sorted(rows, [key, "score", "terms", "query_terms", *(["match"] if include_match else []), *[c for c in index.options.store_fields if c != key]], limit)


def search_compact(index: SearchIndex, query: Query, options: SearchOptions | None = None, limit: int | None = None) -> DataFrame:
    """id, score, terms."""
    return _sorted(ranked(index, query, options, False, limit), [index.options.id_field, "score", "terms"], limit)


def count(index: SearchIndex, query: Query, options: SearchOptions | None = None) -> int:
    return ranked(index, query, options, False).count()


def count_with(index: SearchIndex, query: str, prefix: bool, fuzzy: bool) -> int:
    """Hits with prefix matching as told and a fuzzy share of 0.2 or none, whatever the defaults."""
    return count(index, query, SearchOptions(prefix=prefix, fuzzy=0.2 if fuzzy else False))


def search_packed(index: SearchIndex, query: Query, options: SearchOptions | None = None, limit: int | None = None) -> DataFrame:
    """One row of arrays ids, scores, terms, best first; made for results that one row can hold."""
    rows = ranked(index, query, options, False, limit)
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), F.col(NUMBER).alias("b"), F.col(index.options.id_field).alias("id"), "score", F.col("terms"))))
    packed = rows.agg(best.alias("p"))
    pick = lambda name: F.transform("p", lambda r: r[name]).alias(f"{name}s" if name != "terms" else "terms")
    return packed.select(pick("id"), pick("score"), pick("terms"))


def search_joined(index: SearchIndex, query: Query, or_mode: bool = False, limit: int | None = None) -> DataFrame:
    """One row: count, ids a line each, scores, terms a line each; ``or_mode`` forces OR, else the defaults hold."""
    packed = search_packed(index, query, SearchOptions(combine_with=CombineWith.OR) if or_mode else None, limit)
    lines = lambda c: F.array_join(c, "\n")
    return packed.select(
        F.size("ids").alias("count"), lines(F.transform("ids", lambda x: x.cast("string"))).alias("ids"), "scores",
        lines(F.transform("terms", lambda t: F.array_join(t, " "))).alias("terms"))
