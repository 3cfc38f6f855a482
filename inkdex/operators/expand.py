"""From query words to the terms of the dictionary: exact, by prefix and by edit distance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkdex.functions import text as analysis
from inkdex.options import SearchOptions, max_distance
from inkdex.plans.index import SearchIndex
from inkdex.plans.storage import SMALL_ROWS

LISTED, RANGES = 64, 8  # terms, or ranges of terms, that a scan of postings is given; every row is held against all ranges


@dataclass(frozen=True)
class Spec:
    """One word of a query with the way it is matched; ``place`` counts all words of a query tree."""

    place: int
    term: str
    prefix: bool
    distance: int
    boost: float
    options: SearchOptions

    @property
    def exact(self) -> bool:
        return not self.prefix and not self.distance


def query_terms(index: SearchIndex, query: str, options: SearchOptions) -> list[str]:
    """The query's terms in order, repeats included."""
    tokenize = options.tokenize or index.options.tokenize
    process = options.process_term or index.options.process_term
    one = index.spark.range(0, 1, 1, 1).select(analysis.without_empty(process(tokenize(F.lit(query)))).alias("t"))
    return one.first().t or []


def specs_of(terms: list[str], options: SearchOptions, first: int) -> list[Spec]:
    out = []
    for n, term in enumerate(terms):
        pick = lambda x, default, n=n, term=term: x(term, n, terms) if callable(x) else default if x is None else x
        out.append(Spec(
            first + n, term, bool(pick(options.prefix, False)), max_distance(term, pick(options.fuzzy, False), options.max_fuzzy),
            float(pick(options.boost_term, 1.0)), options))
    return out


def weight(spec: Spec, term: Column, size: Column) -> Column:
    """A term's weight for a word: exact, else prefix, else edit distance; null if none."""
    size = size.cast("double")
    own = float(len(spec.term))
    out = F.when(term == spec.term, F.lit(1.0))
    if spec.prefix:
        out = out.when(term.startswith(spec.term), spec.options.weights.prefix * size / (size + 0.3 * (size - own)))
    if spec.distance:
        edits = F.levenshtein(term, F.lit(spec.term), spec.distance)
        near = (F.abs(size - own) <= spec.distance) & edits.between(1, spec.distance)
        out = out.when(near, spec.options.weights.fuzzy * size / (size + edits))
    return out


def reach(specs: list[Spec]) -> Column:
    """What a term must fulfil to be found by some word, in predicates that a scan takes."""
    term, size = F.col("term"), F.col("size")
    out = F.lit(False)
    exact = sorted({s.term for s in specs})
    if exact:
        out = term.isin(exact)
    for s in specs:
        if s.prefix:
            out |= term.startswith(s.term)
        if s.distance:
            out |= size.between(len(s.term) - s.distance, len(s.term) + s.distance)
    return out


def within(terms: list[str]) -> Column:
    """A predicate on the column ``term`` that all of these terms fulfil: the terms themselves, or if they are many, a few ranges with the widest gaps between them."""
    terms = sorted(set(terms))
    if len(terms) <= LISTED:
        return F.col("term").isin(terms)
    at = [int.from_bytes(t.encode()[:8].ljust(8, b"\0"), "big") for t in terms]
    ends = sorted(sorted(range(1, len(terms)), key=lambda n: at[n - 1] - at[n])[: RANGES - 1]) + [len(terms)]
    out, first = F.lit(False), 0
    for end in ends:
        out |= F.col("term").between(terms[first], terms[end - 1])
        first = end
    return out


def candidates(index: SearchIndex, specs: list[Spec]) -> DataFrame:
    """(place, term, df, weight): the dictionary is read once for all words."""
    terms = index.dictionary.where(reach(specs))
    pairs = F.array(*[F.struct(F.lit(s.place).alias("place"), weight(s, F.col("term"), F.col("size")).alias("weight")) for s in specs])
    return terms.select("term", "df", F.inline(F.filter(pairs, lambda p: p["weight"].isNotNull())))


def idf(df: Column, n: int) -> Column:
    return F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def searched_fields(index: SearchIndex, options: SearchOptions) -> list[tuple[int, str, float]]:
    """(field, name, boost) of the fields that are searched; unknown names are passed over."""
    names = index.fields if options.fields is None else options.fields
    return [(index.fields.index(f), f, float((options.boost or {}).get(f, 1.0))) for f in names if f in index.fields]


def factors(index: SearchIndex, specs: list[Spec]) -> tuple[DataFrame, list[str] | None]:
    """(place, term, field, factor), and the terms in it if they are known to be few.

    A factor is all of a contribution that doesn't depend on the document: weight,
    boosts and idf.  What prefixes and edit distances find is counted by
    fetching up to SMALL_ROWS of it; beyond that it stays a table that is joined
    by shuffle.
    """
    spark, found = index.spark, candidates(index, specs)
    few = all(s.exact for s in specs)
    terms = sorted({s.term for s in specs}) if few else None
    if not few:
        rows = found.limit(SMALL_ROWS + 1).toArrow()
        few = rows.num_rows <= SMALL_ROWS
        if few:
            terms = sorted(set(rows["term"].to_pylist()))
            found = spark.createDataFrame(rows, found.schema)
    if index.dead is not None:  # the stored counts include documents that are no longer live
        known = index.live_dictionary(F.broadcast(found.select("term").distinct()) if few else found.select("term").distinct())
        found = (F.broadcast(found.drop("df")) if few else found.drop("df")).join(known.select("term", "df"), "term")
    boosts = [
        F.struct(F.lit(s.place).alias("place"), F.lit(field).alias("field"), F.lit(s.boost * boost).alias("boost"))
        for s in specs for field, _, boost in searched_fields(index, s.options)]
    if not boosts:
        return spark.createDataFrame([], "place int, term string, field int, factor double"), []
    each = F.filter(F.array(*boosts), lambda b: b["place"] == F.col("place"))
    joined = found.select("place", "term", "weight", "df", F.inline(each).alias("__place", "field", "boost"))
    own = F.get(F.col("df"), F.col("field"))
    out = joined.where(own > 0).select("place", "term", "field", (F.col("weight") * F.col("boost") * idf(own, index.n_docs)).alias("factor"))
    return out, terms
