"""Query suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.operators.search import ranked
from inkdex.options import CombineWith, SearchOptions
from inkdex.plans.index import SearchIndex


def auto_suggest(index: SearchIndex, query: str, options: SearchOptions | None = None, total: bool = False) -> DataFrame:
    """(suggestion, terms, score), best first: the phrases of terms by which documents match.

    Unless told otherwise all words must match, the last as a prefix.  A phrase
    scores the mean of its documents' scores, or their sum if ``total``.
    """
    defaults = SearchOptions(combine_with=CombineWith.AND, prefix=lambda term, n, terms: n == len(terms) - 1)
    own = (options or SearchOptions()).over(index.options.suggest).over(defaults)
    rows = ranked(index, query, own, match=False)
    ordered = F.array_distinct(F.transform(F.array_sort(F.transform("__hits", lambda h: F.struct(h["place"].alias("place"), h["term"].alias("term")))), lambda h: h["term"]))
    rows = rows.select(ordered.alias("terms"), "score").where(F.size("terms") > 0)
    score = F.sum("score") if total else F.avg("score")
    found = rows.groupBy("terms").agg(score.alias("score"))
    return found.select(F.array_join("terms", " ").alias("suggestion"), "terms", "score").orderBy(F.desc("score"), "suggestion")


