"""BM25+ contributions of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkdex.operators.expand import Spec, factors, within
from inkdex.options import Bm25
from inkdex.plans.index import NUMBER, SearchIndex


def saturation(tf: Column, length: Column, average: Column, p: Bm25) -> Column:
    return p.d + tf * (p.k + 1) / (tf + p.k * (1 - p.b + p.b * length / average))


def hits(index: SearchIndex, specs: list[Spec]) -> DataFrame:
    """(number, place, term, field, score): what each posting of a matched term adds for each word."""
    table, terms = factors(index, specs)
    postings = index.live_postings
    if terms is not None:
        postings, table = postings.where(within(terms)), F.broadcast(table)
    joined = postings.join(table, ["term", "field"])
    average = F.get(F.array(*[F.lit(float(a)) for a in index.averages]), F.col("field"))
    used = {s.options.bm25 for s in specs}
    score = None
    for p in used:
        own = saturation(F.col("tf").cast("double"), F.col("length").cast("double"), average, p)
        which = F.col("place").isin([s.place for s in specs if s.options.bm25 == p])
        score = own if len(used) == 1 else (F.when(which, own) if score is None else score.when(which, own))
    joined = joined.where((F.col("length") > 0) & (average > 0)).select(NUMBER, "place", "term", "field", (F.col("factor") * score).alias("score"))
    boosted = [s for s in specs if s.options.boost_document is not None]
    if boosted:
        joined = joined.join(index.docs, NUMBER)
        b = F.lit(1.0)
        for f in {s.options.boost_document for s in boosted}:
            which = F.col("place").isin([s.place for s in boosted if s.options.boost_document is f])
            b = F.when(which, f(F.col(index.options.id_field), F.col("term")).cast("double")).otherwise(b)
        joined = joined.withColumn("__boost", b).where("__boost is not null and __boost != 0").select(
            NUMBER, "place", "term", "field", (F.col("score") * F.col("__boost")).alias("score"))
    return joined
