"""Search for a table of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkdex.functions import text as analysis
from inkdex.operators.expand import idf, searched_fields
from inkdex.operators.score import saturation
from inkdex.operators.search import merged
from inkdex.options import CombineWith, SearchOptions
from inkdex.plans.index import NUMBER, SearchIndex
from inkdex.plans.storage import ROWS, SMALL_ROWS, tasks


def search_batch(index: SearchIndex, queries: DataFrame, key: str, text: str, options: SearchOptions | None = None, top: int | None = None) -> DataFrame:
    """(query, id, score) for every query of a table, by equi-joins alone; words match exactly or as prefixes.

    Words are joined to the dictionary by the term, or by the beginnings of terms
    that have the length of some word; no pair of a query and a document is made
    that doesn't share a term.  Postings that some query asks for go to their document's
    task once, whatever the number of queries, and are met and summed there.  With
    ``top``, scores that are equal to eight places tie.
    """
    own = merged(index, options, False).resolved()
    if own.fuzzy or callable(own.fuzzy) or callable(own.prefix) or own.filter is not None or own.boost_document is not None or own.boost_term is not None:
        raise ValueError("a batch takes fixed prefix matching, fields, boosts, weights and BM25 parameters only")
    tokens = analysis.without_empty((own.process_term or index.options.process_term)((own.tokenize or index.options.tokenize)(F.col(text))))
    words = queries.select(F.col(key).alias("query"), F.size(tokens).alias("words"), F.posexplode(tokens).alias("place", "word"))
    words = words.groupBy("query", "word").agg(
        F.first("words").alias("words"), F.count(F.lit(1)).alias("times"), F.count_distinct("place").alias("places"), F.count_if(F.col("place") == 0).alias("head"), F.max("place").alias("last"))
    words = F.broadcast(words) if words.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else words
    terms = index.dictionary.select("term", F.col("size").cast("double").alias("size"), "df")
    if index.dead is not None:
        terms = index.live_dictionary(index.dictionary.select("term")).select("term", F.col("size").cast("double").alias("size"), "df")
    found = words.join(terms, words.word == terms.term).withColumn("weight", F.lit(1.0))
    if own.prefix:
        sizes = words.select(F.length("word").alias("n")).distinct()
        starts = terms.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("size").cast("int") - 1)))).where("n < size")
        starts = starts.join(sizes, "n", "left_semi").withColumn("start", F.substring("term", F.lit(1), F.col("n")))
        longer = words.join(starts, words.word == starts.start)
        weight = own.weights.prefix * F.col("size") / (F.col("size") + 0.3 * (F.col("size") - F.col("n")))
        found = found.unionByName(longer.withColumn("weight", weight).select(*found.columns))
    boosts = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(b).alias("boost")) for f, _, b in searched_fields(index, own)])
    df = F.get(F.col("df"), F.col("field"))
    asked = ["query", "words", "word", "times", "places", "head", "last"]
    factors = found.select(*asked, "term", "weight", "df", F.inline(boosts)).where(df > 0)
    factors = factors.select(*asked, "term", "field", df.alias("df"), (F.col("weight") * F.col("boost") * idf(df, index.n_docs)).alias("factor"))
    postings, fetched = index.live_postings, factors.limit(SMALL_ROWS + 1).toArrow()
    if fetched.num_rows <= SMALL_ROWS:
        factors = F.broadcast(index.spark.createDataFrame(fetched, factors.schema))
        n_hits = sum(fetched["df"].to_pylist())
        postings = postings.join(F.broadcast(factors.select("term", "field").distinct()), ["term", "field"], "left_semi")
        hits = postings.repartition(tasks(index.spark, n_hits, 4 * ROWS), NUMBER).join(factors, ["term", "field"])
    else:
        n_hits = factors.agg(F.sum("df")).first()[0]
        hits = postings.join(factors, ["term", "field"]).repartition(tasks(index.spark, n_hits, 4 * ROWS), NUMBER)
    average = F.get(F.array(*[F.lit(float(a)) for a in index.averages]), F.col("field"))
    score = F.col("factor") * saturation(F.col("tf").cast("double"), F.col("length").cast("double"), average, own.bm25)
    hits = hits.where((F.col("length") > 0) & (average > 0)).withColumn("score", score)
    hits = hits.select(NUMBER, "query", "words", "word", "places", "last", (F.col("times") * F.col("score")).alias("all"), (F.col("head") * F.col("score")).alias("first"))
    if own.prefix or len(searched_fields(index, own)) > 1:  # a word may be met by more than one posting of a document
        hits = hits.groupBy(NUMBER, "query", "words", "word").agg(F.sum("all").alias("all"), F.sum("first").alias("first"), F.max("last").alias("last"), F.max("places").alias("places"))
    sums = {
        CombineWith.OR: [F.sum("all").alias("all")], CombineWith.AND: [F.sum("all").alias("all"), F.sum("places").alias("places"), F.max("words").alias("words")],
        CombineWith.AND_NOT: [F.sum("first").alias("all"), F.max("last").alias("last")]}
    rows = hits.groupBy(NUMBER, "query").agg(F.count(F.lit(1)).alias("quality"), *sums[own.combine_with])
    if own.combine_with is CombineWith.AND:
        rows = rows.where("places = words")
    if own.combine_with is CombineWith.AND_NOT:
        rows = rows.where("last = 0")
    rows = rows.select("query", NUMBER, (F.col("all") * F.col("quality")).alias("score"))
    if top is not None:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 8)), NUMBER))).where(F.col("rank") <= top).drop("rank")
    return rows.join(index.docs.select(NUMBER, index.options.id_field), NUMBER).select("query", index.options.id_field, "score")


