"""Adding and taking away documents; every function returns another index."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.functions import text as analysis
from inkdex.plans.index import MOST_SEGMENTS, NUMBER, SearchIndex, _field, analyze, averages_of, averages_without, by_term, check_ids, compact, dictionary_table, log
from inkdex.plans.storage import ROWS, materialize, tasks


def add(index: SearchIndex, df: DataFrame, order_by: list[str] | None = None) -> SearchIndex:
    """Add documents; all or none. An id that is there already is an error."""
    key = index.options.id_field
    check_ids(df, index.options)
    known = df.select(key).join(index.live_docs.select(key), key, "left_semi").limit(1).collect()
    if known:
        raise ValueError(f"duplicate ID {known[0][0]}")
    docs, postings = analyze(df, index.options, index.next_number, order_by)
    n = docs.count()
    # numbers start again from the documents that are live, so that a running average goes on from them
    averages = averages_of(docs, len(index.fields), index.n_docs, index.averages)
    fresh = dictionary_table(postings, len(index.fields))
    sums = F.array(*[F.sum(F.get("df", n)).alias(f"d{n}") for n in range(len(index.fields))])
    # counts are added when terms are looked up: predicates on terms reach the scans of all segments
    both = index.dictionary.unionByName(fresh).groupBy("term", "size").agg(sums.alias("df"))
    more = replace(
        index, docs=index.docs.unionByName(docs.select(*index.docs.columns)), postings=index.postings.unionByName(postings), dictionary=both,
        averages=averages, n_docs=index.n_docs + n, next_number=index.next_number + n, segments=index.segments + 1)
    return compact(more) if more.segments > MOST_SEGMENTS else more


def _numbers(index: SearchIndex, ids: DataFrame) -> DataFrame:
    """Numbers of the documents with these ids; an id that isn't there is an error."""
    key = index.options.id_field
    ids = ids.select(F.col(ids.columns[0] if key not in ids.columns else key).alias(key)).distinct()
    lost = ids.join(index.live_docs.select(key), key, "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"cannot discard document with ID {lost[0][0]}: it is not in the index")
    return index.live_docs.join(ids, key, "left_semi").select(NUMBER)


def discard_all(index: SearchIndex, ids: DataFrame) -> SearchIndex:
    """Mark the documents with these ids (a column) as dead; postings stay until the index is vacuumed."""
    gone = materialize(_numbers(index, ids), "dead")
    n = gone.count()
    dead = gone if index.dead is None else index.dead.unionByName(gone)
    before, fields = index, len(index.fields)
    index = replace(index, dead=dead, n_docs=index.n_docs - n, n_dead=index.n_dead + n)
    if index.options.running_removal:
        averages = averages_without(before.docs.join(gone, NUMBER, "left_semi"), fields, before.n_docs, before.averages)
    else:
        averages = averages_of(index.live_docs, fields)
    index = replace(index, averages=averages)
    return vacuum(index) if index.options.auto_vacuum and is_dirty(index) else index


def discard(index: SearchIndex, key) -> SearchIndex:
    return discard_all(index, _one(index, key))


def _one(index: SearchIndex, key) -> DataFrame:
    kind = index.docs.schema[index.options.id_field].dataType
    return index.spark.range(0, 1, 1, 1).select(F.lit(key).cast(kind).alias(index.options.id_field))


def replace_documents(index: SearchIndex, df: DataFrame, order_by: list[str] | None = None) -> SearchIndex:
    """Discard the documents with the ids of ``df`` and add it; they are numbered anew, so ties order differently."""
    check_ids(df, index.options)
    return add(discard_all(index, df), df, order_by)


def remove_all(index: SearchIndex, df: DataFrame | None = None) -> SearchIndex:
    """Take documents out at once, postings included; without ``df``, all.

    Documents are found by id. Where their terms aren't those that were indexed, a
    warning is logged, and the terms that were indexed are removed.
    """
    if df is None:
        none = F.lit(False)
        return replace(
            index, docs=index.docs.where(none), postings=index.postings.where(none), dictionary=index.dictionary.where(none),
            averages=(0.0,) * len(index.fields), n_docs=0, dead=None, n_dead=0)
    check_ids(df, index.options)
    changed = _changed(index, df)
    if changed is not None:
        log.warning("version_conflict: document with ID %s has changed before removal: term %r was not present in field %r", *changed)
    gone = discard_all(replace(index, options=replace(index.options, auto_vacuum=False)), df)
    return vacuum(replace(gone, options=index.options))


def remove(index: SearchIndex, df: DataFrame) -> SearchIndex:
    return remove_all(index, df)


def changed_terms(index: SearchIndex, df: DataFrame) -> DataFrame:
    """(id, term, field) of the terms in ``df`` that aren't indexed for their documents."""
    o, key = index.options, index.options.id_field
    texts = df.select(F.col(key).alias("id"), *[_field(df, o, f).alias(f"__text{n}") for n, f in enumerate(o.fields)])
    numbers = index.live_docs.select(NUMBER, F.col(key).alias("id"))
    texts = texts.join(numbers, "id")
    each = [F.struct(F.lit(n).alias("place"), F.lit(name).alias("field"), F.array_distinct(analysis.without_empty(o.process_term(o.tokenize(F.col(f"__text{n}"))))).alias("terms")) for n, name in enumerate(o.fields)]
    terms = texts.select("id", NUMBER, F.inline(F.array(*each))).select("id", NUMBER, "place", "field", F.explode("terms").alias("term"))
    own = numbers.join(df.select(F.col(key).alias("id")), "id", "left_semi").select(NUMBER)
    there = index.among(index.postings, own, index.n_docs, True).select("term", NUMBER, F.col("field").alias("place"))
    on = ["term", NUMBER, "place"]
    apart = lambda rows: rows.repartition(tasks(index.spark, index.postings.count(), ROWS), *on)
    return apart(terms).join(apart(there), on, "left_anti").select("id", "term", "field").distinct()


def _changed(index: SearchIndex, df: DataFrame) -> tuple | None:
    lost = changed_terms(index, df).limit(1).collect()
    return tuple(lost[0]) if lost else None


def is_dirty(index: SearchIndex) -> bool:
    """Whether enough documents are dead for a vacuum: by number and by share."""
    o = index.options
    return index.n_dead >= o.min_dirt_count and index.n_dead / (1 + index.n_docs + index.n_dead) >= o.min_dirt_factor


def vacuum(index: SearchIndex) -> SearchIndex:
    """Rewrite the tables without what belongs to dead documents."""
    if index.dead is None:
        return index
    docs = materialize(index.live_docs, "docs")
    # what is left of sorted files is sorted
    live = index.live_postings if index.segments == 1 else by_term(index.live_postings, index.postings.count(), NUMBER)
    postings = materialize(live, "postings")
    dictionary = dictionary_table(postings, len(index.fields))
    return replace(index, docs=docs, postings=postings, dictionary=dictionary, dead=None, n_dead=0, segments=1)
