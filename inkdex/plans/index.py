"""The inverted index as tables: documents, postings and a dictionary."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkdex.functions import text as analysis
from inkdex.options import IndexOptions
from inkdex.plans.storage import ROWS, materialize, numbered, release, tasks

LONGEST = 65_535  # a field's length as scoring sees it; averages take the true one
BLOCK = 65_536  # documents, then blocks, whose part of a running average is folded at a time
MOST_SEGMENTS = 8
MOST_WORDS = 1_000_000  # of 64 documents each
log = logging.getLogger("inkdex")

NUMBER = "__doc"


@dataclass(frozen=True)
class SearchIndex:
    """Immutable: a mutation gives another index that shares the tables it leaves alone.

    ``docs`` has a row for each document (number, id, stored fields, true length of each
    field, null where it is missing), ``postings`` one for each term in a field
    of a document, ``dictionary`` one for each term with the number of documents
    per field; terms are range-partitioned in both.  Added documents are a segment more of
    each table, and segments are merged from time to time.  ``dead`` numbers documents that were discarded but not yet
    vacuumed; postings and dictionary may still hold them.
    """

    options: IndexOptions
    docs: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    averages: tuple[float, ...]
    n_docs: int
    next_number: int
    dead: DataFrame | None = None
    n_dead: int = 0
    segments: int = 1

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @property
    def fields(self) -> tuple[str, ...]:
        return self.options.fields

    def length(self, n: int) -> str:
        return f"__length{n}"

    def among(self, df: DataFrame, numbers: DataFrame, count: int, inside: bool) -> DataFrame:
        """The rows of ``df`` whose documents are among these numbers, of which there are at most ``count``, or aren't.

        Numbers are broadcast as a bit each, 64 to a row, so that postings aren't shuffled; beyond
        ``MOST_WORDS`` such rows they are joined by a shuffle that is parted by the rows.
        """
        if min(count, self.next_number // 64 + 1) > MOST_WORDS:
            return df.repartition(tasks(self.spark, df.count(), ROWS), NUMBER).join(numbers, NUMBER, "left_semi" if inside else "left_anti").select(*df.columns)
        bit = f"shiftleft(1L, CAST({NUMBER} & 63 AS INT))"
        words = numbers.groupBy(F.shiftright(NUMBER, 6).alias("__word")).agg(F.expr(f"bit_or({bit})").alias("__bits"))
        joined = df.join(F.broadcast(words), F.shiftright(NUMBER, 6) == F.col("__word"), "left")
        return joined.where(F.expr(f"(coalesce(__bits & {bit}, 0) != 0) = {inside}")).select(*df.columns)

    @cached_property
    def live_docs(self) -> DataFrame:
        return self.docs if self.dead is None else self.among(self.docs, self.dead, self.n_dead, False)

    @cached_property
    def live_postings(self) -> DataFrame:
        return self.postings if self.dead is None else self.among(self.postings, self.dead, self.n_dead, False)

    def live_dictionary(self, terms: DataFrame) -> DataFrame:
        """The dictionary's rows for these terms, counting live documents only."""
        if self.dead is None:
            return self.dictionary.join(terms, "term", "left_semi")
        return dictionary_of(self.live_postings.join(terms, "term", "left_semi"), len(self.fields))

    def document_count(self) -> int:
        return self.n_docs

    def term_count(self) -> int:
        """Terms of the dictionary, those included whose documents were all discarded and not yet vacuumed."""
        return self.dictionary.count()

    def has(self, key) -> bool:
        return self.live_docs.where(F.col(self.options.id_field) == F.lit(key)).limit(1).count() > 0

    def stored_fields(self, key) -> dict | None:
        """Stored fields of a document, or None if it isn't in the index."""
        row = self.live_docs.where(F.col(self.options.id_field) == F.lit(key)).select(*self.options.store_fields, F.lit(1).alias("__one")).first()
        return None if row is None else {k: v for k, v in row.asDict(recursive=True).items() if k != "__one" and v is not None}


def dictionary_of(postings: DataFrame, n_fields: int) -> DataFrame:
    """(term, size, df of each field)."""
    counts = [F.count_if(F.col("field") == n).alias(f"df{n}") for n in range(n_fields)]
    found = postings.groupBy("term").agg(*counts)
    return found.select("term", F.length("term").alias("size"), F.array(*[F.col(f"df{n}") for n in range(n_fields)]).alias("df"))


def _field(df: DataFrame, options: IndexOptions, name: str) -> Column:
    """A field's text; null where the document lacks it."""
    if name in options.extract:
        c = options.extract[name]
    elif name in df.columns:
        c = F.col(f"`{name}`")
    else:
        c = F.lit(None).cast("string")
    c = analysis.stringify(c, df.select(c.alias("x")).schema["x"].dataType)
    return F.coalesce(c, F.lit("")) if options.null_as_empty else c


def check_ids(df: DataFrame, options: IndexOptions) -> None:
    key = options.id_field
    if key not in df.columns:
        raise ValueError(f'document does not have ID field "{key}"')
    bad = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or k is null").limit(1).collect()
    if bad and bad[0].k is None:
        raise ValueError(f'document does not have ID field "{key}"')
    if bad:
        raise ValueError(f"duplicate ID {bad[0].k}")


def analyze(df: DataFrame, options: IndexOptions, start: int, order_by: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(documents with numbers, stored fields and lengths; postings) of a table of documents."""
    clash = {NUMBER, *(f"__length{n}" for n in range(len(options.fields)))} & set(df.columns)
    if clash:
        raise ValueError(f"reserved column names: {', '.join(sorted(clash))}")
    keep = list(dict.fromkeys([options.id_field, *options.store_fields, *(order_by or [])]))
    fields = range(len(options.fields))
    texts = [_field(df, options, name).alias(f"__text{n}") for n, name in enumerate(options.fields)]
    stored = [options.id_field, *[c for c in options.store_fields if c != options.id_field]]

    def analyzed(rows: DataFrame) -> DataFrame:
        """Each step is used more than once by the next, so texts are tokenized once; terms are counted in their document, before any shuffle."""
        rows = rows.select("__at", *stored, *[options.tokenize(F.col(f"__text{n}")).alias(f"__tokens{n}") for n in fields])
        none = F.array().cast("array<string>")
        terms = [F.sort_array(F.coalesce(analysis.without_empty(options.process_term(F.col(f"__tokens{n}"))), none)).alias(f"__terms{n}") for n in fields]
        rows = rows.select("__at", *stored, *[analysis.field_length(F.col(f"__tokens{n}")).alias(f"__length{n}") for n in fields], *terms)
        rows = rows.select("*", *[analysis.runs(F.col(f"__terms{n}")).alias(f"__found{n}") for n in fields]).drop(*[f"__terms{n}" for n in fields])
        return rows.withColumn("__n", sum(F.size(f"__found{n}") for n in fields))

    size = sum(F.coalesce(F.octet_length(f"__text{n}"), F.lit(0)) for n in fields)
    rows = numbered(df.select(*keep, *texts), order_by or [options.id_field], NUMBER, start, size, analyzed)
    docs = materialize(rows.select(NUMBER, *stored, *[f"__length{n}" for n in fields]), "docs")
    # each field's own scan: lists aren't copied into rows of (field, list) first
    of = [rows.select(NUMBER, F.lit(n).alias("field"), F.least(F.col(f"__length{n}"), F.lit(LONGEST)).alias("length"), F.inline(f"__found{n}")) for n in fields]
    found = reduce(DataFrame.unionByName, of).select("term", "field", NUMBER, "tf", "length")
    postings = materialize(by_term(found, rows.agg(F.sum("__n")).first()[0] or 0, NUMBER), "postings")  # a frequent term spreads over many files
    release(rows)
    return docs, postings


def by_term(df: DataFrame, rows: int, *more: str) -> DataFrame:
    """At most so many rows, range-partitioned and sorted by term, so that a look-up of terms reads few files and row groups."""
    return df.repartitionByRange(tasks(df.sparkSession, rows, ROWS), "term", *more).sortWithinPartitions("term", *more)


def dictionary_table(postings: DataFrame, n_fields: int) -> DataFrame:
    """The dictionary of written postings; the ranges that it is sorted by cluster what is counted, so there is one shuffle."""
    ranges = postings.select("term", "field").repartitionByRange(tasks(postings.sparkSession, postings.count(), 2 * ROWS), "term")
    return materialize(dictionary_of(ranges, n_fields).sortWithinPartitions("term"), "dictionary")


def compact(index: SearchIndex) -> SearchIndex:
    """Write the tables of an index that documents were added to as one segment."""
    return replace(
        index, docs=materialize(index.docs, "docs"), postings=materialize(by_term(index.postings, index.postings.count(), NUMBER), "postings"),
        dictionary=materialize(by_term(index.dictionary, index.dictionary.count()), "dictionary"), segments=1)


def averages_of(docs: DataFrame, n_fields: int, start: int = 0, before: tuple[float, ...] | None = None) -> tuple[float, ...]:
    """Average field lengths, continued from those of ``start`` documents.

    A document's length moves the average by its place among all documents, so a
    document without the field makes the result depend on the order; if all
    have it, the result is the mean.
    """
    before = before or (0.0,) * n_fields
    row = docs.agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"__length{n}").alias(f"s{n}") for n in range(n_fields)],
        *[F.count(f"__length{n}").alias(f"c{n}") for n in range(n_fields)], F.min(NUMBER).alias("lo"), F.max(NUMBER).alias("hi")).first()
    if not row.n:
        return before
    out = []
    for n in range(n_fields):
        if row[f"c{n}"] == row.n:
            out.append((before[n] * start + row[f"s{n}"]) / (start + row.n))
        elif not row[f"c{n}"]:
            out.append(before[n])
        else:
            out.append(_folded(docs, n, start, before[n], row.lo, row.hi - row.lo + 1 == row.n))
    return tuple(out)


def _folded(docs: DataFrame, n: int, start: int, average: float, low: int, dense: bool, sign: int = 1) -> float:
    """The running average, folded in blocks of documents, then in blocks of those, until few are left."""
    rows = docs.select(NUMBER, F.col(f"__length{n}").alias("x"))
    if not dense:
        rows, low = numbered(rows.withColumnRenamed(NUMBER, "old"), ["old"], NUMBER), 0
    place = F.col(NUMBER) - low
    at = (F.lit(start) + sign * place).cast("double")
    parts = rows.where("x is not null").select(F.floor(place / BLOCK).alias("b"), place.alias("o"), *_moved(at, F.col("x").cast("double"), sign))
    state = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("a"))  # average -> m * average + a; such maps are composed in a tree
    step = lambda s, r: F.struct((s["m"] * r["m"]).alias("m"), (s["a"] * r["m"] + r["a"]).alias("a"))
    while True:
        folded = parts.groupBy("b").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("o", "m", "a"))), state, step).alias("f"))
        parts = materialize(folded.select(F.floor(F.col("b") / BLOCK).alias("b"), F.col("b").alias("o"), "f.m", "f.a"), "average")
        if parts.count() <= BLOCK:
            break
    for f in sorted(parts.collect(), key=lambda f: f.o):  # at most BLOCK rows
        average = f.m * average + f.a
    return average


def _moved(at: Column, x: Column, sign: int) -> list[Column]:
    """How a document's length moves an average of ``at`` documents, when it joins or, with sign -1, leaves them: factor and summand."""
    rest = at + sign
    return [F.when(rest > 0, at / F.greatest(rest, F.lit(1.0))).otherwise(0.0).alias("m"), F.when(rest > 0, sign * x / F.greatest(rest, F.lit(1.0))).otherwise(0.0).alias("a")]


def averages_without(gone: DataFrame, n_fields: int, count: int, before: tuple[float, ...]) -> tuple[float, ...]:
    """Running averages after the documents ``gone`` (of ``count``) are taken out one by one, in the order of their numbers.

    A document's length is taken out by the number of all documents at the time, and one that
    lacks the field leaves the average as it is, so what is left isn't the average
    of an index built without them where fields are missing.
    """
    return tuple(_folded(gone, n, count, before[n], 0, False, -1) for n in range(n_fields))


def build(df: DataFrame, options: IndexOptions, order_by: list[str] | None = None) -> SearchIndex:
    """Index a table of documents; numbers, and so the order of ties, follow ``order_by`` (the id if unset)."""
    check_ids(df, options)
    docs, postings = analyze(df, options, 0, order_by)
    n = docs.count()
    return SearchIndex(
        options, docs, postings, dictionary_table(postings, len(options.fields)), averages_of(docs, len(options.fields)), n, n)


def empty(spark: SparkSession, options: IndexOptions, schema: "str | StructType") -> SearchIndex:
    """An index without documents, for documents of this schema."""
    return build(spark.createDataFrame([], schema), options)


def with_stats(index: SearchIndex, **changes) -> SearchIndex:
    return replace(index, **changes)
