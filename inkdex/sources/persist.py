"""Saved indexes: Parquet or JSON tables beside a versioned manifest."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkdex.options import IndexOptions
from inkdex.plans.index import NUMBER, SearchIndex, by_term

VERSION = 1


def save(index: SearchIndex, path: str, mode: str = "error", form: str = "parquet") -> None:
    """Write an index, dead documents included; terms are range-partitioned and sorted, so a look-up reads few files. Tables of one segment are that already and are copied."""
    tables = {
        "docs": index.docs,
        "postings": index.postings if index.segments == 1 else by_term(index.postings, index.postings.count(), NUMBER),
        "dictionary": index.dictionary if index.segments == 1 else by_term(index.dictionary, index.dictionary.count()),
        "dead": index.dead if index.dead is not None else index.docs.select(NUMBER).where(F.lit(False)),
    }
    for name, df in tables.items():
        df.write.mode(mode).format(form).save(f"{path}/{name}")
    manifest = {
        "version": VERSION, "form": form, "schemas": {name: json.loads(df.schema.json()) for name, df in tables.items()}, "fields": list(index.options.fields), "id_field": index.options.id_field, "store_fields": list(index.options.store_fields),
        "averages": list(index.averages), "n_docs": index.n_docs, "next_number": index.next_number, "n_dead": index.n_dead}
    index.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")


def load(spark: SparkSession, path: str, options: IndexOptions) -> SearchIndex:
    """Read an index; ``options`` must name the fields that it was built with, and gives analyzers and search defaults."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if manifest["version"] != VERSION:
        raise ValueError(f"unsupported version {manifest['version']} of a saved index")
    if manifest["fields"] != list(options.fields) or manifest["id_field"] != options.id_field:
        raise ValueError(f"the index was built with fields {manifest['fields']} and ID field {manifest['id_field']!r}")
    options = replace(options, store_fields=tuple(manifest["store_fields"]))
    schemas = manifest["schemas"]
    read = lambda name: spark.read.schema(StructType.fromJson(schemas[name])).format(manifest["form"]).load(f"{path}/{name}")
    return SearchIndex(
        options, read("docs"), read("postings"), read("dictionary"), tuple(manifest["averages"]), manifest["n_docs"], manifest["next_number"],
        read("dead") if manifest["n_dead"] else None, manifest["n_dead"])


def to_json(index: SearchIndex, table: str = "postings") -> DataFrame:
    """A table of the index as JSON lines: ``docs``, ``postings`` or ``dictionary``."""
    df = getattr(index, table)
    return df.select(F.to_json(F.struct("*")).alias("value"))
