"""A map from strings to values with look-ups by prefix and by edit distance, held as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TermMap:
    """Immutable map (key, value); ``prefix`` is that of a view made by :meth:`at_prefix`."""

    entries: DataFrame
    prefix: str = ""

    @classmethod
    def empty(cls, spark: SparkSession, value_type: str = "bigint") -> "TermMap":
        return cls(spark.createDataFrame([], f"key string, value {value_type}"))

    @classmethod
    def of(cls, df: DataFrame, key: str, value: str) -> "TermMap":
        """From a table; of rows that share a key one stays, that with the greatest value."""
        if not isinstance(df.schema[key].dataType, T.StringType):
            raise TypeError("key must be a string")
        return cls(df.groupBy(F.col(key).alias("key")).agg(F.max(value).alias("value")))

    @classmethod
    def from_object(cls, spark: SparkSession, values: dict[str, Any], value_type: str = "bigint") -> "TermMap":
        if not all(isinstance(k, str) for k in values):
            raise TypeError("key must be a string")
        return cls(spark.createDataFrame(list(values.items()), f"key string, value {value_type}"))

    def _check(self, key: str) -> None:
        if not isinstance(key, str):
            raise TypeError("key must be a string")

    def _rest(self, key: str) -> DataFrame:
        self._check(key)
        return self.entries.where(F.col("key") != key)

    def set(self, key: str, value: Any) -> "TermMap":
        kind = self.entries.schema["value"].dataType
        one = self.entries.sparkSession.range(0, 1, 1, 1).select(F.lit(key).alias("key"), F.lit(value).cast(kind).alias("value"))
        return TermMap(self._rest(key).unionByName(one), self.prefix)

    def set_all(self, other: DataFrame) -> "TermMap":
        """Put many entries (key, value) in, over those that are there."""
        return TermMap(self.entries.join(other, "key", "left_anti").unionByName(other), self.prefix)

    def update(self, key: str, change: Callable[[Column], Column]) -> "TermMap":
        """Change the value of a key; it is null before if the key is new."""
        self._check(key)
        kind = self.entries.schema["value"].dataType
        now = self.entries.where(F.col("key") == key).agg(F.first("value").alias("value"))
        return TermMap(self._rest(key).unionByName(now.select(F.lit(key).alias("key"), change(F.col("value")).cast(kind).alias("value"))), self.prefix)

    def fetch(self, key: str, initial: Any) -> "TermMap":
        """Put a key in with an initial value unless it is there."""
        return self if self.has(key) else self.set(key, initial)

    def delete(self, key: str) -> "TermMap":
        return TermMap(self._rest(key), self.prefix)

    def clear(self) -> "TermMap":
        return TermMap(self.entries.where(F.lit(False)), self.prefix)

    def get(self, key: str) -> Any:
        self._check(key)
        row = self.entries.where(F.col("key") == key).first()
        return None if row is None else row.value

    def has(self, key: str) -> bool:
        self._check(key)
        return self.entries.where(F.col("key") == key).limit(1).count() > 0

    def size(self) -> int:
        return self.entries.count()

    def is_empty(self) -> bool:
        return self.entries.isEmpty()

    def keys(self) -> DataFrame:
        return self.entries.select("key")

    def values(self) -> DataFrame:
        return self.entries.select("value")

    def sorted_entries(self) -> DataFrame:
        return self.entries.orderBy("key")

    def for_each(self, function: Callable[[str, Any], None]) -> None:
        """Call a function of key and value for each entry, in order of keys; entries come to the driver one part at a time."""
        for row in self.sorted_entries().toLocalIterator():
            function(row.key, row.value)

    def at_prefix(self, prefix: str) -> "TermMap":
        """View of the entries whose keys begin so."""
        if not prefix.startswith(self.prefix):
            raise ValueError("mismatched prefix")
        return TermMap(self.entries.where(F.col("key").startswith(prefix)), prefix)

    def prefix_entries(self, prefix: str) -> DataFrame:
        return self.entries.where(F.col("key").startswith(prefix))

    def fuzzy_get(self, key: str, most: int) -> DataFrame:
        """(key, value, distance) of the keys within so many edits, the key itself included."""
        near = self.entries.where(F.abs(F.length("key") - len(key)) <= most)
        return near.withColumn("distance", F.levenshtein(F.col("key"), F.lit(key), most)).where("distance >= 0")
