"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkdex.plans.storage import materialize, release

#: Tables of at most this many short rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: A key is heavy if it stands for more than this part of all rows, so that fewer than HEAVY keys can be.
HEAVY = 50_000
#: Rows of an Arrow batch: memory of workers, and of executors off their heaps, goes with it.
BATCH_ROWS, _BATCH = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Columns of rows that pass through an operator whole may not begin like this.
RESERVED = "__inkdex_"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


__all__ = ["BROADCAST_ROWS", "HEAVY", "heavy", "materialize", "ranked", "release", "reserved", "ship", "short_shuffles", "shuffle_partitions", "small", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, and keep what they are handed at a time small.

    Texts are handed over in batches of ``BATCH_ROWS`` rows unless the session sets another number.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_inkdex_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="inkdex-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "inkdex_pkg.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "inkdex").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(archive)
    sc._inkdex_shipped = True


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within this, a shuffle's files go when the action that wrote them is done, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table that is known to have at most ``rows`` rows, if that is few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def heavy(counts: DataFrame, n: str, total: int | None = None) -> DataFrame:
    """The rows of a materialized table of keys and counts whose count is over a HEAVY-th of the ``total`` (of all counts): a broadcast of fewer than HEAVY rows.

    Rows with heavy keys are joined where they lie; what is left for a shuffle has no
    key with a large share of the rows.
    """
    total = (counts.agg(F.sum(n)).first()[0] or 0) if total is None else total
    return F.broadcast(counts.where(F.col(n) > max(1, total // HEAVY)))


def reserved(df: DataFrame) -> None:
    """Refuse tables with column names that the operators use for their own."""
    taken = [c for c in df.columns if c.lower().startswith(RESERVED)]
    if taken:
        raise ValueError(f"column names beginning with {RESERVED} are reserved: {taken}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: str, n_groups: int, order: list[str], rank: str) -> tuple[DataFrame, DataFrame]:
    """Range-sort ``df`` by (group, order) and number the rows of each group from 0.

    A group of any size is spread over as many tasks as it needs: rows are
    numbered inside their range partition, and each partition's offset in the
    group comes from a table with at most (partitions + groups) rows.
    Returns the numbered rows and (group, count).
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    keys = [F.col(group), *[F.col(c) for c in order]]
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows, f"ranked-{rank}").withColumn("_part", F.shiftright("_at", 33))
    heads = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    heads = materialize(heads, f"heads-{rank}")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = rows.join(small(offsets, n + n_groups), rows[group].eqNullSafe(F.col("_g")) & (rows["_part"] == F.col("_p")))
    numbered = numbered.withColumn(rank, F.col("_at") + F.col("_shift")).drop("_g", "_p", "_shift", "_part", "_at")
    return numbered, heads.groupBy(group).agg(F.sum("_n").alias("count"))
