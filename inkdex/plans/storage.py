"""Tables that are written once and read often, and numbering of rows in a given order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many short rows may be broadcast or held by the driver.
SMALL_ROWS = 100_000
#: Rows of a table of the index, and bytes of texts, that a task sorts or counts, whatever the size of the table.
ROWS, BYTES = 1_000_000, 16 << 20
#: Tables of an index that :func:`keeping` keeps.
LASTING = {"docs", "postings", "dictionary", "dead"}
_kept: ContextVar[str | None] = ContextVar("kept", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``, else (in tests) one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(sc, "_inkdex_tables", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="inkdex-tables-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc._inkdex_tables = own
    return f"file://{own}"


@contextmanager
def keeping(folder: str | None) -> Iterator[None]:
    """Within this, the tables of an index are written to ``folder`` and stay there (None: as usual)."""
    token = _kept.set(folder)
    try:
        yield
    finally:
        _kept.reset(token)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; the table goes when the session's JVM ends."""
    kept = _kept.get() if name in LASTING else None
    path = f"{kept or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if kept is None:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._inkdex_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing yet to run reads."""
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(df._inkdex_path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def tasks(spark: SparkSession, amount: int, each: int) -> int:
    """Partitions for an amount: by it alone, so that none takes more than ``each``; a small one is spread over the cores."""
    return max(1, -(-amount // each), min(spark.sparkContext.defaultParallelism, 16 * amount // each))


def numbered(df: DataFrame, order_by: list[str], name: str, start: int = 0, size: Column | None = None, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Number the rows from ``start`` in this order, by many tasks: range-sorted, with an offset for each partition.

    ``size`` is the number of bytes of a row that isn't short; ``then`` is done to the sorted rows before they are written.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in order_by]
    amount = df.agg(F.sum(F.lit(64) + (F.lit(0) if size is None else size))).first()[0] or 0
    rows = df.repartitionByRange(tasks(spark, amount, BYTES), *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    rows = materialize(then(rows), f"numbered-{name}")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, total = [], start
    for p, size in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():  # at most a row for each task
        offsets.append((p, total))
        total += size
    table = spark.createDataFrame(offsets, "__p bigint, __o bigint")
    table = F.broadcast(table) if len(offsets) <= SMALL_ROWS else table
    out = rows.join(table, part == F.col("__p")).withColumn(name, F.col("__o") + place).drop("__at", "__p", "__o")
    out._inkdex_path = rows._inkdex_path
    return out
