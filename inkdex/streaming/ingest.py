"""Documents that arrive as a stream are indexed batch by batch; vacuums run beside searches."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from inkdex.operators import mutate
from inkdex.operators.mutate import add, replace_documents
from inkdex.options import IndexOptions
from inkdex.plans.index import SearchIndex, compact
from inkdex.plans.storage import keeping

_TABLES = ("docs", "postings", "dictionary", "dead")


class LiveIndex:
    """Holds the newest index; searches use the one that is current when they start.

    With a ``folder``, the tables of every batch are written there as a segment, and a small
    state file names the segments and the last batch: :meth:`resume` goes on from it
    after a restart.  Segments are merged when there are more than a few.
    Mutations follow one another; a vacuum runs in the background, searches going on meanwhile.
    """

    def __init__(self, index: SearchIndex, saved: Callable[[SearchIndex, int], None] | None = None, folder: str | None = None, done: int = -1):
        self.saved, self.done, self.folder = saved, done, folder
        self._auto = index.options.auto_vacuum
        self._turn, self._gate = threading.RLock(), threading.Lock()
        self._pool = ThreadPoolExecutor(max_workers=1, thread_name_prefix="inkdex-vacuum")
        self._vacuums: list[Future] = []
        self.index = replace(index, options=replace(index.options, auto_vacuum=False))
        if folder is not None and done < 0:
            with keeping(f"{folder}/start"):
                self.index = compact(self.index)
            self._note()

    @classmethod
    def resume(cls, spark: SparkSession, folder: str, options: IndexOptions, saved: Callable[[SearchIndex, int], None] | None = None) -> "LiveIndex":
        """The index as it was after the last batch whose state was written."""
        sc = spark.sparkContext
        fs_path = sc._jvm.org.apache.hadoop.fs.Path
        found = fs_path(folder).getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(fs_path(f"{folder}/state-*/_SUCCESS"))
        newest = max((str(f.getPath().getParent()) for f in found or ()), key=lambda p: int(p.rsplit("-", 1)[1]), default=None)
        if newest is None:
            raise ValueError(f"no state in {folder}")
        state = json.loads(spark.read.text(newest).first().value)
        read = lambda name: spark.read.schema(StructType.fromJson(state["schemas"][name])).parquet(*state["tables"][name])
        dictionary = read("dictionary")
        if len(state["tables"]["dictionary"]) > 1:
            sums = F.array(*[F.sum(F.get("df", F.lit(n))).alias(f"d{n}") for n in range(len(options.fields))])
            dictionary = dictionary.groupBy("term", "size").agg(sums.alias("df"))
        index = SearchIndex(
            options, read("docs"), read("postings"), dictionary, tuple(state["averages"]), state["n_docs"], state["next_number"],
            read("dead") if state["tables"]["dead"] else None, state["n_dead"], state["segments"])
        live = cls(index, saved, folder, max(state["done"], 0))
        live.done = state["done"]
        return live

    def _note(self) -> None:
        """Write the state after a batch, once its tables are there."""
        if self.folder is None:
            return
        i = self.index
        frames = {"docs": i.docs, "postings": i.postings, "dictionary": i.dictionary, "dead": i.dead}
        tables = {name: sorted({p.rsplit("/", 1)[0] for p in df.inputFiles()}) if df is not None else [] for name, df in frames.items()}
        state = {
            "done": self.done, "tables": tables, "schemas": {name: json.loads(df.schema.json()) for name, df in frames.items() if df is not None},
            "averages": list(i.averages), "n_docs": i.n_docs, "next_number": i.next_number, "n_dead": i.n_dead, "segments": i.segments}
        one = i.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1)
        one.write.mode("overwrite").text(f"{self.folder}/state-{self.done + 1}")

    def take(self, batch: DataFrame, number: int) -> None:
        """Index one batch; one that was taken before (after a restart) is passed over, and ids that are known are replaced."""
        if number <= self.done:
            return
        with self._turn, keeping(f"{self.folder}/batch-{number}" if self.folder else None):
            key = self.index.options.id_field
            given = batch = batch.persist()
            try:
                if given.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect():  # else texts need no shuffle
                    batch = given.dropDuplicates([key]).persist()
                if not batch.isEmpty():
                    old = batch.join(self.index.live_docs.select(key), key, "left_semi")
                    if old.isEmpty():
                        self.index = add(self.index, batch)
                    else:
                        fresh = batch.join(self.index.live_docs.select(key), key, "left_anti").persist()
                        changed = replace_documents(self.index, old)
                        self.index = changed if fresh.isEmpty() else add(changed, fresh)
                        fresh.unpersist()
            finally:
                batch.unpersist()
                given.unpersist()
            self.done = number
            self._note()
        if self.saved is not None:
            self.saved(self.index, number)
        self._clean()

    def add_chunks(self, df: DataFrame, chunks: int) -> None:
        """Add a table in so many parts, each searchable when it is in."""
        key = self.index.options.id_field
        for n in range(chunks):
            self.take(df.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == n), self.done + 1)

    def discard(self, ids: DataFrame) -> None:
        with self._turn, keeping(f"{self.folder}/discard-{self.index.next_number}-{self.index.n_dead}" if self.folder else None):
            self.index = mutate.discard_all(self.index, ids)
            self._note()
        self._clean()

    def _clean(self) -> None:
        if self._auto and mutate.is_dirty(self.index):
            self.vacuum(if_dirty=True)

    @property
    def is_vacuuming(self) -> bool:
        with self._gate:
            return any(not f.done() for f in self._vacuums)

    def vacuum(self, if_dirty: bool = False) -> Future:
        """Vacuum in the background; while one runs, at most one more waits, and it is given to all who ask.

        With ``if_dirty`` nothing is done if too few documents are dead when its turn comes.
        """
        with self._gate:
            self._vacuums = [f for f in self._vacuums if not f.done()]
            if len(self._vacuums) > 1:
                return self._vacuums[1]
            job = self._pool.submit(self._vacuum, if_dirty)
            self._vacuums.append(job)
            return job

    def _vacuum(self, if_dirty: bool) -> None:
        with self._turn:
            if if_dirty and not mutate.is_dirty(self.index):
                return
            with keeping(f"{self.folder}/vacuum-{self.index.next_number}-{self.done + 1}-{self.index.n_dead}" if self.folder else None):
                self.index = mutate.vacuum(self.index)
                self._note()


def ingest(stream: DataFrame, live: LiveIndex, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start indexing a stream of documents."""
    writer = stream.writeStream.foreachBatch(live.take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
