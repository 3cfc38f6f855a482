"""Approximate nearest neighbours by vantage-point trees, one per shard.

Shards are regions of space: a vantage-point tree over a bounded sample (about
``SAMPLE`` vectors, by a hash of their ids) routes every vector of the table to a
leaf, and a leaf that holds more than ``2 * shard_rows`` vectors is split by row
number, so that no task ever holds more.  A task builds the tree of a shard when its
vectors arrive, then answers the queries that follow in the same partition.

A query is answered twice.  First in the shard it lies in itself, which gives the
distance of the k-th nearest found there; with this bound the upper tree tells which
other shards can hold anything nearer, and it is sent to those only.  At a node the
ball around the vantage point holds the nearer half; the triangle inequality tells
which half can't hold anything nearer than the k-th found so far.  ``factor`` scales
that distance before it is compared, in the upper tree as in the shards': at 1 nothing
nearer can be missed and the search is exact, below 1 more is pruned.

Defined cases: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part; a query never finds rows of its own
id; query rows that repeat both id and vector are one query, and different vectors under
one id are a query each (told apart by ``query_key``); ties go to the smaller id; fewer
candidates than ``k`` are all returned; candidate rows that repeat an id are candidates
each; a null id takes no part; an empty table gives an empty result; further columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkdex.llm.common import materialize, ship

SHARD_ROWS, LEAF, SAMPLE = 8_192, 64, 16_384
MOST_PARTITIONS = 10_000
_NONE = np.iinfo(np.int64).max  # an id that stands for the bound a query comes with


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector as array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances (queries by points), by differences."""
    out = np.empty((len(queries), len(points)))
    for at in range(0, len(queries), 16):
        d = points[None] - queries[at : at + 16, None]
        out[at : at + 16] = np.sqrt(np.einsum("qpd,qpd->qp", d, d))
    return out


class Tree:
    """A shard's vantage-point tree; leaves hold up to LEAF points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, factor: float = 1.0):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points, self.factor = ids[order], points[order], factor
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        here = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= LEAF:
            self.nodes[here] = (rows,)
            return here
        far = distances(self.points[rows], self.points[rows[:1]])[0]
        d = distances(self.points[rows], self.points[rows[[int(far.argmax())]]])[0]
        vantage = rows[int(far.argmax())]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        bounds = d[inner].max(), d[outer].min()
        self.nodes[here] = (vantage, *bounds, self._build(rows[np.sort(inner)]), self._build(rows[np.sort(outer)]))
        return here

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, distance) of up to k nearest points of each query, none farther than its bound."""
        self.q, self.qid, self.k, self.looked = queries, query_ids, k, 0
        self.best_d = np.full((len(queries), k), np.inf)
        self.best_i = np.full((len(queries), k), _NONE)
        if bound is not None:
            self.best_d[:] = bound[:, None]
        if len(self.ids):
            self._visit(self.root, np.arange(len(queries)))
        found = np.isfinite(self.best_d) & (self.best_i != _NONE)
        return np.nonzero(found)[0], self.best_i[found], self.best_d[found]

    def _visit(self, at: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        node = self.nodes[at]
        if len(node) == 1:
            d = distances(self.points[node[0]], self.q[rows])
            self.looked += d.size
            ids = self.ids[node[0]]
            d[ids[None] == self.qid[rows, None]] = np.inf
            d = np.concatenate([self.best_d[rows], d], axis=1)
            i = np.concatenate([self.best_i[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
            order = np.lexsort((i, d), axis=1)[:, : self.k]
            self.best_d[rows], self.best_i[rows] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            return
        vantage, inner, outer, left, right = node
        d = distances(self.points[[vantage]], self.q[rows])[:, 0]
        self.looked += len(d)
        first = d - inner <= outer - d
        far = lambda: self.factor * self.best_d[rows, -1] * (1 + 1e-9)
        self._visit(left, rows[first])
        self._visit(right, rows[~first | (outer - d <= far())])
        self._visit(left, rows[~first & (d - inner <= far())])


class Regions:
    """The upper tree: every vector lies in one leaf; a ball holds distances up to its radius, the other side those above."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []  # (vantage point, radius, inner, outer), or (leaf number,)
        self.leaves = 0
        self._build(sample, max(1, len(sample) // max(1, leaves)))

    def _build(self, points: np.ndarray, most: int) -> int:
        here = len(self.nodes)
        self.nodes.append(())
        far = distances(points, points[:1])[0] if len(points) else np.zeros(1)
        if len(points) < 2 * most or not far.any():
            self.nodes[here] = (self.leaves,)
            self.leaves += 1
            return here
        vantage = points[int(far.argmax())]
        d = distances(points, vantage[None])[0]
        radius = np.sort(d)[len(d) // 2 - 1]
        inner = d <= radius
        if inner.all():
            radius = (d.min() + d.max()) / 2
            inner = d <= radius
        self.nodes[here] = (vantage, float(radius), self._build(points[inner], most), self._build(points[~inner], most))
        return here

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), dtype=np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[rows] = node[0]
            elif len(rows):
                inner = distances(node[0][None], points[rows])[:, 0] <= node[1]
                todo += [(node[2], rows[inner]), (node[3], rows[~inner])]
        return out

    def within(self, points: np.ndarray, bound: np.ndarray, factor: float) -> list[list[int]]:
        """The leaves that can hold something within ``factor * bound`` of each point."""
        out: list[list[int]] = [[] for _ in points]
        far = factor * bound * (1 + 1e-9)
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                for r in rows.tolist():
                    out[r].append(node[0])
            elif len(rows):
                d = distances(node[0][None], points[rows])[:, 0]
                todo += [(node[2], rows[d - node[1] <= far[rows]]), (node[3], rows[node[1] - d <= far[rows]])]
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width) if len(column) else np.zeros((0, width))


def _search(candidates: DataFrame, queries: DataFrame, shards: int, width: int, k: int, factor: float) -> DataFrame:
    """(query_id, query_key, id, score): the nearest of each query (shard, id, v, query_key, bound) in the shards it is sent to."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("query_key", "string"), ("bound", "double"))]
    both = candidates.select("shard", F.lit(0).alias("part"), "id", "v", *nothing).unionByName(
        queries.select("shard", F.lit(1).alias("part"), "id", "v", "query_key", "bound"))
    parts = min(shards, MOST_PARTITIONS)
    both = both.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "part", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, ids, points = None, None, [], []
        for batch in batches:
            s, part, i = (batch.column(n).to_numpy() for n in range(3))
            v = _matrix(batch.column(3), width)
            cuts = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(s)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if s[lo] != shard:
                    shard, tree, ids, points = s[lo], None, [], []
                if part[lo] == 0:
                    ids.append(i[lo:hi])
                    points.append(v[lo:hi])
                    continue
                if tree is None:
                    if not ids:
                        continue
                    tree = Tree(np.concatenate(ids), np.concatenate(points), factor)
                    ids, points = [], []
                for at in range(lo, hi, 256):
                    to = min(at + 256, hi)
                    bound = batch.column(5).slice(at, to - at).to_numpy(zero_copy_only=False)
                    row, found, d = tree.search(i[at:to], v[at:to], k, bound)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(i[at:to][row]), batch.column(4).slice(at, to - at).take(pa.array(row)), pa.array(found), pa.array(d),
                         pa.array(np.full(len(row), tree.looked / max(1, len(row))))],
                        names=["query_id", "query_key", "id", "score", "looked"])

    return both.mapInArrow(run, "query_id bigint, query_key string, id bigint, score double, looked double")


def nearest(
    df: DataFrame, k: int = 10, every: int = 100, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(query_id, rank, key, score, query_key): the k nearest found for each vector whose id ``every`` divides, among all others."""
    found = search(df, k, every, factor, key, vector, shard_rows)
    order = Window.partitionBy("query_id", "query_key").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score", "query_key")


def search(df: DataFrame, k: int, every: int, factor: float, key: str, vector: str, shard_rows: int) -> DataFrame:
    """What every shard that was asked found: (query_id, query_key, id, score, looked); ``looked`` adds up to the distances computed."""
    spark = df.sparkSession
    ship(spark)
    rows = materialize(usable(df, key, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = F.size("v")
    most = rows.groupBy(size.alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    total, width = (most.c, most.n) if most else (0, 1)
    rows = rows.where(size == width)
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, total // SAMPLE))) == 0).select("v").limit(2 * SAMPLE).collect()
    regions = Regions(np.array([r.v for r in some], dtype=np.float64).reshape(-1, width), -(-total // shard_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = regions.home(_matrix(batch.column(2), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "row", "v", "leaf"])

    rows = materialize(rows.select("id", "row", "v").mapInArrow(route, "id bigint, row bigint, v array<double>, leaf int"), "routed-vectors")
    sizes = {r.leaf: r.n for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each leaf of the sample's tree
    pieces = [-(-sizes.get(leaf, 1) // (2 * shard_rows)) for leaf in range(regions.leaves)]
    first = np.concatenate([[0], np.cumsum(pieces)]).tolist()
    shards = first[-1]
    of_leaf = spark.createDataFrame([(n, first[n], pieces[n]) for n in range(regions.leaves)], "leaf int, _first int, _pieces int")
    rows = rows.join(F.broadcast(of_leaf), "leaf").withColumn("shard", F.col("_first") + F.pmod(F.col("row"), F.col("_pieces")).cast("int"))  # at most SAMPLE rows
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).withColumn("query_key", F.substring(F.sha2(F.col("v").cast("string"), 256), 1, 32))
    asked = asked.groupBy("id", "query_key").agg(F.min(F.struct("shard", "v")).alias("r")).select("id", "query_key", "r.shard", "r.v")
    asked = materialize(asked, "queries")
    near = materialize(_search(rows, asked.withColumn("bound", F.lit(float("inf"))), shards, width, k, factor), "near")
    bounds = near.groupBy("query_id", "query_key").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("most"))
    bounds = bounds.select(F.col("query_id").alias("id"), "query_key", F.when(F.col("n") >= k, F.col("most")).alias("most"))
    again = asked.join(bounds, ["id", "query_key"], "left").select(
        "id", "query_key", "shard", "v", F.coalesce("most", F.lit(float("inf"))).alias("bound"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound, home = batch.column(4).to_numpy(), batch.column(2).to_pylist()
            leaves = regions.within(_matrix(batch.column(3), width), bound, factor)
            to = [[s for leaf in mine for s in range(first[leaf], first[leaf + 1]) if s != own] for mine, own in zip(leaves, home)]
            index = pa.array(np.repeat(np.arange(len(to)), [len(x) for x in to]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array([s for x in to for s in x], pa.int32()), batch.column(3).take(index), batch.column(4).take(index)],
                names=["id", "query_key", "shard", "v", "bound"])

    sent = again.mapInArrow(spread, "id bigint, query_key string, shard int, v array<double>, bound double")
    return near.unionByName(_search(rows, sent, shards, width, k, factor))
