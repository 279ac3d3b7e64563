"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Fit: a bounded sample of the vectors (FIT_ROWS, in hash order) is split by k-means into BRANCH parts again and again, on
the driver, down to leaves that stand for about LEAF_ROWS vectors of the table each, so there are more leaves in a larger
table (until a leaf has LEAF_FIT sampled vectors; from then on, leaves grow). The largest inner product is the smallest distance once a coordinate that makes all norms equal
is added to the stored vectors (zero for queries), so the tree splits these. Index: every vector goes to the leaf that
greedy descent finds, in blocks of at most about BLOCK_ROWS vectors, so a leaf that holds a third of all rows is many
blocks; a block is one row with a packed matrix. Search: a priority queue walks the tree from the nearest bin on, each
query visits the first leaves so found, and meets their blocks by a join on the leaf. The number of leaves is calibrated:
a pass of CALIBRATE sampled vectors over all blocks gives their true neighbours, whose leaves' places in each query's
walk tell the recall of any number of visits; it is raised by a quarter until TARGET is reached, in the end to all leaves,
which is exact. A task carries on only the k best of each query. A query whose leaves hold fewer than k vectors of other ids walks on until they do.

Scores are computed in double precision and in one order of addition for every pair, so equal vectors tie exactly.

Defined cases: null, empty and zero vectors, those with null or non-finite components, and those of another length than
most take no part, neither as query nor as candidate; null ids neither; a vector is no candidate for a query of its own
id; of rows with equal ids each is a candidate, and one, the largest in array order, is the query; fewer candidates than k
give them all; ties go to the smaller id; empty tables give no rows. Only id and vector columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import scratch

FIT_ROWS = 50_000
BRANCH = 8
#: Vectors of the table that a leaf stands for, and sampled ones that it has at least.
LEAF_ROWS = 1_500
LEAF_FIT = 20
BLOCK_ROWS = 2_048
QUERY_ROWS = 512
CALIBRATE = 400
TARGET = 0.95
#: Pairs of a block's exact scores that are made together, and found rows that a task gathers before it drops all but the best.
PAIRS = 1 << 16
GATHER = 1 << 19


class Tree:
    """Centres of all nodes; children of node i are at first[i] .. first[i] + count[i] - 1; a node without any is a leaf."""

    def __init__(self, sample: np.ndarray, leaf_fit: int = LEAF_FIT, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.norm = float(np.max(np.sum(sample * sample, 1))) if len(sample) else 0.0
        points = self.lifted(sample)
        centres, first, count, todo, at = [points.mean(0) if len(points) else np.zeros(self.dim + 1)], [0], [0], [(0, np.arange(len(points)))], 0
        while at < len(todo):
            node, rows = todo[at]
            at += 1
            if len(rows) <= leaf_fit:
                continue
            parts = _kmeans(points[rows], BRANCH, rng)
            groups = [rows[parts == p] for p in range(BRANCH) if (parts == p).any()]
            if len(groups) < 2:
                continue
            first[node], count[node] = len(centres), len(groups)
            for g in groups:
                todo.append((len(centres), g))
                centres.append(points[g].mean(0))
                first.append(0)
                count.append(0)
        self.centres, self.first, self.count = np.asarray(centres), np.asarray(first), np.asarray(count)
        self.leaves = int((self.count == 0).sum())

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(0.0, self.norm - np.sum(x * x, 1)))[:, None]), 1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each stored vector by greedy descent."""
        points, node = self.lifted(x), np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.count[node] > 0)
        while len(live):
            for parent in np.unique(node[live]):
                rows = live[node[live] == parent]
                a, n = self.first[parent], self.count[parent]
                d = ((points[rows][:, None, :] - self.centres[a : a + n][None]) ** 2).sum(2)
                node[rows] = a + d.argmin(1)
            live = live[self.count[node[live]] > 0]
        return node

    def walk(self, query: np.ndarray, leaves: int, rows: int, sizes: np.ndarray) -> list[int]:
        """The first leaves, and more until they hold that many rows by the nodes' sizes, best bin first: a queue holds the branches not taken by their centres' distance. The query is scaled to the stored norm, which changes no ranking."""
        scale = np.sqrt(self.norm) / max(np.sqrt(np.sum(query * query)), 1e-300)
        point = np.append(query * scale, 0.0)
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < leaves or held < rows):
            _, node = heapq.heappop(queue)
            while self.count[node]:
                a, n = self.first[node], self.count[node]
                d = ((self.centres[a : a + n] - point) ** 2).sum(1)
                best = int(d.argmin())
                for i in range(n):
                    if i != best:
                        heapq.heappush(queue, (float(d[i]), int(a + i)))
                node = int(a + best)
            found.append(node)
            held += int(sizes[node])
        return found


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        part = (np.sum(centres * centres, 1)[None] - 2 * x @ centres.T).argmin(1)
        for p in range(len(centres)):
            if (part == p).any():
                centres[p] = x[part == p].mean(0)
    return (np.sum(centres * centres, 1)[None] - 2 * x @ centres.T).argmin(1)


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, added in one fixed order."""
    return np.add.reduce(rows * query, axis=1)


def usable(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(index: DataFrame, dim: int, kind: str) -> DataFrame:
    """(leaf, ids, vectors): blocks of one leaf, packed as binary."""
    size = index.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    dealt = index.join(F.broadcast(size), "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy().astype("<i8")
        x = _matrix(t.column("v").combine_chunks(), dim).astype(kind)
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())})

    return dealt.select("leaf", "part", "id", "v").groupBy("leaf", "part").applyInArrow(pack, "leaf long, ids binary, x binary")


def _best_of_each(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    head = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(head, np.arange(len(q)), 0))
    return q[place < k], ids[place < k], scores[place < k]


def _search(queries: DataFrame, blocks: DataFrame, dim: int, k: int, kind: str, count: int) -> DataFrame:
    """queries (leaf, q, v), of count different ones, against the blocks of their leaf: (q, id, score), up to k for each query of a task."""

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        x = np.ascontiguousarray(_matrix(t.column("v").combine_chunks(), dim).astype(kind))
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "qs": pa.array([t.column("q").to_numpy().astype("<i8").tobytes()], pa.binary()), "y": pa.array([x.tobytes()], pa.binary())})

    dealt = queries.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(-(-count // QUERY_ROWS))).cast("int"))
    packed = dealt.select("leaf", "part", "q", "v").groupBy("leaf", "part").applyInArrow(gather, "leaf long, qs binary, y binary")

    def found(ids: np.ndarray, x: np.ndarray, qs: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows that may be among the k best of their query in this block, with exact scores."""
        about = y @ x.T
        about[qs[:, None] == ids[None, :]] = -np.inf
        edge = np.partition(about, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
        far = np.sqrt(np.sum(y * y, 1)) * np.sqrt(np.max(np.sum(x * x, 1)))
        with np.errstate(invalid="ignore"):
            least = edge - 1e-9 * (np.where(np.isfinite(edge), np.abs(edge), 0) + far)
        i, j = np.nonzero((about >= least[:, None]) & (about > -np.inf))
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            yield qs[a], ids[b], exact(y[a], x[b])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(z) for z in rows], ["q", "id", "score"])
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x, qs, y = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in (("ids", "<i8"), ("x", kind), ("qs", "<i8"), ("y", kind)))
                for some in found(ids, x.reshape(-1, dim).astype(np.float64), qs, y.reshape(-1, dim).astype(np.float64)):
                    held.append(some)
                    if sum(len(h[0]) for h in held) > GATHER:
                        held = [_best_of_each(*(np.concatenate(z) for z in zip(*held, strict=True)), k)]
                        if len(held[0][0]) > GATHER // 2:
                            yield out(held.pop())
        if held:
            yield out(_best_of_each(*(np.concatenate(z) for z in zip(*held, strict=True)), k))

    return blocks.join(packed, "leaf").select("ids", "x", "qs", "y").mapInArrow(meet, "q long, id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    """(q, rank, id, score) of the k best of each query: at most k rows for each leaf it visited come together."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows of vectors that is_query holds for, against all rows."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, held = ("<f4", "array<float>") if single else ("<f8", "array<double>")  # as stored; all arithmetic is in double precision
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(held).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where("id is not null and v is not null")
    sizes = raw.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return none
    dim = sizes[0]["n"]
    good = raw.where(usable(F.col("v"), dim))
    sample = good.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow().column("v")
    if not len(sample):
        return none
    total = good.count()
    tree = Tree(np.concatenate([_matrix(c, dim) for c in sample.chunks if len(c)]).astype(np.float64), max(LEAF_FIT, -(-len(sample) * LEAF_ROWS // total)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.place(_matrix(batch.column("v"), dim).astype(np.float64))), batch.column("id"), batch.column("v")], ["leaf", "id", "v"])

    index = scratch(spark, good.select("id", "v").mapInArrow(assign, f"leaf long, id long, v {held}"), "leaves")
    blocks = scratch(spark, _blocks(index, dim, kind), "blocks")

    sizes = np.zeros(len(tree.centres), np.int64)
    for r in index.groupBy("leaf").count().collect():  # a row for each leaf of the tree
        sizes[r["leaf"]] = r["count"]

    def visits(rows: DataFrame, leaves: int) -> DataFrame:
        """(leaf, q, v, place): the first leaves of each query's walk, in which own rows have the query's id."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                seen = [tree.walk(x, leaves, k + n, sizes) for x, n in zip(_matrix(batch.column("v"), dim).astype(np.float64), batch.column("own").to_pylist(), strict=True)]
                take = pa.array(np.repeat(np.arange(len(seen)), [len(s) for s in seen]))
                place = np.concatenate([np.arange(len(s)) for s in seen]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seen).astype(np.int64)), batch.column("q").take(take), batch.column("v").take(take), pa.array(place)], ["leaf", "q", "v", "place"])

        return rows.mapInArrow(run, f"leaf long, q long, v {held}, place int")

    probe = good.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(CALIBRATE).groupBy(F.col("id").alias("q")).agg(F.max("v").alias("v"), F.lit(0).cast("long").alias("own"))
    walks = scratch(spark, visits(probe, tree.leaves), "walks")
    truth = _top(_search(walks.drop("place"), blocks, dim, k, kind, CALIBRATE), k).select("q", "id")
    # at most CALIBRATE * k rows, each with one leaf
    places = index.join(F.broadcast(truth), "id").select("q", "leaf").join(walks.select("q", "leaf", "place"), ["q", "leaf"]).groupBy("place").count().collect()
    wanted, leaves = sum(r["count"] for r in places), 1
    while leaves < tree.leaves and sum(r["count"] for r in places if r["place"] < leaves) < target * wanted:
        leaves = min(tree.leaves, max(leaves + 1, leaves * 5 // 4))
    asked = good.groupBy(F.col("id").alias("q")).agg(F.max(F.when(F.col("query"), F.col("v"))).alias("v"), F.count("*").alias("own")).where("v is not null")
    asked = scratch(spark, asked, "queries")
    found = _search(visits(asked, leaves).drop("place"), blocks, dim, k, kind, max(1, asked.count()))
    return _top(found, k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
