"""Centroid clustering (integer k-means) by filtering ball trees.

Vectors are quantised to integers. Each task cuts its rows into blocks of BLOCK vectors and builds a metric
tree over each: a node is a ball that knows its centre, radius, count and integer sum. Trees are stored
once. In a round every tree is walked from its root with the k centroids: a centroid stays a candidate of a
ball only if it can be nearest to some point of it (triangle inequality, with a margin for rounding). A ball with
one candidate left goes to it as a whole, by its count and sum, and no vector of it is read; otherwise its halves are
looked at with the candidates that are left, down to leaves, where distances to them are exact. What a round
returns is one row of count and sum for each cluster and task; the k centroids are all the driver sees.

Exact: vectors and centroids whose components stay below SMALL are compared by float64 products, which hold
such integers without rounding; any others by Python's integers. A distance or inertia that does not fit a long raises.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part;
fewer vectors than k give fewer centroids, an empty table no rows; rows with equal ids are rows of their own, and among equal
hashes smaller vectors start first; rows without an id are assigned, but start no centroid while others are left; equal
distances go to the smaller number; other columns do not take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepeak.llm.common import bound_batches, materialise

WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors of a tree, and of a leaf at most.
BLOCK, LEAF = 2048, 32
#: Below it, squared distances of WIDTH components are whole numbers that float64 holds.
SMALL = 2**22
#: Share of a distance that rounding may have cost.
MARGIN = 1e-9

#: Components below it can be summed over a block by longs; balls are made of no others.
SUMMABLE = 2**51

TREE = "ids array<bigint>, vectors binary, kind string, starts array<int>, ends array<int>, left array<int>, right array<int>, radius array<double>, sums binary"
SUMS = "cluster int, n bigint, place int, total decimal(38,0)"


def quantised(vectors: DataFrame, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """vec_id and v = floor(scale * x), whole numbers as doubles, of every vector that is whole and of this width."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") == width) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # rint of a floor changes nothing, and keeps a double where floor would make a long
    v = F.transform("embedding", lambda c: F.rint(c.cast("double") * scale) - (F.rint(c.cast("double") * scale) > c.cast("double") * scale).cast("double"))
    return vectors.where(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))


@dataclass
class Tree:
    """Balls over rows [start, end) of a matrix, with their integer sums; left and right are -1 at leaves."""

    vectors: np.ndarray
    starts: list[int]
    ends: list[int]
    left: list[int]
    right: list[int]
    radius: list[float]
    sums: np.ndarray | None

    def sum_of(self, at: int) -> list[int]:
        return exact_sum(self.vectors[self.starts[at] : self.ends[at]]) if self.sums is None else self.sums[at].tolist()


def largest(numbers: np.ndarray) -> float:
    """The largest magnitude."""
    return max(abs(float(numbers.min(initial=0))), abs(float(numbers.max(initial=0))))


def compact(vectors: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them."""
    low, high = vectors.min(initial=0), vectors.max(initial=0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return vectors.astype(kind)
    return vectors


def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """The order of rows, and the tree over them in that order. A ball is halved along the line between two distant points of it.

    Rows with components from SUMMABLE on are one leaf without bounds.
    """
    order = np.arange(len(vectors))
    if largest(vectors) >= SUMMABLE:
        return order, Tree(vectors, [0], [len(vectors)], [-1], [-1], [float("inf")], None)
    x = vectors.astype(np.float64)
    tree = Tree(vectors, [], [], [], [], [], None)
    sums: list[np.ndarray] = []

    def node(start: int, end: int) -> int:
        rows = x[order[start:end]]
        sums.append(vectors[order[start:end]].astype(np.int64).sum(0))
        away = np.sqrt(((rows - sums[-1] / (end - start)) ** 2).sum(1))
        for column, value in ((tree.starts, start), (tree.ends, end), (tree.left, -1), (tree.right, -1), (tree.radius, float(away.max()) * (1 + MARGIN))):
            column.append(value)
        return len(sums) - 1

    todo = [node(0, len(x))] if len(x) else []
    while todo:
        at = todo.pop()
        start, end = tree.starts[at], tree.ends[at]
        if end - start <= leaf or tree.radius[at] == 0:
            continue
        rows = x[order[start:end]]
        one = rows[((rows - rows[0]) ** 2).sum(1).argmax()]
        other = rows[((rows - one) ** 2).sum(1).argmax()]
        # nearer to one or to the other; only rounding can leave a half empty
        nearer = (rows - (one + other) / 2) @ (other - one) < 0
        order[start:end] = np.concatenate([order[start:end][nearer], order[start:end][~nearer]])
        middle = start + int(nearer.sum())
        if start < middle < end:
            tree.left[at], tree.right[at] = node(start, middle), node(middle, end)
            todo += [tree.left[at], tree.right[at]]
    tree.vectors, tree.sums = vectors[order], np.array(sums)
    return order, tree


def distances(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances (rows by centroids): int64, or Python's integers where those could be too small."""
    most = max([abs(c) for row in centroids for c in row], default=0)
    if max(most, largest(vectors)) < SMALL:
        x, c = vectors.astype(np.float64), np.array(centroids, np.float64)
        return ((x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)).astype(np.int64)
    rows = [[int(v) for v in row] for row in vectors.tolist()]
    return np.array([[sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids] for row in rows], object)


def exact_sum(vectors: np.ndarray) -> list[int]:
    if largest(vectors) < 2**40:
        return vectors.astype(np.int64).sum(0).tolist()
    return [sum(int(v) for v in column) for column in vectors.T.tolist()]


def walk(tree: Tree, centroids: list[list[int]]) -> Iterator[tuple[int, int | np.ndarray]]:
    """(node, cluster of the whole ball, or of each row of a leaf) of nodes that cover all rows."""
    c = np.array(centroids, np.float64)
    todo = [(0, np.arange(len(c)))] if tree.starts else []
    while todo:
        at, among = todo.pop()
        start, end, radius = tree.starts[at], tree.ends[at], tree.radius[at]
        if len(among) > 1 and radius < float("inf"):
            centre = tree.sums[at] / (end - start)
            away = np.sqrt(((c[among] - centre) ** 2).sum(1))
            slack = MARGIN * (away.max() + radius + np.abs(centre).max())
            # nearest to some point of the ball: not farther from the centre than the nearest one by more than a diameter
            among = among[away <= away.min() + 2 * radius + slack]
        if len(among) == 1:
            yield at, int(among[0])
        elif tree.left[at] < 0:
            yield at, among[distances(tree.vectors[start:end], [centroids[j] for j in among]).argmin(1)]
        else:
            todo += [(tree.left[at], among), (tree.right[at], among)]


def trees(vectors: DataFrame, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Rows (vec_id, v) as trees of up to `block` vectors each, made where the rows are."""

    def grown(ids: list[int | None], rows: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(rows) if rows else np.empty((0, 0))
        order, tree = build(compact(x), leaf)
        values = {
            "ids": [ids[i] for i in order.tolist()], "vectors": tree.vectors.tobytes(), "kind": tree.vectors.dtype.str, "starts": tree.starts, "ends": tree.ends,
            "left": tree.left, "right": tree.right, "radius": tree.radius, "sums": None if tree.sums is None else tree.sums.tobytes(),
        }
        kinds = [pa.list_(pa.int64()), pa.binary(), pa.string(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.float64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values.values(), kinds, strict=True)], list(values))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        rows: list[np.ndarray] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - len(ids))
                ids += part.column(0).to_pylist()
                rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                at += part.num_rows
                if len(ids) == block:
                    yield grown(ids, rows)
                    ids, rows = [], []
        if ids:
            yield grown(ids, rows)

    return vectors.select("vec_id", "v").mapInArrow(grow, TREE)


def read_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], Tree]]:
    for batch in batches:
        for row in batch.to_pylist():
            vectors = np.frombuffer(row["vectors"], np.dtype(row["kind"])).reshape(len(row["ids"]), -1)
            sums = row["sums"] and np.frombuffer(row["sums"], np.int64).reshape(len(row["starts"]), -1)
            yield row["ids"], Tree(vectors, row["starts"], row["ends"], row["left"], row["right"], row["radius"], sums)


def cluster_sums(grown: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """For every cluster and component: n, and the exact sum of its vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(centroids)
        total = [[0] * len(row) for row in centroids]
        for _, tree in read_trees(batches):
            for at, found in walk(tree, centroids):
                start, end = tree.starts[at], tree.ends[at]
                if isinstance(found, int):
                    parts = [(found, end - start, tree.sum_of(at))]
                else:
                    parts = [(j, int((found == j).sum()), exact_sum(tree.vectors[start:end][found == j])) for j in np.unique(found).tolist()]
                for j, count, sums in parts:
                    n[j] += count
                    total[j] = [a + b for a, b in zip(total[j], sums, strict=True)]
        rows = [(j, n[j], place, t) for j in range(len(n)) if n[j] for place, t in enumerate(total[j])]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([Decimal(r[3]) for r in rows], pa.decimal128(38, 0))], ["cluster", "n", "place", "total"])

    return grown.mapInArrow(add, SUMS).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of `seed:vec_id`, as integers."""
    named = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [[int(x) for x in r.v] for r in named.orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()]


def moved(grown: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: floor(sum / n) of each component; without vectors as before."""
    out = [list(c) for c in centroids]
    for r in cluster_sums(grown, centroids).collect():  # k * width rows
        out[r.cluster][r.place] = int(r.total) // r.n
    return out


def assigned(grown: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in read_trees(batches):
            labels, far = np.empty(len(ids), np.int32), np.empty(len(ids), object)
            for at, found in walk(tree, centroids):
                labels[tree.starts[at] : tree.ends[at]] = found
            for j in np.unique(labels).tolist():
                mine = labels == j
                far[mine] = distances(tree.vectors[mine], [centroids[j]])[:, 0].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels), pa.array(far.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    return grown.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    bound_batches(spark)
    whole = quantised(vectors, scale, width)
    centroids = first_centroids(whole, k, seed)
    grown = materialise(trees(whole), "ball-trees")
    for _ in range(rounds):
        centroids = moved(grown, centroids)
    rows = materialise(assigned(grown, centroids), "ball-clusters")
    inertia = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    named = [(j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # k rows
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
