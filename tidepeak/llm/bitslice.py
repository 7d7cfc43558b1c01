"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised attributes (integers). A block of rows keeps each attribute's coarse
value a, with v = STEP * a + rest, as bitmaps, one for each bit ("slice"), with a row in each bit.
For a query the scores of all rows of a block are added up as bitmaps by carry-save adders:
a query weight is a sum of signed powers of two, and each power adds the attribute's slices,
shifted. From the most significant slice of the sum downward the k best rows are selected. The
rest of a score is bounded by the norms of query and rests (Cauchy-Schwarz), so every row that can
still be among the k best is known; those rows are resolved by the exact integer product.

Rows and queries are cut into blocks of bounded size, and each pair of blocks is one group; the k
best of a query in each block meet in a window over k rows a block. A row is copied once for QUERIES queries.

Vectors with a squared length of LARGEST or more are wide: their products may not fit 64 bits on the way, so they
stay out of the slices and are multiplied as Python's integers. A score among the k best that does not fit a long raises.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; vectors
of different lengths are compared as if padded by zeros; ties go to smaller ids; fewer candidates than k
give all. Rows that share an id are rows of their own: each is asked if its id is one to be asked, and
each is a candidate of all rows but itself. Empty tables give no rows; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepeak.llm.common import materialise

STEP = 4
#: Inner products of vectors below this squared length are below it, too.
LARGEST = 2.0**62
#: Rows and queries of a block.
ROWS, QUERIES = 32_768, 65_536


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v = floor(scale * x) as whole doubles, and wide, of every vector that is whole."""
    scaled = lambda c: c.cast("double") * scale
    v = F.transform("embedding", lambda c: F.rint(scaled(c)) - (F.rint(scaled(c)) > scaled(c)).cast("double"))
    whole = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    return whole.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).withColumn("wide", ~(squares < LARGEST))


def powers(weight: int) -> list[tuple[int, int]]:
    """A weight as few signed powers of two: (exponent, sign), non-adjacent form."""
    out, e = [], 0
    while weight:
        if weight & 1:
            sign = 2 - (weight & 3)
            out.append((e, sign))
            weight -= sign
        weight >>= 1
        e += 1
    return out


class SlicedBlock:
    """Bitmaps of one block of integer row vectors (n by d)."""

    def __init__(self, vectors: np.ndarray) -> None:
        n, d = vectors.shape
        self.vectors = vectors
        coarse = vectors // STEP
        # STEP * coarse + centre is nearest to the value on average
        self.centre = (STEP - 1) / 2
        self.rest = float(np.sqrt(((vectors - STEP * coarse - self.centre) ** 2).sum(1)).max(initial=0.0))
        self.low = coarse.min(0, initial=0)  # attributes start from their least value, so that bitmaps hold no signs
        shifted = (coarse - self.low).astype(np.int64)
        bits = int(shifted.max(initial=0)).bit_length()
        words = -(-n // 64)
        self.slices = np.zeros((d, bits, words), np.uint64)
        for b in range(bits):
            packed = np.packbits((shifted >> b & 1).astype(np.uint8), axis=0, bitorder="little")
            full = np.zeros((words * 8, d), np.uint8)
            full[: packed.shape[0]] = packed
            self.slices[:, b] = np.ascontiguousarray(full.T).view(np.uint64)
        self.used = [[b for b in range(bits) if self.slices[j, b].any()] for j in range(d)]
        valid = np.zeros(words * 8, np.uint8)
        valid[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
        self.valid = valid.view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the coarse scores of all rows, least significant first, and what to add to them.

        A negative power adds the complement of a slice (within the slice's weight), with a constant.
        """
        columns: dict[int, list[np.ndarray]] = {}
        offset = int((query * self.low).sum())
        for j in np.flatnonzero(query).tolist():
            for e, sign in powers(int(query[j])):
                for b in self.used[j]:
                    bitmap = self.slices[j, b]
                    columns.setdefault(e + b, []).append(bitmap if sign > 0 else ~bitmap)
                    offset -= (1 << (e + b)) if sign < 0 else 0
        out, at, zero = [], 0, np.zeros_like(self.valid)
        while at <= max(columns, default=-1):
            column = columns.pop(at, [])
            carry = columns.setdefault(at + 1, []) if len(column) > 1 else None
            while len(column) > 2:  # full adders: three bitmaps become a sum and a carry
                n = len(column) // 3
                a, b, c = (np.stack(column[i * n : (i + 1) * n]) for i in range(3))
                half = a ^ b
                carry.extend((a & b) | (half & c))
                column = [*(half ^ c), *column[3 * n :]]
            if len(column) == 2:
                carry.append(column[0] & column[1])
                column = [column[0] ^ column[1]]
            out.append(column[0] if column else zero)
            at += 1
        return out, offset

    def bound(self, sums: list[np.ndarray], k: int, among: np.ndarray) -> int | None:
        """The k-th largest sum among rows, found from the most significant slice downward; None if fewer rows."""
        if int(np.bitwise_count(among).sum()) < k:
            return None
        value, left = 0, k
        for b in range(len(sums) - 1, -1, -1):
            ones = among & sums[b]
            n = int(np.bitwise_count(ones).sum())
            if n >= left:
                among, value = ones, value | 1 << b
            else:
                left -= n
                among = among & ~sums[b]
        return value

    def at_least(self, sums: list[np.ndarray], value: int) -> np.ndarray:
        """Bitmap of rows whose sum is not below value."""
        if value <= 0:
            return self.valid
        if value >> len(sums):
            return np.zeros_like(self.valid)
        above, equal = np.zeros_like(self.valid), self.valid
        for b in range(len(sums) - 1, -1, -1):
            if value >> b & 1:
                equal = equal & sums[b]
            else:
                above = above | (equal & sums[b])
                equal = equal & ~sums[b]
        return above | equal

    def top(self, query: np.ndarray, k: int, but: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of all rows that may be among the k best, without those in the bitmap `but`."""
        sums, _ = self.sums(query)
        among = self.valid & ~but
        kth = self.bound(sums, k, among)
        if kth is not None:
            # score = STEP * sum + constant + error, where |error| is at most norm(query) * rest
            error = float(np.sqrt((query.astype(float) ** 2).sum())) * self.rest
            among = among & self.at_least(sums, kth - int(np.ceil(2 * error / STEP)) - 1)
        places = np.flatnonzero(np.unpackbits(among.view(np.uint8), bitorder="little"))
        return places, self.vectors[places] @ query


def as_matrix(lists: list[list[float]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def exact_product(a: list[float], b: list[float]) -> int:
    return sum(int(x) * int(y) for x, y in zip(a, b, strict=False))


class Block:
    """Rows (id, number, vector, wide) of a block: sliced ones, and wide ones apart."""

    def __init__(self, ids: list[int], rows: list[int], vectors: list[list[float]], wide: list[bool], width: int) -> None:
        order = sorted(range(len(ids)), key=lambda i: wide[i])
        self.ids, self.rows = np.array([ids[i] for i in order], np.int64), np.array([rows[i] for i in order], np.int64)
        self.vectors, self.narrow = [vectors[i] for i in order], len(ids) - sum(wide)
        self.sliced = SlicedBlock(as_matrix(self.vectors[: self.narrow], width))

    def best(self, row: int, query: list[float], wide: bool, k: int, width: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows other than `row`."""
        exact = range(len(self.ids)) if wide else range(self.narrow, len(self.ids))
        found = [(-exact_product(query, self.vectors[i]), int(self.ids[i])) for i in exact if self.rows[i] != row]
        if not wide:
            own = np.zeros(len(self.sliced.valid) * 8, np.uint8)
            packed = np.packbits(self.rows[: self.narrow] == row, bitorder="little")
            own[: len(packed)] = packed
            places, scores = self.sliced.top(as_matrix([query], width)[0], k, own.view(np.uint64))
            some = np.lexsort((self.ids[places], -scores))[:k]
            found += [(-int(scores[i]), int(self.ids[places[i]])) for i in some]
        return [(vec_id, -score) for score, vec_id in sorted(found)[:k]]


def search(vectors: DataFrame, k: int = 5, every: int = 50, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    base = materialise(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "quantised")
    n = base.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    # more row blocks than their size asks for, so that all executors take part
    row_blocks = max(-(-n[0] // rows), min(spark.sparkContext.defaultParallelism, -(-n[0] // 1024)), 1)
    query_blocks = max(-(-n[1] // queries), 1)
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    left = base.withColumn("rb", dealt(row_blocks)).withColumn("qb", spread(query_blocks))
    right = base.where(F.col("vec_id") % every == 0).withColumn("qb", dealt(query_blocks)).withColumn("rb", spread(row_blocks))

    def answer(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if block.num_rows and asked.num_rows:
            each = lambda t: [t.column(c).to_pylist() for c in ("vec_id", "row", "v", "wide")]
            rows, queries = each(block), each(asked)
            width = max(map(len, [*rows[2], *queries[2]]), default=0)
            held = Block(*rows, width)
            for query_id, row, query, wide in zip(*queries, strict=True):
                out += [(row, query_id, vec_id, score) for vec_id, score in held.best(row, query, wide, k, width)]
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["row", "query_id", "vec_id", "score"])

    near = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(answer, "row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
