"""SimHash near-duplicates: fingerprints, links within a Hamming radius by BK-trees, components.

Two fingerprints within a radius of 2 agree on at least 3 of 5 bit blocks, so each distinct
fingerprint is sent to the ten shards of its block triples. Shards are sized natively before
anything meets in one task: a shard of more than SHARD fingerprints is dealt again by blocks
of the bits that are still free (those too agree on one block of three), until the free bits
bound its size. Each small shard builds a BK-tree, whose queries follow only the edges that
the radius allows, and returns a spanning set of links. Exact copies meet before all that, as
one fingerprint. Shard trees grow with the corpus, so they are built where their shard is and
not broadcast.

Defined cases: null or blank text has fingerprint zero, linked like any other; fewer words than
a shingle give one shingle of all; rows with equal ids keep their own fingerprints; a null
doc_id takes part, and a component whose ids are all null has a null component_id; an empty table
gives no rows. Other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepeak.llm.common import bound_batches, materialise

#: Seed of the shingle hash.
SEED = 42
#: Fingerprints that one BK-tree may hold before its shard is split further.
SHARD = 2048
RADIUS = 2


def fingerprint(text: str, words: int) -> int:
    """64-bit SimHash as a signed integer; a bit is set if it is in over half of the shingle hashes."""
    w = text.encode().lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w]
    hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, 1 + len(hashes) // 8192):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, words: int) -> Column:
    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t or "", words) for t in texts.to_pylist()], pa.int64())

    return simhash(text)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of the given bit places cut into parts."""
    return [sum(1 << b for b in part) for part in np.array_split(np.array(bits), parts) for part in [part.tolist()]]


def shard_masks(radius: int = RADIUS) -> list[int]:
    """Masks of all choices of three blocks out of radius + 3."""
    cut = blocks([*range(64)], radius + 3)
    return [a | b | c for i, a in enumerate(cut) for j, b in enumerate(cut[:i]) for c in cut[:j]]


class BkTree:
    """Burkhard-Keller tree of fingerprints under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Places of all stored values within the radius, by the edges that can lead there."""
        stack = [0] if self.values else []
        while stack:
            node = stack.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                yield node
            children = self.children[node]
            if len(children) <= 2 * radius:
                stack += [c for d, c in children.items() if abs(d - distance) <= radius]
            else:
                stack += [children[d] for d in range(distance - radius, distance + radius + 1) if d in children]

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while node < new:
            distance = (self.values[node] ^ value).bit_count()
            node = self.children[node].setdefault(distance, new)
        return new


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within the radius connect, at most one fewer than values."""
    tree, top, links = BkTree(), [], []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for value in values:
        near = list(tree.near(value & (2**64 - 1), radius))
        new = tree.add(value & (2**64 - 1))
        top.append(new)
        for other in near:
            if (a := root(other)) != (b := root(new)):
                top[max(a, b)] = min(a, b)
                links.append((values[other], value))
    return links


def shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within shards (key columns pos, key, fp) of bounded size."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(groups: list[list[int]]) -> pa.RecordBatch:
            links = [x for g in groups for x in spanning_links(g, radius)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        last, group, groups = None, [], []
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(3))
            for pos, key, fp in zip(*columns, strict=True):
                if (pos, key) != last:
                    groups.append(group)
                    last, group = (pos, key), []
                group.append(fp)
            if len(groups) > 1000:
                yield out(groups)
                groups = []
        yield out([*groups, group])

    dealt = shards.select("pos", "key", "fp").repartition("pos", "key").sortWithinPartitions("pos", "key", "fp")
    return dealt.mapInArrow(link, "a bigint, b bigint")


def crowded(keys: DataFrame) -> DataFrame:
    """Keys (pos, key, fp) of shards that hold more than one fingerprint, with their number n."""
    sizes = keys.groupBy("pos", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(sizes, ["pos", "key"])


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within the radius."""
    masks = shard_masks(radius)
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(signed(m)) for m in masks])).alias("pos", "key"))
    fixed, found = masks, []
    while True:
        full = materialise(crowded(keys), "simhash-shards")
        found.append(shard_links(full.where(F.col("n") <= shard), radius))
        free = [[b for b in range(64) if not m >> b & 1] for m in fixed]
        if max(map(len, free)) <= shard.bit_length() - 1 or full.where(F.col("n") > shard).isEmpty():
            break
        # over-full shards: of the free bits cut into radius + 1 blocks, one is equal in any two near fingerprints
        finer = [[m | b for b in blocks(f, radius + 1)] if len(f) > shard.bit_length() - 1 else [m] * (radius + 1) for m, f in zip(fixed, free, strict=True)]
        table = F.array(*[F.array(*[F.lit(signed(m)) for m in row]) for row in finer])
        width = radius + 1
        keys = full.where(F.col("n") > shard).select(
            "fp", "pos", F.posexplode(F.transform(F.get(table, "pos"), lambda m: F.col("fp").bitwiseAND(m))).alias("sub", "key")
        )
        # a key keeps the masked bits of its parent, and pos tells which bits those are
        keys = keys.select("fp", (F.col("pos") * width + F.col("sub")).alias("pos"), "key")
        fixed = [m for row in finer for m in row]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): alternating large and small stars, root being the smallest node.

    Each round joins links with the smallest neighbour of their ends; nothing is gathered by node.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        # large star: larger neighbours of every node go to its smallest neighbour
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: of the smaller neighbours of every node, and itself, all go to the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        edges = materialise(small, "links")
        before, now = now, state(edges)
        if now == before:
            break
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def groups(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row."""
    bound_batches(docs.sparkSession)
    rows = materialise(docs.select("doc_id", fingerprint_column(docs["text"], words).alias("fp")), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    tied = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    members = distinct.join(tied, "fp", "left")
    whole = members.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("rep").alias("lowest"))
    named = members.join(whole, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("lowest")).alias("component_id"))
    return rows.join(materialise(named, "components"), "fp")


def assign(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs without near copies: of each component, the document of its component_id stays, as it is.

    A document is known by its id: of rows that share an id, one stays. Rows without an id all stay.
    """
    kept = groups(docs, words, radius).where("component_id IS NOT NULL").select(F.col("component_id").alias("doc_id")).distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
