"""Divergence of sources: how far the word use of each source of a language is from that of every other.

A group is a (lang, source); its smoothed share of a term is p = 1 + floor(UNIT * (count + SMOOTH) /
(N + SMOOTH * V)), and two groups differ by the sum over all V kept terms of floor((p - q)^2 / (p + q)).
No term is visited for a pair unless both groups have it. By inclusion and exclusion over the supports
the sum is

    V * f(0, 0)                                     constants: as if both lacked every term
  + sum over counts c of a: terms(c) * (f(c, 0) - f(0, 0))      histogram of a, priced against b's zero
  + sum over counts c of b: terms(c) * (f(0, c) - f(0, 0))      histogram of b, priced against a's zero
  + sum over terms of both: f(a, b) - f(a, 0) - f(0, b) + f(0, 0)   postings joined by term

Terms are counted in batches before anything is shuffled, so a source with a third of all rows or a very
common word is a row a task; pairs of groups are made in salted parts of their language.

Everything is exact: shares by decimals, all else by longs, and a sum that does not fit one raises.
Defined cases: null text, lang and source are ''; a group without terms takes part with counts of
zero; a language without kept terms has values of zero for its pairs and no terms; a language of one source has no
pairs; repeated rows and ids count one by one, as documents are rows; texts of any length are read whole,
in pieces; an empty table gives no rows; other columns do not take part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepeak.llm.common import LOWER, UPPER, bound_batches, materialise

#: A language keeps the terms that so many of its documents have.
LEAST_DOCUMENTS = 10
UNIT, SMOOTH = 1_000_000_000, 2
#: Terms listed of each group.
TERMS = 10
#: Parts that the groups of a language are dealt to when they are paired.
SALTS = 8
#: Distinct terms, and bytes of them, that a task counts before it hands its counts on.
HELD_TERMS, HELD_BYTES = 200_000, 16 << 20
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20

#: Every byte of a term as itself, in lower case; all others as a space. Bytes from 0x80 are those of non-ASCII characters.
TERM_BYTES = bytes(b if chr(b) in LOWER or b >= 0x80 else ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else 0x20 for b in range(256))

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of a piece of it each."""
    flat = text.translate(TERM_BYTES)
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), counted within batches; each group also has a row without a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, source, term, number, having[term]) for (lang, source), (total, having) in held.items() for term, number in total.items()]
            rows += [(lang, source, None, 0, 0) for lang, source in held]
            held.clear()
            names, kinds = ["lang", "source", "term", "n", "docs"], [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            columns[2] = columns[2].cast(pa.string())
            return pa.RecordBatch.from_arrays(columns, names)

        terms = size = 0
        for batch in batches:
            for text, lang, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total, having = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                before = len(total)
                for words in terms_of(text):
                    total.update(words)
                    seen.update(words)
                having.update(seen)
                if len(total) > before:
                    terms += len(total) - before
                    size += sum(map(len, seen))
                if terms > HELD_TERMS or size > HELD_BYTES:
                    yield out()
                    terms = size = 0
        yield out()

    columns = [F.coalesce("text", F.lit("")).cast("binary"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))]
    return docs.select(*columns).mapInArrow(count, COUNTS)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = wide(count + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)")
    below = wide(total + SMOOTH * kept)
    return F.call_function("div", above, below).cast("bigint") + 1


def differ(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are positive and at most UNIT + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term and lang_n of the terms that each language keeps."""
    return counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")


def shares(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, kept, total, lang_total, none: the share of a missing term) and postings (lang, source, term, n, lang_n, p)."""
    kept = materialise(kept_terms(counts, least), "divergence-kept")
    found = counts.where("term IS NOT NULL").join(kept, ["lang", "term"])
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "total", "lang_total")])
    none = F.when(F.col("kept") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.greatest("kept", F.lit(1))))
    groups = materialise(groups.withColumn("none", none), "divergence-groups")
    postings = found.select("lang", "source", "term", "n", "lang_n").join(groups.select("lang", "source", "kept", "total", "lang_total", "none"), ["lang", "source"])
    postings = postings.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    return groups, materialise(postings.select("lang", "source", "term", "n", "none", "p", "q"), "divergence-postings")


def group_pairs(groups: DataFrame, salts: int = SALTS) -> DataFrame:
    """lang, a, b, kept, a_total, a_none and b_none of all ordered pairs of different groups of a language."""
    left = groups.select("lang", F.pmod(F.xxhash64("source"), F.lit(salts)).alias("salt"), F.col("source").alias("a"), "kept", F.col("total").alias("a_total"), F.col("none").alias("a_none"))
    right = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"), F.col("source").alias("b"), F.col("none").alias("b_none"))
    return left.join(right, ["lang", "salt"]).where("a <> b").drop("salt")


def pair_parts(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, a, b and value of every unordered pair (a below b) of groups of a language."""
    pairs = group_pairs(groups)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    neither = differ(F.col("a_none"), F.col("b_none"))
    constants = pairs.where("a < b").select("lang", "a", "b", F.coalesce(F.col("kept") * neither, F.lit(0)).alias("value"))
    histogram = postings.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"), F.first("p").alias("p")).withColumnRenamed("source", "a")
    # the histogram of a group meets each other group once
    priced = histogram.join(pairs.select("lang", "a", "b", "a_none", "b_none"), ["lang", "a"])
    one_sided = priced.select("lang", low.alias("a"), high.alias("b"), (F.col("terms") * (differ(F.col("p"), F.col("b_none")) - neither)).alias("value"))
    x = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("none").alias("za"))
    y = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("none").alias("zb"))
    pa_, pb_, za, zb = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    both = x.join(y, ["lang", "term"]).where("a < b").select("lang", "a", "b", (differ(pa_, pb_) - differ(pa_, zb) - differ(za, pb_) + differ(za, zb)).alias("value"))
    return constants.unionByName(one_sided).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: other sources by their divergence, and the terms that a source has more of than its language."""
    bound_batches(docs.sparkSession)
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    groups, postings = shares(materialise(counts, "divergence-counts"), least)
    half = pair_parts(groups, postings)
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = half.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    more = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(more).where(F.col("rank") <= terms)).select("lang", "source", "part", "item", "value", "rank")
