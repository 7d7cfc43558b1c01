"""Clips against annotations: ranks, matches, metrics, aggregates, profiles.

Clips are (room, id, start, end, score), annotations (room, id, start, end, quality, worth).
Pairs of intervals meet within a room and a bucket of time, so a long recording is not one nested loop.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidepeak.config import PROFILES, TARGETS, WEIGHT_NAMES, profile_rows
from tidepeak.functions.settle import settle
from tidepeak.operators.intervals import iou, overlap
from tidepeak.operators.normalize import variant_weights
from tidepeak.schema import room_type


def is_positive(min_quality: int = 3) -> Column:
    return F.col("worth") & (F.col("quality") >= min_quality)


def ranked(clips: DataFrame) -> DataFrame:
    """Adds rank by falling score, then start."""
    return clips.withColumn("rank", F.row_number().over(Window.partitionBy("room").orderBy(F.desc("score"), "start", "id")))


def overlapping(left: DataFrame, right: DataFrame, width: float = 64.0) -> DataFrame:
    """Pairs of a room whose intervals overlap: left (room, a_*), right (room, b_*), by shared buckets of time.

    A pair that shares several buckets is kept in the first of them only.
    """
    buckets = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    pairs = left.withColumn("bucket", buckets("a_start", "a_end")).join(right.withColumn("bucket", buckets("b_start", "b_end")), ["room", "bucket"])
    common = overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    first = F.floor(F.greatest("a_start", "b_start") / width)
    return pairs.where((common > 0) & (F.col("bucket") == first)).drop("bucket")


def named(rows: DataFrame, prefix: str, *more: str) -> DataFrame:
    return rows.select("room", *[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "start", "end", *more)])


def match_edges(top: DataFrame, positives: DataFrame, least: float = 0.0, width: float = 64.0) -> DataFrame:
    """(room, a_id, a_rank, b_id, iou) of clips and positive annotations that overlap, with at least `least` IoU."""
    value = iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    pairs = overlapping(named(top, "a", "rank"), named(positives, "b"), width).withColumn("iou", value)
    return pairs.where(F.col("iou") >= least)


def by_room(edges: DataFrame, choose: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """(room, ...) of what choose gives for the edges (a_id, a_rank, b_id, iou) of each room, best ranks first and nearest annotations first.

    Rooms are many and small: they pass through a task in order, one at a time, and none costs a data frame of its own.
    """
    schema = f"room {room_type(edges)}, {schema}"
    kinds = edges.sparkSession.createDataFrame([], schema).schema
    names, target = kinds.names, to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        out: list[tuple] = []
        told = lambda: pa.RecordBatch.from_arrays([pa.array(c, target.field(i).type) for i, c in enumerate(zip(*out, strict=True))], schema=target)
        for room, group in groupby(rows, key=lambda r: r[0]):
            out += [(room, *r) for r in choose([r[1:] for r in group])]
            if len(out) >= 10_000:
                yield told()
                out = []
        if out:
            yield told()

    dealt = edges.select("room", "a_id", "a_rank", "b_id", "iou").repartition("room").sortWithinPartitions("room", "a_rank", F.desc("iou"), "b_id")
    return dealt.mapInArrow(run, kinds).select(*names)


def matchings(edges: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(room, k, a_id, b_id, iou): for each k, a largest one-to-one matching of the clips of the k best ranks.

    Clips enter in order of rank, each by one search for an augmenting path, nearest annotations by IoU first; so the matching
    of the first k clips is there on the way to that of more, and all k cost one run. A room's clips are at most the largest k.
    """
    wanted = sorted(set(ks))

    def augmented(a: int, near: dict[int, list[int]], holder: dict[int, int], held: dict[int, int]) -> None:
        # breadth over alternating paths: which clip asked for each annotation first
        asked, queue, end = {}, [a], None
        while queue and end is None:
            clip = queue.pop(0)
            for b in near[clip]:
                if b not in asked:
                    asked[b] = clip
                    if b not in holder:
                        end = b
                        break
                    queue.append(holder[b])
        while end is not None:
            clip = asked[end]
            before = held.get(clip)
            holder[end], held[clip] = clip, end
            end = None if clip == a else before

    def run(rows: list[tuple]) -> Iterator[tuple]:
        near: dict[int, list[int]] = {}
        value, rank = {}, {}
        for a, a_rank, b, x in rows:
            near.setdefault(a, []).append(b)
            value[a, b] = x
            rank[a] = a_rank
        holder: dict[int, int] = {}
        held: dict[int, int] = {}
        clips, at = [*near], 0
        for k in wanted:
            while at < len(clips) and rank[clips[at]] <= k:
                augmented(clips[at], near, holder, held)
                at += 1
            yield from ((k, a, b, value[a, b]) for b, a in holder.items())

    return by_room(edges, run, "k int, a_id long, b_id long, iou double")


def max_matching(edges: DataFrame) -> DataFrame:
    """(room, a_id, b_id, iou): a largest one-to-one matching of all clips."""
    return matchings(edges, (2**31 - 1,)).drop("k")


def duplicate_pairs(top: DataFrame, least: float = 0.5, width: float = 64.0) -> DataFrame:
    """(room, id, rank, duplicate_of, iou): for each clip the best-ranked earlier one with at least `least` IoU."""
    pairs = overlapping(named(top, "a", "rank"), named(top, "b", "rank"), width).where("b_rank < a_rank")
    same = pairs.withColumn("iou", iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))).where(F.col("iou") >= least)
    return same.groupBy("room", F.col("a_id").alias("id"), F.col("a_rank").alias("rank")).agg(F.min("b_rank").alias("duplicate_of"), F.min_by("iou", "b_rank").alias("iou"))


def negative_hits(top: DataFrame, negatives: DataFrame, width: float = 64.0) -> DataFrame:
    """(room, id, ranks): negative annotations that clips overlap, with the clips' ranks."""
    pairs = overlapping(named(top, "a", "rank"), named(negatives, "b"), width)
    return pairs.groupBy("room", F.col("b_id").alias("id")).agg(F.array_sort(F.collect_set("a_rank")).alias("ranks"))


def unmatched(top: DataFrame, matches: DataFrame) -> DataFrame:
    return top.join(matches.select("room", F.col("a_id").alias("id")), ["room", "id"], "left_anti")


def metrics(clips: DataFrame, annotations: DataFrame, k: int = 10, match_iou: float = 0.0, duplicate_iou: float = 0.5, min_quality: int = 3, width: float = 64.0) -> DataFrame:
    """One row of metrics a room that has positive annotations; rates without a denominator are 0, or null where nothing was measured."""
    return metrics_at(clips, annotations, (k,), match_iou, duplicate_iou, min_quality, width)


def metrics_at(clips: DataFrame, annotations: DataFrame, ks: tuple[int, ...], match_iou: float = 0.0, duplicate_iou: float = 0.5, min_quality: int = 3, width: float = 64.0) -> DataFrame:
    """metrics() of every case (room) at every k, all from one ranking, one matching and one join with annotations, however many k there are."""
    if not ks:
        raise ValueError("at least one k is needed")
    if min(ks) < 1 or not 0 <= match_iou <= 1 or not 0 <= duplicate_iou <= 1:
        raise ValueError("k must be at least 1, and IoU limits within 0 and 1")
    ks = tuple(sorted(set(ks)))
    all_clips = ranked(clips).withColumn("clips", F.count(F.lit(1)).over(Window.partitionBy("room")))
    top = settle(all_clips.where(F.col("rank") <= ks[-1]))
    notes = settle(annotations.select("room", "id", "start", "end", is_positive(min_quality).alias("positive")))
    positives, negatives = notes.where("positive"), notes.where("NOT positive")
    matches = matchings(match_edges(top, positives, match_iou, width), ks)
    full = matches.join(named(top, "a"), ["room", "a_id"]).join(named(positives, "b"), ["room", "b_id"])
    cost = F.abs(F.col("a_start") - F.col("b_start")) + F.abs(F.col("a_end") - F.col("b_end"))
    matched = full.groupBy("room", "k").agg(F.count(F.lit(1)).alias("matched"), F.sum(F.round("iou", 4)).alias("iou_sum"), F.sum(F.round(cost, 3)).alias("cost_sum"))
    # what holds at a rank holds at every k from there on
    from_rank = lambda rows, rank, to: rows.select("room", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= rank)).alias("k")).groupBy("room", "k").agg(F.count(F.lit(1)).alias(to))
    duplicates = from_rank(duplicate_pairs(top, duplicate_iou, width), F.col("rank"), "duplicates")
    hits = from_rank(negative_hits(top, negatives, width), F.array_min("ranks"), "negative_hits")
    count = notes.groupBy("room").agg(F.count_if("positive").alias("positives"), F.count_if(~F.col("positive")).alias("negatives")).where("positives > 0")
    sizes = top.groupBy("room").agg(F.max("clips").alias("clips"))
    out = count.join(sizes, "room", "left").fillna(0).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("top", F.least("clips", "k"))
    for part in (matched, duplicates, hits):
        out = out.join(part, ["room", "k"], "left")
    out = out.fillna(0)
    ratio = lambda a, b, d=0.0: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(d))
    p, r = ratio("matched", "top"), ratio("matched", "positives")
    return out.select(
        "room", "k", "clips", "top", "positives", "negatives", "matched", "duplicates", "negative_hits", "iou_sum", "cost_sum",
        F.round(p, 4).alias("precision_at_k"), F.round(F.col("matched") / F.col("k"), 4).alias("strict_precision_at_k"), F.round(r, 4).alias("recall_at_k"),
        F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1_at_k"),
        F.round(F.try_divide("iou_sum", "matched"), 4).alias("mean_iou"), F.round(F.try_divide("cost_sum", "matched"), 3).alias("editing_cost"),
        F.round(F.coalesce(F.try_divide(F.col("top") - F.col("matched"), F.col("top")), F.lit(0.0)), 4).alias("invalid_rate"), F.round(ratio("duplicates", "top"), 4).alias("duplicate_rate"),
        F.round(F.try_divide("negative_hits", "negatives"), 4).alias("negative_hit_rate"),
    )


def case_checks(rows: DataFrame, targets: tuple = TARGETS) -> DataFrame:
    """(room, k, name, value, target, met) of every target of every metrics row; met is null where nothing was measured."""
    columns = {"precisionAtK": "precision_at_k", "recallAtK": "recall_at_k", "meanIou": "mean_iou", "invalidRate": "invalid_rate", "duplicateRate": "duplicate_rate"}
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value")) for name, c in columns.items()])
    return target_checks(rows.select("room", "k", F.inline(pairs)), targets)


def failed_cases(checks: DataFrame) -> DataFrame:
    """(room, k, missed): cases that miss a target, an unmeasured one counting as missed."""
    return checks.where(~F.coalesce("met", F.lit(False))).groupBy("room", "k").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("missed"))


def loaded_cases(tables: DataFrame, annotations: DataFrame, profiles: tuple[str, ...] = tuple(PROFILES)) -> tuple[DataFrame, DataFrame]:
    """Cases (room, profile, duration, clips) and unknown profiles (room, profile), of time tables (room, doc) and annotation documents (room, doc).

    A table without clips has none; the annotations' profile and duration count before the table's, and no profile is the default one.
    """
    table = tables.select("room", "doc", F.from_json("doc", "struct<profile:string,duration:double,clips:array<struct<id:bigint,start:double,end:double,score:double>>>").alias("t")).where(F.trim("doc").startswith("{"))
    noted = annotations.select("room", F.from_json("doc", "struct<profile:string,duration:double>").alias("a"))
    none = F.array().cast("array<struct<id:bigint,start:double,end:double,score:double>>")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    cases = table.join(noted, "room", "left").select(
        "room", F.coalesce(text("a.profile"), text("t.profile"), F.lit("default")).alias("profile"), F.coalesce("t.duration", "a.duration").alias("duration"), F.coalesce("t.clips", none).alias("clips")
    )
    return cases.where(F.col("profile").isin(*profiles)), cases.where(~F.col("profile").isin(*profiles)).select("room", "profile")


def clips_of(cases: DataFrame) -> DataFrame:
    """Clips (room, id, start, end, score) of loaded cases; a clip without an id is known by its place."""
    each = cases.select("room", F.posexplode("clips").alias("pos", "c"))
    return each.select("room", F.coalesce("c.id", F.col("pos") + 1).alias("id"), "c.start", "c.end", F.coalesce("c.score", F.lit(0.0)).alias("score")).where("start IS NOT NULL AND end IS NOT NULL")


def finite(value: Column) -> Column:
    """A number, or null for text that is none, and for what is not finite."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def aggregate(rows: DataFrame, *by: str) -> DataFrame:
    """Macro means of rates over cases, and micro rates from sums, for each value of `by`."""
    avg = lambda c: F.round(F.avg(c), 4).alias(f"macro_{c}")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    p, r = ratio("matched", "top"), ratio("matched", "positives")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), avg("precision_at_k"), avg("recall_at_k"), avg("f1_at_k"), avg("mean_iou"), avg("invalid_rate"), avg("duplicate_rate"),
        F.round(p, 4).alias("micro_precision_at_k"), F.round(r, 4).alias("micro_recall_at_k"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("micro_f1_at_k"),
        F.round(F.try_divide(F.sum("iou_sum"), F.sum("matched")), 4).alias("micro_mean_iou"), F.round(F.coalesce(F.try_divide(F.sum("top") - F.sum("matched"), F.sum("top")), F.lit(0.0)), 4).alias("micro_invalid_rate"),
        F.round(ratio("duplicates", "top"), 4).alias("micro_duplicate_rate"),
    )


def target_checks(values: DataFrame, targets: tuple = TARGETS) -> DataFrame:
    """Rows (name, value) with the target's limit and whether it is met; null values give null."""
    limit = F.coalesce(*[F.when(F.col("name") == n, F.lit(v)) for n, v, _ in targets])
    less = F.coalesce(*[F.when(F.col("name") == n, F.lit(x)) for n, _, x in targets])
    met = F.when(less, F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    return values.withColumn("target", limit).where("target IS NOT NULL").withColumn("met", F.when(F.col("value").isNotNull(), met))


def all_met(checks: DataFrame) -> DataFrame:
    """One row: whether every target is met, a null counting as a failure."""
    return checks.agg(F.coalesce(F.bool_and(F.coalesce("met", F.lit(False))), F.lit(False)).alias("passed"))


def objective(kind: str) -> Column:
    """One number of a metrics row, more being better."""
    if kind in ("f1", "precision", "recall"):
        return F.coalesce(F.col(f"{kind}_at_k"), F.lit(0.0))
    if kind == "iou":
        return F.coalesce(F.col("mean_iou"), F.lit(0.0))
    if kind == "editing":
        return F.coalesce(-F.col("editing_cost"), F.lit(-1e9))
    raise ValueError("objective must be one of f1, precision, recall, iou, editing")


def random_candidates(base: dict[str, float], n: int, seed: int = 0) -> list[dict[str, float]]:
    """Weight vectors near a base: some weights dropped, some introduced, others scaled log-uniformly; each sums to 1."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        w = {}
        for name in WEIGHT_NAMES:
            x = base.get(name, 0.0)
            if x <= 0:
                x = rng.uniform(0.01, 0.1) if rng.random() < 0.15 else 0.0
            elif rng.random() < 0.08:
                x = 0.0
            else:
                low, high = ((0.4, 1.0), (1.0, 2.5))[rng.random() < 0.5]
                x *= low * (high / low) ** rng.random()
            w[name] = x
        if total := sum(w.values()):
            out.append({k: v / total for k, v in w.items() if v > 0})
    return out


def candidate_scores(z: DataFrame, candidates: list[dict[str, float]]) -> DataFrame:
    """(candidate, room, t, score): curves of all weight vectors in one pass over z; their list is short and travels in the plan."""
    table = F.array(*[F.struct(F.lit(i).alias("candidate"), F.coalesce(*[F.when(F.col("signal") == s, F.lit(w)) for s, w in c.items()], F.lit(0.0)).alias("w")) for i, c in enumerate(candidates)])
    each = z.select("room", "t", "value", F.explode(table).alias("c")).where("c.w > 0")
    return each.groupBy(F.col("c.candidate").alias("candidate"), "room", "t").agg(F.sum(F.col("c.w") * F.col("value")).alias("score"))


def in_variants(rows: DataFrame, variants: list[str]) -> DataFrame:
    """Rows once for each variant (a short list), with rooms `variant|room`, so that all variants run in one job."""
    return rows.withColumn("variant", F.explode(F.array(*map(F.lit, variants)))).withColumn("room", F.concat_ws("|", "variant", F.col("room").cast("string")))


def out_of_variants(rows: DataFrame) -> DataFrame:
    """(variant, room, ...) of rows whose rooms are `variant|room`; room is a text."""
    rest = [c for c in rows.columns if c != "room"]
    return rows.select(F.substring_index("room", "|", 1).alias("variant"), F.expr("substr(room, instr(room, '|') + 1)").alias("room"), *rest)


def variant_metrics(signals: DataFrame, annotations: DataFrame, weights: DataFrame, score: object, k: int = 5, **limits: float) -> DataFrame:
    """Metrics (variant, room, ...) of every case under every weight vector (variant, signal, w): score(signals, weights) gives the clips of all of them at once."""
    variants = [r[0] for r in weights.select("variant").distinct().orderBy("variant").collect()]
    many = in_variants(signals, variants)
    clips = score(many.drop("variant"), variant_weights(many, weights))
    return out_of_variants(metrics(clips, in_variants(annotations, variants).drop("variant"), k, **limits))


def candidate_table(spark: SparkSession, candidates: list[dict[str, float]]) -> DataFrame:
    """(variant, signal, w) of weight vectors, numbered in order."""
    return spark.createDataFrame([(f"{i:05d}", name, float(w)) for i, c in enumerate(candidates) for name, w in c.items()], "variant string, signal string, w double")


def evaluated_candidates(by_case: DataFrame, kind: str = "f1", scope: str = "micro") -> DataFrame:
    """(variant, objective, precision, recall, invalid, duplicate): aggregates of variant_metrics() over the cases of each variant."""
    if kind not in ("f1", "precision", "recall", "iou", "editing") or scope not in ("micro", "macro"):
        raise ValueError("objective must be one of f1, precision, recall, iou, editing, and scope micro or macro")
    rows = aggregate(by_case, "variant").join(by_case.groupBy("variant").agg(F.try_divide(F.sum("cost_sum"), F.sum("matched")).alias("micro_cost"), F.avg("editing_cost").alias("macro_cost")), "variant")
    at = lambda c: F.col(f"{scope}_{c}")
    value = {"f1": at("f1_at_k"), "precision": at("precision_at_k"), "recall": at("recall_at_k"), "iou": F.coalesce(at("mean_iou"), F.lit(0.0)), "editing": F.coalesce(-at("cost"), F.lit(-1e9))}[kind]
    out = rows.select("variant", F.round(value, 6).alias("objective"), at("precision_at_k").alias("precision"), at("recall_at_k").alias("recall"), at("invalid_rate").alias("invalid"), at("duplicate_rate").alias("duplicate"))
    return out


def best_candidate(evaluated: DataFrame) -> DataFrame:
    """The row of the best variant: by objective, then precision, recall, fewer invalid and fewer duplicate clips, then the first."""
    order = [F.desc("objective"), F.desc("precision"), F.desc("recall"), F.asc("invalid"), F.asc("duplicate"), F.asc("variant")]
    return evaluated.orderBy(*order).limit(1)


def compare_profiles(by_case: DataFrame, cases: DataFrame, min_cases: int = 2, min_positives: int = 5, min_delta: float = 0.02) -> DataFrame:
    """(profile, cases, positives, micro_f1, default_f1, delta, sufficient, recommendation) of variant_metrics() under every profile.

    cases (room, profile) say which profile owns a case; a profile is judged on its own cases against the default on the same ones.
    """
    owned = cases.select(F.col("room").cast("string").alias("room"), F.col("profile").alias("own"))
    rows = by_case.join(owned, "room")
    f1 = lambda when: F.coalesce(F.try_divide(2.0 * F.sum(F.when(when, F.col("matched"))), F.sum(F.when(when, F.col("top") + F.col("positives")))), F.lit(0.0))
    mine, plain = F.col("variant") == F.col("own"), F.col("variant") == "default"
    judged = rows.groupBy(F.col("own").alias("profile")).agg(
        F.count_if(mine).alias("cases"), F.sum(F.when(mine, F.col("positives"))).alias("positives"), F.round(f1(mine), 4).alias("micro_f1"), F.round(f1(plain), 4).alias("default_f1")
    )
    every = by_case.select(F.col("variant").alias("profile")).distinct().join(judged, "profile", "left").fillna(0, ["cases", "positives"])
    return recommend(every.withColumn("delta", F.round(F.col("micro_f1") - F.col("default_f1"), 4)), min_cases, min_positives, min_delta)


def top_features(weights: DataFrame, limit: int = 5) -> DataFrame:
    """(variant, place, signal, w): the largest positive weights of each vector, equal ones by name."""
    place = F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("w"), "signal"))
    return weights.where("w > 0").withColumn("place", place).where(F.col("place") <= limit).select("variant", "place", "signal", F.round("w", 6).alias("w"))


def positive_counts(annotations: DataFrame, min_quality: int = 3) -> DataFrame:
    """(room, positives, annotations)."""
    return annotations.groupBy("room").agg(F.count_if(is_positive(min_quality)).alias("positives"), F.count(F.lit(1)).alias("annotations"))


def coordinate_search(evaluate: object, base: dict[str, float], multipliers: tuple[float, ...] = (0.5, 0.8, 1.25, 2.0), rounds: int = 1) -> dict[str, float]:
    """Greedy search, one weight at a time: evaluate(list of weight vectors) gives their objectives in one job."""
    best = dict(base)
    for _ in range(rounds):
        for name in [k for k, v in base.items() if v > 0]:
            tries = [best] + [{k: v * m if k == name else v for k, v in best.items()} for m in multipliers]
            tries = [{k: v / sum(t.values()) for k, v in t.items()} for t in tries]
            scores = evaluate(tries)
            best = tries[max(range(len(tries)), key=lambda i: (scores[i], -i))]
    return best


def profile_table(spark: SparkSession) -> DataFrame:
    """(profile, signal, w) of all profiles."""
    return spark.createDataFrame(profile_rows(), "profile string, signal string, w double")


def profile_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """Total variation and cosine of two weight tables (signal, w), over the union of their signals."""
    both = left.select("signal", F.col("w").alias("a")).join(right.select("signal", F.col("w").alias("b")), "signal", "full").fillna(0.0)
    a, b = F.col("a"), F.col("b")
    return both.agg((F.sum(F.abs(a - b)) / 2).alias("total_variation"), F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))).alias("cosine"))


def profile_pairs(profiles: DataFrame) -> DataFrame:
    """(left, right, total_variation, cosine) of each pair of profiles."""
    a = profiles.select(F.col("profile").alias("left"), "signal", F.col("w").alias("a"))
    b = profiles.select(F.col("profile").alias("right"), "signal", F.col("w").alias("b"))
    x, y = F.col("a"), F.col("b")
    sums = a.join(b, "signal").where("left < right").groupBy("left", "right")
    return sums.agg((F.sum(F.abs(x - y)) / 2).alias("total_variation"), F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))).alias("cosine"))


def best_profile(results: DataFrame) -> DataFrame:
    """(label, best): of results (label, profile, own, f1_at_k, precision_at_k) the best by F1, precision, and being the case's own."""
    order = F.struct(F.coalesce("f1_at_k", F.lit(-1.0)), F.coalesce("precision_at_k", F.lit(0.0)), (F.col("profile") == F.col("own")).cast("int"), F.col("profile"))
    return results.groupBy("label").agg(F.max_by("profile", order).alias("best"))


def recommend(reports: DataFrame, min_cases: int = 2, min_positives: int = 5, min_delta: float = 0.02) -> DataFrame:
    """Adds recommendation to (profile, cases, positives, delta)."""
    enough = (F.col("cases") >= min_cases) & (F.col("positives") >= min_positives)
    kind = F.when(F.col("profile") == "default", "keep").when(~enough, "collect_more_or_merge").when(F.col("delta") >= min_delta, "keep").otherwise("merge_into_default")
    return reports.withColumn("sufficient", enough).withColumn("recommendation", kind)


def by_recommendation(recommended: DataFrame) -> DataFrame:
    return recommended.groupBy("recommendation").agg(F.array_join(F.array_sort(F.collect_list("profile")), ",").alias("profiles"))


def unique_labels(cases: DataFrame, block: int = 100_000) -> DataFrame:
    """Labels told apart: the second `x` becomes `x#2`. Cases are (idx, label), idx being a number.

    A label is numbered in ranges of idx of about `block` cases, each from where the ranges before it end, so no task has all of a common one.
    """
    ranges = -(-cases.count() // block)
    cuts = sorted({*cases.approxQuantile("idx", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}) if ranges > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("idx"))) if cuts else F.lit(0)
    dealt = cases.withColumn("_range", F.when(F.col("idx").isNull(), -1).otherwise(place))
    sizes = dealt.groupBy("label", "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("label").orderBy("_range")) - F.col("_size")
    starts = sizes.select(F.col("label").alias("_label"), F.col("_range").alias("_of"), before.alias("_before"))
    joined = dealt.join(starts, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_of")))
    n = F.row_number().over(Window.partitionBy("label", "_range").orderBy("idx")) + F.col("_before")
    return joined.withColumn("n", n).select(*cases.columns, "n").withColumn("label", F.when(F.col("n") > 1, F.concat("label", F.lit("#"), F.col("n").cast("string"))).otherwise(F.col("label"))).drop("n")


def best_existing_match(clips: DataFrame, existing: DataFrame, least: float = 0.5) -> DataFrame:
    """(room, id, existing_id, iou): clips by rank take the best annotation not yet taken, with at least `least` IoU."""

    def run(rows: list[tuple]) -> Iterator[tuple]:
        near: dict[int, list[tuple]] = {}
        for a, _, b, x in rows:
            near.setdefault(a, []).append((b, x))
        taken: set[int] = set()
        for a, found in near.items():
            free = next(((b, x) for b, x in found if b not in taken), None)
            if free is not None:
                taken.add(free[0])
                yield a, *free

    return by_room(match_edges(ranked(clips), existing, least), run, "id long, existing_id long, iou double")
