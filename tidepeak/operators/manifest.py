"""Artifact manifests: fingerprints, reuse decisions, run status, resumable chunks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION, GENERATOR = "1.0", "tidepeak-3"
STATUSES = ("pending", "running", "ok", "empty", "failed", "skipped", "invalid")


def hash_json(value: object) -> str:
    """Digest of settings or parameters that does not depend on the order of keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def fingerprints(files: DataFrame, longest: int = 256 << 20) -> DataFrame:
    """(path, size, modified, digest) of files as read by the binaryFile source; the content of those over `longest` bytes is not read, and they have no digest."""
    of = lambda rows, digest: rows.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), digest.alias("digest"))
    return of(files.where(F.col("length") <= longest), F.sha2("content", 256)).unionByName(of(files.where(F.col("length") > longest), F.lit(None).cast("string")))


def unchanged(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, same): whether files of two fingerprint tables are the same, by size and digest, or by time where there is no digest; one that is missing is not."""
    a, b = before.select("path", F.struct("size", "modified", "digest").alias("a")), now.select("path", F.struct("size", "modified", "digest").alias("b"))
    alike = F.when(F.col("a.digest").isNotNull() & F.col("b.digest").isNotNull(), F.col("a.digest") == F.col("b.digest")).otherwise(F.col("a.modified") == F.col("b.modified"))
    return a.join(b, "path", "full").select("path", F.coalesce((F.col("a.size") == F.col("b.size")) & alike, F.lit(False)).alias("same"))


def reuse(artifacts: DataFrame, expected: DataFrame, version: str = VERSION, generator: str = GENERATOR) -> DataFrame:
    """Adds (hit, reason) to expected (artifact, step, settings, params, sources, digest): the first reason not to reuse what artifacts records.

    artifacts: (artifact, schema_version, generator, step, settings, params, source_digests, digest); expected.digest
    is that of the file as it is, null if there is none; sources is a map of paths to their digests now.
    """
    m = artifacts.select(F.col("artifact"), *[F.col(c).alias(f"m_{c}") for c in ("schema_version", "generator", "step", "settings", "params", "source_digests", "digest")])
    rows = expected.join(m, "artifact", "left")
    known, now = F.map_keys("m_source_digests"), F.map_keys("sources")
    changed = F.exists(F.map_entries("sources"), lambda e: e["value"] != F.try_element_at(F.col("m_source_digests"), e["key"]))
    gone = F.exists(F.map_entries("sources"), lambda e: e["value"].isNull())
    checks = (
        (F.col("digest").isNull(), "artifact missing"), (F.col("m_step").isNull(), "metadata missing"), (F.col("m_schema_version") != version, "schema changed"),
        (F.col("m_generator") != generator, "generator changed"), (F.col("m_step") != F.col("step"), "step changed"), (F.col("m_settings") != F.col("settings"), "settings changed"),
        (F.col("m_params") != F.col("params"), "parameters changed"), (F.col("m_digest") != F.col("digest"), "artifact modified"),
        ((F.size(F.array_except(known, now)) > 0) | (F.size(F.array_except(now, known)) > 0), "source set changed"), (gone, "source missing"), (changed, "source changed"),
    )
    reason = F.coalesce(*[F.when(c, F.lit(text)) for c, text in checks])
    return rows.withColumn("reason", reason).select(*expected.columns, F.col("reason").isNull().alias("hit"), F.coalesce("reason", F.lit("cache hit")).alias("reason"))


def cache_stats(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


def run_status(events: DataFrame) -> DataFrame:
    """(run, step, status, elapsed_ms): the last state of each step from (run, step, ts_ms, status); a finish without a start takes no time."""
    last = Window.partitionBy("run", "step").orderBy(F.desc("ts_ms"))
    started = F.min(F.when(F.col("status") == "running", F.col("ts_ms"))).over(Window.partitionBy("run", "step"))
    rows = events.where(F.col("status").isin(*STATUSES)).withColumn("started", started).withColumn("place", F.row_number().over(last)).where("place = 1")
    return rows.select("run", "step", "status", F.greatest(F.lit(0), F.coalesce(F.col("ts_ms") - F.col("started"), F.lit(0))).alias("elapsed_ms"))


def failures(status: DataFrame) -> DataFrame:
    return status.where("status IN ('failed', 'invalid')")


def pending_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks (signature, idx) that no earlier run with the same signature completed."""
    return chunks.join(done, ["signature", "idx"], "left_anti")


def feature_status(artifacts: DataFrame) -> DataFrame:
    """(artifact, status, features, misaligned) of (artifact, duration, features map of arrays): missing, empty, or ok; which lengths are off by more than a second.

    With a column doc, the text of the artifact, one that is there but holds no map of features is invalid.
    """
    off = F.map_keys(F.map_filter("features", lambda k, v: F.abs(F.size(v) - F.ceil("duration")) > 1))
    held = F.map_filter(F.coalesce("features", F.create_map().cast("map<string,array<double>>")), lambda k, v: F.size(v) > 0)
    invalid = F.col("doc").isNotNull() if "doc" in artifacts.columns else F.lit(False)
    status = F.when(F.col("features").isNull() & invalid, "invalid").when(F.col("features").isNull(), "missing").when(F.size(held) == 0, "empty").otherwise("ok")
    return artifacts.select("artifact", status.alias("status"), F.size(held).alias("features"), F.array_sort(F.coalesce(off, F.array().cast("array<string>"))).alias("misaligned"))


def record(produced: DataFrame, version: str = VERSION, generator: str = GENERATOR) -> DataFrame:
    """Manifest rows, as reuse() reads them, of produced (artifact, step, settings, params, sources, digest)."""
    return produced.select("artifact", F.lit(version).alias("schema_version"), F.lit(generator).alias("generator"), "step", "settings", "params", F.col("sources").alias("source_digests"), "digest")


def updated(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest with rows in the place of older ones of the same artifact."""
    return manifest.join(rows.select("artifact"), "artifact", "left_anti").unionByName(rows)


def segment_report(segments: DataFrame, least: int = 1024) -> DataFrame:
    """Recorded segments (room, idx, size, seconds, header) with usable or the reason of quarantine: missing, too_small, bad_header, no_duration."""
    reason = F.coalesce(
        F.when(F.col("size").isNull(), F.lit("missing")), F.when(F.col("size") < least, F.lit("too_small")), F.when(F.coalesce(F.col("header") != "FLV", F.lit(True)), F.lit("bad_header")),
        F.when(~(F.coalesce("seconds", F.lit(0.0)) > 0), F.lit("no_duration")),
    )
    return segments.withColumn("quarantine", reason).withColumn("usable", F.col("quarantine").isNull())


def step_range(steps: tuple[str, ...], first: str | None = None, only: str | None = None) -> tuple[str, ...]:
    """Steps of a run that starts at one, or does one only."""
    if only:
        return (steps[steps.index(only)],)
    return steps[steps.index(first) :] if first else steps


def text_or_null(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
