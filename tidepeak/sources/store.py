"""Documents and manifests that readers only ever see whole.

A document is written beside its place and renamed into it. A manifest is a chain of versions: each names a
folder of Parquet files that was complete before the version appeared. A version appears by a rename that
fails if it is there already, so of two writers one starts again from what the other has published.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.operators import manifest

MANIFEST = "artifact string, schema_version string, generator string, step string, settings string, params string, source_digests map<string,string>, digest string"


class Files:
    """The few operations on single files that Spark's tables lack, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        self.modes = {}
        for name in ("NONE", "OVERWRITE"):
            self.modes[name] = spark.sparkContext._gateway.new_array(rename, 1)
            self.modes[name][0] = getattr(rename, name)

    def path(self, path: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str, overwrite: bool) -> bool:
        """Writes text beside path and renames it; False if something is there that must not be overwritten."""
        folder, _, name = path.rpartition("/")
        self.fs.mkdirs(self.path(folder))
        if self.fs.getUri().getScheme() == "file":
            return self.publish_local(self.path(path).toUri().getPath(), text, overwrite)
        beside = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(beside), True)
        try:
            stream.write(text.encode())
            stream.hsync()
        finally:
            stream.close()
        try:
            self.context.rename(self.path(beside), self.path(path), self.modes["OVERWRITE" if overwrite else "NONE"])
            return True
        except Exception as e:
            self.fs.delete(self.path(beside), False)
            if not overwrite and "FileAlreadyExistsException" in str(e):
                return False
            raise


    def publish_local(self, path: str, text: str, overwrite: bool) -> bool:
        """publish() where files are the machine's or a mounted share: there Hadoop's renames take two steps, links and replacements one."""
        folder, name = os.path.split(path)
        beside = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
        with open(beside, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(beside, path)
            return True
        try:
            os.link(beside, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(beside)


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """One document in the place of an older one; readers see the one or the other, whole."""
    Files(spark, path).publish(path, text, True)


def read_document(spark: SparkSession, path: str) -> str:
    return Files(spark, path).read(path)


class ManifestStore:
    """A manifest in a folder: versions/00000007.json names the data folder of version 7."""

    def __init__(self, spark: SparkSession, root: str, retries: int = 50) -> None:
        self.spark, self.root, self.retries, self.files = spark, root.rstrip("/"), retries, Files(spark, root)

    def version(self) -> int:
        """The latest version, 0 if there is none."""
        return max([int(n[:-5]) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The manifest as it is, or was at a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        head = json.loads(self.files.read(f"{self.root}/versions/{version:08d}.json"))
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{head['data']}")

    def change(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Publishes what `change` makes of the latest manifest; if another version came meanwhile, of that one. Returns the version."""
        for attempt in range(self.retries):
            before = self.version()
            data = f"data-{uuid.uuid4().hex}"
            change(self.read(before)).coalesce(1).write.parquet(f"{self.root}/{data}")
            if self.files.publish(f"{self.root}/versions/{before + 1:08d}.json", json.dumps({"version": before + 1, "data": data}), False):
                return before + 1
            self.files.fs.delete(self.files.path(f"{self.root}/{data}"), True)
            time.sleep(0.01 * (attempt + 1))
        raise RuntimeError(f"{self.root}: {self.retries} other versions came first")

    def record(self, produced: DataFrame) -> int:
        """Adds artifacts (artifact, step, settings, params, sources, digest), in the place of older entries."""
        rows = manifest.record(produced)
        return self.change(lambda held: manifest.updated(held, rows))

    def invalidate(self, artifacts: DataFrame) -> int:
        """Takes out artifacts (artifact), before they are made again, so that a failed run does not look fresh."""
        return self.change(lambda held: held.join(artifacts.select("artifact").distinct(), "artifact", "left_anti"))

    def reuse(self, expected: DataFrame) -> DataFrame:
        return manifest.reuse(self.read(), expected)


def mark_miss(decisions: DataFrame, misses: DataFrame) -> DataFrame:
    """Decisions (artifact, hit, reason), with misses (artifact, reason) that the caller has found in the place of what was decided."""
    own = misses.select("artifact", F.lit(False).alias("hit"), "reason")
    return decisions.select("artifact", "hit", "reason").join(own.select("artifact"), "artifact", "left_anti").unionByName(own)


def stats(decisions: DataFrame, written: DataFrame) -> DataFrame:
    """One row (hits, misses, writes)."""
    counts = decisions.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return counts.crossJoin(written.agg(F.count(F.lit(1)).alias("writes")))  # one row by one row
