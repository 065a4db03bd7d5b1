"""Only new or changed records, by offsets, a write-ahead plan and an idempotent sink.

One partition is one repository. Its offset is the state that its last successful run left
behind. A batch is planned against the offsets, the plan is written ahead to the log and
committed by a marker; only then do its records reach the sink. After a failure the plan
is read again, never computed anew, so a batch has the same records however often it is
replayed, and the sink keeps one record per (partition, key, offset).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Folder

KEY = ["repo_id", "plugin_id", "path"]
PLAN = "repo_id string, plugin_id string, path string, plugin_version string, digest string, change string, offset string"


def norm_path(path: Column) -> Column:
    """One notation of a path: slashes, no empty or '.' segments at its head."""
    return F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), r"^(\./)+", "")


def norm_digest(digest: Column) -> Column:
    """One notation of a digest: lower case, without the algorithm's prefix."""
    return F.regexp_replace(F.lower(F.trim(digest)), r"^sha-?256[:=-]", "")


def last_successful(runs: DataFrame) -> DataFrame:
    """(repo_id, run_id) of the Completed run with the greatest completed_at (ties: the greatest id)."""
    done = runs.where((F.col("status") == "Completed") & F.col("completed_at").isNotNull())
    return done.groupBy("repo_id").agg(F.max(F.struct("completed_at", "run_id")).alias("r")).select("repo_id", F.col("r.run_id").alias("run_id"))


def committed_sources(runs: DataFrame, index_states: DataFrame) -> DataFrame:
    """(repo_id, plugin_id, npath, plugin_version, digest, offset) that the last successful runs had indexed.

    A run may have left several states; the latest recorded one counts (ties: the greatest).
    Only the states of successful runs are exploded.
    """
    states = index_states.select("repo_id", "run_id", "recorded_at", "sources").join(last_successful(runs), ["repo_id", "run_id"])
    latest = states.groupBy("repo_id", "run_id").agg(F.max(F.struct("recorded_at", "sources")).alias("s"))
    rows = latest.select("repo_id", F.col("run_id").alias("offset"), F.explode("s.sources").alias("x"))
    entry = F.struct(F.col("x.plugin_version").alias("plugin_version"), norm_digest(F.col("x.hash")).alias("digest"))
    return (
        rows.select("repo_id", "offset", F.col("x.plugin_id").alias("plugin_id"), norm_path(F.col("x.path")).alias("npath"), entry.alias("e"))
        .groupBy("repo_id", "offset", "plugin_id", "npath")
        .agg(F.max("e").alias("e"))
        .select("repo_id", "plugin_id", "npath", "e.plugin_version", "e.digest", "offset")
    )


def current_sources(source_files: DataFrame) -> DataFrame:
    """The latest observation of each (repo_id, plugin_id, path); ties: the greatest row."""
    seen = F.struct("observed_at", "file_id", "plugin_version", "source_hash")
    return source_files.groupBy(*KEY).agg(F.max(seen).alias("s")).select(*KEY, "s.plugin_version", norm_digest(F.col("s.source_hash")).alias("digest"))


def plan_changes(source_files: DataFrame, runs: DataFrame, index_states: DataFrame, keep_all: bool = False) -> DataFrame:
    """:func:`compared` against what the last successful runs had indexed."""
    return compared(source_files, committed_sources(runs, index_states), keep_all)


def compared(source_files: DataFrame, was: DataFrame, keep_all: bool = False) -> DataFrame:
    """Each current source with its change (New or Changed; with keep_all also Unchanged and Deleted).

    was: what had been indexed (see :func:`committed_sources`). Deleted rows have the committed
    path's notation. Null plugins, paths and digests are compared as values; a source without
    digest is Changed unless the committed one lacks it too.
    """
    now = current_sources(source_files).withColumn("npath", norm_path(F.col("path")))
    a, b = now.alias("a"), was.alias("b")
    same = (F.col("a.repo_id").eqNullSafe(F.col("b.repo_id"))) & F.col("a.plugin_id").eqNullSafe(F.col("b.plugin_id")) & F.col("a.npath").eqNullSafe(F.col("b.npath"))
    both = a.join(b, same, "full" if keep_all else "left")
    equal = F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.plugin_version").eqNullSafe(F.col("b.plugin_version"))
    change = F.when(F.col("b.offset").isNull(), "New").when(F.col("a.repo_id").isNull() & F.col("a.path").isNull(), "Deleted").when(~equal, "Changed").otherwise("Unchanged")
    out = both.select(
        F.coalesce("a.repo_id", "b.repo_id").alias("repo_id"),
        F.coalesce("a.plugin_id", "b.plugin_id").alias("plugin_id"),
        F.coalesce("a.path", "b.npath").alias("path"),
        F.coalesce("a.plugin_version", "b.plugin_version").alias("plugin_version"),
        F.coalesce("a.digest", "b.digest").alias("digest"),
        change.alias("change"),
        F.col("b.offset").alias("offset"),
    )
    return out if keep_all else out.where(F.col("change").isin("New", "Changed"))


OFFSETS = "repo_id string, plugin_id string, npath string, plugin_version string, digest string, offset string"


class ChangeLog:
    """Offsets, write-ahead plans and the deduplicating sink below one folder of a shared file system.

    * ``offsets/<n>``: what each repository had indexed after batch n (its manifest) and the name
      of that state. Offsets advance only after a batch has reached the sink,
    * ``wal/<n>``: the plan of batch n, written before anything of it is delivered,
    * ``sink/<n>/<attempt>``: what was delivered; readers see the attempt that ``commits/<n>``
      names, which is written by a rename, so a delivery is seen whole or not at all.

    :meth:`run` first finishes a batch that was broken off, from its plan, and then starts a new one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, path)

    def _done(self, name: str) -> list[int]:
        return sorted(int(n) for n in self.folder.names(name) if n.isdigit() and (name == "commits" or self.folder.exists(f"{name}/{n}/_SUCCESS")))

    def start(self, committed: DataFrame) -> None:
        """Takes over the offsets of earlier runs (see :func:`committed_sources`); a log that has some keeps its own."""
        if not self._done("offsets"):
            committed.write.mode("overwrite").parquet(f"{self.path}/offsets/0")

    def offsets(self) -> DataFrame:
        """(repo_id, plugin_id, npath, plugin_version, digest, offset) after the last finished batch."""
        done = self._done("offsets")
        if not done:
            return self.spark.createDataFrame([], OFFSETS)
        return self.spark.read.schema(OFFSETS).parquet(f"{self.path}/offsets/{done[-1]}")

    def plan(self, batch: int, source_files: DataFrame) -> DataFrame:
        """The batch's plan: read from the log if it is there, else computed against the offsets and written ahead."""
        at = f"wal/{batch}"
        if not self.folder.exists(f"{at}/_SUCCESS"):  # written last, by the job's commit
            compared(source_files, self.offsets(), keep_all=True).write.mode("overwrite").parquet(f"{self.path}/{at}")
        return self._plan(batch)

    def _plan(self, batch: int) -> DataFrame:
        return self.spark.read.schema(PLAN).parquet(f"{self.path}/wal/{batch}")

    def deliver(self, batch: int) -> None:
        """The batch's new and changed records to the sink, once: a batch that is committed is not delivered again."""
        if self.folder.exists(f"commits/{batch}"):
            return
        attempt = uuid.uuid4().hex
        self._plan(batch).where(F.col("change").isin("New", "Changed")).write.parquet(f"{self.path}/sink/{batch}/{attempt}")
        self.folder.write(f"commits/{batch}", attempt)

    def advance(self, batch: int) -> None:
        """The offsets after a batch: every repository has indexed what the plan says it has now.

        Repositories that the batch did not see keep their offsets.
        """
        if self.folder.exists(f"offsets/{batch}/_SUCCESS"):
            return
        plan, before = self._plan(batch), self.offsets()
        seen = plan.where("change != 'Deleted'").select("repo_id").distinct().withColumnRenamed("repo_id", "_r")
        now = plan.where("change != 'Deleted'").select("repo_id", "plugin_id", norm_path(F.col("path")).alias("npath"), "plugin_version", "digest", F.lit(f"batch-{batch}").alias("offset"))
        kept = before.join(seen, before["repo_id"].eqNullSafe(seen["_r"]), "left_anti")
        now.unionByName(kept).write.mode("overwrite").parquet(f"{self.path}/offsets/{batch}")

    def run(self, source_files: DataFrame) -> int:
        """Finishes what was broken off, else processes the next batch; gives the number of the batch."""
        planned, finished = self._done("wal"), self._done("offsets")
        last = finished[-1] if finished else 0
        batch = planned[-1] if planned and planned[-1] > last else last + 1
        self.plan(batch, source_files)
        self.deliver(batch)
        self.advance(batch)
        return batch

    def sink(self, batch: int | None = None) -> DataFrame:
        """What was delivered, of one batch or of all, with the column batch.

        One row per (repo_id, plugin_id, path, digest, plugin_version, offset); of several the
        change of the earliest batch.
        """
        numbers = [batch] if batch is not None else self._done("commits")
        out = self.spark.createDataFrame([], PLAN).withColumn("batch", F.lit(0))
        for n in numbers:
            out = out.unionByName(self.spark.read.schema(PLAN).parquet(f"{self.path}/sink/{n}/{self.folder.read(f'commits/{n}')}").withColumn("batch", F.lit(n)))
        key = [*KEY, "plugin_version", "digest", "offset"]
        return out.groupBy(*key).agg(F.min(F.struct("batch", "change")).alias("x")).select(*key, "x.batch", "x.change")
