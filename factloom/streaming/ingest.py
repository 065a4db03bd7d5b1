"""Streams: units assembled from batches of facts, the fold of a command log, pending references.

Each micro-batch writes state below its own epoch and reads that of the epoch before, so a
replayed micro-batch overwrites what it wrote and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import planner
from ..operators.orphans import OrphanState
from ..schema import UNIT_BATCHES, UNIT_FACTS

UNIT = ["repo_id", "run_id", "plugin_id", "unit_id"]
FACTS = "repo_id string, run_id string, plugin_id string, unit_id string, plugin_version string, batch bigint, completes boolean, fact string, fact_id string, body string"


class Epochs:
    """Versions of a state below a folder, one per epoch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def before(self, epoch: int) -> DataFrame | None:
        """The latest complete state before an epoch."""
        if not self._fs.exists(self._jpath(self.path)):
            return None
        done = [int(x.getPath().getName().removeprefix("epoch=")) for x in self._fs.listStatus(self._jpath(self.path)) if self._fs.exists(self._jpath(f"{x.getPath().toString()}/_SUCCESS"))]
        last = max((e for e in done if e < epoch), default=None)
        return None if last is None else self.spark.read.parquet(f"{self.path}/epoch={last}")

    def write(self, epoch: int, state: DataFrame) -> DataFrame:
        at = f"{self.path}/epoch={epoch}"
        state.write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)


def unit_states(facts: DataFrame) -> DataFrame:
    """One row per unit: whether it is complete, and why it is rejected (null: it is not).

    A unit's batches must agree on the plugin's version; it may have so many batches and facts
    at most; a fact id may not come twice with different bodies. One bad batch spoils the unit.
    """
    twice = facts.where("fact_id is not null").groupBy(*UNIT, "fact", "fact_id").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("not (a <=> b)").groupBy(*UNIT).agg(F.lit(True).alias("twice"))
    s = facts.groupBy(*UNIT).agg(F.bool_or("completes").alias("complete"), F.min("plugin_version").alias("v0"), F.max("plugin_version").alias("v1"), F.count_distinct("batch").alias("batches"), F.count("fact_id").alias("n"))
    why = (
        F.when(~F.col("v0").eqNullSafe(F.col("v1")), "ingestion.origin.changed")
        .when((F.col("batches") > UNIT_BATCHES) | (F.col("n") > UNIT_FACTS), "ingestion.index-unit.limit")
        .when(F.coalesce("twice", F.lit(False)), "ingestion.index-unit.rejected")
    )
    return s.join(twice, UNIT, "left").select(*UNIT, "complete", F.col("n").alias("facts"), why.alias("rejected"))


def ingest(stream: DataFrame, path: str, checkpoint: str, running: Callable[[], DataFrame], stage: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Buffers facts (schema FACTS) until their unit is complete, then hands it to stage(facts, epoch).

    running() gives the runs (repo_id, run_id) that may still receive facts; facts of any other
    run are dropped. A unit that is rejected is kept in the buffer, so that completing its run fails.
    """
    spark = stream.sparkSession
    buffer = Epochs(spark, f"{path}/buffer")

    def step(batch: DataFrame, epoch: int) -> None:
        new = batch.join(running(), ["repo_id", "run_id"], "left_semi")
        held = buffer.before(epoch)
        facts = (new if held is None else held.unionByName(new)).distinct()
        states = unit_states(facts)
        ready = states.where("complete and rejected is null").select(*UNIT)
        done = facts.join(ready, UNIT, "left_semi")
        done.write.mode("overwrite").parquet(f"{path}/ready/epoch={epoch}")
        stage(spark.read.parquet(f"{path}/ready/epoch={epoch}"), epoch)
        buffer.write(epoch, facts.join(ready, UNIT, "left_anti"))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incomplete(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Units of a run that are pending or rejected: with any, the run may not be completed."""
    held = Epochs(spark, f"{path}/buffer").before(1 << 60)
    if held is None:
        return spark.createDataFrame([], FACTS).select(*UNIT, F.lit("").alias("code"))
    return unit_states(held.where(F.col("run_id") == run)).select(*UNIT, F.coalesce("rejected", F.lit("ingestion.index-unit.incomplete")).alias("code"))


def fold_log(stream: DataFrame, path: str, checkpoint: str, slot: list[str], seq: str, value: list[str]) -> StreamingQuery:
    """Keeps the last value of every slot of a log; late and repeated entries change nothing."""
    states = Epochs(stream.sparkSession, path)

    def step(batch: DataFrame, epoch: int) -> None:
        held = states.before(epoch)
        rows = batch.select(*slot, seq, *value)
        states.write(epoch, planner.log_fold(rows if held is None else held.unionByName(rows), slot, seq, value))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track_orphans(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Applies a stream of references and parent events to the state of pending references.

    Rows have the columns of both forms; ``contribution`` is null for references. A micro-batch
    that is replayed writes its part of the log again and is not applied twice.
    """
    state = OrphanState(stream.sparkSession, path)

    def step(batch: DataFrame, epoch: int) -> None:
        if not state.applied(epoch):
            state.append(batch.where("contribution is null"), batch.where("contribution is not null"), epoch)
            state.apply(epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
