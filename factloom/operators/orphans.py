"""References to records that do not exist, kept as incremental state.

State lies below one folder, all of it keyed by ``(parent, repo_id, key)`` and cut into buckets
by a hash of the key:

* ``refs`` and ``events``: the log, one part per batch. References seen stay there, since a
  deletion may reopen them,
* ``parents``: the contributions of every parent record and whether they are gone,
* ``pending``: the references whose parent is not live now,
* ``counts``: a snapshot of the open references after every batch.

A batch brings new references and parent events (a contribution appears or is deleted; events
are known by their contribution, so one that is delivered again changes nothing). New
references probe the parent index, a parent that becomes live resolves what waits for it, and
one that loses its last contribution reopens its references. Only buckets that a batch touches
are read and written again. A manifest names the version of every bucket; writing it commits
the batch, and a batch that was broken off is done again from its part of the log. Versions
that the last two manifests do not name are removed.

Only keys travel to the probe: references are reduced to their distinct keys before the
shuffle, so a key that holds a third of all references is one row there. The references of
the orphaned keys are then fetched by a broadcast, if these are few (their number is checked),
else by a join that spreads every key over SALTS partitions.

Defined results: a null reference is no case; a null ``repo_id`` equals only itself;
repeated rows count once; references and events without a time belong to the first batch;
empty tables give an empty state. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Folder, cut

KEY = ["parent", "repo_id", "key"]
REF = [*KEY, "ref_table", "ref_column", "ref_id", "at"]
EVENT = [*KEY, "contribution", "gone", "at"]
REFS = "parent string, repo_id string, key string, ref_table string, ref_column string, ref_id string, at timestamp_ntz"
EVENTS = "parent string, repo_id string, key string, contribution bigint, gone boolean, at timestamp_ntz"
PARENTS = "parent string, repo_id string, key string, contribution bigint, gone boolean"
#: Parts of the state; partitions of a hot key; keys that are broadcast at most.
BUCKETS, SALTS, FEW = 8, 16, 50_000


def _join(left: DataFrame, right: DataFrame, how: str, on: list[str] = KEY) -> DataFrame:
    """Null-safe join on the keys; the columns of the left side."""
    right = right.select(*[F.col(c).alias(f"_{c}") for c in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(right[f"_{c}"])
    return left.join(right, cond, how)


def _of_keys(refs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """refs whose key is among keys (a cut relation of n distinct keys)."""
    if n <= FEW:
        return _join(refs, F.broadcast(keys.select(*KEY)), "left_semi")
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("ref_table", "ref_column", "ref_id"), F.lit(SALTS)).cast("int"))
    spread = keys.select(*KEY).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return _join(salted, spread, "left_semi", [*KEY, "salt"]).drop("salt")


def references(df: DataFrame, ref_table: str, parent: str, ref_id: str, at: str, *ref_columns: str) -> DataFrame:
    """The non-null references of some columns of a table, in the operator's form; the table is read once."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_column"), F.col(c).alias("key")) for c in ref_columns])).alias("r")
    rows = df.select("repo_id", F.col(ref_id).alias("ref_id"), F.col(at).cast("timestamp_ntz").alias("at"), each)
    return rows.where("r.key is not null").select(F.lit(parent).alias("parent"), "repo_id", "r.key", F.lit(ref_table).alias("ref_table"), "r.ref_column", "ref_id", "at")


def parent_events(df: DataFrame, parent: str, key: str, created: str, deleted: str | None = None, identity: tuple[str, ...] = ()) -> DataFrame:
    """(parent, repo_id, key, contribution, gone, at): each row appears, and is gone where it has been deleted.

    A row is one contribution, known by a hash of its identity, of its times and of whether it
    is deleted: the same row written twice is one, and a deleted row never takes another along.
    """
    gone = F.col(deleted) if deleted else F.lit(None).cast("timestamp_ntz")
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (*identity, created, *([deleted] if deleted else []))])
    states = F.array(F.struct(F.lit(False).alias("gone"), F.col(created).cast("timestamp_ntz").alias("at")), F.struct(F.lit(True).alias("gone"), gone.cast("timestamp_ntz").alias("at")))
    rows = df.where(F.col(key).isNotNull()).select(F.lit(parent).alias("parent"), "repo_id", F.col(key).alias("key"), row.alias("contribution"), F.explode(F.when(gone.isNotNull(), states).otherwise(F.slice(states, 1, 1))).alias("e"))
    return rows.select(*KEY, "contribution", "e.gone", "e.at")


def quarter(at: Column, first: int = 0) -> Column:
    """The number of a time's quarter of a year, first for no time: a batch number for :meth:`OrphanState.append`."""
    return F.coalesce(F.year(at) * 4 + F.quarter(at) - 1, F.lit(first))


class OrphanState:
    """The state below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.folder = Folder(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, df: DataFrame, where: str, *parts: str) -> None:
        """df by bucket (and parts): a large bucket is written by several tasks, small ones share one."""
        df.withColumn("bucket", self._bucket()).hint("rebalance", *parts, "bucket").write.mode("overwrite").partitionBy(*parts, "bucket").parquet(f"{self.path}/{where}")

    def _read(self, places: list[str], schema: str) -> DataFrame:
        """The parts of a relation that exist."""
        found = [f"{self.path}/{p}" for p in places if self.folder.exists(p)]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def append(self, refs: DataFrame, events: DataFrame, batch: int | Column) -> None:
        """Writes references and events to the log: as one batch, or each row to the batch of its time."""
        if isinstance(batch, int):
            for name, df in (("refs", refs.select(*REF)), ("events", events.select(*EVENT))):
                self._write(df, f"{name}/batch={batch}")
            return
        self._write(refs.select(*REF).withColumn("batch", batch), "refs", "batch")
        self._write(events.select(*EVENT).withColumn("batch", batch), "events", "batch")

    def _numbers(self, name: str) -> set[int]:
        return {int(x.removeprefix("batch=").removesuffix(".json")) for x in self.folder.names(name) if x.removeprefix("batch=").removesuffix(".json").isdigit()}

    def waiting(self) -> list[int]:
        """The batches in the log that have not been applied, in order."""
        return sorted((self._numbers("refs") | self._numbers("events")) - self._numbers("manifest"))

    def _manifest(self, before: int | None = None) -> dict:
        done = [b for b in self._numbers("manifest") if before is None or b < before]
        return json.loads(self.folder.read(f"manifest/{max(done)}.json")) if done else {"refs": [], "parents": {}, "pending": {}}

    def _touched(self, batch: int) -> list[str]:
        """Buckets in which a batch has rows, by the names of their folders."""
        return sorted({b for name in ("refs", "events") for b in self.folder.names(f"{name}/batch={batch}") if b.startswith("bucket=")})

    def applied(self, batch: int) -> bool:
        return self.folder.exists(f"manifest/{batch}.json")

    def apply(self, batch: int) -> None:
        """Applies one batch of the log; one that is committed already changes nothing.

        Batches must be applied in the order of their numbers.
        """
        if self.applied(batch):
            return
        was = self._manifest(batch)
        touched = self._touched(batch)

        def held(name: str) -> list[str]:
            return [f"{name}/batch={was[name][b]}/{b}" for b in touched if b in was[name]]

        refs = self._read([f"refs/batch={batch}/{b}" for b in touched], REFS)
        events = self._read([f"events/batch={batch}/{b}" for b in touched], EVENTS)
        before = self._read(held("parents"), PARENTS).withColumn("old", F.lit(True))
        both = before.unionByName(events.drop("at").withColumn("old", F.lit(False)))
        each = both.groupBy(*KEY, "contribution").agg(F.bool_or("gone").alias("gone"), F.bool_or(F.col("old") & ~F.col("gone")).alias("was"))
        self._write(each, f"parents/batch={batch}")
        # One row per key that the batch touches: was it live, is it live, is it asked for by new references?
        now_ = self._read([f"parents/batch={batch}/{b}" for b in touched], PARENTS + ", was boolean").select(*KEY, "was", (~F.col("gone")).alias("live"), F.lit(False).alias("asked"))
        asked = refs.select(*KEY, F.lit(False).alias("was"), F.lit(False).alias("live"), F.lit(True).alias("asked"))
        status = cut(now_.unionByName(asked).groupBy(*KEY).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("was", "live", "asked")]))
        # What waits and is resolved, what was resolved and is reopened, what is new and finds no parent.
        change = {"resolved": F.col("live") & ~F.col("was"), "reopened": F.col("was") & ~F.col("live"), "missing": F.col("asked") & ~F.col("live")}
        resolved, reopened, missing = (status.where(c) for c in change.values())
        n = status.agg(*[F.count_if(c).alias(name) for name, c in change.items()], F.collect_set(F.when(change["reopened"], self._bucket())).alias("buckets")).first()
        seen = self._read([f"refs/batch={b}/bucket={x}" for b in was["refs"] for x in sorted(n["buckets"])], REFS)
        waiting = self._read(held("pending"), REFS)
        still = _join(waiting, F.broadcast(resolved.select(*KEY)) if n["resolved"] <= FEW else resolved, "left_anti")
        opened = _of_keys(seen, reopened, n["reopened"]).unionByName(_of_keys(refs, missing, n["missing"]))
        self._write(still.unionByName(opened).distinct(), f"pending/batch={batch}")
        now = {"refs": sorted({*was["refs"], batch}), "parents": was["parents"] | {b: batch for b in touched}, "pending": was["pending"] | {b: batch for b in touched}}
        self._counted(now).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch}")
        self.folder.write(f"manifest/{batch}.json", json.dumps(now))
        self._cleared(was, now)

    def _cleared(self, was: dict, now: dict) -> None:
        """Removes versions of buckets that neither this nor the last manifest names."""
        for name in ("parents", "pending"):
            kept = {(v, b) for m in (was, now) for b, v in m[name].items()}
            for number in self._numbers(name):
                for b in self.folder.names(f"{name}/batch={number}"):
                    if b.startswith("bucket=") and (number, b) not in kept:
                        self.folder.delete(f"{name}/batch={number}/{b}")

    def _open(self, manifest: dict) -> DataFrame:
        return self._read([f"pending/batch={v}/{b}" for b, v in sorted(manifest["pending"].items())], REFS)

    def _counted(self, manifest: dict) -> DataFrame:
        month = F.date_format("at", "yyyy-MM").alias("month")
        return self._open(manifest).select("ref_table", "ref_column", "repo_id", "ref_id", month).distinct().groupBy("ref_table", "ref_column", "month").agg(F.count("*").alias("n_orphans"))

    def replay(self) -> OrphanState:
        """Applies all batches that wait in the log."""
        for batch in self.waiting():
            self.apply(batch)
        return self

    def pending(self) -> DataFrame:
        """The references that are open after the last batch, in the operator's form."""
        return self._open(self._manifest())

    def refs(self) -> DataFrame:
        """All references of the batches that were applied."""
        return self._read([f"refs/batch={b}/{x}" for b in self._manifest()["refs"] for x in self.folder.names(f"refs/batch={b}") if x.startswith("bucket=")], REFS)

    def orphans(self) -> DataFrame:
        """(ref_table, ref_column, repo_id, ref_id), distinct."""
        return self.pending().select("ref_table", "ref_column", "repo_id", "ref_id").distinct()

    def snapshots(self) -> DataFrame:
        """(batch, ref_table, ref_column, month, n_orphans): the open references after each batch, by month of the reference."""
        schema = "ref_table string, ref_column string, month string, n_orphans bigint"
        out = self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        for b in sorted(self._numbers("manifest")):
            out = out.unionByName(self._read([f"counts/batch={b}"], schema).withColumn("batch", F.lit(b)))
        return out.select("batch", "ref_table", "ref_column", "month", "n_orphans")


def orphan_counts(new_refs: DataFrame, pending: DataFrame) -> DataFrame:
    """Counts per table, column and month of the reference: all references and the open ones.

    References without a time fall into a null month. Repeated rows count once.
    """
    month = F.date_format("at", "yyyy-MM").alias("month")
    ids = ["ref_table", "ref_column", "repo_id", "ref_id"]

    def per_month(df: DataFrame, name: str) -> DataFrame:
        once = df.groupBy(*ids).agg(F.min("at").alias("at"))
        return once.groupBy("ref_table", "ref_column", month).agg(F.count("*").alias(name))

    total, broken = per_month(new_refs, "n_refs"), per_month(pending, "n_orphans")
    return (
        total.unionByName(broken, allowMissingColumns=True)
        .groupBy("ref_table", "ref_column", "month")
        .agg(F.coalesce(F.sum("n_refs"), F.lit(0)).alias("n_refs"), F.coalesce(F.sum("n_orphans"), F.lit(0)).alias("n_orphans"))
    )
