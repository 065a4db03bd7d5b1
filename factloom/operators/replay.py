"""Replay of a change feed (inserts, updates, deletes) into the current state.

:func:`replay` is the generic operator, :func:`effective_changes` turns staged commands and
run lifecycles into such a feed, :func:`published_units` puts both together.

The replay is ordered per key. A key's history is cut into segments of SEGMENT sequence
numbers; within one segment the changes are sorted by sequence and folded by a small state
machine, and the segments' results are then combined in their order. A key that holds a
third of all changes is thereby replayed by many tasks, and none holds more than SEGMENT
changes of a key at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sequence numbers that one fold takes at most.
SEGMENT = 4096


def replay(changes: DataFrame, key: list[str], seq: str, op: str, columns: list[str], state: DataFrame | None = None) -> DataFrame:
    """The state after all changes took effect once, in order of seq.

    ``op`` is ``set`` (insert or partial update: a null column is left as it is) or ``del``.
    Returns key, columns, and what a later call needs as ``state``: ``_seqs`` (the sequence
    that supplied each column), ``_set`` and ``_del`` (the last one of each kind). Rows with
    ``_live`` false are deleted keys; they are kept so that late changes can be judged.

    Late and repeated changes: a change is applied where its sequence says, however late it
    arrives; one that is already applied has no effect. Of several different changes with
    one key and sequence the greatest (op, columns) counts. Changes without a sequence, and
    operations that are neither, are ignored. Null key parts are values of their own.
    """
    value = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    feed = changes.where(F.col(seq).isNotNull() & F.col(op).isin("set", "del")).select(*key, F.col(seq).cast("bigint").alias("_s"), F.col(op).alias("_op"), value.alias("_v"))
    once = feed.groupBy(*key, "_s").agg(F.max(F.struct("_op", "_v")).alias("_c"))
    ordered = (
        once.withColumn("_seg", F.floor(F.col("_s") / SEGMENT))
        .groupBy(*key, "_seg")
        .agg(F.sort_array(F.collect_list(F.struct("_s", F.col("_c._op").alias("_op"), F.col("_c._v").alias("_v")))).alias("_log"))
    )
    none = F.lit(None).cast("bigint")
    types = {f.name: f.dataType for f in changes.schema.fields}

    def start() -> Column:
        cells = [F.struct(none.alias("s"), F.lit(None).cast(types[c]).alias("v")).alias(f"c{i}") for i, c in enumerate(columns)]
        return F.struct(none.alias("set"), none.alias("del"), F.struct(*cells).alias("cells"))

    def step(acc: Column, x: Column) -> Column:
        gone = x["_op"] == "del"
        cells = []
        for i, c in enumerate(columns):
            old, new = acc["cells"][f"c{i}"], x["_v"][f"c{i}"]
            empty = F.struct(none.alias("s"), F.lit(None).cast(types[c]).alias("v"))
            cells.append(F.when(gone, empty).when(new.isNotNull(), F.struct(x["_s"].alias("s"), new.alias("v"))).otherwise(old).alias(f"c{i}"))
        return F.struct(F.when(gone, acc["set"]).otherwise(x["_s"]).alias("set"), F.when(gone, x["_s"]).otherwise(acc["del"]).alias("del"), F.struct(*cells).alias("cells"))

    folded = ordered.select(*key, F.aggregate("_log", start(), step).alias("_r"))
    parts = folded.select(*key, F.col("_r.set").alias("_set"), F.col("_r.del").alias("_del"), *[F.col(f"_r.cells.c{i}").alias(f"_c{i}") for i in range(len(columns))])
    if state is not None:
        cells = [F.struct(F.col("_seqs")[i].alias("s"), F.col(c).alias("v")).alias(f"_c{i}") for i, c in enumerate(columns)]
        parts = parts.unionByName(state.select(*key, "_set", "_del", *cells))
    merged = parts.groupBy(*key).agg(F.max("_set").alias("_set"), F.max("_del").alias("_del"), *[F.max_by(f"_c{i}", F.col(f"_c{i}.s")).alias(f"_c{i}") for i in range(len(columns))])
    live = F.col("_set").isNotNull() & (F.col("_del").isNull() | (F.col("_set") > F.col("_del")))

    def kept(i: int) -> Column:
        return F.col(f"_c{i}.s").isNotNull() & (F.col("_del").isNull() | (F.col(f"_c{i}.s") > F.col("_del")))

    return merged.select(
        *key,
        *[F.when(kept(i), F.col(f"_c{i}.v")).alias(c) for i, c in enumerate(columns)],
        F.array(*[F.when(kept(i), F.col(f"_c{i}.s")) for i in range(len(columns))]).alias("_seqs"),
        "_set",
        "_del",
        live.alias("_live"),
    )


def effective_changes(log: DataFrame) -> DataFrame:
    """(repo_id, plugin_id, unit_id, at, op, seq): when each unit command takes effect.

    ``replace`` and ``delete`` act at their own sequence. A staged command waits in its run
    and acts at the sequence of the run's first end, if that is a ``complete``; what is
    staged after the end, in a run that ends otherwise, or in one that never ends, is
    dropped. The identity of a contribution is that of its origin; the columns beside it
    serve only where the origin lacks a value. Repeated deliveries count once.
    """
    origin = F.col("replacement")
    unit = log.select(
        F.coalesce(origin["repo_id"], "repo_id").alias("repo_id"),
        F.coalesce(origin["plugin_id"], "plugin_id").alias("plugin_id"),
        F.coalesce(origin["unit_id"], "unit_id").alias("unit_id"),
        F.coalesce(origin["run_id"], "run_id").alias("run_id"),
        "kind",
        "seq",
    ).where(F.col("kind").isin("replace", "delete", "stage-replace", "stage-delete"))
    op = F.when(F.col("kind").endswith("replace"), "set").otherwise("del")
    direct = unit.where(F.col("kind").isin("replace", "delete")).select("repo_id", "plugin_id", "unit_id", F.col("seq").alias("at"), op.alias("op"), "seq")
    ends = (
        log.where((F.col("kind") == "complete") | ((F.col("kind") == "run") & (F.col("run_status") != "Running")))
        .groupBy("repo_id", "run_id")
        .agg(F.min(F.struct("seq", "kind")).alias("end"))
        .where("end.kind = 'complete'")
        .select("repo_id", "run_id", F.col("end.seq").alias("end"))
    )
    # One row per run, plugin and unit reaches the join: the last of its commands before the end.
    staged = unit.where(F.col("kind").startswith("stage-")).select("repo_id", "run_id", "plugin_id", "unit_id", op.alias("op"), "seq")
    acting = (
        staged.join(ends, ["repo_id", "run_id"])
        .where("seq < end")
        .groupBy("repo_id", "run_id", "plugin_id", "unit_id", "end")
        .agg(F.max(F.struct("seq", "op")).alias("c"))
        .select("repo_id", "plugin_id", "unit_id", F.col("end").alias("at"), F.col("c.op").alias("op"), F.col("c.seq").alias("seq"))
    )
    return direct.unionByName(acting)


def published_units(log: DataFrame) -> DataFrame:
    """(repo_id, plugin_id, unit_id, seq): the units published after the whole log."""
    state = replay(effective_changes(log), ["repo_id", "plugin_id", "unit_id"], "at", "op", ["seq"])
    return state.where("_live").select("repo_id", "plugin_id", "unit_id", "seq")
