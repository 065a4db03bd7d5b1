"""Source plans, freshness, ownership, index identities, coverage and the fold of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .changes import committed_sources, current_sources, last_successful, norm_digest, norm_path, plan_changes

__all__ = ["committed_sources", "current_sources", "last_successful", "norm_digest", "norm_path", "plan_changes"]

STATUSES = ("New", "Changed", "Unchanged", "Deleted")


def source_plan(current: DataFrame, previous: DataFrame, plugins: tuple[str, ...] = ()) -> DataFrame:
    """(repo_id, plugin_id, path, status): inventories (repo_id, plugin_id, path, plugin_version, hash) compared by (plugin, path).

    Another plugin version counts as a change. With plugins, only theirs are planned,
    deletions included. A key that one inventory holds twice is an error of the inventory;
    see :func:`duplicate_sources`.
    """
    key = ["repo_id", "plugin_id", "path"]
    if plugins:
        current, previous = (df.where(F.col("plugin_id").isin(*plugins)) for df in (current, previous))
    a = current.select(*key, F.struct("plugin_version", "hash").alias("now"))
    b = previous.select(*key, F.struct("plugin_version", "hash").alias("was"))
    status = F.when(F.col("was").isNull(), "New").when(F.col("now").isNull(), "Deleted").when(F.col("now") == F.col("was"), "Unchanged").otherwise("Changed")
    return a.join(b, key, "full").select(*key, status.alias("status"))


def duplicate_sources(inventory: DataFrame) -> DataFrame:
    """Keys that an inventory holds more than once."""
    return inventory.groupBy("repo_id", "plugin_id", "path").count().where("count > 1").select("repo_id", "plugin_id", "path")


def plan_counts(plan: DataFrame) -> DataFrame:
    """(repo_id, new, changed, unchanged, deleted)."""
    return plan.groupBy("repo_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])


def freshness(plan: DataFrame, known: DataFrame) -> DataFrame:
    """(repo_id, state, ...counts): Unknown where nothing was published, else Fresh or Stale; known: (repo_id)."""
    counts = plan_counts(plan).join(known.select("repo_id", F.lit(True).alias("known")).distinct(), "repo_id", "left")
    state = F.when(F.col("known").isNull(), "Unknown").when(F.col("new") + F.col("changed") + F.col("deleted") == 0, "Fresh").otherwise("Stale")
    return counts.select("repo_id", state.alias("state"), "new", "changed", "unchanged", "deleted")


def retained(previous: DataFrame, current: DataFrame, in_scope: tuple[str, ...]) -> DataFrame:
    """Previous sources whose plugin does not run now and whose path no current source covers."""
    rest = previous.where(~F.col("plugin_id").isin(*in_scope)) if in_scope else previous
    return rest.join(current.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")


def ownerless_units(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Published units of plugins that own no path in the new state."""
    return units.join(sources.select("repo_id", "plugin_id").distinct(), ["repo_id", "plugin_id"], "left_anti")


def overlay(published: DataFrame, staged: DataFrame, deleted: DataFrame) -> DataFrame:
    """Units after a run: published ones without those deleted or replaced, and the staged ones."""
    key = ["repo_id", "plugin_id", "unit_id"]
    gone = deleted.select(*key).unionByName(staged.select(*key)).distinct()
    return published.join(gone, key, "left_anti").unionByName(staged)


def obsolete_units(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Units of the previous state that the present one no longer has."""
    key = ["repo_id", "plugin_id", "unit_id"]
    return previous.select(*key).distinct().join(current.select(*key), key, "left_anti")


def live_source_first(sources: DataFrame) -> DataFrame:
    """One row per (repo_id, path) of (repo_id, path, plugin_id, deleted): a live source before a deletion, then the least plugin."""
    return sources.groupBy("repo_id", "path").agg(F.min(F.struct("deleted", "plugin_id")).alias("x")).select("repo_id", "path", "x.plugin_id", "x.deleted")


def index_identity(repo: Column, consistent: Column, snapshot: Column, sources: Column) -> Column:
    """The content address of a state: a digest over its header and its sources in the order (plugin, path).

    sources: array of structs (plugin_id, plugin_version, path, hash). Equal content has an
    equal identity, whichever run recorded it. Sources that a state lists twice count twice.
    """
    header = F.concat(repo, F.lit("\n"), F.when(consistent, "True").otherwise("False"), F.lit("\n"), F.coalesce(snapshot, F.lit("")), F.lit("\n"))
    by = F.transform(sources, lambda s: F.struct(s["plugin_id"].alias("p"), s["path"].alias("q"), s["plugin_version"].alias("v"), s["hash"].alias("h")))
    lines = F.transform(F.array_sort(by), lambda s: F.concat(s["p"], F.lit("\t"), s["v"], F.lit("\t"), s["q"], F.lit("\t"), s["h"], F.lit("\n")))
    return F.sha2(F.concat(header, F.array_join(lines, "")), 256)


def log_fold(log: DataFrame, slot: list[str], seq: str, value: list[str]) -> DataFrame:
    """The last value of each slot, by sequence; ties: the greatest value."""
    last = log.groupBy(*slot).agg(F.max(F.struct(seq, *value)).alias("x"))
    return last.select(*slot, *[F.col(f"x.{c}").alias(c) for c in (seq, *value)])


def coverage(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, plugin_id, kind, emitted, internal, cross_project, unresolved), kind null: the plugin's total, plugin null: the repository's.

    An edge is internal if its target is a node that its own unit contributes, cross-project
    if only other units do, unresolved if none does.
    """
    e = edges.select("repo_id", "plugin_id", "unit_id", "edge_id", "kind", "target_id").distinct()
    own = nodes.where("deleted_at is null").select("repo_id", "plugin_id", "unit_id", F.col("node_id").alias("target_id")).distinct().withColumn("own", F.lit(True))
    any_ = own.select("repo_id", "target_id").distinct().withColumn("known", F.lit(True))
    j = e.join(own, ["repo_id", "plugin_id", "unit_id", "target_id"], "left").join(any_, ["repo_id", "target_id"], "left")
    counted = j.groupBy("repo_id", "plugin_id", "kind").agg(F.count("*").alias("emitted"), F.count("own").alias("internal"), F.count_if(F.col("own").isNull() & F.col("known").isNotNull()).alias("cross_project"), F.count_if(F.col("known").isNull()).alias("unresolved"))
    names = ("emitted", "internal", "cross_project", "unresolved")
    return counted.rollup("repo_id", "plugin_id", "kind").agg(*[F.sum(n).alias(n) for n in names]).where("repo_id is not null")


def run_diagnostics(runs: DataFrame) -> DataFrame:
    """Per repository: runs, sums of their counters, and the first hundred warning codes in order."""
    last = runs.groupBy("repo_id", "run_id").agg(F.max(F.struct(F.col("status") != "Running", "completed_at", "unresolved_relationships", "unresolved_targets", "changed_count", "warning_codes")).alias("r"))
    sums = [F.sum(F.coalesce(f"r.{c}", F.lit(0))).cast("bigint").alias(c) for c in ("unresolved_relationships", "unresolved_targets", "changed_count")]
    codes = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set("r.warning_codes")))), 1, 100)
    return last.groupBy("repo_id").agg(F.count("*").alias("n_runs"), *sums, F.array_join(codes, ",").alias("warning_codes"))


def health(nodes: DataFrame, declarations: DataFrame, edges: DataFrame, units: DataFrame) -> DataFrame:
    """(repo_id, units, nodes, declarations, edges): distinct facts of each repository."""
    parts = [df.select("repo_id", *key).distinct().groupBy("repo_id").agg(F.count("*").alias(name)) for df, key, name in ((units, ["plugin_id", "unit_id"], "units"), (nodes, ["node_id"], "nodes"), (declarations, ["declaration_id"], "declarations"), (edges, ["edge_id"], "edges"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "repo_id", "full")
    return out.na.fill(0)


def first_per(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
