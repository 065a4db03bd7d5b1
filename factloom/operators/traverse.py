"""Bounded breadth-first traversal of the fact graph, for any number of seeds at once.

The result equals that of a sequential walk with a queue, whose budgets are charged edge by
edge; but each level is a few joins and aggregates. The order in which a walk would look at
edges is (position of the node in the queue, rank of the edge at the node). From the least
such place of each neighbour and edge follow, per seed: which neighbours still fit, which edges
are kept, where the walk stops, and what it had examined until then.

Ranks of edges at their nodes are computed by range partitions with offsets, so the edges of a
hub are ranked by many tasks. Selections of the first few per seed use windows with a constant
limit, which Spark applies before the shuffle.

Repositories whose walkable edges fit into one task (WHOLE rows) are walked there, seed by seed
and chunks of SEEDS seeds at a time; the joins are for all others. Both ways give the same rows.

Defined results: a seed that is no node of its repository gives no rows and an untruncated
statistic; repeated edge ids count once; edges with a null end are not walked.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

MAX_DEPTH, MAX_NODES, MAX_EDGES = 1, 2, 4
#: Rows of adjacency and seeds that one task takes at most.
WHOLE, SEEDS = 100_000, 1_000
ORDER = ["kind", "source_id", "target_id", "edge_id"]
WALK = "seed string, repo_id string, found array<struct<node_id:string,ord:bigint,depth:int>>, kept array<struct<edge_id:string,ord:bigint>>, flags int, nodes_examined bigint, edges_examined bigint, omitted bigint, depth_reached int"


@dataclass(frozen=True)
class Traversal:
    """nodes (seed, repo_id, node_id, ord, depth), edges (seed, edge_id, ord), stats (one row per seed)."""

    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame


def ranked(df: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """df with the rank (from 1) of each row in its group, whatever the group's size."""
    keys = [*group, *order]
    spread = cut(df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    local = Window.partitionBy("_p", *group).orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("_p", *group).agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = spread.withColumn("_r", F.row_number().over(local)).join(offsets, ["_p", *group])
    return out.withColumn(into, (F.col("_r") + F.col("_o")).cast("bigint")).drop("_p", "_r", "_o")


def adjacency(edges: DataFrame) -> DataFrame:
    """(repo_id, node, neighbour, edge_id, kind, ev_quality, outgoing, a): the edges at each node, both ways, in their order.

    The order holds for every direction and every filter on kinds and qualities, so one adjacency
    serves all walks; :class:`factloom.plans.mirror.Mirror` keeps it for a publication.
    """
    out = ranked(_ways(edges), ["repo_id", "node"], [*ORDER, "outgoing"], "a")
    return out.select("repo_id", "node", "neighbour", "edge_id", "kind", "ev_quality", "outgoing", "a")


def _ways(edges: DataFrame) -> DataFrame:
    """Each distinct edge at both of its ends."""
    e = edges.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    e = e.groupBy("repo_id", "edge_id").agg(F.min(F.struct("kind", "source_id", "target_id", "ev_quality")).alias("x")).select("repo_id", "edge_id", "x.*")
    ways = F.array(F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), F.lit(True).alias("outgoing")), F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), F.lit(False).alias("outgoing")))
    return e.select("repo_id", "edge_id", "kind", "ev_quality", "source_id", "target_id", F.explode(ways).alias("w")).select("repo_id", "edge_id", "kind", "ev_quality", "source_id", "target_id", "w.*")


def walked(adj: DataFrame, direction: str, kinds: tuple[str, ...] = (), qualities: tuple[str, ...] = ()) -> DataFrame:
    """The rows of an adjacency that a walk may take; a loop counts once.

    Filters are filters of navigation: an edge that is filtered out is not walked at all.
    """
    one = {"Outgoing": F.col("outgoing"), "Incoming": ~F.col("outgoing"), "Both": F.col("outgoing") | (F.col("node") != F.col("neighbour"))}[direction]
    if kinds:
        one = one & F.col("kind").isin(*kinds)
    if qualities:
        one = one & F.col("ev_quality").isin(*qualities)
    return adj.where(one)


def _walk(out: dict, index: dict, start: str, max_depth: int, max_nodes: int, max_edges: int) -> tuple:
    """One walk with a queue: nodes with depths, edges, flags and counters."""
    nodes, kept = {start: 0}, {}
    order, flags, looked, omitted, examined, reached = [start], 0, 0, 0, 0, 0
    for node in order:  # grows while it is walked
        depth = nodes[node]
        examined, reached = examined + 1, depth
        neighbours, ids = out.get(node, ((), ()))
        if depth == max_depth:
            if ids:
                flags |= MAX_DEPTH
                omitted += len(ids)
            continue
        at, n = 0, len(ids)
        while at < n:
            if len(nodes) >= max_nodes and n - at > 4 * max_nodes:
                # The budget of nodes is spent: of all further edges only those to known nodes matter.
                if node not in index:
                    where = index[node] = {}
                    for i, x in enumerate(neighbours):
                        where.setdefault(x, []).append(i)
                rest, spent = sorted(i for x in nodes for i in index[node].get(x, ()) if i >= at), False
                for done, i in enumerate(rest):
                    if ids[i] not in kept:
                        if len(kept) >= max_edges:
                            flags |= MAX_EDGES | (MAX_NODES if i - at > done else 0)
                            looked += i - at + 1
                            omitted += i - at - done
                            spent = True
                            break
                        kept[ids[i]] = len(kept)
                if not spent:
                    looked += n - at
                    if n - at > len(rest):
                        flags |= MAX_NODES
                        omitted += n - at - len(rest)
                break
            other, edge = neighbours[at], ids[at]
            at += 1
            looked += 1
            if other not in nodes and len(nodes) >= max_nodes:
                flags |= MAX_NODES
                omitted += 1
                continue
            if edge not in kept:
                if len(kept) >= max_edges:
                    flags |= MAX_EDGES
                    break
                kept[edge] = len(kept)
            if other not in nodes:
                nodes[other] = depth + 1
                order.append(other)
        if flags and len(kept) == max_edges:
            break
    return [(x, i, nodes[x]) for i, x in enumerate(order)], list(kept.items()), flags, examined, looked, omitted, reached


def _walks(order: list[str], *budgets: int):
    """The walks of one chunk of a repository's seeds."""

    def run(key: tuple, seeds: pd.DataFrame, adj: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, tuple[list[str], list[str]]] = {}
        index: dict = {}
        adj = adj.sort_values(order)
        for node, neighbour, edge in zip(adj["node"], adj["neighbour"], adj["edge_id"]):
            a, b = out.setdefault(node, ([], []))
            a.append(neighbour)
            b.append(edge)
        rows = [(seed, key[0], *_walk(out, index, node, *budgets)) for seed, node in zip(seeds["seed"], seeds["node_id"])]
        return pd.DataFrame(rows, columns=["seed", "repo_id", "found", "kept", "flags", "nodes_examined", "edges_examined", "omitted", "depth_reached"])

    return run


def _whole(adj: DataFrame, known: DataFrame, order: list[str], *budgets: int) -> tuple[DataFrame, DataFrame]:
    """The seeds that are walked in whole repositories, and their walks (schema WALK)."""
    few = adj.groupBy("repo_id").agg(F.count("*").alias("k")).where(F.col("k") > WHOLE).select("repo_id")
    mine = known.where("repo_id is not null").join(few, "repo_id", "left_anti")
    chunks = mine.groupBy("repo_id").agg(F.ceil(F.count("*") / SEEDS).cast("int").alias("k"))
    left = mine.join(chunks, "repo_id").withColumn("chunk", F.pmod(F.xxhash64("seed", "node_id"), "k").cast("int"))
    right = adj.join(chunks, "repo_id").select(F.col("repo_id").alias("r"), "node", "neighbour", *order, *([] if "edge_id" in order else ["edge_id"]), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"))
    walks = left.select("seed", F.col("repo_id"), "node_id", "chunk").groupBy("repo_id", "chunk").cogroup(right.groupBy("r", "c")).applyInPandas(_walks(order, *budgets), WALK)
    return mine, cut(walks)


def traverse(edges: DataFrame, seeds: DataFrame, direction: str = "Outgoing", kinds: tuple[str, ...] = (), qualities: tuple[str, ...] = (), max_depth: int = 1, max_nodes: int = 100, max_edges: int = 250, nodes: DataFrame | None = None, adj: DataFrame | None = None) -> Traversal:
    """Walks from each seed (seed, repo_id, node_id), each with budgets of its own.

    With nodes (repo_id, node_id), seeds that are none of them give no rows. adj: an adjacency
    that was built before; edges are not looked at then.
    """
    if max_depth < 0 or max_nodes < 1 or max_edges < 1:
        raise ValueError("max_depth must be at least 0, max_nodes and max_edges at least 1")
    asked = seeds.select("seed", "repo_id", "node_id").distinct()
    known = cut(asked if nodes is None else asked.join(nodes.select("repo_id", "node_id"), ["repo_id", "node_id"], "left_semi"))
    rows, order = (_ways(edges), ORDER) if adj is None else (adj, ["a"])
    mine, walks = _whole(walked(rows, direction, kinds, qualities), known, order, max_depth, max_nodes, max_edges)
    rest = cut(asked.join(mine, asked.columns, "left_anti"))
    here = Traversal(
        walks.select("seed", "repo_id", F.explode("found").alias("x")).select("seed", "repo_id", "x.node_id", "x.ord", "x.depth"),
        walks.select("seed", F.explode("kept").alias("x")).select("seed", "x.edge_id", "x.ord"),
        walks.select("seed", F.size("found").cast("bigint").alias("nodes"), F.size("kept").cast("bigint").alias("edges"), "flags", "nodes_examined", "edges_examined", "omitted", "depth_reached", (F.col("flags") > 0).alias("truncated")),
    )
    if rest.isEmpty():
        return here
    known = known.join(rest, known.columns, "left_semi")
    there = _by_joins(walked(cut(adjacency(edges)) if adj is None else adj, direction, kinds, qualities), rest, known, max_depth, max_nodes, max_edges)
    return Traversal(*[getattr(here, x).unionByName(getattr(there, x)) for x in ("nodes", "edges", "stats")])


def _by_joins(adj: DataFrame, asked: DataFrame, known: DataFrame, max_depth: int, max_nodes: int, max_edges: int) -> Traversal:
    """The walks of all asked seeds level by level, by joins alone."""
    visited = cut(known.select("seed", "repo_id", F.col("node_id").alias("node"), F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("depth")).distinct())
    kept = visited.select("seed", F.lit("").alias("edge_id"), F.lit(0).cast("bigint").alias("ord")).limit(0)
    zero = F.lit(0).cast("bigint")
    found = asked.select("seed").distinct().join(visited.select("seed", F.lit(1).cast("bigint").alias("n")).distinct(), "seed", "left")
    stats = cut(found.select("seed", F.coalesce("n", F.lit(0)).cast("bigint").alias("nodes"), zero.alias("edges"), F.lit(0).alias("flags"), zero.alias("nodes_examined"), zero.alias("edges_examined"), zero.alias("omitted"), F.lit(0).alias("depth_reached"), F.lit(False).alias("stopped")))
    frontier = visited.select("seed", "repo_id", "node", F.col("ord").alias("pos"))
    here: Column = F.struct("pos", "a")
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        """Kept for this level only; what is lost with an executor is computed again from the last cut."""
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    for depth in range(max_depth + 1):
        at = frontier.join(stats.where("not stopped").select("seed"), "seed")
        if depth == max_depth:
            reached = at.select("repo_id", "node").distinct()
            beyond = adj.join(reached, ["repo_id", "node"], "left_semi").groupBy("repo_id", "node").agg(F.count("*").alias("k"))
            last = at.join(beyond, ["repo_id", "node"], "left").groupBy("seed").agg(F.count("*").alias("n"), F.sum(F.coalesce("k", zero)).alias("k"))
            stats = stats.join(last, "seed", "left").select(
                "seed", "nodes", "edges", F.when(F.col("k") > 0, F.col("flags").bitwiseOR(F.lit(MAX_DEPTH))).otherwise(F.col("flags")).alias("flags"),
                (F.col("nodes_examined") + F.coalesce("n", zero)).alias("nodes_examined"), "edges_examined", (F.col("omitted") + F.coalesce("k", zero)).alias("omitted"),
                F.when(F.col("n") > 0, F.lit(depth)).otherwise(F.col("depth_reached")).alias("depth_reached"), "stopped",
            )
            break
        rows = at.join(adj, ["repo_id", "node"]).select("seed", "repo_id", "pos", "a", "neighbour", "edge_id")
        rows = rows.join(visited.select("seed", "repo_id", F.col("node").alias("neighbour"), F.lit(True).alias("old")), ["seed", "repo_id", "neighbour"], "left")
        rows = hold(rows.join(kept.select("seed", "edge_id", F.lit(True).alias("had")), ["seed", "edge_id"], "left").withColumns({"old": F.coalesce("old", F.lit(False)), "had": F.coalesce("had", F.lit(False))}))
        first = Window.partitionBy("seed").orderBy("first")
        # Neighbours that still fit into the node budget.
        fresh = rows.where("not old").groupBy("seed", "repo_id", "neighbour").agg(F.min(here).alias("first"))
        fresh = fresh.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= max_nodes)
        accepted = hold(fresh.join(stats.select("seed", "nodes"), "seed").where(F.col("rn") <= max_nodes - F.col("nodes")).select("seed", "repo_id", "neighbour", "first", "rn"))
        rows = hold(rows.join(accepted.select("seed", "repo_id", "neighbour", F.lit(True).alias("fits")), ["seed", "repo_id", "neighbour"], "left").withColumn("lost", ~F.col("old") & F.col("fits").isNull()).drop("fits"))
        # New edges, in order; the one beyond the edge budget is where the walk breaks off.
        news = rows.where("not lost and not had").groupBy("seed", "edge_id").agg(F.min(here).alias("first"))
        news = news.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= max_edges + 1)
        news = hold(news.join(stats.select("seed", "edges", "flags"), "seed").withColumn("room", max_edges - F.col("edges")).where(F.col("rn") <= F.col("room") + 1))
        # Where the walk of a seed ends: at the row that is cut off, or behind the first node at whose
        # end all edges are spent and something was left out before.
        marks = news.groupBy("seed").agg(F.min(F.when(F.col("rn") == F.col("room") + 1, F.col("first"))).alias("cut"), F.min(F.when(F.col("rn") == F.col("room"), F.col("first.pos"))).alias("spent"))
        lost = rows.where("lost").groupBy("seed").agg(F.min("pos").alias("lost_pos"))
        span = at.groupBy("seed").agg(F.min("pos").alias("pos0"))
        ends = span.join(stats.select("seed", "edges", "flags"), "seed").join(marks, "seed", "left").join(lost, "seed", "left")
        spent = F.when(F.col("edges") >= max_edges, F.col("pos0")).otherwise(F.col("spent"))
        quiet = F.when(F.col("flags") > 0, spent).otherwise(F.greatest(spent, F.when(spent.isNotNull(), F.col("lost_pos"))))
        quiet = F.when(spent.isNotNull() & ((F.col("flags") > 0) | F.col("lost_pos").isNotNull()), quiet)
        # A quiet end that lies before the cut-off row comes first.
        cut_first = F.col("cut").isNotNull() & (quiet.isNull() | (F.col("cut.pos") <= quiet))
        ends = hold(ends.select("seed", F.when(cut_first, F.col("cut.pos")).otherwise(quiet).alias("stop_pos"), F.when(cut_first, F.col("cut")).alias("cut_at")))
        inside = F.col("stop_pos").isNull() | (F.col("pos") < F.col("stop_pos")) | ((F.col("pos") == F.col("stop_pos")) & (F.col("cut_at").isNull() | (here <= F.col("cut_at"))))
        seen = rows.join(ends, "seed").where(inside).groupBy("seed").agg(F.count("*").alias("e"), F.sum(F.col("lost").cast("bigint")).alias("l"))
        nodes_seen = at.join(ends, "seed").where(F.col("stop_pos").isNull() | (F.col("pos") <= F.col("stop_pos"))).groupBy("seed").agg(F.count("*").alias("n"))
        reached = F.col("stop_pos").isNull() | F.when(F.col("cut_at").isNotNull(), F.col("first") < F.col("cut_at")).otherwise(F.col("first.pos") <= F.col("stop_pos"))
        new_nodes = accepted.join(ends, "seed").where(reached).join(stats.select("seed", "nodes"), "seed").select("seed", "repo_id", F.col("neighbour").alias("node"), (F.col("nodes") + F.col("rn") - 1).cast("bigint").alias("ord"), F.lit(depth + 1).alias("depth"))
        new_nodes = cut(new_nodes)
        new_edges = cut(news.where("rn <= room").join(ends, "seed").where(reached).select("seed", "edge_id", (F.col("edges") + F.col("rn") - 1).cast("bigint").alias("ord")))
        visited, kept = visited.unionByName(new_nodes), kept.unionByName(new_edges)
        counts = (
            stats.join(seen, "seed", "left").join(nodes_seen, "seed", "left").join(ends, "seed", "left")
            .join(new_nodes.groupBy("seed").agg(F.count("*").alias("nn")), "seed", "left")
            .join(new_edges.groupBy("seed").agg(F.count("*").alias("ne")), "seed", "left")
        )
        add = lambda c, d: (F.col(c) + F.coalesce(d, zero)).alias(c)
        flags = F.col("flags").bitwiseOR(F.when(F.col("l") > 0, F.lit(MAX_NODES)).otherwise(0)).bitwiseOR(F.when(F.col("cut_at").isNotNull(), F.lit(MAX_EDGES)).otherwise(0))
        stats = cut(counts.select("seed", add("nodes", "nn"), add("edges", "ne"), flags.alias("flags"), add("nodes_examined", "n"), add("edges_examined", "e"), add("omitted", "l"), F.when(F.col("n") > 0, F.lit(depth)).otherwise(F.col("depth_reached")).alias("depth_reached"), (F.col("stopped") | F.col("stop_pos").isNotNull()).alias("stopped")))
        while held:
            held.pop().unpersist()
        frontier = new_nodes.select("seed", "repo_id", "node", F.col("ord").alias("pos"))
        if frontier.isEmpty():
            break
    return Traversal(visited.withColumnRenamed("node", "node_id"), kept, stats.drop("stopped").withColumn("truncated", F.col("flags") > 0))
