import random
from collections import deque

import pytest

from factloom.operators import traverse as t
from factloom.plans.mirror import Mirror, MirrorError

EDGES = "repo_id string, edge_id string, source_id string, target_id string, kind string, ev_quality string"


def model(edges, start, direction, kinds, depth, max_nodes, max_edges):
    """A sequential walk with a queue."""
    nodes, kept, flags, examined, looked, omitted, reached = [start], [], 0, 0, 0, 0, 0
    queue = deque([(start, 0)])
    while queue:
        node, d = queue.popleft()
        examined += 1
        reached = max(reached, d)
        adj = {}
        for i, s, g, k in edges:
            if (not kinds or k in kinds) and ((direction != "Incoming" and s == node) or (direction != "Outgoing" and g == node)):
                adj[i] = (k, s, g, i)
        if d == depth:
            if adj:
                flags |= t.MAX_DEPTH
                omitted += len(adj)
            continue
        for k, s, g, i in sorted(adj.values()):
            looked += 1
            other = g if s == node else s
            if other not in nodes and len(nodes) >= max_nodes:
                flags |= t.MAX_NODES
                omitted += 1
                continue
            if i not in kept:
                if len(kept) >= max_edges:
                    flags |= t.MAX_EDGES
                    break
                kept.append(i)
            if other not in nodes:
                nodes.append(other)
                queue.append((other, d + 1))
        if flags and len(kept) == max_edges:
            break
    return nodes, kept, (flags, examined, looked, omitted, reached)


def graph(rng):
    n = rng.randrange(1, 8)
    return [(f"e{i}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["calls", "references"])) for i in range(rng.randrange(0, 16))]


@pytest.mark.parametrize(("case", "whole"), [*((i, t.WHOLE) for i in range(8)), *((i, 0) for i in range(3))])
def test_equals_sequential_walk(spark, monkeypatch, case, whole):
    monkeypatch.setattr(t, "WHOLE", whole)
    monkeypatch.setattr(t, "SEEDS", 7)
    rng = random.Random(case)
    direction = ["Outgoing", "Incoming", "Both"][case % 3]
    kinds = rng.choice([(), (), ("calls",)])
    depth, max_nodes, max_edges = rng.choice([0, 1, 2, 3]) if case > 2 else 3, rng.randrange(1, 6), rng.randrange(1, 7)
    graphs = {f"r{g}": graph(rng) for g in range(60)}
    rows = [(r, *e[:3], e[3], "Resolved") for r, es in graphs.items() for e in es]
    seeds = spark.createDataFrame([(r, r, "n0") for r in graphs], "seed string, repo_id string, node_id string")
    got = t.traverse(spark.createDataFrame(rows + rows[:20], EDGES), seeds, direction, kinds, (), depth, max_nodes, max_edges)
    nodes, edges = {}, {}
    for x in sorted(got.nodes.collect(), key=lambda x: x.ord):
        nodes.setdefault(x.seed, []).append(x.node_id)
    for x in sorted(got.edges.collect(), key=lambda x: x.ord):
        edges.setdefault(x.seed, []).append(x.edge_id)
    stats = {x.seed: (x.flags, x.nodes_examined, x.edges_examined, x.omitted, x.depth_reached) for x in got.stats.collect()}
    for r, es in graphs.items():
        want = model(es, "n0", direction, kinds, depth, max_nodes, max_edges)
        assert (nodes[r], edges.get(r, []), stats[r]) == want, (r, es, direction, kinds, depth, max_nodes, max_edges)


def test_evidence_is_a_filter_of_navigation(spark):
    rows = [("r", "1", "file", "caller", "declares", "Structural"), ("r", "2", "caller", "callee", "calls", "Resolved")]
    seeds = spark.createDataFrame([("s", "r", "file")], "seed string, repo_id string, node_id string")
    df = spark.createDataFrame(rows, EDGES)
    assert t.traverse(df, seeds, max_depth=2, qualities=("Resolved",)).edges.count() == 0
    assert t.traverse(df, seeds, max_depth=2).edges.count() == 2
    with pytest.raises(ValueError):
        t.traverse(df, seeds, max_nodes=0)


def test_unknown_seeds_give_nothing(spark):
    df = spark.createDataFrame([("r", "e", "a", "b", "calls", "Resolved")], EDGES)
    seeds = spark.createDataFrame([("s1", "r", "a"), ("s2", "r", "zzz"), ("s3", "q", "a")], "seed string, repo_id string, node_id string")
    nodes = spark.createDataFrame([("r", "a"), ("r", "b")], "repo_id string, node_id string")
    got = t.traverse(df, seeds, nodes=nodes)
    assert {(r.seed, r.node_id) for r in got.nodes.collect()} == {("s1", "a"), ("s1", "b")}
    assert {(r.seed, r.nodes, r.truncated) for r in got.stats.collect()} == {("s1", 2, False), ("s2", 0, False), ("s3", 0, False)}


def test_mirror(spark, tmp_path):
    rows = [("r", f"e{i}", f"n{i % 7}", f"n{i * 3 % 11}", ("calls", "inherits")[i % 2], "Resolved") for i in range(40)] + [("r", "loop", "n1", "n1", "calls", "Resolved")]
    df = spark.createDataFrame(rows, EDGES)
    seeds = spark.createDataFrame([("s", "r", "n1")], "seed string, repo_id string, node_id string")
    mirror = Mirror(spark, f"{tmp_path}/m")
    with pytest.raises(MirrorError, match="mirror.missing"):
        mirror.adjacency("1")
    mirror.build(df, "1")
    for direction in ("Outgoing", "Incoming", "Both"):
        for kinds in ((), ("calls",)):
            a, b = (t.traverse(*x, direction, kinds, (), 3, 6, 9, adj=y) for x, y in (((df, seeds), None), ((None, seeds), mirror.adjacency("1"))))
            for name in ("nodes", "edges", "stats"):
                assert sorted(map(tuple, getattr(a, name).collect())) == sorted(map(tuple, getattr(b, name).collect()))
    mirror.build(df.where("edge_id = 'loop'"), "2")
    with pytest.raises(MirrorError, match="mirror.stale"):
        mirror.adjacency("1")
    assert mirror.adjacency("2").count() == 2 and len([x for x in mirror.folder.names() if x.startswith("adjacency-")]) == 1
    mirror.drop()
    assert mirror.version() is None
