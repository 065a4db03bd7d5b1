import random

import pytest

from factloom.operators import hierarchy as h

EDGES = "repo_id string, plugin_id string, unit_id string, source_id string, target_id string, kind string"


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def brute(pairs):
    reach = {a: {b} for a, b in pairs for a in (a,)}
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = set()
    for start in out:
        seen, todo = set(), list(out[start])
        while todo:
            x = todo.pop()
            if x == start:
                found.add(start)
                break
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
    return found


@pytest.mark.parametrize("limit", [3, 12, 5_000])
def test_cycles_equal_brute_force(spark, limit):
    rng = random.Random(limit)
    rows, want = [], set()
    for r in range(4):
        n = rng.choice([6, 14, 30])
        pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(int(n * 1.2))]
        rows += [(f"r{r}", "p", f"u{rng.randrange(5)}", a, b, rng.choice(["contains", "declares"])) for a, b in pairs]
        want |= {(f"r{r}", x) for x in brute(pairs)}
    got = h.cycle_nodes(h.hierarchy_links(edges(spark, rows * 2)), limit)
    assert {tuple(r) for r in got.collect()} == want


def test_cycles_by_colour_alone(spark):
    rows = [("r", "p", "u", a, b, "contains") for a, b in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "a")]]
    got = h._classes_by_colour(h.hierarchy_links(edges(spark, rows)))
    assert {(r["node"], r["class"]) for r in got.collect()} == {("a", "c"), ("b", "c"), ("c", "c"), ("d", "e"), ("e", "e")}


@pytest.mark.parametrize("limit", [4, 5_000])
def test_hierarchy(spark, limit):
    chain = [("r", "p", f"u{i % 7}", f"n{i:03}", f"n{i + 1:03}", "contains") for i in range(40)]
    rows = chain + [("r", "p", "u", "a", "n005", "declares"), ("r", "p", "u", "z", "z", "contains"), ("q", "p", "u", "x", "y", "contains"), ("q", "p", "u", "y", "x", "contains"), ("q", "p", "u", "y", "w", "contains"), ("q", "p", "u", None, "w", "contains"), ("q", "p", "u", "k", "w2", "calls")]
    rows += [("s", "p", "u", *x, "contains") for x in (("a", "c"), ("b", "c"), ("c", "d"), ("c", "b"), ("d", "e > f"))]
    got = {(r.repo_id, r.node_id): r for r in h.hierarchy(h.hierarchy_links(edges(spark, rows)), limit).collect()}
    assert len(got) == 42 + 1 + 3 + 5
    # n005 has two parents; the least one, a, counts for its place, both for descendants.
    assert (got["r", "n040"].root_id, got["r", "n040"].depth) == ("a", 36)
    assert got["r", "n006"].path == ["a", "n005", "n006"]
    assert (got["r", "n000"].n_descendants, got["r", "a"].n_descendants) == (40, 36)
    assert (got["r", "z"].root_id, got["r", "z"].depth, got["r", "z"].on_cycle) == ("z", 0, True)
    # A cycle without a way in: each of its nodes is a root.
    assert [got["q", x].path for x in "xyw"] == [["x"], ["y"], ["y", "w"]]
    # One with a way in: its nodes hang below the least parent outside.
    assert [got["s", x].path for x in ("a", "b", "c", "d", "e > f")] == [["a"], ["a", "b"], ["a", "c"], ["a", "c", "d"], ["a", "c", "d", "e > f"]]
    assert {x for x, r in got.items() if r.on_cycle} == {("r", "z"), ("q", "x"), ("q", "y"), ("s", "b"), ("s", "c")}
    assert [got["s", x].n_descendants for x in ("a", "b", "c", "d", "e > f")] == [4, 3, 3, 1, 0]


def test_empty(spark):
    links = h.hierarchy_links(edges(spark, []))
    assert h.cycle_nodes(links).collect() == [] and h.hierarchy(links).collect() == [] and h.descendants(links).collect() == []


def test_no_fragment_above_the_limit(spark):
    """One unit, whether a chain or a star, is split."""
    for rows in ([("r", "p", "u", f"n{i}", f"n{i + 1}", "contains") for i in range(2000)], [("r", "p", "u", "hub", f"n{i}", "contains") for i in range(2000)]):
        sizes = h._fragments(h.hierarchy_links(edges(spark, rows)), 200).groupBy("repo_id", "frag").count().collect()
        assert sum(x["count"] for x in sizes) == 2000 and max(x["count"] for x in sizes) <= 200


@pytest.mark.parametrize(("limit", "hold"), [(12, 1_000_000), (12, 12), (5_000, 1_000_000)])
def test_descendants_over_all_links(spark, limit, hold, monkeypatch):
    monkeypatch.setattr(h, "HOLD", hold)
    rng = random.Random(6)
    rows, want = [], set()
    for r in range(3):
        n = rng.choice([6, 14, 30])
        pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(int(n * 1.2))] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(9)]
        rows += [(f"r{r}", "p", f"u{rng.randrange(5)}", a, b, "contains") for a, b in pairs]
        for start in {a for a, _ in pairs}:
            far, wave = {start}, {start}
            while wave:
                wave = {b for a, b in pairs if a in wave} - far
                far |= wave
            want |= {(f"r{r}", start, x) for x in far if x != start}
    links = h.hierarchy_links(edges(spark, rows * 2))
    got = [tuple(r) for r in h.descendants(links, limit).collect()]
    assert len(got) == len(want) and set(got) == want
    counts = {(r.repo_id, r.node_id): r.n for r in h.descendant_counts(links, limit).collect() if r.n}
    assert counts == {k: sum(1 for w in want if w[:2] == k) for k in {w[:2] for w in want}}


def test_pairs_by_joins_alone(spark):
    links = h.hierarchy_links(edges(spark, [("r", "p", "u", f"n{i}", f"n{(i + 1) % 9}", "contains") for i in range(9)]))
    assert h._pairs_by_joins(links).count() == 72
