import random
from datetime import datetime

import pytest

from factloom.operators import orphans as o

T0 = datetime(2025, 1, 31)


def refs(spark, rows):
    return spark.createDataFrame([("node", r, k, "edges", "target_id", i, T0) for r, k, i in rows], o.REFS)


def events(spark, rows):
    """rows: (repo, key, contribution, gone)."""
    return spark.createDataFrame([("node", r, k, c, gone, T0) for r, k, c, gone in rows], o.EVENTS)


def ids(state):
    return {r.ref_id for r in state.orphans().collect()}


def batch(state, n, new_refs, new_events):
    spark = state.spark
    state.append(refs(spark, new_refs), events(spark, new_events), n)
    state.apply(n)
    return ids(state)


def test_waiting_resolved_and_reopened(spark, tmp_path):
    s = o.OrphanState(spark, f"{tmp_path}/s", 4)
    assert batch(s, 0, [("r", "a", "e1"), ("r", "b", "e2"), ("q", "a", "e3")], [("r", "a", 1, False)]) == {"e2", "e3"}
    assert batch(s, 1, [("r", "b", "e4"), ("r", "c", "e5")], [("r", "b", 1, False), ("q", "a", 1, False), ("q", "a", 2, False)]) == {"e5"}
    assert batch(s, 2, [], [("r", "b", 1, True), ("q", "a", 1, True)]) == {"e2", "e4", "e5"}
    assert batch(s, 3, [], []) == {"e2", "e4", "e5"}
    # One contribution of q's a is left until now; a deletion that comes before its contribution counts, too.
    assert batch(s, 4, [("r", "z", "e6")], [("q", "a", 2, True), ("r", "z", 7, True)]) == {"e2", "e3", "e4", "e5", "e6"}
    assert batch(s, 5, [], [("r", "z", 7, False)]) == {"e2", "e3", "e4", "e5", "e6"}
    got = {(r.batch, r.n_orphans) for r in s.snapshots().collect()}
    assert got == {(0, 2), (1, 1), (2, 3), (3, 3), (4, 5), (5, 5)}


def test_events_delivered_again_change_nothing(spark, tmp_path):
    s = o.OrphanState(spark, f"{tmp_path}/s", 4)
    assert batch(s, 0, [("r", "a", "e1")], [("r", "a", 1, False), ("r", "a", 1, False)]) == set()
    assert batch(s, 1, [("r", "a", "e1")], [("r", "a", 1, False)]) == set()
    assert batch(s, 2, [], [("r", "a", 1, True)]) == {"e1"}


def test_only_touched_buckets_are_written(spark, tmp_path):
    s = o.OrphanState(spark, f"{tmp_path}/s", 64)
    batch(s, 0, [("r", f"k{i}", f"e{i}") for i in range(40)], [("r", f"k{i}", 1, False) for i in range(40)])
    batch(s, 1, [("r", "k3", "new")], [("r", "k5", 1, True)])
    assert len(s.folder.names("parents/batch=1")) <= 4  # two buckets, the success marker and its check sum
    batch(s, 2, [], [("r", "k5", 2, False)])
    batch(s, 3, [], [("r", "k5", 2, True)])
    assert ids(s) == {"e5"} and not [b for b in s.folder.names("parents/batch=1") if b.startswith("bucket=") and s._manifest()["parents"][b] != 1]


@pytest.mark.parametrize("step", ["parents", "pending", "counts", "manifest"])
def test_a_batch_broken_off_at_any_step_is_done_again(spark, tmp_path, monkeypatch, step):
    s = o.OrphanState(spark, f"{tmp_path}/s", 4)
    batch(s, 0, [("r", "a", "e1"), ("r", "b", "e2")], [("r", "a", 1, False)])

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        if step == "manifest":
            m.setattr(s.folder, "write", broken)
        elif step == "counts":
            m.setattr(s, "_counted", broken)
        else:
            write = s._write
            m.setattr(s, "_write", lambda df, where, *p, **k: broken() if where.startswith(step) else write(df, where, *p, **k))
        batch(s, 1, [("r", "c", "e3")], [("r", "b", 1, False), ("r", "a", 1, True)])
    assert ids(s) == {"e2"} and s.waiting() == [1]
    again = o.OrphanState(spark, f"{tmp_path}/s", 4)
    assert ids(again.replay()) == {"e1", "e3"} and again.waiting() == []
    again.apply(1)
    assert ids(again) == {"e1", "e3"}


@pytest.mark.parametrize("few", [50_000, 0])
def test_batches_equal_brute_force(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(o, "FEW", few)
    rng = random.Random(5)
    s, all_refs, life = o.OrphanState(spark, f"{tmp_path}/s", 3), [], {}
    for n in range(4):
        new = [(rng.choice(["r", None]), rng.choice(["hot", "a", "b", "c"]), f"e{n}-{i}") for i in range(12)]
        changes = [(rng.choice(["r", None]), rng.choice(["hot", "a", "b"]), rng.randrange(2), rng.random() < 0.4) for _ in range(4)]
        all_refs += new
        for r, k, c, gone in changes:
            life[r, k, c] = life.get((r, k, c), False) or gone
        live = {(r, k) for (r, k, _), gone in life.items() if not gone}
        assert batch(s, n, new, changes) == {i for r, k, i in all_refs if (r, k) not in live}


def test_nulls_repeats_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("r", "e1", None, T0), ("r", "e2", "gone", T0), ("r", "e2", "gone", T0), (None, "e3", "x", None)], "repo_id string, edge_id string, target_id string, written_at timestamp_ntz")
    new = o.references(df, "edges", "node", "edge_id", "written_at", "target_id")
    nodes = spark.createDataFrame([("r", "n", T0, None), ("r", "gone", T0, T0), (None, "x", T0, None)], "repo_id string, node_id string, written_at timestamp_ntz, deleted_at timestamp_ntz")
    from pyspark.sql import functions as F

    s = o.OrphanState(spark, f"{tmp_path}/s")
    s.append(new, o.parent_events(nodes, "node", "node_id", "written_at", "deleted_at"), o.quarter(F.col("at"), 8100))
    s.replay()
    assert ids(s) == {"e2"}
    got = {r.month: (r.n_refs, r.n_orphans) for r in o.orphan_counts(s.refs(), s.pending()).collect()}
    assert got == {"2025-01": (1, 1), None: (1, 0)}


def test_empty(spark, tmp_path):
    s = o.OrphanState(spark, f"{tmp_path}/s")
    assert s.orphans().collect() == s.snapshots().collect() == []
    assert batch(s, 0, [], []) == set()
