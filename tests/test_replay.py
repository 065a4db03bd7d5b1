import random

import pytest

from factloom.operators import replay as r

FEED = "k string, s bigint, op string, a string, b bigint, extra string"


def model(rows):
    state = {}
    for k, s, op, a, b, _ in sorted(rows, key=lambda x: x[1]):
        if op == "del":
            state.pop(k, None)
        else:
            old = state.get(k, (None, None))
            state[k] = (a if a is not None else old[0], b if b is not None else old[1])
    return state


@pytest.mark.parametrize("segment", [2, 4096])
def test_replay_equals_model_in_any_order(spark, monkeypatch, segment):
    monkeypatch.setattr(r, "SEGMENT", segment)
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(4)}", s, rng.choice(["set", "set", "del"]), rng.choice([None, f"a{s}"]), rng.choice([None, s]), "x") for s in range(60)]
    shuffled = rows + rows[::3]
    rng.shuffle(shuffled)
    halves = [shuffled[:30], shuffled[30:]]
    state = None
    for half in halves:
        state = r.replay(spark.createDataFrame(half, FEED), ["k"], "s", "op", ["a", "b"], state)
    got = {x.k: (x.a, x.b) for x in state.where("_live").collect()}
    assert got == model(rows)


def test_replay_ignores_what_it_cannot_order(spark):
    got = r.replay(spark.createDataFrame([("k", None, "set", "a", 1, None), ("k", 3, "noop", "a", 1, None)], FEED), ["k"], "s", "op", ["a", "b"])
    assert got.collect() == []


LOG = "repo_id string, seq bigint, kind string, run_id string, plugin_id string, unit_id string, run_status string, replacement struct<repo_id:string,plugin_id:string,run_id:string,unit_id:string>"


def rep(run, unit):
    return ("r", "p", run, unit)


def test_published_units(spark):
    log = [
        ("r", 1, "run", "A", None, None, "Running", None),
        ("r", 2, "stage-replace", None, None, None, None, rep("A", "u1")),
        ("r", 3, "stage-replace", "B", None, "old", None, rep("A", "u1")),
        ("r", 4, "replace", None, None, None, None, rep(None, "u2")),
        ("r", 5, "stage-delete", "A", "p", "u2", None, None),
        ("r", 6, "stage-replace", None, None, None, None, rep("B", "u3")),
        ("r", 7, "complete", "A", None, None, "Completed", None),
        ("r", 8, "stage-replace", None, None, None, None, rep("A", "u9")),
        ("r", 9, "run", "B", None, None, "Failed", None),
        ("r", 10, "complete", "B", None, None, "Completed", None),
        ("r", 11, "replace", None, None, None, None, rep(None, "u4")),
        ("r", 12, "delete", None, "p", "u4", None, None),
        ("r", 13, "replace", None, None, None, None, rep(None, "u4")),
        ("r", 14, "stage-replace", None, None, None, None, rep("C", "u5")),
    ]
    got = r.published_units(spark.createDataFrame(log[::-1] + log[:6], LOG))
    assert {tuple(x) for x in got.collect()} == {("r", "p", "u1", 3), ("r", "p", "u4", 13)}
    assert r.published_units(spark.createDataFrame([], LOG)).collect() == []
