from datetime import datetime

import pytest

from factloom.operators import changes as c

SRC = "file_id bigint, repo_id string, plugin_id string, plugin_version string, path string, source_hash string, observed_at timestamp_ntz"
RUNS = "repo_id string, run_id string, status string, completed_at timestamp_ntz"
STATES = "repo_id string, run_id string, recorded_at timestamp_ntz, sources array<struct<plugin_id:string,plugin_version:string,path:string,hash:string>>"


def day(n):
    return datetime(2025, 1, n)


def tables(spark, src, runs, states):
    return spark.createDataFrame(src, SRC), spark.createDataFrame(runs, RUNS), spark.createDataFrame(states, STATES)


CASE = (
    [(1, "r", "p", "1", "a/x.cs", "sha256:aa", day(1)), (2, "r", "p", "1", "a/x.cs", "sha256:bb", day(2)), (3, "r", "p", "2", "b.cs", "sha256:cc", day(1)), (4, "r", "p", "1", "c.cs", None, day(1)), (5, "r", "p", "1", "same.cs", "sha256:dd", day(1)), (5, "r", "p", "1", "same.cs", "sha256:dd", day(1)), (6, "new", "p", "1", "same.cs", "sha256:dd", day(1))],
    [("r", "1", "Completed", day(1)), ("r", "2", "Completed", day(3)), ("r", "3", "Failed", day(4)), ("new", "9", "Running", None)],
    [("r", "2", day(3), [("p", "1", "a\\x.cs", "BB"), ("p", "1", "b.cs", "sha256:cc"), ("p", "1", "same.cs", "SHA256:DD"), ("p", "1", "gone.cs", "ee")]), ("r", "3", day(4), [("p", "1", "c.cs", "ff")]), ("new", "9", day(4), [("p", "1", "same.cs", "dd")])],
)


def test_plan(spark):
    got = {(r.repo_id, r.path): r.change for r in c.plan_changes(*tables(spark, *CASE), keep_all=True).collect()}
    assert got == {("r", "a/x.cs"): "Unchanged", ("r", "b.cs"): "Changed", ("r", "c.cs"): "New", ("r", "same.cs"): "Unchanged", ("r", "gone.cs"): "Deleted", ("new", "same.cs"): "New"}


def rows(df):
    return {(r.repo_id, r.path, r.change) for r in df.collect()}


def test_offsets_advance_from_batch_to_batch(spark, tmp_path):
    src, runs, states = tables(spark, *CASE)
    log = c.ChangeLog(spark, str(tmp_path))
    log.start(c.committed_sources(runs, states))
    assert log.run(src) == 1
    first = {("r", "b.cs", "Changed"), ("r", "c.cs", "New"), ("new", "same.cs", "New")}
    assert rows(log.sink(1)) == first
    assert log.run(src) == 2 and rows(log.sink(2)) == set()
    more = spark.createDataFrame([(9, "r", "p", "1", "same.cs", "sha256:ee", day(5)), (10, "new", "p", "1", "d.cs", "sha256:aa", day(5))], SRC)
    assert log.run(src.unionByName(more)) == 3 and rows(log.sink(3)) == {("r", "same.cs", "Changed"), ("new", "d.cs", "New")}
    # A repository that a batch does not see keeps its offset.
    assert log.run(more.where("repo_id = 'new'")) == 4 and log.offsets().where("repo_id = 'r'").count() == 4
    assert log.sink().count() == 5
    again = c.ChangeLog(spark, str(tmp_path))
    again.start(c.committed_sources(runs, states))
    assert again.run(more.where("repo_id = 'new'")) == 5 and rows(again.sink(5)) == set()


@pytest.mark.parametrize("step", ["plan", "deliver", "commit", "advance"])
def test_a_batch_broken_off_at_any_step_is_finished_from_its_plan(spark, tmp_path, monkeypatch, step):
    src, runs, states = tables(spark, *CASE)
    log = c.ChangeLog(spark, str(tmp_path))
    log.start(c.committed_sources(runs, states))

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        if step == "commit":  # delivered, but not yet seen
            m.setattr(log.folder, "write", broken)
        else:
            m.setattr(log, step, broken)
        log.run(src)
    assert step == "advance" or rows(log.sink()) == set()
    # More arrives before the retry: it belongs to the next batch, if the plan was written.
    more = src.unionByName(spark.createDataFrame([(9, "new", "p", "1", "z.cs", "sha256:zz", day(5))], SRC))
    again = c.ChangeLog(spark, str(tmp_path))
    again.run(more)
    again.run(more)
    want = {("r", "b.cs", "Changed"), ("r", "c.cs", "New"), ("new", "same.cs", "New"), ("new", "z.cs", "New")}
    assert rows(again.sink()) == want and again.sink().count() == 4
    assert again.sink().where("path = 'z.cs'").first().batch == (1 if step == "plan" else 2)


def test_empty(spark):
    assert c.plan_changes(*tables(spark, [], [], []), keep_all=True).collect() == []
