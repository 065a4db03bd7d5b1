import pytest

from factloom.llm import mixing as m

SIZES = "doc_id bigint, source string, tokens bigint"
TARGETS = "source string, target_share double, max_repeats int"


def sizes(spark, n=400):
    rows = [(i, "big" if i % 3 else "mid", 10 + i % 7) for i in range(n)] + [(1000 + i, "tiny", 5) for i in range(10)] + [(2000, None, 9), (2001, "other", 9), (2002, "big", 0)]
    return spark.createDataFrame(rows, SIZES)


@pytest.mark.parametrize("per_range", [7, 20_000])
def test_shares_caps_and_exact_cut(spark, monkeypatch, per_range):
    monkeypatch.setattr(m, "RANGE", per_range)
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("Mid", 0.3, 2), ("tiny", 0.1, 4), ("ghost", 0.4, 3), ("nan", float("nan"), 1), (None, 0.2, 1)], TARGETS)
    s = sizes(spark)
    mixed = m.mix(s, targets)
    rows = mixed.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} <= {"big", "mid", "tiny"}
    report = {r.source: r for r in m.shares(mixed, s, targets).collect()}
    assert set(report) == {"big", "mid", "tiny", "ghost"}
    for name, cap in (("big", 1), ("mid", 2), ("tiny", 4)):
        r = report[name]
        assert r.max_copies <= cap and 0 <= r.budget - r.used < 17
        assert abs(r.reached - r.want) < 0.05
    assert report["tiny"].budget == report["tiny"].available * 4 == 200  # the source that bounds the total
    assert report["ghost"].used == 0 and report["ghost"].reached == 0


def test_cut_follows_the_keys(spark, monkeypatch):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    got = {}
    for per_range in (5, 20_000):
        monkeypatch.setattr(m, "RANGE", per_range)
        got[per_range] = {(r.doc_id, r.copies) for r in m.mix(sizes(spark), targets, total=1000).collect()}
    assert got[5] == got[20_000] and got[5]


def test_given_total_beyond_the_caps(spark):
    targets = spark.createDataFrame([("big", 1.0, 2), ("tiny", 1.0, 3)], TARGETS)
    s = sizes(spark)
    report = {r.source: r for r in m.shares(m.mix(s, targets, total=10**9), s, targets, total=10**9).collect()}
    assert report["tiny"].used == report["tiny"].available * 3 and report["big"].used == report["big"].available * 2


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 2)], TARGETS)
    none = sizes(spark).limit(0)
    assert m.mix(none, targets).collect() == []
    assert m.mix(sizes(spark), targets.limit(0)).collect() == []
    assert [r.reached for r in m.shares(m.mix(none, targets), none, targets).collect()] == [0.0]
