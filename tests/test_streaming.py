from factloom.operators.orphans import OrphanState
from factloom.streaming import ingest as g


def write(spark, rows, path):
    spark.createDataFrame(rows, g.FACTS).coalesce(1).write.mode("append").json(path)


def fact(unit, batch, completes, fact_id, body="b", run="1", version="1"):
    return ("r", run, "p", unit, version, batch, completes, "node" if fact_id else None, fact_id, body)


def test_units_wait_until_complete(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    staged = []

    def run():
        stream = spark.readStream.schema(g.FACTS).json(src)
        q = g.ingest(stream, out, cp, lambda: spark.createDataFrame([("r", "1")], "repo_id string, run_id string"), lambda df, epoch: staged.append(sorted((r.unit_id, r.fact_id) for r in df.where("fact_id is not null").collect())))
        q.awaitTermination()

    write(spark, [fact("u1", 1, False, "a"), fact("u2", 1, True, "b"), fact("late", 1, True, "x", run="0"), fact("bad", 1, False, "z", "1"), fact("bad", 2, True, "z", "2")], src)
    run()
    assert staged == [[("u2", "b")]]
    assert {(r.unit_id, r.code) for r in g.incomplete(spark, out, "1").collect()} == {("u1", "ingestion.index-unit.incomplete"), ("bad", "ingestion.index-unit.rejected")}
    write(spark, [fact("u1", 2, False, "c"), fact("u1", 3, True, None)], src)
    run()
    assert staged[1] == [("u1", "a"), ("u1", "c")]
    assert {r.unit_id for r in g.incomplete(spark, out, "1").collect()} == {"bad"}


def test_log_is_folded_whatever_the_order(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "slot string, seq bigint, value string"
    for rows in ([("a", 2, "two"), ("b", 1, "one")], [("a", 1, "late"), ("a", 3, "three"), ("b", 1, "one")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        g.fold_log(spark.readStream.schema(schema).json(src), out, cp, ["slot"], "seq", ["value"]).awaitTermination()
    assert {tuple(r) for r in g.Epochs(spark, out).before(1 << 60).collect()} == {("a", 3, "three"), ("b", 1, "one")}


def test_orphans_over_a_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "parent string, repo_id string, key string, ref_table string, ref_column string, ref_id string, at timestamp_ntz, contribution bigint, gone boolean"
    ref = lambda key, i: ("node", "r", key, "edges", "target_id", i, None, None, None)
    event = lambda key, c, gone: ("node", "r", key, None, None, None, None, c, gone)
    batches = ([ref("a", "1"), ref("b", "2"), event("c", 1, False)], [event("a", 1, False), ref("a", "3"), ref("c", "4")], [event("a", 1, True), event("a", 1, False)])
    for rows, want in zip(batches, ({"1", "2"}, {"2"}, {"1", "2", "3"})):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        g.track_orphans(spark.readStream.schema(schema).json(src), out, cp).awaitTermination()
        assert {r.ref_id for r in OrphanState(spark, out).orphans().collect()} == want
