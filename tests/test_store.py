import pytest

from factloom.plans import store as s

UNITS = "repo_id string, plugin_id string, unit_id string, plugin_version string, source_path string, source_hash string"
NODES = "repo_id string, plugin_id string, unit_id string, node_id string, kind string, name string, qualified_name string, symbol_id string, language string, access string, properties string"
DECL = "repo_id string, plugin_id string, unit_id string, declaration_id string, symbol_id string, symbol_node_id string, path string, start_line int, start_col int, end_line int, end_col int, properties string"
EDGES = "repo_id string, plugin_id string, unit_id string, edge_id string, source_id string, target_id string, kind string, ev_quality string, ev_provider string, ev_provider_version string, ev_confidence double"


def facts(spark, unit, nodes, edges=(), plugin="p"):
    k = ("r", plugin, unit)
    return (
        spark.createDataFrame([(*k, "1", f"{unit}.cs", f"sha256:{unit}")], UNITS),
        spark.createDataFrame([(*k, n, "type", n, n, f"s:{n}", None, None, None) for n in nodes], NODES),
        spark.createDataFrame([], DECL),
        spark.createDataFrame([(*k, f"{a}{b}", a, b, "calls", "Resolved", "x", None, None) for a, b in edges], EDGES),
    )


@pytest.fixture
def store(spark, tmp_path):
    st = s.GraphStore(spark, str(tmp_path / "store"))
    st.upsert_repository("r")
    return st


def ids(st):
    return sorted(r.node_id for r in st.read(st.publication("r"))["nodes"].select("node_id").distinct().collect())


def test_staging_is_invisible_publication_atomic_and_overlaid(spark, store):
    store.store_run("r", "1", plugins=("p",))
    store.stage("r", "1", *facts(spark, "u1", ["a", "b"], [("a", "b")]))
    assert store.publication("r") is None
    first = store.complete("r", "1")
    assert ids(store) == ["a", "b"] and store.run("r", "1")["status"] == "Completed"
    pinned = store.read(first)
    store.store_run("r", "2", plugins=("p",))
    store.stage("r", "2", *facts(spark, "u2", ["c", "b"]))
    store.stage("r", "2", *facts(spark, "u1", ["a"]))
    second = store.complete("r", "2")
    assert ids(store) == ["a", "b", "c"] and pinned["edges"].count() == 1 and second["identity"] != first["identity"]
    store.store_run("r", "3", plugins=("p",))
    store.stage_deletion("r", "3", facts(spark, "u2", [])[0])
    store.complete("r", "3")
    assert ids(store) == ["a"]
    assert [tuple(r) for r in store.health().collect()] == [("r", 1, 1, 0, 0)]


def test_rules_of_runs(spark, store):
    with pytest.raises(s.StoreError, match="run.repository.missing"):
        store.store_run("other", "1")
    store.store_run("r", "1", plugins=("p",))
    assert store.store_run("r", "1")["status"] == "Running"
    with pytest.raises(s.StoreError, match="replacement.plugin.not-in-run"):
        store.stage("r", "1", *facts(spark, "u", ["a"], plugin="q"))
    store.stage("r", "1", *facts(spark, "u", ["a"]))
    store.store_run("r", "1", "Failed")
    assert store.store_run("r", "1", "Failed")["status"] == "Failed"
    for late in (lambda: store.stage("r", "1", *facts(spark, "u", ["a"])), lambda: store.complete("r", "1"), lambda: store.store_run("r", "1", "Cancelled")):
        with pytest.raises(s.StoreError):
            late()
    assert store.publication("r") is None


def test_dangling_edges_and_superseded_runs_fail_and_change_nothing(spark, store):
    store.store_run("r", "1", plugins=("p",))
    store.store_run("r", "2", plugins=("p",))
    store.stage("r", "1", *facts(spark, "u", ["a"], [("a", "gone")]))
    with pytest.raises(s.StoreError, match="graph.edge.endpoint-missing") as e:
        store.complete("r", "1")
    assert e.value.found and store.publication("r") is None
    store.stage("r", "2", *facts(spark, "u", ["a"]))
    store.complete("r", "2")
    store.store_run("r", "1", "Cancelled")
    store.store_run("r", "3", plugins=("p",))
    store.store_run("r", "4", plugins=("p",))
    store.stage("r", "3", *facts(spark, "v", ["b"]))
    store.complete("r", "3")
    store.stage("r", "4", *facts(spark, "w", ["c"]))
    with pytest.raises(s.StoreError, match="superseded"):
        store.complete("r", "4")
    assert ids(store) == ["a", "b"]


def test_snapshot_round_trip_and_tampering(spark, store, tmp_path):
    store.store_run("r", "1", plugins=("p",))
    store.stage("r", "1", *facts(spark, "u1", ["a", "b"], [("a", "b")]))
    first = store.complete("r", "1", snapshot="s1")
    text = store.export("r")
    other = s.GraphStore(spark, str(tmp_path / "other"))
    again = other.import_(text, "x")
    assert again["identity"] == first["identity"] and ids(other) == ["a", "b"]
    with pytest.raises(s.StoreError, match="hash.mismatch"):
        other.import_(text.replace('\\"a\\"', '\\"z\\"'), "y")


def test_what_staging_and_completion_reject(spark, store):
    with pytest.raises(s.StoreError, match="run.transition.invalid"):
        store.store_run("r", "0", "Completed")
    store.store_run("r", "1", plugins=("p",))
    units, nodes, decl, edges = facts(spark, "u", ["a", "b"])
    with pytest.raises(s.StoreError, match="replacement.plugin.not-in-run"):
        store.stage("r", "1", spark.createDataFrame([(None, "p", "u", "1", None, None)], UNITS), nodes, decl, edges)
    guess = spark.createDataFrame([("r", "p", "u", "e", "a", "b", "calls", "Inferred", "x", None, 0.5)], EDGES)
    with pytest.raises(s.StoreError, match="edge.evidence.calls-requires-resolved"):
        store.stage("r", "1", units, nodes, decl, guess)
    twice = nodes.unionByName(spark.createDataFrame([("r", "p", "u", "a", "type", "other", "a", "s:a", None, None, None)], NODES))
    with pytest.raises(s.StoreError, match="replacement.node.duplicate"):
        store.stage("r", "1", units, twice, decl, edges)
    store.stage("r", "1", units, nodes, decl, edges)
    held = spark.createDataFrame([("r", "1", "p", "u9", "ingestion.index-unit.incomplete")], "repo_id string, run_id string, plugin_id string, unit_id string, code string")
    with pytest.raises(s.StoreError, match="ingestion.index-unit.incomplete"):
        store.complete("r", "1", incomplete=held)
    first = store.complete("r", "1", incomplete=held.limit(0))
    assert store.pinned(first)["nodes"].count() == 2
    store.store_run("r", "2", plugins=("p",))
    store.stage("r", "2", *facts(spark, "v", ["c"]))
    store.complete("r", "2")
    with pytest.raises(s.StoreError, match="publication.moved"):
        store.pinned(first)
