from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions import text as X
from factloom.operators import lookup, merge, planner, resolve

T0 = datetime(2025, 1, 1)
NODES = "repo_id string, plugin_id string, unit_id string, node_id string, kind string, name string, qualified_name string, symbol_id string, language string, access string, properties string, deleted_at timestamp_ntz, contributors string"
EDGES = "repo_id string, plugin_id string, unit_id string, edge_id string, source_id string, target_id string, kind string, ev_quality string, ev_provider string, ev_provider_version string, ev_location string, ev_confidence double"
DECL = "repo_id string, plugin_id string, unit_id string, declaration_id string, symbol_id string, symbol_node_id string, path string, start_line int, start_col int, end_line int, end_col int, properties string"


def node(i, unit="u", name=None, qn=None, sym=None, kind="type", deleted=None, access=None, props=None, repo="r", lang="csharp"):
    return (repo, "p", unit, i, kind, name or i, qn, sym, lang, access, props, deleted, "clash")


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODES)


def edges(spark, *rows):
    return spark.createDataFrame([("r", "p", u, i, s, t, k, q, "x", None, None, c) for u, i, s, t, k, q, c in rows], EDGES)


def decl(spark, *rows):
    return spark.createDataFrame([("r", "p", "u", i, s, s and f"n{s}", path, *place, None) for i, s, path, place in rows], DECL)


def test_first_contribution_wins_and_differences_are_conflicts(spark):
    df = nodes(spark, node("a", "u2", "late"), node("a", "u1", "first"), node("a", "u1", "first"), node("b", "u1"), node("b", "u2", deleted=T0), node("gone", deleted=T0), node(None))
    got = {r.node_id: (r.name, r.contributors, r.conflict) for r in merge.merge(df, "node").collect()}
    assert got == {"a": ("first", 2, True), "b": ("b", 1, False)}
    assert {(r.fact_id, r.unit_id) for r in merge.provenance(df, "node").where("fact_id = 'a'").collect()} == {("a", "u1"), ("a", "u2")}
    assert merge.merge(df.limit(0), "node").collect() == []


def test_rules(spark):
    n = nodes(spark, node("a", sym="s"), node("b", sym="s"), node("n1", sym="1"), node("x", "u", "x"), node("x", "u", "y"))
    e = edges(spark, ("u", "e1", "a", "b", "calls", "Resolved", None), ("u", "e2", "a", "nowhere", "calls", "Derived", None), ("u", "e3", None, "a", "references", "Inferred", 0.5), ("u", "e4", "a", "b", "references", "Resolved", 0.5))
    d = decl(spark, ("d1", "1", "f", (1, 1, 2, 1)), ("d2", "2", "f", (1, 1, 2, 1)))
    got = {(r.code, r.fact_id) for r in merge.violations(n, d, e).collect()}
    assert got == {("replacement.node.duplicate", "x"), ("graph.node.conflict", "x"), ("graph.symbol.duplicate", "s"), ("graph.declaration.symbol-missing", "d2"), ("graph.edge.endpoint-missing", "e2"), ("graph.edge.endpoint-missing", "e3"), ("edge.evidence.invalid", "e4"), ("edge.evidence.calls-requires-resolved", "e2")}
    assert merge.first_violations(merge.violations(n, d, e), 2).count() == 2
    big = nodes(spark, node("p", props='{"a": "' + "x" * 32_769 + '"}'), node("q", props="{" + ",".join(f'"k{i}": 1' for i in range(65)) + "}"), node("ok", props='{"a": 1}'), node("bad", props="nonsense"))
    assert {(r.code, r.fact_id) for r in merge.property_limits(big, "node").collect()} == {("batch.property.text-length", "p"), ("batch.properties.limit", "q")}


def test_symbols_and_patterns(spark):
    n = merge.merge(nodes(spark, node("z", qn="Ex.Same"), node("a", qn="Ex.Same"), node("m", name="%Match"), node("k", qn=None, name="plain")), "node")
    asked = spark.createDataFrame([("Ex.Same",), ("Missing",), (" ",), ("Ex.Same",)], "name string")
    assert {(r.name, r.node_id, r.candidates) for r in lookup.symbols_by_name(n, asked).collect()} == {("Ex.Same", "a", 2), ("Ex.Same", "z", 2), ("Missing", None, 0)}
    top, total = lookup.by_pattern(n, "EX.", 1)
    assert [r.node_id for r in top.collect()] == ["a"] and tuple(total.first()) == (2, 1, True)
    assert [r.node_id for r in lookup.by_pattern(n, "%m")[0].collect()] == ["m"]
    for bad in ((" ", 5), ("x", 0), ("x", 201)):
        with pytest.raises(ValueError):
            lookup.by_pattern(n, *bad)


def test_tightest_enclosing_declaration(spark):
    d = decl(spark, ("outer", "1", "f", (1, 1, 200, 1)), ("inner", "2", "f", (50, 3, 60, 20)), ("tie", "3", "f", (50, 3, 60, 20)), ("bad", "4", "f", (9, 1, 3, 1)))
    pts = spark.createDataFrame([("r", "f", 55, 1), ("r", "f", 50, 2), ("r", "f", 60, 20), ("r", "f", 500, 1), ("r", "g", 1, 1)], "repo_id string, path string, line int, col int")
    assert {(r.path, r.line): r.declaration_id for r in lookup.enclosing(pts, d).collect()} == {("f", 55): "inner", ("f", 50): "outer", ("f", 60): "outer", ("f", 500): None, ("g", 1): None}


def test_scoped_discovery_and_affected_tests(spark):
    n = merge.merge(nodes(spark, node("proj", kind="project"), node("f", kind="file"), node("w", sym="s1", qn="W", access="public"), node("t", sym="s2", access="public", props='{"test-method": true}')), "node")
    e = merge.merge(edges(spark, ("u", "1", "proj", "f", "contains", "Structural", None), ("u", "2", "f", "w", "declares", "Structural", None), ("u", "3", "t", "w", "calls", "Resolved", None)), "edge")
    root = n.where("kind = 'project'")
    assert [(r.node_id, r.depth) for r in lookup.symbols_in(n, e, root).collect()] == [("w", 2)]
    assert [(r.node_id, r.ord) for r in lookup.public_surface(n, e, root).collect()] == [("w", 1)]
    seeds = spark.createDataFrame([("s", "r", "w"), ("s2", "r", "f")], "seed string, repo_id string, node_id string")
    assert [(r.seed, r.node_id) for r in lookup.affected_tests(n, e, seeds).collect()] == [("s", "t")]
    assert [tuple(r) for r in resolve.exercised_by(e, n).collect()] == [("r", "w", "t")]


def test_plans(spark):
    schema = "repo_id string, plugin_id string, path string, plugin_version string, hash string"
    now = spark.createDataFrame([("r", "p", "new", "1", "a"), ("r", "p", "same", "1", "a"), ("r", "p", "hash", "1", "b"), ("r", "p", "ver", "2", "a")], schema)
    was = spark.createDataFrame([("r", "p", "same", "1", "a"), ("r", "p", "hash", "1", "a"), ("r", "p", "ver", "1", "a"), ("r", "p", "old", "1", "a"), ("r", "q", "x", "1", "a")], schema)
    plan = planner.source_plan(now, was, ("p",))
    assert {r.path: r.status for r in plan.collect()} == {"new": "New", "same": "Unchanged", "hash": "Changed", "ver": "Changed", "old": "Deleted"}
    assert tuple(planner.plan_counts(plan).first()) == ("r", 1, 2, 1, 1)
    known = spark.createDataFrame([("r",)], "repo_id string")
    assert planner.freshness(plan, known).first().state == "Stale" and planner.freshness(plan, known.limit(0)).first().state == "Unknown"
    assert planner.duplicate_sources(now.unionByName(now)).count() == 4
    assert [r.path for r in planner.retained(was, now, ("p",)).collect()] == ["x"]


def test_modules(spark):
    files = spark.createDataFrame([("r", "a/x.ts"), ("r", "a/y/index.ts"), ("r", "a/x.d.ts"), ("r", "z.ts")], "repo_id string, path string")
    refs = spark.createDataFrame([("r", "a/m.ts", s) for s in ("./x", "./y", "../z", "../../up", "./no", "lib", None, "./x.d.ts", ".//x")], "repo_id string, path string, specifier string")
    got = {r.specifier: (r.state, r.target) for r in resolve.resolve_modules(refs, files, "typescript").collect()}
    assert got == {"./x": ("internal", "a/x.ts"), "./y": ("internal", "a/y/index.ts"), "../z": ("internal", "z.ts"), "../../up": ("unsupported", None), "./no": ("unresolved", None), "lib": ("external", None), None: ("dynamic", None), "./x.d.ts": ("internal", "a/x.d.ts"), ".//x": ("unsupported", None)}


def test_symbol_targets(spark):
    cols = "repo_id string, assembly string, identity string, fingerprint string, path string"
    offered = spark.createDataFrame([("n1", "r", "A", "I", "F1", "p1"), ("n2", "r", "B", "I", "F2", "p2"), ("n3", "r", "C", "J", "F3", "p3")], f"node_id string, {cols}")
    wanted = spark.createDataFrame([("1", "r", "A", "I", None, None), ("2", "r", "Z", "I", None, None), ("3", "r", "Z", "K", "F3", None), ("4", "r", "Z", "K", "no", "p2"), ("5", "r", "Z", "K", None, None)], f"ref_id string, {cols}")
    assert {r.ref_id: (r.state, r.node_id) for r in resolve.resolve_symbols(wanted, offered).collect()} == {"1": ("Found", "n1"), "2": ("Ambiguous", None), "3": ("Found", "n3"), "4": ("Found", "n2"), "5": ("External", None)}


def test_small_folds(spark):
    mods = spark.createDataFrame([("r", "s", ["a", "b", "b"]), ("r", "s", ["b", "c"]), ("r", "t", [])], "repo_id string, symbol_id string, modifiers array<string>")
    assert {r.symbol_id: r.modifiers for r in resolve.common_modifiers(mods).collect()} == {"s": ["b"], "t": []}
    docs = nodes(spark, node("a", sym="s", props='{"doc-summary": "two"}'), node("b", sym="s", props='{"doc-summary": "one"}'), node("c", sym="s", props='{"doc-summary": " "}'), node("d", sym="t", props="broken"))
    assert [tuple(r) for r in resolve.merged_documentation(docs).collect()] == [("r", "s", "one\n\ntwo")]


def test_text_functions(spark):
    df = spark.createDataFrame([("a\U0001f600b", "x/y:z", "A.B.C", "a/./b/../c", " id", "ok")], "u string, p string, m string, q string, i string, j string")
    row = df.select(X.utf16_length(F.col("u")), X.short_name(F.col("p")), X.module_short_name(F.col("m")), X.normalise_path(F.col("q")), S.valid_identifier(F.col("i")), S.valid_identifier(F.col("j")), X.contains_ignoring_case(F.col("m"), "b.c")).first()
    assert tuple(row) == (4, "z", "C", "a/c", False, True, True)
    order = spark.createDataFrame([("￿",), ("\U0001f600",)], "c string").orderBy(X.ordinal(F.col("c"))).collect()
    assert [r.c for r in order] == ["\U0001f600", "￿"]
    assert [S.valid_path(F.lit(x)).alias("v") is not None for x in ("a",)] == [True]
    got = spark.range(1).select(*[S.valid_path(F.lit(x)) for x in ("a/b", "/a", "a/../b", "C:\\a", "")]).first()
    assert tuple(got) == (True, False, False, False, False)
