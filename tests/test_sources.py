import pytest

from factloom.plans import lifecycle as lc
from factloom.sources import files as f
from factloom.sources import projects as p


def test_inventory_routing_and_verified_content(spark, tmp_path):
    for name, text in {"src/a.cs": "class A {}", "src/b.ts": "let a;", "Node_Modules/x.ts": "no", "readme": "x"}.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    inv = f.inventory(spark, str(tmp_path), "r")
    assert sorted(r.path for r in inv.select("path").collect()) == ["readme", "src/a.cs", "src/b.ts"]
    cs, ts, ts2 = f.Plugin("cs", "1", "csharp", (".cs",)), f.Plugin("ts", "1", "typescript", (".ts",)), f.Plugin("ts2", "1", "typescript", (".TS",))
    assert {r.path: r.plugin_id for r in f.route(inv, [cs, ts]).collect()} == {"readme": None, "src/a.cs": "cs", "src/b.ts": "ts"}
    with pytest.raises(f.SourceError, match="ambiguous"):
        f.route(inv, [ts, ts2])
    assert {r.plugin_id for r in f.route(inv, [ts, ts2], {"typescript": ["ts2", "ts"]}).collect()} == {None, "ts2"}
    plan = f.hashed(inv).select("path", "hash").cache()
    plan.count()
    (tmp_path / "src/a.cs").write_text("class B {}")
    got = {r.path: r.problem for r in f.materialise(f.inventory(spark, str(tmp_path), "r"), plan, per_source=20).collect()}
    assert got == {"readme": None, "src/a.cs": "source.changed", "src/b.ts": None}
    with pytest.raises(f.SourceError, match="total.limit"):
        f.materialise(f.inventory(spark, str(tmp_path), "r"), plan, in_total=3)
    with pytest.raises(f.SourceError, match="entries.limit"):
        f.inventory(spark, str(tmp_path), "r", max_entries=1)


def test_provider_is_never_chosen_by_order():
    yes, no = (lambda d: True), (lambda d: False)
    assert f.resolve_provider({"a": no, "b": yes}, "x") == "b"
    for bad in ({}, {"a": no}, {"a": yes, "b": yes}):
        with pytest.raises(f.SourceError):
            f.resolve_provider(bad, "x")


PROJECT = """<Project Sdk="X"><ItemGroup Condition="'$(T)'=='n'"><PackageReference Include="B" Version="2.0" /></ItemGroup>
<ItemGroup><PackageReference Include="A"><Version>1.0</Version></PackageReference><PackageReference Include="C" /><ProjectReference Include="..\\Q\\Q.csproj" />
<Compile Remove="skip/**" /><Compile Include="..\\shared\\*.cs" /></ItemGroup></Project>"""


def test_projects(spark):
    files = spark.createDataFrame([("r", "P/P.csproj", PROJECT), ("r", "Q/Q.csproj", "<broken"), ("r", "all.sln", 'Project("{x}") = "P", "P\\P.csproj", "{y}"\nProject("{x}") = "Z", "Z\\Z.csproj", "{y}"\n')] + [("r", n, "") for n in ("P/a.cs", "P/skip/b.cs", "P/obj/c.cs", "loose.cs")], "repo_id string, path string, content string")
    parsed = p.projects(files)
    rows = {r.project: r for r in parsed.collect()}
    assert rows["Q/Q.csproj"].error == "project.load-failure"
    assert [(x.name, x.version, x.condition) for x in rows["P/P.csproj"].packages] == [("A", "1.0", None), ("B", "2.0", "'$(T)'=='n'"), ("C", "", None)]
    assert rows["P/P.csproj"].references == ["../Q/Q.csproj"]
    assert {(r.project, r.finding) for r in p.solution_findings(files).collect()} == {("Z/Z.csproj", "solution.project-missing"), ("Q/Q.csproj", "solution.project-unlisted")}
    assert {(r.project, r.path) for r in p.compile_items(parsed, files).collect()} == {("P/P.csproj", "P/a.cs"), (p.LOOSE, "P/skip/b.cs"), (p.LOOSE, "P/obj/c.cs"), (p.LOOSE, "loose.cs")}
    assert p.package_facts(parsed).count() == 3
    assert p.parse_solution('<Solution><Project Path="a\\b.csproj" /></Solution>') == ["a/b.csproj"]


def test_build_order():
    assert p.build_order({"a": ["b"], "b": ["c"], "c": []}) == (["c", "b", "a"], [])
    assert p.build_order({"a": ["b"], "b": ["a"], "x": ["gone"]})[1] == ["a"]


def test_fallbacks():
    assert [lc.may_fall_back(x, y) for x, y in (("None", "parse"), ("OnUnavailable", "version-mismatch"), ("OnUnavailable", "parse"), ("OnFailure", "parse"), ("OnFailure", "cancelled"))] == [False, True, False, True, False]
    out = lc.takeovers({"a": ["1", "2"], "b": ["3"], "c": []}, {"a": "parse", "b": "cancelled"}, {"a": "OnFailure", "b": "OnFailure"}, ["a", "b", "c"], {"a": 7, "c": 3}, {"c": {"1", "2", "3"}})
    assert out.owner == {"1": "c", "2": "c"} and out.failed == {"b": "cancelled"} and out.lost == 4
    assert lc.is_noop({"unchanged": 3}) and not lc.is_noop({"deleted": 1})
