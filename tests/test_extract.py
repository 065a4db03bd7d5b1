import json
from factloom.sources import extract as x

TS = """import def, { a } from './x';
import type { T } from "types";
export * from './star';
export * as ns from './ns';
export { a as b };
@Deco({ z: 1 })
export default abstract class Html<T> extends Base<T> implements Renderer, Other {
  private static readonly limit?: number = 1;
  get size(): number { return this.n; }
  constructor(private n: number) { super(); }
  protected async render(x: string): Promise<void> { helper(x); new Widget(); }
}
interface Renderer extends Root { render(x: string): void; name?: string }
type Alias = { a: number };
enum Color { Red }
namespace Inner { export function deep() { } }
export function top<T>(a: T) { return require('fs'); }
export const arrow = async (a: number): Promise<number> => { return a; };
const plain = 3, second = function () { };
const lazy = import('./lazy');
"""


def rows(path, text):
    return x.extract("r", path, text)


def names(found, fact, kind):
    return sorted(r["qualified_name"] for r in found if r["fact"] == fact and r["kind"] == kind and r["symbol_id"])


def test_typescript():
    f = rows("src/a.ts", TS)
    assert names(f, "node", "type") == ["Alias", "Color", "Html"]
    assert names(f, "node", "interface") == ["Renderer"] and names(f, "node", "namespace") == ["Inner"]
    assert names(f, "node", "callable") == ["Html.constructor", "Html.render", "Inner.deep", "Renderer.render", "arrow", "second", "top"]
    assert names(f, "node", "field") == ["Html.limit", "lazy", "plain"]
    assert names(f, "node", "property") == ["Html.size", "Renderer.name"]
    edge = {(r["kind"], r["target_id"]) for r in f if r["fact"] == "edge"}
    node = {r["id"]: r["qualified_name"] for r in f if r["fact"] == "node"}
    assert {(k, node[t]) for k, t in edge if k in ("inherits", "implements")} == {("inherits", "Base"), ("implements", "Renderer"), ("implements", "Other"), ("inherits", "Root")}
    assert {node[t] for k, t in edge if k == "invokes-name"} >= {"helper", "Widget"}
    assert {(r["kind"], r["name"]) for r in f if r["fact"] == "module"} == {("import", "./x"), ("import-type", "types"), ("export-star", "./star"), ("export-namespace-from", "./ns"), ("require", "fs"), ("dynamic-import", "./lazy")}
    assert sorted(r["name"] for r in f if r["fact"] == "node" and r["kind"] == "export") == ["arrow", "b", "default", "top"]
    assert not any(r["fact"] == "warning" for r in f)
    html = next(r for r in f if r["fact"] == "declaration" and r["start_line"] == 6)
    assert (html["start_col"], html["end_line"]) == (1, 12)


EX = """defmodule Shop.Cart do
  alias Shop.Item
  use GenServer
  @doc "Adds."
  @spec add(integer(), term()) :: term()
  def add(a, {b, c}) do
    Item.put(a)
    helper(b)
    if ready?(c), do: a
  end
  defp helper(x), do: x
  def zero, do: 0
  defmodule Inner do
    def f(x), do: x
  end
end
"""


def test_elixir():
    f = rows("lib/cart.ex", EX)
    assert names(f, "node", "type") == ["Shop.Cart", "Shop.Cart.Inner"]
    assert names(f, "node", "callable") == ["Shop.Cart.Inner.f/1", "Shop.Cart.add/2", "Shop.Cart.helper/1", "Shop.Cart.zero/0"]
    assert {(r["kind"], r["name"]) for r in f if r["fact"] == "module"} == {("alias", "Shop.Item"), ("use", "GenServer")}
    node = {r["id"]: r["qualified_name"] for r in f if r["fact"] == "node"}
    assert {node[r["target_id"]] for r in f if r["kind"] == "invokes-name"} == {"put", "helper", "ready?"}


def test_partial_and_awkward(spark):
    assert any(r["kind"] == "plugin.partial-result" for r in rows("a.ts", "class A { foo() { \nfunction b() { }"))
    assert [r["kind"] for r in rows("a.ts", None)] == ["file"] and rows("a.py", "x") == []
    for text in ("", "(" * 500, "export", "class", "import", "interface A", "const", "type X =", "export {", "@", "def", "defmodule A", "\U0001f600", "export default", "const {a} = b", "function"):
        for path in ("a.ts", "a.js", "a.ex"):
            rows(path, text)
    df = spark.createDataFrame([("r", "a.ts", "class A { }", "q"), ("r", "a.ts", "class A { }", "q"), ("r", None, "x", "q"), ("r", "b.ex", None, "q")], "repo_id string, path string, content string, kind string")
    got = x.facts(df)
    assert got.where("fact = 'node'").count() == 3 and x.facts(df.limit(0)).collect() == []


def test_columns_count_utf16_units():
    f = rows("a.js", "/* \U0001f600 */ function f() { }")
    assert next(r["start_col"] for r in f if r["fact"] == "declaration") == 10


CSHARP = """using System;
using Json = System.Text.Json;
namespace A.B;

/// <summary>Keeps <c>things</c>.</summary>
[Serializable]
public sealed partial class Store<T> : Base<T>, IStore, Other.IMore where T : new()
{
    private readonly Dictionary<string, (int a, int b)> _map = new Dictionary<string, (int a, int b)>();
    public int Count { get; private set; } = Start();
    public string Name => Render(1);
    public Store(int size) : base(size) { Fill(); }
    /// <summary>Adds one.</summary>
    [Fact]
    public async Task<int> AddAsync<U>(U item) where U : class
    {
        var x = new Item(item);
        return await Send(x);
    }
    interface IInner : IDisposable { void Close(); }
    enum Color { Red, Green = 2 }
    public delegate int Maker(int x);
}
public record struct Point(int X, int Y);
"""


def test_csharp():
    rows = x.extract("r", "src/Store.cs", CSHARP)
    nodes = {(r["kind"], r["qualified_name"]) for r in rows if r["fact"] == "node" and r["symbol_id"]}
    assert nodes == {
        ("type", "A.B.Store"), ("field", "A.B.Store._map"), ("property", "A.B.Store.Count"), ("property", "A.B.Store.Name"), ("callable", "A.B.Store.Store"), ("callable", "A.B.Store.AddAsync"),
        ("interface", "A.B.Store.IInner"), ("callable", "A.B.Store.IInner.Close"), ("type", "A.B.Store.Color"), ("field", "A.B.Store.Color.Red"), ("field", "A.B.Store.Color.Green"), ("type", "A.B.Store.Maker"), ("type", "A.B.Point"),
    }
    of = {r["qualified_name"]: json.loads(r["properties"]) for r in rows if r["fact"] == "node" and r["symbol_id"]}
    assert of["A.B.Store"] == {"access": "public", "doc-summary": "Keeps things ."} and of["A.B.Store.IInner.Close"] == {"access": "public"}
    assert of["A.B.Store.AddAsync"] == {"access": "public", "doc-summary": "Adds one.", "test-method": "true"} and of["A.B.Store._map"] == {"access": "private"}
    named = {r["id"]: r["qualified_name"] for r in rows if r["fact"] == "node"}
    edges = {(r["kind"], named[r["source_id"]], named[r["target_id"]]) for r in rows if r["fact"] == "edge" and r["kind"] not in ("declares", "contains")}
    assert {y for y in edges if y[0] in ("inherits", "implements")} == {("inherits", "A.B.Store", "Base"), ("implements", "A.B.Store", "IStore"), ("implements", "A.B.Store", "Other.IMore"), ("inherits", "A.B.Store.IInner", "IDisposable")}
    assert {y[1:] for y in edges if y[0] == "invokes-name"} == {("A.B.Store._map", "Dictionary"), ("A.B.Store.Count", "Start"), ("A.B.Store.Name", "Render"), ("A.B.Store.Store", "Fill"), ("A.B.Store.AddAsync", "Item"), ("A.B.Store.AddAsync", "Send")}
    assert {y[2] for y in edges if y[0] == "imports"} == {"System", "System.Text.Json"}
    for end in range(0, len(CSHARP), 7):  # what breaks off is never an error
        x.extract("r", "a.cs", CSHARP[:end])
