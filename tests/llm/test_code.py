import random
import pytest

from factloom.llm import docs, origin, sources, validity
from factloom.functions.lexers import LEX, language_of

VALID = {
    "a.ts": """
import def, { a as b, type C } from './x';
export default class A<T extends object = {}> extends B<T> implements I, J {
  private readonly x?: Map<string, Array<number>> = new Map();
  static #y = 1; declare z: string
  constructor(private a: number, public b = 2) { super(a) }
  get v(): number { return this.#q ?? 0 }
  async *gen<T>(@Inj() x: T, ...rest: unknown[]): AsyncGenerator<T> { yield* x; for await (const a of b) c(a) }
  [key: string]: any;
  abstract foo(): void
}
@Deco({ a: 1 }) export abstract class Q { m = (x: number): string => `a${x > 1 ? `b${x}` : 'c'}d` }
type U = { readonly [K in keyof T]?: T[K] } | ((a: string) => void) | typeof x.y | `a${string}`
interface I2 extends X<Y<Z>> { a: string; b?(c: number): void, new (x: string): I2 }
enum E { A = 1, B = 'x', }
declare module 'm' { export const q: number; }
function isX(a: unknown): a is string { return (a as any)!.b satisfies string; }
const re = /[{"(]a\\/+/.test(s) ? '{' : "'", f = <T,>(x: T) => x, g = async <T>(x: T): Promise<T> => { return x };
label: for (let i = 0, n = 5; i < n >> 1; i++) { if (i >= 3) continue label; else break }
if (a) b(); else if (c) d = e ? (f) : (g, h);
export * as ns from 'y'; export { def as default, b }; export type { C } from './x'
let o = { a, b: 1, 'c': 2, [d]: 3, async e() {}, get f() { return 1 }, set f(v) {}, ...g, *h() {} };
try { x() } catch { y() } finally { z() }
do x++; while (x < 5)
""",
    "a.js": """#!/usr/bin/env run
!function(e,t){"use strict";var c0=function(q){for(var e=0,d=q.length;e<d;e++)q[e]=q[e]<<0;return q};if(!k){x={v:0,f:!0}}else x=void 0}(1,2)
class A extends (B, C) { static { this.x = 1 } 'quoted'() {} 12() {} async = 1; get = 2; static async *[Symbol.iterator]() {} }
const { a, b: [c = 1, ...d], ...rest } = e, fn = async x => await x, g = (a, { b } = {}) => ({ a, b })
switch (x) { case 1: case 2: y(); break; default: z() }
export const of = 1, async = 2
var s = `line
<<<<<<< ours
${a}`, h = a / b / c, r = x ? /re/g : 1 / 2
import('x').then(({ default: d }) => d?.a?.[0]?.(1))
new.target
""",
    "a.cs": """
#nullable enable
using System; using static System.Math; global using X = System.Collections.Generic.List<int>;
[assembly: Foo("x")]
namespace A.B;
#region r
[Serializable, Obsolete("x", false)]
public abstract partial class C<T, U> : Base<T>, IFoo where T : class, new() where U : struct
{
    private const int N = 0xFF; static readonly int[,] M = { { 1, 2 }, { 3, 4 } };
    public string Name { get; private set; } = $"a{(x > 1 ? $"b{x:D2}" : "c")}d{{";
    public int this[int i] => _a[i];
    public event EventHandler<Args>? Changed;
    public C(int a) : base(a) { }
    ~C() { }
    public static C<T, U> operator +(C<T, U> a, C<T, U> b) => a;
    public static implicit operator int(C<T, U> a) => 1;
    void IFoo.Bar<V>(ref V v, out int w, params object[] rest) { w = 1; }
    public async Task<(int, string)> M2(int a = 5, string? b = null)
    {
        var (x, y) = await F(a: 1, out var z).ConfigureAwait(false);
        var q = from i in list where i > 1 orderby i descending select new { i, i.Name };
        if (o is string { Length: > 5 } s && o is not null or (int, int)) return (1, "a");
        var r = o switch { 1 => "x", > 2 and < 5 when y => "z", _ => throw new Exception() };
        foreach (var (k, v) in d) { goto end; }
        using var f = new Foo { A = 1, [2] = 3 }; int[] arr = [1, ..other, 2]; var t = arr[^1..];
        Func<int, Task> fn = static async (int p) => { await G(p); }; Action<int> h = delegate(int p) { };
        for (int i = 0, j = 1; i < 5 && j >= 2; i++, j--) unchecked { a <<= 1; a = a >> 2; }
        int Local(int n) => n <= 1 ? 1 : n * Local(n - 1);
        try { lock (this) { } } catch (Exception e) when (e.X) { throw; } finally { }
        string v1 = @"c:\\""q"" <<<<<<< HEAD", v2 = \"\"\"raw "x" \"\"\"; char ch = '\\''; List<List<int>> l = new();
        p ??= (int?)x ?? default; var rec = r1 with { A = 2 }; end: return default;
    }
}
#endregion
record struct P(int X, int Y); delegate void D<in T>(T t); enum E : byte { A = 1, B }
interface I { int P { get; } void M() => X(); }
""",
    "a.ex": '''
defmodule A.B do
  @moduledoc """
  Doc "x" #{1 + 1}
  """
  use GenServer, restart: :temporary
  alias A.{B, C}
  import Kernel, except: [if: 2]
  @type t :: %__MODULE__{a: integer() | nil, b: (integer -> atom)}
  @spec f(integer(), String.t()) :: {:ok, t} | :error
  defstruct [:a, b: 1]
  def f(x, y \\\\ 1) when x > 0 and is_binary(y), do: {:ok, x}
  def g(%{a: a} = m, [h | t]) do
    with {:ok, x} <- f(a),
         y = x + 1 do
      x |> Enum.map(&(&1 * 2)) |> Enum.reduce(0, fn a, b -> a + b end)
    else
      {:error, _} = e -> e
      _ -> nil
    end
    m = ?{
    case m do
      x when x in 1..5 -> ~s(a "do" b)
      <<a::size(8), rest::binary>> -> "end #{inspect(x, pretty: true)} }"
      _ ->
        receive do
          :x -> 1
        after
          10 -> 2
        end
    end
    cond do
      true -> raise ArgumentError, message: "x"
    end
    for x <- 1..20, rem(x, 2) == 0, into: %{}, do: {x, x * 2}
    try do
      Map.get(m, :a)[:b].c.(1)
    rescue
      e in RuntimeError -> reraise e, __STACKTRACE__
    catch
      :exit, _ -> nil
    end
    "a" <>
      "b"
    unless x, do: y, else: z
    %{m | "b" => 2, a: 1}
    not x and !y
    quote do: unquote(x)
    @limit
  end
  defp h?(_), do: if(true, do: 1)
  defmacro m(do: block), do: block
end
''',
}
INVALID = {
    "a.ts": ["const a = (1 + ;", "class A { foo( { } }", "let x: = 3;", "function f() { if (a) { }", "<<<<<<< HEAD\nlet a;\n=======\n>>>>>>> x\n", "let s = 'abc\n';", "/* open", "defmodule A do\nend", "{\n \"a\": 1,\n \"b\": 2\n}", "<!DOCTYPE html>\n<p>x</p>", "a b", "let t = `x ${1", "}"],
    "a.js": ["const a: number = 1;", "function f(a: string) {}", "interface A { b: string }", "class A { private x = 1 }", "let a = b as string;", "enum E { A }", "function f<T>(x) {}"],
    "a.cs": ["class A { void F() { }", "class A { int x = (3 * [4, 5; }", "class A { void F() { var s = \"never closed;\n } }", "import { a } from './b';", "class A { } }", "#!/bin/sh\nset -e", "namespace A { class B { int } }", "class A { void F() { /* left open } }", "public class A { <<<<<<< HEAD\n int a; }"],
    "a.ex": ["defmodule A do\n def f(x) do\n x\nend", "defmodule A do\nend\nend", "def f(x), do: (1 +\nend", "x = [1, 2", "y = \"abc", "<!DOCTYPE html>", "if x do\n<<<<<<< HEAD\n1\n=======\nend", "%{a: 1", "using System;\npublic class A : B { }", "import os\n\ndef f(x):\n    return os.path.join(x, 'a')\n", "#!/bin/sh\nset -e\n"],
}


@pytest.mark.parametrize("path", VALID)
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_valid(path, ends):
    text = "﻿" + VALID[path].lstrip().replace("\n", ends)
    tokens, wrong = validity.parse(text, language_of(path))
    assert wrong is None, text[tokens.start[wrong[1]] - 60 : tokens.start[wrong[1]] + 40] if wrong[1] >= 0 else wrong


@pytest.mark.parametrize("path,text", [(p, t) for p, ts in INVALID.items() for t in ts])
def test_invalid(path, text):
    assert sources.look(path, text, False, False)[3] is not None


@pytest.mark.parametrize("text", ["[1 2]", "{:ok 5}", "%{a: 1 b: 2}", '"a" "b"', "f(x) y", "x = 1 2", "[a: 1 b: 2]", "A.f(x) y", "(a) b", "fn -> 1 end 2", ":a b", "A b", "{:ok (x)}", "f.(x) y"])
def test_missing_comma_or_operator(text):
    assert sources.look("a.ex", f"defmodule A do\n  def f(x) do\n    {text}\n  end\nend\n", False, False)[3] is not None


@pytest.mark.parametrize("text", ["f x, y", "A.f x, a: 1", "a.b.c 1", "A.\"f g\" 1", ":m.f 1", "f x do\n1\nend", "A.f x do\n1\nend", "f g h 1", "@spec f(x) :: y", "f (1)", "f(x)(y)", "f.(x).(y)", "A.f(x).g y", "a |> A.f b", "f [1], {2}", "f fn x -> x end", "unquote(f)(x)", "A.unquote(f)(x)", "x[:a].b 1", "f (1), 2", "A.f (1) + 2", "f -1", "f a: 1, b: 2"])
def test_calls_without_brackets_are_valid(text):
    assert sources.look("a.ex", f"defmodule A do\n  def f(x) do\n    {text}\n  end\nend\n", False, False)[3] is None


@pytest.mark.parametrize("path", VALID)
def test_truncation_is_found(path):
    text = VALID[path].lstrip()
    tokens = LEX[language_of(path)](text)
    brackets = [i for i, k in enumerate(tokens.kind) if k in ("{", "(", "do", "[")]
    for i in brackets[:: max(1, len(brackets) // 25)]:
        assert sources.look(path, text[: tokens.end[i]], False, False)[3] is not None, text[tokens.end[i] - 50 : tokens.end[i]]


def test_awkward_contents():
    for path in ("a.ts", "a.js", "a.cs", "a.ex"):
        for text in ("", " \n", "\x00", "é" * 5000, "(" * 3000, "a" * 100_000, "'", '"', "`", "/", "#", "~", "?", ":", "@", "$\"{", "'''", "1e", "=begin"):
            sources.look(path, text, True, True)
    assert sources.look(None, "x", True, True)[0] is None and sources.look("noext", "x", True, True)[2] is None


KINDS = [
    ("a.cs", "// <auto-generated/>\nclass A { }", "generated"),
    ("a.js", "/* eslint-disable */\n// Code generated by foo v1.2. DO NOT EDIT.\nlet a = 1;", "generated"),
    ("a.ts", "// Diese Datei wurde automatisch erzeugt. Änderungen gehen verloren.\nlet a;", "generated"),
    ("a.ex", "# Generated from a.proto by foo.\nx = 1", "generated"),
    ("a.js", "/*! lib v1.2.3 | MIT */\nlet a;", "vendored"),
    ("a.js", "!function(e,t){" + "var a=e[t]<<0;if(!a){b={c:1}}else{d=void 0}" * 20 + "}(1,2)", "minified"),
    ("a.ts", "export const a = [\n" + "1, 0x2f, -3.5,\n" * 40 + "];", "data"),
    ("a.cs", 'class A { static readonly object[] X = {\n' + '"a-1",\n' * 60 + "}; }", "data"),
    ("a.js", "export default " + '"QUJD" +\n' * 30 + '"x";', "data"),
    ("a.ts", '// Writes the "DO NOT EDIT" banner that our code generator puts into its output.\nfunction f(a: number) { return a; }', None),
    ("a.ts", "// Do not edit the list below without asking the depot first.\nlet a = 1;", None),
    ("a.ts", "// The generated report is cached by the caller, see the notes.\nlet a = 1;", None),
    ("a.js", "// NOTE: the minified bundle is served by another host.\nlet a = 1;", None),
    ("a.cs", "// Copyright (c) Us authors. All rights reserved.\nclass A { }", None),
    ("a.js", "export function f(a) {\n  return a;\n}\nconst weights = [" + "1, " * 60 + "];", None),
    ("a.js", "'use strict';\n// @generated by somebody\nlet a = 1;", "generated"),
    ("a.cs", "using System;\n// Code generated by x. DO NOT EDIT.\nnamespace A { class B { } }", "generated"),
    ("a.ex", "defmodule A do\n  alias B\n  # Code generated by x. DO NOT EDIT.\n  def f(x), do: x\nend", "generated"),
    ("a.js", "function f() {\n  // @generated by nobody\n  return 1;\n}", None),
    ("a.js", "let a = 1; // @generated by nobody", None),
    ("a.cs", '{\n  "a": [1, 2, 3, 4, 5, 6, 7],\n  "b": null\n}', None),
]


@pytest.mark.parametrize("path,text,kind", KINDS)
def test_kinds(path, text, kind):
    assert origin.content_kinds(path, text)[:1] == ([kind] if kind else [])


def test_attribute_files_and_paths(spark):
    rows = [
        (1, "r", ".gitattributes", "gen/** linguist-generated\n*.lib.js linguist-vendored=true\n# comment\nhand/vendor/** -linguist-vendored\n"),
        (2, "r", "sub/.gitattributes", "*.lib.js -linguist-vendored\n"),
        (3, "r", "gen/a.ts", "let a = 1;"),
        (4, "r", "b.lib.js", "let a = 1;"),
        (5, "r", "sub/b.lib.js", "let a = 1;"),
        (6, "r", "hand/vendor/c.ts", "let a = 1;"),
        (7, "q", "b.lib.js", "let a = 1;"),
        (8, "q", "x/node_modules/y/z.js", "let a = 1;"),
        (9, "q", "src/vendors/z.js", "let a = 1;"),
        (10, "q", "Src\\A.Designer.cs", "class A { }"),
        (11, "q", "a.cs", None),
        (12, None, None, None),
        (13, "q", "e.js", ""),
    ]
    rows += rows[:4]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_id bigint, repo_id string, path string, content string, kind string")
    got = {r.file_id: r.kind for r in sources.kinds_of(df).collect()}
    assert got == {3: "generated", 4: "vendored", 8: "vendored", 10: "generated"}


SEEN = "file_id bigint, repo_id string, path string, kinds array<string>, said array<array<string>>, content string"


def test_mined_patterns(spark):
    rows = [(i, f"r{i % 5}", f"src/weird/m{i}.ts", ["generated"] if i % 20 else [], [], None) for i in range(60)]
    rows += [(100 + i, f"r{i % 5}", f"src/plain/m{i}.ts", ["generated"] if i % 3 == 0 else [], [], None) for i in range(60)]
    assert {r.file_id for r in origin.not_handwritten(spark.createDataFrame(rows, SEEN)).collect()} == set(range(60)) | set(range(100, 160, 3))


def test_declarations_are_mined_for_repositories_without_any(spark):
    rows = [(1000 + r, f"r{r}", ".gitattributes", None, None, "lib3/** linguist-vendored\n") for r in range(4)]
    rows += [(100 * r + i, f"r{r}", f"{'lib3' if i < 15 else 'own'}/m{i}.ts", [], [], None) for r in range(6) for i in range(30)]
    rows += [(2000, "r1", "x/lib3/a.ts", [], [], None)]  # declares, but not this one
    got = {r.file_id: r.kind for r in origin.not_handwritten(spark.createDataFrame(rows, SEEN)).collect()}
    assert got == {100 * r + i: "vendored" for r in range(6) for i in range(15)}


def test_phrases_are_mined_from_files_named_by_convention(spark):
    """A sentence frequent below vendor/ marks other files; one that hand-written files use as often does not."""
    taken, ours = origin.phrases("// borrowed from upstream release 1.2, leave as is"), origin.phrases("// written by our own people")
    rows = [(i, f"r{i % 7}", f"vendor/m{i}.ts", [], [taken, ours] if i % 2 else [ours], None) for i in range(40)]
    rows += [(100 + i, f"r{i % 7}", f"src/m{i}.ts", [], [taken, ours] if i % 10 == 0 else [ours], None) for i in range(400)]
    got = {r.file_id for r in origin.not_handwritten(spark.createDataFrame(rows, SEEN)).collect()}
    assert got == set(range(40)) | set(range(100, 500, 10))


def test_negative_attributes_take_away_their_own_kind(spark):
    rows = [(0, "r", ".gitattributes", "a/** -linguist-vendored\nb/** linguist-vendored\nb/c/** !linguist-vendored\n*.cs -linguist-generated\n")]
    rows += [(1, "r", "a/x.ts", "// @generated by x\nlet a = 1;"), (2, "r", "a/node_modules/x.ts", "let a = 1;"), (3, "r", "b/x.ts", "let a = 1;"), (4, "r", "b/c/x.ts", "let a = 1;"), (5, "r", "x.g.cs", "class A { }"), (6, "r", "vendor/x.cs", "class A { }"), (7, None, "b/x.ts", "let a = 1;")]
    df = spark.createDataFrame(rows, "file_id bigint, repo_id string, path string, content string")
    assert {r.file_id: r.kind for r in sources.kinds_of(df).collect()} == {1: "generated", 3: "vendored", 6: "vendored"}


def test_attribute_files_of_null_repositories(spark):
    df = spark.createDataFrame([(0, None, ".gitattributes", "b/** linguist-vendored"), (1, None, "b/x.ts", "let a = 1;"), (2, "r", "b/x.ts", "let a = 1;")], "file_id bigint, repo_id string, path string, content string")
    assert [tuple(r) for r in sources.kinds_of(df).collect()] == [(1, "vendored")]


def found(path, text):
    language = language_of(path)
    return [(a, b) for a, b, _ in docs.documented(text, language, LEX[language](text))]


def test_documented_functions():
    ts = """/**
 * Shop tools. Copyright Shop authors.
 */
import { a } from './a';

/** Chooses the open cargo of a permit. */
// eslint-disable-next-line complexity
export async function chooseCargo<T>(a: number): Promise<string> {
  const fake = '/** Not documentation */ function ghost() {';
  return pick(a);
}

/** Choose the cargo. */
function chooseCargo2(a) { }

/** Keeps the greatest number of things. */
const limit = 3;
/**
 * Combines what arrives first.
 * @param b the thing
 */
export const combine =
  async (b: { id: number }): Promise<{ id: number }> => { return b; };
/* Not documentation. */
const plain = function () { };
/** TODO: document this
 * @param {number} x */
const todo = (x) => x;
/** Holds everything that is open. */
export class A<T> extends B {
  /** Limits what may be held. */
  private limit = 85;
  /**
   *
   * @param {number} a
   */
  private static first(a: number) { }
  /** Walks the parcels in the order of arrival. */
  @Memo({ size: 4 })
  protected static async second(a: number, b: string): Promise<void> { }
}
"""
    assert found("a.ts", ts) == [(8, "chooseCargo"), (22, "combine"), (40, "second")]
    cs = """namespace N {
    /// <summary>Holds what is open.</summary>
    public class A : B {
        /// <summary>Names the thing shown.</summary>
        public string Label { get; set; } = "{x";
        /// <summary>
        /// Rejects the open <see cref="Locker"/> of a week.
        /// </summary>
        /// <param name="a">The a.</param>
        // ReSharper disable once All
        [Fact]
        protected override (int, string)
            RejectIt<T>(int a, Dictionary<string, int> b) where T : class
        { _log.Write("x"); return Pick(a); }
        /// <inheritdoc />
        public int Second(int a) => 1;
        /// <summary>  </summary>
        /// <remarks>Returns nothing while the harvest lasts.</remarks>
        internal Dictionary<string, int> Third(int a) => Pick(a);
        /** <summary>
         *  Rejects the inner signal.
         *  </summary> */
        public static async Task<List<int>> Fourth() { }
        /// <summary>Gets n/a.</summary>
        /// <summary>n/a</summary>
        public int Get(int a) => 1;
        /// <summary>n/a</summary>
        public int Sixth(int a) => 1;
    }
}
"""
    assert found("a.cs", cs)[:3] == [(13, "RejectIt"), (19, "Third"), (23, "Fourth")] and "Sixth" not in str(found("a.cs", cs))
    ex = '''defmodule A do
  @moduledoc "Walks it all."
  @doc """
  Orders the pending window.

  ## Examples

      iex> f(1, "do")
  """
  @spec f(integer(), String.t()) :: integer()
  def f(0, _), do: 1
  def f(a, b) when a > 0 do
    a
  end
  @doc false
  def g(a), do: a
  @doc since: "1.4.0"
  def h(a), do: a
  @doc ~s(Copies the raw meter twice.)
  @doc since: "1.4.0"
  # credo:disable-for-next-line
  def i?(a), do: a
  @doc "The j method."
  def j(a), do: a
  @doc """
  """
  def k(a), do: a
end
'''
    assert found("a.ex", ex) == [(11, "f"), (22, "i?")]


def test_documented_functions_of_object_literals_and_arrow_properties():
    js = """const api = {
  limit: 1,
  /** Loads the parcel from disk. */
  load(x) { return g({ x }); },
  /** Moves every crate ashore. */
  async *move(a, b) { if (a) { const c = { d: 1 }; } },
  /** Keeps what was paid last. */
  keep: function (a) { },
  /** Sorts harbours by depth. */
  "sort": async (a) => a,
  /** Counts gulls over water. */
  count: x => x,
  inner: {
    /** Wakes the night watch. */
    wake() { },
  },
  /** Not a function, only a number. */
  size: f(x),
};
export default {
  /** Starts whatever waits. */
  run() {
    /** Opens the inner hatch. */
    function open() { }
  },
};
switch (a) {
  case 1: {
    /** Turns the old key. */
    const turn = (a) => { };
  }
}
const pick = a ? 1 : {
  /** Chooses the better rope. */
  choose() { },
};
class A {
  /** Folds the sail quickly. */
  fold = x => x;
  /** Hides the inner light. */
  #hide = async x => x;
}
"""
    names = ["load", "move", "keep", "sort", "count", "wake", "run", "open", "turn", "choose", "fold", "#hide"]
    assert [n for _, n in found("a.js", js)] == names
    ts = """type T = {
  /** Is called for every row. */
  cb: (x: number) => void;
  /** Holds the nested callbacks. */
  inner: { cb: (x: number) => void };
};
interface I {
  /** Is called when it ends. */
  end: (x: number) => void;
}
const o: { a?: { b: (x: number) => void } } = {
  /** Gives back the whole box. */
  box(): { a: string } { return { a: "" }; },
};
function f(o: { /** Says hello to them. */ cb: (x: number) => void }): { a: string } { return null; }
class B {
  /** Maps the generic cargo. */
  map = <T>(x: T): T => x;
}
"""
    assert [n for _, n in found("a.ts", ts)] == ["box", "map"]


def test_same_function_in_several_modules():
    inner = '  @doc "Starts whatever waits."\n  def run(a), do: a\n'
    ex = f"defmodule A do\n{inner}end\ndefmodule B do\n{inner}  def run(_), do: 1\n  defmodule C do\n{inner}  end\n{inner}end\n"
    assert found("a.ex", ex) == [(3, "run"), (7, "run"), (11, "run"), (14, "run")]


def test_descriptions_may_speak_of_copyright():
    assert docs.informative("Returns the copyright notice of a book.", "load") and docs.informative("Prints the words all rights reserved.", "load")
    for notice in ("Copyright (c) 2020 The Authors", "Copyright Harbour Works. All rights reserved.", "SPDX-License-Identifier: MIT", "Parcels 1.2\nCopyright 2020 A"):
        assert not docs.informative(notice, "load")


def test_assignment_takes_the_nearest_and_uses_each_once():
    text = "/** Counts what is lost. */\n/** Sums up what is left. */\nfunction total(a) { }\nfunction other(a) { }\n"
    assert [(b, c) for _, b, c in docs.documented(text, "javascript", LEX["javascript"](text))] == [("total", "Sums up what is left.")]


def test_dataframes(spark):
    ok = "/** Counts the open things. */\nexport function f(a) {\n  return a;\n}\n"
    rows = [(1, "r", "a.js", ok), (1, "r", "a.js", ok), (2, "r", "vendor/a.js", ok), (3, "r", "b.js", ok + "}"), (4, "r", "c.js", None), (5, "r", "d.js", ""), (None, None, None, None), (6, "r", "e.txt", ok)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_id bigint, repo_id string, path string, content string, language string")
    assert [tuple(r) for r in sources.documented_functions(df).select("file_id", "fn_line", "fn_name").collect()] == [(1, 2, "f")]
    assert {r.file_id for r in sources.invalid_files(df).where("invalid is not null").collect()} == {3}
    assert [tuple(r) for r in sources.rates(df).collect()] == [("r", "javascript", 3, 1, 0.333333)]
    none = df.limit(0)
    assert sources.documented_functions(none).collect() == sources.kinds_of(none).collect() == sources.rates(none).collect() == []


def test_syntax_beyond_the_corpus():
    good = {
        "a.ts": ["const a = [1] as const;", "const b = <const>['x'];", "type T = typeof import('./a');", "declare const x: string;", "const x = {a: 1} as const satisfies T;"],
        "a.js": ["let a = b\n++c\n", "a++\nb--\n", "if (a)\n  ++b\nelse\n  --c", "for (const a of b) {}", "let x = y.return;"],
        "a.cs": ["extern alias X;\nusing A;\nclass B { }", "class A { void F(scoped ref int x) { scoped Span<int> z = a; } }"],
        "a.ex": ["%{:a => 1, b: 2}", "[1, a: 2]", "f a: 1, b: 2", "%{m | a: 1}", "f(a, b,\n c: 1\n)"],
    }
    bad = {"a.js": ["const x;", "return 1;", "with (a) { }"], "a.ts": ["return 1;"], "a.ex": ["%{a: 1, 2 => 3}", "[a: 1, 2]", "f(a: 1, 2)"]}
    assert not [(p, t) for p, ts in good.items() for t in ts if sources.look(p, t, False, False)[3]]
    assert not [(p, t) for p, ts in bad.items() for t in ts if not sources.look(p, t, False, False)[3]]


def test_links_of_comments_and_functions():
    assert found("a.ts", "/** Adds two numbers.\n * @param left x\n * @param right y\n */\nfunction shuffle(deck: number[]) {}\n") == []
    assert found("a.ts", "/** Adds a card to the deck.\n * @param deck x\n */\nfunction shuffle(deck: number[]) {}\n") == [(4, "shuffle")]
    assert found("a.cs", "class A {\n /// <summary>Starts empty and waits.</summary>\n A() { }\n}") == [(3, "A")]
    assert found("a.ex", 'defmodule A do\n  @doc "Sends a letter home."\n  def unquote(name)(x), do: x\nend') == []


def test_heaviest_assignment_equals_brute_force():
    from itertools import permutations

    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        links = {(a, b): float(rng.randrange(1, 20)) for a in range(n) for b in range(m) if rng.random() < 0.6}
        got = docs.heaviest(links)
        assert len(set(got.values())) == len(got)
        best = max((sum(links.get((a, b), 0.0) for a, b in enumerate(p) if b is not None) for p in permutations([*range(m), *[None] * n], n)), default=0.0)
        assert abs(sum(links[a, b] for b, a in got.items()) - best) < 1e-9
