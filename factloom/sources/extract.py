"""Facts from source text: TypeScript, JavaScript, Elixir and C#, read structurally on tokens.

One row per fact: nodes, declarations, edges, and references to modules. A file's rows make up
one unit. Only what the scanner understands is emitted; a file with tokens that are none, or
with brackets that do not close, keeps its other facts and is marked partial. Nothing is
resolved here: heritage and calls point to placeholder nodes of a name (quality Structural),
prototype idioms are Derived. Of C# the syntactic facts are read (namespaces, types, members,
modifiers, documentation, test attributes, bases by name, invocations by name); what needs a
compiler (overloads, resolved calls and types) is not.

Defined results: null and empty contents give the file node alone; repeated input rows give
their facts once; unknown extensions give nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.lexers import ECMA_KEYWORDS, ECMA_NAMES, LEX, Tokens, language_of
from ..session import importable

COLUMNS = ("repo_id", "plugin_id", "unit_id", "fact", "id", "kind", "name", "qualified_name", "symbol_id", "source_id", "target_id", "ev_quality", "path", "start_line", "start_col", "end_line", "end_col", "properties")
SCHEMA = ", ".join(f"{c} {'int' if c.endswith(('_line', '_col')) else 'string'}" for c in COLUMNS)
#: Elixir's forms that are no invocations, and its definitions and directives.
CONTROL = frozenset("if unless case cond for with receive try fn quote unquote do end else when raise reraise throw".split())
DEFINITIONS = ("def", "defp", "defmacro", "defmacrop", "defguard", "defguardp", "defdelegate")
DIRECTIVES = ("alias", "import", "require", "use")
#: Longest specifier and name that are kept.
MAX_NAME = 256

_CLOSER = {"(": ")", "[": "]", "{": "}", "call(": ")", "at[": "]", "tplhead": "tplend", "do": "end", "fn": "end", "<<": ">>"}


def _digest(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:20]


class Extraction:
    """The facts of one file."""

    def __init__(self, repo: str, path: str, text: str, language: str) -> None:
        self.repo, self.path, self.text, self.language = repo, path, text, language
        self.unit = f"{language}:file:{path}"
        self.rows: dict[tuple[str, str], dict] = {}
        self.partial = False
        self._lines = [0, *[m.end() for m in re.finditer(r"\r\n|\n|\r", text)]]
        self.file = f"{language}:file:{_digest(path)}"
        self.add("node", self.file, kind="file", name=path.rsplit("/", 1)[-1], qualified_name=path)

    def place(self, at: int) -> tuple[int, int]:
        """1-based line and column, in UTF-16 code units."""
        line = bisect.bisect_right(self._lines, at) - 1
        before = self.text[self._lines[line] : at]
        return line + 1, len(before) + sum(ord(c) > 0xFFFF for c in before) + 1

    def add(self, fact: str, id_: str, start: int | None = None, end: int | None = None, **columns: object) -> None:
        row = dict.fromkeys(COLUMNS) | {"repo_id": self.repo, "plugin_id": f"plugin.{self.language}", "unit_id": self.unit, "fact": fact, "id": id_, "path": self.path} | columns
        if start is not None:
            row["start_line"], row["start_col"] = self.place(start)
            row["end_line"], row["end_col"] = self.place(end if end is not None else start)
        had = self.rows.get((fact, id_))
        if had is None or (had["symbol_id"] is None and row["symbol_id"] is not None):  # a symbol replaces its placeholder
            self.rows[fact, id_] = row

    def edge(self, kind: str, source: str, target: str, start: int, end: int, quality: str = "Structural") -> None:
        self.add("edge", f"edge:{_digest(kind, source, target, str(start))}", start, end, kind=kind, source_id=source, target_id=target, ev_quality=quality)

    def symbol(self, kind: str, name: str, container: str, label: str, at: int, name_end: int, end: int, own_path: bool = False, **props: object) -> str:
        """A node with its declaration and the edges from its file and container."""
        qualified = f"{label}.{name}" if label else name
        key = _digest(kind, qualified, *([self.path] if own_path else []))
        id_ = f"{self.language}:{kind}:{key}"
        symbol = f"{self.language}:symbol:{kind}:{key}"
        kept = {k: v for k, v in props.items() if v}
        self.add("node", id_, kind=kind, name=name, qualified_name=qualified, symbol_id=symbol, properties=json.dumps(kept, sort_keys=True) if kept else None)
        self.add("declaration", f"decl:{_digest(symbol, self.path, str(at))}", at, end, symbol_id=symbol, source_id=id_, properties=json.dumps(kept, sort_keys=True) if kept else None)
        self.edge("declares", self.file, id_, at, name_end)
        self.edge("contains", container, id_, at, name_end)
        return id_

    def named(self, kind: str, name: str) -> str:
        """A placeholder node for a name that is not resolved."""
        id_ = f"{self.language}:{kind}:{_digest(kind, name)}"
        self.add("node", id_, kind=kind, name=name.rsplit("/", 1)[-1].rsplit(".", 1)[-1] or name, qualified_name=name)
        return id_

    def module(self, form: str, specifier: str | None, source: str, start: int, end: int) -> None:
        """A reference to a module; escapes and overlong specifiers are not decoded."""
        if specifier is not None and ("\\" in specifier or len(specifier) > MAX_NAME):
            specifier = None
        self.add("module", f"mod:{_digest(self.path, form, str(start))}", start, end, kind=form, name=specifier, source_id=source)
        if specifier:
            self.edge("imports", source, self.named("namespace", specifier), start, end)


def _match(kinds: list[str]) -> dict[int, int]:
    """Closing token of every bracket; brackets that do not close are left out."""
    out, stack = {}, []
    for i, k in enumerate(kinds):
        if k in _CLOSER:
            stack.append(i)
        elif k in (")", "]", "}", "tplend", "end", ">>"):
            while stack and _CLOSER[kinds[stack[-1]]] != k:
                stack.pop()
            if stack:
                out[stack.pop()] = i
    return out


_MODIFIERS = ("public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor", "get", "set")


def _ecma(x: Extraction, t: Tokens) -> None:
    kinds, close, n = t.kind, _match(t.kind), len(t.kind)
    word = lambda i: x.text[t.start[i] : t.end[i]]
    is_name = lambda i: i < n and (kinds[i] == "id" or kinds[i] in ECMA_NAMES)
    x.partial = "error" in kinds or any(k in _CLOSER and i not in close for i, k in enumerate(kinds) if k in ("(", "[", "{"))

    def until(i: int, stops: tuple[str, ...]) -> int:
        while i < n and kinds[i] not in stops:
            i = close.get(i, i) + 1
        return i

    def heritage(i: int, body: int, owner: str, kind: str) -> None:
        form = "inherits"
        while i < body:
            if kinds[i] in ("extends", "implements"):
                form = "inherits" if kinds[i] == "extends" else "implements"
            elif is_name(i) and kinds[i - 1] in ("extends", "implements", ","):
                j = i
                while j + 2 < body and kinds[j + 1] == ".":
                    j += 2
                target = x.named("interface" if form == "implements" or kind == "interface" else "type", x.text[t.start[i] : t.end[j]])
                x.edge(form, owner, target, t.start[i], t.end[j])
                i = j
            elif kinds[i] == "<":
                depth = 0
                while i < body:
                    depth += (kinds[i] == "<") - (kinds[i] == ">")
                    if not depth:
                        break
                    i += 1
            i = close.get(i, i) + 1

    def members(i: int, end: int, owner: str, label: str, in_interface: bool) -> None:
        while i < end:
            first, mods = i, []
            while i < end and kinds[i] == "@":
                i += 2
                while i < end and kinds[i] in (".", "("):
                    i = close.get(i, i) + 1 if kinds[i] == "(" else i + 2
            while i + 1 < end and (kinds[i] in _MODIFIERS or kinds[i] == "*") and kinds[i + 1] not in ("(", "=", ":", ";", "?", "<"):
                mods.append(kinds[i])
                i += 1
            at = i
            if is_name(at) or (at < end and kinds[at] in ("priv", "str") and not in_interface) or (at < end and kinds[at] in ECMA_KEYWORDS and at + 1 < end and kinds[at + 1] in ("(", ":", "?", "=")):
                j = at + 1 + (at + 1 < end and kinds[at + 1] in ("?", "!"))
                callable_ = j < end and kinds[j] in ("(", "<")
                stop = j
                while stop < end and kinds[stop] not in (";", ",") and not (stop > j and t.newline[stop] and kinds[stop - 1] in ("}", ")", "]", "num", "str", "id", "tpl", "tplend")):
                    brace = kinds[stop] == "{"
                    stop = close.get(stop, stop) + 1
                    if brace and callable_:
                        break
                stop = max(stop, at + 1)
                access = next((m for m in mods if m in ("public", "private", "protected")), None)
                kind = "callable" if callable_ and "get" not in mods and "set" not in mods else "property" if in_interface or "get" in mods or "set" in mods else "field"
                x.symbol(kind, word(at).strip("\"'"), owner, label, t.start[first], t.end[at], t.end[min(stop, end) - 1], True, access=access, modifiers=sorted(m for m in mods if m not in ("async", "*", access)) or None, optional=kinds[at + 1 : at + 2] == ["?"])
                i = stop + (stop < end and kinds[stop] in (";", ","))
            else:
                i = close.get(i, i) + 1

    def walk(i: int, end: int, container: str, label: str, top: bool) -> None:
        while i < end:
            first, exported = i, False
            while i < end and kinds[i] in ("export", "default", "declare", "abstract", "async", "@"):
                if kinds[i] == "@":
                    i += 2
                    while i < end and kinds[i] in (".", "("):
                        i = close.get(i, i) + 1 if kinds[i] == "(" else i + 2
                    continue
                if kinds[i] == "async" and not (i + 1 < end and kinds[i + 1] == "function"):
                    break
                exported = exported or kinds[i] == "export"
                i += 1
            exported = exported and top  # a namespace's own exports are not the module's
            if i >= end:
                break
            k = kinds[i]
            props = {"exported": exported}
            done = None
            if k == "class" or (k in ("interface", "enum", "namespace", "module") and is_name(i + 1)):
                named = is_name(i + 1)
                body = until(i + 1, ("{",))
                if body < n and body in close:
                    kind = {"interface": "interface", "namespace": "namespace", "module": "namespace"}.get(k, "type")
                    name = word(i + 1) if named else "default"
                    id_ = x.symbol(kind, name, container, label, t.start[first], t.end[i + 1 if named else i], t.end[close[body]], k in ("class", "interface"), **props)
                    inside = f"{label}.{name}" if label else name
                    if k in ("class", "interface"):
                        heritage(i + 1, body, id_, kind)
                        members(body + 1, close[body], id_, inside, k == "interface")
                    elif k in ("namespace", "module"):
                        walk(body + 1, close[body], id_, inside, False)
                    if exported:
                        export(name, "both" if k in ("class", "enum") else "type" if k == "interface" else "unknown", i, kinds[first : i + 1])
                    done = close[body] + 1
            elif k == "type" and is_name(i + 1) and i + 2 < end and kinds[i + 2] in ("=", "<"):
                stop = until(i + 2, (";",)) if kinds[i + 2] == "=" else until(i + 3, (";",))
                x.symbol("type", word(i + 1), container, label, t.start[first], t.end[i + 1], t.end[min(stop, end) - 1], True, alias=True, **props)
                if exported:
                    export(word(i + 1), "type", i, kinds[first : i + 1])
                done = stop + 1
            elif k == "function" or (k == "async" and i + 1 < end and kinds[i + 1] == "function"):
                j = i + 1 + (k == "async")
                j += j < end and kinds[j] == "*"
                if is_name(j) or "default" in kinds[first:i]:
                    body = until(j, ("{", ";"))
                    stop = close.get(body, body)
                    name = word(j) if is_name(j) else "default"
                    x.symbol("callable", name, container, label, t.start[first], t.end[j], t.end[min(stop, n - 1)], **props)
                    if exported:
                        export(name, "value", i, kinds[first : i + 1])
                    done = stop + 1
            elif k in ("const", "let", "var") and top:
                j = i + 1
                while is_name(j):
                    eq = j + 1
                    while eq < end and kinds[eq] not in ("=", ",", ";") and not (t.newline[eq] and kinds[eq] in ECMA_KEYWORDS):
                        eq = close.get(eq, eq) + 1
                    valued = eq < end and kinds[eq] == "="
                    arrow = valued and any(kinds[q] in ("function", "=>") for q in range(eq + 1, min(eq + 3, end)))
                    if valued and not arrow:
                        q = eq + 1 + (eq + 1 < end and kinds[eq + 1] == "async")
                        q = close.get(q, q) + 1 if q < end and kinds[q] == "(" else q
                        while q < end and kinds[q] not in ("=>", ";", ",", "}") and not t.newline[q]:
                            q = close.get(q, q) + 1
                        arrow = q < end and kinds[q] == "=>" and kinds[eq + 1] in ("(", "async", "<") or False
                    stop = eq
                    while stop < end and kinds[stop] not in (";", ",") and not (stop > eq + 1 and t.newline[stop] and kinds[stop] in ("const", "let", "var", "function", "class", "export", "import", "if", "for", "return", "interface", "type")):
                        stop = close.get(stop, stop) + 1
                    x.symbol("callable" if arrow else "field", word(j), container, label, t.start[first], t.end[j], t.end[min(stop, end) - 1], modifiers=[k], **props)
                    if exported:
                        export(word(j), "value", j, ["export"])
                    j = stop + 1 if stop < end and kinds[stop] == "," else n
                    done = stop + 1
            elif k in ("import", "{", "*", "=") or (exported and k == "type"):
                stop = until(i, (";",))
                line = next((q for q in range(i + 1, min(stop, end)) if t.newline[q] and kinds[q] in ("import", "export", "const", "let", "var", "function", "class", "interface")), stop)
                stop = min(stop, line)
                source = next((q for q in range(i, min(stop, end)) if kinds[q] == "str"), None)
                if k == "import" and kinds[i + 1 : i + 2] != ["("] or (exported and source is not None):
                    star = "*" in kinds[first:stop]
                    typed = "type" in kinds[first : first + 3]
                    if k == "import":
                        form = "import-type" if typed else "import"
                    else:
                        form = ("export-namespace-from" if "as" in kinds[first:stop] else "export-star") if star else "export-type-from" if typed else "export-from"
                    if source is not None:
                        x.module(form, word(source)[1:-1], x.file, t.start[first], t.end[source])
                elif exported and k == "{":
                    j = i + 1
                    while j < close.get(i, i):
                        q = j
                        while q < close[i] and kinds[q] != ",":
                            q += 1
                        export(word(q - 1), "type" if kinds[j] == "type" else "unknown", q - 1, ["export"], word(j))
                        j = q + 1
                if k != "{" or exported:
                    done = stop + (stop < end and kinds[stop] == ";")
                elif i in close:
                    done = close[i] + 1
            elif exported and "default" in kinds[first:i]:
                export(word(i) if is_name(i) and i + 1 < n and kinds[i + 1] == ";" else None, "unknown", i, kinds[first:i])
            i = max(done if done is not None else close.get(i, i) + 1, first + 1)

    def export(local: str | None, projection: str, at: int, head: list[str], own: str | None = None) -> None:
        name = "default" if "default" in head else local
        if not name or len(name) > MAX_NAME or at >= n:
            return
        slot = f"{x.language}:export:{_digest(x.path, name)}"
        x.add("node", slot, kind="export", name=name, qualified_name=f"{x.path}#{name}", properties=json.dumps({"local": own or local, "projection": projection}, sort_keys=True))
        x.edge("exports", x.file, slot, t.start[at], t.end[at])

    walk(0, n, x.file, "", True)
    for i in range(n - 1):
        if kinds[i + 1] == "(" and is_name(i) and (i == 0 or kinds[i - 1] not in ("function", "new", "*")):
            if kinds[i - 1 : i] == ["."] and i >= 2 and is_name(i - 2) and word(i - 2) == "Object" and word(i) in ("create", "setPrototypeOf"):
                args = [q for q in range(i + 2, close.get(i + 1, i + 1)) if is_name(q)]
                if args:
                    x.edge("inherits", x.file, x.named("type", word(args[-1] if word(i) == "setPrototypeOf" else args[0])), t.start[i], t.end[i], "Derived")
            after = kinds[close.get(i + 1, i + 1) + 1 : close.get(i + 1, i + 1) + 2]
            if word(i) == "require" and kinds[i + 2 : i + 3] == ["str"]:
                x.module("require", word(i + 2)[1:-1], x.file, t.start[i], t.end[i + 2])
            elif after not in (["{"], [":"]):
                x.edge("invokes-name", x.file, x.named("callable", word(i)), t.start[i], t.end[i])
        elif kinds[i] == "new" and is_name(i + 1):
            x.edge("invokes-name", x.file, x.named("callable", word(i + 1)), t.start[i + 1], t.end[i + 1])
        elif kinds[i] == "import" and kinds[i + 1] == "(":
            lone = kinds[i + 2 : i + 4] == ["str", ")"]
            x.module("dynamic-import", word(i + 2)[1:-1] if lone else None, x.file, t.start[i], t.end[i + 1])


def _elixir(x: Extraction, t: Tokens) -> None:
    kinds, n = t.kind, len(t.kind)
    word = lambda i: x.text[t.start[i] : t.end[i]]
    close = _match(kinds)
    x.partial = "error" in kinds
    dotted = lambda i: next((j - 1 for j in range(i + 1, n + 1) if j >= n or kinds[j] not in (".", "alias")), n - 1)

    def walk(i: int, end: int, container: str, label: str) -> None:
        attribute = False
        while i < end:
            k = kinds[i]
            if k == "@":
                attribute = True
            elif k == "nl" and (i + 1 >= n or kinds[i + 1] != "nl"):
                attribute = False
            w = word(i) if k == "id" else ""
            if w in ("defmodule", "defprotocol") and i + 1 < end and kinds[i + 1] == "alias":
                last = dotted(i + 1)
                body = next((q for q in range(last, end) if kinds[q] == "do"), None)
                if body is not None and body in close:
                    name = x.text[t.start[i + 1] : t.end[last]]
                    id_ = x.symbol("interface" if w == "defprotocol" else "type", name, container, label, t.start[i], t.end[last], t.end[close[body]])
                    walk(body + 1, close[body], id_, f"{label}.{name}" if label else name)
                    i = close[body]
            elif w in DEFINITIONS and i + 1 < end and kinds[i + 1] in ("id", "kw"):
                opens = kinds[i + 2] == "call(" if i + 2 < n else False
                stop = close.get(i + 2, i + 2) if opens else i + 1
                inside = range(i + 3, stop) if opens else range(0)
                depth = arity = 0
                for q in inside:
                    depth += (kinds[q] in _CLOSER) - (kinds[q] in (")", "]", "}", "end", ">>"))
                    arity += kinds[q] == "," and depth == 0
                arity += bool(len(inside))
                q = stop
                while q < end and kinds[q] not in ("do", "nl"):
                    q = close.get(q, q) + 1 if kinds[q] != "do" else q
                last = close.get(q, q) if q < end and kinds[q] == "do" else q - 1
                x.symbol("callable", f"{word(i + 1).rstrip(':')}/{arity}", container, label, t.start[i], t.end[i + 1], t.end[min(max(last, stop), n - 1)], access="private" if w.endswith("p") and w != "defguard" else "public")
                walk(stop + 1, max(last, stop) + 1, container, label) if last > stop else None
                i = max(last, stop)
            elif w in DIRECTIVES and i + 1 < end and kinds[i + 1] == "alias" and (i == 0 or kinds[i - 1] in ("nl", "do", ";")):
                last = dotted(i + 1)
                x.module(w, x.text[t.start[i + 1] : t.end[last]], x.file, t.start[i], t.end[last])
                i = last
            elif w and not attribute and w not in CONTROL and i + 1 < n and kinds[i + 1] == "call(" and kinds[i - 1 : i] != ["@"]:
                x.edge("invokes-name", x.file, x.named("callable", w), t.start[i], t.end[i])
            i += 1

    walk(0, n, x.file, "")


_CS_MODIFIERS = frozenset("public private protected internal static readonly abstract override sealed virtual async partial extern unsafe new const volatile required file ref".split())
_CS_ACCESS = ("public", "protected", "internal", "private")
#: Attributes that mark a test.
TEST_ATTRIBUTES = frozenset(("Fact", "Theory", "Test", "TestCase", "TestMethod", "DataTestMethod"))


def _csharp(x: Extraction, t: Tokens) -> None:
    kinds, n = t.kind, len(t.kind)
    word = lambda i: x.text[t.start[i] : t.end[i]]
    close = _match(kinds)
    x.partial = "error" in kinds or any(k in ("(", "[", "{") and i not in close for i, k in enumerate(kinds))
    ends = [b for _, b in t.comments]

    def documentation(at: int) -> str | None:
        """The summary of the /// lines directly before a place."""
        lines, i = [], bisect.bisect_right(ends, at) - 1
        while i >= 0 and x.text.startswith("///", t.comments[i][0]) and not x.text[t.comments[i][1] : at].strip():
            at = t.comments[i][0]
            lines.insert(0, x.text[at + 3 : t.comments[i][1]])
            i -= 1
        text = "\n".join(lines)
        inner = re.search(r"<summary>(.*?)</summary>", text, re.S)
        return " ".join(re.sub(r"<[^>]+>", " ", inner.group(1) if inner else text).split()) or None

    def calls(a: int, b: int, source: str) -> None:
        for q in range(a, b):
            if kinds[q] == "id" and q + 1 < n and kinds[q + 1] == "(" and kinds[q - 1] != "new":
                x.edge("invokes-name", source, x.named("callable", word(q)), t.start[q], t.end[q])
            elif kinds[q] == "new" and q + 1 < n and kinds[q + 1] == "id":
                x.edge("invokes-name", source, x.named("callable", word(q + 1)), t.start[q + 1], t.end[q + 1])

    def name_before(j: int) -> int:
        """The name that stands before a token, type parameters left out."""
        j -= 1
        if kinds[j] == ">":
            depth = 0
            while j > 0:
                depth += (kinds[j] == ">") - (kinds[j] == "<")
                j -= 1
                if not depth:
                    break
        return j

    def end_of(j: int, end: int) -> int:
        """The last token of what begins before j: a block, or all up to a semicolon."""
        while j < end and kinds[j] not in (";", "{"):
            j = close.get(j, j) + 1 if kinds[j] in ("(", "[") else j + 1
        if j < end and kinds[j] == "{":
            j = close.get(j, end - 1)
            if j + 1 < end and kinds[j + 1] == "=":  # a property with a value
                return end_of(j + 1, end)
        return min(j, end - 1)

    def bases(a: int, b: int, id_: str, interface: bool) -> None:
        depth, at = 0, True
        for q in range(a, b):
            if kinds[q] == "where":
                return
            if at and not depth and kinds[q] == "id":
                last = q
                while last + 2 < b and kinds[last + 1] == "." and kinds[last + 2] == "id":
                    last += 2
                name = x.text[t.start[q] : t.end[last]]
                contract = interface or re.match(r"I[A-Z]", word(last)) is not None
                x.edge("implements" if contract and not interface else "inherits", id_, x.named("interface" if contract else "type", name), t.start[q], t.end[last])
                at = False
            depth += (kinds[q] in ("<", "(")) - (kinds[q] in (">", ")"))
            at = at or (kinds[q] == "," and not depth)

    def walk(i: int, end: int, container: str, label: str, owner: str | None) -> None:
        while i < end:
            start, marks = i, set()
            while i < end and kinds[i] == "[" and i in close:
                marks |= {word(q) for q in range(i + 1, close[i]) if kinds[q] == "id" and kinds[q - 1] in ("[", ",", ".")}
                i = close[i] + 1
            first, mods = i, []
            while i < end and kinds[i] in _CS_MODIFIERS:
                mods.append(kinds[i])
                i += 1
            if i >= end:
                return
            k = kinds[i]
            access = " ".join(m for m in mods if m in _CS_ACCESS) or ("public" if owner == "" else "private" if owner else "internal")
            props = {"access": access, "static": "true" if "static" in mods else None, "abstract": "true" if "abstract" in mods else None, "doc-summary": documentation(t.start[start]), "test-method": "true" if marks & TEST_ATTRIBUTES else None}
            if k == "using" and owner is None:
                stop = end_of(i, end)
                names = [q for q in range(i + 1, stop) if kinds[q] == "id"]
                if names and kinds[stop] == ";":
                    equals = next((q for q in range(i + 1, stop) if kinds[q] == "="), i)
                    names = [q for q in names if q > equals]
                    if names:
                        x.module("using", x.text[t.start[names[0]] : t.end[stop - 1]], x.file, t.start[i], t.end[stop])
                i = stop + 1
            elif k == "namespace" and i + 1 < end:
                last = i + 1
                while last + 2 < end and kinds[last + 1] == ".":
                    last += 2
                name = x.text[t.start[i + 1] : t.end[last]]
                id_ = x.named("namespace", f"{label}.{name}" if label else name)
                x.edge("contains", x.file, id_, t.start[i], t.end[last])
                body = last + 1
                if body < end and kinds[body] == "{":
                    walk(body + 1, close.get(body, end), id_, f"{label}.{name}" if label else name, None)
                    i = close.get(body, end) + 1
                else:
                    walk(body + 1, end, id_, f"{label}.{name}" if label else name, None)
                    return
            elif k in ("class", "struct", "interface", "enum") or (k == "record" and i + 1 < end and kinds[i + 1] in ("id", "class", "struct")):
                at = i + 1 + (k == "record" and kinds[i + 1] in ("class", "struct"))
                if at >= end:
                    return
                name, body = word(at), at + 1
                colon = None
                while body < end and kinds[body] not in ("{", ";"):
                    colon = body if kinds[body] == ":" and colon is None else colon
                    body = close.get(body, body) + 1 if kinds[body] == "(" else body + 1
                stop = close.get(body, end - 1) if body < end and kinds[body] == "{" else min(body, end - 1)
                id_ = x.symbol("interface" if k == "interface" else "type", name, container, label, t.start[first], t.end[at], t.end[stop], **props)
                if colon is not None:
                    bases(colon + 1, body, id_, k == "interface")
                inner = f"{label}.{name}" if label else name
                if k == "enum":
                    for q in range(body + 1, stop):
                        if kinds[q] == "id" and kinds[q - 1] in ("{", ",", "]"):
                            x.symbol("field", word(q), id_, inner, t.start[q], t.end[q], t.end[q], access="public")
                elif stop > body:
                    walk(body + 1, stop, id_, inner, "" if k == "interface" else name)
                i = stop + 1
            elif k == "delegate" and (at := next((q for q in range(i, end) if kinds[q] in ("(", ";")), end)) < end and kinds[at] == "(":
                at = name_before(at)
                stop = end_of(at, end)
                x.symbol("type", word(at), container, label, t.start[first], t.end[at], t.end[stop], **props)
                i = stop + 1
            elif owner is not None and k not in ("}", ";"):
                j, angle = close.get(i, i) + 1 if k == "(" else i, 0
                while j < end and (angle or kinds[j] not in ("(", "{", ";", "=", "=>")):
                    angle = max(0, angle + (kinds[j] == "<") - (kinds[j] == ">")) if "operator" not in kinds[i:j] else 0
                    j = close.get(j, j) + 1 if kinds[j] == "[" or (angle and kinds[j] == "(") else j + 1
                if j >= end:
                    return
                at, stop = name_before(j), end_of(j, end)
                if kinds[at] == "id" or kinds[at].isalpha():
                    if kinds[j] == "(" and at >= i:
                        id_ = x.symbol("callable", word(at), container, label, t.start[first], t.end[at], t.end[stop], **props)
                        calls(close.get(j, j), stop, id_)
                    elif kinds[j] in ("{", "=>") and at > i and k != "event":
                        calls(j, stop, x.symbol("property", word(at), container, label, t.start[first], t.end[at], t.end[stop], **props))
                    elif kinds[j] in ("=", ";") and at > i:
                        calls(j, stop, x.symbol("field", word(at), container, label, t.start[first], t.end[at], t.end[stop], **props))
                i = stop + 1
            else:
                i = max(i, start) + 1

    walk(0, n, x.file, "", None)


def extract(repo: str, path: str, content: str | None) -> list[dict]:
    """The fact rows of one file."""
    language = language_of(path)
    if language is None:
        return []
    x = Extraction(repo, path, content or "", language)
    if content:
        {"elixir": _elixir, "csharp": _csharp}.get(language, _ecma)(x, LEX[language](content))
    rows = list(x.rows.values())
    if x.partial:
        x.add("warning", f"warn:{_digest(path)}", kind="plugin.partial-result")
        rows = list(x.rows.values())
    return rows


def facts(files: DataFrame) -> DataFrame:
    """Fact rows (COLUMNS) of files (repo_id, path, content as text), each distinct file once."""
    importable(files.sparkSession)
    types = pa.schema([(c, pa.int32() if c.endswith(("_line", "_col")) else pa.string()) for c in COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = extract(row["repo_id"], row["path"], row["content"]) if row["path"] else []
                if found:
                    yield pa.RecordBatch.from_pylist(found, types)

    return files.select("repo_id", "path", "content").distinct().mapInArrow(run, SCHEMA)
