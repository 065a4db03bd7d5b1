"""Functions paired with their documentation.

The functions of a file and its documentation comments are found on the token stream. A
comment is a candidate for the functions that follow it up to the next one; the links between
candidates and functions are weighted by distance, parameter tags and names, and the best
assignment of comments to functions is taken, in which each has one partner at most. Links
that are implausible (something other than attributes, decorators, specs and remarks stands
between) are not made; descriptions that say nothing are rejected.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from ..functions.lexers import CSHARP_KEYWORDS, ECMA_KEYWORDS, Tokens


@dataclass
class Function:
    """A function: its name and place, the place where its definition starts, its parameters' names."""

    name: str
    at: int
    start: int
    params: list[str]


@dataclass
class Comment:
    """A documentation comment: its place, its description, the parameters it names."""

    start: int
    end: int
    text: str
    params: list[str]


_OPEN = {"(": ")", "[": "]", "{": "}", "call(": ")", "at[": "]", "tplhead": "tplend"}


def _close(kinds: list[str], i: int) -> int:
    """The number of the token that closes the bracket at i (the last one, if none does)."""
    depth = 0
    for j in range(i, len(kinds)):
        k = kinds[j]
        if k in _OPEN:
            depth += 1
        elif k in (")", "]", "}", "tplend"):
            depth -= 1
            if not depth:
                return j
    return len(kinds) - 1


def _close_angle(kinds: list[str], i: int) -> int:
    """The number of the token that closes the type arguments at i; i if it opens none."""
    depth, j = 0, i
    while j < len(kinds):
        k = kinds[j]
        if k == "<":
            depth += 1
        elif k == ">":
            depth -= 1
            if not depth:
                return j
        elif k in (";", "{", "}") and depth == 0:
            return i
        elif k in ("(", "["):
            j = _close(kinds, j)
        j += 1
    return i


def _params(t: Tokens, text: str, open_: int) -> list[str]:
    """Names in a parameter list: the last name before a comma, type mark, default or the end, whichever comes first."""
    kinds, out, j, last = t.kind, [], open_ + 1, ""
    end = _close(kinds, open_)
    done = False
    while j <= end:
        k = kinds[j]
        if k in ("(", "[", "{") and j != end:
            j = _close(kinds, j)
        elif k == "," or j == end:
            if last:
                out.append(last)
            last, done = "", False
        elif k in (":", "=", "?", "\\\\"):
            done = True
        elif k == "<":
            j = max(j, _close_angle(kinds, j))
        elif not done and (k == "id" or k[0].isalpha()):
            last = text[t.start[j] : t.end[j]]
        j += 1
    return out


_NOT_NAMES = ECMA_KEYWORDS - {"delete", "default", "in", "import", "continue", "return", "catch", "finally", "throw", "with", "do"}


#: What stands before a brace that opens an object literal (a colon needs a look at what it belongs to).
_BEFORE_OBJECT = frozenset(("=", "(", ",", "[", "?", "&&", "||", "??", "??=", "||=", "&&=", "return", "default", "throw", "await", "yield"))


def _brace(kinds: list[str], i: int, start: int, stack: list[str]) -> str:
    """What the brace at i opens: an object literal, the members of a type, or a block; start: where the statement or member begins."""
    begin = start
    while begin < i and kinds[begin] in ("export", "declare", "default"):
        begin += 1
    if "type" in stack and stack[-1] != "block" or begin + 1 < i and kinds[begin] in ("type", "interface") and kinds[begin + 1][0].isalpha():
        return "type"
    before = kinds[i - 1] if i else ""
    if before == ":":
        if any(kinds[j] == "?" and kinds[j + 1] not in (":", ")", ",") for j in range(start, i - 1)):
            return "object"  # the other branch of a condition
        # A property's value; behind a bracket it is the type that a method returns.
        return "object" if stack and stack[-1] == "object" and kinds[i - 2] != ")" else "block"
    return "object" if before in _BEFORE_OBJECT else "block"


def _function_value(t: Tokens, text: str, p: int) -> list[str] | None:
    """The parameters of the function or arrow that the expression at p is; None if it is neither."""
    kinds, n = t.kind, len(t.kind)
    if p + 1 < n and kinds[p] == "async" and kinds[p + 1] != "=>":
        p += 1
    if p < n and kinds[p] == "function":
        while p < n and kinds[p] != "(":
            p += 1
        return _params(t, text, p) if p < n else []
    if p < n and kinds[p] == "<":
        p = _close_angle(kinds, p) + 1
    if p < n and kinds[p] == "(":
        q = _close(kinds, p) + 1
        if q < n and kinds[q] == ":":
            q = _skip_type(kinds, q)
        return _params(t, text, p) if q < n and kinds[q] == "=>" else None
    return [text[t.start[p] : t.end[p]]] if p + 1 < n and kinds[p + 1] == "=>" else None


def _ecma_functions(t: Tokens, text: str) -> list[Function]:
    kinds, out, n = t.kind, [], len(t.kind)
    # Where a class body's members stand: brace depth by open class.
    stack: list[str] = []
    pending_class = False
    start_of = 0  # first token of the present statement or member
    skip = 0
    for i, k in enumerate(kinds):
        if i < skip:
            continue
        if k == "@":  # a decorator, with its arguments, is no code of its own
            skip = i + 2
            while skip < n and kinds[skip] in (".", "("):
                skip = _close(kinds, skip) + 1 if kinds[skip] == "(" else skip + 2
            continue
        if k == "{":
            stack.append("class" if pending_class else _brace(kinds, i, start_of, stack))
            pending_class = False
            start_of = i + 1
            continue
        if k in ("(", "[", "tplhead"):
            stack.append(k)
        elif k in (")", "]", "tplend"):
            if stack:
                stack.pop()
            continue
        elif k == "}":
            if stack:
                stack.pop()
            start_of = i + 1
            continue
        elif k == ";":
            start_of = i + 1
            continue
        elif k == "class":
            pending_class = i == 0 or kinds[i - 1] != "."
        top = stack[-1] if stack else "block"
        if k == "," and top == "object":
            start_of = i + 1
            continue
        if k == "function" and top in ("block", "class") and (i == 0 or kinds[i - 1] != "."):
            j = i + 1 + (i + 1 < n and kinds[i + 1] == "*")
            before = kinds[start_of:i]
            if j < n and kinds[j] not in ("(", "<") and all(b in ("export", "default", "async", "declare") for b in before):
                p = j + 1
                if p < n and kinds[p] == "<":
                    p = _close_angle(kinds, p) + 1
                if p < n and kinds[p] == "(":
                    out.append(Function(text[t.start[j] : t.end[j]], t.start[j], t.start[start_of], _params(t, text, p)))
        elif k in ("const", "let", "var") and top == "block" and all(b in ("export", "declare") for b in kinds[start_of:i]) and i + 1 < n:
            j = _skip_type(kinds, i + 2)
            if j < n and kinds[j] == "=":
                params = _function_value(t, text, j + 1)
                if params is not None and kinds[i + 1] not in ("{", "["):
                    out.append(Function(text[t.start[i + 1] : t.end[i + 1]], t.start[i + 1], t.start[start_of], params))
        elif top in ("class", "object") and k not in ("(", "[", "*", "@") and i >= start_of:
            # A member: modifiers, a name, type parameters, then the parameter list.
            p = i + 1
            if p < n and kinds[p] == "?":
                p += 1
            if p < n and kinds[p] == "<":
                p = _close_angle(kinds, p) + 1
            head = _without_decorators(kinds, start_of, i)
            if p < n and kinds[p] == "(" and (k in ("id", "str", "priv", "num") or k[0].isalpha()) and all(h[0].isalpha() or h == "*" for h in head) and "=" not in head:
                q = _close(kinds, p) + 1
                if q < n and kinds[q] == ":":
                    q = _skip_type(kinds, q)
                if q < n and (kinds[q] == "{" or top == "class" and (kinds[q] == ";" or t.newline[q])):
                    name = text[t.start[i] : t.end[i]].strip("\"'")
                    out.append(Function(name, t.start[i], t.start[start_of], _params(t, text, p)))
            elif top == "object":
                if i == start_of and i + 1 < n and kinds[i + 1] == ":" and (k in ("id", "str", "num") or k[0].isalpha()):
                    params = _function_value(t, text, i + 2)
                    if params is not None:
                        out.append(Function(text[t.start[i] : t.end[i]].strip("\"'"), t.start[i], t.start[start_of], params))
            elif p < n and kinds[p] in ("=", ":") and k in ("id", "priv") and all(h[0].isalpha() for h in head):
                j = _skip_type(kinds, p)
                params = _function_value(t, text, j + 1) if j < n and kinds[j] == "=" else None
                if params is not None:
                    out.append(Function(text[t.start[i] : t.end[i]], t.start[i], t.start[start_of], params))
    return out


def _skip_type(kinds: list[str], j: int) -> int:
    """The number of the token behind a type mark at j (j itself, if there is none)."""
    n = len(kinds)
    if j < n and kinds[j] == "!":
        j += 1
    if j >= n or kinds[j] != ":":
        return j
    j += 1
    fresh = True  # a brace here begins a type, elsewhere a body
    while j < n:
        k = kinds[j]
        if k in ("=", ";", ",", ")") or (k == "=>" and not (j and kinds[j - 1] == ")" and fresh is None)):
            return j
        if k == "{" and not fresh:
            return j
        if k in ("(", "[", "{"):
            j = _close(kinds, j)
            fresh = False
        elif k == "<":
            j = max(j, _close_angle(kinds, j))
            fresh = False
        else:
            fresh = k in ("|", "&", ":", "?", "extends", "keyof", "readonly", "is")
        j += 1
    return j


def _without_decorators(kinds: list[str], a: int, b: int) -> list[str]:
    out, j = [], a
    while j < b:
        if kinds[j] == "@":
            j += 2
            while j < b and kinds[j] in (".", "("):
                j = _close(kinds, j) + 1 if kinds[j] == "(" else j + 2
            continue
        out.append(kinds[j])
        j += 1
    return out


_TYPES = frozenset(("class", "struct", "interface", "enum", "record", "delegate", "namespace", "using", "event"))
_IN_TYPES = frozenset((".", "::", "<", ">", ",", "?", "[", "]", "(", "*"))
_STATEMENTS = frozenset(("new", "return", "throw", "await", "if", "while", "for", "foreach", "switch", "catch", "lock", "else", "try", "case", "goto", "yield"))
_CS_NAMES_BARRED = CSHARP_KEYWORDS


def _csharp_functions(t: Tokens, text: str) -> list[Function]:
    kinds, out, n = t.kind, [], len(t.kind)
    starts = [0] + [i + 1 for i, k in enumerate(kinds) if k in ("{", "}", ";")]
    classes = {text[t.start[i + 1] : t.end[i + 1]] for i, k in enumerate(kinds[:-1]) if k in ("class", "struct", "record") and kinds[i + 1] == "id"}
    for start in starts:
        j = start
        while j < n and kinds[j] == "[":  # attributes
            j = _close(kinds, j) + 1
        first, name, ident_seen = j, -1, False
        while j < n:
            k = kinds[j]
            if k in _TYPES and (k != "record" or j == first or kinds[j - 1].isalpha()):
                break
            if not k[0].isalpha() and k not in _IN_TYPES:
                break
            if k in _STATEMENTS and not (k == "new" and j > first and kinds[j - 1] in ("public", "internal", "protected", "private", "static")):
                break
            if k == "(":
                before = kinds[j - 1] if j > first else ""
                if before == ">" and name >= 0:
                    found = name
                elif before and (before == "id" or (before.isalpha() and before not in _CS_NAMES_BARRED)):
                    found = j - 1
                else:
                    found = -1
                if found > first or (found == first and before == "id"):
                    # A name with nothing before it is a call; a constructor has modifiers, a method its type.
                    close = _close(kinds, j)
                    after = kinds[close + 1] if close + 1 < n else ""
                    path = found
                    while path - 2 >= first and kinds[path - 1] == ".":
                        path -= 2
                    bare = path == first and after in ("{", "=>", ":") and text[t.start[found] : t.end[found]] in classes  # a constructor
                    if bare or path > first and after in ("{", "=>", ";", "where", ":"):
                        out.append(Function(text[t.start[found] : t.end[found]].lstrip("@"), t.start[found], t.start[start], _params(t, text, j)))
                    break
                if found < 0 and (before in ("", "async", "static", "public", "private", "protected", "internal", "override", "virtual", "abstract", "sealed", "new", "extern", "unsafe", "readonly", "ref", "partial", "<", ",") or not before):
                    j = _close(kinds, j) + 1  # a tuple type
                    continue
                break
            if k == "<":
                name = j - 1
                e = _close_angle(kinds, j)
                if e == j:
                    break
                j = e
            j += 1
    return out


_DEFS = frozenset(("def", "defp", "defmacro", "defmacrop", "defguard", "defguardp", "defdelegate"))


def _elixir_functions(t: Tokens, text: str) -> list[Function]:
    kinds, out, n = t.kind, [], len(t.kind)
    last: tuple[str, str] | None = None
    blocks: list[bool] = []  # whether each open block is a module's
    module = False
    for i in range(n - 1):
        if kinds[i] in ("do", "fn"):
            blocks.append(module and kinds[i] == "do")
            module = False
        elif kinds[i] == "end" and blocks:
            last = None if blocks.pop() else last
        elif kinds[i] == "id" and text[t.start[i] : t.end[i]] in ("defmodule", "defimpl", "defprotocol"):
            last, module = None, True
        if kinds[i] == "id" and (i == 0 or kinds[i - 1] in ("nl", "do", ";", "->")) and text[t.start[i] : t.end[i]] in _DEFS and kinds[i + 1] in ("id", "kw"):
            j = i + 1
            name = text[t.start[j] : t.end[j]].rstrip(":")
            params = _params(t, text, j + 1) if j + 1 < n and kinds[j + 1] == "call(" else []
            if name == "unquote" and kinds[j + 1 : j + 2] == ["call("]:
                continue  # a name that is made up when the module is compiled
            key = (text[t.start[i] : t.end[i]], f"{name}/{len(params)}")
            if key != last:  # further clauses belong to the first one
                out.append(Function(name, t.start[j], t.start[i], params))
            last = key
    return out


FUNCTIONS = {"typescript": _ecma_functions, "javascript": _ecma_functions, "csharp": _csharp_functions, "elixir": _elixir_functions}

# --- documentation ------------------------------------------------------------------------

_TAG = re.compile(r"^\s*@(\w+)\b[ \t]*(.*)$")
_KEPT_TAGS = frozenset(("description", "desc", "summary", "remarks", "classdesc", "fileoverview"))


def _star_lines(body: str) -> list[str]:
    return [re.sub(r"^[ \t]*\*(?!\*)[ \t]?|^[ \t]+(?=\S)", "", x).rstrip() for x in re.split(r"\r\n|\n|\r", body)]


def _jsdoc(body: str) -> tuple[str, list[str]]:
    """Description and parameters of a /** */ comment: text before the first tag, and the texts of describing tags."""
    kept, params, keep = [], [], True
    for line in _star_lines(body):
        m = _TAG.match(line)
        if m:
            keep = m.group(1) in _KEPT_TAGS
            if m.group(1) in ("param", "arg", "argument") and (p := re.match(r"(?:\{[^}]*\}\s*)?\[?([\w$]+)", m.group(2))):
                params.append(p.group(1))
            line = m.group(2)
        if keep:
            kept.append(line)
    text = re.sub(r"\{@\w+\s+([^}]*)\}", r"\1", "\n".join(kept))
    return re.sub(r"<[^>]+>", " ", text), params


def _xmldoc(body: str) -> tuple[str, list[str]]:
    """Description and parameters of an XML comment: summary, remarks and what stands in no element."""
    params = re.findall(r"<param\s+name\s*=\s*[\"']([^\"']+)", body)
    text = re.sub(r"<(param|typeparam|returns?|exception|value|example|permission|seealso|code|inheritdoc|include)\b[^>]*?/>", " ", body)
    text = re.sub(r"<(param|typeparam|returns?|exception|value|example|permission|seealso|code)\b[^>]*>.*?(?:</\1\s*>|$)", " ", text, flags=re.S)
    text = re.sub(r"<(?:see|paramref|typeparamref)\s+\w+\s*=\s*[\"']([^\"']*)[\"']\s*/?>", r" \1 ", text)
    return re.sub(r"<[^>]*>", " ", text), params


def _markdown(body: str) -> str:
    """Elixir's documentation without headings, examples and marks."""
    kept = []
    for line in re.split(r"\r\n|\n|\r", body):
        if re.match(r"\s*#+\s|\s*(iex|\.\.\.)>|\s*```", line):
            if re.match(r"\s*#+\s*(examples?|usage)\b", line, re.I):
                break
            continue
        kept.append(line)
    return "\n".join(kept)


PLACEHOLDERS = frozenset(("todo", "todo document this", "document this", "fixme", "fixme add docs", "add docs", "tbd", "tba", "na", "n a", "none", "xxx", "summary goes here", "description", "summary", "description goes here", "docs go here", "to be documented", "to do", "no description", "missing documentation", "wip", "fill in", "placeholder", "undocumented"))
_FILLERS = frozenset("the a an of for to this that is and method function macro callback helper it its given with in from as on".split())


def _stem(word: str) -> str:
    for end, new in (("ies", "y"), ("ing", ""), ("ied", "y"), ("ed", ""), ("es", ""), ("s", "")):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: len(word) - len(end)] + new
            break
    return word.rstrip("e")


def _name_words(name: str) -> set[str]:
    return {_stem(w.lower()) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", name)}


#: A line or sentence of a licence notice; a description may speak of copyright.
_NOTICE = re.compile(r"^\W*copyright\s*(?:\(c\)|©|\d{4}|by\b)|^\W*(?:\(c\)|©)\s*(?:copyright|\d{4})|(?:^|[.,])\W*all rights reserved\b|^\W*spdx-license-identifier\b", re.I | re.M)


def informative(text: str, name: str) -> bool:
    """Whether a description says more than a placeholder or the function's name."""
    words = re.findall(r"[^\W_]+", text.lower())
    if not words or " ".join(words) in PLACEHOLDERS:
        return False
    if words[0] in ("todo", "fixme", "xxx", "tbd") and len(words) <= 4:
        return False
    if _NOTICE.search(text):
        return False
    own = _name_words(name)
    return any(_stem(w) not in own and w not in own for w in words if w not in _FILLERS)


def _comments(t: Tokens, text: str, language: str) -> list[Comment]:
    out: list[Comment] = []
    if language == "elixir":
        kinds, n = t.kind, len(t.kind)
        for i in range(n - 2):
            if kinds[i] == "@" and kinds[i + 1] == "id" and text[t.start[i + 1] : t.end[i + 1]] == "doc":
                j = i + 2 + (kinds[i + 2] in ("call(", "("))
                if j < n and kinds[j] == "str":
                    s = re.sub(r"^~\w+", "", text[t.start[j] : t.end[j]])
                    s = s.strip("\"'") if s[:1] in "\"'" else s[1:-1]
                    out.append(Comment(t.start[i], t.end[j], _markdown(s), []))
        return out
    for a, b in t.comments:
        c = text[a:b]
        if language == "csharp" and c.startswith("///") and not c.startswith("////"):
            if out and text[out[-1].start : out[-1].start + 3] == "///" and not text[out[-1].end : a].strip():
                last = out[-1]
                out[-1] = Comment(last.start, b, last.text + "\n" + c[3:], [])
            else:
                out.append(Comment(a, b, c[3:], []))
        elif c.startswith("/**") and len(c) > 4 and not c.startswith("/***"):
            out.append(Comment(a, b, c[3:-2], []))
    for c in out:
        if language == "csharp":
            body = c.text if text.startswith("///", c.start) else "\n".join(_star_lines(c.text))
            c.text, c.params = _xmldoc(body)
        else:
            c.text, c.params = _jsdoc(c.text)
    return out


def _between(t: Tokens, text: str, language: str, a: int, b: int) -> bool:
    """Whether only attributes, decorators, specs and remarks stand between two places."""
    i, end = bisect_left(t.start, a), bisect_left(t.start, b)
    for p, q in t.comments[bisect_left(t.comments, (a, 0)) : bisect_left(t.comments, (b, 0))]:
        if text.startswith("/*", p) and ("\n" in text[p:q] or "\r" in text[p:q]):
            return False
    kinds = t.kind
    while i < end:
        k = kinds[i]
        if language == "csharp" and k == "[":
            i = _close(kinds, i) + 1
        elif language == "elixir" and k == "@":
            if text[t.start[i + 1] : t.end[i + 1]] in ("doc", "moduledoc") and not kinds[i + 2] == "kw":
                return False
            depth = 0
            while i < end and (depth or kinds[i] != "nl"):
                depth += (kinds[i] in _OPEN) - (kinds[i] in (")", "]", "}"))
                i += 1
        elif k == "nl":
            i += 1
        elif language in ("typescript", "javascript") and k == "@":
            i += 2
            while i < end and kinds[i] in (".", "("):
                i = _close(kinds, i) + 1 if kinds[i] == "(" else i + 2
        else:
            return False
    return True


#: What near, tagged and named links weigh at most, what foreign tags take away, and what a link must weigh.
NEAR, TAGGED, NAMED, FOREIGN, LEAST = 2.0, 1.0, 1.0, 2.0, 0.5


def weight(c: Comment, f: Function) -> float:
    """How well a comment fits a function: near, its parameters named, its name's words used.

    A comment all of whose parameters are foreign to the function falls below LEAST, unless it uses
    half of the name's words.
    """
    gap = f.start - c.end if f.start >= c.end else 0
    fit = NEAR / (1.0 + gap / 200.0)
    if c.params and f.params:
        known = sum(p in f.params for p in c.params)
        fit += TAGGED * known / len(c.params) if known else -FOREIGN
    own = _name_words(f.name)
    said = {_stem(w) for w in re.findall(r"[^\W_]+", c.text.lower())}
    return fit + (NAMED * len(own & said) / len(own) if own else 0.0)


def heaviest(links: dict[tuple[int, int], float]) -> dict[int, int]:
    """The matching of greatest weight: right node -> left node; links with weights above 0.

    Left nodes are added one by one, each along the alternating path that gains most.
    """
    near: dict[int, list[int]] = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
    owner: dict[int, int] = {}
    for start in near:
        # Longest alternating paths from start (Bellman-Ford; the matching has no gaining cycle).
        gain, came = {start: 0.0}, {}
        queue = [start]
        best, end = 0.0, None
        while queue:
            a = queue.pop(0)
            for b in near[a]:
                if owner.get(b) == a:
                    continue
                g = gain[a] + links[a, b]
                held = owner.get(b)
                if held is None:
                    if g > best + 1e-12:
                        best, end = g, (a, b)
                elif g - links[held, b] > gain.get(held, float("-inf")) + 1e-12:
                    gain[held] = g - links[held, b]
                    came[held] = (a, b)
                    queue.append(held)
        # Giving a link up without another one for its comment may pay, too.
        for a, g in gain.items():
            if a != start and g > best + 1e-12:
                best, end = g, a
        if end is None:
            continue
        at = end if isinstance(end, int) else None
        if at is None:
            a, b = end
            steps = [(a, b)]
            at = a
        else:
            steps = []
            for b in [b for b, o in owner.items() if o == at]:
                del owner[b]
        while at != start:
            a, b = came[at]
            steps.append((a, b))
            at = a
        for a, b in steps:
            owner[b] = a
    return owner


def assign(comments: list[Comment], functions: list[Function], plausible) -> list[tuple[Comment, Function]]:
    """The heaviest assignment of comments to functions, each used once at most.

    A comment is a candidate for the functions around and behind it up to the first that it
    cannot reach; a link below LEAST is no candidate. Where only one comment and one function
    meet, as nearly always, the link is the assignment.
    """
    starts = [f.start for f in functions]
    links: dict[tuple[int, int], float] = {}
    for n, c in enumerate(comments):
        inside = bisect_right(starts, c.start) - 1  # decorators may stand before the comment: the function then starts before it
        first = bisect_left(starts, c.end)
        for k in ([inside] if 0 <= inside < first else []):
            if c.end <= functions[k].at and plausible(c, functions[k]) and (w := weight(c, functions[k])) >= LEAST:
                links[n, k] = w
        for k in range(first, len(functions)):
            if not plausible(c, functions[k]):
                break
            if (w := weight(c, functions[k])) >= LEAST:
                links[n, k] = w
    lefts, rights = {a for a, _ in links}, {b for _, b in links}
    if len(lefts) == len(links) == len(rights):
        pairs = [(b, a) for a, b in links]
    else:
        pairs = list(heaviest(links).items())
    return [(comments[a], functions[b]) for b, a in sorted(pairs)]


def documented(content: str, language: str, tokens: Tokens) -> list[tuple[int, str, str]]:
    """(line, name, description) of the functions of a file with informative documentation."""
    functions = sorted(FUNCTIONS[language](tokens, content), key=lambda f: (f.start, f.at))
    pairs = assign(_comments(tokens, content, language), functions, lambda c, f: _between(tokens, content, language, c.end, max(f.start, c.end)))
    breaks = [m.start() for m in re.finditer(r"\r\n|\n|\r", content)]
    out = []
    for c, f in pairs:
        if informative(c.text, f.name):
            out.append((bisect_left(breaks, f.at) + 1, f.name, " ".join(c.text.split())))
    return out
