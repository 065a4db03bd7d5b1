"""Token streams of TypeScript, JavaScript, C# and Elixir.

A token's kind is its text for keywords and punctuation, else its class (``id``, ``num``,
``str``, ...). What cannot be a token (an unterminated string or comment, a stray character)
has the kind ``error``; lexing goes on behind it. Comments are kept apart with their places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

LANGUAGES = {".ts": "typescript", ".js": "javascript", ".cs": "csharp", ".ex": "elixir"}


def language_of(path: str | None) -> str | None:
    """The language of a path's extension."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    return LANGUAGES.get(name[name.rfind(".") :]) if "." in name else None


@dataclass
class Tokens:
    """Parallel lists of the tokens' kinds and places; whether a line ends before each; the comments."""

    kind: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    newline: list[bool] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)

    def add(self, kind: str, start: int, end: int, newline: bool) -> None:
        self.kind.append(kind)
        self.start.append(start)
        self.end.append(end)
        self.newline.append(newline)


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# The languages' keywords. Words that may also be names come second.
ECMA_KEYWORDS = _words("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with")
ECMA_NAMES = _words("async await of get set static let yield from as type interface namespace module declare abstract readonly private protected public implements keyof infer is asserts satisfies override accessor unique require global out")
CSHARP_KEYWORDS = _words("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while")
CSHARP_NAMES = _words("add alias and ascending async await by descending equals file from get global group init into join let managed nameof not on or orderby partial record remove required scoped select set unmanaged value var when where with yield dynamic")
ELIXIR_KEYWORDS = _words("after and catch do else end false fn in nil not or rescue true when")

_ID = r"[^\W\d][\w$]*"
_ECMA = re.compile(
    r"(?P<ws>[ \t\v\f\xa0﻿]+)|(?P<nl>\r\n?|[\n  ])|(?P<line>//[^\r\n  ]*)|(?P<block>/\*[\s\S]*?\*/)"
    r"|(?P<id>[$\w&&[^\d]][\w$‌‍]*)".replace("[$\\w&&[^\\d]]", r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})")
    + r"|(?P<num>0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<str>\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<priv>#[^\W\d][\w$]*)"
    r"|(?P<op>\.\.\.|=>|===|!==|\*\*=|&&=|\|\|=|\?\?=|<<=|==|!=|\*\*|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|<<|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
)
_ECMA_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-zA-Z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
#: After these kinds a slash divides.
_VALUES = _words("id num str regex tpl tplend priv ) ] } this super null true false ++ --") | ECMA_NAMES


def ecma(text: str) -> Tokens:
    """Tokens of TypeScript or JavaScript."""
    out, at, n, newline = Tokens(), 0, len(text), False
    add = out.add
    if text.startswith("﻿"):
        at = 1
    if text.startswith("#!", at):
        m = re.compile(r"[^\r\n]*").match(text, at)
        out.comments.append((at, m.end()))
        at = m.end()
    braces: list[str] = []
    last = ""
    while at < n:
        c = text[at]
        if c == "`" or (c == "}" and braces and braces[-1] == "`"):
            head = c == "`"
            m = _TEMPLATE.match(text, at + 1)
            if not m:
                add("error", at, n, newline)
                return out
            if head:
                last = "tpl" if m.group(1) == "`" else "tplhead"
                if last == "tplhead":
                    braces.append("`")
            else:
                last = "tplmid"
                if m.group(1) == "`":
                    braces.pop()
                    last = "tplend"
            add(last, at, m.end(), newline)
            at, newline = m.end(), False
            continue
        if c == "/" and last not in _VALUES and text[at + 1 : at + 2] not in ("/", "*"):
            m = _ECMA_REGEX.match(text, at)
            if m:
                last = "regex"
                add(last, at, m.end(), newline)
                at, newline = m.end(), False
                continue
        m = _ECMA.match(text, at)
        if not m:
            add("error", at, at + 1, newline)
            last, newline, at = "error", False, at + 1
            if c in "\"'" or text.startswith("/*", at - 1):
                return out
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "ws":
            pass
        elif kind == "nl":
            newline = True
        elif kind in ("line", "block"):
            out.comments.append((at, end))
            newline = newline or (kind == "block" and ("\n" in m.group() or "\r" in m.group()))
        else:
            if kind == "op" and text.startswith("/*", at):
                add("error", at, n, newline)
                return out
            if kind == "id":
                word = m.group()
                last = word if word in ECMA_KEYWORDS or word in ECMA_NAMES else "id"
            elif kind == "op":
                last = m.group()
                if last == "{":
                    braces.append("{")
                elif last == "}" and braces:
                    braces.pop()
            else:
                last = kind
            if kind == "num" and end < n and (text[end].isalnum() or text[end] in "_$"):
                last = "error"
            add(last, at, end, newline)
            newline = False
        at = end
    return out


_CSHARP = re.compile(
    r"(?P<ws>[ \t\v\f\xa0﻿]+)|(?P<nl>\r\n?|[\n\u0085  ])|(?P<line>//[^\r\n\u0085  ]*)|(?P<block>/\*[\s\S]*?\*/)"
    r"|(?P<id>@?[^\W\d]\w*)"
    r"|(?P<num>0[xX][\da-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[uUlLfFdDmM]*)"
    r"|(?P<chr>'(?:[^'\\\r\n]|\\(?:[uU][\da-fA-F]{4,8}|x[\da-fA-F]{1,4}|[^\r\n]))')"
    r"|(?P<op>=>|==|!=|\?\?=|<<=|\+\+|--|&&|\|\||\?\?|\?\.|\.\.|::|->|<<|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.])"
)
_CS_STRING = re.compile(r'"(?:[^"\\\r\n]|\\[^\r\n])*"(?:u8)?')
_CS_VERBATIM = re.compile(r'@"(?:[^"]|"")*"')
_CS_START = re.compile(r'(\$*)("{3,})|(\$@|@\$|\$|@)?"')


def _csharp_interpolated(text: str, at: int, verbatim: bool) -> int:
    """The end of an interpolated string whose text starts at at; -1: it does not end."""
    n = len(text)
    while at < n:
        c = text[at]
        if c == '"':
            if verbatim and text.startswith('""', at):
                at += 2
                continue
            return at + 1
        if c == "\\" and not verbatim:
            at += 2
        elif c in "\r\n" and not verbatim:
            return -1
        elif c == "{":
            if text.startswith("{{", at):
                at += 2
                continue
            depth, at = 1, at + 1
            while at < n and depth:
                c = text[at]
                if c in '"$@' and (m := _CS_START.match(text, at)):
                    at = csharp_string(text, m)
                    if at < 0:
                        return -1
                    continue
                if c == "'" and (m := re.compile(r"'(?:[^'\\\r\n]|\\.)+'").match(text, at)):
                    at = m.end()
                    continue
                depth += (c in "{([") - (c in "})]")
                if c in "\r\n" and not verbatim:
                    return -1
                at += 1
            if depth:
                return -1
        else:
            at += 1
    return -1


def csharp_string(text: str, m: re.Match) -> int:
    """The end of the C# string that starts at a match of _CS_START; -1: it does not end."""
    if m.group(2):
        close = text.find(m.group(2), m.end())
        if close < 0:
            return -1
        end = close + len(m.group(2))
        while text.startswith('"', end):
            end += 1
        return end
    mode = m.group(3) or ""
    if "$" in mode:
        return _csharp_interpolated(text, m.end(), "@" in mode)
    s = (_CS_VERBATIM if mode else _CS_STRING).match(text, m.start())
    return s.end() if s else -1


def csharp(text: str) -> Tokens:
    """Tokens of C#. Preprocessor lines count as comments."""
    out, at, n, newline, fresh = Tokens(), 0, len(text), False, True
    add = out.add
    rest = re.compile(r"[^\r\n]*")
    while at < n:
        c = text[at]
        if c == "#" and fresh:
            end = rest.match(text, at).end()
            if not re.match(r"#\s*(?:region|endregion|if|elif|else|endif|define|undef|pragma|nullable|line|error|warning|r|load)\b", text[at:end]):
                add("error", at, end, newline)
            out.comments.append((at, end))
            at = end
            continue
        if c in '"$@' and (m := _CS_START.match(text, at)):
            end = csharp_string(text, m)
            if end < 0:
                add("error", at, n, newline)
                return out
            add("str", at, end, newline)
            at, newline, fresh = end, False, False
            continue
        m = _CSHARP.match(text, at)
        if not m:
            add("error", at, at + 1, newline)
            at, newline, fresh = at + 1, False, False
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "nl":
            newline = fresh = True
        elif kind in ("line", "block"):
            out.comments.append((at, end))
            newline = newline or (kind == "block" and "\n" in m.group())
        elif kind != "ws":
            fresh = False
            word = m.group()
            if kind == "op" and text.startswith("/*", at):
                add("error", at, n, newline)
                return out
            if kind == "id":
                kind = word if word in CSHARP_KEYWORDS or word in CSHARP_NAMES else "id"
            elif kind == "op":
                kind = word
            elif kind == "num" and end < n and (text[end].isalnum() or text[end] == "_"):
                kind = "error"
            add(kind, at, end, newline)
            newline = False
        at = end
    return out


_ELIXIR = re.compile(
    r"(?P<ws>[ \t\f\xa0﻿]+|\\\r?\n)|(?P<nl>\r\n?|\n)|(?P<line>#[^\r\n]*)"
    r"|(?P<kw>(?:[^\W\d]\w*[?!]?|\"(?:[^\"\\]|\\[\s\S])*\"):(?=[ \t\r\n]))"
    r"|(?P<alias>[A-Z]\w*)|(?P<id>[^\W\d]\w*[?!]?)"
    r"|(?P<num>0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?\d+)?)?)"
    r"|(?P<chr>\?(?:\\[^\r\n]|[^\s\\]))"
    r"|(?P<atom>:(?:[^\W\d][\w@]*[?!]?|(?:<<>>|%\{\}|\{\}|\.\.\.|===|!==|=~|==|!=|<=|>=|&&|\|\||<>|\+\+|--|\|>|->|[+\-*/<>=!&|.^])))"
    r"|(?P<op>\.\.\.|===|!==|=~|\|>|<-|->|=>|==|!=|<=|>=|&&&|&&|\|\|\||\|\||<<<|>>>|<<~|~>>|<~>|<~|~>|<>|\+\+\+|---|\+\+|--|\*\*|\.\.|::|<<|>>|\\\\|\^\^\^|~~~|//|[{}()\[\];,<>+\-*/|!=.@&^%])"
)
_SIGIL = re.compile(r'~([a-z]|[A-Z][A-Z0-9]*)("""|\'\'\'|[(\[{<"\'/|])')
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _elixir_quoted(text: str, at: int, close: str, interpolates: bool) -> int:
    """The end of a quoted text whose body starts at at; -1: it does not end."""
    n, heredoc = len(text), len(close) == 3
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif text.startswith(close, at):
            if not heredoc or not text[text.rfind("\n", 0, at) + 1 : at].strip():
                return at + len(close)
            at += 1
        elif c == "#" and interpolates and text.startswith("#{", at):
            depth, at = 1, at + 2
            while at < n and depth:
                c = text[at]
                if c in "\"'":
                    at = _elixir_quoted(text, at + 1, c, True)
                    if at < 0:
                        return -1
                    continue
                depth += (c == "{") - (c == "}")
                at += 1
            if depth:
                return -1
        else:
            at += 1
    return -1


def elixir(text: str) -> Tokens:
    """Tokens of Elixir; line ends are tokens (``nl``), ``(`` and ``[`` that touch a name have their own kinds."""
    out, at, n, newline = Tokens(), 0, len(text), False
    add = out.add
    touching = False  # whether the last token ends here and may be called or indexed
    while at < n:
        c = text[at]
        if c == "~" and (m := _SIGIL.match(text, at)):
            opener = m.group(2)
            end = _elixir_quoted(text, m.end(), _CLOSE.get(opener, opener), m.group(1).islower())
            if end < 0:
                add("error", at, n, newline)
                return out
            while end < n and text[end].isalpha():
                end += 1
            add("str", at, end, newline)
            at, newline, touching = end, False, True
            continue
        if c in "\"'" or (c == ":" and text[at + 1 : at + 2] in ('"', "'")):
            body = at + (c == ":")
            close = text[body] * 3 if text.startswith(text[body] * 3, body) else text[body]
            end = _elixir_quoted(text, body + len(close), close, True)
            if end < 0:
                add("error", at, n, newline)
                return out
            kind = "str"
            if text.startswith(":", end) and text[end + 1 : end + 2] in (" ", "\n", "\t", "\r") and c != ":" and len(close) == 1:
                kind, end = "kw", end + 1
            add(kind, at, end, newline)
            at, newline, touching = end, False, kind == "str"
            continue
        m = _ELIXIR.match(text, at)
        if not m:
            add("error", at, at + 1, newline)
            at, newline, touching = at + 1, False, False
            continue
        kind, end, word = m.lastgroup, m.end(), m.group()
        if kind == "nl":
            newline = True
            if out.kind and out.kind[-1] != "nl":
                add("nl", at, end, True)
        elif kind == "line":
            out.comments.append((at, end))
        elif kind != "ws":
            if kind == "id" and word in ELIXIR_KEYWORDS:
                kind = word
            elif kind == "op":
                kind = {"(": "call(", "[": "at["}.get(word, word) if touching else word
            elif kind == "num" and end < n and (text[end].isalpha() or text[end] == "_"):
                kind = "error"
            add(kind, at, end, newline)
            newline = False
        touching = kind in ("id", "alias", ")", "]", "}", "str", "end", "atom") or (kind == "." and text.startswith("(", end))
        at = end
    return out


LEX = {"typescript": ecma, "javascript": ecma, "csharp": csharp, "elixir": elixir}
