"""Source files that are not valid in the language of their path's extension."""

from __future__ import annotations

from .grammars import grammar
from ..functions.lexers import LEX, Tokens

#: Elixir: an operator at the start of a line continues the line before, these included.
_CONTINUES = frozenset("|> <> ++ -- and or && || |||  &&& when = == != =~ === !== <= >= | :: <- ~> ~>> <~ <<~ <~> <<< >>> ** ^^^ // .. in => \\\\ + * /".split())
_OPEN = frozenset(("(", "call(", "[", "at[", "{", "<<"))


def _elixir_lines(t: Tokens) -> tuple[list[str], list[bool]]:
    """The kinds without line ends that separate nothing: before continuing operators and before what closes."""
    kinds, newline = [], []
    n = len(t.kind)
    for i, k in enumerate(t.kind):
        if k == "nl":
            nxt = t.kind[i + 1] if i + 1 < n else ""
            if nxt in _CONTINUES or nxt in (")", "]", "}", ">>", "."):
                continue
        kinds.append(k)
        newline.append(t.newline[i])
    return kinds, newline


def _ecma_lines(t: Tokens) -> list[str]:
    """The kinds; an increment at the start of a line belongs to what follows (no line may end before a postfix one)."""
    if "++" not in t.kind and "--" not in t.kind:
        return t.kind
    return [f"line{k}" if k in ("++", "--") and new else k for k, new in zip(t.kind, t.newline)]


def _outside(kinds: list[str]) -> int | None:
    """The first ``return`` that stands in no brackets at all, so in no function."""
    depth = 0
    for i, k in enumerate(kinds):
        if k in ("{", "(", "[", "tplhead"):
            depth += 1
        elif k in ("}", ")", "]", "tplend"):
            depth -= 1
        elif k == "return" and not depth and (not i or kinds[i - 1] not in (".", "?.")):
            return i
    return None


def check(tokens: Tokens, language: str) -> tuple[str, int] | None:
    """What is wrong and where: (reason, offset of the failing token or -1 at the end); None if the file is valid."""
    ecma = language in ("typescript", "javascript")
    kinds, newline = _elixir_lines(tokens) if language == "elixir" else (_ecma_lines(tokens) if ecma else tokens.kind, tokens.newline)
    at = grammar(language).check(kinds, newline, semicolons=ecma)
    if at is None and ecma and "return" in kinds:
        at = _outside(kinds)
    if at is None:
        return None
    if at >= len(kinds):
        return "truncated", -1
    return ("lexical" if kinds[at] == "error" else "syntax"), at


def parse(content: str | None, language: str | None) -> tuple[Tokens, tuple[str, int] | None] | None:
    """Tokens and verdict of a file; None where there is nothing to judge (null or empty content, unknown language)."""
    if not content or language is None:
        return None
    tokens = LEX[language](content)
    return tokens, check(tokens, language)
