"""Memoised parsing with derivatives.

A grammar's language is kept as an expression (token, sequence, choice, repetition, name of a
rule). Its derivative by a token is the language of what may still follow; a file is valid if
the derivative by all its tokens accepts the empty rest. If a derivative is empty, its token is
where the text fails; if the last one is not nullable, the text ends too early.

Equal expressions are one object (hash-consing), and each keeps its derivatives. As nested code
comes back to the same expressions again and again, most steps are one look-up in a table.
"""

from __future__ import annotations

import re

#: Expressions kept before the tables are built anew.
NODES = 400_000


class Node:
    """An expression: kind, parts, whether it accepts the empty text, its derivatives so far."""

    __slots__ = ("kind", "a", "b", "nullable", "d", "number")

    def __init__(self, kind: str, a: object, b: object, nullable: bool, number: int) -> None:
        self.kind, self.a, self.b, self.nullable, self.d, self.number = kind, a, b, nullable, {}, number


class Grammar:
    """Rules in EBNF: ``name = ...``, with ``|``, ``( )``, ``[ ]`` (optional), ``{ }`` (repetition), quoted tokens.

    A word that is no rule is a token kind. Rules must not be left-recursive.
    """

    def __init__(self, text: str, start: str) -> None:
        self.source = {m.group(1): m.group(2) for m in re.finditer(r"^(\w+)\s*=(.*(?:\n[ \t]+.*)*)", text, re.M)}
        self.start = start
        self.reset()

    def reset(self) -> None:
        self.table: dict[tuple, Node] = {}
        self.empty = self._node("empty", None, None, False)
        self.eps = self._node("eps", None, None, True)
        self.bodies: dict[str, Node] = {}
        self.null: dict[str, bool] = {}
        self._nullable_rules()
        self.root = self.ref(self.start)

    def _node(self, kind: str, a: object, b: object, nullable: bool) -> Node:
        key = (kind, a.number if isinstance(a, Node) else a, b.number if isinstance(b, Node) else b)
        got = self.table.get(key)
        if got is None:
            got = self.table[key] = Node(kind, a, b, nullable, len(self.table))
        return got

    # Construction of expressions, in a normal form.

    def tok(self, t: str) -> Node:
        return self._node("tok", t, None, False)

    def ref(self, name: str) -> Node:
        return self._node("ref", name, None, self.null.get(name, False))

    def seq(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.kind == "seq":
            return self.seq(a.a, self.seq(a.b, b))
        return self._node("seq", a, b, a.nullable and b.nullable)

    def alt(self, parts: list[Node]) -> Node:
        flat: dict[int, Node] = {}
        for p in parts:
            for q in p.a if p.kind == "alt" else (p,):
                if q is not self.empty:
                    flat[q.number] = q
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        order = tuple(sorted(flat))
        key = ("alt", order, None)
        got = self.table.get(key)
        if got is None:
            members = tuple(flat[i] for i in order)
            got = self.table[key] = Node("alt", members, None, any(m.nullable for m in members), len(self.table))
        return got

    def star(self, a: Node) -> Node:
        return self.eps if a in (self.empty, self.eps) else self._node("star", a, None, True)

    # Reading of the rules.

    def _parse(self, text: str) -> Node:
        items = re.findall(r"'[^']+'|\w+|[|()\[\]{}]", text)
        at = 0

        def choice() -> Node:
            nonlocal at
            parts = [sequence()]
            while at < len(items) and items[at] == "|":
                at += 1
                parts.append(sequence())
            return self.alt(parts)

        def sequence() -> Node:
            nonlocal at
            parts = []
            while at < len(items) and items[at] not in ("|", ")", "]", "}"):
                x = items[at]
                at += 1
                if x in "([{" and len(x) == 1:
                    inner = choice()
                    at += 1
                    parts.append(inner if x == "(" else self.alt([inner, self.eps]) if x == "[" else self.star(inner))
                elif x[0] == "'":
                    parts.append(self.tok(x[1:-1]))
                else:
                    parts.append(self.ref(x) if x in self.source else self.tok(x))
            out = self.eps
            for p in reversed(parts):
                out = self.seq(p, out)
            return out

        return choice()

    def _nullable_rules(self) -> None:
        """Which rules accept the empty text: repeated until nothing changes."""
        while True:
            known = dict(self.null)
            self.table.clear()
            self.empty = self._node("empty", None, None, False)
            self.eps = self._node("eps", None, None, True)
            self.bodies = {name: self._parse(body) for name, body in self.source.items()}
            self.null = {name: body.nullable for name, body in self.bodies.items()}
            if self.null == known:
                return

    # Derivatives.

    def derive(self, node: Node, t: str) -> Node:
        """The language of what may follow after token t."""
        got = node.d.get(t)
        if got is not None:
            return got
        kind = node.kind
        if kind == "tok":
            out = self.eps if node.a == t else self.empty
        elif kind == "seq":
            out = self.seq(self.derive(node.a, t), node.b)
            if node.a.nullable:
                out = self.alt([out, self.derive(node.b, t)])
        elif kind == "alt":
            out = self.alt([self.derive(m, t) for m in node.a])
        elif kind == "star":
            out = self.seq(self.derive(node.a, t), node)
        elif kind == "ref":
            out = self.derive(self.bodies[node.a], t)
        else:
            out = self.empty
        node.d[t] = out
        return out

    def check(self, kinds: list[str], newline: list[bool], semicolons: bool = False) -> int | None:
        """The number of the token at which the text fails; len(kinds): it ends too early; None: it is valid.

        semicolons: a token that cannot stand where it stands may be preceded by an omitted
        semicolon if a line ends before it, or if it is a closing brace or the end.
        """
        if len(self.table) > NODES:
            self.reset()
        state, empty, derive = self.root, self.empty, self.derive
        for i, t in enumerate(kinds):
            nxt = state.d.get(t)
            if nxt is None:
                nxt = derive(state, t)
            if nxt is empty:
                if semicolons and (newline[i] or t == "}"):
                    nxt = derive(derive(state, ";"), t)
                if nxt is empty:
                    return i
            state = nxt
        if state.nullable or (semicolons and derive(state, ";").nullable):
            return None
        return len(kinds)
