"""A generalised LL recogniser over a graph-structured stack.

Grammars are written in EBNF. Every nonterminal becomes a position automaton;
the parser keeps descriptors (position, stack node, input place). A stack node
stands for one nonterminal at one place and is shared by all callers, with the
set of places it was left at, so any context-free grammar - ambiguous,
left-recursive or with several dialects side by side - takes polynomial time.

Grammar notation: ``Name = expression`` (a definition goes on over further
lines), ``|``, ``*``, ``+``, ``?`` and parentheses; ``'x'`` and capital words that
are not defined are terminals; ``p:N``, ``b:N`` and ``c:N`` are a whole group in
round, square or curly brackets whose inside derives N.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKENS = re.compile(r"'[^']+'|[pbc]:\w+|\w+|[|*+?()]")


@dataclass
class _Part:
    """Automaton of an expression: can it be empty, first and last positions."""

    empty: bool
    first: tuple[int, ...]
    last: tuple[int, ...]


@dataclass
class Grammar:
    """A compiled grammar."""

    text: str
    bits: dict[str, int] = field(default_factory=dict)  # terminal -> bit number
    symbol: list[object] = field(default_factory=list)  # position -> terminal mask, or nonterminal name
    follow: list[tuple[int, ...]] = field(default_factory=list)
    accepts: list[bool] = field(default_factory=list)
    start: dict[str, int] = field(default_factory=dict)  # nonterminal -> its start position
    first: dict[str, int] = field(default_factory=dict)
    empty: dict[str, bool] = field(default_factory=dict)
    groups: dict[str, list[str]] = field(default_factory=dict)  # bracket letter -> nonterminals used inside

    def __post_init__(self) -> None:
        rules: dict[str, str] = {}
        name = ""
        for line in self.text.splitlines():
            m = re.match(r"(\w+) = (.*)", line.strip())
            if m:
                name = m.group(1)
                rules[name] = m.group(2)
            elif line.strip():
                rules[name] += " " + line.strip()
        self.rules = rules
        seen: dict[str, set[str]] = {"p": set(), "b": set(), "c": set()}
        for name, body in rules.items():
            tokens = _TOKENS.findall(body)
            for t in tokens:
                if t[1:2] == ":" and t[0] in "pbc":
                    seen[t[0]].add(t[2:])
            self._position(None)
            begin = len(self.symbol) - 1
            part, rest = self._choice(tokens, rules)
            if rest:
                raise ValueError(f"{name}: {rest[:3]} is left over")
            self.follow[begin] = part.first
            self.accepts[begin] = part.empty
            for p in part.last:
                self.accepts[p] = True
            self.start[name] = begin
        self.groups = {k: sorted(v) for k, v in seen.items()}
        missing = {n for v in seen.values() for n in v} - set(rules)
        if missing:
            raise ValueError(f"undefined inside brackets: {missing}")
        self._first_sets()

    def _position(self, symbol: object) -> int:
        self.symbol.append(symbol)
        self.follow.append(())
        self.accepts.append(False)
        return len(self.symbol) - 1

    def bit(self, terminal: str) -> int:
        return self.bits.setdefault(terminal, len(self.bits))

    def _choice(self, tokens: list[str], rules: dict[str, str]) -> tuple[_Part, list[str]]:
        part, tokens = self._sequence(tokens, rules)
        while tokens and tokens[0] == "|":
            other, tokens = self._sequence(tokens[1:], rules)
            part = _Part(part.empty or other.empty, part.first + other.first, part.last + other.last)
        return part, tokens

    def _sequence(self, tokens: list[str], rules: dict[str, str]) -> tuple[_Part, list[str]]:
        whole = _Part(True, (), ())
        while tokens and tokens[0] not in "|)":
            t, tokens = tokens[0], tokens[1:]
            if t == "(":
                part, tokens = self._choice(tokens, rules)
                tokens = tokens[1:]
            else:
                p = self._position(t if t in rules else 1 << self.bit(t.strip("'")))
                part = _Part(False, (p,), (p,))
            while tokens and tokens[0] in "*+?":
                if tokens[0] in "*+":
                    for p in part.last:
                        self.follow[p] = tuple(dict.fromkeys(self.follow[p] + part.first))
                part = _Part(part.empty or tokens[0] in "*?", part.first, part.last)
                tokens = tokens[1:]
            for p in whole.last:
                self.follow[p] = tuple(dict.fromkeys(self.follow[p] + part.first))
            whole = _Part(
                whole.empty and part.empty,
                whole.first + part.first if whole.empty else whole.first,
                part.last + whole.last if part.empty else part.last,
            )
        return whole, tokens

    def _first_sets(self) -> None:
        self.empty = dict.fromkeys(self.rules, False)
        self.first = dict.fromkeys(self.rules, 0)
        changed = True
        while changed:
            changed = False
            for name, begin in self.start.items():
                mask, empty = 0, self.accepts[begin]
                todo, done = list(self.follow[begin]), set()
                while todo:
                    p = todo.pop()
                    if p in done:
                        continue
                    done.add(p)
                    s = self.symbol[p]
                    if isinstance(s, int):
                        mask |= s
                        continue
                    mask |= self.first[s]
                    if self.empty[s]:
                        todo += self.follow[p]
                        empty = empty or self.accepts[p]
                if (mask, empty) != (self.first[name], self.empty[name]):
                    self.first[name], self.empty[name] = mask, empty
                    changed = True

    def derives(self, name: str, masks: list[int]) -> bool:
        """Whether ``name`` derives the input, given as a mask of terminals for each token."""
        size = len(masks)
        symbol, follow, accepts, first, empty, start = self.symbol, self.follow, self.accepts, self.first, self.empty, self.start
        masks = [*masks, 0]
        edges: dict[tuple[str, int], list[tuple[int, tuple[str, int]]]] = {}
        left: dict[tuple[str, int], set[int]] = {}
        root = (name, 0)
        edges[root], left[root] = [], set()
        seen = {(start[name], root, 0)}
        todo = [(start[name], root, 0)]
        while todo:
            state, node, i = todo.pop()
            if accepts[state]:
                if node == root and i == size:
                    return True
                if i not in left[node]:
                    left[node].add(i)
                    for back, parent in edges[node]:
                        d = (back, parent, i)
                        if d not in seen:
                            seen.add(d)
                            todo.append(d)
            here = masks[i]
            for p in follow[state]:
                s = symbol[p]
                if s.__class__ is int:
                    if s & here:
                        d = (p, node, i + 1)
                        if d not in seen:
                            seen.add(d)
                            todo.append(d)
                elif first[s] & here or empty[s]:
                    child = (s, i)
                    known = edges.get(child)
                    if known is None:
                        edges[child], left[child] = [(p, node)], set()
                        d = (start[s], child, i)
                        seen.add(d)
                        todo.append(d)
                    elif (p, node) not in known:
                        known.append((p, node))
                        for j in left[child]:
                            d = (p, node, j)
                            if d not in seen:
                                seen.add(d)
                                todo.append(d)
        return False
