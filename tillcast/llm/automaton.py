"""Byte automata: several regular expressions compiled into one minimal deterministic transition array."""

from __future__ import annotations

import re
from re import _constants as ops, _parser as regex_parser

SIZE = 256


class Nfa:
    """Thompson construction over bytes. ``step[s]`` has (byte set, target) pairs, ``empty[s]`` free moves."""

    def __init__(self):
        self.step: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.empty.append([])
        return len(self.step) - 1

    def add(self, parsed, start: int, ignore_case: bool, backward: bool) -> int:
        """Append a parsed pattern behind ``start``; the state behind it."""
        for op, value in (reversed(list(parsed)) if backward else parsed):
            start = self._one(op, value, start, ignore_case, backward)
        return start

    def _one(self, op, value, start: int, ignore_case: bool, backward: bool) -> int:
        if op is ops.SUBPATTERN:
            return self.add(value[3], start, ignore_case, backward)
        end = self.state()
        if op is ops.BRANCH:
            for choice in value[1]:
                self.empty[self.add(choice, start, ignore_case, backward)].append(end)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            least, most, body = value
            for _ in range(least):
                start = self.add(body, start, ignore_case, backward)
            if most is ops.MAXREPEAT:
                loop = self.state()
                self.empty[start].append(loop)
                self.empty[self.add(body, loop, ignore_case, backward)].append(loop)
                self.empty[loop].append(end)
            else:
                self.empty[start].append(end)
                for _ in range(most - least):
                    start = self.add(body, start, ignore_case, backward)
                    self.empty[start].append(end)
        else:
            self.step[start].append((_bytes_of(op, value, ignore_case), end))
        return end


def _bytes_of(op, value, ignore_case: bool) -> frozenset:
    if op is ops.LITERAL:
        found, negated = {value}, False
    elif op is ops.NOT_LITERAL:
        found, negated = {value}, True
    elif op is ops.IN:
        negated = value[0][0] is ops.NEGATE
        found = set()
        for kind, x in value[negated:]:
            if kind is ops.LITERAL:
                found.add(x)
            elif kind is ops.RANGE:
                found.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"{kind} is not supported in a set")
    else:
        raise ValueError(f"{op} is not supported")
    if ignore_case:
        found |= {ord(f(chr(b))) for b in found if b < 128 for f in (str.lower, str.upper)}
    if max(found, default=0) >= 128:
        raise ValueError("rules are written in ASCII")
    return frozenset(set(range(SIZE)) - found if negated else found)


class Dfa:
    """``table[state * 256 + byte]`` is the next state times 256; ``accepts[state]`` a bit set of rules.

    Accepting states have the highest numbers, from ``first_accept`` on, so that a scan tests one bound.
    State 0 is the start.
    """

    def __init__(self, table: list[int], accepts: list[int], first_accept: int, dead: int | None):
        self.table, self.accepts, self.first_accept, self.dead = table, accepts, first_accept, dead

    @property
    def n_states(self) -> int:
        return len(self.accepts)


def compile_rules(patterns: list[tuple[str, bool]], *, anywhere: bool, backward: bool = False) -> Dfa:
    """One automaton for all ``(pattern, ignore_case)`` rules; ``anywhere``: a match may begin at any byte."""
    nfa = Nfa()
    root = nfa.state()
    if anywhere:
        nfa.step[root].append((frozenset(range(SIZE)), root))
    final: dict[int, int] = {}
    for i, (pattern, ignore_case) in enumerate(patterns):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        final[nfa.add(regex_parser.parse(pattern), begin, ignore_case, backward)] = 1 << i
    return _minimal(*_subsets(nfa, root, final))


def _subsets(nfa: Nfa, root: int, final: dict[int, int]) -> tuple[list[list[int]], list[int]]:
    """Subset construction: rows of 256 targets, and the rules that each state accepts."""
    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    start = closure([root])
    number, rows, accepts, todo = {start: 0}, [], [], [start]
    for states in todo:
        moves: list[set] = [set() for _ in range(SIZE)]
        for s in states:
            for allowed, target in nfa.step[s]:
                for b in allowed:
                    moves[b].add(target)
        row, known = [], {}
        for move in moves:
            key = frozenset(move)
            if key not in known:
                closed = closure(key)
                if closed not in number:
                    number[closed] = len(number)
                    todo.append(closed)
                known[key] = number[closed]
            row.append(known[key])
        rows.append(row)
        hit = 0
        for s in states:
            hit |= final.get(s, 0)
        accepts.append(hit)
    return rows, accepts


def _minimal(rows: list[list[int]], accepts: list[int]) -> Dfa:
    """Merge equal states by refining the partition until it is stable, and lay the result out."""
    kinds = {a: i for i, a in enumerate(sorted(set(accepts)))}
    group = [kinds[a] for a in accepts]
    while True:
        names: dict[tuple, int] = {}
        refined = [names.setdefault((group[s], *(group[t] for t in row)), len(names)) for s, row in enumerate(rows)]
        if len(names) == len(set(group)):
            break
        group = refined
    lead = {}
    for s, g in enumerate(group):
        lead.setdefault(g, s)
    order = sorted(lead, key=lambda g: (accepts[lead[g]] != 0, g != group[0], g))
    place = {g: i for i, g in enumerate(order)}
    table = [place[group[t]] * SIZE for g in order for t in rows[lead[g]]]
    marks = [accepts[lead[g]] for g in order]
    plain = [i for i, m in enumerate(marks) if not m]
    if marks[0]:
        raise ValueError("a rule matches the empty text")
    dead = next((i for i in plain if all(t == i * SIZE for t in table[i * SIZE:(i + 1) * SIZE])), None)
    return Dfa(table, marks, len(plain) * SIZE, None if dead is None else dead * SIZE)
