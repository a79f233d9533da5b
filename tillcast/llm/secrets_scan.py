"""Secret scan: all rules in one pass over the bytes of a text.

The rules are compiled into one minimal automaton (subset construction, Moore minimisation). A scan takes
one table lookup a byte; where an accepting state of a rule is left, the match ends there, and the rule's
automaton run backward from that end gives its leftmost start. Every rule ends in a run of one character
class, so the longest match to the left is the leftmost one. Matches of a rule never overlap: one that
begins inside the last is cut to begin behind it, or dropped if nothing is left.

Null and empty texts have no span. Repeated rows give repeated results. Long texts are scanned whole in
constant extra memory. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.automaton import Dfa, compile_rules


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # ends in a run of one character class, matched as far as it goes
    ignore_case: bool = False
    least: int = 1  # characters of the final run's counted part
    lead: str = ""  # what precedes the counted part, where that is not the whole match

    @property
    def whole(self) -> str:
        return self.lead + self.pattern


# The three base rules.
ASSIGN = Rule("assign", r"[A-Za-z0-9+/_.=-]+", True, 8,
              r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""")
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", least=16)
HEX = Rule("hex", r"[0-9a-f]{32,}", least=32)
BASE = (ASSIGN, ACCESS, HEX)

# Further rules; they add spans and never change base ones. Rules whose runs share characters multiply the
# states of the automaton: these five have about 1,350.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9._~+/=-]+", least=24),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.forward = compile_rules([(r.whole, r.ignore_case) for r in rules], anywhere=True)
        self.backward = [compile_rules([(r.whole, r.ignore_case)], anywhere=False, backward=True) for r in rules]
        self.counted = [compile_rules([(r.pattern, r.ignore_case)], anywhere=False, backward=True)
                        if r.lead else None for r in rules]

    def ends(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(rule, end) of every match, in order of ends: where its accepting states are left."""
        table, accepts, bound = self.forward.table, self.forward.accepts, self.forward.first_accept
        state, open_rules = 0, 0
        for i, b in enumerate(data):
            state = table[state + b]
            if state >= bound or open_rules:
                now = accepts[state >> 8]
                for r in _bits(open_rules & ~now):
                    yield r, i
                open_rules = now
        for r in _bits(open_rules):
            yield r, len(data)

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(rule, start, end) in code points, leftmost and without overlap for each rule."""
        data = (text or "").encode("utf-8", "surrogatepass")
        found, last = [], [0] * len(self.rules)
        for r, end in self.ends(data):
            start = _longest(self.backward[r], data, last[r], end)
            if start is None:
                continue
            last[r] = end
            rule = self.rules[r]
            if end - (start if self.counted[r] is None else _value_start(rule, data, start, end)) >= rule.least:
                found.append((r, start, end))
        if len(data) != len(text or ""):
            found = _code_points(found, data)
        return found


def _value_start(rule: Rule, data: bytes, start: int, end: int) -> int:
    """Where the counted part begins: behind the lead, matched as far as it goes."""
    lead = _lead(rule)
    state, at = 0, start
    best = start
    while at < end:
        state = lead.table[state + data[at]]
        if state == lead.dead:
            break
        at += 1
        if state >= lead.first_accept:
            best = at
    return best


@lru_cache
def _lead(rule: Rule) -> Dfa:
    return compile_rules([(rule.lead, rule.ignore_case)], anywhere=False)


def _longest(dfa: Dfa, data: bytes, first: int, end: int) -> int | None:
    """The leftmost start from ``first`` on of a match that ends at ``end``."""
    state, best = 0, None
    for i in range(end - 1, first - 1, -1):
        state = dfa.table[state + data[i]]
        if state == dfa.dead:
            break
        if state >= dfa.first_accept:
            best = i
    return best


def _bits(n: int) -> Iterator[int]:
    while n:
        low = n & -n
        yield low.bit_length() - 1
        n ^= low


def _code_points(found: list[tuple[int, int, int]], data: bytes) -> list[tuple[int, int, int]]:
    at, count, place = 0, 0, {}
    for offset in sorted({x for _, s, e in found for x in (s, e)}):
        count += len(data[at:offset].decode("utf-8", "surrogatepass"))
        place[offset], at = count, offset
    return [(r, place[s], place[e]) for r, s, e in found]


@lru_cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with an array column ``out`` of (kind, start, end), by start and then order of the rules.

    A column called ``out`` in any case is replaced, all others are kept as they are. Empty tables give empty results.
    """
    @F.udf(SPANS, useArrow=True)
    def spans(value):
        scan = scanner(rules)
        return [(rules[r].kind, s, e) for s, r, e in sorted((s, r, e) for r, s, e in scan.spans(value))]

    found = spans(F.col(f"`{text}`")).alias(out)
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()], found)
