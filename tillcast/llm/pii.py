"""Personal data: exact base rules and a skip-chain conditional random field over the tokens of a document.

Base rules find email and IP addresses, card and phone numbers. Every base span is a node with a known
label; further nodes are number runs and tokens with digits or ``@`` outside base spans, with unknown
labels. Nodes are linked to the next node of the document (chain) and to the next one that is the same or
similar: same last seven digits, same address, same name before ``@`` (skip edges). Loopy sum-product
messages over these edges give each unknown node a label that agrees with its mentions elsewhere in the
document; a node whose likeliest label is a kind, and not "other", becomes an added span. Base spans stay.

Weights are fitted by pseudo-likelihood (each node given its neighbours' labels) on the nodes of all documents.
Nodes that look alike are counted together; a step of the ascent sums gradients over these counts in Spark, and
the driver sees one vector of fixed length per part. Unknown nodes with a similar base span are hidden from the
fit: whether they are personal data is what the field is to tell. A prior draws nodes to "other" and skip edges
to agreement, at any size of the corpus.

Null and empty texts have no spans. Texts are read whole, in time linear in their length; edges are at most
three a node. Repeated rows have one result each; empty tables give empty results, and a field that is the prior.
A column called like the result, in any case, is replaced, all others are kept as they are.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.tables import staged, without

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = len(KINDS) + 1

# The base rules, written so that a scan never reads a run twice: an address is looked for from its "@",
# and a number only where its run of digits begins.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

RUN = re.compile(r"(?<![0-9(])\(?[0-9][0-9().\x20-]*+")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
EDGE = "\"'`,;:!?()[]{}<>.=*#%&/\\|~^"
CONTEXTS = 128
ROUNDS = 12
AGREEMENT = 4.0  # prior weight of equal kinds on a skip edge
RESERVE = 0.5  # prior weight of "other" for each feature
EXAMPLES_PER_PART = 100_000


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        # What lies between two signs is read once for each of them at most.
        at = text.find("@", max(at + 1, last))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, by start and kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() < 40 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Graph:
    """Nodes of a document in order: span, known label or -1, features; chain edges are (i, i + 1)."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    known: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    skips: list[tuple[int, int]] = field(default_factory=list)


def graph_of(text: str, base: list[tuple[int, int, int]]) -> Graph:
    taken = sorted((s, e) for s, _, e in base)
    nodes = [(s, e, k) for s, k, e in base]
    rivals = []
    for m in RUN.finditer(text):
        s, e = m.start(), m.start() + len(m[0].rstrip("(). -"))
        if e - s >= 7 and len(_digits(text[s:e])) >= 7:
            rivals.append((s, e))
    for m in TOKEN.finditer(text):
        piece = m[0]
        s = m.start() + len(piece) - len(piece.lstrip(EDGE))
        e = m.end() - (len(piece) - len(piece.rstrip(EDGE)))
        if e - s >= 3:
            rivals.append((s, e))
    # Neither base spans nor an earlier candidate may overlap.
    free, i, last = [], 0, 0
    for s, e in sorted(rivals, key=lambda x: (x[0], -x[1])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= last and (i == len(taken) or taken[i][0] >= e):
            free.append((s, e, -1))
            last = e
    out, latest = Graph(), {}
    for s, e, k in sorted(nodes + free):
        piece = text[s:e]
        n = len(out.spans)
        for key in _keys(piece):
            if key in latest:
                out.skips.append((latest[key], n))
            latest[key] = n
        out.spans.append((s, e))
        out.known.append(k)
        out.features.append(_features(piece, text[max(0, s - 40):s]))
    return out


def _keys(piece: str) -> list[str]:
    """What similar mentions share."""
    keys, digits, low = [], _digits(piece), piece.lower()
    if len(digits) >= 7:
        keys.append("d" + digits[-7:])
    if "@" in low:
        keys.append("n" + low.split("@")[0])
    elif any(c.isalpha() for c in low):
        keys.append("n" + low)
    if low.count(".") == 3:
        keys.append("i" + low.split(":")[0])
    return keys


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= x for x in edges)


def _features(piece: str, before: str) -> list[int]:
    """Indices of the features that hold: shape of the piece, and the word before it."""
    digits = len(_digits(piece))
    letters = sum(c.isalpha() for c in piece)
    shape = [_bucket(digits, (1, 4, 7, 10, 14, 20)), 8 + _bucket(len(piece), (4, 8, 12, 16, 24, 40)),
             16 + _bucket(letters, (1, 4, 8)), 20 + ("@" in piece), 22 + ("." in piece), 24 + ("-" in piece),
             26 + (" " in piece), 28 + ("(" in piece), 30 + _bucket(piece.count("."), (1, 2, 3, 4))]
    words = before.split()
    word = words[-1].lower().strip(EDGE) if words else ""
    return [*shape, 40 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % CONTEXTS]


N_FEATURES = 40 + CONTEXTS


@dataclass
class Field:
    """Weights: ``node`` (features x labels), ``chain`` and ``skip`` (labels x labels, symmetric)."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def label(self, graph: Graph) -> list[int]:
        """The likeliest label of every node by loopy sum-product messages; known labels are held."""
        n = len(graph.spans)
        if all(k >= 0 for k in graph.known):
            return list(graph.known)
        own = np.array([self.node[f].sum(axis=0) for f in graph.features])
        for i, k in enumerate(graph.known):
            if k >= 0:
                own[i] = -50.0
                own[i, k] = 0.0
        chain = np.array([(i, i + 1) for i in range(n - 1)], np.int64).reshape(-1, 2)
        skip = np.array(graph.skips, np.int64).reshape(-1, 2)
        source = np.concatenate((chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]))
        target = np.concatenate((chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]))
        c, s = len(chain), len(skip)
        back = np.concatenate((np.arange(c, 2 * c), np.arange(c), np.arange(2 * c + s, 2 * c + 2 * s), np.arange(2 * c, 2 * c + s)))
        power = np.exp(np.concatenate((np.broadcast_to(self.chain, (2 * c, LABELS, LABELS)), np.broadcast_to(self.skip, (2 * s, LABELS, LABELS)))))
        sent = np.zeros((len(source), LABELS))
        order = np.argsort(target, kind="stable")
        starts = np.searchsorted(target[order], np.arange(n))
        degree = np.bincount(target, minlength=n)
        for _ in range(ROUNDS):
            belief = own + _sum_to(sent, order, starts, degree)
            leave = belief[source] - sent[back]
            top = leave.max(axis=1, keepdims=True)
            fresh = np.log(np.einsum("ej,ejk->ek", np.exp(leave - top), power) + 1e-300)
            fresh -= fresh.max(axis=1, keepdims=True)
            moved = np.abs(fresh - sent).max() if len(sent) else 0.0
            sent = 0.5 * sent + 0.5 * fresh
            if moved < 1e-3:
                break
        belief = own + _sum_to(sent, order, starts, degree)
        return [k if k >= 0 else int(b) for k, b in zip(graph.known, belief.argmax(axis=1))]


def _sum_to(sent: np.ndarray, order: np.ndarray, starts: np.ndarray, degree: np.ndarray) -> np.ndarray:
    out = np.zeros((len(degree), LABELS))
    some = np.flatnonzero(degree)
    if len(some):
        out[some] = np.add.reduceat(sent[order], starts[some], axis=0)
    return out


def prior() -> Field:
    """The field that nothing was learned from: "other", unless a similar node is known."""
    node, skip = np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS))
    node[:, OTHER] = RESERVE
    skip[range(OTHER), range(OTHER)] = AGREEMENT
    return Field(node, np.zeros((LABELS, LABELS)), skip)


EXAMPLES = "label int, features array<int>, chain array<int>, skip array<int>"


def fit(docs: DataFrame, *, text: str = "text", steps: int = 60, rate: float = 0.2, ridge: float = 1e-3) -> Field:
    """Fit the weights by gradient ascent on the mean log-likelihood of each node's label given its neighbours' labels.

    The labels count alike in the mean, so that frequent "other" nodes don't drown the kinds.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for value in frame["text"] if value for r in _examples(value)]
            yield pd.DataFrame(rows, columns=["label", "features", "chain", "skip"])

    seen = docs.select(F.col(f"`{text}`").alias("text")).mapInPandas(run, EXAMPLES)
    table = staged(seen.groupBy("label", "features", "chain", "skip").agg(F.count("*").alias("n")), "pii-examples")
    sizes = table.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    share = np.zeros(LABELS)
    for r in sizes:
        share[r.label] = 1.0 / (r.n * len(sizes))
    parts = table.coalesce(1 + sum(r.rows for r in sizes) // EXAMPLES_PER_PART)
    base = prior()
    centre = [base.node, base.chain, base.skip]
    weights, speed = [w.copy() for w in centre], [np.zeros_like(w) for w in centre]
    for _ in range(steps if sizes else 0):
        for i, sums in enumerate(_gradient(parts, weights, share)):
            step = sums - ridge * (weights[i] - centre[i])
            if i:  # an edge has no direction
                step = (step + step.T) / 2
            speed[i] = 0.9 * speed[i] + step
            weights[i] = weights[i] + rate * speed[i]
    return Field(*weights)


def _gradient(parts: DataFrame, weights: list[np.ndarray], share: np.ndarray) -> list[np.ndarray]:
    """Sums over all examples, one row of fixed length from each part."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros_like(w) for w in weights]
        for frame in frames:
            if len(frame):
                for t, g in zip(total, gradient_of(frame, weights, share)):
                    t += g
        yield pd.DataFrame({"g": [np.concatenate([t.ravel() for t in total])]})

    flat = np.sum([r.g for r in parts.mapInPandas(run, "g array<double>").collect()], axis=0)
    ends = np.cumsum([w.size for w in weights])
    return [part.reshape(w.shape) for part, w in zip(np.split(flat, ends[:-1]), weights)]


def gradient_of(frame: pd.DataFrame, weights: list[np.ndarray], share: np.ndarray) -> list[np.ndarray]:
    features = np.stack(frame["features"].to_numpy())
    chain, skip = np.stack(frame["chain"].to_numpy()), np.stack(frame["skip"].to_numpy())
    label = frame["label"].to_numpy()
    value = weights[0][features].sum(axis=1) + chain @ weights[1] + skip @ weights[2]
    p = np.exp(value - value.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    miss = (np.eye(LABELS)[label] - p) * (frame["n"].to_numpy() * share[label])[:, None]
    each = np.repeat(miss, features.shape[1], axis=0)
    node = np.stack([np.bincount(features.ravel(), each[:, k], N_FEATURES) for k in range(LABELS)], axis=1)
    return [node, chain.T @ miss, skip.T @ miss]


def _examples(text: str) -> list[tuple]:
    """(label, features, counts of labels along the chain, the same over skip edges) of the nodes that the fit may see."""
    graph = graph_of(text, base_spans(text))
    near: list[list[int]] = [[] for _ in graph.spans]
    for i, j in graph.skips:
        near[i].append(j)
        near[j].append(i)
    label = [OTHER if k < 0 else k for k in graph.known]
    hidden = [k < 0 and any(graph.known[j] >= 0 for j in near[i]) for i, k in enumerate(graph.known)]

    def counts(neighbours: list[int]) -> list[int]:
        out = [0] * LABELS
        for j in neighbours:
            if not hidden[j]:
                out[label[j]] += 1
        return out

    return [(k, graph.features[i], counts([j for j in (i - 1, i + 1) if 0 <= j < len(label)]), counts(near[i]))
            for i, k in enumerate(label) if not hidden[i]]


def spans_of(text: str | None, weights: Field) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all spans, by start and kind."""
    text = text or ""
    base = base_spans(text)
    graph = graph_of(text, base)
    added = []
    if any(k < 0 for k in graph.known):
        for (s, e), k, known in zip(graph.spans, weights.label(graph), graph.known):
            if known < 0 and k != OTHER:
                added.append((s, k, e, False))
    return sorted([(*b, True) for b in base] + added)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_personal_data(docs: DataFrame, weights: Field, *, text: str = "text", out: str = "personal") -> DataFrame:
    """``docs`` with an array column ``out`` of (kind, start, end, base)."""
    docs = without(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.udf(SPANS, useArrow=True)
    def spans(value):
        return [(KINDS[k], s, e, base) for s, k, e, base in spans_of(value, shared.value)]

    return docs.withColumn(out, spans(F.col(f"`{text}`")))
