"""How far the sources of a language differ in their words: hash-consed segment trees over term ids.

Terms are counted per language and source. The kept terms of a language (in ``min_docs`` of its documents or more)
are dealt by a hash to segments; a segment, for all sources of its language, is one unit of work. Inside it terms get ids in
the order of their counts, so that equal counts lie side by side, and every source has a binary tree over the
ids whose leaves are counts. Nodes are hash-consed: equal subtrees, of whatever source and place, are one node.
The trees of two sources are traversed together, level by level, and each pair of nodes that meets is priced once
per pair of totals, however often it occurs; leaf pairs are priced with exact whole numbers and added on the way
up. Spark adds the prices of the segments of a language. Divergence is the sum over kept terms of
floor((p - q)^2 / q), with p = 1 + floor(10^9 (count + 1) / (N + V)).

``pairs`` prices every two sources of a language, ``terms`` each source against its whole language, term by term.

Null text, language and source are read as ''. Languages and sources without terms have all their rows, with value 0.
Repeated rows count each; ties go to the smaller name in UTF-8 order; empty tables give empty results. Texts are read
whole, long ones in pieces. Other columns are not read. Counts are exact up to 2^63; prices need a vocabulary of less than 10^9 terms a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillcast.llm.tables import staged

MIN_DOCS = 3
SCALE = 1_000_000_000
SEGMENT_CELLS = 1 << 16  # counts of one segment, zeros included, over all sources
HELD_TERMS = 400_000  # distinct terms a task holds before it passes its counts on
PIECE_BYTES = 8 << 20

# Terms are letters A-Z and characters beyond ASCII: all other bytes part them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    folded, first = text.translate(_FOLD), 0
    while first < len(folded):
        last = folded.find(b" ", first + PIECE_BYTES)
        yield folded[first:last if last >= 0 else len(folded)].split()
        first = last if last >= 0 else len(folded)


COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, from ``lang, source, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                size = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array(list(n.values()), pa.int64()),
                     pa.array([docs_[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2)):
                n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in _words(text.as_py()):
                    n.update(words)
                    seen.update(words)
                docs_.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from passed_on()
        yield from passed_on()

    parts = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Audit:
    """Counts of a corpus, prepared for both comparisons."""

    def __init__(self, docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS,
                 top: int | None = None, segment_cells: int = SEGMENT_CELLS):
        """``top``: how many terms of each source are wanted at most (None: all)."""
        rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
        counts = staged(term_counts(rows), "term-counts")
        # The terms of a language: in how many of its documents, how often, and with what segment.
        vocabulary = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= min_docs)
        vocabulary = staged(vocabulary.drop("docs"), "term-vocabulary")
        present = rows.select("lang", "source").distinct()
        cells = counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "all_n")
        self.cells = staged(cells, "term-cells")
        totals = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
        groups = present.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "all_total")])
        n_sources = present.groupBy("lang").agg(F.count("*").alias("n_sources"))
        segments = F.greatest(F.ceil(F.col("v") * (F.col("n_sources") + 1) / segment_cells), F.lit(1)).cast("int")
        self.groups = staged(groups.join(n_sources, "lang").withColumn("segments", segments), "term-groups")
        self.prices = staged(self._priced(top), "term-prices")

    def _priced(self, top: int | None) -> DataFrame:
        """``lang, source, other, term, value``: sums of a segment where ``term`` is null, else prices against the language."""
        many = self.groups.where("v > 0").withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
        members = many.select("lang", "segment", "source", "total", "v", "all_total")
        of = self.groups.select("lang", "source", "segments")
        dealt = self.cells.join(of, ["lang", "source"]).withColumn("segment", F.pmod(F.xxhash64("term"), F.col("segments")).cast("int"))
        dealt = dealt.select("lang", "segment", "source", "term", "n", "all_n")
        return dealt.groupBy("lang", "segment").cogroup(members.groupBy("lang", "segment")).applyInArrow(
            lambda cells, members: _price_segment(cells, members, top), "lang string, source string, other string, term string, value bigint")

    def pairs(self) -> DataFrame:
        """``lang, source, other, value`` for every two sources of a language."""
        sums = self.prices.where("term is null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
        empty = self.groups.where("v = 0").select("lang", "source")
        void = empty.join(empty.withColumnRenamed("source", "other"), "lang").where("source <> other")
        return sums.union(void.select("lang", "source", "other", F.lit(0).cast("long")))

    def terms(self) -> DataFrame:
        """``lang, source, term, value``: terms that a source uses more than its language does."""
        return self.prices.where("term is not null").select("lang", "source", "term", "value")


def ranked(rows: DataFrame, item: str, limit: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` in each ``lang, source``: value descending, item ascending; up to ``limit``, cut in each part before they meet."""
    order = [F.col("value").desc(), F.col(item)]
    if limit is not None:
        part = F.pmod(F.xxhash64(item), F.lit(64))
        cut = F.row_number().over(Window.partitionBy("lang", "source", part).orderBy(*order))
        rows = rows.withColumn("cut", cut).where(F.col("cut") <= limit).drop("cut")
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return out.where(F.col("rank") <= limit) if limit is not None else out


def consed(counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, int]:
    """Hash-consed trees over the columns of ``counts`` (a power of two), one tree a row.

    Gives the distinct leaf counts, per level the children (left, right) of its distinct nodes, the root of each
    row, and the number of levels.
    """
    leaves, nodes = np.unique(counts, return_inverse=True)
    nodes, levels = nodes.reshape(counts.shape), []
    while nodes.shape[1] > 1:
        keys = nodes[:, ::2].astype(np.int64) << 32 | nodes[:, 1::2]
        distinct, inverse = np.unique(keys, return_inverse=True)
        levels.append(np.stack((distinct >> 32, distinct & 0xFFFFFFFF)))
        nodes = inverse.reshape(keys.shape)
    return leaves, levels, nodes[:, 0], len(levels)


def share(count: int, total: int, v: int) -> int:
    return 1 + SCALE * (count + 1) // (total + v)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def price_of_pairs(trees: tuple, shares: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Prices of tree ``first[i]`` against tree ``second[i]``; ``shares[t, leaf]`` is the share of a leaf in a tree with the totals of t.

    Rows of ``shares`` that are equal stand for equal totals, so pairs of such trees are one.
    """
    leaves, levels, roots, depth = trees
    _, kind = np.unique(shares, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    kinds = int(kind.max()) + 1
    example = np.zeros(kinds, np.int64)
    example[kind] = np.arange(len(kind))

    def distinct(totals: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct (pair of totals, node, node), and where each of the given ones is among them."""
        order = np.lexsort((w, u, totals))
        t, a, b = totals[order], u[order], w[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        where = np.empty(len(t), np.int64)
        where[order] = np.cumsum(new) - 1
        return t[new], a[new], b[new], where

    totals, u, w, root_of = distinct(kind[first] * kinds + kind[second], roots[first], roots[second])
    met = []
    for level in reversed(levels):
        n = len(totals)
        totals, u, w, below = distinct(np.concatenate((totals, totals)), np.concatenate((level[0][u], level[1][u])),
                                       np.concatenate((level[0][w], level[1][w])))
        met.append((below[:n], below[n:]))
    prices = price(shares[example[totals // kinds], u], shares[example[totals % kinds], w])
    for left, right in reversed(met):
        prices = prices[left] + prices[right]
    return prices[root_of]


_PRICES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("term", pa.string()), ("value", pa.int64())])


def _price_segment(cells: pa.Table, members: pa.Table, top: int | None) -> pa.Table:
    if not len(cells) or not len(members):
        return _PRICES.empty_table()
    lang, v, all_total = (members.column(c)[0].as_py() for c in ("lang", "v", "all_total"))
    sources, totals = members.column("source").combine_chunks(), members.column("total").to_pylist()
    row = pc.index_in(cells.column("source"), value_set=sources).to_numpy()
    coded = cells.column("term").combine_chunks().dictionary_encode()
    column, terms = coded.indices.to_numpy(), coded.dictionary
    counts = np.zeros((len(sources) + 1, len(terms)), np.int64)  # the last row: the whole language
    counts[row, column] = cells.column("n").to_numpy()
    counts[-1, column] = cells.column("all_n").to_numpy()
    order = np.lexsort(counts)
    counts, terms = counts[:, order], terms.take(pa.array(order))
    # Places beyond the last term have a leaf of their own (-1), which costs nothing.
    size = 1 << max(0, len(terms) - 1).bit_length()
    padded = np.full((len(counts), size), -1, np.int64)
    padded[:, :len(terms)] = counts
    trees = consed(padded)
    shares = np.array([[share(int(c), t, v) if c >= 0 else 1 for c in trees[0]] for t in [*totals, all_total]], np.int64)

    def table(first: np.ndarray, other: pa.Array | None, term: pa.Array | None, value: np.ndarray) -> pa.Table:
        none = pa.nulls(len(value), pa.string())
        return pa.Table.from_arrays([pa.array([lang] * len(value), pa.string()), sources.take(pa.array(first)), none if other is None else other,
                                     none if term is None else term, pa.array(value, pa.int64())], schema=_PRICES)

    s = len(sources)
    first, second = np.divmod(np.arange(s * s), s)
    first, second = first[first != second], second[first != second]
    out = []
    if s > 1:
        out.append(table(first, sources.take(pa.array(second)), None, price_of_pairs(trees, shares, first, second)))
    # Against the language leaves are the result: each pair of counts is priced once.
    own, at = np.nonzero(counts[:-1])
    leaf = np.searchsorted(trees[0], counts)
    pairs = np.stack((own, leaf[own, at], leaf[-1, at]))
    distinct, where = np.unique(pairs, axis=1, return_inverse=True)
    p, q = shares[distinct[0], distinct[1]], shares[-1, distinct[2]]
    values = np.where(p > q, price(p, q), -1)[where.reshape(-1)]
    more = values >= 0
    own, at, values = own[more], at[more], values[more]
    if top is not None and len(values):
        # What is beyond the limit in its segment is so in its group; names in UTF-8 order break ties.
        name = pc.rank(terms.cast(pa.binary()), "ascending").to_numpy()[at]
        order = np.lexsort((name, -values, own))
        own, at, values = own[order], at[order], values[order]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        place = np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own))))
        own, at, values = own[place < top], at[place < top], values[place < top]
    out.append(table(own, None, terms.take(pa.array(at)), values))
    return pa.concat_tables(out)
