"""Near duplicates by SimHash: fingerprints, a distributed binary-trie self-join, connected components.

Fingerprints are 64 bits: a bit is set if it is set in over half of the hashes of the text's word shingles.
Two link if they differ in at most ``budget`` bits (4 unless said otherwise). Several independent
fingerprints of a text (``prints``) may be used: texts link if they link under any of them.

The trie self-join. Bits are cut into budget + 2 blocks. Two fingerprints within the budget agree on at
least two whole blocks, so the join walks one trie for each two blocks (15 for four bits), with these two
in front: on the first levels a node is paired with itself only, below them with every node of the same
subtrie. A subtrie is one unit of work.
Within it node pairs are traversed together from the root, jumping over levels on which neither node
branches; the bits in which the two prefixes differ are added up, and a pair is pruned as soon as they
exceed the budget. Units of one batch are traversed at once in numpy. A unit with more than ``UNIT_ROWS``
fingerprints is first split by Spark: its nodes eight levels deeper are paired, pruned by the same budget,
and each pair becomes a unit, until all are small. A unit gives the links of a spanning forest: no link
between fingerprints is lost, but a dense unit does not give all its pairs.

Equal fingerprints are joined before (a group of exact copies is one fingerprint), and components are found
by star contraction over links, checkpointed in the shared folder every round. Nothing is collected.

Null and empty texts have fingerprint zero and link like any other. Repeated rows have one result each. A
null doc_id takes part, but is never a component's id unless all its ids are null. Empty tables give empty
results. Long texts are hashed whole, in blocks.

``near_duplicates`` links by fingerprints alone. ``keep_one_of_each``, which drops rows, compares the shingle
sets of the texts that fingerprints propose and links only those that reach the similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.tables import free_name, staged, with_row_id

BUDGET = 4
SIMILARITY = 0.8
UNIT_ROWS = 2048
DEEPER = 8  # levels by which a large unit is split at a time
FRONTIER = 200_000  # node pairs held at once
HASH_BLOCK = 1 << 16
MAX_BROADCAST_BYTES = 32 << 20
FIRST_PRINTS = 2  # prints whose links are drawn together before the others are traversed
NO_ROOT = -1  # a node that happens to be called so is only linked more often than needed
HUB_PAIRS = 512  # pairs of one text that are compared in one task


def shingle_hashes(text: str, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Blocks of XXH64 hashes of the word shingles of a text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words) - width + 1
    if not words:
        return
    if n < 1:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for first in range(0, n, HASH_BLOCK):
        part = words[first:first + HASH_BLOCK + width - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[:len(part) - width + 1].tolist(), ends[width - 1:].tolist())
        yield np.fromiter((digest(line[s:e], seed) for s, e in spans), np.uint64, len(part) - width + 1)


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Independent hashes from the first ones (number 0: unchanged), by a bijective mix."""
    if not number:
        return hashes
    x = hashes ^ np.uint64(0x9E3779B97F4A7C15 * number % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, from bit 0."""
    parts = hashes.view(np.uint8).reshape(-1, 8)
    if len(parts) < 512:
        return np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(parts[:, i], minlength=256) @ _BITS_OF_BYTE for i in range(8)])


def _prints_of(blocks: Iterable[np.ndarray], prints: int) -> list[int]:
    counts, n = np.zeros((prints, 64), np.int64), 0
    for hashes in blocks:
        if len(hashes) < 512:
            mixed = np.stack([_mixed(hashes, i) for i in range(prints)])
            bits = np.unpackbits(mixed.view(np.uint8).reshape(prints, -1, 8), axis=2, bitorder="little")
            counts += bits.sum(axis=1, dtype=np.uint16)
        else:
            for i in range(prints):
                counts[i] += _bit_counts(_mixed(hashes, i))
        n += len(hashes)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view(np.int64)[:, 0].tolist() if n else [0] * prints


def fingerprints(text: str | None, width: int = 4, prints: int = 1) -> list[int]:
    """The fingerprints as signed 64-bit numbers."""
    return _prints_of(shingle_hashes(text or "", width), prints)


def fingerprint(text: str | None, width: int = 4) -> int:
    return fingerprints(text, width)[0]


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 4, prints: int = 1, out: str = "fps") -> DataFrame:
    @F.udf("array<bigint>", useArrow=True)
    def of(value):
        return fingerprints(value, width, prints)

    return docs.withColumn(out, of(F.col(f"`{text}`")))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class Layout:
    """Tries over the bits of fingerprints, cut into ``blocks``: ``front`` of them lead, the others follow; the root's level is bit 63.

    With ``budget + front`` blocks (the default) fingerprints within the budget agree on ``front`` whole blocks, so one of
    the tries has them in one subtrie. Fewer blocks are wider: fewer subtries a fingerprint, and pairs that differ in
    every block are missed, for which several independent fingerprints make up.
    """

    def __init__(self, budget: int = BUDGET, blocks: int | None = None, front: int = 2):
        self.budget, n = budget, blocks or budget + front
        self.widths = [64 // n + (i < 64 % n) for i in range(n)]  # from the lowest bit
        self.offsets = [sum(self.widths[:i]) for i in range(n)]
        self.tries = list(combinations(range(n), front))
        self.front = [sum(self.widths[b] for b in trie) for trie in self.tries]

    def _moves(self, trie: int) -> Iterator[tuple[int, int, int]]:
        """(from, mask, to) of every block."""
        first, at = self.tries[trie], 64
        for b in [*first, *[b for b in range(len(self.widths)) if b not in first]]:
            at -= self.widths[b]
            yield self.offsets[b], (1 << self.widths[b]) - 1, at

    def moved(self, fps: np.ndarray, trie: int) -> np.ndarray:
        out = np.zeros_like(fps)
        for old, mask, new in self._moves(trie):
            out |= ((fps >> np.uint64(old)) & np.uint64(mask)) << np.uint64(new)
        return out

    def moved_column(self, fp: Column, trie: int) -> Column:
        parts = [F.shiftleft(F.shiftrightunsigned(fp, old).bitwiseAND(F.lit(mask)), new) for old, mask, new in self._moves(trie)]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.bitwiseOR(p)
        return whole


def links(fps: DataFrame, budget: int = BUDGET, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``unit, print, a, b``: links that connect all fingerprints within the budget. ``fps`` has distinct ``print, fp``."""
    layout = Layout(budget)
    return reduce(DataFrame.union, [_traverse(u, layout) for u in _units(fps, layout, unit_rows)])


def _units(fps: DataFrame, layout: Layout, unit_rows: int, *carried: str) -> list[DataFrame]:
    """``unit, walk, side, fp`` and the columns ``carried``: units of at most ``unit_rows`` fingerprints, in parts."""
    n = len(layout.tries)
    nodes = [F.struct(F.lit(i).alias("trie"), F.shiftrightunsigned(layout.moved_column(F.col("fp"), i), 64 - layout.front[i]).alias("node"))
             for i in range(n)]
    members = fps.select("print", "fp", *carried, F.explode(F.array(*nodes)).alias("x"))
    # A unit is a subtrie, or a pair of them: sides 0 and 1 are their members. ``walk`` tells print and trie.
    walk = (F.col("print") * n + F.col("x.trie")).cast("int")
    units = members.select(F.xxhash64(walk, "x.node").alias("unit"), walk.alias("walk"), F.lit(0).alias("side"), "fp", *carried)
    counts = units.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > unit_rows)
    large = staged(counts.select("unit"), "simhash-large")
    parts = [units.join(large, "unit", "left_anti")]
    todo = staged(units.join(large, "unit", "left_semi"), "simhash-split")
    depth = min(layout.front)
    while depth < 64 and not todo.isEmpty():
        depth = min(64, depth + DEEPER)
        small, todo = _split(todo, layout, depth, unit_rows)
        parts.append(small)
    return parts


def _split(units: DataFrame, layout: Layout, depth: int, unit_rows: int) -> tuple[DataFrame, DataFrame]:
    """Pair the nodes at ``depth`` of every unit; the pairs are the new units, small and still too large."""
    trie = F.col("walk") % len(layout.tries)
    moved = F.when(trie == 0, layout.moved_column(F.col("fp"), 0))
    for i in range(1, len(layout.tries)):
        moved = moved.when(trie == i, layout.moved_column(F.col("fp"), i))
    rows = units.withColumn("child", F.shiftrightunsigned(moved, 64 - depth))
    nodes = rows.groupBy("unit", "side", "child").agg(F.count("*").alias("n"))
    # A unit of one side pairs its nodes among themselves, one of two sides those of side 0 with side 1.
    sides = nodes.groupBy("unit").agg(F.max("side").alias("last"))
    left = nodes.join(sides, "unit").select("unit", F.col("side").alias("sa"), F.col("child").alias("a"), F.col("n").alias("na"), "last")
    right = nodes.select(F.col("unit").alias("ub"), F.col("side").alias("sb"), F.col("child").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, (F.col("unit") == F.col("ub")) & (F.col("sb") == F.col("last")) & (F.col("sa") == 0)
                      & ((F.col("last") == 1) | (F.col("a") <= F.col("b")))
                      & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= layout.budget))
    own = (F.col("last") == 0) & (F.col("a") == F.col("b"))
    pairs = staged(pairs.where(~own | (F.col("na") > 1)).select(
        "unit", F.xxhash64("unit", "a", "b").alias("pair"), "sa", "a", "sb", "b", "last", own.alias("own"),
        F.when(own, F.col("na")).otherwise(F.col("na") + F.col("nb")).alias("n")), "simhash-pairs")
    ends = pairs.select("unit", "pair", "n", F.explode(F.when(F.col("own"), F.array(
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("side"), F.col("a").alias("child")))).otherwise(F.array(
            F.struct(F.lit(0).alias("to"), F.lit(0).alias("side"), F.col("a").alias("child")),
            F.struct(F.lit(1).alias("to"), F.col("sb").alias("side"), F.col("b").alias("child"))))).alias("e"))
    ends = ends.select("unit", "pair", "n", "e.*")
    dealt = staged(rows.join(ends, ["unit", "side", "child"]).select(F.col("pair").alias("unit"), "walk", F.col("to").alias("side"), "fp", *units.columns[4:], "n"), "simhash-units")
    return dealt.where(F.col("n") <= unit_rows).drop("n"), dealt.where(F.col("n") > unit_rows).drop("n")


FOUND = "unit bigint, print int, a bigint, b bigint"


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, put together so that no unit is in two of them."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        unit = now.column(0).to_numpy()
        # The last unit may go on in the next batch.
        done = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
        rest = now.slice(done)
        if done:
            yield now.slice(0, done)
    if rest is not None and len(rest):
        yield rest


def _traverse(units: DataFrame, layout: Layout) -> DataFrame:
    """Links of a spanning forest of each unit; the rows of a unit meet in one task and are at most ``UNIT_ROWS``.

    If the units carry a ``root``, fingerprints of one root are joined already and only links between roots are given.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches):
            unit, walk, side, fp = (table.column(i).to_numpy() for i in range(4))
            order, pairs = _pairs_of_units(unit, walk, side, fp, layout)
            unit, walk, fp, label = unit[order], walk[order], fp[order], np.arange(len(order))
            if table.num_columns > 4:
                label = _first_of_root(unit, table.column(4).to_numpy()[order])
            for i, j in pairs:
                i, j = _union(label, i, j)
                which = (walk[i] // len(layout.tries)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(unit[i]), pa.array(which), pa.array(fp[i]), pa.array(fp[j])], names=["unit", "print", "a", "b"])

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, FOUND)


def _first_of_root(unit: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For every place the first one of its unit and root, with ``NO_ROOT`` the place itself."""
    order = np.lexsort((root, unit))  # stable
    new = np.ones(len(order), bool)
    new[1:] = (unit[order[1:]] != unit[order[:-1]]) | (root[order[1:]] != root[order[:-1]]) | (root[order[1:]] == NO_ROOT)
    label = np.empty(len(order), np.int64)
    label[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return label


def _pairs_of_units(unit: np.ndarray, walk: np.ndarray, side: np.ndarray, fp: np.ndarray, layout: Layout):
    """An order of the rows, and places in it of all pairs within the budget, unit by unit. Rows are distinct."""
    bits = fp.view(np.uint64)
    moved = np.empty_like(bits)
    for i in range(len(layout.tries)):
        of = walk % len(layout.tries) == i
        moved[of] = layout.moved(bits[of], i)
    order = np.lexsort((moved, side, unit))
    unit, side, moved = unit[order], side[order], moved[order]
    change = np.flatnonzero((unit[1:] != unit[:-1]) | (side[1:] != side[:-1])) + 1
    low = np.concatenate(([0], change))
    high = np.concatenate((change, [len(unit)]))
    second = np.zeros(len(low), bool)  # the range is side 1 of the unit before it
    second[1:] = unit[low[1:]] == unit[low[:-1]]
    paired = np.zeros(len(low), bool)
    paired[:-1] = second[1:]
    alone = ~second & ~paired & (high - low > 1)
    first = np.flatnonzero(paired)
    begin = np.concatenate((np.stack((low[alone], high[alone], low[alone], high[alone])),
                            np.stack((low[first], high[first], low[first + 1], high[first + 1]))), axis=1)
    return order, linked_pairs(moved, begin, layout.budget)


MEMBERS = "unit bigint, walk int, side int, fp bigint, node bigint"


def _open_pairs(table: pa.Table, layout: Layout, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``table`` of the pairs that may still be linked: within the budget, of different roots and like sizes.

    ``table`` holds whole units with ``unit, walk, side, fp, node, root, size, fps``. A pair is given in the first unit in which it meets.
    """
    unit, walk, side, fp, node, root, size = (table.column(i).to_numpy() for i in range(7))
    prints = np.stack(table.column("fps").to_numpy()).view(np.uint64)
    # Nodes of one fingerprint are one row of the traversal.
    row = np.lexsort((node, fp, side, unit))
    new = np.ones(len(row), bool)
    new[1:] = (unit[row[1:]] != unit[row[:-1]]) | (side[row[1:]] != side[row[:-1]]) | (fp[row[1:]] != fp[row[:-1]])
    first = np.flatnonzero(new)
    held = np.diff(np.append(first, len(row)))
    heads = row[first]
    order, pairs = _pairs_of_units(unit[heads], walk[heads], side[heads], fp[heads], layout)
    own = np.flatnonzero((held > 1) & (side[heads] == 0))

    def expanded(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = held[i] * held[j]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(held[j], n)
        return row[np.repeat(first[i], n) + at // wide], row[np.repeat(first[j], n) + at % wide]

    for i, j in chain([(own, own)], ((order[i], order[j]) for i, j in pairs)):
        for part in range(0, len(i), 4096):
            x, y = expanded(i[part:part + 4096], j[part:part + 4096])
            open_ = (root[x] != root[y]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9)
            open_ &= node[x] != node[y]
            x, y = x[open_], y[open_]
            fresh = ~_met_before(prints, x, y, walk[x], layout)
            yield x[fresh], y[fresh]


def _open_members(units: DataFrame, layout: Layout, similarity: float) -> DataFrame:
    """``MEMBERS`` that are part of an open pair in their unit; ``units`` as in ``_open_pairs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches):
            some = np.zeros(len(table), bool)
            for x, y in _open_pairs(table, layout, similarity):
                some[x] = some[y] = True
            yield from table.select(range(5)).filter(pa.array(some)).to_batches()

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, MEMBERS)


def _compare_units(units: DataFrame, layout: Layout, similarity: float) -> DataFrame:
    """``a, b``: the open pairs that are truly similar; ``units`` as in ``_open_pairs``, and ``s``.

    A pair is compared where its texts lie together, so no list of pairs is ever written.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches):
            node, size = table.column("node").to_numpy(), table.column("size").to_numpy()
            lists = table.column("s").combine_chunks()
            sets: dict[int, frozenset[int]] = {}
            for x, y in _open_pairs(table, layout, similarity):
                a, b = [], []
                for p, q in zip(x.tolist(), y.tolist()):
                    for k in (p, q):
                        if node[k] not in sets:
                            sets[node[k]] = frozenset(lists[k].as_py())
                    common = len(sets[node[p]] & sets[node[q]])
                    if common >= similarity * (size[p] + size[q] - common) - 1e-9:
                        a.append(node[p])
                        b.append(node[q])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a bigint, b bigint")


def _met_before(prints: np.ndarray, x: np.ndarray, y: np.ndarray, walk: np.ndarray, layout: Layout) -> np.ndarray:
    """Whether a pair is in one subtrie and within the budget under an earlier print and trie than ``walk``."""
    out, n = np.zeros(len(x), bool), len(layout.tries)
    for p in range(prints.shape[1]):
        apart = prints[x, p] ^ prints[y, p]
        near = np.bitwise_count(apart) <= layout.budget
        for t, front in enumerate(layout.tries):
            mask = np.uint64(sum(((1 << layout.widths[b]) - 1) << layout.offsets[b] for b in front))
            out |= near & ((apart & mask) == 0) & (p * n + t < walk)
    return out


def linked_pairs(keys: np.ndarray, roots: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Traverse pairs of trie nodes; index pairs of keys that differ in at most ``budget`` bits.

    A node is a range of sorted keys with a common prefix; ``roots`` has columns (a low, a high, b low,
    b high). The two ranges of a pair are equal or disjoint.
    """
    todo = [roots]
    while todo:
        pairs = todo.pop()
        if pairs.shape[1] > FRONTIER:
            todo += [pairs[:, FRONTIER:]]
            pairs = pairs[:, :FRONTIER]
        if not pairs.shape[1]:
            continue
        a, a_end, b, b_end = pairs
        forks_a, forks_b = _common(keys[a] ^ keys[a_end - 1]), _common(keys[b] ^ keys[b_end - 1])
        level = np.minimum(forks_a, forks_b)  # down to here neither node branches
        apart = keys[a] ^ keys[b]
        differing = np.bitwise_count(np.where(level == 64, apart, apart & ~_mask(level)))
        near = differing <= budget
        leaf = near & (level == 64) & (a != b)
        if leaf.any():
            yield a[leaf], b[leaf]
        go = near & (level < 64)
        a, a_end, b, b_end, level = a[go], a_end[go], b[go], b_end[go], level[go]
        forks_a, forks_b = forks_a[go] == level, forks_b[go] == level
        same = a == b
        mid_a = np.where(forks_a, _fork(keys, a, a_end, level), a_end)
        mid_b = np.where(same, mid_a, np.where(forks_b, _fork(keys, b, b_end, level), b_end))
        grown = []
        for lo_a, hi_a, second_a in ((a, mid_a, False), (mid_a, a_end, True)):
            for lo_b, hi_b, second_b in ((b, mid_b, False), (mid_b, b_end, True)):
                some = (hi_a > lo_a) & (hi_b > lo_b)
                if second_a and not second_b:
                    some &= ~same  # the mirror of the pair (first, second)
                grown.append(np.stack((lo_a[some], hi_a[some], lo_b[some], hi_b[some])))
        todo.append(np.concatenate(grown, axis=1))


def _common(x: np.ndarray) -> np.ndarray:
    """Leading zero bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(s)
    return 64 - np.bitwise_count(x).astype(np.int64)


def _mask(level: np.ndarray) -> np.ndarray:
    """Ones from ``level`` (below 64) down."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(level, 63).astype(np.uint64)


def _fork(keys: np.ndarray, low: np.ndarray, high: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first place in each sorted range whose bit at ``level`` is set (the range's end if none is)."""
    bit = np.uint64(1) << (63 - level).astype(np.uint64)
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = np.where(open_, (low + high) // 2, 0)
        is_set = (keys[mid] & bit) != 0
        high = np.where(open_ & is_set, mid, high)
        low = np.where(open_ & ~is_set, mid + 1, low)


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join the components of linked places; ``label`` keeps every place's smallest. Gives the links that joined two."""
    used = []
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return tuple(np.concatenate(x) for x in zip(*used)) if used else (i[:0], j[:0])
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(label, high, low)
        hooks = np.flatnonzero(label[high] == low)
        hooks = hooks[np.unique(high[hooks], return_index=True)[1]]
        used.append((i[hooks], j[hooks]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge ``a, b``: the smallest node it can reach.

    Alternating large-star and small-star steps, each of them a written table, until all is stars.
    """
    edges = _downward(edges)
    while not _beside_stars(edges).isEmpty():
        edges = _nearer_stars(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _downward(edges: DataFrame, name: str = "edges") -> DataFrame:
    return staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)


def _nearer_stars(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step; ``b`` is the smaller node of an edge, before and after."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = staged(both.join(least, "u").where("v > u").select("v", "m").where("v <> m").distinct().toDF("u", "v"), "edges")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _downward(small.union(least.select("u", "m")))


def _beside_stars(edges: DataFrame) -> DataFrame:
    """Nodes that have two smaller neighbours, or a smaller and a larger one; without such a node every ``b`` is the root of its ``a``."""
    up, down = edges.selectExpr("a AS node", "1 AS up", "0 AS down"), edges.selectExpr("b", "0", "1")
    return up.union(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1")


def proposed(of: DataFrame, layout: Layout, unit_rows: int) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` that connect all nodes within the budget under any print, and their ``components``.

    ``of`` has distinct ``node, print, fp``. The links of the first prints are drawn together before the other prints are
    traversed, which then give only links between what is still apart: a dense group does not bring a forest for every
    print and trie.
    """
    def new_links(of: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        heads, carried = of.groupBy("print", "fp").agg(F.min("node").alias("head")), []
        if roots is not None:
            heads, carried = heads.join(roots.toDF("head", "root"), "head", "left"), ["root"]
        heads = staged(heads, "print-heads")
        parts = _units(heads.fillna(NO_ROOT, carried), layout, unit_rows, *carried)
        found = staged(reduce(DataFrame.union, [_traverse(u, layout) for u in parts]), "simhash-links").select("print", "a", "b").distinct()
        a, b = (heads.select("print", F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in "ab")
        across = found.join(a, ["print", "a"]).join(b, ["print", "b"]).select("head_a", "head_b")
        within = of.join(heads, ["print", "fp"]).where("node <> head")
        if roots is not None:
            within = within.join(roots.toDF("node", "own"), "node", "left").where(~F.coalesce("own", "node").eqNullSafe(F.col("root")))
        return _downward(across.union(within.select("node", "head")).toDF("a", "b"), "unchecked")

    first, rest = new_links(of.where(F.col("print") < FIRST_PRINTS)), of.where(F.col("print") >= FIRST_PRINTS)
    if rest.isEmpty():
        return first, components(first)
    near = _nearer_stars(_nearer_stars(first))
    # Not yet the smallest node that can be reached, but nodes of one root are connected. Nodes without a link are not listed.
    roots = _broadcast_if_small(near.union(near.select("b", "b")).groupBy("a").agg(F.min("b").alias("b")))
    second = new_links(rest, roots)
    return first.union(second), components(near.union(second))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 4, budget: int = BUDGET,
                    prints: int = 1, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its identity), ``doc_id``, ``fp``, ``root``, ``component_id``."""
    row = free_name(docs, "row_id")
    narrow = with_row_id(docs, row).select(F.col(row).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    taken = staged(with_fingerprints(narrow, "text", width, prints).select("row", "doc_id", F.col("fps")[0].alias("fp"), "fps"), "fingerprints")
    # A first fingerprint stands for its texts: those of equal fingerprints are linked anyhow.
    distinct = staged(taken.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    if prints == 1:
        roots = components(links(distinct.select(F.lit(0).alias("print"), "fp"), budget, unit_rows).select("a", "b"))
    else:
        of = staged(taken.select(F.col("fp").alias("node"), F.posexplode("fps").alias("print", "fp")).distinct(), "print-members")
        _, roots = proposed(of, Layout(budget), unit_rows)
    roots = roots.withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root")
    return taken.join(named, "fp").select("row", "doc_id", "fp", "root", "component_id")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return _set_of(list(shingle_hashes(text or "", width)))


def _set_of(blocks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def shingle_sets(ends: DataFrame, nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``node, size, s`` of the nodes in ``ends``; ``nodes`` has ``node, row``, ``texts`` has ``row, text``."""
    @F.udf("array<bigint>", useArrow=True)
    def shingles(value):
        return shingle_set(value, width).view(np.int64).tolist()

    # Only the rows that are wanted travel: their names to the texts, not all texts to their nodes.
    wanted = _broadcast_if_small(staged(nodes.join(ends, "node", "left_semi").select("row", "node"), "shingle-rows"))
    sets = texts.join(wanted, "row").select("node", shingles("text").alias("s"))
    return staged(sets.select("node", F.size("s").alias("size"), "s"), "shingle-sets")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    Sets of too unlike sizes are not compared. A node of many pairs meets them in parts of ``HUB_PAIRS``.
    """
    sizes = sets.select("node", "size")
    near = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    near = near.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    near = staged(near.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(1 << 30)).alias("draw")), "pairs-of-like-size")
    parts = near.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts"))
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")).join(parts, "a")
    left = left.select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = near.join(parts, "a").select("a", "b", (F.col("draw") % F.col("parts")).cast("int").alias("part"))
    right = right.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = right.join(left, ["a", "part"])
    common = F.size(F.array_intersect("sa", "sb"))
    counted = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("n"))
    return staged(counted.where(F.col("common") >= similarity * (F.col("n") - F.col("common")) - 1e-9).select("a", "b"), "similar")


def _broadcast_if_small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() * 40 <= MAX_BROADCAST_BYTES else rows


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes."""
    return staged(nodes.select("node").join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "rooted")


def similar_groups(nodes: DataFrame, texts: DataFrame, width: int, layout: Layout, similarity: float, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``node, root``: components of the texts that are within the budget under any print and truly similar.

    ``nodes`` has ``node, row, fps``, ``texts`` has ``row, text``. Three rounds compare texts exactly: every node with
    the root of its unchecked component, which settles most of a dense group; then links of spanning forests
    between what is still apart; then, inside units, all pairs that are still apart. Units are traversed twice for that: first
    without the shingle sets, which go only to members of such a pair.
    So a refuted link hides no true one, and neither pairs of one component nor refuted ones are ever listed.
    """
    def apart(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
        ends = pairs.join(rooted.toDF("a", "root_a"), "a").join(rooted.toDF("b", "root_b"), "b").where("root_a <> root_b")
        return ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    of = staged(nodes.select("node", F.posexplode("fps").alias("print", "fp")), "print-members")
    edges, roots = proposed(of, layout, unit_rows)
    if edges.isEmpty():
        return nodes.select("node", F.col("node").alias("root"))
    sets = shingle_sets(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts, width)
    first = staged(roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")), "checked")
    true = similar_pairs(first, sets, similarity)
    rooted = _rooted(nodes, true)
    second = staged(apart(edges, rooted).join(first, ["a", "b"], "left_anti"), "checked")
    true = true.union(similar_pairs(second, sets, similarity))
    rooted = _rooted(nodes, true)

    # A node without an edge is within the budget of none.
    live = staged(sets.select("node", "size").join(rooted, "node").join(nodes.select("node", "fps"), "node"), "open-nodes")
    held = live.select("node", "root", "size", "fps", F.posexplode("fps").alias("print", "fp"))
    print_of = (F.col("walk") / len(layout.tries)).cast("int").alias("print")
    parts = _units(held.select("print", "fp").distinct(), layout, unit_rows)
    again = [u.withColumn("print", print_of).join(held, ["print", "fp"]).select("unit", "walk", "side", "fp", "node", "root", "size", "fps") for u in parts]
    members = staged(reduce(DataFrame.union, [_open_members(u, layout, similarity) for u in again]), "open-members")
    compared = members.join(live.join(sets.select("node", "s"), "node"), "node").select("unit", "walk", "side", "fp", "node", "root", "size", "fps", "s")
    true = true.union(staged(_compare_units(compared, layout, similarity), "similar"))
    return _rooted(nodes, true)


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 4, budget: int = BUDGET, prints: int = 1,
                     blocks: int | None = None, front: int = 2, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of every group of near copies: the smallest id, the first row of that id.

    Fingerprints propose pairs, ``blocks`` and ``front`` as in ``Layout``; texts are linked only if their sets of word
    shingles have a Jaccard similarity of ``similarity`` or more, and links are joined transitively. Texts of equal sets
    are one node. Rows of one id are ordered by their content. All columns are kept as they are, whatever they are called.
    """
    @F.udf("struct<digest:binary,fps:array<bigint>>", useArrow=True)
    def marks(value):
        hashes = list(shingle_hashes(value or "", width))
        return hashlib.blake2b(_set_of(hashes).tobytes(), digest_size=16).digest(), _prints_of(hashes, prints)

    row = free_name(docs, "row_id")
    numbered = with_row_id(docs, row)
    content = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    taken = numbered.select(F.col(row).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), content.alias("content"), marks(F.col(f"`{text}`")).alias("m"))
    taken = staged(taken.select("row", "doc_id", "content", "m.*"), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content", "row", "fps"))
    nodes = staged(taken.groupBy("digest").agg(best.alias("best")).select(
        F.monotonically_increasing_id().alias("node"), "digest", "best", F.col("best.fps").alias("fps"), F.col("best.row").alias("row")), "shingle-nodes")
    texts = numbered.select(F.col(row).alias("row"), F.col(f"`{text}`").alias("text"))
    groups = similar_groups(nodes, texts, width, Layout(budget, blocks, front), similarity)
    rooted = nodes.select("node", "digest", "best").join(groups, "node")
    first = rooted.groupBy("root").agg(F.min("best").alias("best")).select("root", F.col("best.row").alias("kept"))
    kept = staged(rooted.select("digest", "root").join(first, "root").select("digest", "kept"), "near-duplicates")
    gone = _broadcast_if_small(staged(taken.select("row", "digest").join(kept, "digest").where("row <> kept").select("row"), "near-duplicates-gone"))
    return numbered.join(gone, numbered[row] == gone["row"], "left_anti").drop(row)
