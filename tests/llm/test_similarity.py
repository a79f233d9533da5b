from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tillcast.llm import simhash


def jaccard(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def met(x, layout):
    """Whether two fingerprints that differ by ``x`` are in one subtrie of the layout and within its budget."""
    same = [not x >> at & ((1 << wide) - 1) for at, wide in zip(layout.offsets, layout.widths)]
    return sum(same) >= len(layout.tries[0]) and x.bit_count() <= layout.budget


def kept_by_brute_force(rows, width, layout, prints, similarity):
    sets = [simhash.shingle_set(t, width) for _, t in rows]
    fps = [[x & (2**64 - 1) for x in simhash.fingerprints(t, width, prints)] for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if any(met(x ^ y, layout) for x, y in zip(fps[i], fps[j])) and jaccard(sets[i], sets[j]) >= similarity:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted({min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)})


@pytest.mark.parametrize("budget,blocks,front", [(10, None, 2), (10, 4, 1)])
def test_only_similar_texts_are_dropped(spark, monkeypatch, budget, blocks, front):
    monkeypatch.setattr(simhash, "HUB_PAIRS", 5)
    rng = np.random.default_rng(3)
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words)))

    shared = [f"s{i}" for i in range(62)]
    for d in range(60):  # a dense group: about 60% in common, no pair reaches 0.8
        add(shared + [f"own{d}x{i}" for i in range(16)])
    for g in range(15):  # near copies at many similarities
        words = [f"g{g}w{i}" for i in range(100)]
        add(words)
        for n in (1, 2, 3, 4):
            changed = list(words)
            for at in rng.choice(100, n, replace=False):
                changed[at] = f"new{g}x{n}x{at}"
            add(changed)
    want = kept_by_brute_force(rows, 5, simhash.Layout(budget, blocks, front), 4, 0.8)
    assert set(range(60)) <= set(want) and len(want) < 120
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.keep_one_of_each(docs, width=5, budget=budget, prints=4, blocks=blocks, front=front).collect())
    # A text may also be linked to a similar one that it meets through others only.
    true = kept_by_brute_force(rows, 5, simhash.Layout(64, 1, 0), 1, 0.8)
    assert set(true) <= set(got) <= set(want)
    assert blocks or got == want


def test_sets_travel_to_members_of_open_pairs_only(spark, monkeypatch):
    shared = [f"s{i}" for i in range(62)]
    rows = [(d, " ".join(shared + [f"own{d}x{i}" for i in range(16)])) for d in range(40)]  # close, but no pair reaches 0.8
    rows += [(100 + d, " ".join([f"c{i}" for i in range(200)] + [f"end{d}"])) for d in range(40)]  # near copies
    layout, seen, compare = simhash.Layout(10, 4, 1), [], simhash._compare_units

    def recorded(units, *args):
        seen.extend(units.select("unit", "walk", "node", "root", "fps", "s").collect())
        return compare(units, *args)

    monkeypatch.setattr(simhash, "_compare_units", recorded)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one_of_each(docs, width=5, budget=10, prints=4, blocks=4, front=1).collect()
    assert sorted(r.doc_id for r in kept) == [*range(40), 100]

    def fronts(x):
        return [t for t in range(4) if not x >> layout.offsets[t] & ((1 << layout.widths[t]) - 1)]

    nodes = list({r.node: r for r in seen}.values())
    want = set()
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            apart = [(x ^ y) & (2**64 - 1) for x, y in zip(a.fps, b.fps)]
            walks = [4 * p + t for p, x in enumerate(apart) if x.bit_count() <= 10 for t in fronts(x)]
            if walks and a.root != b.root:
                want |= {(walks[0], a.node), (walks[0], b.node)}
    assert len(want) > 40 and {(r.walk, r.node) for r in seen} == want and len(seen) == len(want)


def recall_at(similarity, prints, layout, width, pairs=400):
    """Share of random pairs at about the similarity that a fingerprint proposes."""
    rng = np.random.default_rng(8)
    found = tried = 0
    while tried < pairs:
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        changed = list(words)
        for at in rng.choice(120, int(rng.integers(2, 6)), replace=False):
            changed[at] = f"new{at}"
        a, b = " ".join(words), " ".join(changed)
        if abs(jaccard(simhash.shingle_set(a, width), simhash.shingle_set(b, width)) - similarity) > 0.02:
            continue
        tried += 1
        fps = zip(*(simhash.fingerprints(t, width, prints) for t in (a, b)))
        found += any(met((x ^ y) & (2**64 - 1), layout) for x, y in fps)
    return found / tried


def test_prints_of_the_stage_find_copies_at_the_limit():
    layout = simhash.Layout(corpus_pipeline.BITS, corpus_pipeline.BLOCKS, corpus_pipeline.FRONT)
    assert recall_at(0.81, corpus_pipeline.PRINTS, layout, corpus_pipeline.SHINGLE_WORDS) >= 0.95


def test_columns_and_content_decide_nothing_by_chance(spark, tmp_path):
    rows = [(1, "same text of six words here", f"source {i}", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, row_id int").repartition(3)
    docs.write.parquet(str(tmp_path / "a"))
    docs.coalesce(1).write.parquet(str(tmp_path / "b"))
    kept = [simhash.keep_one_of_each(spark.read.parquet(str(tmp_path / x))).collect() for x in "ab"]
    assert kept[0] == kept[1] and len(kept[0]) == 1 and kept[0][0].asDict().keys() == {"doc_id", "text", "_row", "row_id"}


@pytest.mark.parametrize("unit_rows", [2048, 30])
def test_later_prints_add_links_only_between_what_is_apart(spark, unit_rows):
    rng = np.random.default_rng(11)
    layout, rows = simhash.Layout(4), []
    for size in [120, *[4] * 20, *[1] * 40]:  # a dense group, small ones, texts on their own
        centres = [int(x) for x in rng.integers(0, 2**64, 5, dtype=np.uint64)]
        for _ in range(size):
            rows.append([c ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for c in centres])
    rows += [[int(x) for x in rng.integers(0, 2**64, 4, dtype=np.uint64)] + [5] for _ in range(6)]  # equal under the last print only
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and any(met(x ^ y, layout) for x, y in zip(rows[i], rows[j])):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    of = spark.createDataFrame([(i, p, int(np.uint64(x).view(np.int64))) for i, fps in enumerate(rows) for p, x in enumerate(fps)], "node long, print int, fp long")
    edges, roots = simhash.proposed(of, layout, unit_rows)
    for got in roots, simhash.components(edges):
        got = {r.node: r.root for r in got.collect()}
        assert [got.get(i, i) for i in range(len(rows))] == root


def test_a_dense_group_brings_no_forest_for_every_print(spark, monkeypatch):
    shared = [f"s{i}" for i in range(62)]
    rows = [(d, " ".join(shared + [f"own{d}x{i}" for i in range(12)])) for d in range(80)]  # close, but no pair reaches 0.8
    given, components = [], simhash.components

    def recorded(edges):
        given.append(edges.count())
        return components(edges)

    monkeypatch.setattr(simhash, "components", recorded)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one_of_each(docs, width=5, budget=10, prints=10, blocks=4, front=1)
    assert kept.count() == 80
    assert 79 <= max(given) <= 5 * 80  # four tries of one print, not forty of ten
