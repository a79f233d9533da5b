from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from tillcast.llm import simhash


def fingerprint_by_definition(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbÉé \t\n\x0b\x1c\u00a0x", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == fingerprint_by_definition(text)


def test_long_texts_are_hashed_whole(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text)
    assert whole & (2**64 - 1) == fingerprint_by_definition(text)
    monkeypatch.setattr(simhash, "HASH_BLOCK", 100)
    assert simhash.fingerprint(text) == whole


def flipped(rng, value, n):
    for bit in rng.choice(64, n, replace=False):
        value ^= 1 << int(bit)
    return value


def family(rng, size, flips):
    centre = int(rng.integers(0, 2**64, dtype=np.uint64))
    return [flipped(rng, centre, int(rng.integers(0, flips))) for _ in range(size)]


def roots_by_brute_force(fps, budget):
    root = {f: f for f in fps}
    signed = {f: int(np.uint64(f).view(np.int64)) for f in fps}
    todo = set(fps)
    for start in sorted(fps, key=signed.get):
        if start not in todo:
            continue
        stack = [start]
        todo.discard(start)
        while stack:
            x = stack.pop()
            near = [y for y in todo if (x ^ y).bit_count() <= budget]
            todo.difference_update(near)
            stack += near
            for y in near:
                root[y] = start
    return {signed[f]: signed[r] for f, r in root.items()}


@pytest.mark.parametrize("budget,unit_rows", [(4, 2048), (4, 40), (6, 100)])
def test_links_and_components(spark, budget, unit_rows):
    rng = np.random.default_rng(budget)
    fps = {int(x) for x in rng.integers(0, 2**64, 150, dtype=np.uint64)} | {0}
    for _ in range(30):
        fps |= set(family(rng, 4, budget + 2))
    fps |= set(family(rng, 400, 5))  # a dense group: its units must be split
    want = roots_by_brute_force(sorted(fps), budget)
    df = spark.createDataFrame([(0, x) for x in want], "print int, fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, budget, unit_rows).select("a", "b")).collect()}
    assert {x: got.get(x, x) for x in want} == want


def test_traversal_gives_each_pair_once():
    rng = np.random.default_rng(5)
    keys = np.unique(np.array(family(rng, 300, 8) + family(rng, 50, 3), np.uint64))
    found = [p for i, j in simhash.linked_pairs(keys, np.array([[0], [len(keys)], [0], [len(keys)]])) for p in zip(i.tolist(), j.tolist())]
    want = {(i, j) for i in range(len(keys)) for j in range(i) if int(keys[i] ^ keys[j]).bit_count() <= 4}
    assert len(found) == len(want) and {(max(p), min(p)) for p in found} == want


TEXT = " ".join(f"word{i}" for i in range(300))


def test_near_duplicates_of_odd_rows(spark):
    rows = [(7, TEXT), (3, TEXT.upper()), (3, TEXT.upper()), (9, TEXT + " end"), (5, None), (4, ""), (None, " \t"), (8, "another text of few words")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ROW string, fp int")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([(7, 3), (3, 3), (3, 3), (9, 3), (5, 4), (4, 4), (0, 4), (8, 8)])
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 8]
    several = simhash.keep_one_of_each(docs, width=5, budget=6, prints=3)
    assert sorted(r.doc_id for r in several.collect()) == [3, 4, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_several_fingerprints_find_more(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(40):
        words = [f"g{g}w{i}" for i in range(200)]
        rows.append((2 * g, " ".join(words)))
        for at in rng.choice(200, 2, replace=False):
            words[at] = "changed"
        rows.append((2 * g + 1, " ".join(words)))  # about nine tenths in common
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one_of_each(docs, width=5, budget=6, prints=4)
    found = {r.doc_id for r in kept.collect()}
    assert {2 * g for g in range(40)} <= found and len(found) <= 48
