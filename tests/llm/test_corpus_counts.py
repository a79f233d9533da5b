"""Collocations and source divergence: odd tables and small parameters against SQL and brute force."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from oracle_check import rows_of
from tillcast.llm import collocations, divergence
from tillcast.llm.oracle import ORACLE
from tillcast.llm.queries import QUERIES
from tillcast.llm.tables import staged

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, PHRASE string, n int, term string, value string, shard int, rank int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    words = ["The", "of", "ÄRA", "ära", "x*y", "a\x00b", " ", "n1", "日本", "z\x1fz", "de", "É"]
    rows = []
    for i in range(400):
        picked = rng.choice(words, int(rng.integers(0, 40)), p=np.arange(12, 0, -1) / 78)
        text = "".join(w + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "], p=[.6, .1, .05, .05, .05, .05, .05, .05])) for w in picked)
        rows.append((i, text, [None, "", "en", "en", "de"][i % 5], [None, "", "s1", "s2", "sé"][i % 7 % 5]))
    rows += [(1000, None, "en", None), (1001, "", None, "s9"), (1002, "only", "solo", "lonely"), (1003, "only", "solo", "other"), (1002, "only", "solo", "lonely")]
    rows += [(2000 + i, "new york city of the north " * 5, "en", "s1") for i in range(20)] * 2
    rows += [(None, "lone words stay here. " * 9000, "en", "s2")]
    path = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame([(*r, "p", 1, "t", "v", 2, 3) for r in rows], SCHEMA)
    df.repartition(5).write.parquet(str(path / "documents.parquet"))
    df.limit(0).write.parquet(str(path / "none" / "documents.parquet"))
    return path


@pytest.mark.parametrize("name", ["op11_collocations", "op12_divergence"])
def test_odd_rows_against_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    result = con.execute(ORACLE[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    df = QUERIES[name](spark, str(odd))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want and len(want[1]) > 20
    assert QUERIES[name](spark, str(odd / "none")).count() == 0


def phrases_by_brute_force(rows, min_count, longest):
    counts = Counter()
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                counts.update((lang or "und", " ".join(words[i:i + k])) for i in range(len(words) - k + 1))
    return {p: n for p, n in counts.items() if n >= min_count}


@pytest.mark.parametrize("shards,longest,bits", [(1, 4, 24), (3, 5, 24), (6, 4, 3)])
def test_phrase_counts_for_any_cycle_and_table(spark, odd, shards, longest, bits):
    # With eight slots nearly every phrase shares one.
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    want = phrases_by_brute_force([(lang if lang is not None else None, t) for lang, t in rows if lang != ""], 7, longest)
    got = collocations.frequent_phrases(docs.where("lang is null or lang <> ''"), min_count=7, longest=longest, shards=shards,
                                        slot_bits=bits, chunk_bytes=900).where("length > 0").collect()
    assert len(got) == len(want) and {(r.lang, r.phrase): r.n for r in got} == want


def test_complete_rare_phrases_are_not_written(spark, odd, monkeypatch):
    docs, written = spark.read.parquet(f"{odd}/documents.parquet"), []

    def recorded(df, name, by=None):
        out = staged(df, name, by)
        if name == "phrase-counts":
            written.append(out)
        return out

    monkeypatch.setattr(collocations, "staged", recorded)
    collocations.frequent_phrases(docs, min_count=7, shards=2)
    for step, found in enumerate(written, 1):
        assert found.where(f"tag % 16 > 0 and n < 7 and floor(tag / 16) + 2 <= {step}").isEmpty()


def test_later_cycles_tell_only_used_words_apart():
    texts, langs = [b"a bb  a, ccc\nbb a", b"", b" bb ccc ", b"a"], ["en", "de", "de", "en"]
    texts = [t.translate(collocations._FOLD) for t in texts]
    whole, part = collocations.Tokens(texts, langs), collocations.Tokens(texts, langs, whole=False)
    assert (whole.hashes == part.hashes).all() and (whole.piece == part.piece).all()
    # Equal hashes for equal language and word, wherever they lie.
    assert len(set(whole.hashes)) == len(set(whole.ids)) == 5 and len(set(zip(whole.hashes, whole.ids))) == 5
    places = np.array([0, 4])  # "a bb" in the first piece, "bb a" in the third
    part.encode(np.array([0, 1, 4, 5]))
    found, n = part.counted(places, 2)
    assert len(part.words) == 2 and sorted(zip(part.keys(found, 2).to_pylist(), n)) == [("en\na bb", 1), ("en\nbb a", 1)]
    assert not len(collocations.Tokens([b"", b" "], ["en", "en"], whole=False).hashes)


def test_phrases_are_told_apart_beyond_64_bits(monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(5000)).encode()]
    tokens = collocations.Tokens(texts, ["en"])
    monkeypatch.setattr(tokens, "n_ids", 1 << 40)
    places, n = tokens.counted(np.arange(4997), 4)
    assert sorted(places) == list(range(4997)) and set(n) == {1}


def test_trees_share_nodes_and_price_pairs_once():
    rng = np.random.default_rng(2)
    counts = rng.choice([0, 0, 0, 1, 5], (5, 64))
    counts[3] = counts[2]
    counts[:, 32:] = 0
    trees = divergence.consed(counts)
    leaves, levels, roots, depth = trees
    assert depth == 6 and roots[2] == roots[3] and len(set(roots[[0, 1, 2, 4]])) == 4

    def expand(node, level):
        if level < 0:
            return [leaves[node]]
        left, right = levels[level][:, node]
        return expand(left, level - 1) + expand(right, level - 1)

    assert all(expand(r, depth - 1) == list(c) for r, c in zip(roots, counts))
    totals = [int(c.sum()) for c in counts]
    shares = np.array([[divergence.share(int(c), t, 64) for c in leaves] for t in totals], np.int64)
    first, second = np.array(list(itertools.permutations(range(5), 2))).T
    got = divergence.price_of_pairs(trees, shares, first, second)
    for i, j, value in zip(first, second, got):
        p = [divergence.share(int(c), totals[i], 64) for c in counts[i]]
        q = [divergence.share(int(c), totals[j], 64) for c in counts[j]]
        assert value == sum((a - b) ** 2 // b for a, b in zip(p, q))


def test_small_segments_and_huge_counts(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    whole, small = divergence.Audit(docs), divergence.Audit(docs, segment_cells=8)
    for part in (divergence.Audit.pairs, divergence.Audit.terms):
        assert sorted(map(tuple, part(whole).collect())) == sorted(map(tuple, part(small).collect()))
    few = divergence.Audit(docs, top=3, segment_cells=8).terms()
    for n in (3, 1):
        assert sorted(map(tuple, divergence.ranked(few, "term", n).collect())) == sorted(map(tuple, divergence.ranked(whole.terms(), "term", n).collect()))
    assert divergence.share(10**13, 3 * 10**13, 10**6) == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 10**6)
