from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.llm import langid
from tillcast.llm.queries import op4_language_id

PIECES = ["a", "b", "ab", "ba", "▁", "▁a", "abb", "▁b"]


@pytest.fixture(scope="module")
def prob():
    p = np.random.default_rng(0).random((len(PIECES) + 1, 3))
    p /= p.sum(axis=0)
    p[0] = langid.UNKNOWN
    return p


def segmentations(word, prob, lang):
    ids = {p: i for i, p in enumerate(PIECES, 1)}

    def walk(i):
        if i == len(word):
            yield 1.0, ()
        for j in range(i + 1, len(word) + 1):
            pid = ids.get(word[i:j], 0 if j == i + 1 else None)
            if pid is not None:
                for value, rest in walk(j):
                    yield prob[pid, lang] * value, (pid, *rest)

    return list(walk(0))


WORDS = ["a", "ab", "abba", "abbaabx", "bbbb", "babababa", "é"]


def test_forward_sums_all_segmentations(prob):
    lattice = langid.Lattice(WORDS, langid.Trie(PIECES))
    logs, uses = lattice.log_probability(prob), lattice.expected(prob, np.ones((len(WORDS), 3)))
    want = np.zeros_like(prob)
    for k, word in enumerate(WORDS):
        for lang in range(3):
            every = segmentations("▁" + word, prob, lang)
            total = sum(v for v, _ in every)
            assert logs[k, lang] == pytest.approx(math.log(total))
            for value, pieces in every:
                for pid in pieces:
                    want[pid, lang] += value / total
    assert np.allclose(uses, want)


def test_long_words_keep_their_scale(prob):
    trie, word = langid.Trie(PIECES), "ab" * 100 + "x" * 20 + "ba" * 18
    together = langid.Lattice([word, "ab", "x" * 256], trie).log_probability(prob)
    assert np.isfinite(together).all()
    assert together[0] == pytest.approx(langid.Lattice([word], trie).log_probability(prob)[0])
    exact = np.zeros(3)
    for lang in range(3):  # plain logs, letter by letter
        ids = {p: i for i, p in enumerate(PIECES, 1)}
        marked, alpha = "▁" + word, [0.0]
        for e in range(1, len(marked) + 1):
            ways = [alpha[s] + math.log(prob[ids.get(marked[s:e], 0), lang]) for s in range(max(0, e - 3), e) if e - s == 1 or marked[s:e] in ids]
            top = max(ways)
            alpha.append(top + math.log(sum(math.exp(w - top) for w in ways)))
        exact[lang] = alpha[-1]
    assert together[0] == pytest.approx(exact)


def test_held_out_accuracy(spark, sf_oracle):
    docs = spark.read.parquet(f"{sf_oracle}/documents.parquet")
    rows = op4_language_id(spark, sf_oracle).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(40)] + [(100 + i, "der hund und die katze", "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "the", None), (None, "der", "de")]
    return spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, lang string, SCORE string")


def test_odd_rows(spark, small):
    model = langid.fit(small)
    rows = [(1, "the dog"), (2, None), (3, ""), (4, "123 !?"), (5, "ጀጀጀ"), (6, "x" * 100_000), (6, "Hund und Katze")]
    docs = spark.createDataFrame([(*r, "en", "old") for r in rows], small.schema)
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    found = [(r.doc_id, r.lang_pred) for r in got.collect()]
    assert found[:4] == [(1, "en"), (2, "und"), (3, "und"), (4, "und")] and found[6] == (6, "de") and len(found) == 7
    assert [r.score for r in got.collect()][4] == pytest.approx(0.5)  # letters of no known language
    kept = langid.keep_identified(docs, model, least_score=0.51)
    assert kept.columns == docs.columns and {1} <= {r.doc_id for r in kept.collect()} <= {1, 6}


def test_nothing_to_learn_from(spark, small):
    model = langid.fit(small.where(F.col("lang") == "xx"))
    assert [tuple(r) for r in langid.identify(small.limit(2), model).select("lang_pred", "score").collect()] == [("und", 0.0)] * 2
    assert langid.identify(small.limit(0), langid.fit(small)).count() == 0
