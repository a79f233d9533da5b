from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.llm.topk import integer_vector, top_k


def brute(rows, k):
    """``rows``: (id, vector), ids may repeat."""
    found = {}
    for q, v in rows:
        if q % 50 == 0:
            found.setdefault(q, []).extend((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
    return sorted((q, n, i, -s) for q, others in found.items() for n, (s, i) in enumerate(sorted(others)[:k], 1))


@pytest.mark.parametrize("block,query_block", [(8192, 512), (37, 2)])
def test_against_brute_force(spark, block, query_block):
    rng = np.random.default_rng(2)
    vectors = {i: rng.integers(-300, 300, 8) for i in range(400)}
    vectors |= {400 + i: vectors[50].copy() for i in range(60)}  # a common vector, ids tie
    vectors |= {1000 + i: np.array([i, -i, 10**12]) for i in range(60)}  # another length, large components
    vectors[2000] = np.array([1])  # nothing to compare with
    rows = list(vectors.items())
    rows += [(7, vectors[50])] * 9 + [(50, vectors[50])] * 3  # repeated rows, of a candidate and of a query
    rows += [(100, vectors[100] * n) for n in range(2, 12)] + [(9, vectors[100] * n) for n in range(2, 5)]  # one id, many vectors
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows], "id long, v array<long>").repartition(3)
    got = top_k(df, F.col("id") % 50 == 0, 5, block=block, query_block=query_block)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_odd_rows(spark):
    rows = [(0, [0.5, 1.0]), (0, [0.5, 1.0]), (1, [0.25, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 0.0]), (4, None),
            (5, [-0.001, 1.0]), (None, [1.0, 1.0]), (50, []), (100, [])]
    df = spark.createDataFrame(rows, "id long, e array<float>").select("id", integer_vector(F.col("e")).alias("v"))
    got = sorted(tuple(r) for r in top_k(df, F.col("id") % 50 == 0, 5).collect())
    best = 128 * -1 + 256 * 256
    assert got == [(0, 1, 5, best), (0, 2, 5, best), (50, 1, 100, 0), (100, 1, 50, 0)]
    assert top_k(df.limit(0), F.col("id") % 50 == 0, 5).count() == 0
