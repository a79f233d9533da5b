"""Exact top-k inner products with vector-approximation files.

Each component is quantised into one of 256 equal cells between its least and greatest value, so a vector's
approximation is one byte per component. For a query the approximation bounds the score from both sides.
A block of vectors is scanned by its approximations against a block of queries at once; a query's exact
vectors are then read in the order of their bounds, best first, until the k-th exact score beats the bound
of the next, so nothing that could be among the best is left out. Bests of blocks are merged per query.

Equal vectors are met once: a distinct vector carries its k + 1 smallest ids, enough for any query with
its own id left out, as ties go to the smaller id, each as often as its rows have it, up to k times. Work is blocks of queries times blocks of vectors,
joined on the block number; no pair of rows is ever formed by a join.

Vectors that are null or hold null, NaN or infinite components take no part; vectors are compared only with
vectors of the same length. Every row is a candidate, also those of a repeated id, but never for a query of the same
id; a query id with several rows gets the best of all of them. A query with fewer than k candidates gets all. Empty tables give empty results. Scores are exact 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillcast.llm.tables import staged

LEVELS = 256
BLOCK = 8192  # vectors of a block
QUERY_BLOCK = 512
ROUND = 8  # exact vectors read per query between two looks at the bounds


def integer_vector(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, or null where a component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("long")))


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """``v, ids``: distinct vectors with their k + 1 smallest ids, each up to k times. ``vectors`` has ``id, v``."""
    counted = vectors.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = counted.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct("id", "n")))
    return few.groupBy("v").agg(F.flatten(F.transform(ids, lambda x: F.array_repeat(x["id"], x["n"]))).alias("ids"))


def _packed(rows: DataFrame, size: int, cells: dict[int, tuple[np.ndarray, np.ndarray]] | None) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length: ids, exact components and, with ``cells``, approximations."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            ids = batch.column("ids").to_pylist()
            out: dict[str, list] = {n: [] for n in ("dim", "n", "exact", "codes", "ids")}
            for dim in np.unique(lengths):
                of = np.flatnonzero(lengths == dim)
                for first in range(0, len(of), size):
                    part = of[first:first + size]
                    exact = flat[starts[part][:, None] + np.arange(dim)].astype(np.int64)
                    out["dim"].append(int(dim))
                    out["n"].append(len(part))
                    out["exact"].append(exact.tobytes())
                    out["codes"].append(_codes(exact, *cells[int(dim)]).tobytes() if cells is not None else b"")
                    out["ids"].append([ids[i] for i in part])
            yield pa.RecordBatch.from_arrays([
                pa.array(out["dim"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["exact"], pa.binary()),
                pa.array(out["codes"], pa.binary()), pa.array(out["ids"], pa.list_(pa.list_(pa.int64())))], names=list(out))

    return rows.select("ids", "v").mapInArrow(run, "dim int, n int, exact binary, codes binary, ids array<array<bigint>>")


def _codes(exact: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return np.clip((exact - low) // width, 0, LEVELS - 1).astype(np.uint8)


def _bounds(queries: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the scores of every query with every vector of a block.

    A cell holds the integers from ``low + code * width`` on, ``width`` many. The small allowance covers
    rounding in floating point, so the bounds are safe.
    """
    q = queries.astype(np.float64)
    base = q @ (low[:, None].astype(np.float64) + width[:, None] * codes.T.astype(np.float64))
    spread = (width - 1).astype(np.float64)
    up, down = np.maximum(q, 0) @ spread, np.minimum(q, 0) @ spread
    slack = 1e-9 * (np.abs(q) @ (np.abs(low) + width * float(LEVELS)).astype(np.float64)) + 1
    return base + (up + slack)[:, None], base + (down - slack)[:, None]


def _best_of_block(queries: np.ndarray, own: np.ndarray, exact: np.ndarray, codes: np.ndarray, ids: list, cells, k: int) -> list[tuple]:
    """(query row, score, id) of the k best of this block for each query, read in the order of upper bounds."""
    upper, lower = _bounds(queries, codes, *cells)
    found = []
    only = np.array([i[0] if i[0] == i[-1] else -1 for i in ids], np.int64)
    alone = np.array([i[0] == i[-1] for i in ids])
    lower = np.where(alone & (own[:, None] == only), -np.inf, lower)  # rows of the query's own id are no candidates
    some = min(k, upper.shape[1])
    floor_ = np.partition(lower, upper.shape[1] - some, axis=1)[:, upper.shape[1] - some]
    for r in range(len(queries)):
        if upper.shape[1] <= some:
            near = np.arange(upper.shape[1])
        else:
            near = np.flatnonzero(upper[r] >= floor_[r])
        near = near[np.argsort(-upper[r][near], kind="stable")]
        best: list[tuple[int, int]] = []
        for first in range(0, len(near), ROUND):
            # Certain once the k-th exact score is above every bound still unread.
            if len(best) >= k and -best[k - 1][0] > upper[r][near[first]]:
                break
            read = near[first:first + ROUND]
            scores = exact[read] @ queries[r]
            best += [(-int(s), i) for s, j in zip(scores, read) for i in ids[j] if i != own[r]]
            best = sorted(best)[:k]
        found += [(r, -s, i) for s, i in best]
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` holds, against all other rows.

    ``vectors`` has ``id`` (long) and ``v`` (array of long); rows with a null ``v`` or ``id`` take no part.
    """
    clean = staged(vectors.where("id is not null and v is not null").select("id", "v"), "vectors")
    distinct = staged(distinct_vectors(clean, k), "distinct-vectors")
    # Cells by component: least value and width. One row per length and component.
    ranges = distinct.select(F.size("v").alias("dim"), F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    cells: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.zeros(0, np.int64), np.ones(0, np.int64))}
    for dim in {r.dim for r in ranges}:
        own = sorted((r.at, r.lo, r.hi) for r in ranges if r.dim == dim)
        low = np.array([x[1] for x in own], np.int64)
        high = np.array([x[2] for x in own], np.int64)
        cells[dim] = (low, (high - low) // LEVELS + 1)
    files = staged(_packed(distinct, block, cells).withColumn("block", F.monotonically_increasing_id()), "va-file")
    asked = clean.where(is_query).select(F.array("id").alias("ids"), "v")
    queries = staged(_packed(asked.coalesce(max(1, asked.count() // (query_block * 8))), query_block, None).withColumn("q", F.monotonically_increasing_id()), "va-queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {n: batch.column(n)[row] for n in batch.schema.names}
                dim, n, nq = x["dim"].as_py(), x["n"].as_py(), x["qn"].as_py()
                exact = np.frombuffer(x["exact"].as_buffer(), np.int64).reshape(n, dim)
                codes = np.frombuffer(x["codes"].as_buffer(), np.uint8).reshape(n, dim)
                asked_for = np.frombuffer(x["qexact"].as_buffer(), np.int64).reshape(nq, dim)
                own = np.array([i[0] for i in x["qids"].as_py()], np.int64)
                best = _best_of_block(asked_for, own, exact, codes, x["ids"].as_py(), cells[dim], k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own[[b[0] for b in best]] if best else [], pa.int64()), pa.array([b[1] for b in best], pa.int64()),
                    pa.array([b[2] for b in best], pa.int64())], names=["query_id", "score", "vec_id"])

    # Every block meets every block of queries of its length: an equi-join on (length, query block).
    numbers = queries.groupBy("dim").agg(F.collect_list("q").alias("qs"))
    work = files.join(numbers, "dim").withColumn("q", F.explode("qs")).drop("qs")
    asked_blocks = queries.select("q", F.col("n").alias("qn"), F.col("exact").alias("qexact"), F.col("ids").alias("qids"))
    met = work.join(asked_blocks, "q").select("dim", "n", "exact", "codes", "ids", "qn", "qexact", "qids")
    found = met.mapInArrow(run, "query_id bigint, score bigint, vec_id bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
