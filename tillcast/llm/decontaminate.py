"""Benchmark decontamination with DataFrame functions only.

Benchmark texts become windows of n consecutive words (an item with fewer words is one window). Their
hashes are broadcast as a hash relation, behind a check of its size; a larger benchmark is cut into chunks
of that size and the documents are scanned once per chunk. Every window of every document is looked up;
a hit counts only if the words themselves are equal. Windows are never shuffled: what leaves a scan is one
row per document and one per hit, so a frequent passage costs as many rows as it has occurrences.

Words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters. Null and empty texts have
no words and no hits. Repeated rows are judged each. An item without words has no window; one without an
id has windows that hit, but is not named. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.tables import ascii_lower, free_name, staged, with_row_id

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# What one broadcast of windows may take.
MAX_BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    parts = F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Distinct windows: ``h, length, window`` (words) and the ``items`` (ids as text) that have them."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    window = F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("window")
    return (words.select("item", window).groupBy("window").agg(F.collect_set("item").alias("items"))
            .select(F.xxhash64("window").alias("h"), F.size("window").alias("length"), "window", "items"))


def _candidates(rows: DataFrame, windows: DataFrame, lengths: list[int], keep_all: bool) -> DataFrame:
    """``row, id, start, length, window, items`` where a hash is met and, with ``keep_all``, per document a row whose ``start`` is its number of words.

    A row has a hash and a place, never the words, so the work grows with the length of a text.
    """
    def hashes(w: Column, n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1),
                           lambda i: F.struct(F.xxhash64(F.slice(w, i, n)).alias("h"), i.alias("start"), F.lit(n).alias("length")))
        return F.when(F.size(w) >= n, some).otherwise(F.array().cast("array<struct<h:bigint,start:int,length:int>>"))

    def elements(w: Column) -> Column:
        none = F.lit(None)
        whole = F.array(F.struct(none.cast("bigint").alias("h"), F.size(w).alias("start"), none.cast("int").alias("length")))
        return F.concat(*[hashes(w, n) for n in lengths], whole)

    grams = rows.select("row", "id", F.explode(F.transform(F.array(words_of(F.col("text"))), elements)[0]).alias("x")).select("row", "id", "x.*")
    met = grams.join(F.broadcast(windows), ["h", "length"], "left" if keep_all else "inner")
    return met.where("h is null or window is not null").select("row", "id", "start", "length", "window", "items")


def _verified(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """``row, hit, items`` of the candidates whose words are those of the window; only documents with some are read again."""
    each = staged(candidates.groupBy("row").agg(F.collect_list(F.struct("start", "length", "window", "items")).alias("found")), "benchmark-candidates")
    words = F.flatten(F.transform("found", lambda c: c["window"]))
    size = each.agg(F.sum(64 + 8 * F.size(words) + F.octet_length(F.array_join(words, "")))).first()[0] or 0
    if size <= MAX_BROADCAST_BYTES // 2:
        each = F.broadcast(each)
    true = F.transform(F.array(words_of(F.col("text"))), lambda w: F.filter("found", lambda c: F.slice(w, c["start"], c["length"]) == c["window"]))[0]
    hits = rows.select("row", "text").join(each, "row").select("row", F.explode(true).alias("x"))
    return hits.select("row", F.struct("x.start", "x.length").alias("hit"), "x.items")


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, doc_id: str = "doc_id", text: str = "text",
                  max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, hit_words`` (places from 0), ``items``, ``contaminated``.

    Contaminated: some word is inside a window, and these words are at least a twentieth of all. Long texts are
    read whole; other columns are not read.
    """
    windows = staged(benchmark_windows(benchmark, n), "benchmark-windows")
    facts = windows.agg(F.collect_set("length").alias("lengths"),
                        F.sum(64 + 2 * F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " "))).alias("bytes")).first()
    lengths = sorted(facts.lengths) or [n]
    chunks = max(1, math.ceil((facts.bytes or 0) / max_broadcast_bytes))
    row = free_name(docs, "row")
    rows = with_row_id(docs, row).select(F.col(row).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    found = None
    for i in range(chunks):
        part = windows if chunks == 1 else windows.where(F.pmod("h", F.lit(chunks)) == i)
        met = _candidates(rows, part, lengths, keep_all=i == 0)
        found = met if found is None else found.union(met)
    found = staged(found, "benchmark-found")
    hits = _verified(rows, found.where("window is not null"))
    every = found.where("window is null").select("row", "id", F.col("start").alias("n_words")).unionByName(hits, allowMissingColumns=True)
    grouped = every.groupBy("row").agg(
        F.any_value("id", ignoreNulls=True).alias("doc_id"), F.max("n_words").cast("long").alias("n_words"),
        F.collect_set("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    places = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"] - 1, x["start"] + x["length"] - 2))))
    n_hit = F.size("hit_words")
    return grouped.select("doc_id", "n_words", places.alias("hit_words"), "items").withColumn(
        "contaminated", (n_hit > 0) & (n_hit * 20 >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 13) -> DataFrame:
    """``docs`` without contaminated documents; every other row and all columns stay."""
    texts = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("key"), "text")
    bad = contamination(texts, benchmark, n=n, doc_id="key").where("contaminated").select("doc_id.*").distinct()
    h = F.xxhash64(docs["text"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id"]) & (h == bad["h"]), "left_anti")


def cut_hits(text: Column, hit_words: Column) -> Column:
    """``text`` without the words at ``hit_words`` (places from 0); all separators stay."""
    parts = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|" + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    first_is_word = text.rlike(r"\A[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    shift = F.when(first_is_word, 0).otherwise(1)
    kept = F.filter(parts, lambda p, i: ((i + shift) % 2 == 1) | ~F.array_contains(hit_words, ((i - shift) / 2).cast("int")))
    return F.when(F.size(hit_words) == 0, text).otherwise(F.array_join(kept, ""))
