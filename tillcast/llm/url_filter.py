"""URL filter: host and path rules, and a Bloom filter cascade for listed hosts. DataFrame functions only.

A cascade answers exact membership for every key of a known universe. Level 1 holds the listed keys; level
2 the unlisted keys that level 1 lets through by mistake; level 3 the listed keys that level 2 lets
through; and so on until nobody is let through by mistake. A key is listed if the first level that refuses
it is an even one. Rows are judged by a few hash probes into arrays, with no join to the list.

Null and malformed urls have empty host and path and are judged like any other key. Several rows with one
url get one verdict each. An empty page table gives an empty result, an empty list lists nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.tables import ascii_lower, free_name, staged

# Bits of one level that may be shipped with the plan (8 MB). A list that needs more is cut into
# segments by hash, and rows meet their segment in an equi-join.
MAX_FILTER_BITS = 1 << 26


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after_scheme(url), "/", 1)).otherwise("")
    return F.coalesce(ascii_lower(F.substring_index(F.substring_index(rest, "?", 1), "#", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    plain = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    slash = F.instr(plain, "/")
    has = (F.instr(url, "://") > 0) & (slash > 0)
    return F.coalesce(F.when(has, F.substr(plain, slash)).otherwise(""), F.lit(""))


def _after_scheme(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule ``(host, path, verdict)`` as a struct, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"),
                                      F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


class Cascade:
    """An exact membership filter over ``universe``: distinct keys with a boolean column ``listed``."""

    def __init__(self, universe: DataFrame, key: str = "key", listed: str = "listed",
                 max_bits: int = MAX_FILTER_BITS):
        self.universe = staged(universe.select(F.col(key).alias("key"), F.col(listed).alias("listed"))
                               .where("key is not null"), "url-universe")
        self.levels: list[tuple[int, int, int, DataFrame]] = []
        counts = self.universe.agg(F.count_if("listed").alias("r"), F.count_if(~F.col("listed")).alias("s")).first()
        n_in, n_out, keep_in = counts.r, counts.s, True
        # The first level refuses most of the unlisted keys, later ones half of what is left.
        rate = min(0.5, n_in / (math.sqrt(2) * n_out)) if n_in and n_out else 0.5
        self.segments = max(1, math.ceil(_bits(n_in, rate) / max_bits))
        while n_in:
            self._add(n_in, rate, keep_in)
            wrong = self.universe.where(F.col("listed") != F.lit(keep_in))
            n_out = self._passing(wrong, keep_in).count()
            n_in, rate, keep_in = n_out, 0.5, not keep_in

    def _add(self, n: int, rate: float, keep_in: bool) -> None:
        level, hashes = len(self.levels), max(1, round(-math.log2(rate)))
        words = max(1, math.ceil(_bits(n, rate) / 64 / self.segments))
        keys = self._passing(self.universe.where(F.col("listed") == F.lit(keep_in)), not keep_in)
        at = F.explode(F.array(*_positions(F.col("key"), level, hashes, words))).alias("at")
        every = self.universe.sparkSession.range(self.segments * words).select(
            F.expr(f"cast(id div {words} as int)").alias("segment"),
            F.expr(f"cast(id % {words} as int)").alias("word"), F.lit(0).cast("long").alias("bits"))
        filled = keys.select(_segment(F.col("key"), self.segments).alias("segment"), at).select(
            "segment", F.shiftright("at", 6).cast("int").alias("word"), _bit(F.col("at")).alias("bits"))
        # One row per segment: its words in order. Words without a key come from the range.
        table = (filled.union(every).groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
                 .groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))),
                                                     lambda x: x["bits"]).alias("bits")))
        self.levels.append((level, hashes, words, staged(table, f"url-level{level}")))

    def _passing(self, keys: DataFrame, listed_levels: bool) -> DataFrame:
        """Keys that every level of one kind lets through (True: levels 1, 3, ..., False: levels 2, 4, ...)."""
        kind = [x for x in self.levels if (x[0] % 2 == 0) == listed_levels]
        for number, hashes, words, table in kind:
            keys, bits = self._with_bits(keys, number, table)
            keys = keys.where(_has(bits, F.col("key"), number, hashes, words)).select("key", "listed")
        return keys

    def _with_bits(self, rows: DataFrame, number: int, table: DataFrame, key: str = "key"):
        if self.segments == 1:
            return rows, table.select("bits").scalar()
        name = f"_bits{number}"
        rows = rows.withColumn("_segment", _segment(F.col(key), self.segments))
        joined = rows.join(table.select(F.col("segment").alias("_segment"), F.col("bits").alias(name)), "_segment", "left")
        return joined.drop("_segment"), F.col(name)

    def mark(self, rows: DataFrame, key: str, out: str) -> DataFrame:
        """``rows`` with a boolean column ``out``: is the key listed? Null keys are not."""
        columns = list(rows.columns)
        answer = F.lit(bool(len(self.levels) % 2))
        steps = []
        for number, hashes, words, table in self.levels:
            rows, bits = self._with_bits(rows, number, table, key)
            steps.append((number, _has(bits, F.col(key), number, hashes, words)))
        for number, has in reversed(steps):
            answer = F.when(~has, F.lit(number % 2 == 1)).otherwise(answer)
        return rows.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(answer & F.col(key).isNotNull(), F.lit(False)).alias(out))


def _bits(n: int, rate: float) -> float:
    return n * math.log2(1 / rate) / math.log(2)


def _segment(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("segment")), F.lit(segments)).cast("int")


def _positions(key: Column, level: int, hashes: int, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(64 * words)) for i in range(hashes)]


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def _has(bits: Column, key: Column, level: int, hashes: int, words: int) -> Column:
    tests = [bits[F.shiftright(at, 6).cast("int")].bitwiseAND(_bit(at)) != 0
             for at in _positions(key, level, hashes, words)]
    every = tests[0]
    for test in tests[1:]:
        every = every & test
    return every


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame,
               max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``pages`` with ``host, path, rule, listed, verdict``.

    ``listed`` has one string column ``host``. The key universe is every distinct host of ``pages``. Columns called like
    a result, in any case, are replaced, all others are kept as they are; long urls and pages are carried whole.
    """
    own = ["host", "path", "rule", "listed", "verdict"]
    kept = [c for c in pages.columns if c.lower() not in own]
    parts = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = parts.select(F.col("host").alias("key")).distinct()
    on_list = listed.select(F.col("host").alias("key")).where("key is not null").distinct().withColumn("listed", F.lit(True))
    universe = hosts.join(on_list, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    marked = Cascade(universe, max_bits=max_bits).mark(parts, "host", "listed")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    fits = free_name(marked, "fits")
    return marked.withColumn(fits, rule).select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col(f"{fits}.rule").alias("rule"), "listed",
        F.coalesce(F.col(f"{fits}.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
