"""Decontamination, mixing and the URL filter: small cases, and the registered queries against SQL."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from oracle_check import compare, connect
from tillcast.llm import decontaminate, mixing, url_filter
from tillcast.llm.oracle import ORACLE
from tillcast.llm.queries import QUERIES, URL_RULES


@pytest.fixture(scope="module")
def duck(sf_oracle):
    con = connect(sf_oracle)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_oracle, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLE[name], sf_oracle) is None


@pytest.mark.parametrize("name", ["op3_decontamination", "op6_mixing", "op7_url_filter"])
def test_native_queries_run_no_python(spark, sf_small, name):
    plan = QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


DOCS = "doc_id long, text string, source string, TEXT_HASH string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], DOCS)


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_contamination_cases(spark):
    long_item = words(30, "q")
    bench = spark.createDataFrame([(1, long_item), (2, "Tiny item"), (3, None), (4, "..."), (None, words(13, "z"))], "item_id long, text string")
    rows = [
        (1, "x " + words(13, "q") + " y", "a"),                       # one window
        (2, words(12, "q"), "a"),                                      # one word short
        (3, "a tiny, ITEM b", "a"),                                    # the short item, other case and signs
        (4, words(400, "c") + " tiny item", "a"),                      # under a twentieth
        (5, None, "a"), (6, "", "a"), (7, "...", None),
        (8, words(20, "q") + " " + words(20, "q"), "a"), (8, words(20, "q") + " " + words(20, "q"), "a"),
        (None, "z0 " + words(13, "z"), "a"),
    ]
    found = decontaminate.contamination(docs_of(spark, rows), bench)
    got = sorted((r.doc_id or 0, r.n_words, len(r.hit_words), tuple(r["items"]), r.contaminated) for r in found.collect())
    assert got == sorted([
        (1, 15, 13, ("1",), True), (2, 12, 0, (), False), (3, 4, 2, ("2",), True), (4, 402, 2, ("2",), False),
        (5, 0, 0, (), False), (6, 0, 0, (), False), (7, 0, 0, (), False),
        (8, 40, 40, ("1",), True), (8, 40, 40, ("1",), True), (0, 14, 13, (), True)])
    kept = decontaminate.drop_contaminated(docs_of(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", "source", "TEXT_HASH"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7]
    chunked = decontaminate.contamination(docs_of(spark, rows), bench, max_broadcast_bytes=500)
    assert sorted((r.doc_id or 0, r.n_words, len(r.hit_words), tuple(r["items"]), r.contaminated) for r in chunked.collect()) == got


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs_of(spark, [(1, "a b", "s")]), none).first().contaminated is False
    assert decontaminate.contamination(docs_of(spark, []), none).count() == 0


def test_cut_hits(spark):
    df = spark.createDataFrame([("--A b, c! d", [1, 2]), ("a b", []), (None, []), ("Zé x", [0])], "t string, h array<int>")
    got = [r[0] for r in df.select(decontaminate.cut_hits(F.col("t"), F.col("h"))).collect()]
    assert got == ["--A , ! d", "a b", None, " x"]


def test_mixing_limit_and_entropy(spark):
    rows = [(i, words(10), "big") for i in range(900)] + [(1000 + i, words(10), "small") for i in range(90)] + [(2000, "a", None), (2001, None, "void")]
    docs = docs_of(spark, rows)
    mixed = mixing.mix(docs, repetition_limit=3.0).cache()
    uses = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(uses) == {r[0] for r in rows}  # no document is lost
    tokens = {r.source: r.t for r in mixed.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("t")).collect()}
    alpha = mixed.first().alpha
    smallest = 1 / 9901  # the null source has one token
    assert (9000 / 9901 / smallest) ** (1 - alpha) == pytest.approx(3.0, rel=1e-4)
    assert tokens["big"] == 9000 and tokens["small"] == pytest.approx(900 * (9000 / 900) ** (1 - alpha), rel=0.05)
    assert mixed.groupBy("source", "epoch").agg(F.countDistinct("block_rank").alias("r"), F.countDistinct("block").alias("b")).where("r <> b").count() == 0
    totals = spark.createDataFrame([(0.9,), (0.1,)], "p double")
    a = mixing.find_alpha(totals, target_entropy=0.6)
    w = [0.9 ** a, 0.1 ** a]
    w = [x / sum(w) for x in w]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.6, abs=1e-5)
    assert mixing.find_alpha(totals, target_entropy=5.0) == 0.0
    assert mixing.find_alpha(totals, repetition_limit=100.0) == 0.0


def test_mixing_of_empty_and_clashing_tables(spark):
    assert mixing.mix(docs_of(spark, []), repetition_limit=2.0).count() == 0
    clash = docs_of(spark, [(1, "a b", "s"), (1, "a b", "s")]).withColumn("Epoch", F.lit("old")).withColumn("weight", F.lit(1))
    got = mixing.mix(clash, repetition_limit=2.0)
    assert got.count() == 2 and got.first().epoch == 1


URLS = [
    ("https://a.example.net/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("HTTP://A.Example.NET/de/", "a.example.net", "/de/", "net/", "block"),
    ("x://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
    ("x://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ("x://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
    ("x://bad.org?u=/fr/", "bad.org", "", None, "block"),
    ("x://bad.org#/fr/?", "bad.org", "", None, "block"),
    ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("x://h/a://b", "h", "/a://b", None, "allow"),
]


@pytest.mark.parametrize("max_bits", [1 << 26, 64])
def test_urls(spark, max_bits):
    pages = spark.createDataFrame([(i, u[0], "old") for i, u in enumerate(URLS + URLS)], "page_id long, url string, HOST string")
    listed = spark.createDataFrame([("bad.org",), ("not.seen",), (None,)], "host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, URL_RULES, listed, max_bits).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS + URLS)}
    assert url_filter.judge_urls(pages.limit(0), URL_RULES, listed, max_bits).count() == 0


@pytest.mark.parametrize("listed", [0, 1, 700, 3000])
@pytest.mark.parametrize("max_bits", [1 << 26, 1024])
def test_cascade_is_exact_over_its_universe(spark, listed, max_bits):
    universe = spark.range(3000).select(F.concat(F.lit("key"), "id").alias("key"), (F.col("id") < listed).alias("listed"))
    cascade = url_filter.Cascade(universe, max_bits=max_bits)
    marked = cascade.mark(universe.withColumnRenamed("listed", "truth"), "key", "listed")
    assert marked.where("listed <> truth").count() == 0 and marked.count() == 3000
