"""User columns of any name stay as they are; the work of decontamination grows with the length of a text."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tillcast.llm import decontaminate, langid, mixing, secrets_scan, url_filter
from tillcast.llm.queries import URL_RULES

NAMES = ["_row", "row", "_use", "use", "src", "of_block", "_rule", "fits", "_judged", "judged", "_key", "h", "n"]


def with_names(df):
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def kept(rows):
    return all(tuple(r[n] for n in NAMES) == tuple(range(len(NAMES))) for r in rows)


def test_mix_urls_languages_and_secrets(spark):
    docs = with_names(spark.createDataFrame([(i, "the word of it " * 5, f"s{i % 3}", "en") for i in range(30)], "doc_id long, text string, source string, lang string"))
    mixed = mixing.mix(docs, repetition_limit=2.0).collect()
    assert len(mixed) >= 30 and kept(mixed)
    pages = with_names(spark.createDataFrame([(1, "http://a.example.com/de/x"), (2, None)], "page_id long, url string"))
    listed = spark.createDataFrame([("b.org",)], "host string")
    judged = url_filter.judge_urls(pages, URL_RULES, listed).collect()
    assert len(judged) == 2 and kept(judged)
    named = langid.identify(docs, langid.fit(docs)).collect()
    assert len(named) == 30 and kept(named)
    found = secrets_scan.find_secrets(docs.withColumn("Secrets", F.lit("mine")))
    assert [c.lower() for c in found.columns].count("secrets") == 1 and kept(found.collect())
    assert secrets_scan.find_secrets(docs.limit(0)).count() == 0


def test_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(i, "the word of it" if i % 2 else "das wort und die", "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "½ ² Ⅻ"), (2, "Ⅻ the word")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, langid.fit(docs)).collect()}
    assert got == {1: "und", 2: "en"}


def test_long_texts_and_chunks_of_windows(spark, tmp_path):
    passage = " ".join(f"b{i}" for i in range(40))
    bench = spark.createDataFrame([(1, passage), (2, "short item"), (3, " ".join(f"c{i}" for i in range(20)))], "item_id long, text string")
    filler = " ".join(f"w{i % 5000}" for i in range(150_000))
    rows = [(1, f"{filler} {passage} {filler}"), (2, passage), (3, "a short item here"), (4, None), (2, passage)]
    with_names(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    start = time.monotonic()
    for most in (64 << 20, 1500):  # one broadcast, and several
        got = sorted((r.doc_id, r.n_words, len(r.hit_words), tuple(r["items"]), r.contaminated) for r in
                     decontaminate.contamination(docs, bench, max_broadcast_bytes=most).collect())
        assert got == [(1, 300_040, 40, ("1",), False), (2, 40, 40, ("1",), True), (2, 40, 40, ("1",), True), (3, 4, 2, ("2",), True), (4, 0, 0, (), False)]
    assert time.monotonic() - start < 120
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 4] and kept(left.collect())
