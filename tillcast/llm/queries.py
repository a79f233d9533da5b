"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.decontaminate import contamination
from tillcast.llm import collocations, divergence, langid, pii, quality, toxicity
from tillcast.llm.mixing import mix
from tillcast.llm.secrets_scan import find_secrets
from tillcast.llm.sharding import shard_rows
from tillcast.llm.simhash import hex_of, near_duplicates
from tillcast.llm.tables import held_out, read, staged
from tillcast.llm.topk import integer_vector, top_k
from tillcast.llm.url_filter import host_of, judge_urls

Query = Callable[[SparkSession, str], DataFrame]

# The rules of the page query.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# The site names on the page query's list; every host of such a site is listed.
LISTED_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(base: Column, spans: Column, kinds: list[str]) -> list[Column]:
    """Counts of the base kinds, the hash of their spans, and all spans."""
    def of(kind: str) -> Column:
        return F.filter(base, lambda s: s["kind"] == kind)

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    return [*counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans")]


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(read(spark, sf, "documents")).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    sharded = shard_rows(docs, 16, key_columns=["doc_id", "text"])
    return sharded.select(
        "doc_id", "size", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    judged = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), integer_vector(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("id") % 50 == 0, 5)


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix(read(spark, sf, "documents").select("doc_id", "source", "text"), repetition_limit=2.0)
    return mixed.select("doc_id", "source", "epoch", "block", "block_rank", F.round("weight", 9).alias("weight"), F.round("alpha", 6).alias("alpha"))


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    site = F.element_at(F.split("host", r"\."), -3)
    listed = hosts.where(F.size(F.split("host", r"\.")) >= 3).where(site.isin(*LISTED_SITES))
    return judge_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score_texts(docs, toxicity.fit(docs, read(spark, sf, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = find_secrets(read(spark, sf, "documents").select("doc_id", "text")).drop("text")
    kinds = ["assign", "access", "hex"]
    base = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *span_digest(base, F.col("secrets"), kinds))


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.fit(docs)).drop("text")
    base = F.filter("personal", lambda s: s["base"])
    return found.select("doc_id", *span_digest(base, F.col("personal"), ["email", "ip", "card", "phone"]))


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(read(spark, sf, "documents"))


def op12_divergence(spark: SparkSession, sf: str) -> DataFrame:
    audit = divergence.Audit(read(spark, sf, "documents"), top=200)
    pairs = divergence.ranked(audit.pairs().withColumnRenamed("other", "item"), "item")
    terms = divergence.ranked(audit.terms().withColumnRenamed("term", "item"), "item", 200)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).union(terms.withColumn("part", F.lit("term")).select(columns))


def op13_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    # Measured once: the cutoffs are chosen on these rows, and then applied to them.
    measured = staged(quality.measure(read(spark, sf, "documents").select("doc_id", "lang", "text")).drop("text"), "quality-measures")
    judged = quality.judge(measured, quality.fit(measured, read(spark, sf, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_top_k": op5_top_k,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_pii": op10_pii,
    "op11_collocations": op11_collocations,
    "op12_divergence": op12_divergence,
    "op13_quality_rules": op13_quality_rules,
}

