from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as contract
from tillcast.llm import langid
from tillcast.llm.decontaminate import contamination
from tillcast.llm.tables import read, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_their_own_input(spark, sf_small):
    docs = read(spark, sf_small, "documents")
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        outputs[name] = (docs, docs := staged(stage(spark, docs, sf_small), f"test-{name}"))
        assert docs.columns[:5] == COLUMNS and (name == "sharding" or docs.columns == COLUMNS)

    before, after = outputs["language_id"]
    judged = langid.identify(before, langid.fit(before))
    assert after.count() == judged.where("lang_pred <> 'und' and score >= 0.5").count()

    before, after = outputs["near_duplicates"]
    texts = [r.text for r in after.collect()]
    assert len(texts) == len(set(texts)) == before.select("text").distinct().count() - (before.select("text").distinct().count() - len(texts))
    first = {}
    for r in before.collect():
        first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
    assert {r.doc_id for r in after.collect()} <= set(first.values())

    before, after = outputs["decontamination"]
    bad = {r.doc_id for r in contamination(before, read(spark, sf_small, "benchmark")).where("contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad

    before, after = outputs["mixing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}

    before, after = outputs["sharding"]
    assert after.count() == before.count() and after.groupBy("shard", "slot").count().where("count > 1").count() == 0


def test_stages_take_odd_tables(spark, sf_small):
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (None, "the thing was of the", None, "s", 3), (3, "the thing was of the", "en", "s", 3),
            (3, "the thing was of the", "en", "s", 3)]
    odd = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, SHARD int, fp string")
    for docs in (staged(odd, "odd"), staged(odd.limit(0), "none")):
        for name, stage in corpus_pipeline.STAGES:
            assert staged(stage(spark, docs, sf_small), f"odd-{name}").count() >= 0


def test_every_query_is_registered():
    names = list(contract.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
