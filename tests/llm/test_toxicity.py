from __future__ import annotations

import itertools

import numpy as np
import pytest

from tillcast.llm import toxicity
from tillcast.llm.queries import op8_toxicity


@pytest.fixture(scope="module")
def model():
    text = "the quick stupid idiot went to the market with a worthless clown and saw the sea " * 50
    return toxicity.CharacterModel(toxicity._grams(text))


def test_viterbi_finds_the_best_path(model):
    for token in ("stup1d", "$tupid", "id!ot", "w0rthl3ss", "clo0wn"):
        lattice = toxicity.lattice_of(token)

        def value(path):
            a = b = c = 0
            total = sum(cost for _, cost in path)
            for letter in "".join(p for p, _ in path) + " ":
                d = int(toxicity.classes_of(letter)[0])
                total += float(model.log[a, b, c, d])
                a, b, c = b, c, d
            return total

        best = max(itertools.product(*lattice), key=value)
        assert model.best_reading(lattice) == "".join(p for p, _ in best)


@pytest.mark.parametrize("token,word", [
    ("stup1d", "stupid"), ("1d10t", "idiot"), ("stuuuupid", "stupid"), ("c.l.o.w.n", "clown"), ("w0rthle$$", "worthless"),
    ("stupid", "stupid"), ("stupid!!", "stupid"), ("(idiot),", "idiot"), ("st*pid", "stupid")])
def test_restored_words(model, token, word):
    assert word in toxicity.Restorer(model).words(token)


def test_spaced_words(model):
    assert toxicity.SPACED.findall("you s t u p i d thing") == ["s t u p i d"]
    assert "stupid" in toxicity.Restorer(model).spaced("s t u p i d")


def test_spaced_words_are_read_to_the_end(model):
    run = " ".join("thequickmarketandthesea" * 40 + "stupid")
    words = toxicity.Restorer(model).spaced(run)
    assert "".join(words[:-1]) == run.replace(" ", "") and words[-2].endswith("stupid")


@pytest.mark.parametrize("text", ["you i d i o t.", '"i d i o t"', "i  d\ti d  i  o\tt", "so i d i o t!!"])
def test_spaced_words_with_punctuation_and_wide_blanks(model, text):
    assert any("idiot" in w for w in toxicity.Restorer(model).in_context(text))


@pytest.mark.parametrize("token,word", [("s/t/u/p/i/d", "stupid"), ("c,l,o,w,n", "clown"), ("stu" + 70 * "u" + "pid", "stupid"), ("stup1d" * 20, "stupid" * 20)])
def test_separators_and_long_tokens(model, token, word):
    assert word in toxicity.Restorer(model).words(token)


def test_tokens_of_signs_only():
    model = toxicity.CharacterModel(toxicity._grams("what an ass and a bigot was at sea " * 50))
    scorer = toxicity.Scorer(model, {"ass": 3.0, "bigot": 3.0}, 1.0, 0.0)
    assert scorer.evidence("an @$$") == scorer.evidence("a 81607") == 3.0 and scorer.evidence("in 2024") == 0.0


def test_plain_tokens_are_left(model):
    r = toxicity.Restorer(model)
    assert r.words("sea") == ("sea",) and r.words("2024") == () and r.words("...") == ()


def test_held_out_quality(spark, sf_oracle):
    labels = spark.read.parquet(f"{sf_oracle}/labels.parquet")
    rows = op8_toxicity(spark, sf_oracle).join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf_oracle}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.toxic is not None]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("you stupid thing " if i % 2 else "you lovely thing ") + f"number{i}", 1) for i in range(200)], "doc_id long, text string, SCORE int")
    texts = docs.select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    before = [f"word{i}" for i in range(200)]
    varied = spark.createDataFrame([(i, f"{before[i]} " + ("stupid" if i % 2 else "lovely")) for i in range(200)], "doc_id long, text string")
    scorer = toxicity.fit(varied, labels)
    rows = [(1, "stupid"), (2, None), (3, ""), (4, "st*pid"), (4, "so s t u p i d"), (5, "lovely " * 50_000)]
    got = toxicity.score_texts(spark.createDataFrame([(*r, 9) for r in rows], docs.schema), scorer)
    assert got.columns == ["doc_id", "text", "score"]
    scores = [r.score for r in got.collect()]
    assert scores[0] > 0.7 and scores[3] > 0.7 and scores[4] > 0.7 and scores[1] == scores[2] == scores[5] < 0.3
    none = toxicity.fit(texts, labels.where("toxic = 1"))
    assert {r.score for r in toxicity.score_texts(texts.limit(3), none).collect()} == {0.0}
    assert toxicity.score_texts(texts.limit(0), scorer).count() == 0


def test_grams_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([("abé",), (None,), ("",), ("abé",)], "text string")
    counts = {r.gram: r.n for r in toxicity.gram_counts(docs).collect()}
    n = toxicity.CLASSES
    assert counts[((0 * n + 1) * n + 2) * n + 5] == 2 and sum(counts.values()) == 8
    assert np.isclose(np.exp(toxicity.CharacterModel(np.zeros(n**4, np.int64)).log).sum(axis=-1), 1).all()
