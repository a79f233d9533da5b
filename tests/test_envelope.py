from __future__ import annotations

import json

from pyspark.sql import functions as F

from tillcast.operators import envelope


def test_defaults_and_status(spark):
    df = spark.createDataFrame(
        [(1, None, None, None), (2, ["e"], ["w"], {"a": "1"})],
        "i int, errors array<string>, warnings array<string>, metrics map<string,string>",
    )
    rows = envelope.with_status(df).orderBy("i").collect()
    assert (rows[0].errors, rows[0].warnings, rows[0].metrics, rows[0].status) == ([], [], {}, "ok")
    assert (rows[1].errors, rows[1].metrics, rows[1].status) == (["e"], {"a": "1"}, "error")


def test_demotion_only_where_asked(spark):
    df = spark.createDataFrame(
        [("gpt_insight", ["e1", "e2"], None), ("other", ["e"], ["w"])],
        "step string, errors array<string>, warnings array<string>",
    )
    rows = {r.step: r for r in envelope.demote_errors(df, F.col("step") == "gpt_insight").collect()}
    assert rows["gpt_insight"].errors == [] and rows["gpt_insight"].status == "ok"
    assert rows["gpt_insight"].warnings == ["UpstreamError: e1", "UpstreamError: e2"]
    assert (rows["other"].errors, rows["other"].warnings, rows["other"].status) == (["e"], ["w"], "error")


CASES = [
    # raw, data, errors, warnings, metrics
    ({"data": {"a": 1}, "x": 2, "errors": []}, {"a": 1}, [], [], {}),
    ({"a": 1, "b": {"c": [1]}, "status": "s", "step": "t", "errors": None}, {"a": 1, "b": {"c": [1]}}, [], [], {}),
    ({"data": None, "a": 1}, {"a": 1}, [], [], {}),
    ({"data": [1, 2], "errors": "boom", "warnings": {"m": 1}, "metrics": {"k": 1}}, [1, 2], ["boom"], [{"m": 1}], {"k": 1}),
    ({"errors": [1, {"t": 2}], "metrics": [1]}, {}, [1, {"t": 2}], [], {}),
    ([1, 2], {"value": [1, 2]}, [], [], {}),
    (5, {"value": 5}, [], [], {}),
    (None, {"value": None}, [], [], {}),
]


def test_coerce_output(spark):
    rows = [(i, json.dumps(c[0])) for i, c in enumerate(CASES)] + [(99, 'not "json"')]
    got = {r.i: r for r in envelope.coerce_output(spark.createDataFrame(rows, "i int, raw_json string")).collect()}
    for i, (_, data, errors, warnings, metrics) in enumerate(CASES):
        r = got[i]
        assert json.loads(r.data_json) == data, i
        assert [json.loads(e) for e in r.errors] == errors and [json.loads(w) for w in r.warnings] == warnings
        assert json.loads(r.metrics_json) == metrics
        assert r.status == ("error" if errors else "ok")
    assert json.loads(got[99].data_json) == {"value": 'not "json"'}
