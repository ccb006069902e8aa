"""Answers in JSON without nulls, against a recursive version."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changeloom.functions.texts import drop_nulls
from changeloom.operators import decisions

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.text(st.sampled_from('a":,{}[]\\n \n\tull'), max_size=8),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(st.sampled_from('a":null\\,}'), max_size=4), inner, max_size=4),
    max_leaves=12,
)


def without(v):
    if isinstance(v, dict):
        return {k: without(x) for k, x in v.items() if x is not None}
    return [without(x) for x in v] if isinstance(v, list) else v


def dropped(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["d"] for r in rows.select("i", drop_nulls(F.col("t")).alias("d")).orderBy("i").collect()]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(answers=st.lists(st.dictionaries(st.sampled_from(["a", "null", 'x":null', "b"]), VALUES, min_size=1, max_size=4), min_size=30, max_size=60))
def test_nulls_at_any_depth(spark, answers):
    got = dropped(spark, [f"so: {json.dumps(a, indent=i % 3 or None)} done" for i, a in enumerate(answers)])
    assert [json.loads(g) for g in got] == [without(a) for a in answers]


def test_defined_cases(spark):
    long = {"a": "\\\"x" * 100_000, "b": None, "c": [None, {"d": None}]}
    deep = '{"n":null,"a":' * 50 + "1" + "}" * 50
    texts = [None, "", "no answer", '{"a": 1', '{"a": null}', '{"a": 1, "a": 2}', json.dumps(long), deep]
    got = dropped(spark, texts)
    assert got[:6] == [None, None, None, None, "{}", None] and json.loads(got[6]) == without(long) and json.loads(got[7]) == without(json.loads(deep))


def test_a_decision_with_nulls(spark):
    answer = '{"bucket": "skim", "change_kind": "test", "confidence": 0.7, "reason": "x", "risk_signals": null, "more": {"n": null}}'
    got = spark.createDataFrame([(answer,)], "a string").select(decisions.decode_decision(F.col("a")).alias("d")).first()["d"]
    assert got["ok"] and got["bucket"] == "skim" and got["risk_signals"] == []
