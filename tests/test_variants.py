"""Strict parsing in the JVM against strict parsing in Python."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.errors import InvalidJson, UnexpectedSchema
from tessera.functions import variants
from tessera.operators import completions

ONE = '{"question":"Q","answer":"A"}'
ITEMS = [
    "", "  ", "no", "1", "null", '"x"', "{}", "[]", '{"items":[]}', '{"questions":[]}', '{"items":null,"questions":[]}', '{"items":{},"questions":[]}', f'{{"items":[{ONE}],"questions":7}}', f"[{ONE}, {ONE}]", f"[{ONE}, 3]", f"[{ONE}, null]",
    f"text ```json\n[{ONE}]\n``` more", f"```\n[{ONE}]", f"[{ONE}", f"[{ONE}] x", '[{"question":"Q"}]', '[{"question":null,"answer":"A"}]', '[{"question":1,"answer":"A"}]', '[{"question":"Q","answer":["A"]}]', '[{"question":"Q","answer":"A","tags":null}]',
    '[{"question":"Q","answer":"A","tags":"t"}]', '[{"question":"Q","answer":"A","tags":[]}]', '[{"question":"Q","answer":"A","tags":["t","u"]}]', '[{"question":"Q","answer":"A","tags":["t",1]}]', '[{"question":"Q","answer":"A","tags":["t",null]}]',
    '[{"question":"Q","answer":"A","confidence":null}]', '[{"question":"Q","answer":"A","confidence":1}]', '[{"question":"Q","answer":"A","confidence":-0.25}]', '[{"question":"Q","answer":"A","confidence":1e3}]', '[{"question":"Q","answer":"A","confidence":"1"}]', '[{"question":"Q","answer":"A","confidence":true}]',
    '[{"question":"Q","answer":"A","confidence":NaN}]', '[{"question":"Qé\\n\\"\\u4e2d","answer":"","more":{"a":[1,{"b":null}]}}]', '[{"question":"2024-01-01","answer":"2024-01-01T00:00:00Z","confidence":0.1234567890123456789}]',
]


def check(passed=True, reason="r"):
    return {"passed": passed, "reason": reason}


GOOD = {"grounded": check(), "self_contained": check(False), "answer_relevant": check(reason=" x ")}
DECISIONS = [
    "", "[]", "{", "3", json.dumps(GOOD), json.dumps(GOOD | {"evidence": None}), json.dumps(GOOD | {"evidence": "seen"}), json.dumps(GOOD | {"evidence": "  "}), json.dumps(GOOD | {"evidence": 1}), json.dumps(GOOD | {"grounded": 1}), json.dumps(GOOD | {"grounded": None}),
    json.dumps(GOOD | {"grounded": {"passed": "true", "reason": "r"}}), json.dumps(GOOD | {"grounded": {"passed": 1, "reason": "r"}}), json.dumps(GOOD | {"grounded": {"passed": True}}), json.dumps(GOOD | {"grounded": check(reason=" \n")}), json.dumps(GOOD | {"grounded": check(reason=None)}),
    json.dumps({"grounded": check()}), json.dumps(GOOD | {"more": [GOOD]}), "Sure: ```json\n" + json.dumps(GOOD) + "```",
]


def outcome(parse, completion):
    try:
        return "ok", parse(completion)
    except InvalidJson:
        return "invalid_json", None
    except UnexpectedSchema:
        return "unexpected_schema", None


@pytest.mark.parametrize("given, column, parse", [(ITEMS, variants.questions, completions.parse_questions), (DECISIONS, variants.decision, completions.parse_decision)])
def test_both_ways_agree(spark, given, column, parse):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(given)], "k int, c string").select("k", column(F.col("c")).alias("r")).select("k", "r.outcome", F.to_json("r.value", {"ignoreNullFields": "false"}).alias("value"))
    got = {r.k: (r.outcome, json.loads(r.value) if r.value else None) for r in rows.collect()}
    for k, completion in enumerate(given):
        name, value = outcome(parse, completion)
        assert got[k][0] == name, completion
        if isinstance(value, list):
            assert [{**x, "confidence": None} for x in got[k][1]] == [{**x, "confidence": None} for x in value]
            assert [x["confidence"] for x in got[k][1]] == pytest.approx([x["confidence"] for x in value])
        else:
            assert got[k][1] == value
    assert {o for o, _ in got.values()} == {"ok", "invalid_json", "unexpected_schema"}
