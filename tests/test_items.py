import json
import math

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.errors import ApiError, InvalidJson, PromptError, UnexpectedSchema
from tessera.functions import text as T
from tessera.operators import completions, prompts, qa


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def item(spark, **changes):
    base = {"id": "i", "question": "q", "answer": "a", "source": ("p", 1, 2), "chunk_id": "c", "model": "m", "generated_at": "t", "tags": [], "confidence": None} | changes
    return tuple(base[n] for n in schemas.QA.fieldNames())


def test_normalize(spark):
    norm = lambda q: value(spark, T.normalize_question(F.lit(q)))
    assert norm("  What   IS X?  ") == norm("what is x") == "what is x"
    assert norm("What ?") == "what " and norm("???") == "" and norm("A  b?!.") == "a b"


def test_trim_is_unicode(spark):
    assert value(spark, T.trim(F.lit("   \x1ca b\x85\n"))) == "\x1ca b" == T.py_trim("   \x1ca b\x85\n")


@pytest.mark.parametrize(
    "changes, reason",
    [({"question": " "}, "empty_question"), ({"answer": " \n "}, "empty_answer"), ({"source": ("", 1, 1)}, "empty_source_path"), ({"source": ("p", 0, 1)}, "invalid_source_range"), ({"source": ("p", 3, 2)}, "invalid_source_range"), ({"chunk_id": ""}, "empty_chunk_id"), ({"confidence": math.nan}, "invalid_confidence"), ({"confidence": 1.5}, "invalid_confidence"), ({"confidence": math.inf}, "invalid_confidence"), ({"confidence": -0.0}, None), ({"confidence": 1.0}, None), ({"question": "", "answer": "", "confidence": 2.0}, "empty_question")],
)
def test_reasons(spark, changes, reason):
    assert spark.createDataFrame([item(spark, **changes)], schemas.QA).select(qa.reject_reason().alias("r")).first().r == reason


def test_first_question_stays_and_rejected_ones_claim_nothing(spark):
    rows = [item(spark, id="0", question="Q1", answer=""), item(spark, id="1", question="Q1"), item(spark, id="2", question=" q1 ? "), item(spark, id="3", question="q1?"), item(spark, id="4", question="Q2")]
    items = spark.createDataFrame(rows, schemas.QA).withColumn("at", F.col("id").cast("int"))
    valid, rejected = qa.validate(items)
    assert sorted(r.id for r in qa.first_per_question(valid, ["at"]).collect()) == ["1", "2", "4"] and rejected.count() == 1
    stats = qa.build_stats(items, 5, 1, 1, 0)
    assert (stats["generated_items"], stats["rejected_items"], stats["duplicate_items"]) == (3, 1, 1)


def test_first_questions_are_found_by_numbers(spark):
    rows = [(f"Q{k % 50}?" if k % 3 else "everyone asks", k // 40, k % 40, "x" * (k % 7)) for k in range(2000)]
    items = spark.createDataFrame(rows, "question string, doc long, line int, rest string").repartition(7)
    first = qa.first_per_question(items, ["doc", "line"])
    want = {}
    for q, doc, line, rest in sorted(rows, key=lambda r: r[1:3]):
        want.setdefault(T.py_trim(q).rstrip("?").lower(), (q, doc, line, rest))
    assert sorted(tuple(r) for r in first.collect()) == sorted(want.values()) and first.columns == items.columns
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "min_by" not in plan


def test_json_lines_leave_out_what_is_empty(spark):
    rows = spark.createDataFrame([item(spark), item(spark, tags=["x"], confidence=0.5)], schemas.QA)
    lines = [json.loads(r.value) for r in qa.json_lines(qa.alpaca(rows), ["instruction", "input", "output", "metadata"]).collect()]
    assert lines[0] == {"instruction": "q", "input": "", "output": "a", "metadata": {"id": "i", "source": {"path": "p", "start_line": 1, "end_line": 2}, "chunk_id": "c", "model": "m", "generated_at": "t"}}
    assert lines[1]["metadata"]["tags"] == ["x"] and lines[1]["metadata"]["confidence"] == 0.5


def test_templates_are_filled_once(spark):
    filled = value(spark, T.render_template("{{a}}{{b}} {{a}} {{unknown}}", {"a": F.lit("{{b}}"), "b": F.lit("2")}))
    assert filled == "{{b}}2 {{b}} {{unknown}}" == T.py_render("{{a}}{{b}} {{a}} {{unknown}}", {"a": "{{b}}", "b": "2"})


def test_prompt_names_its_source(spark):
    chunk = spark.createDataFrame([("docs/a.md", 4, 8, "body {{path}}")], "path string, start_line long, end_line long, text string")
    text = chunk.select(prompts.qa_prompt(prompts.QA_TEMPLATE, 3).alias("p")).first().p
    assert "docs/a.md:4-8" in text and "<source>\nbody {{path}}\n</source>" in text


def test_prompt_files(tmp_path):
    (tmp_path / "p.txt").write_text("{{path}} {{chunk_text}}")
    (tmp_path / "bad.txt").write_text("{{path}}")
    assert prompts.load_prompt(prompts.QA_VERSION, str(tmp_path), "p.txt").version == "custom"
    for kind, name in ((prompts.QA_VERSION, "bad.txt"), (prompts.VERIFY_VERSION, "p.txt"), (prompts.QA_VERSION, "none.txt")):
        with pytest.raises(PromptError):
            prompts.load_prompt(kind, str(tmp_path), name)


ONE = '{"question":"Q","answer":"A"}'


@pytest.mark.parametrize(
    "raw, confidence",
    [('{"items":[{"question":"Q","answer":"A","tags":[],"confidence":0.8}]}', 0.8), (f"```json\n[{ONE}]\n```", None), (f'Sure:\n```\n{{"questions":[{ONE}]}}\n``` bye', None), (f'{{"questions":[{ONE}],"more":1}}', None)],
)
def test_completions(spark, raw, confidence):
    got = completions.parse_questions(raw)
    assert [(g["question"], g["answer"], g["tags"]) for g in got] == [("Q", "A", [])] and (confidence is None) == (got[0]["confidence"] is None)
    assert json.loads(value(spark, T.json_candidate(F.lit(raw)))) == completions.parse_json(raw)


@pytest.mark.parametrize("raw, error", [('{"items":[{"question":"Q"}', InvalidJson), ('{"items":1,"questions":[]}', UnexpectedSchema), ('[{"question":1,"answer":"a"}]', UnexpectedSchema), ('[{"question":"q","answer":"a","tags":null}]', UnexpectedSchema), ('[{"question":"q","answer":"a","confidence":"1"}]', UnexpectedSchema), ('[{"question":"q","answer":"a","confidence":NaN}]', InvalidJson), ('{"x":1}', UnexpectedSchema), ('[{"question":"```","answer":"a"}]', InvalidJson)])
def test_bad_completions(raw, error):
    with pytest.raises(error) as e:
        completions.parse_questions(raw)
    assert e.value.retryable


def test_decisions():
    check = {"passed": True, "reason": "r"}
    good = {"grounded": check, "self_contained": check, "answer_relevant": check}
    assert completions.parse_decision(json.dumps(good))["evidence"] is None
    for bad in ({**good, "grounded": {"passed": 1, "reason": "r"}}, {**good, "grounded": {"passed": True, "reason": " "}}, {**good, "evidence": ""}, {"grounded": check}):
        with pytest.raises(UnexpectedSchema):
            completions.parse_decision(json.dumps(bad))
    assert completions.questions_schema(3)["properties"]["items"]["maxItems"] == 3 and "evidence" in completions.decision_schema()["required"]


def test_retryable():
    assert [ApiError(s, "").retryable for s in (429, 503, 401, 404)] == [True, True, False, False]
    assert [T.py_retry_delay(n) for n in (1, 2, 7, 9)] == [0.5, 1.0, 32.0, 32.0]
