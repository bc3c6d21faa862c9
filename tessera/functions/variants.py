"""Strict parsing of completions that are a column: the rules of operators/completions.py as expressions over VARIANT, without Python workers.

An outcome is ok, invalid_json or unexpected_schema; the value is null unless it is ok. Types must be as asked for, nothing is coerced. What the JVM's parser takes for JSON
differs from Python's in that an object must not repeat a name; and a completion of more than 16 MB is no JSON to it (the limit of a VARIANT).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import parsed_json, trim

OK, INVALID_JSON, UNEXPECTED_SCHEMA = "ok", "invalid_json", "unexpected_schema"
CHECK_NAMES = ("grounded", "self_contained", "answer_relevant")


def _field(variant: Column, name: str) -> Column:
    """A field of an object as a VARIANT; SQL null if it is missing, a VARIANT null if it is null."""
    return F.try_variant_get(variant, f"$.{name}", "variant")


def _is(variant: Column, *kinds: str) -> Column:
    """Whether a VARIANT is of one of the kinds, as schema_of_variant begins to name them."""
    schema = F.schema_of_variant(variant)
    found = F.startswith(schema, F.lit(kinds[0]))
    for kind in kinds[1:]:
        found = found | F.startswith(schema, F.lit(kind))
    return F.coalesce(found, F.lit(False))


def _is_number(variant: Column) -> Column:
    return _is(variant, "BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _missing_or_null(variant: Column) -> Column:
    return variant.isNull() | F.is_variant_null(variant)


def _outcome(parsed: Column, sound: Column, value: Column) -> Column:
    """A struct of outcome and value."""
    outcome = F.when(parsed.isNull(), INVALID_JSON).when(F.coalesce(sound, F.lit(False)), OK).otherwise(UNEXPECTED_SCHEMA)
    return F.struct(outcome.alias("outcome"), F.when(outcome == OK, value).alias("value"))


def questions(completion: Column) -> Column:
    """struct<outcome, value: array<struct<question, answer, tags, confidence>>> of a completion that should hold generated items."""
    parsed = parsed_json(completion)
    items = F.when(_is(parsed, "ARRAY"), parsed).when(_is(parsed, "OBJECT"), F.coalesce(_field(parsed, "items"), _field(parsed, "questions")))
    listed = F.try_variant_get(items, "$", "array<variant>")

    def sound(item: Column) -> Column:
        tags, confidence = _field(item, "tags"), _field(item, "confidence")
        texts = F.forall(F.coalesce(F.try_variant_get(tags, "$", "array<variant>"), F.array().cast("array<variant>")), lambda t: _is(t, "STRING"))
        return _is(item, "OBJECT") & _is(_field(item, "question"), "STRING") & _is(_field(item, "answer"), "STRING") & (tags.isNull() | _is(tags, "ARRAY") & texts) & (_missing_or_null(confidence) | _is_number(confidence))

    def typed(item: Column) -> Column:
        text = lambda name: F.try_variant_get(item, f"$.{name}", "string").alias(name)
        tags = F.coalesce(F.try_variant_get(item, "$.tags", "array<string>"), F.array().cast("array<string>"))
        return F.struct(text("question"), text("answer"), tags.alias("tags"), F.try_variant_get(item, "$.confidence", "double").cast("float").alias("confidence"))

    return _outcome(parsed, _is(items, "ARRAY") & F.forall(listed, sound), F.transform(listed, typed))


def decision(completion: Column) -> Column:
    """struct<outcome, value: struct<checks, evidence>> of a completion that should hold a decision."""
    parsed = parsed_json(completion)
    sound, checks = _is(parsed, "OBJECT"), []
    for name in CHECK_NAMES:
        passed, reason = _field(parsed, f"{name}.passed"), _field(parsed, f"{name}.reason")
        said = F.try_variant_get(parsed, f"$.{name}.reason", "string")
        sound = sound & _is(passed, "BOOLEAN") & _is(reason, "STRING") & (trim(said) != "")
        checks.append(F.struct(F.try_variant_get(parsed, f"$.{name}.passed", "boolean").alias("passed"), said.alias("reason")).alias(name))
    evidence = _field(parsed, "evidence")
    quoted = F.try_variant_get(parsed, "$.evidence", "string")
    sound = sound & (_missing_or_null(evidence) | _is(evidence, "STRING") & (trim(quoted) != ""))
    return _outcome(parsed, sound, F.struct(F.struct(*checks).alias("checks"), F.when(~_missing_or_null(evidence), quoted).alias("evidence")))
