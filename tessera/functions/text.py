"""Text functions as column expressions, so that they stay inside generated code; and their Python twins where drivers or workers need them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space, which Python's strip() and Java's \s both get wrong.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_W = r"\p{IsWhite_Space}"
_PLACEHOLDER = re.compile(r"\{\{([a-z_]+)\}\}")


def trim(text: Column) -> Column:
    """text without the white space of Unicode at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"\P{IsWhite_Space}")


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def normalize_question(question: Column) -> Column:
    """The key of equal questions: single spaces, no run of closing marks at the end, lower case."""
    spaced = F.btrim(F.regexp_replace(question, f"{_W}+", " "))
    return F.lower(F.regexp_replace(spaced, r"[?.!:;]+\z", ""))


def sha256_joined(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL characters between them."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def excerpt(text: Column, limit: int = 500) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def render_template(template: str, values: dict[str, Column]) -> Column:
    """The template with its placeholders filled in one pass: what a value holds is never taken for a placeholder."""
    parts = _PLACEHOLDER.split(template)
    columns = []
    for k, part in enumerate(parts):
        if k % 2:
            columns.append(values[part].cast("string") if part in values else F.lit("{{" + part + "}}"))
        elif part:
            columns.append(F.lit(part))
    return F.concat(*columns) if columns else F.lit("")


def json_candidate(completion: Column) -> Column:
    """What a completion holds between its first code fence and the next, without the word json; or all of it, if there is no fence."""
    whole = trim(completion)
    after = F.substring(whole, F.instr(whole, "```") + 3, F.length(whole))
    unnamed = F.when(F.startswith(after, F.lit("json")), F.substring(after, F.lit(5), F.length(after))).otherwise(after)
    return F.when(F.instr(whole, "```") > 0, trim(F.substring_index(unnamed, "```", 1))).otherwise(whole)


def parsed_json(completion: Column) -> Column:
    """The completion's JSON as a variant, null where it is malformed. The JVM's parser stops after the first value; so the value is parsed as a field,
    followed by a field whose name, the digest of the text, no text can hold, and nothing may come between."""
    text = json_candidate(completion)
    mark = F.sha2(text, 256)
    fields = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"'), mark, F.lit('":0}'))), "$", "map<string,variant>")
    return F.when(F.map_contains_key(fields, mark), F.try_element_at(fields, F.lit("value")))


def retry_delay_ms(attempt: Column) -> Column:
    """500 ms before the first retry, doubling, 32 s at most."""
    return (F.lit(500) * F.pow(F.lit(2), F.greatest(F.lit(0), F.least(attempt - 1, F.lit(6))))).cast("long")


# the same for drivers and workers

def py_trim(text: str) -> str:
    return text.strip(WHITE_SPACE)


def py_render(template: str, values: dict[str, str]) -> str:
    return _PLACEHOLDER.sub(lambda m: values.get(m[1], m[0]), template)


def py_json_candidate(completion: str) -> str:
    whole = py_trim(completion)
    before, fence, after = whole.partition("```")
    if not fence:
        return whole
    return py_trim(after.removeprefix("json").partition("```")[0])


def py_excerpt(text: str, limit: int = 500) -> str:
    return text[:limit] + "..." if len(text) > limit else text


def py_retry_delay(attempt: int) -> float:
    """Seconds before the retry of that number, from 1."""
    return 0.5 * 2 ** min(max(attempt - 1, 0), 6)
