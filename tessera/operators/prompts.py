"""Prompt templates: built in, or from a file; rendered as column expressions."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import PromptError
from tessera.functions.text import py_trim, render_template

QA_TEMPLATE = """<source>
{{chunk_text}}
</source>

The lines above stand at {{path}}:{{start_line}}-{{end_line}}. Someone will study them and then be quizzed; prepare the quiz, with {{questions_per_chunk}} entries, no more and no fewer.

- Name the subject of each question in full, because the quiz is read apart from these lines.
- Take each reply from these lines, in one or two sentences. Where they are silent, ask something else.
- Add a few topic words as tags. If you can tell how sure you are of a reply, add that as a fraction of 1.

Send back a JSON object and no other text: under "items" a list of entries, each with "question" and "answer" (text), "tags" (a list of text) and, where you give it, "confidence" (a number from 0 to 1).
"""
VERIFY_TEMPLATE = """You are the second reader of a quiz. This entry was submitted:

Q: {{question}}
A: {{answer}}

Its author worked from {{path}}:{{start_line}}-{{end_line}}, which reads:

<source>
{{chunk_text}}
</source>

Decide on each of these by itself:

- grounded: go through what A says, claim by claim. It passes if the passage supports every one; what you know from elsewhere supports nothing.
- self_contained: read Q alone. It passes if it names what it is about, so that nobody has to ask "which file?" or "what does this refer to?".
- answer_relevant: lay A beside Q. It passes if A settles what Q wants to know and leaves out nothing that Q asks for.

Send back a JSON object and no other text. Under each of these three names put an object with "passed" (true or false) and "reason" (one sentence). Under "evidence" quote the words of the passage that settled the matter, or put null.
"""
QA_VERSION, VERIFY_VERSION, CUSTOM_VERSION = "qa-v1", "verify-v1", "custom"
_REQUIRED = {QA_VERSION: ("chunk_text",), VERIFY_VERSION: ("question", "answer", "chunk_text")}


@dataclass(frozen=True)
class Prompt:
    version: str
    template: str
    path: str | None = None


def check_template(template: str, kind: str) -> None:
    if not py_trim(template):
        raise PromptError("the prompt template is empty")
    for name in _REQUIRED[kind]:
        if "{{" + name + "}}" not in template:
            raise PromptError(f"the prompt template lacks {{{{{name}}}}}")


def load_prompt(kind: str, repository: str, prompt_file: str | None) -> Prompt:
    """The built-in template of a kind (QA_VERSION, VERIFY_VERSION), or that of a file, relative to the repository unless absolute."""
    if prompt_file is None:
        return Prompt(kind, QA_TEMPLATE if kind == QA_VERSION else VERIFY_TEMPLATE)
    path = os.path.join(repository, prompt_file)
    try:
        with open(path, encoding="utf-8") as f:
            template = f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise PromptError(f"cannot read the prompt {path}: {e}") from e
    check_template(template, kind)
    return Prompt(CUSTOM_VERSION, template, path)


def _source(chunk: str = "") -> dict[str, Column]:
    col = lambda name: F.col(f"{chunk}{name}")
    return {"path": col("path"), "start_line": col("start_line"), "end_line": col("end_line"), "chunk_text": col("text")}


def qa_prompt(template: str, questions_per_chunk: int, chunk: str = "") -> Column:
    return render_template(template, _source(chunk) | {"questions_per_chunk": F.lit(questions_per_chunk)})


def verification_prompt(template: str, chunk: str = "", question: str = "question", answer: str = "answer") -> Column:
    return render_template(template, _source(chunk) | {"question": F.col(question), "answer": F.col(answer)})
