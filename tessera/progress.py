"""Progress events; a reporter is any callable that takes one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Event:
    """kind: discovery_started, discovery_finished, file_chunked, generation_started, chunk_started, retry_scheduled, chunk_finished, generation_finished,
    validation_finished, export_started, finished; for verification: verification_started, reconstructed, item_started, retry_scheduled,
    item_finished, verification_finished, report_written. Events of chunks and items that a model is asked about are told while it is,
    those of one in order; of the others, which the cache answers or which cannot be verified, in order after them."""

    kind: str
    details: dict[str, Any] = field(default_factory=dict)


Reporter = Callable[[Event], None]


def silent(event: Event) -> None:
    """Reports nothing."""


#: What a line on a screen says of each kind of event.
LINES = {
    "discovery_started": "looking for Markdown files in {repository}",
    "discovery_finished": "{discovered} files, {skipped} of them left out",
    "file_chunked": "{path}: {chunks} chunks",
    "generation_started": "{chunks} chunks to ask about, {concurrency} at a time",
    "chunk_started": "[{number}/{total}] {path}:{start_line}-{end_line}",
    "chunk_finished": "[{number}] {path}:{start_line}-{end_line}: {generated_items} items{from_cache}",
    "retry_scheduled": "[{number}] again in {delay_ms} ms, attempt {attempt} of {max_retries}",
    "generation_finished": "{model_calls} calls of the model, {retries} of them again",
    "validation_finished": "{accepted} items good, {rejected} rejected, {duplicates} asked before",
    "export_started": "writing {output}",
    "verification_started": "checking {dataset}",
    "reconstructed": "{items} items have their source",
    "item_started": "[{number}/{total}] {qa_id}",
    "item_finished": "[{number}] {qa_id}: {verdict}{from_cache}",
    "verification_finished": "{accepted_items} accepted, {rejected_items} rejected, {unverifiable_items} unverifiable of {total_items} items; {model_calls} calls of the model",
    "report_written": "wrote {output}",
    "finished": "wrote {output}",
}


def describe(event: Event) -> str:
    """The event as a line for a screen."""
    known = event.details | {"number": event.details.get("index", 0) + 1, "from_cache": " (from the cache)" if event.details.get("source") == "cache" else ""}
    return LINES[event.kind].format(**known)
