"""Ignore rules in the manner of gitignore files, for pruning a walk on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern[str]
    negated: bool
    directories_only: bool


def _glob(glob: str) -> str:
    """A regular expression for a glob in which * and ? stop at slashes and ** between slashes does not."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.+")
            i += 3
        elif glob[i] == "*":
            while glob.startswith("**", i):
                i += 1
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and (end := _class_end(glob, i)):
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            out.append(f"(?!/)[{'^' if negated else ''}{re.sub(r'([\\[&~|])', r'\\\1', body[negated:])}]")
            i = end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "".join(out)


def _class_end(glob: str, start: int) -> int | None:
    end = glob.find("]", start + (3 if glob[start + 1 : start + 2] in ("!", "^") else 2))
    return end if end > 0 else None


def parse_rule(line: str) -> Rule | None:
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    directories_only = line.endswith("/")
    line = line.rstrip("/") if directories_only else line
    if not line:
        return None
    anchored = "/" in line
    body = _glob(line.removeprefix("/"))
    return Rule(re.compile(f"{'' if anchored else '(?:.*/)?'}{body}", re.S), negated, directories_only)


class Rules:
    """The rules of one file, for paths below its folder; the last rule that matches decides."""

    def __init__(self, lines: list[str]):
        self.rules = [r for r in map(parse_rule, lines) if r]

    def verdict(self, path: str, is_directory: bool) -> bool | None:
        """True: ignored; False: expressly not; None: no rule matches."""
        for rule in reversed(self.rules):
            if (is_directory or not rule.directories_only) and rule.pattern.fullmatch(path):
                return not rule.negated
        return None

    def ignores_or_a_parent(self, path: str, is_directory: bool) -> bool:
        parts = path.split("/")
        return any(self.verdict("/".join(parts[:k]), is_directory or k < len(parts)) is True for k in range(1, len(parts) + 1))


def expand_recursive_suffix(pattern: str) -> str | None:
    """prefix/**suffix also means prefix/**/*suffix: the added pattern, if the first /** has a suffix."""
    prefix, mark, suffix = pattern.partition("/**")
    return f"{prefix}/**/*{suffix}" if mark and suffix and not suffix.startswith("/") else None


def custom_rules(texts: list[str]) -> list[Rules]:
    """Rules of extra ignore files, each with its expansions after all of its own lines."""
    found = []
    for text in texts:
        lines = text.splitlines()
        found.append(Rules(lines + [e for e in map(expand_recursive_suffix, lines) if e]))
    return found
