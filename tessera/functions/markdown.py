"""Where CommonMark headings begin: a line scanner of the block structure, after the public specification.

Containers (quotes, list items) are matched first, then leaves: fenced and indented code, HTML blocks, ATX headings, thematic breaks, paragraphs,
and setext underlines, whose heading begins where the paragraph does. A paragraph of link reference definitions alone is no heading.
"""

from __future__ import annotations

import re

_ATX = re.compile(r"#{1,6}(?=[ \t]|$)")
_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_BULLET = re.compile(r"[-+*](?=[ \t]|$)")
_ORDERED = re.compile(r"(\d{1,9})[.)](?=[ \t]|$)")
_REFERENCE = re.compile(r"""[ ]{0,3}\[(?=[^\]]*[^\]\s])(?:[^\[\]\\]|\\.)+\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<][^\s]*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)""")
#: Fixed values of the specification: the tag names that begin an HTML block which a blank line ends.
_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
_ATTRIBUTE = r"""(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
_HTML: list[tuple[re.Pattern[str], re.Pattern[str] | None, bool]] = [  # begin, end (None: a blank line), may interrupt a paragraph
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(rf"</?(?:{_TAGS})(?:\s|/?>|$)", re.I), None, True),
    (re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None, False),
]


class _Line:
    """A line with a cursor; tabs stop at columns that are multiples of four."""

    def __init__(self, text: str):
        self.text, self.at, self.column, self.spare = text, 0, 0, 0  # spare: columns left of a tab that is partly consumed

    def indent(self) -> tuple[int, int]:
        """(columns of white space ahead, place after it)"""
        n, at, column = self.spare, self.at, self.column + self.spare
        while at < len(self.text) and self.text[at] in " \t":
            step = 1 if self.text[at] == " " else 4 - column % 4
            n, column, at = n + step, column + step, at + 1
        return n, at

    def skip(self, columns: int) -> None:
        while columns > 0:
            if self.spare:
                used = min(self.spare, columns)
                self.spare -= used
                self.column += used
                columns -= used
                continue
            if self.at >= len(self.text) or self.text[self.at] not in " \t":
                return
            self.spare = 1 if self.text[self.at] == " " else 4 - self.column % 4
            self.at += 1

    def past(self, place: int) -> None:
        n, at = self.indent()
        self.column += n + (place - at)
        self.at, self.spare = place, 0

    def blank(self) -> bool:
        return self.indent()[1] >= len(self.text)


def heading_offsets(text: str) -> list[int]:
    """Ascending character offsets at which headings begin."""
    found: list[int] = []
    containers: list[int] = []  # -1: a quote; else the columns by which a list item's content is indented
    paragraph: list[tuple[int, str]] | None = None  # (offset, content) of its lines
    fence: tuple[str, int] | None = None
    html: re.Pattern[str] | None = None
    in_html = in_code = False
    fresh_item = False  # an item that began with a blank line
    offset = 0

    def reference_lines(lines: list[tuple[int, str]]) -> int:
        body, taken = "\n".join(c for _, c in lines), 0
        while taken < len(body):
            m = _REFERENCE.match(body, taken)
            if not m:
                break
            taken = m.end()
        return len(lines) if taken >= len(body) else body.count("\n", 0, taken)

    for raw in text.split("\n"):
        begin, offset = offset, offset + len(raw) + 1
        line = _Line(raw.rstrip("\r"))
        matched = 0
        for kind in containers:
            n, at = line.indent()
            if kind < 0:
                if n > 3 or at >= len(line.text) or line.text[at] != ">":
                    break
                line.past(at + 1)
                if line.indent()[0]:
                    line.skip(1)
            elif line.blank():
                if fresh_item and matched == len(containers) - 1:
                    break
                line.skip(min(n, kind))
            elif n >= kind:
                line.skip(kind)
            else:
                break
            matched += 1
        all_matched = matched == len(containers)
        if (fence or in_html) and not all_matched:
            fence, in_html = None, False
        if not all_matched and in_code:
            in_code = False
        if fence:
            n, at = line.indent()
            rest = line.text[at:].rstrip(" \t")
            if n <= 3 and len(rest) >= fence[1] and rest == fence[0] * len(rest):
                fence = None
            continue
        if in_html:
            if (html.search(line.text, line.at) if html else line.blank()):
                in_html = False
            continue
        opened = False
        while True:  # new containers
            n, at = line.indent()
            if at >= len(line.text) or n > 3:
                break
            if line.text[at] == ">":
                if not opened:
                    del containers[matched:]
                paragraph, opened = None, True
                containers.append(-1)
                line.past(at + 1)
                if line.indent()[0]:
                    line.skip(1)
                fresh_item = False
                continue
            rest = line.text[at:]
            if _BREAK.match(rest) and not (paragraph is not None and all_matched and not opened and _SETEXT.match(rest)):
                break
            m = _BULLET.match(rest) or _ORDERED.match(rest)
            if not m:
                break
            if paragraph is not None and not opened and all_matched and _SETEXT.match(rest) and rest[0] == "-":
                break
            empty = not rest[m.end() :].strip(" \t")
            interrupts = paragraph is not None and not opened and all_matched
            if interrupts and (empty or (m.re is _ORDERED and m[1] != "1")):
                break
            if not opened:
                del containers[matched:]
            line.past(at + m.end())
            spaces, after = line.indent()
            if empty:
                width = n + m.end() + 1
                fresh_item = True
            elif spaces > 4:
                width = n + m.end() + 1
                line.skip(1)
                fresh_item = False
            else:
                width = n + m.end() + spaces
                line.skip(spaces)
                fresh_item = False
            containers.append(width)
            paragraph, opened, in_code = None, True, False
            if empty:
                break
        if opened:
            all_matched = True
        n, at = line.indent()
        if at >= len(line.text):
            paragraph = None
            if not opened:
                del containers[matched:]
                if not all_matched:
                    fresh_item = False
            continue
        if not opened:
            fresh_item = False
        lazy = paragraph is not None and not all_matched
        rest = line.text[at:]
        if n > 3:
            if paragraph is not None:
                paragraph.append((begin + at, rest))
            else:
                del containers[matched if not opened else len(containers) :]
                in_code = True
            continue
        in_code = False
        if _ATX.match(rest):
            if not all_matched:
                del containers[matched:]
            found.append(begin + at)
            paragraph = None
            continue
        m = _FENCE.match(rest)
        if m:
            if not all_matched:
                del containers[matched:]
            fence, paragraph = (m[1][0], len(m[1])), None
            continue
        if rest[0] == "<":
            started = next(((end,) for start, end, interrupts in _HTML if start.match(rest) and (interrupts or paragraph is None)), None)
            if started:
                if not all_matched:
                    del containers[matched:]
                html, paragraph = started[0], None
                in_html = not (html and html.search(rest))
                continue
        if paragraph is not None and not lazy and _SETEXT.match(rest):
            skipped = reference_lines(paragraph)
            if skipped < len(paragraph):
                found.append(paragraph[skipped][0])
                paragraph = None
                continue
            paragraph = [(begin + at, rest)]
            continue
        if _BREAK.match(rest):
            if not all_matched:
                del containers[matched:]
            paragraph = None
            continue
        if paragraph is not None:
            paragraph.append((begin + at, rest))
        else:
            if not all_matched:
                del containers[matched:]
            paragraph = [(begin + at, rest)]
    return found
