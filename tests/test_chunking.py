import pytest

from tessera.errors import ChunkError
from tessera.functions.markdown import heading_offsets
from tessera.operators.chunking import chunk_documents, chunk_text, chunks_per_file, unique_chunks


def lines(text, most=1000):
    return [(c["text"], c["start_line"], c["end_line"]) for c in chunk_text("a.md", text, most)]


def test_splits_at_headings():
    assert lines("# Intro\nbody.\n\n## Usage\nrun.") == [("# Intro\nbody.", 1, 2), ("## Usage\nrun.", 4, 5)]


def test_fenced_headings_are_text():
    text = "# One\n\n```sh\n# Not a section\n```"
    assert [c[0] for c in lines(text)] == [text]


def test_cuts_long_lines_by_characters():
    assert lines("ééééé", 3) == [("ééé", 1, 1), ("éé", 1, 1)]


def test_prefers_line_ends():
    assert lines("1234\n5678", 5) == [("1234", 1, 1), ("5678", 2, 2)]


def test_exactly_the_limit_is_not_split():
    assert len(lines("12345", 5)) == 1 and len(lines("123456", 5)) == 2


def test_ids_are_stable():
    first, again, other = (chunk_text("a.md", t, 100)[0] for t in ("same", "same", "changed"))
    assert first["chunk_id"] == again["chunk_id"] != other["chunk_id"] and first["content_hash"] != other["content_hash"]


def test_blank_text_has_no_chunks():
    assert lines(" \n\n ") == []


def test_zero_limit_is_an_error(spark):
    with pytest.raises(ChunkError):
        chunk_text("a.md", "x", 0)
    with pytest.raises(ChunkError):
        chunk_documents(spark.createDataFrame([("a.md", "x")], "path string, text string"), 0)


@pytest.mark.parametrize(
    "text, starts",
    [
        ("Title\n=====\nx", [0]), ("two\nlines\n---\nx", [0]), ("   ### three\nx", [3]), ("    # code", []), ("> # quoted\n> x", [2]), ("- # item\n  x", [2]), ("1. a\n\n   ## in item", [9]),
        ("<div>\n# html\n</div>\n\n# after", [21]), ("<!-- \n\n# no\n-->\n# yes", [16]), ("---\ntitle: x\n---\n", [4]), ("```\n# open", []), ("~~~\n# no\n~~~\n# yes", [13]), ("````\n```\n# no\n````\n# yes", [19]),
        ("[a]: /u\n===\n", []), ("#no\n#hash tag", []), ("#\n", [0]), ("####### seven", []), ("text\n# interrupts", [5]), ("- a\n---\n", []), ("* * *\nfoo\n===", [6]), ("> lazy\n===\n", []), ("a\n\n===\n", []), ("`x\n# y`", [3]),
    ],
)
def test_heading_offsets(text, starts):
    assert heading_offsets(text) == starts


def test_repeated_pieces_share_an_id_and_do_not_multiply(spark):
    docs = spark.createDataFrame([("long.md", "abcd" * 30), ("empty.md", " "), ("none.md", None)], "path string, text string")
    chunks = chunk_documents(docs, 40)
    assert chunks.count() == 3 and unique_chunks(chunks).count() == 1
    assert {r.path: r.chunks for r in chunks_per_file(docs, chunks).collect()} == {"long.md": 3, "empty.md": 0, "none.md": 0}
