"""Operator 2: WARC archives and a reader that salvages what a damaged archive still holds.

Writer: every page becomes a record, a response, or a revisit of the response with an equal payload; each record is a gzip member of
its own. Equal payloads are found by SHA-1 in a partial aggregation; texts are shuffled once. Each task writes archives of its own under names
that no other attempt uses, and only archives that finished attempts report are read, so a lost executor leaves no half archive behind.

Reader: a record must have its version line, its length, the separator behind it and its block digest; a gzip member must also pass its own check.
After a failed check the reader searches for the next member or version line at which a whole valid record begins, goes on from there, and
logs the bytes between as a quarantined gap.

A null html is an empty payload. A null page_id is written as none and read back as null; such a page revisits any page with an id and an equal payload,
and where all pages of a payload are without id they are responses. Repeated rows of one page are one page written as
often as it is there; the largest page_id of equal payloads is the response, so such rows are all responses. No pages give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table

VERSION = b"WARC/1.1\r\n"
_ID = "urn:page:"
STEP = 1 << 16  # bytes that are unpacked at a time


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, response_id: int | None) -> bytes:
    """One record. response_id: the page that a revisit refers to, None for a response."""
    revisit = response_id is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    clean = "".join(c for c in url or "" if c >= " ")
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{response_id}>"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


@dataclass
class _Bad(Exception):
    reason: str = field(default="")


class _Short(_Bad):
    """The bytes end before the check does: it fails if there are no more."""


def parse(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at that place of plain bytes; raises if any check fails."""
    if not raw.startswith(b"WARC/1.", at):
        raise _Bad("no version line")
    first = raw[at : at + 10]
    if len(first) == 10 and first not in (b"WARC/1.0\r\n", VERSION):
        raise _Bad("no version line")
    headers: dict[str, str] = {}
    place = at + 10
    while raw[place : place + 2] != b"\r\n":  # line by line, so that what is no header costs no search of all that follows
        stop = raw.find(b"\r\n", place)
        if stop < 0:
            raise _Short("header without end")
        name, colon, value = raw[place:stop].partition(b":")
        if not colon:
            raise _Bad("header line without colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        place = stop + 2
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise _Bad("no length")
    begin, end = place + 2, place + 2 + int(length)
    if end + 4 > len(raw):
        raise _Short("truncated, or length differs")
    if raw[end : end + 4] != b"\r\n\r\n":
        raise _Bad("truncated, or length differs")
    block = raw[begin:end]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest(block):
        raise _Bad("block digest differs")
    return headers, block, end + 4


def _at(raw: bytes, at: int, base: int) -> tuple[list[Record], int]:
    """The records of the gzip member or the plain record at that place, and its end. base: where raw begins in the archive."""
    if raw.startswith(b"\x1f\x8b\x08", at):
        opened, parts, end = zlib.decompressobj(31), [], at
        try:
            while not opened.eof and end < len(raw):
                parts.append(opened.decompress(raw[end : end + STEP]))
                end += STEP
        except zlib.error as e:
            raise _Bad("gzip member is damaged") from e
        if not opened.eof:
            raise _Short("gzip member is truncated")
        end = min(end, len(raw)) - len(opened.unused_data)
        inner, found, place = b"".join(parts), [], 0
        while place < len(inner) or not found:
            try:
                headers, block, place = parse(inner, place)
            except _Short as e:
                raise _Bad(e.reason) from e
            found.append(Record(base + at, base + end, headers, block))
        return found, end
    headers, block, end = parse(raw, at)
    return [Record(base + at, base + end, headers, block)], end


def salvage(source, window: int = 4 << 20) -> Iterator[Record | Gap]:
    """Every record of an archive that can be read, and the gaps between them. source: bytes, or a file that is read on as its records are passed.

    What is held at once is the record in work, or a window where no record is found, and up to twice as much read ahead.
    """
    source = io.BytesIO(source) if isinstance(source, (bytes, bytearray)) else source
    raw, base, ended = b"", 0, False

    def more(keep: int) -> None:
        """Reads on, and forgets what lies before a place."""
        nonlocal raw, base, ended
        new = source.read(max(window, len(raw) - keep))
        raw, base, ended = raw[keep:] + new, base + keep, not new

    def tried(at: int) -> tuple[list[Record], int] | str | None:
        """What is found at a place, or why nothing is; None if that takes more bytes."""
        try:
            return _at(raw, at, base)
        except _Short as e:
            return e.reason if ended else None
        except _Bad as e:
            return e.reason

    at = 0
    lost: tuple[int, str] | None = None  # where a gap began, and why
    while True:
        if lost is not None:
            options = [p for p in (raw.find(b"\x1f\x8b\x08", at), raw.find(b"WARC/1.", at)) if p >= 0]
            if not options:
                if ended:
                    yield Gap(lost[0], base + len(raw), lost[1])
                    return
                more(max(at, len(raw) - 6))  # a version line may have been cut
                at = 0
                continue
            at = min(options)
        elif at >= len(raw):
            if ended:
                return
            more(at)
            at = 0
            continue
        found = tried(at)
        if found is None:
            more(at)
            at = 0
        elif isinstance(found, str):
            lost = lost or (base + at, found)
            at += 1
        else:
            if lost is not None:
                yield Gap(lost[0], base + at, lost[1])
                lost = None
            yield from found[0]
            at = found[1]


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes pages (page_id, url, html) below folder; (path, n_records, n_bytes) of each archive, lazily: keep it in a table."""
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = full.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    largest = keyed.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("response_id"))
    revisits = keyed.select("page_id", "sha").join(largest, "sha").where("page_id < response_id OR page_id IS NULL AND response_id IS NOT NULL").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "response_id").distinct()
    wanted = keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "html", "response_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                raw = member(record(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["response_id"]))
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "n_records", "n_bytes"])

    return wanted.mapInArrow(run, "path string, n_records long, n_bytes long")


READ = "path string, start long, end long, gap_reason string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(text: str) -> int | None:
    number = text.strip("<>").removeprefix(_ID)
    return int(number) if number.lstrip("-").isdigit() else None


def described(found: Record | Gap) -> dict:
    """What READ tells of a record, or of a gap."""
    if isinstance(found, Gap):
        return {"start": found.start, "end": found.end, "gap_reason": found.reason}
    http, _, payload = found.block.partition(b"\r\n\r\n")
    kind = found.headers.get("warc-type", "")
    out = {"start": found.start, "end": found.end, "page_id": _page(found.headers.get("warc-record-id", "")), "record_type": kind}
    if kind == "revisit":
        said = [line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        return out | {"payload_bytes": int(said[0]) if said else None, "payload_digest": found.headers.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": _page(found.headers.get("warc-refers-to", ""))}
    return out | {"payload_bytes": len(payload), "payload_digest": digest(payload)}


def read_archives(archives: DataFrame, tasks: int) -> DataFrame:
    """READ of all archives by their path: a row for each record, and one with gap_reason for each quarantined gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in READ.split(", "))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = fs.FileSystem.from_uri(path)
                rows = []
                with files.open_input_stream(place, compression=None) as stream:
                    for found in salvage(stream):
                        rows.append({"path": path} | described(found))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return archives.select("path").repartition(max(1, tasks)).mapInArrow(run, READ)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = scratch.path()
    archives = scratch.keep(write_archives(spark, table(spark, sf_dir, "pages"), folder))
    read = read_archives(archives, archives.count())
    return read.where("gap_reason IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha, CAST(unhex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits FROM pages
), r AS (SELECT sha, max(page_id) AS response_id FROM p GROUP BY sha)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * i + 1, 1)::INT
         + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN p.page_id = r.response_id OR r.response_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = r.response_id THEN NULL ELSE r.response_id END AS refers_to
FROM p JOIN r ON p.sha = r.sha
"""
