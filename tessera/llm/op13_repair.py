"""Operator 13: repair of the structure of conversations by the cheapest edits.

A repaired conversation has a system row or none, then pairs of user and assistant. Rows may be kept, given another role, or deleted, and empty rows
inserted; blank rows and repetitions must go. Four states (nothing yet, after the system row, after a user, after an assistant) describe what
a prefix has given, so the cheapest edits are a dynamic programme over turns. It is solved with numpy for many conversations at once:
conversations are bucketed by length and laid out with time first, each turn updates the costs of all states of all conversations of a bucket,
the costs to the end are stored, and edits are traced forwards, again for all at once, taking the least letter wherever costs tie.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation is not bound to one task. One that lies within a task and is of one
segment (SEGMENT_ROWS rows, SEGMENT_BYTES bytes) is repaired where it lies. Those that are cut, by a border between tasks or because they are longer, go on as
segments: a segment's effect on costs is a table of four by four, tables are combined along the conversation, which tells the costs and
the state at each border, and then each segment is traced on its own. What meets in one task of a long conversation are those tables, one for each
segment, and its repaired text as a stream, because it has one digest.

A null role or text is one space; a null conv_id is a conversation of its own; a null turn comes first. Rows of one turn are taken by role, then by the
first 64 characters and the hash of their text; equal rows are interchangeable. A conversation that has lost all rows has zeros, no edits and an
empty text. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import Scratch, table

SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
#: Costs of the edits; what is left of a truncated row adds its own.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
D, I, K, R = b"DIKR"  # in the order in which ties fall
#: States: nothing yet, system, user, assistant; the state after a user or assistant is added, and the cost to end in each.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = np.array([USER, USER, ASSISTANT, USER])
_END = np.array([0, 2 * INSERT, INSERT, 0])
_INF = 1 << 60

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(["conv_id long", *(f"{c} long" for c in COUNTS), "audit string", "repaired_sha256 string"])
ROWS = "conv_id long, seg long, at int, turn long, role string, text string, gone boolean, initial int, blank boolean, truncated boolean, h1 long, h2 long"
SPLIT = f"whole struct<{', '.join(f.replace(' ', ': ') for f in RESULT.split(', '))}>, part struct<{', '.join(f.replace(' ', ': ') for f in ROWS.split(', '))}>"
TABLES = "conv_id long, seg long, costs array<long>, n long, blank long, duplicate long, truncated long, illegal long, first int, last int, least long, most long, turns long"

_SOLID = ~kernel._IS_SPACE
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_CODE = np.zeros(256, np.int32)
_CODE[list(b"sua")] = (SYSTEM, USER, ASSISTANT)


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text), of which a twentieth each, by the checksum of `conv_id:turn`, is dropped (gone, so that its conversation is not
    forgotten), emptied, stripped of its ends of sentences, repeated, or given to the user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(told("role"))
    once = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return once.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "again")


# one segment, or many conversations of one segment each

def features(rows: pa.Table) -> dict[str, np.ndarray]:
    """Of each row: initial (the state it stands for, or START), blank, truncated, and the 128-bit digest (h1, h2) of conversation, role and text."""
    found: dict[str, list[np.ndarray]] = {c: [] for c in ("initial", "blank", "truncated", "h1", "h2")}
    text = rows.column("text").combine_chunks()
    for a, b in kernel.by_bytes(text):
        raw, at = kernel.text_bytes(text.slice(a, b - a))
        names, name_at = kernel.text_bytes(rows.column("role").slice(a, b - a))
        initial = np.zeros(b - a, np.int32)
        named = name_at[1:] > name_at[:-1]
        initial[named] = _CODE[names[name_at[:-1][named]]]
        solid = np.flatnonzero(_SOLID[raw])
        before = np.searchsorted(solid, at)
        blank = before[1:] == before[:-1]
        last = solid[np.maximum(before[1:] - 1, 0)] if len(solid) else np.zeros(b - a, np.int64)
        ended = _ENDS[raw[last]] if len(raw) else np.zeros(b - a, bool)
        convs, name_view, view = rows.column("conv_id").slice(a, b - a).to_pylist(), memoryview(names), memoryview(raw)
        digests = []
        for conv, p, q, x, y in zip(convs, name_at[:-1].tolist(), name_at[1:].tolist(), at[:-1].tolist(), at[1:].tolist()):
            digest = hashlib.blake2b(f"{conv} {q - p} ".encode(), digest_size=16)
            digest.update(name_view[p:q])
            digest.update(view[x:y])
            digests.append(digest.digest())
        both = np.frombuffer(b"".join(digests), np.int64)
        for name, values in zip(found, (initial, blank, ~blank & ~ended, both[::2], both[1::2])):
            found[name].append(values)
    return {name: np.concatenate(values) if values else np.zeros(0, np.int64) for name, values in found.items()}


def repeats(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether an earlier row has the same digest."""
    order = np.lexsort((np.arange(len(h1)), h2, h1))
    out = np.zeros(len(h1), bool)
    out[order[1:]] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    return out


def backward(initial: np.ndarray, must: np.ndarray, truncated: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """costs[t, state, j]: of the cheapest edits of rows t and later of conversation j. The rows are [t, j]; end[state, j] are the costs after the last."""
    steps, n = initial.shape
    costs = np.empty((steps + 1, 4, n), np.int64)
    costs[steps] = end
    for t in range(steps - 1, -1, -1):
        after, here = costs[t + 1], costs[t]
        extra = TRUNCATED * truncated[t] + _INF * must[t]
        here[:] = np.minimum(DELETE + after, REROLE + extra + after[_NEXT])
        role = initial[t]
        here[START] = np.minimum(here[START], np.where(role == SYSTEM, extra + after[SYSTEM], _INF))
        for state in (START, SYSTEM, ASSISTANT):
            here[state] = np.minimum(here[state], np.where(role == USER, extra + after[USER], _INF))
        here[USER] = np.minimum(here[USER], np.where(role == ASSISTANT, extra + after[ASSISTANT], _INF))
        user, assistant = here[USER].copy(), here[ASSISTANT].copy()
        here[USER], here[ASSISTANT] = np.minimum(user, INSERT + assistant), np.minimum(assistant, INSERT + user)
        here[:2] = np.minimum(here[:2], INSERT + here[USER])
        past = t >= lengths
        here[:, past] = after[:, past]
    return costs


def trace(costs: np.ndarray, initial: np.ndarray, must: np.ndarray, truncated: np.ndarray, lengths: np.ndarray, state: np.ndarray, ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """(letters[step, j], state after the last row) of the cheapest edits from a state, of which the least string; 0 is no edit. ends: what is missing
    after the last row is inserted too."""
    steps, n = initial.shape
    letters, column = np.zeros((3 * steps + 2, n), np.uint8), np.arange(n)
    for t in range(steps):
        here, after, role = costs[t], costs[t + 1], initial[t]
        extra = TRUNCATED * truncated[t]
        active = t < lengths
        for k in range(3):  # two insertions at most, then an edit of the row
            now, onwards = here[state, column], _NEXT[state]
            kept = np.where(role == SYSTEM, SYSTEM, onwards)
            fits = ~must[t] & ((role == SYSTEM) & (state == START) | (role == USER) & (state != USER) | (role == ASSISTANT) & (state == USER))
            delete = now == DELETE + after[state, column]
            insert = ~delete & (now == INSERT + here[onwards, column])
            keep = ~delete & ~insert & fits & (now == extra + after[kept, column])
            letters[3 * t + k] = np.where(active, np.select([delete, insert, keep], [D, I, K], R), 0)
            state = np.where(active & ~delete, np.where(keep, kept, onwards), state)
            active = active & insert
    for k in range(2 if ends else 0):
        missing = (state == SYSTEM) | (state == USER)
        letters[3 * steps + k] = np.where(missing, I, 0)
        state = np.where(missing, _NEXT[state], state)
    return letters, state


def solve(initial: np.ndarray, must: np.ndarray, truncated: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(cost, edits) of each conversation; conversation j has the rows at[j] to at[j + 1]."""
    lengths = np.diff(at)
    cost, edits = np.zeros(len(lengths), np.int64), [b""] * len(lengths)
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for size in np.unique(bucket[lengths > 0]).tolist():
        every = np.flatnonzero((bucket == size) & (lengths > 0))
        for own in np.array_split(every, -(-len(every) << size >> 16) or 1):
            long = lengths[own]
            place = np.minimum(at[own] + np.arange(long.max())[:, None], at[own] + long - 1)
            rows = initial[place], must[place], truncated[place]
            costs = backward(*rows, long, np.repeat(_END[:, None], len(own), 1))
            letters, _ = trace(costs, *rows, long, np.zeros(len(own), np.int64), True)
            cost[own] = costs[0, START]
            for j, line in zip(own.tolist(), letters.T):
                edits[j] = line[line > 0].tobytes()
    return cost, edits


def repaired(edits: bytes, state: int, initial: np.ndarray, roles: list[str], texts: list[str]) -> list[str]:
    """The rows `role:text` that the edits leave."""
    out, row = [], 0
    for edit in edits:
        if edit == D:
            row += 1
            continue
        onwards = int(_NEXT[state])
        added = "assistant" if onwards == ASSISTANT else "user"
        if edit == I:
            out.append(f"{added}:")
        else:
            out.append(f"{roles[row] if edit == K else added}:{texts[row]}")
            onwards = SYSTEM if edit == K and initial[row] == SYSTEM else onwards
            row += 1
        state = onwards
    return out


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[at])


def _illegal(initial: np.ndarray) -> np.ndarray:
    """Whether a row may not follow the one before it."""
    pairs = 4 * initial[:-1] + initial[1:]
    return np.append(False, ~np.isin(pairs, [4 * SYSTEM + USER, 4 * USER + ASSISTANT, 4 * ASSISTANT + USER]))[: len(initial)]


def _turns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column("turn").combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False), np.array(column.is_valid())


def repair_whole(rows: pa.Table, starts: np.ndarray, n_rows: int) -> pa.Table:
    """RESULT of whole conversations, which begin at starts and follow one another."""
    convs = rows.column("conv_id").take(pa.array(starts))
    stay = ~rows.column("gone").combine_chunks().to_numpy(zero_copy_only=False)
    at = np.append(0, np.cumsum(stay))[np.append(starts, n_rows)]
    rows = rows.filter(pa.array(stay))
    f = features(rows)
    again = repeats(f["h1"], f["h2"]) & ~f["blank"]
    cut = f["truncated"] & ~again
    cost, edits = solve(f["initial"], f["blank"] | again, cut, at)
    first = np.zeros(len(stay) + 1, bool)
    first[at[:-1]] = True
    turn, known = _turns(rows)
    new = np.append(True, (turn[1:] != turn[:-1]) | ~known[:-1])[: len(turn)] | first[: len(turn)]
    gaps = []
    distinct = _sums(known & new, at)
    for j, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        a += int((~known[a:b]).sum())  # nulls come first
        gaps.append(int(turn[b - 1]) - int(turn[a]) + 1 - int(distinct[j]) if b > a else 0)
    roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
    digests = []
    for a, b, e in zip(at[:-1].tolist(), at[1:].tolist(), edits):
        digests.append(hashlib.sha256("\n".join(repaired(e, START, f["initial"][a:b], roles[a:b], texts[a:b])).encode()).hexdigest())
    illegal = _sums(_illegal(f["initial"]) & ~first[: len(turn)], at)
    made = [gaps, _sums(f["blank"], at), _sums(again, at), _sums(cut, at), illegal, cost]
    return pa.table([convs, *(pa.array(x, pa.int64()) for x in made), pa.array([e.decode() for e in edits]), pa.array(digests)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])


def _structs(made: pa.Table, like: pa.DataType) -> pa.Array:
    made = made.combine_chunks()
    return pa.StructArray.from_arrays([pa.concat_arrays(made.column(f.name).chunks or [pa.array([], f.type)]).cast(f.type) for f in like], fields=list(like))


def split(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """SPLIT: of sorted rows, the repair of each conversation that lies within the task and is of one segment, and the rows of the others."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    whole_type, part_type = (pa.struct([(n, kinds[k]) for n, k in (f.split(" ") for f in schema.split(", "))]) for schema in (RESULT, ROWS))
    segment = TaskContext.get().partitionId() << 32
    carry: pa.Table | None = None
    cut = True  # the conversation in hand may have begun in the task before

    def both(whole: pa.Array | None, part: pa.Array | None) -> pa.RecordBatch:
        n = len(whole if whole is not None else part)
        return pa.RecordBatch.from_arrays([whole if whole is not None else pa.nulls(n, whole_type), part if part is not None else pa.nulls(n, part_type)], ["whole", "part"])

    def parted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """rows of one conversation as segments."""
        nonlocal segment
        sizes = np.cumsum(np.diff(kernel.text_bytes(rows.column("text"))[1]))
        a = 0
        while a < len(rows):
            b = max(a + 1, min(a + most_rows, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most_bytes, side="right"))))
            own = rows.slice(a, b - a)
            made = own.append_column("seg", pa.array(np.full(b - a, segment, np.int64))).append_column("at", pa.array(np.arange(b - a, dtype=np.int32)))
            for name, values in features(own).items():
                made = made.append_column(name, pa.array(values))
            yield both(None, _structs(made, part_type))
            segment += 1
            a = b

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", rows.column("text").cast(pa.large_string()))
        rows = pa.concat_tables([carry, rows]).combine_chunks() if carry is not None else rows
        if not len(rows):
            continue
        conv = rows.column("conv_id").combine_chunks()
        value, known = conv.fill_null(0).to_numpy(), np.array(conv.is_valid())
        starts = np.append(0, np.flatnonzero((value[1:] != value[:-1]) | (known[1:] != known[:-1])) + 1)
        open_at = int(starts[-1])  # the last conversation may go on
        done = starts[:-1]
        if cut and len(done):
            yield from parted(rows.slice(0, int(starts[1])))
            done, cut = done[1:], False
        if len(done):
            sizes = np.diff(np.append(done, open_at))
            text_at = kernel.text_bytes(rows.column("text"))[1]
            large = (sizes > most_rows) | (text_at[done + sizes] - text_at[done] > most_bytes)
            for a, n in zip(done[large].tolist(), sizes[large].tolist()):
                yield from parted(rows.slice(a, n))
            small = np.zeros(len(rows), bool)
            small[np.concatenate([np.arange(a, a + n) for a, n in zip(done[~large].tolist(), sizes[~large].tolist())] or [np.zeros(0, int)])] = True
            begin = np.cumsum(sizes[~large]) - sizes[~large]
            if len(begin):
                yield both(_structs(repair_whole(rows.filter(pa.array(small)), begin, int(small.sum())), whole_type), None)
        carry = rows.slice(open_at).combine_chunks()
        if len(carry) >= most_rows or carry.column("text").nbytes >= most_bytes:
            yield from parted(carry)
            carry, cut = carry.slice(0, 0), True
    if carry is not None and len(carry):
        yield from parted(carry)


# segments of conversations that are cut

def _sorted(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A segment's rows that are left, in order, and initial, must and truncated, [row, 1]."""
    rows = group.filter(pc.invert(group.column("gone"))).sort_by("at").combine_chunks()
    flags = [rows.column(c).to_numpy() for c in ("initial", "blank", "duplicate", "truncated")]
    initial, blank, duplicate, truncated = (x.astype(bool) if k else x for k, x in enumerate(flags))
    return rows, initial[:, None], (blank | duplicate)[:, None], (truncated & ~duplicate)[:, None]


def _tables(group: pa.Table) -> pa.Table:
    """TABLES of a segment: the costs from each state to each, and what its counts and borders are."""
    seg, conv = group.column("seg")[0].as_py(), group.column("conv_id")[0].as_py()
    rows, initial, must, cut = _sorted(group)
    n = len(rows)
    end = np.where(np.eye(4, dtype=bool), 0, _INF)
    costs = backward(*(np.repeat(x, 4, 1) for x in (initial, must, cut)), np.full(4, n), end)[0]
    turn, known = _turns(rows)
    turns = int((known & np.append(True, (turn[1:] != turn[:-1]) | ~known[:-1])[:n]).sum())
    out = {
        "conv_id": conv, "seg": seg, "costs": np.minimum(costs, _INF).reshape(-1).tolist(), "n": n, "blank": int(rows.column("blank").to_numpy().sum()), "duplicate": int(rows.column("duplicate").to_numpy().sum()), "truncated": int(cut.sum()),
        "illegal": int(_illegal(initial[:, 0]).sum()), "first": int(initial[0, 0]) if n else None, "last": int(initial[-1, 0]) if n else None, "least": int(turn[known].min()) if known.any() else None, "most": int(turn[known].max()) if known.any() else None, "turns": turns,
    }
    kinds = {"costs": pa.list_(pa.int64()), "first": pa.int32(), "last": pa.int32()}
    return pa.table({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in out.items()})


def _along(group: pa.Table) -> pa.Table:
    """From the tables of a conversation's segments: the costs that each segment meets at its end, and the conversation's counts, which stand at its first."""
    found = group.sort_by("seg").to_pylist()
    total = dict.fromkeys(COUNTS, 0)
    ends, cost = [], _END
    for row in reversed(found):
        ends.append(cost.tolist())
        cost = np.minimum(np.array(row["costs"]).reshape(4, 4) + cost, _INF).min(1)
    turns, last, most, least = 0, None, None, None
    for row in found:
        for c in ("blank", "duplicate", "truncated", "illegal"):
            total[c] += row[c]
        if row["n"]:
            total["illegal"] += last is not None and bool(_illegal(np.array([last, row["first"]]))[1])
            last = row["last"]
        if row["least"] is not None:
            turns += row["turns"] - (row["least"] == most)
            least, most = row["least"] if least is None else least, row["most"]
    total |= {"gaps": most - least + 1 - turns if most is not None else 0, "cost": int(cost[START])}
    out = [{"conv_id": r["conv_id"], "seg": r["seg"], "end": e, "head": k == 0} | (total if k == 0 else {}) for k, (r, e) in enumerate(zip(found, reversed(ends)))]
    kinds = {"end": pa.list_(pa.int64()), "head": pa.bool_()}
    return pa.table({c: pa.array([r.get(c) for r in out], kinds.get(c, pa.int64())) for c in ("conv_id", "seg", "end", "head", *COUNTS)})


def _exits(group: pa.Table) -> pa.Table:
    """The state in which a segment is left from each state in which it may be entered."""
    _, *rows = _sorted(group)
    rows = [np.repeat(x, 4, 1) for x in rows]
    lengths = np.full(4, len(rows[0]))
    costs = backward(*rows, lengths, np.repeat(np.array(group.column("end")[0].as_py())[:, None], 4, 1))
    state = trace(costs, *rows, lengths, np.arange(4), False)[1]
    return pa.table({"conv_id": group.column("conv_id")[:1], "seg": group.column("seg")[:1], "exits": pa.array([state.tolist()], pa.list_(pa.int64()))})


def _entries(group: pa.Table) -> pa.Table:
    rows, state = group.sort_by("seg"), START
    entered = []
    for exits in rows.column("exits").to_pylist():
        entered.append(state)
        state = exits[state]
    last = [False] * (len(rows) - 1) + [True]
    return pa.table({"seg": rows.column("seg"), "entry": pa.array(entered, pa.int32()), "tail": pa.array(last)})


def _pieces(group: pa.Table) -> pa.Table:
    """A segment's edits and repaired text."""
    rows, *flags = _sorted(group)
    entry, tail = group.column("entry")[0].as_py(), group.column("tail")[0].as_py()
    lengths = np.full(1, len(rows))
    costs = backward(*flags, lengths, np.array(group.column("end")[0].as_py())[:, None])
    letters, _ = trace(costs, *flags, lengths, np.array([entry]), tail)
    edits = letters[letters > 0].tobytes()
    lines = repaired(edits, entry, flags[0][:, 0], rows.column("role").to_pylist(), rows.column("text").to_pylist())
    return pa.table({"conv_id": group.column("conv_id")[:1], "seg": group.column("seg")[:1], "edits": pa.array([edits.decode()]), "body": pa.array(["\n".join(lines) if lines else None], pa.string())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, audit, repaired_sha256) from pieces in order, of which only one conversation's digest and edits are held."""
    none = object()
    now, digest, edits, begun = none, hashlib.sha256(), [], False

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array(["".join(edits)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

    for batch in batches:
        for conv, piece, body in zip(batch.column("conv_id").to_pylist(), batch.column("edits").to_pylist(), batch.column("body")):
            if now is none or conv != now:
                if now is not none:
                    yield told()
                now, digest, edits, begun = conv, hashlib.sha256(), [], False
            edits.append(piece)
            if body.is_valid:
                digest.update((b"\n" if begun else b"") + body.as_py().encode())
                begun = True
    if now is not none:
        yield told()


def repair_parts(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """RESULT of the conversations whose rows (ROWS) are in segments. Whether a row repeats an earlier one is found by its place in a join by digest and
    place, so that equal rows, however many, are dealt by their places."""
    first = parts.where("NOT gone AND NOT blank").groupBy("h1", "h2").agg(F.min(F.struct("seg", "at")).alias("p")).select("h1", "h2", "p.seg", "p.at", F.lit(True).alias("first"))
    flagged = scratch.keep(parts.join(first, ["h1", "h2", "seg", "at"], "left").withColumn("duplicate", F.col("first").isNull() & ~F.col("blank") & ~F.col("gone")).drop("first", "h1", "h2"))
    thin = flagged.select("conv_id", "seg", "at", "turn", "gone", "initial", "blank", "duplicate", "truncated")
    along = scratch.keep(thin.groupBy("seg").applyInArrow(_tables, TABLES).groupBy("conv_id").applyInArrow(_along, "conv_id long, seg long, end array<long>, head boolean, " + ", ".join(f"{c} long" for c in COUNTS)))
    ends = along.select("seg", "end")
    entries = thin.join(ends, "seg").groupBy("seg").applyInArrow(_exits, "conv_id long, seg long, exits array<long>").groupBy("conv_id").applyInArrow(_entries, "seg long, entry int, tail boolean")
    pieces = flagged.join(ends, "seg").join(scratch.keep(entries), "seg").groupBy("seg").applyInArrow(_pieces, "conv_id long, seg long, edits string, body string")
    digests = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")
    counts = along.where("head").select(F.col("conv_id").alias("c"), *COUNTS)
    return digests.join(counts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """RESULT of each conversation of rows (conv_id, turn, role, text, gone)."""
    scratch = Scratch(rows.sparkSession, "repair")
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text")]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt")
    found = scratch.keep(dealt.select("conv_id", "turn", "role", "text", "gone").mapInArrow(lambda batches: split(batches, segment_rows, segment_bytes), SPLIT))
    return found.where("whole IS NOT NULL").select("whole.*").unionByName(repair_parts(found.where("part IS NOT NULL").select("part.*"), scratch))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def _sql() -> str:
    """The same in SQL: a recursion from each conversation's end, whose rows hold, for each state, the cheapest and least way on, {cost, edits, text}."""
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda e, k: xor(e >> 1, (e & 1) * 3988292384::BIGINT))"
    crc = f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}))"
    way = lambda cost, edit, line, on: f"{{'c': {cost} + {on}.c, 'e': '{edit}' || {on}.e, 't': {f'chr(10) || {line} || ' if line else ''}{on}.t}}"
    after = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
    name = {USER: "user", ASSISTANT: "assistant"}

    def options(state: int) -> str:
        onwards = after[state]
        found = [way(DELETE, "D", "", f"s{state}"), f"CASE WHEN NOT must THEN {way(f'{REROLE} + {TRUNCATED} * cut', 'R', f"'{name[onwards]}:' || text", f's{onwards}')} END"]
        fits = [("s", SYSTEM)] if state == START else []
        fits += [("a", ASSISTANT)] if state == USER else [("u", USER)]
        found += [f"CASE WHEN NOT must AND initial = '{i}' THEN {way(f'{TRUNCATED} * cut', 'K', "role || ':' || text", f's{to}')} END" for i, to in fits]
        return f"list_min([{', '.join(found)}]) AS o{state}"

    better = lambda own, on, to: f"list_min([{own}, {way(INSERT, 'I', f"'{name[to]}:'", on)}])"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (
  SELECT *, {crc} % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, i, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kinds, range(1, 3) AS r(i) WHERE kind <> 0 AND (i = 1 OR kind = 3)
), placed AS (
  SELECT *, left(role, 1) AS initial, trim(text, {ws}) AS solid, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, i) AS n FROM damaged
), seen AS (
  SELECT *, solid = '' AS blank, solid <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM placed
), judged AS (
  SELECT *, blank OR again AS must, (NOT blank AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?'))::INT AS cut FROM seen
), ways AS (
  SELECT conv_id, max(n) + 1 AS n, {{'c': 0::BIGINT, 'e': '', 't': ''}} AS s0, {{'c': {2 * INSERT}::BIGINT, 'e': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s1, {{'c': {INSERT}::BIGINT, 'e': 'I', 't': chr(10) || 'assistant:'}} AS s2, {{'c': 0::BIGINT, 'e': '', 't': ''}} AS s3 FROM judged GROUP BY conv_id
  UNION ALL
  SELECT conv_id, n, {better("o0", "b2", USER)}, {better("o1", "b2", USER)}, b2, b3 FROM (
    SELECT *, {better("o2", "o3", ASSISTANT)} AS b2, {better("o3", "o2", USER)} AS b3 FROM (
      SELECT w.conv_id, j.n, {', '.join(map(options, range(4)))} FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.n = w.n - 1))
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, sum(cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.s0.c, 0)::BIGINT AS cost, coalesce(w.s0.e, '') AS audit, sha256(coalesce(substr(w.s0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM k.conv_id AND w.n = 1
"""


ORACLE_SQL = _sql()
