"""The repair of conversations against a search of all edits, row by row."""

import collections
import functools
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op13_repair as repair

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """(cost, edits, roles) by trying every edit of every row; rows: (initial, must go, truncated)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @functools.lru_cache(None)
    def best(k, state, inserted=0):
        options = []
        if k == len(rows) and state in ("", "a"):
            options.append((0, ""))
        if inserted < 3:
            options += [(5 + c, "I" + e) for r in "ua" if r in after[state] for c, e in [best(k, r, inserted + 1)]]
        if k < len(rows):
            initial, must, cut = rows[k]
            c, e = best(k + 1, state)
            options.append((2 + c, "D" + e))
            if not must:
                if initial in after[state]:
                    c, e = best(k + 1, initial)
                    options.append((5 * cut + c, "K" + e))
                for r in "ua":
                    if r in after[state]:
                        c, e = best(k + 1, r)
                        options.append((1 + 5 * cut + c, "R" + e))
        return min(options, default=(1 << 40, ""))

    for k in range(len(rows), 0, -100):  # from the end, so that no call goes deep
        for state in after:
            best(k, state)
    return best(0, "")


def brute(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        seen, judged, counts = set(), [], collections.Counter()
        for _, role, text in own:
            solid = text.strip(SPACE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, edits = cheapest(tuple(judged))
        state, k, lines = "", 0, []
        for e in edits:
            if e == "D":
                k += 1
                continue
            role = "assistant" if state == "u" else "user"
            if e == "K":
                role = own[k][1]
            lines.append(f"{role}:{'' if e == 'I' else own[k][2]}")
            k += e != "I"
            state = role[0]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, n_convs, most):
    r = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "and then", " \n", "", None, "Why?  ", "é…", "x" * 300 + ".", "half a", "One more."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "ultra", "U"]
    rows = []
    for conv in range(n_convs):
        turn = int(r.integers(0, 3))
        for _ in range(int(r.integers(0, most)) + 1):
            rows.append((None if conv == 3 else conv, None if r.random() < 0.05 else turn, roles[int(r.integers(0, 5 if r.random() < 0.7 else 10))], texts[int(r.integers(0, len(texts)))] if r.random() < 0.6 else f"No. {int(r.integers(0, 999))}{'.' if r.random() < 0.7 else ''}"))
            turn += int(r.random() < 0.9) + 2 * int(r.random() < 0.1)
    return rows + rows[5:9]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("seg"), F.lit("x").alias("gone"), F.lit(0).alias("blank"), F.lit(3).alias("times")).repartition(5)


def got(frame):
    assert frame.columns == COLUMNS
    found = [tuple(r) for r in frame.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


@pytest.mark.parametrize("segment", [repair.SEGMENT_ROWS, 3])
def test_repairs_cost_least(spark, segment):
    rows = made(segment, 150, 14)
    assert got(repair.repair(repair.damage(table(spark, rows)), segment)) == brute(rows)


def test_a_long_conversation_is_cut_anywhere(spark):
    rows = made(11, 1, 400) + [(7, t, "user", "Same.") for t in range(300)] + [(8, 0, "assistant", "x" * 100 + ".")] * 30 + made(12, 9, 6)
    found = got(repair.repair(repair.damage(table(spark, rows)), 16, 800))
    assert found == brute(rows) and found == got(repair.repair(repair.damage(table(spark, rows))))


def test_conversations_that_lose_all_rows_and_empty_tables(spark):
    dropped = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert dropped and set(got(repair.repair(repair.damage(table(spark, dropped)))).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(repair.repair(repair.damage(table(spark, dropped).limit(0)))) == {}


def test_ties_take_the_least_letter():
    initial, must, cut = (np.array(x)[:, None] for x in ([2, 2], [False, False], [False, False]))
    cost, edits = repair.solve(initial[:, 0], must[:, 0], cut[:, 0], np.array([0, 2]))
    assert cost.tolist() == [1] and edits == [b"KR"]
    assert repair.solve(np.zeros(0, int), np.zeros(0, bool), np.zeros(0, bool), np.array([0, 0]))[1] == [b""]
