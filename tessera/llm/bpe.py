"""Byte-level BPE over whole Arrow batches: overlapping chunks are split into pre-tokens, stitched, and the distinct pre-tokens encoded once.

The split follows the public pattern of byte-level BPE (contractions; runs of letters, numbers or other marks, each
with one space before it; white space that leaves its last character to what follows). Code points that this interpreter's Unicode table does not
assign, or whose class has changed, are left to the tokenizer library, which then encodes that whole text.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np

from tessera.llm.kernel import mix

U = np.uint64
LETTER, NUMBER, OTHER, BLANK, UNSURE = range(5)
#: White space of the Unicode standard.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = U(0xD6E8FEB86659FD93)
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point; UNSURE where it is not assigned, or was of another class in Unicode 3.2."""
    global _classes
    if _classes is None:
        old = unicodedata.ucd_3_2_0
        of = lambda kind: {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
        kinds = np.full(0x110000, UNSURE, np.uint8)
        for point in range(0x110000):
            now, then = unicodedata.category(chr(point)), old.category(chr(point))
            if now in ("Co", "Cs") or now != "Cn" and (then == "Cn" or of(then) == of(now)):
                kinds[point] = of(now)
        kinds[WHITE_SPACE] = BLANK
        kinds[[0x180E]] = UNSURE
        _classes = kinds
    return _classes


def token_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True where a pre-token begins. points: code points of all rows end to end; rows: where each non-empty row begins, ascending."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    row_start = np.zeros(n, bool)
    row_start[rows] = True
    blank = kind == BLANK
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    after_space = np.zeros(n, bool)
    after_space[1:] = points[:-1] == 32
    start &= ~(after_space & ~blank)
    last_blank = blank.copy()  # the last white space of a run goes with what follows in the row, if anything does
    last_blank[:-1] &= ~blank[1:] & ~row_start[1:]
    last_blank[-1] = False
    start |= last_blank | row_start
    marks = np.flatnonzero((points == 39) & start)
    if len(marks):
        padded = np.append(points, [0, 0, 0]).astype(np.int64)
        ends = np.append(row_start, [True, True, True])
        one = padded[marks + 1]
        two = padded[marks + 2]
        here = ~ends[marks + 1]
        both = here & ~ends[marks + 2]
        short = here & np.isin(one, [ord(c) for c in "stmd"])
        long = both & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for found, length in ((marks[short], 1), (marks[long & ~short], 2)):
            start[found + 1] = False
            after = found + 1 + length
            after = after[after < n]
            start[after[(kind[after] == LETTER)]] = True
    return start


def stitched_starts(texts: list[str], chunk: int = 1 << 16, overlap: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, token starts, row offsets) of the texts, from chunks that are split side by side and overlap.

    A split that begins anywhere falls into step with the split of the whole text at the first boundary that both have, since
    the pattern looks back at nothing; boundaries near a chunk's own end are not trusted, since it looks ahead. Where two chunks share no
    trusted boundary in their overlap, the pair is split again as one chunk.
    """
    if not 8 < overlap <= chunk:
        raise ValueError("overlap must be over 8 and at most chunk")
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    at = np.append(0, np.cumsum(lengths))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = [at[:-1][lengths > 0]]
    long_rows = np.flatnonzero(lengths > chunk + overlap)
    if not len(long_rows):
        return points, token_starts(points, begins[0]), at
    short = np.ones(len(texts), bool)
    short[long_rows] = False
    spans = [(int(at[i]), int(at[i + 1])) for i in np.flatnonzero(short & (lengths > 0))]
    pieces: list[tuple[int, int, int]] = []
    for i in long_rows:
        a, b = int(at[i]), int(at[i + 1])
        cuts = list(range(a, b, chunk))
        pieces += [(int(i), s, min(s + chunk + overlap, b)) for s in cuts]
    spans_all = spans + [(s, e) for _, s, e in pieces]
    joined = np.concatenate([points[s:e] for s, e in spans_all])
    sizes = np.array([e - s for s, e in spans_all], np.int64)
    where = np.append(0, np.cumsum(sizes))
    flags = token_starts(joined, where[:-1])
    out = np.zeros(len(points), bool)
    for k, (s, e) in enumerate(spans):
        out[s:e] = flags[where[k] : where[k + 1]]
    parts = [(i, s, e, flags[where[len(spans) + k] : where[len(spans) + k + 1]]) for k, (i, s, e) in enumerate(pieces)]
    for _, group in itertools.groupby(parts, key=lambda p: p[0]):
        mine = list(group)
        _, done, end, now = mine[0]
        out[done:end] = now
        for _, s, e, nxt in mine[1:]:
            common = np.flatnonzero(now[s - done : max(s - done, end - done - 8)] & nxt[: max(0, end - s - 8)])
            common = common[common > 0]  # a chunk's own first place is always a start
            if len(common):
                out[s + common[0] : e] = nxt[common[0] :]
                done, end, now = s + int(common[0]), e, nxt[common[0] :]
            else:
                now = token_starts(points[done:e], np.zeros(1, np.int64))
                out[done:e] = now
                end = e
    return points, out, at


class PieceCache:
    """Ids of pre-tokens by their hash, in an open-addressed table that starts anew when it is full (bounded memory).

    Two pre-tokens of one length share a 64-bit hash with a probability of about 2**-64.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], bits: int = 21):
        self.encode, self.size = encode, 1 << bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.size, U)
        self.slots = np.zeros(self.size, np.int64)
        self.used, self.filled = 0, 0
        self.begin = np.zeros(self.size, np.int64)
        self.count = np.zeros(self.size, np.int64)
        self.ids = np.zeros(1 << 20, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where there is none."""
        found = np.full(len(keys), -1, np.int64)
        place = (keys & U(self.size - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[place]
            hit = there == keys[left]
            found[left[hit]] = self.slots[place[hit]]
            go = ~hit & (there != 0)
            left, place = left[go], (place[go] + 1) & (self.size - 1)
        return found

    def _add(self, keys: np.ndarray, encoded: list[list[int]]) -> None:
        counts = np.fromiter((len(x) for x in encoded), np.int64, len(encoded))
        flat = np.fromiter((i for x in encoded for i in x), np.int32, int(counts.sum()))
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), np.int32))
        self.ids[self.filled : self.filled + len(flat)] = flat
        new = np.arange(self.used, self.used + len(keys))
        self.begin[new] = self.filled + np.cumsum(counts) - counts
        self.count[new] = counts
        self.filled += len(flat)
        self.used += len(keys)
        place = (keys & U(self.size - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[place] == 0
            slots, first = np.unique(place[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[slots] = keys[left[chosen]]
            self.slots[slots] = new[left[chosen]]
            stay = np.ones(len(left), bool)
            stay[chosen] = False
            left, place = left[stay], place[stay]
            place = np.where(self.keys[place] != 0, (place + 1) & (self.size - 1), place)

    def ids_of(self, texts: list[str], chunk: int = 1 << 16, overlap: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts)."""
        points, start, at = stitched_starts(texts, chunk, overlap)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = np.flatnonzero(start)
        lengths = np.diff(np.append(starts, len(points)))
        place = np.arange(len(points)) - np.repeat(starts, lengths)
        powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE, U))
        values = (points.astype(U) + U(1)) * powers[place]
        keys = mix(np.add.reduceat(values, starts) ^ (lengths.astype(U) << U(40)))
        keys[keys == 0] = 1
        entry = self.find(keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            if self.used + len(first) > self.size // 2:
                self.clear()
                if len(first) > self.size // 2 and len(texts) > 1:
                    half = len(texts) // 2
                    a, b = self.ids_of(texts[:half], chunk, overlap), self.ids_of(texts[half:], chunk, overlap)
                    return np.append(a[0], b[0]), np.append(a[1], a[1][-1] + b[1][1:])
                _, first = np.unique(keys, return_index=True)
                while len(first) > self.size // 2:
                    self.size *= 2
                    self.clear()
            raw = points.tobytes()
            pieces = [raw[4 * s : 4 * e].decode("utf-32-le", "surrogatepass") for s, e in zip(starts[first].tolist(), (starts[first] + lengths[first]).tolist())]
            self._add(keys[first], list(self.encode(pieces)))
            entry = self.find(keys)
        counts = self.count[entry]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.begin[entry] - (ends - counts), counts) + np.arange(int(ends[-1]))]
        tokens_before = np.append(0, ends)[np.searchsorted(starts, at)]
        return ids, tokens_before


def merged(piece: bytes, ranks: dict[bytes, int], short: int = 40) -> list[int]:
    """Ids of a pre-token: of neighbours whose union has a rank, those with the lowest are joined, the first of equal ones, until none has one.

    Short pieces look at all neighbours each time; longer ones keep them in a heap, so that very long ones take n log n steps.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= short:
        parts = [piece[i : i + 1] for i in range(n)]
        found = [ranks.get(piece[i : i + 2]) for i in range(n - 1)]
        while True:
            best = min((r for r in found if r is not None), default=None)
            if best is None:
                return [ranks[x] for x in parts]
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i + 1 < len(parts):
                found[i] = ranks.get(parts[i] + parts[i + 1])
    end, before, ahead = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))  # by where a part begins
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = ahead[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been joined since
        end[i], alive[j], ahead[i] = stop, False, ahead[j]
        if ahead[j] < n:
            before[ahead[j]] = i
        for left in (before[i], i):
            if left >= 0 and ahead[left] < n:
                to = end[ahead[left]]
                rank = ranks.get(piece[left:to])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, to))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


_SURE_CUT = re.compile(r"(?<=[a-z])(?= [a-z])")


def segments(text: str, limit: int) -> list[str]:
    """Parts of a very long text, cut where a pre-token surely begins (a space between letters); a part is longer than limit where there is no such place."""
    parts, a = [], 0
    while len(text) - a > limit:
        cut = _SURE_CUT.search(text, a + limit)
        if not cut:
            break
        parts.append(text[a : cut.start()])
        a = cut.start()
    return [*parts, text[a:]]


def batch_ids(cache: PieceCache, whole: Callable[[str], list[int]], texts: list[str], chunk: int = 1 << 16, overlap: int = 512, limit: int = 1 << 20) -> list[np.ndarray]:
    """Ids of each text, about limit characters at a time; texts with code points of an unsure class go whole to the library."""
    kinds = classes()
    out: list[list[np.ndarray]] = [[] for _ in texts]
    waiting: list[tuple[int, str]] = []

    def flush() -> None:
        ids, at = cache.ids_of([t for _, t in waiting], chunk, overlap)
        for (i, _), a, b in zip(waiting, at[:-1].tolist(), at[1:].tolist()):
            out[i].append(ids[a:b])
        waiting.clear()

    size = 0
    for i, text in enumerate(texts):
        if not text.isascii() and (kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == UNSURE).any():
            out[i].append(np.array(whole(text), np.int32))
            continue
        for part in segments(text, limit):
            waiting.append((i, part))
            size += len(part)
            if size >= limit:
                flush()
                size = 0
    flush()
    return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int32), *x]) for x in out]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
