"""Operator 10: exact n-gram Jaccard join in metric space.

A document is its set of word n-grams, held as 64-bit hashes. Sets link when the Jaccard distance 1 - |A & B| / |A u B| is at most eps. Four steps:

1. Copies. Rows with equal sets (a 128-bit sum over the set) are one class.
2. Regions. The distance of unrelated sets is 1 whatever the pivot, so pivots that are documents cannot part a corpus; its first regions come from
   two other reference points of the symmetric-difference metric D(A, B) = |A xor B|. Around the empty set, D is the set's size: sizes form rings,
   and by the triangle inequality sets that link differ in size by at most D, so a set near its ring's rim is replicated to the next ring.
   In a ring the space of hashes is cut into m slices, D is the sum of the slices' own D, and as m exceeds every D of a linked pair, such
   sets agree on a slice: a region holds the sets of a ring that have the same content of one slice. Sets so small that they
   might agree on empty slices alone also get regions by their first hashes, of which linked sets have one in common.
3. Pivots. In each region the smallest id is the pivot. The regions of the first NAMING slices name a set's pivots, and it is compared with the
   nearest, the one it shares most of these with. Tasks combine before they shuffle: they send one member of a region on, as their own
   pivot for those that stay. This labels most copies; a region whose members have one label is done. NAMING only decides who is compared first.
4. Recursion. All regions of sets with two labels at least are joined in tasks, those with one pivot together: pivots form Voronoi cells, a set
   goes to its nearest pivot's cell and also to every cell whose pivot is at most 2 eps farther, which is what the triangle inequality asks for,
   and cells are joined by the same rule until they are small. More than cell_cap sets are dealt as pairs of blocks, those of one label alone left
   out, so that a task's memory is bounded and no pair is lost.

Components follow from the links by distributed label propagation (tessera.llm.components).

Null texts and texts without words have the empty set, which links with nothing, not even its equals. Rows that repeat a doc_id each keep their own
set; they share that id's links. Rows with a null doc_id get a null component. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import Scratch, table
from tessera.llm.components import components

U = np.uint64
NAMING = 6
MARK_PARTS = 64
_K = [kernel.mix(np.array([i], U) * U(0x9E3779B97F4A7C15))[0] | U(1) for i in range(101, 107)]


class Rings:
    """Rings of set sizes and their slices, for links of similarity num / den or more."""

    def __init__(self, num: int, den: int, ratio: float = 1.25, first: int = 2, last: int = 1 << 40):
        self.num, self.den = num, den
        bounds = [first]
        while bounds[-1] < last:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * ratio)))
        self.bounds = np.array(bounds, np.int64)  # ring i: bounds[i] <= size < bounds[i + 1]
        most = (den - num) * 2 * (self.bounds[1:] - 1) // (den + num)
        self.slices = np.maximum(2, (most * 11 + 9) // 10 + 1)

    def ring(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, size, side="right") - 1

    def largest_partner(self, size: np.ndarray) -> np.ndarray:
        return size * self.den // self.num

    def most_apart(self, size: np.ndarray) -> np.ndarray:
        """The largest D of a set of that size and a set that it links with."""
        return (self.den - self.num) * (size + self.largest_partner(size)) // (self.den + self.num)


def regions(h: np.ndarray, at: np.ndarray, rings: Rings) -> tuple[np.ndarray, np.ndarray]:
    """(region, row) of each set, sets being ascending hashes h[at[i]:at[i + 1]]. The regions of the first NAMING slices are odd numbers.

    Linked sets that agree on empty slices alone differ on all others, so each has at most as many of those as a linked pair can differ by; such sets
    are small, and of their first n - ceil(similarity * n) + 1 hashes the other has one at least among its own.
    """
    size = np.diff(at)
    apart = rings.most_apart(size)
    home, rim = rings.ring(size), rings.ring(rings.largest_partner(size))
    out_key, out_row = [], []
    for step in range(int((rim - home).max(initial=0)) + 1):
        rows = np.flatnonzero((size > 1) & (apart > 0) & (home + step <= rim))
        if not len(rows):
            continue
        ring = home[rows] + step
        m = rings.slices[ring].astype(U)
        counts = size[rows]
        ends = np.cumsum(counts)
        index = np.repeat(at[:-1][rows] - (ends - counts), counts) + np.arange(int(ends[-1]))
        own = h[index]
        owner = np.repeat(np.arange(len(rows)), counts)
        slice_ = ((own >> U(32)) * m[owner]) >> U(32)  # ascending within a set
        first = np.append(True, (owner[1:] != owner[:-1]) | (slice_[1:] != slice_[:-1]))
        starts = np.flatnonzero(first)
        content = np.add.reduceat(kernel.mix(own ^ _K[0]), starts)
        o, s = owner[starts], slice_[starts]
        key = kernel.mix(content + ring.astype(U)[o] * _K[1] + s * _K[2] + _K[3])
        out_key.append(np.where(s < U(NAMING), key | U(1), key & ~U(1)))
        out_row.append(rows[o])
        few = rows[np.bincount(o, minlength=len(rows)) <= apart[rows]]
        n = size[few] - (size[few] * rings.num + rings.den - 1) // rings.den + 1
        owner, begin = np.repeat(few, n), np.repeat(np.cumsum(n) - n, n)
        out_key.append(kernel.mix(h[at[:-1][owner] + np.arange(len(owner)) - begin] + (home[owner] + step).astype(U) * _K[1] + _K[4]) & ~U(1))
        out_row.append(owner)
    if not out_key:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(out_key), np.concatenate(out_row)


def _spokes(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of its region, number of its region) when sorted by region and id; the first of a region is its pivot."""
    order = np.lexsort((node, key))
    k = key[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    return order, new, np.cumsum(new) - 1


def _pairs(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (member, pivot) of naming regions, how many of these they share; then all regions, their pivots, whether they have other members."""
    order, new, number = _spokes(key, node)
    k, v = key[order], node[order]
    pivot = v[new][number] if len(v) else v
    other = v != pivot
    named = other & ((k & U(1)) == 1)
    a, b = v[named], pivot[named]
    shared_ = np.bincount(number[other], minlength=int(new.sum())) > 0
    if len(a):
        o = np.lexsort((b, a))
        a, b = a[o], b[o]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        times = np.diff(np.append(first, len(a)))
        a, b = a[first], b[first]
    else:
        times = np.zeros(0, np.int64)
    return a, b, times, k[new], v[new], shared_


MIXED = "bucket int, kind int, a long, b long, c long, d long, payload binary"


def _rows(bucket, kind: int, a=None, b=None, c=None, d=None, payload=None) -> pa.RecordBatch:
    n = len(bucket)
    long = lambda x: pa.nulls(n, pa.int64()) if x is None else x if isinstance(x, pa.Array) else pa.array(np.asarray(x).astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(bucket, np.int32)), pa.array(np.full(n, kind, np.int32)), long(a), long(b), long(c), long(d), pa.nulls(n, pa.binary()) if payload is None else pa.array(payload, pa.binary())], ["bucket", "kind", "a", "b", "c", "d", "payload"])


def _set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; 0 for the empty set."""
    starts = at[:-1]
    out = []
    for k in (_K[4], _K[5]):
        total = np.append(U(0), np.cumsum(kernel.mix(h ^ k)))  # wraps, as sums modulo 2**64 may
        out.append((total[at[1:]] - total[starts]).view(np.int64))
    return out[0], out[1]


def _first_pass(docs: DataFrame, width: int, rings: Rings, buckets: int, flush: int = 1_500_000) -> DataFrame:
    """Kind 0: (doc_id, size, set key); kind 1: (member, pivot, shared naming regions), so at most NAMING for a member and task; kind 3: packed regions
    of several members. One shuffle of packed (region, id)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []

        def combined() -> Iterator[pa.RecordBatch]:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            keys.clear(), nodes.clear()
            a, b, times, region, pivot, others = _pairs(key, node)
            if len(a):
                yield _rows(a % buckets, 1, a, b, times)
            if others.any():
                yield _rows([int(region[0] % U(buckets))], 3, payload=[region[others].tobytes()])
            place = (region % U(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, region, pivot = place[order], region[order], pivot[order]
            there, first = np.unique(place, return_index=True)
            last = np.append(first[1:], len(place))
            yield _rows(there, 2, payload=[region[x:y].tobytes() + pivot[x:y].tobytes() for x, y in zip(first, last)])

        held = 0
        for batch in batches:
            for x, y in kernel.by_bytes(batch.column("text")):
                part = batch.slice(x, y - x)
                h, at = kernel.shingle_sets(part.column("text"), width)
                k1, k2 = _set_keys(h, at)
                yield _rows(np.abs(k1) % buckets, 0, part.column("doc_id"), np.diff(at), k1, k2)
                known = np.array(part.column("doc_id").is_valid())
                ids = part.column("doc_id").fill_null(0).to_numpy()
                key, row = regions(h, at, rings)
                ok = known[row]
                keys.append(key[ok])
                nodes.append(ids[row[ok]])
                held += len(key)
                if held >= flush:
                    yield from combined()
                    held = 0
        if keys:
            yield from combined()

    def gather(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        packed = [p for p, k in zip(group.column("payload").to_pylist(), kinds.tolist()) if k == 2]
        out = group.filter(pa.array(kinds != 2))
        if packed:
            key = np.concatenate([np.frombuffer(p, U, len(p) // 16) for p in packed])
            node = np.concatenate([np.frombuffer(p, np.int64, len(p) // 16, len(p) // 2) for p in packed])
            a, b, times, region, _, others = _pairs(key, node)
            more = pa.Table.from_batches([_rows(np.zeros(len(a), np.int32), 1, a, b, times), _rows([0], 3, payload=[region[others].tobytes()])]).cast(out.schema)
            out = pa.concat_tables([out, more])
        return out

    return docs.select("doc_id", "text").mapInArrow(spread, MIXED).groupBy("bucket").applyInArrow(gather, MIXED)


class _Marks:
    """A table of fixed size with a bit for each value's hash; it only saves work, as it may also hold bits of values that were never added."""

    def __init__(self, frame: DataFrame, column: str, bits: int = 26):
        """Adds a column's 64-bit values, or those packed in a binary column."""
        size = 1 << bits

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table_ = np.zeros(size, bool)
            for batch in batches:
                values = batch.column(0)
                found = [np.frombuffer(x, U) for x in values.to_pylist() if x] if pa.types.is_binary(values.type) else [values.to_numpy().view(U)]
                for x in found:
                    table_[_Marks.place(x, size)] = True
            parts = np.packbits(table_).reshape(MARK_PARTS, -1)
            some = np.flatnonzero(parts.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())], ["part", "t"])

        def either(group: pa.Table) -> pa.Table:
            found = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in group.column("t").to_pylist()])
            return pa.table([group.column("part").slice(0, 1), pa.array([zlib.compress(found.tobytes(), 1)], pa.binary())], ["part", "t"])

        whole = np.zeros((MARK_PARTS, size // 8 // MARK_PARTS), np.uint8)
        for row in frame.select(column).mapInArrow(marks, "part int, t binary").groupBy("part").applyInArrow(either, "part int, t binary").collect():  # MARK_PARTS rows
            whole[row["part"]] = np.frombuffer(zlib.decompress(row["t"]), np.uint8)
        self.size, self.sent = size, frame.sparkSession.sparkContext.broadcast(zlib.compress(whole.tobytes(), 1))

    @staticmethod
    def place(values: np.ndarray, size: int) -> np.ndarray:
        return (kernel.mix(values) % U(size)).astype(np.int64)

    def load(self) -> np.ndarray:
        """The marks, eight to a byte."""
        return np.frombuffer(zlib.decompress(self.sent.value), np.uint8)

    @staticmethod
    def found(known: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Whether the values are marked in what load() gave."""
        place = _Marks.place(values, 8 * len(known))
        return (known[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is in ids (id). The marks keep most others from the shuffle; the join keeps out the rest."""
    marks = _Marks(ids, "id")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = marks.load()
        for batch in batches:
            yield batch.filter(pa.array(_Marks.found(known, batch.column("doc_id").fill_null(0).to_numpy().view(U))))

    return docs.select("doc_id", "text").mapInArrow(likely, "doc_id long, text string").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, judged on their whole texts. pairs must be a table. Pivots of very many pairs, a bounded number, are repeated with their texts once for each
    block of members, so that neither join brings all members of one to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in kernel.by_bytes(batch.column("text_a"), 1 << 19):
                part = batch.slice(x, y - x)
                (ha, ia), (hb, ib) = kernel.shingle_sets(part.column("text_a"), width), kernel.shingle_sets(part.column("text_b"), width)
                keep = []
                for i in range(len(part)):
                    p, q = ha[ia[i] : ia[i + 1]], hb[ib[i] : ib[i + 1]]
                    both = shared(p, q)
                    keep.append(both > 0 and den * both >= num * (len(p) + len(q) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    hot = _hot(pairs.groupBy("b").agg(F.count("*").alias("times"))).select("b", F.ceil(F.col("times") / MEMBERS).alias("blocks"))
    one = lambda blocks: F.coalesce(blocks, F.lit(1).cast("long"))
    own = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    pivots = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(F.broadcast(hot), "b", "left").select("b", "text_b", F.explode(F.sequence(F.lit(0).cast("long"), one(F.col("blocks")) - 1)).alias("block"))
    dealt = pairs.select("a", "b").join(F.broadcast(hot), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), one(F.col("blocks"))).alias("block"))
    return dealt.join(pivots, ["b", "block"]).join(own, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


#: Share of all rows from which a key is hot, so that there are 1 / HOT_SHARE hot keys at most; members of a block of a hot pivot.
HOT_SHARE, MEMBERS = 1 / 2000, 256


def _hot(counted: DataFrame) -> DataFrame:
    """Of keys with their number of rows (times), those with MEMBERS or more and HOT_SHARE of all."""
    total = counted.agg(F.sum("times")).first()[0] or 0
    return counted.where(F.col("times") >= max(MEMBERS, HOT_SHARE * total))


def shared(p: np.ndarray, q: np.ndarray) -> int:
    """|p & q| of two ascending arrays without repeats."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return 0
    return int((q[np.searchsorted(q, p).clip(max=len(q) - 1)] == p).sum())


def overlaps(sets: list[np.ndarray], at_once: int = 1 << 24) -> np.ndarray:
    """|A & B| of all pairs of a bounded number of sets, as products of their incidence matrix."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate([np.zeros(0, U), *sets]), return_inverse=True, return_counts=True)
    often = times[column] > 1  # what one set alone holds adds nothing
    owner, column = owner[often], np.unique(column[often], return_inverse=True)[1]
    out = np.diag([float(len(s)) for s in sets]).astype(np.float32)
    step = max(1, at_once // max(n, 1))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared_ = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        x, y = np.searchsorted(column, [first, first + step])
        part = np.zeros((n, min(step, int(column[-1]) + 1 - first)), np.float32)
        part[owner[x:y], column[x:y] - first] = 1
        shared_ += part @ part.T
    np.fill_diagonal(shared_, out.diagonal())
    return shared_


def voronoi_links(sets: list[np.ndarray], part: np.ndarray, num: int, den: int, leaf: int = 96, n_pivots: int = 8) -> list[tuple[int, int]]:
    """Links between sets of different parts, by recursive Voronoi cells; enough of them to join all parts that any links join.

    Members are compared with pivots; a set is copied to each cell whose pivot is at most 2 eps farther than its nearest one: if A lies in the cell
    of p and B in that of q and they link, then d(B, p) <= d(A, p) + eps <= d(A, q) + eps <= d(B, q) + 2 eps. Cells are joined by the same rule as long
    as that halves the pairs to compare; else, and when they are small, all their pairs are compared at once.
    """
    eps = 1 - num / den
    sizes = np.array([len(s) for s in sets], np.int64)
    leader = {int(p): int(p) for p in np.unique(part)}
    found: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while leader[x] != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    def one(i: int) -> int:
        return root(int(part[i]))

    def link(i: int, j: int) -> None:
        if one(i) != one(j):
            found.append((i, j))
            leader[one(i)] = one(j)

    def join(members: np.ndarray) -> None:
        if len({one(i) for i in members.tolist()}) < 2:
            return
        if len(members) > leaf:
            pivots = members[:: max(1, len(members) // n_pivots)][:n_pivots]
            near = np.array([[shared(sets[i], sets[p]) for p in pivots.tolist()] for i in members.tolist()], float)
            distance = 1 - near / (sizes[members][:, None] + sizes[pivots][None, :] - near)
            for i, k in zip(*np.nonzero(distance <= eps + 1e-12)):
                i, p, n = int(members[i]), int(pivots[k]), int(near[i, k])
                if i != p and den * n >= num * int(sizes[i] + sizes[p] - n):
                    link(i, p)
            within = distance <= distance.min(1, keepdims=True) + 2 * eps + 1e-9
            if 2 * (within.sum(0) ** 2).sum() <= len(members) ** 2:
                for k in range(len(pivots)):
                    join(members[within[:, k]])
                return
        both = overlaps([sets[i] for i in members.tolist()]).astype(np.int64)
        union = sizes[members][:, None] + sizes[members][None, :] - both
        for i, j in zip(*np.nonzero(np.triu((den * both >= num * union) & (both > 0), 1))):
            link(int(members[i]), int(members[j]))

    join(np.arange(len(sets)))
    return found


def _open_cells(docs: DataFrame, reps: DataFrame, parts: DataFrame, marks: _Marks, width: int, rings: Rings) -> DataFrame:
    """(pivot, id, part): the sets that share with a pivot a region whose members are of two components at least. reps: (id) of the classes; parts:
    (id, part) of those that are not their own part. Texts are read where they are; each id's regions of several members are shuffled.

    Any two members of such a region are in its pivot's cell together; taking a pivot's regions as one cell sends each set to a pivot once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = marks.load()
        for batch in batches:
            for x, y in kernel.by_bytes(batch.column("text")):
                part = batch.slice(x, y - x)
                h, at = kernel.shingle_sets(part.column("text"), width)
                key, row = regions(h, at, rings)
                several = _Marks.found(known, key)
                key, row = key[several], row[several]
                order = np.argsort(row, kind="stable")
                own, first = np.unique(row[order], return_index=True)
                lists = pa.ListArray.from_arrays(np.append(first, len(row)).astype(np.int32), pa.array(key[order].view(np.int64)))
                found = pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(own)), lists], ["id", "regions"])
                yield found.filter(found.column("id").is_valid())

    lists = docs.select("doc_id", "text").mapInArrow(run, "id long, regions array<long>").join(reps, "id", "left_semi").join(parts, "id", "left")
    members = lists.select("id", F.coalesce("part", "id").alias("part"), F.explode("regions").alias("region"))
    mixed = members.groupBy("region").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("id").alias("pivot")).where("lo < hi").select("region", "pivot")
    return members.join(mixed, "region").select("pivot", "id", "part").distinct()


def _join_cells(open_: DataFrame, texts: DataFrame, width: int, num: int, den: int, cell_cap: int) -> DataFrame:
    """Links between the members of each cell, of different parts, each cell (or pair of its blocks) in a task of bounded size."""
    sizes = open_.groupBy("pivot").agg(F.ceil(F.count("*") / (cell_cap // 2)).cast("int").alias("blocks"))
    dealt = open_.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("id", "pivot"), F.col("blocks")).cast("int"))
    # blocks i <= j meet in task (i, j), unless all their members are of one part
    of = dealt.groupBy("pivot", "block").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    one, two = (of.select("pivot", *[F.col(c).alias(f"{c}_{n}") for c in ("block", "lo", "hi")]) for n in "ij")
    meet = one.join(two, "pivot").where("block_i <= block_j AND least(lo_i, lo_j) < greatest(hi_i, hi_j)").select("pivot", F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    ends = meet.select("pivot", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    placed = dealt.select("pivot", "block", "id", "part").join(ends, ["pivot", "block"]).select("pivot", "i", "j", "id", "part")

    def run(group: pa.Table) -> pa.Table:
        column = group.column("text").combine_chunks()
        sets: list[np.ndarray] = []
        for a, b in kernel.by_bytes(column):
            h, at = kernel.shingle_sets(column.slice(a, b - a), width)
            sets += [h[at[k] : at[k + 1]] for k in range(b - a)]
        ids = group.column("id").to_numpy()
        links = voronoi_links(sets, group.column("part").to_numpy(), num, den)
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in links], pa.int64()), "b": pa.array([int(ids[y]) for _, y in links], pa.int64())})

    return placed.join(texts.withColumnRenamed("doc_id", "id"), "id").groupBy("pivot", "i", "j").applyInArrow(run, "a long, b long")


def jaccard_components(spark: SparkSession, docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, cell_cap: int = 512, bucket_docs: int = 1500) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text); links at similarity num / den or more."""
    scratch = Scratch(spark, "jaccard")
    rings = Rings(num, den)
    docs = docs.select("doc_id", "text")
    found = scratch.keep(_first_pass(docs, width, rings, max(1, -(-docs.count() // bucket_docs))))
    rows = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("k1"), F.col("d").alias("k2"))
    filled = rows.where("n > 0")
    classes = scratch.keep(filled.where("doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times")))
    hot = _hot(classes).select("k1", "k2", "n", F.col("rep").alias("hot"))
    dealt = filled.join(F.broadcast(hot), ["k1", "k2", "n"], "left").withColumn("k2", F.when(F.col("hot").isNull(), F.col("k2")).otherwise(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()))))
    alike = dealt.join(classes.drop("times"), ["k1", "k2", "n"], "left").select("doc_id", "n", F.coalesce("hot", "rep").alias("rep"))
    same = scratch.keep(alike.unionByName(rows.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("rep"))))
    name = same.where("doc_id IS NOT NULL AND rep IS NOT NULL").select("doc_id", "rep").distinct()
    candidates = found.where("kind = 1").groupBy("a", "b").agg(F.sum("c").alias("times"))
    candidates = candidates.join(name.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a").join(name.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b")
    candidates = scratch.keep(candidates.where("ra <> rb").groupBy(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).agg(F.max("times").alias("times")))
    alias = name.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    ends_of = lambda pairs: pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def parts_of(links: DataFrame) -> DataFrame:
        """(id, part): the end of the path of smallest links from each linked id, as far as a few doublings reach. Parts only save comparisons: sets of
        one part are surely joined, others may be too."""
        parts = ends_of(links).join(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("part")), "id", "left").select("id", F.coalesce("part", "id").alias("part"))
        for _ in range(2):
            parts = scratch.keep(parts)
            parts = parts.join(parts.select(F.col("id").alias("part"), F.col("part").alias("next")), "part").select("id", F.col("next").alias("part"))
        return scratch.keep(parts)

    # of the pivots that could link by their size, the one that a member shares most naming regions with
    sizes = same.where("rep = doc_id").groupBy("doc_id").agg(F.max("n").alias("n"))
    sized = candidates.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")
    nearest = scratch.keep(sized.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).groupBy("a").agg(F.max_by("b", F.struct("times", (-F.col("b")).alias("x"))).alias("b")))
    links = scratch.keep(_verified(nearest, _only(docs, ends_of(nearest)), width, num, den))
    parts = parts_of(links)
    reps = same.where("rep = doc_id").select(F.col("doc_id").alias("id")).distinct()
    open_ = scratch.keep(_open_cells(docs, reps, parts, _Marks(found.where("kind = 3"), "payload"), width, rings))
    links = scratch.keep(links.unionByName(_join_cells(open_, _only(docs, open_.select("id").distinct()), width, num, den, cell_cap)))
    all_ = scratch.keep(components(links.unionByName(alias), scratch))
    out = scratch.keep(same.join(all_, same["doc_id"] == all_["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
    scratch.drop(*scratch.paths[:-1])
    return out


def drop_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, whatever their columns, whose doc_id is not in gone (id); a null doc_id stays. Most rows pass by the marks alone; the few that
    may be in gone are joined with it, so that other texts are not shuffled."""
    marks = _Marks(gone, "id")

    def part(maybe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = marks.load()
            for batch in batches:
                ids = batch.column("doc_id")
                found = _Marks.found(known, ids.fill_null(0).to_numpy().view(U)) & np.array(ids.is_valid())
                yield batch.filter(pa.array(found if maybe else ~found))

        return docs.mapInArrow(run, docs.schema)

    return part(False).unionByName(part(True).join(gone.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"))
