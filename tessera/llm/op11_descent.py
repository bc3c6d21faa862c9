"""Operator 11: near duplicates among embeddings by NN-descent.

Equal vectors are one class. A class is sketched by the signs of 256 random projections, whose Hamming distance estimates the angle between two vectors;
all search is on sketches, and every link is decided by the cosine of the vectors in double precision.

A graph of nearest neighbours is refined: it begins with neighbours in buckets of sketch bits and at random, and in each round the neighbours (and reverse
neighbours) of a vertex are compared with one another and lists keep their nearest, until hardly a list changes. Vertices with more neighbours than a
block holds deal them to blocks, anew in every round. A full list all of whose entries might link is saturated. Saturated vertices take over the smallest
label that their neighbours pass on and that is near, and those proven to lie within half the linking angle of their group's mean form a ball: by the
triangle inequality all its members are linked, however many, and no pair of them is written. The graph is refined again with balls as vertices, and
lists that are saturated still are enlarged twofold, as often as it takes. Pairs of balls in the graph are linked, or not, as a whole where the angle of
their centres and their radii say so; the members of all others are compared, in blocks, and counted.

Recall is audited: a bounded number of classes are compared with all others, and while the graph has found too few of their links, more buckets are added.

Vectors that are null, empty or zero or hold a null or non-finite component link with nothing, nor do vectors of different lengths. Each row counts as a
vector, also where rows repeat a vec_id or a vector. A null vec_id is no id: it is never a component's smallest, and a component of none but
such rows has a null component_id and all of them are kept. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, table
from tessera.llm.components import components

WORDS = 4  # of 64 bits each in a sketch
BITS = 64 * WORDS
SKETCH = [f"s{i}" for i in range(WORDS)]
#: Rounding of angles and cosines, against which what is concluded without comparing is safe.
SAFE = 1e-6
#: Standard deviations of a sketch's distance that may lie above what the angle lets expect.
SPREAD = 6


# vectors

def unit_rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, padded with zeros, in double precision; their lengths)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    out /= np.abs(out).max(1, initial=0, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(1, keepdims=True)), sizes


def cosines(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Of the vectors of each row; -2 for vectors of different lengths."""
    x, n = unit_rows(a)
    y, m = unit_rows(b)
    width = min(x.shape[1], y.shape[1])
    return np.where(n == m, np.einsum("ij,ij->i", x[:, :width], y[:, :width]), -2)


def all_cosines(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    width = min(x.shape[1], y.shape[1])
    return np.where(n[:, None] == m, x[:, :width] @ y[:, :width].T, -2)


@functools.lru_cache(4)
def _planes(width: int) -> np.ndarray:
    return np.stack([np.random.default_rng([11, j]).standard_normal(BITS) for j in range(width)])


def _sketched(classes: DataFrame) -> DataFrame:
    """classes with SKETCH; equal vectors, and multiples of them, have equal sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _ = unit_rows(batch.column("embedding"))
            words = np.packbits(x @ _planes(x.shape[1]) > 0, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS))], [*batch.schema.names, *SKETCH])

    return classes.mapInArrow(run, T.StructType([*classes.schema, *(T.StructField(s, T.LongType()) for s in SKETCH)]))


def usable() -> Column:
    """Whether an embedding is a vector with a direction."""
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(e.isNotNull() & F.forall(e, finite) & F.exists(e, lambda x: x != 0), F.lit(False))


def _distance(a: str, b: str) -> Column:
    """Hamming distance of the sketches in columns a0.. and b0.."""
    return F.expr(" + ".join(f"bit_count({a}{i} ^ {b}{i})" for i in range(WORDS)))


def _bucket(seed: int, bits: int) -> str:
    """SQL for the value of some bits of the sketch, others for each seed."""
    chosen = np.random.default_rng([13, seed]).permutation(BITS)[:bits].tolist()
    return " | ".join(f"shiftleft(shiftrightunsigned(s{p // 64}, {p % 64}) & 1L, {i})" for i, p in enumerate(chosen))


def most_bits(angle: Column) -> Column:
    """The sketch distance that vectors at an angle, in radians, do not exceed, but for SPREAD standard deviations."""
    share = F.least(angle / math.pi, F.lit(0.5))
    return BITS * share + SPREAD * F.sqrt(BITS * share * (1 - share))


# dense groups

def groups(edges: DataFrame, points: DataFrame, angle: float, scratch: Scratch, rounds: int = 8) -> DataFrame:
    """(id, label) of the ends of edges (v, u): the smallest id that their neighbours hand on and whose sketch is within the angle. What has not come
    through when the rounds end makes groups smaller, not links fewer."""
    label = ["label", *(f"l{i}" for i in range(WORDS)), "size"]
    known = points.select("id", *SKETCH, F.size("embedding").alias("size"))
    state = scratch.keep(edges.select(F.col("v").alias("id")).distinct().join(known, "id").select("id", *SKETCH, F.col("size").alias("own"), F.col("id").alias("label"), *[F.col(s).alias(f"l{i}") for i, s in enumerate(SKETCH)], "size"))
    for _ in range(rounds):
        used = scratch.paths[-1]
        handed = edges.select("v", "u").join(state.select(F.col("id").alias("u"), *label), "u").join(state.select(F.col("id").alias("v"), *SKETCH, "own", F.col("label").alias("has")), "v")
        near = handed.where((F.col("label") < F.col("has")) & (F.col("size") == F.col("own")) & (_distance("s", "l") <= BITS * angle / math.pi))
        least = near.groupBy("v").agg(F.min(F.struct(*label)).alias("new")).withColumnRenamed("v", "id")
        state = scratch.keep(state.join(least, "id", "left").select("id", *SKETCH, "own", *[F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) for c in label], F.col("new").isNotNull().alias("moved")))
        scratch.drop(used)
        if not state.agg(F.count_if("moved")).first()[0]:
            break
    return state.select("id", "label")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, total) of the unit vectors of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, size = unit_rows(batch.column("embedding"))
        label = batch.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
        total = np.add.reduceat(x[order], starts)
        yield pa.RecordBatch.from_arrays([pa.array(label[order][starts]), pa.array([t[:n] for t, n in zip(total, size[order][starts])], pa.list_(pa.float64()))], ["label", "total"])


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, centre) from totals in order of labels, of which one is held."""
    now, total = None, np.zeros(0)

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total / max(np.sqrt(total @ total), 1e-300)], pa.list_(pa.float64()))], ["label", "centre"])

    for batch in batches:
        for label, part in zip(batch.column("label").to_pylist(), batch.column("total")):
            part = part.values.to_numpy()
            if label == now:
                total = total + part
                continue
            if now is not None:
                yield told()
            now, total = label, part
    if now is not None:
        yield told()


def balls(labels: DataFrame, points: DataFrame, angle: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, ball, off) of the points that lie in balls, off being the angle from the centre, half of angle at most; and (ball, embedding) of the centres. The ids of balls are below 0.

    Means are added up within batches, and then from batch to batch.
    """
    shared = labels.groupBy("label").agg(F.count("*").alias("members")).where("members > 1").select("label")
    held = scratch.keep(labels.join(shared, "label").join(points.select("id", "embedding"), "id").select("id", "label", "embedding"))
    means = held.select("label", "embedding").mapInArrow(_sums, "label long, total array<double>").repartition("label").sortWithinPartitions("label").mapInArrow(_means, "label long, centre array<double>")
    means = scratch.keep(means)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = np.arccos(np.clip(cosines(batch.column("embedding"), batch.column("centre")), -1, 1)) if batch.num_rows else np.zeros(0)
            ball = -1 - batch.column("label").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ball), pa.array(np.maximum(off, SAFE))], ["id", "ball", "off"]).filter(pa.array(off <= angle / 2 - SAFE))

    inside = scratch.keep(held.join(means, "label").select("id", "label", "embedding", "centre").mapInArrow(prove, "id long, ball long, off double"))
    return inside, means.select((-1 - F.col("label")).alias("ball"), F.col("centre").alias("embedding"))


# the graph

def _nearest(edges: DataFrame, k: int, wide: DataFrame | None) -> DataFrame:
    """Of edges (v, u, d, fresh), dealt by v, the k nearest of each v, or as many as wide (v, k) says; an edge that is there twice is as old as the older."""
    once = edges.repartition("v").groupBy("v", "u").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "u")))
    if wide is None:
        return ranked.where(F.col("r") <= k).drop("r")
    most = wide.agg(F.max("k")).first()[0] or k
    return ranked.where(F.col("r") <= most).join(wide, "v", "left").where(F.col("r") <= F.coalesce("k", F.lit(k))).drop("r", "k")


def _both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    """Each of pairs (a, b, d and what more names as x_a, x_b) as an edge from either end."""
    ends = [F.struct(F.col(v).alias("v"), F.col(u).alias("u"), "d", *[F.col(f"{m}_{v}").alias(m) for m in more]) for v, u in (("a", "b"), ("b", "a"))]
    return pairs.select(F.inline(F.array(*ends)))


def _meet(placed: DataFrame, on: list[str], *more: str) -> DataFrame:
    """Pairs a < b of the rows (u, SKETCH, more) of placed that share the columns on, with their distance d."""
    side = lambda end, sketch: placed.select(*on, F.col("u").alias(end), *[F.col(s).alias(f"{sketch}{i}") for i, s in enumerate(SKETCH)], *[F.col(m).alias(f"{m}_{end}") for m in more])
    return side("a", "p").join(side("b", "q"), on).where("a < b").withColumn("d", _distance("p", "q"))


def bucket_pairs(centres: DataFrame, n: int, seeds: range, scratch: Scratch, block: int = 32) -> DataFrame:
    """Pairs (a, b, d): of centres of a bucket of about 8, for each seed, and between some 16 at random. Larger buckets are dealt to blocks."""
    bits = max(1, math.ceil(math.log2(max(n, 2) / 8)))
    keys = F.expr("array(" + ", ".join([f"struct({s} AS seed, {_bucket(s, bits)} AS key)" for s in seeds] + [f"struct(-1 - {seeds.start} AS seed, pmod(xxhash64(id, {seeds.start}), {max(1, n // 16)}L) AS key)"]) + ")")
    rows = centres.select(F.col("id").alias("u"), *SKETCH, F.inline(keys))
    sizes = rows.groupBy("seed", "key").agg(F.count("*").alias("n")).where("n > 1").select("seed", "key", F.ceil(F.col("n") / block).alias("blocks"))
    placed = scratch.keep(rows.join(sizes, ["seed", "key"]).withColumn("block", F.pmod(F.xxhash64("u", "seed"), "blocks")).drop("blocks"))
    return _meet(placed, ["seed", "key", "block"]).select("a", "b", "d")


def refine(edges: DataFrame, centres: DataFrame, k: int, wide: DataFrame | None, salt: int, scratch: Scratch, block: int = 48) -> DataFrame:
    """One round: the neighbours of each v, either way, meet if one of them is fresh, and lists take what is nearer than their farthest."""
    either = edges.select("v", "u", "fresh").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u"), "fresh")).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
    blocks = either.groupBy("v").agg(F.count("*").alias("n"), F.max("fresh").alias("any")).where("any AND n > 1").select("v", F.ceil(F.col("n") / block).alias("blocks"))
    lists = edges.groupBy("v").agg(F.count("*").alias("n"), F.max("d").alias("far"))
    most = F.lit(k)
    if wide is not None:
        lists, most = lists.join(wide, "v", "left"), F.coalesce("k", F.lit(k))
    full = lists.select(F.col("v").alias("id"), F.when(F.col("n") >= most, F.col("far")).otherwise(BITS + 1).alias("far"))
    known = centres.select("id", *SKETCH).join(full, "id", "left").select(F.col("id").alias("u"), *SKETCH, F.coalesce("far", F.lit(BITS + 1)).alias("far"))
    placed = scratch.keep(either.join(blocks, "v").join(known, "u").select("v", F.pmod(F.xxhash64("u", F.lit(salt)), "blocks").alias("block"), "u", *SKETCH, "far", "fresh"))
    met = _meet(placed, ["v", "block"], "far", "fresh").where("(fresh_a OR fresh_b) AND d < greatest(far_a, far_b)")
    new = _both_ways(met, "far").where("d < far").select("v", "u", "d", F.lit(True).alias("fresh"))
    return _nearest(edges.withColumn("fresh", F.lit(False)).unionByName(new), k, wide)


def _may_link(edges: DataFrame, radii: DataFrame, angle: float) -> DataFrame:
    """edges with ok: whether some members of the two balls may be linked, by their sketches and radii."""
    of = lambda end: radii.select(F.col("id").alias(end), F.col("radius").alias(f"radius_{end}"))
    return edges.join(of("v"), "v").join(of("u"), "u").withColumn("ok", F.col("d") <= most_bits(F.lit(angle) + F.col("radius_v") + F.col("radius_u")))


def descend(edges: DataFrame, points: DataFrame, angle: float, scratch: Scratch, k: int, enlarge: bool, still: float = 0.05) -> DataFrame:
    """edges (v, u, d, fresh) of points (id, SKETCH, radius) refined, with ok (see _may_link) and saturated. still: the share of list entries that may
    change in the last round. enlarge: until no list is saturated."""
    wide, salt = None, 0
    edges = scratch.keep(_nearest(edges, k, wide))
    most = still * edges.count()
    while True:
        while True:
            used = scratch.paths[-1]
            edges = scratch.keep(refine(edges, points, k, wide, salt, scratch))
            changed = edges.agg(F.count_if("fresh")).first()[0]
            scratch.drop(used, scratch.paths[-2])
            salt += 1
            if changed <= most:
                break
        told = scratch.keep(_may_link(edges, points, angle))
        held = told.where("ok").groupBy("v").agg(F.count("*").alias("good"))
        held = held.withColumn("k", F.lit(k)) if wide is None else held.join(wide, "v", "left").withColumn("k", F.coalesce("k", F.lit(k)))
        saturated = scratch.keep(held.where("good >= k").select("v", (2 * F.col("k")).alias("k")))
        entries = saturated.agg(F.sum("k")).first()[0]
        if not enlarge or not entries:
            return told.join(saturated.select("v", F.lit(True).alias("saturated")), "v", "left").select("v", "u", "d", "ok", F.coalesce("saturated", F.lit(False)).alias("saturated"))
        most = 0.001 * entries
        wide = scratch.keep(saturated if wide is None else wide.join(saturated.select("v"), "v", "left_anti").unionByName(saturated))
        edges = scratch.keep(edges.join(saturated.select("v", F.lit(True).alias("again")), "v", "left").select("v", "u", "d", (F.col("fresh") | F.coalesce("again", F.lit(False))).alias("fresh")))


# links

def _judge(pairs: DataFrame, centres: DataFrame, angle: float, cosine: float) -> DataFrame:
    """(a, b, linked): whether all members of two balls are linked (true), none (false), or some may be (null)."""
    of = lambda end: centres.select(F.col("id").alias(end), F.col("embedding").alias(f"e_{end}"), F.col("radius").alias(f"r_{end}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = cosines(batch.column("e_a"), batch.column("e_b")) if batch.num_rows else np.zeros(0)
            apart, reach = np.arccos(np.clip(cos, -1, 1)), batch.column("r_a").to_numpy() + batch.column("r_b").to_numpy()
            linked = np.where(reach == 0, cos >= cosine, apart + reach <= angle - SAFE)
            sure = (reach == 0) | linked | (apart - reach > angle + SAFE) | (cos < -1.5)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, mask=~sure)], ["a", "b", "linked"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "e_a", "e_b", "r_a", "r_b").mapInArrow(run, "a long, b long, linked boolean")


def _compare(open_: DataFrame, members: DataFrame, cosine: float, block: int = 1024) -> DataFrame:
    """(a, b, id, links): of the pairs of balls (a, b), each member's links with the other ball, where it has any. Members are dealt to blocks, and
    blocks meet; rows are members of blocks, not their pairs."""
    sizes = members.groupBy("ball").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = members.join(sizes, "ball").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    of = lambda end, i: sizes.select(F.col("ball").alias(end), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias(i))
    tasks = open_.join(of("a", "i"), "a").join(of("b", "j"), "b")
    ends = tasks.select("a", "b", "i", "j", F.inline(F.array(F.struct(F.col("a").alias("ball"), F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("ball"), F.col("j").alias("block"), F.lit(1).alias("side")))))
    placed = ends.join(dealt.select("ball", "block", "id", "n", "embedding"), ["ball", "block"]).select("a", "b", "i", "j", "side", "id", "n", "embedding")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side, ids, n = (group.column(c).to_numpy() for c in ("side", "id", "n"))
        x, size = unit_rows(group.column("embedding").combine_chunks())
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = all_cosines(x[one], size[one], x[two], size[two]) >= cosine
        links = np.append(near @ n[two], n[one] @ near)
        rows = np.append(one, two)[links > 0]
        keys = {c: pa.array(np.full(len(rows), group.column(c)[0].as_py(), np.int64)) for c in ("a", "b")}
        return pa.table(keys | {"id": pa.array(ids[rows]), "links": pa.array(links[links > 0].astype(np.int64))})

    return placed.groupBy("a", "b", "i", "j").applyInArrow(run, "a long, b long, id long, links long")


def audit(nodes: DataFrame, found: DataFrame, cosine: float, queries: int = 256) -> tuple[int, int]:
    """(links of some classes with all others, links of them that were found). found: (id, n_links). The queries are those with the smallest hashes of
    their vectors; their number is fixed, so that they may be sent to every task, and each is compared with every vector."""
    asked = nodes.orderBy(F.xxhash64("h1"), "id").limit(queries).select("id", "embedding")
    rows = asked.collect()
    if not rows:
        return 0, 0
    ids = np.array([r["id"] for r in rows])
    x, size = unit_rows(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                y, m = unit_rows(batch.column("embedding"))
                near = all_cosines(x, size, y, m) >= cosine
                near |= ids[:, None] == batch.column("id").to_numpy()
                total += near @ batch.column("n").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "links"])

    true = nodes.select("id", "n", "embedding").mapInArrow(run, "id long, links long").groupBy("id").agg((F.sum("links") - 1).alias("links"))
    both = found.join(true, "id").agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum(F.least("links", "n_links")), F.lit(0))).first()
    return int(both[0]), int(both[1])


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = 0.95, k: int = 10, tables: int = 12, recall: float = 0.98, most_tables: int = 64) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding); links at a cosine or more."""
    scratch, angle = Scratch(spark, "descent"), math.acos(cosine)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("usable", usable())
    hashed = rows.where("usable").withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = hashed.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    nodes = scratch.keep(_sketched(classes.withColumn("id", F.monotonically_increasing_id())))
    points = nodes.select("id", "embedding", *SKETCH, F.lit(0.0).alias("radius"))
    n, edges, began = nodes.count(), None, 0
    while True:
        seeds = range(began, began + tables)
        first = _both_ways(bucket_pairs(points, n, seeds, scratch)).withColumn("fresh", F.lit(True))
        graph = scratch.keep(descend(first if edges is None else first.unionByName(edges), points, angle, scratch, k, enlarge=False))
        edges = graph.select("v", "u", "d", F.lit(False).alias("fresh"))
        placed, centres = nodes.select("id", F.col("id").alias("ball"), F.lit(0.0).alias("off")), points
        dense = graph.where("ok AND saturated").select("v", "u", "d")
        if not dense.isEmpty():
            inside, means = balls(groups(dense, points, angle, scratch), points, angle, scratch)
            placed = scratch.keep(nodes.select("id").join(inside, "id", "left").select("id", F.coalesce("ball", "id").alias("ball"), F.coalesce("off", F.lit(0.0)).alias("off")))
            radii = placed.where("ball < 0").groupBy("ball").agg(F.max("off").alias("radius"))
            round_ = _sketched(means.join(radii, "ball").select(F.col("ball").alias("id"), "embedding", "radius"))
            single = points.join(placed.where("ball >= 0").select("id"), "id", "left_semi")
            centres = scratch.keep(single.unionByName(round_))
            to = lambda end: placed.select(F.col("id").alias(end), F.col("ball").alias(f"{end}{end}"))
            onto = graph.select("v", "u", "d").join(to("v"), "v").join(to("u"), "u").where("vv <> uu")
            between = onto.where("vv >= 0 AND uu >= 0").select("v", "u", "d", F.lit(False).alias("fresh"))
            of = lambda end, sketch: centres.select(F.col("id").alias(end), *[F.col(c).alias(f"{sketch}{i}") for i, c in enumerate(SKETCH)])
            outwards = onto.where("vv < 0 OR uu < 0").select(F.least("vv", "uu").alias("a"), F.greatest("vv", "uu").alias("b")).distinct().join(of("a", "p"), "a").join(of("b", "q"), "b")
            fresh = _both_ways(outwards.withColumn("d", _distance("p", "q"))).unionByName(_both_ways(bucket_pairs(centres, n, seeds, scratch).where("a < 0 OR b < 0")))
            again = between.unionByName(fresh.withColumn("fresh", F.lit(True)))
            graph = scratch.keep(descend(again, centres, angle, scratch, k, enlarge=True))
        about = scratch.keep(placed.join(nodes.select("id", "n", "first"), "id").groupBy("ball").agg(F.sum("n").alias("weight"), F.min("first").alias("first")).withColumnRenamed("ball", "id"))
        pairs = graph.where("ok").select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()
        judged = scratch.keep(_judge(pairs, centres, angle, cosine))
        whole, open_ = judged.where("linked").select("a", "b"), judged.where("linked IS NULL").select("a", "b")
        members = placed.join(nodes.select("id", "n", "embedding"), "id").select("ball", "id", "n", "embedding")
        compared = scratch.keep(_compare(open_, members, cosine))
        weights = about.select(F.col("id").alias("other"), "weight")
        ends = whole.select(F.col("a").alias("ball"), F.col("b").alias("other")).unionByName(whole.select(F.col("b").alias("ball"), F.col("a").alias("other")))
        of_ball = ends.join(weights, "other").groupBy("ball").agg(F.sum("weight").alias("outside"))
        own = about.select(F.col("id").alias("ball"), "weight").join(of_ball, "ball", "left").select("ball", (F.col("weight") - 1 + F.coalesce("outside", F.lit(0))).alias("links"))
        more = compared.groupBy("id").agg(F.sum("links").alias("more"))
        counted = scratch.keep(placed.join(own, "ball").join(more, "id", "left").select("id", "ball", (F.col("links") + F.coalesce("more", F.lit(0))).alias("n_links")))
        true, found = audit(nodes, counted, cosine)
        began += tables
        if found >= recall * true or began >= most_tables:
            break
    joined = components(whole.unionByName(compared.select("a", "b").distinct()), scratch)
    reached = about.join(joined, "id", "left").select(F.col("id").alias("ball"), F.coalesce("component", "id").alias("component"), "first")
    smallest = reached.groupBy("component").agg(F.min("first").alias("component_id"))
    classed = counted.join(reached.select("ball", "component"), "ball").join(smallest, "component").select("id", "n_links", "component_id")
    known = nodes.select("id", "h1", "h2").join(classed, "id").select("h1", "h2", "n_links", "component_id")
    linked = hashed.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
