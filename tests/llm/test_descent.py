"""Near duplicates among embeddings against all cosines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op11_descent as descent
from tessera.llm.common import Scratch


def near(r, x, degrees):
    """A vector at an angle from x."""
    y = r.standard_normal(len(x))
    y -= x * (x @ y) / (x @ x)
    return x / np.linalg.norm(x) * math.cos(math.radians(degrees)) + y / np.linalg.norm(y) * math.sin(math.radians(degrees))


def made():
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(32)) for i in range(300)]
    rows += [(1000 + i, near(r, rows[i][1], float(r.choice([1, 5, 12, 17.9, 18.5, 24])))) for i in range(60)]
    centre = r.standard_normal(32)
    rows += [(2000 + i, near(r, centre, 5)) for i in range(90)]  # all linked
    rows += [(2200 + i, near(r, centre, float(r.uniform(9, 24)))) for i in range(25)]  # some linked with some of those
    shell = r.standard_normal(32)
    rows += [(3000 + i, near(r, shell, 11.5)) for i in range(40)]  # linked here and there, no ball
    walk = r.standard_normal(32)
    for i in range(30):  # each linked with the next
        walk = near(r, walk, 15)
        rows.append((4000 - i, walk))
    rows += [(5000 + i, rows[0][1]) for i in range(20)] + [(5000, rows[0][1] * 3), (5001, rows[7][1]), (None, rows[9][1]), (None, rows[0][1])]  # copies, and ids that repeat
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in rows]
    odd = [(6000, None), (6001, []), (6002, [0.0] * 32), (6003, [float("nan")] * 32), (6004, [1.0, None]), (6005, [float("inf")] + [0.0] * 31), (None, None), (6006, [1.0, 2.0]), (6007, [2.0, 4.0]), (6008, [1e-200, 2e-200]), (6009, [1e200, 2e200]), (6010, rows[3][1][:31])]
    return rows + odd + odd[:1]


def brute(rows):
    usable = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    linked = {k: set() for k in range(len(rows))}
    for k in usable:
        for j in usable:
            if j < k and len(rows[k][1]) == len(rows[j][1]):
                x, y = (np.array(rows[i][1]) / np.max(np.abs(rows[i][1])) for i in (k, j))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                    linked[k].add(j)
                    linked[j].add(k)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((i, len(linked[k]), component, i == component))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    schema = "vec_id long, embedding array<double>"
    return spark.createDataFrame(made(), schema).select("*", F.lit("a").alias("label"), F.lit(1).alias("id"), F.lit(0).alias("n"), F.lit(0).alias("s0"), F.lit(0).alias("ball")).repartition(3)


def test_links_and_components(spark, vectors):
    found = descent.near_duplicates(spark, vectors)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert in_order(found.collect()) == in_order(brute(made()))


def test_empty_tables_and_nothing_usable(spark, vectors):
    assert descent.near_duplicates(spark, vectors.limit(0)).collect() == []
    assert descent.near_duplicates(spark, vectors.where("vec_id = 6002")).collect() == [(6002, 0, 6002, True)]
    assert in_order(descent.near_duplicates(spark, vectors.where("vec_id IN (6, 6002)")).collect()) == [(6, 0, 6, True), (6002, 0, 6002, True)]


def test_dense_groups_become_balls(spark, vectors):
    scratch = Scratch(spark, "test")
    nodes = scratch.keep(descent._sketched(vectors.where("vec_id BETWEEN 2000 AND 2089").select(F.col("vec_id").alias("id"), "embedding")).withColumn("radius", F.lit(0.0)))
    edges = descent.descend(descent._both_ways(descent.bucket_pairs(nodes, 90, range(4), scratch)).withColumn("fresh", F.lit(True)), nodes, math.acos(0.95), scratch, 10, enlarge=False)
    inside, means = descent.balls(descent.groups(edges.where("ok AND saturated").select("v", "u"), nodes, math.acos(0.95), scratch), nodes, math.acos(0.95), scratch)
    assert inside.count() >= 85 and means.count() <= 3
    assert inside.where("ball >= 0 OR off > 0.16").count() == 0


def test_lists_are_enlarged_where_no_ball_forms(spark, vectors):
    """Of the shell, most pairs are under 18.2 degrees apart, but hardly any is within 9.1 of a mean."""
    rows = [r for r in made() if r[0] is not None and 3000 <= r[0] < 4000]
    found = descent.near_duplicates(spark, vectors.where("vec_id BETWEEN 3000 AND 3999"), k=4)
    assert in_order(found.collect()) == in_order(brute(rows)) and max(r[1] for r in brute(rows)) > 8


def test_audit_counts_what_is_lost(spark, vectors):
    nodes = vectors.where("vec_id BETWEEN 2000 AND 2089").select(F.col("vec_id").alias("id"), "embedding", F.lit(1).cast("long").alias("n"), F.xxhash64("embedding").alias("h1"))
    all_, none = (nodes.select("id", F.lit(x).cast("long").alias("n_links")) for x in (89, 0))
    assert descent.audit(nodes, all_, 0.95) == (90 * 89, 90 * 89) and descent.audit(nodes, none, 0.95) == (90 * 89, 0)
    assert descent.audit(nodes, all_, 0.95, queries=7)[0] == 7 * 89
