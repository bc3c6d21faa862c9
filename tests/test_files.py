"""Ordered output: one file that tasks write together, and folders of parts that never take the place of foreign files."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.errors import ExportError
from tessera.plans.files import write_file, write_lines


def lines(spark, n):
    return spark.range(0, n, 1, 7).select((F.col("id") * 7919 % max(n, 1)).alias("k"), F.concat(F.lit("é"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("value"))


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_one_file_by_many_tasks(spark, tmp_path, n):
    path = tmp_path / "out.jsonl"
    path.write_text("what was there before")
    frame = lines(spark, n)
    write_lines(frame, [F.col("k")], str(path))
    want = "".join(f"{r.value}\n" for r in frame.orderBy("k").collect())
    assert path.read_text() == want and os.listdir(tmp_path) == ["out.jsonl"]
    write_file(frame.repartition(13, "k").sortWithinPartitions("k").select("value"), str(path))
    assert sorted(path.read_text().splitlines()) == sorted(want.splitlines())


def test_a_failed_file_leaves_the_old_one(spark, tmp_path):
    path = tmp_path / "out"
    path.write_text("old")
    bad = lines(spark, 500).withColumn("value", F.when(F.col("k") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        write_lines(bad, [F.col("k")], str(path))
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["out"]


def test_folders_of_others_stay(spark, tmp_path):
    mine, ours, empty = (tmp_path / n for n in ("mine", "ours", "empty"))
    mine.mkdir()
    empty.mkdir()
    (mine / "thesis.md").write_text("years of work")
    for bad in (str(mine), f"{mine}/", str(tmp_path)):
        with pytest.raises(ExportError):
            write_lines(lines(spark, 10), [F.col("k")], bad, parts=True)
    assert (mine / "thesis.md").read_text() == "years of work"
    for n in (10, 20):
        write_lines(lines(spark, n), [F.col("k")], f"{ours}/", parts=True)
        assert spark.read.text(str(ours)).count() == n
    write_lines(lines(spark, 3), [F.col("k")], str(empty), parts=True)
    assert [r.value for r in spark.read.text(str(empty)).collect()] == [r.value for r in lines(spark, 3).orderBy("k").collect()] and sorted(os.listdir(tmp_path)) == ["empty", "mine", "ours"]
    (ours / "part-x").touch()
    with pytest.raises(ExportError):
        write_lines(lines(spark, 3), [F.col("k")], str(mine / "thesis.md"), parts=True)
