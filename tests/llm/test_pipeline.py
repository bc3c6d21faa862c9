"""The corpus pipeline on the smallest tables: each stage's decisions, and the tables' SQL for queries that have it."""

import os

import pytest

import corpus_pipeline
from tessera.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, DATA).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == columns and 0 < after.count() <= before.count(), name
            if name != "lines":
                assert after.join(before, columns, "left_anti").count() == 0, name
            else:
                assert after.count() == before.count() and after.where("n_chars <> length(text)").count() == 0
            before = after
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = labels.where("quality = 1 AND toxic = 0").join(docs, "doc_id")
    language = spark.read.parquet(f"{tmp_path}/0")
    quality = spark.read.parquet(f"{tmp_path}/1")
    assert good.join(language, "doc_id", "left_semi").count() >= 0.98 * good.count() and good.join(quality, "doc_id", "left_semi").count() >= 0.93 * good.count()
    assert spark.read.parquet(f"{tmp_path}/4").select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def odd_rows(n=60):
    import random

    def text(k):
        r = random.Random(k)
        word = lambda: r.choice(["the", "of", "and", "is"]) if r.random() < 0.4 else "".join(r.choice(["ba", "do", "ki", "lu", "me", "no", "ra", "si"]) for _ in range(r.randint(2, 4)))
        return " ".join(word() for _ in range(60)).capitalize() + "."

    made = [(k, text(k), "en", "s") for k in range(n)] + [(k, text(k), "en", "s") for k in (3, 3)]
    return made + [(None, text(99), "en", None), (None, None, None, None), (70, None, "en", "s"), (71, "", None, "s"), (72, "x" * 50_000, "fr", "s"), (73, text(5), "fr", None), (74, " \n\t", "en", "s")]


CLASHES = ["row", "chunk", "id", "rep", "part", "n", "n_lines", "n_dropped", "kept_text", "region", "score", "length", "_doc", "_text", "_h1", "_k", "_hot"]


def test_odd_rows_empty_tables_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string")
    whole = plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    for name, first in (("odd", whole), ("empty", whole.limit(0)), ("null", whole.where("doc_id IS NULL AND text IS NULL"))):
        before = first
        for k, (stage, function) in enumerate(corpus_pipeline.STAGES):
            function(spark, before, DATA).write.parquet(f"{tmp_path}/{name}{k}")
            after = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if k < 4:
                assert after.columns == whole.columns, stage
                assert after.where(" OR ".join(f"{c} <> 'own {c}'" for c in CLASHES)).count() == 0, stage
            before = after
        ids = [r["doc_id"] for r in before.collect()]
        assert name == "odd" and None in ids and not {70, 71, 72, 74} & set(ids) or name != "odd" and ids == []


def test_near_duplicates_between_thresholds(spark):
    word = lambda k: f"w{k}"
    base = [word(k) for k in range(200)]
    more = base + [word(k) for k in range(1000, 1040)]  # 196 of 236 windows
    rewritten = [word(k + 2000) if 100 <= k < 118 else w for k, w in enumerate(base)]  # 174 of 218
    far = base + [word(k) for k in range(3000, 3060)]  # 196 of 256
    rows = [(k + 1, " ".join(w)) for k, w in enumerate([base, more, rewritten, far])]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    rows[2] = (3, " ".join(word(k + 2000) if 100 <= k < 117 else w for k, w in enumerate(base)))  # 175 of 217
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    result = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    plain = lambda rows: sorted(tuple("null" if v is None else str(v) for v in r) for r in rows)
    assert plain(QUERIES[name](spark, DATA).select(*columns).collect()) == plain(result.fetchall())
