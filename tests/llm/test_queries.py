import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlog.llm import exact_dedup, queries

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def values(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, map(tuple, df.where(df.notna(), None).values.tolist())))


@here
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert values(queries.queries()[name](spark, DATA).toPandas()) == values(con.execute(queries.oracle_sql()[name]).df())


@here
def test_pipeline(spark):
    """Each stage against what its operator says of the stage's own input."""
    from tests.llm.test_operators import linked, shingles

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in corpus_pipeline.quality_stage(spark, docs, DATA).collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r[0] for r in rows}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.95 * sum(labels.values())
    one = spark.createDataFrame(rows, docs.schema)
    two = corpus_pipeline.exact_dedup_stage(spark, one, DATA)
    assert two.columns == docs.columns
    assert {r["doc_id"] for r in two.collect()} == {r["doc_id"] for r in exact_dedup.exact_groups(one).where("kept").collect()}
    rows2 = [tuple(r) for r in two.collect()]
    three = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows2, docs.schema), DATA)
    component = {i: c for i, _, c in linked(rows2, 5, 4, 5)}
    rows3 = [tuple(r) for r in three.collect()]
    assert {r[0] for r in rows3} == {r[0] for r in rows2 if component[r[0]] == r[0]}
    four = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows3, docs.schema), DATA)
    items = [shingles(r["text"], 5) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r[0] for r in rows3 if not any(s and 5 * len(s & shingles(r[1], 5)) >= 4 * len(s) for s in items)}
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} == clean
    packed = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == clean
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n > 1024 or n <> m").count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert set(queries.queries()) >= {f"op{i}" + n for i, n in ((1, "_jaccard_join"), (10, "_quality"))} | {"pipeline"}
