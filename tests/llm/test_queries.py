"""The registered queries against their SQL on the smallest tables, and the pipeline's stages."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def rows_of(df):
    out = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False):
        out.append(tuple("None" if x is None or isinstance(x, float) and math.isnan(x) or str(x) == "<NA>" else str(round(float(x), 7)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_decontaminate", "op7_warc", "op8_jaccard_join"])
def test_query_equals_sql(spark, name):
    import duckdb

    from scanengine.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows_of(queries.queries()[name](spark, SF).toPandas()) == rows_of(con.execute(queries.oracle_sql()[name]).df())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        assert after <= before
        if name == "quality":
            assert all((i in after) == (labels[i] == 1) for i in before if i in labels)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert mixed and {r.doc_id for r in mixed} <= {r.doc_id for r in docs.collect()} and len(mixed) < seen
    empty = docs.where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_stages_judge_rows_that_repeat_or_lack_an_id(spark):
    """Rows without doc_id, and rows that share one, live and die by their own texts in every stage."""
    import corpus_pipeline

    # the quality stage learns from all rows, so the others get what it leaves and copies of that
    docs = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).cache()
    some = docs.where("length(text) > 200").orderBy("doc_id").limit(40)
    twice = some.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.lit(10**9)).cast(docs.schema["doc_id"].dataType))
    both = docs.unionByName(twice).cache()
    alone = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        alone, both = stage(spark, alone, SF).cache(), stage(spark, both, SF).cache()
        assert both.columns == docs.columns
        with_id = {r.doc_id for r in alone.collect()}
        assert with_id <= {r.doc_id for r in both.collect()}
    left = both.where("doc_id is null or doc_id = 1000000000")
    # every such row copies a text that an earlier row has, so none of them outlives the near-duplicate stage
    assert left.count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs.unionByName(twice), SF)
    assert mixed.where("doc_id is null").count() > 0 and mixed.where("taken > 2 * size").count() == 0
