"""The pipeline and the registered queries on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in c.STAGES[:-1]:
        docs = c.materialize(stage(spark, docs, SF))
        assert docs.columns == columns, name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 150, name
        before = after
    assert {r.doc_id for r in c.STAGES[-1][1](spark, docs, SF).select("doc_id").collect()} == before


def test_queries_are_registered():
    import __spark_entry__ as e

    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in e.queries()} and "pipeline" in e.queries()


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as c

    names = ["letters", "score", "lang_pred", "kept", "keep_id", "_id", "_k", "_reads", "_r1", "_row", "r1", "component", "mix_pass", "row", "name", "label", "a.b", "tick`ed", "at", "shard", "text_"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0)], docs.schema))
    rows = c.materialize(rows.select("*", *[F.concat(F.lit(x), F.coalesce("doc_id", F.lit(0)).cast("string")).alias(x) for x in names]))
    for name, stage in c.STAGES:
        assert stage(spark, rows.limit(0), SF).count() == 0, name
        out = stage(spark, rows, SF)
        if name != "packing":
            assert out.columns == rows.columns, name
            assert all(r[x] == f"{x}{r.doc_id or 0}" for r in out.collect() for x in names), name
    once = c.exact_copies(spark, rows, SF)
    assert once.count() == rows.select(F.lower(F.coalesce("text", F.lit("")))).distinct().count()


def test_operators_keep_columns_of_any_name(spark):
    """Beside the stages' operators: those that take columns by name or pass all on."""
    from netaudit.llm import language_id, quality
    from netaudit.llm.quality_rules import quality_rules
    from netaudit.llm.secret_scan import secret_scan
    from netaudit.llm.sharding import shard

    odd = ["label", "_id", "_text", "a.b", "tick`ed", "row", "held", "low", "score", "kept"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(x), F.col("doc_id").cast("string")).alias(x) for x in odd]).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("_id", F.lit(1)).withColumn("text", F.lit("t"))
    keep = ["doc_id", *odd]
    model = quality.learn(docs, labels)
    outs = [quality.score(docs, model, keep), language_id.identify(docs, language_id.learn(docs), keep), quality_rules(docs, keep), shard(docs)]
    for out in outs:
        assert out.columns[: len(keep)] == keep or out.columns[: len(docs.columns)] == docs.columns
        assert all(r[x] == f"{x}{r.doc_id}" for r in out.collect() for x in odd)
    assert secret_scan(docs).count() == docs.count()
