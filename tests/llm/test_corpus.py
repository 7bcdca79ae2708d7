"""The registered corpus queries against their SQL, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import check
import corpus_pipeline
from seatwise.llm import decontaminate
from seatwise.llm.queries import ORACLES, QUERIES
from tests.llm.odd import docs
from tests.llm.test_copies import want

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries()) and set(ORACLES) <= set(registered.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert check.compare(spark, check.oracle(FOLDER), FOLDER, name) is None


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    now = spark.read.parquet(f"{folder}/documents.parquet").withColumn("n", F.lit(1)).withColumn("fp", F.lit("x"))
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, folder).write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
        assert name == "mixing" or now.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert seen[name] <= ids
        if name == "near_duplicates":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert seen[name] == {d for _, d in want(rows)} != ids
        if name == "decontamination":
            items = spark.read.parquet(f"{folder}/benchmark.parquet")
            report, _ = decontaminate.contamination(before, items)
            assert seen[name] == {r.doc_id for r in report.filter("not contaminated").collect()} and seen[name] != ids
        if name in ("personal_data", "mixing"):
            assert seen[name] == ids
        if name == "personal_data":
            assert now.filter(F.col("text").rlike("[a-z0-9]@[a-z0-9]+[.]")).count() == 0 < before.filter(F.col("text").rlike("[a-z0-9]@[a-z0-9]+[.]")).count()
            assert now.filter("n_chars <> char_length(text)").count() == 0
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    lost = labels.filter("quality = 1").join(spark.read.parquet(f"{tmp_path}/quality"), "doc_id", "left_anti")
    bad = labels.filter("quality = 0").join(spark.read.parquet(f"{tmp_path}/quality"), "doc_id", "left_semi")
    assert lost.count() <= 0.01 * labels.count() and bad.count() <= 0.25 * labels.filter("quality = 0").count()


@pytest.mark.parametrize("rows", [None, []])
def test_stages_bear_odd_rows(spark, rows):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs(spark, rows), FOLDER).collect()
