"""What the physical plans must look like: pushed filters, pruned columns, few shuffles, no per-row Python where it isn't needed."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from echofold.functions import tokens
from echofold.operators import pairs
from echofold.operators.changes import snapshot_changes
from echofold.operators.fingerprints import text_fingerprints
from echofold.sources.tables import compared_path, file_rows, unit_rows


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    t = datetime(2024, 1, 1)
    spark.createDataFrame([(i, "r", f"a/{i}.py", "python", "x = 1\n" * 50, t) for i in range(50)], "file_id long, repo string, path string, lang string, content string, loaded_at timestamp").write.parquet(f"{root}/files.parquet")
    spark.createDataFrame([(i, "go", 5, 0, list(range(i, i + 20)), t, "n") for i in range(200)], "unit_id long, lang string, sig_lines int, batch_no int, fingerprints array<long>, loaded_at timestamp, name string").write.parquet(f"{root}/units.parquet")
    spark.createDataFrame([("c1", f"p{i}", "ab", t, "k") for i in range(50)] + [("c2", f"p{i}", "ac", t, "k") for i in range(50)], "commit string, path string, oid string, delivered_at timestamp, mode string").write.parquet(f"{root}/tree.parquet")
    spark.createDataFrame([(i, "some words 12 34 and more of them " * 5, "en") for i in range(20)], "doc_id long, text string, lang string").write.parquet(f"{root}/documents.parquet")
    return root


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_only_needed_columns_are_read(spark, data):
    p = plan(file_rows(spark.read.parquet(f"{data}/files.parquet")))
    assert "ReadSchema: struct<file_id:bigint,path:string,loaded_at:timestamp>" in p and "IsNotNull(file_id)" in p
    p = plan(unit_rows(spark.read.parquet(f"{data}/units.parquet")))
    assert "name" not in p.split("ReadSchema")[1].split("\n")[0] and "IsNotNull(unit_id)" in p


def test_canonical_units_take_one_shuffle(spark, data):
    assert exchanges(unit_rows(spark.read.parquet(f"{data}/units.parquet"))) == 1


def test_changes_take_one_shuffle_of_the_rows(spark, data):
    steps = spark.createDataFrame([("c1", "c2")], "old string, new string")
    df = snapshot_changes(spark.read.parquet(f"{data}/tree.parquet"), steps, snapshot="commit", key=compared_path(F.col("path")), value=F.lower("oid"), version=F.col("delivered_at"))
    p = plan(df)
    assert exchanges(df) == 1 and "BroadcastHashJoin" in p and "mode:string" not in p and df.count() == 50


def test_text_is_fingerprinted_without_shuffle(spark, data):
    p = plan(text_fingerprints(spark.read.parquet(f"{data}/documents.parquet").coalesce(1), "doc_id", "text"))
    assert "Exchange hashpartitioning(id" in p  # one small file is spread over the cores
    many = spark.read.parquet(f"{data}/documents.parquet").repartition(16)
    p = plan(text_fingerprints(many, "doc_id", "text"))
    assert "hashpartitioning" not in p and "MapInArrow" in p and "lang" not in p


def test_tokens_stay_on_the_jvm(spark, data):
    p = plan(tokens.tokenised(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text"))
    assert "Exchange" not in p and "Python" not in p and "Arrow" not in p and p.count("regexp_extract_all") == 1


def test_set_join_is_an_equi_join(spark, data):
    units = unit_rows(spark.read.parquet(f"{data}/units.parquet"))
    for df in (pairs.jaccard_pairs(units), pairs.candidate_pairs(units), pairs.probe_pairs(units, units)):
        p = plan(df)
        assert "NestedLoop" not in p and "Cartesian" not in p and "Python" not in p


def test_cull_moves_no_sets(spark, data):
    units = spark.read.parquet(f"{data}/units.parquet").select("unit_id", "lang", F.col("fingerprints").alias("fps"))
    culled = pairs.cull(units)
    # only (lang, fp) counts and the caps are shuffled; the sets stay in their partitions
    assert "fps" not in " ".join(x for x in plan(culled).splitlines() if "Exchange hashpartitioning" in x) and culled.count() == 200
