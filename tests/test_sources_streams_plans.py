import os
import re

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assaykit import session
from assaykit.operators import metrics, models, ordered, profile, scoring, similarity, splits
from assaykit.plans import experiment as ex
from assaykit.plans import fixtures as fx
from assaykit.plans import model_queries
from assaykit.plans.catalog import ORACLES, QUERIES
from assaykit.sources import tables as src
from assaykit.streaming import jobs


def test_names(spark):
    df = spark.createDataFrame([(1.0, 2)], "AlogP double, x int")
    assert src.normalize_columns(df).columns == ["ALOGP", "x"]
    assert src.normalize_columns(spark.createDataFrame([(1.0,)], "alogp double")).columns == ["alogp"]
    assert src.feature_columns(["ECFP4", "RDK", "MW", "MACCS"]) == ["ECFP4", "RDK", "MACCS"]
    assert src.known_fingerprints(["MW", "RDK", "ECFP4"]) == ["ECFP4", "RDK"]
    assert src.id_column(["SMILES", "RandomID"]) == "RandomID" and src.id_column(["MW"]) is None
    with pytest.raises(ValueError, match="missing column"):
        src.require_columns(df, ["ALOGP", "y"])


def test_row_cap_needs_an_order(spark):
    with pytest.raises(ValueError, match="order_by"):
        src.row_cap(spark.range(3), 1, None)


def test_run_metrics_without_the_positive_class(spark, tmp_path):
    spark.createDataFrame([(0.5,)], "roc_auc_score double").write.json(f"{tmp_path}/featsel__A_B_20250101-1/test_metrics.json")
    row = ex.sweep_report(src.read_run_metrics(spark, str(tmp_path))).first()
    assert tuple(row) == ("A, B", 0.0, 0.0, 0.0, 0.5)


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x").startswith(configured)


def test_broadcast_hint_only_below_the_bound(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    df = spark.range(10)
    assert "broadcast" in plan(session.broadcast_if_small(df, 10))
    assert "broadcast" not in plan(session.broadcast_if_small(df, 9))


def test_compounds_of_odd_lines(spark, tmp_path):
    """Missing keys, counts of several digits, an order without lines and the short second fingerprint; no text is built element by element in the plan."""
    lines = [(1, 3, 5)] * 12 + [(1, 64 + 3, None), (1, None, 32 + 5), (1, 63, 31), (101, 0, 31), (101, 0, 30), (3, None, None), (None, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, 1, "1-URGENT", 1.0) for k in (1, 2, 3, 101)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    table = fx.compounds(spark, str(tmp_path))
    text = lambda width, held: ",".join(str(held.get(i, 0)) for i in range(width))
    got = {r["compound_id"]: (r["fp_part"], r["fp_supp"]) for r in table.collect()}
    assert got == {
        1: (text(64, {3: 13, 63: 1}), text(32, {5: 13, 31: 1})), 2: (None, None), 3: (text(64, {}), text(32, {})), 101: (text(64, {0: 2}), text(31, {30: 1})),
    }
    assert "lambdafunction" not in plan_of(table)


def test_stream_scores_builds_the_compounds_once(spark, small, monkeypatch):
    built, build = [], fx.compounds
    monkeypatch.setattr(fx, "compounds", lambda *a: built.append(a) or build(*a))
    scored = model_queries.stream_scores(spark, small)
    assert scored.count() == build(spark, small).where("compound_id % 5 = 0").count() and len(built) == 1


def test_scored_stream_equals_batch_and_resumes(spark, small, tmp_path):
    table = fx.compounds(spark, small)
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    table.where("compound_id % 2 = 0").repartition(3).write.parquet(source)
    stages = [*ex.feature_stages(ex.ExperimentConfig(fingerprints=["fp_part"], numerics=["mw"]), {"fp_part": 64}),
              *models.classifier_stages("xgboost", "label", {"n_estimators": 3, "max_depth": 2})]
    model = Pipeline(stages=stages).fit(table)
    ids = ("compound_id",)
    run = lambda: jobs.score_files(spark, model, source, table.schema, sink, state, ids, 1).awaitTermination()
    run()
    assert spark.read.parquet(sink).count() == table.where("compound_id % 2 = 0").count()
    table.where("compound_id % 2 = 1").write.mode("append").parquet(source)
    run()
    want = {tuple(r) for r in scoring.batch_scores(model, table, ids).collect()}
    got = [tuple(r) for r in spark.read.parquet(sink).collect()]
    assert set(got) == want and len(got) == len(want)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_the_columns_used(spark, small):
    plan = plan_of(src.read_compounds(spark, f"{small}/orders.parquet", [], ["o_totalprice"], None, ["o_orderkey"]))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", plan)


def test_top_values_are_limited_before_the_shuffle(spark, small):
    plan = plan_of(profile.top_values(fx.table(spark, small, "events"), ["event_type", "props"]))
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize(
    "build",
    [
        lambda s, d: metrics.roc_auc(fx.expert_scores(s, d), "label", "a"),
        lambda s, d: metrics.pr_curve(fx.expert_scores(s, d), "label", "a"),
        lambda s, d: ordered.global_rank(fx.labels(s, d), ["compound_id"]),
        lambda s, d: splits.stratified_group_folds(fx.labels(s, d), "group_id", "label", 5),
        lambda s, d: splits.stratified_halves(fx.labels(s, d), "compound_id", "label"),
        lambda s, d: profile.describe_numeric(fx.table(s, d, "orders")),
        lambda s, d: similarity.similarity_pairs(fx.fp_bits(s, d), "compound_id", "bits"),
    ],
)
def test_no_quadratic_join_and_no_single_task_window_over_rows(spark, small, build):
    plan = plan_of(build(spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # a window without partition keys is allowed only over per-partition totals
    for line in plan.splitlines():
        if "Window [" in line and "[__part" not in line:
            assert "__n" in line or "__pos" in line or "__cnt" in line or "__p" in line, line


def test_queries_follow_the_naming_rules():
    assert len(QUERIES) > 80 and set(QUERIES) <= set(entry.queries())
    assert not [n for n in QUERIES if n == "pipeline" or re.match(r"op\d+_", n)]
    assert set(ORACLES) <= set(QUERIES)


def test_discard_deletes_intermediate_tables_only(spark, small):
    table = session.materialize(spark.range(10), "gone")
    folder = table.inputFiles()[0].rpartition("/")[0].removeprefix("file://").replace("file:", "")
    assert os.path.isdir(folder)
    session.discard(table)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError):
        session.discard(spark.read.parquet(f"{small}/orders.parquet"))
