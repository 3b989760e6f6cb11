"""End-to-end jobs on the shipped files and on derived pair sets."""

import os
import tempfile

import pandas as pd
import pytest

from conftest import SF_SMALL, golden
from relscope.plans import jobs


def test_comparison_job_writes_published_table(spark):
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    jobs.comparison_job(spark, golden("ResultOverview_allTests.csv"), out)
    files = [f for f in os.listdir(os.path.join(out, "pairwise_ztests_accuracy")) if f.endswith(".csv")]
    got = pd.read_csv(os.path.join(out, "pairwise_ztests_accuracy", files[0]), float_precision="round_trip")
    exp = pd.read_csv(golden("pairwise_ztests_accuracy.csv"), float_precision="round_trip")
    assert list(got.columns) == list(exp.columns)
    assert list(got.comparison) == list(exp.comparison)
    assert max(abs(got.z - exp.z)) == 0.0
    assert list(got.significant) == list(exp.significant)
    report = os.path.join(out, "evaluation_report")
    text = "".join(open(os.path.join(report, f)).read() for f in sorted(os.listdir(report))
                   if f.startswith("part-"))
    assert "| A b5 vs b20 (0-shot) | 0.6400 (1000) | 0.6830 (940) | -4.30 | -1.998 | 0.0457 | ✓ |" in text


def test_relevance_job_joins_labels_by_key(spark):
    got = {r.comparison: r for r in jobs.relevance_job(
        spark, golden("NR_WebDataset_D_Batch10_zeroShot_HumanLabeled_2.csv"),
        golden("QBAF_relevanceScoreHumanLabeled.csv")).collect()}
    assert round(got["model_vs_h2"].mae, 6) == 0.39


def test_evaluation_job_end_to_end(spark):
    from relscope.operators.stub_model import stub_factory
    from relscope.plans import fixtures as fx
    src = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    path = os.path.join(src, "pairs.csv")
    (fx.pairs(spark, SF_SMALL).select("arg1", "arg2", "support", "type")
     .write.option("header", True).option("escape", '"').csv(path))
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = jobs.evaluation_job(spark, path, ["B", "C"], stub_factory, out, few_shot_n=4,
                               limit=40, batch_size=10, retry_wait=0, model="stub",
                               code_version="test").collect()
    assert sorted(r.strategy for r in rows) == ["B", "C"]
    assert all(r.n_evaluated == 40 and r.model == "stub" and r.few_shot_n == 4 for r in rows)
    again = spark.read.parquet(os.path.join(out, "overview")).count()
    assert again == 2


def test_jobs_read_what_the_evaluation_stored(spark):
    from relscope.operators.stub_model import stub_factory
    from relscope.plans import fixtures as fx
    from relscope.sources.predictions import read_predictions
    from relscope.sources.runs import read_runs
    src, out = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(2))
    path = os.path.join(src, "WebDataset.csv")
    fx.pairs(spark, SF_SMALL).select("arg1", "arg2", "support", "type").write.option("header", True).option("escape", '"').csv(path)
    for model in ("first", "second"):
        jobs.evaluation_job(spark, path, ["D", "B"], stub_factory, out, limit=20, retry_wait=0, model=model, code_version="test")
    runs = read_runs(spark, os.path.join(out, "overview")).orderBy("run_seq").collect()
    assert [(r.model, r.strategy) for r in runs] == [("first", "B"), ("first", "D"), ("second", "B"), ("second", "D")]
    assert runs[0].timestamp is not None and len({r.run_seq for r in runs}) == 4
    spec = ("5_cross_model", "B first vs second", "B", "model", "Web", "first", "B", 0, "Web", 10, "first", "second", "B", 0, "Web", 10, "second")
    compared = jobs.comparison_job(spark, os.path.join(out, "overview"), os.path.join(out, "compared"), [spec]).collect()
    assert [(r.n1, r.n2, r.z) for r in compared] == [(20, 20, 0.0)]  # the same stub twice
    predictions = os.path.join(out, "predictions")
    ids = [r.orig_idx for r in read_predictions(spark, predictions).where("strategy = 'D'").select("orig_idx").collect()]
    assert len(ids) == 20
    labels = os.path.join(src, "labels.csv")
    pd.DataFrame({"orig_idx": ids, "relevance human labeled": 0.5, "relevance human labeled #2": 0.25}).to_csv(labels, index=False)
    got = {r.comparison: r for r in jobs.relevance_job(spark, predictions, labels).collect()}
    assert got["model_vs_h1"].n == 20


def test_ids_beyond_a_double_stay(spark):
    from relscope.sources.predictions import read_predictions
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "p.csv")
    pd.DataFrame({"orig_idx": [str(2 ** 53 + 1), "7.0", "junk"]}).to_csv(path, index=False)
    got = [r.orig_idx for r in read_predictions(spark, path).select("orig_idx").collect()]
    assert got == [2 ** 53 + 1, 7, None]
