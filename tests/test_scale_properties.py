"""Plan shapes and hot-key behaviour that the scale design depends on."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from relscope.operators import sampling, scoring
from relscope.plans import fixtures as fx


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_run_scored_exactly(spark):
    # run 1 holds 90% of the rows
    rows = [("p%d" % i, 1 if i % 10 else 2, "C", i % 3, int(i % 4 == 0), int(i % 4 == 1),
             int(i % 4 == 2), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "pair_id string, run_id long, strategy string, support long, "
                                     "pred_attack int, pred_support int, pred_neither int, "
                                     "pred_relevance double")
    got = {r.run_id: r for r in scoring.run_summary(df).collect()}
    pdf = pd.DataFrame(rows, columns=["pair_id", "run_id", "strategy", "support", "a", "s", "n", "r"])
    for run, g in pdf.groupby("run_id"):
        flag = g[["a", "s", "n"]].to_numpy()
        correct = sum(flag[i][g.support.iloc[i]] == 1 for i in range(len(g)))
        assert got[run].n_correct == correct and got[run].n_evaluated == len(g)


def test_hot_group_positions_split_over_buckets(spark):
    df = spark.createDataFrame([(f"h{i}", "hot") for i in range(2000)] +
                               [(f"c{i}", "cold") for i in range(7)], "pair_id string, g string")
    out = sampling.seeded_shuffle(df, group_cols=["g"], rows_per_bucket=50).toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part.pos) == list(range(len(part)))
        assert list(part.sort_values("pos").shuffle_key) == sorted(part.shuffle_key)
    keyed = (df.withColumn("k", sampling.order_key()).groupBy("g").count()).collect()
    assert {r.g: r["count"] for r in keyed}["hot"] == 2000


def test_scoring_aggregates_before_the_shuffle(spark):
    plan = _plan(scoring.run_summary(fx.predictions(spark, SF_SMALL)))
    first_exchange = plan.rfind("Exchange")
    assert "partial_count" in plan[first_exchange:]


def test_no_label_logic_inlined_into_the_scan(spark):
    df = scoring.confusion_matrix(fx.predictions(spark, SF_SMALL))
    df.collect()
    plan = _plan(df)
    longest = max(len(line) for line in plan.splitlines())
    assert longest < 3000, longest


def test_small_quota_sampling_limits_before_the_shuffle(spark):
    df = fx.predictions(spark, SF_SMALL).select("pair_id", "support")
    plan = sampling.stratified_sample(df, 10, (0, 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_exclusion_broadcasts_the_sample(spark):
    df = fx.predictions(spark, SF_SMALL).select("pair_id", "support")
    fs = sampling.stratified_sample(df, 10, (0, 1, 2))
    plan = _plan(sampling.exclude_few_shot(df, fs))
    assert re.search(r"BroadcastHashJoin.*LeftAnti", plan)
