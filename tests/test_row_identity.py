"""Row identity of the sources, rejects, one-scan metrics and resumable streams."""

import math
import os
import tempfile
from decimal import Decimal, getcontext

import pytest

from conftest import SF_SMALL
from relscope.operators import human, scoring
from relscope.plans import fixtures as fx
from relscope.sources import pairs as P
from relscope.streaming import jobs as S


def _folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "20k")
    yield
    spark.conf.set(key, old)


def test_parquet_positions_hold_over_split_files(spark, small_splits):
    path = _folder() + "/pairs.parquet"
    n = 30_000
    (spark.range(0, 2 * n, 1, 2).selectExpr("id % 30000 AS place", "md5(string(id)) AS arg1", "'b' AS arg2",
                                            "id % 3 AS support")
     .write.option("parquet.block.size", 64 * 1024).parquet(path))
    df = P.read_pairs(spark, path)
    assert df.rdd.getNumPartitions() > 4
    assert df.filter("orig_idx <> place").count() == 0
    assert df.select("pair_id").distinct().count() == 2 * n
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_of_one_name_get_different_ids(spark):
    path = _folder() + "/pairs.csv"
    for sub in ("a", "b"):
        os.makedirs(f"{path}/{sub}")
        with open(f"{path}/{sub}/x.csv", "w") as f:
            f.write("arg1,arg2,support,orig_idx\n" + "".join(f"p{i},q,{i % 3},{i}\n" for i in range(10)))
    assert P.read_pairs(spark, f"{path}/a/x.csv").first().pair_id == "x.csv#0"
    both = P.read_pairs_csv(spark, path + "/*")
    assert both.select("pair_id").distinct().count() == 20
    P.check_unique_ids(both)
    with pytest.raises(ValueError):
        P.check_unique_ids(both.union(both.limit(1)))


def test_arrow_files_keep_large_integers_and_hold_one_copy(spark):
    path = _folder()
    rows = [("a", "b", 2**53 + 1, "t"), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "arg1 string, arg2 string, support long, type string").coalesce(1)
    for _ in range(2):  # a repeated task replaces its file
        P.write_pairs_arrow(df, path).collect()
    got = P.read_pairs_arrow(spark, path).orderBy("orig_idx").collect()
    assert [(r.arg1, r.arg2, r.support, r.type) for r in got] == rows
    assert [r.orig_idx for r in got] == [0, 1]


SCHEMA = ("pair_id string, run_id long, strategy string, support long, pred_attack int, "
          "pred_support int, pred_neither int")


def test_rejects_are_counted(spark):
    rows = [("a", 1, "C", 0, 1, 0, 0), ("b", 1, "C", 7, 1, 0, 0), ("c", 1, "C", None, 1, 0, 0),
            ("d", 2, "D", 9, 1, 0, 0), ("e", 3, "A", 9, 1, 0, 0), ("f", 1, "C", 1, None, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    acc = {r.run_id: r for r in scoring.accuracy(df).collect()}
    assert (acc[1].n_valid, acc[1].n_rejected, acc[1].accuracy) == (1, 2, 1.0)
    assert (acc[2].n_valid, acc[2].n_rejected, acc[2].accuracy) == (0, 1, None)
    assert (acc[3].n_valid, acc[3].n_rejected) == (1, 0)
    summ = {r.run_id: r for r in scoring.run_summary(df).collect()}
    assert (summ[1].n_evaluated, summ[1].n_rejected, summ[1].predicted_count_attack) == (2, 2, 1)
    assert sorted(r.pair_id for r in scoring.rejected_predictions(df).collect()) == ["b", "c", "d"]
    assert sorted(r.pair_id for r in scoring.valid_rows(df).collect()) == ["a", "e"]


def test_human_counts_without_a_complete_row(spark):
    df = spark.createDataFrame([(0, None), (None, 1)], "gold long, human long")
    r = human.human_agreement(df).first()
    assert (r.n, r.n_dropped, r.n_rejected) == (0, 2, 0)
    df = spark.createDataFrame([(0, 0), (5, 1), (1, 6), (1, None)], "gold long, human long")
    r = human.human_agreement(df).first()
    assert (r.n, r.n_dropped, r.n_rejected, r.n_human_rejected) == (2, 1, 1, 1)


@pytest.mark.parametrize("metric", [
    scoring.confusion_matrix, scoring.class_metrics, scoring.macro_f1, scoring.count_check,
    scoring.gold_distribution, scoring.predicted_distribution, scoring.run_summary, scoring.accuracy])
def test_metrics_read_the_predictions_once(spark, metric):
    path = _folder() + "/p"
    fx.predictions(spark, SF_SMALL).write.parquet(path)
    df = metric(spark.read.parquet(path))
    df.collect()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan


def test_streams_go_on_where_they_stopped(spark):
    src, out = _folder(), _folder()
    pred = fx.predictions(spark, SF_SMALL)
    half = pred.filter("run_id % 2 = 0")
    half.repartition(2).write.mode("append").parquet(src)

    def run():
        return sorted(map(tuple, S.stream_run_summary(spark, src, pred.schema, out + "/cells",
                                                      out + "/ckpt").collect()))
    batch = lambda d: sorted(map(tuple, scoring.run_summary(d, keys=["run_id"]).collect()))
    assert run() == batch(half)
    assert run() == batch(half)  # nothing new
    pred.filter("run_id % 2 = 1").repartition(2).write.mode("append").parquet(src)
    assert run() == batch(pred)


def test_streamed_predictions_keep_their_items(spark):
    from relscope.operators import replies as R
    from relscope.plans import replies_fixture as rfx
    src, out = _folder(), _folder()
    keys = ("run_id", "strategy", "batch_id")
    rep = rfx.build(spark, SF_SMALL)
    rep.filter("batch_id % 2 = 0").write.mode("append").parquet(src)
    S.stream_predictions(spark, src, rep.schema, out + "/p", out + "/ckpt", keys)
    rep.filter("batch_id % 2 = 1").write.mode("append").parquet(src)
    S.stream_predictions(spark, src, rep.schema, out + "/p", out + "/ckpt", keys)
    got = R.decode_predictions(spark.read.parquet(out + "/p"), keys)
    exp = R.decode_predictions(R.parse_replies(rep, keys), keys)
    assert got.count() == exp.count() > 0
    assert got.exceptAll(exp).count() == 0


def _exact_p(r: float, df: int) -> Decimal:
    """Two-sided tail for an even number of degrees of freedom: a finite sum."""
    getcontext().prec = 60
    r = abs(Decimal(r))
    c2, term, total = 1 - r * r, Decimal(1), Decimal(1)
    for i in range(1, (df - 2) // 2 + 1):
        term *= c2 * (2 * i - 1) / (2 * i)
        total += term
    return 1 - r * total


@pytest.mark.parametrize("n", [4, 10, 102, 1002, 2002, 2004, 20_002])
@pytest.mark.parametrize("t", [0.1, 1.0, 2.5, 6.0])
def test_pearson_p_against_exact_sums(n, t):
    from relscope.functions.stats import _pearson_p
    r = t / math.sqrt(n - 2 + t * t)
    exact = _exact_p(r, n - 2)
    assert abs(Decimal(_pearson_p(r, n)) - exact) < exact * Decimal("1e-10")


def test_pearson_p_does_not_drift_with_n():
    from relscope.functions.stats import _pearson_p
    for n in (10**8, 10**10, 10**12):
        r = 1.0 / math.sqrt(n - 2 + 1.0)
        limit = math.erfc(math.sqrt(0.5))
        assert abs(_pearson_p(r, n) / limit - 1) < 1e-10 + 2.0 / n
    assert _pearson_p(1.0, 2) == 1.0
