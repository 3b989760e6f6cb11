"""Streams that stop, repeat and restart; progress and epochs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from relscope.operators import replies as R
from relscope.operators import scoring
from relscope.plans import fixtures as fx
from relscope.plans import replies_fixture as rfx
from relscope.streaming import jobs as S

KEYS = ("run_id", "strategy", "batch_id")


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def counted(df):
    return sorted(map(str, df.collect()))


def test_decoded_rows_after_stop_repeat_and_restart(spark):
    src, out = folder(), folder()
    rep = rfx.build(spark, SF_SMALL).where("run_id IN (10, 41, 72)")
    rows = rep.collect()
    rep = spark.createDataFrame(rows, rep.schema)
    want = counted(R.decode_predictions(R.parse_replies(rep, KEYS), KEYS))

    def run(**more):
        S.stream_predictions(spark, src, rep.schema, out + "/p", out + "/ckpt", KEYS, decoded_dir=out + "/d", **more)
        return counted(spark.read.parquet(out + "/d").drop("epoch"))

    rep.where("batch_id % 2 = 0").coalesce(1).write.mode("append").parquet(src)
    first = run()
    assert 0 < len(first) < len(want)
    rep.where("batch_id % 2 = 0").coalesce(1).write.mode("append").parquet(src)  # the same replies again
    assert run() == first
    # All of them, and each twice in one file; another answer for a batch that has one doesn't count.
    rep.union(rep).coalesce(1).write.mode("append").parquet(src)
    rep.limit(3).withColumn("reply", F.lit("[]")).coalesce(1).write.mode("append").parquet(src)
    assert run() == want
    assert run() == want  # nothing new
    assert spark.read.parquet(out + "/p").count() == rep.count()


def test_an_epoch_that_failed_is_written_again(spark, monkeypatch):
    src, out = folder(), folder()
    rows = rfx.build(spark, SF_SMALL).where("run_id = 41").collect()
    rep = spark.createDataFrame(rows, rfx.build(spark, SF_SMALL).schema)
    rep.coalesce(1).write.mode("append").parquet(src)
    args = (spark, src, rep.schema, out + "/p", out + "/ckpt", KEYS)
    monkeypatch.setattr(R, "decode_predictions", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(Exception):
        S.stream_predictions(*args, decoded_dir=out + "/d")
    monkeypatch.undo()
    S.stream_predictions(*args, decoded_dir=out + "/d")
    assert counted(spark.read.parquet(out + "/d").drop("epoch")) == counted(R.decode_predictions(R.parse_replies(rep, KEYS), KEYS))
    assert spark.read.parquet(out + "/p").count() == rep.count()


def test_replays_within_a_window(spark):
    src, out = folder(), folder()
    rep = spark.createDataFrame([(1, "B", i, 1, "[1]") for i in range(4)], "run_id long, strategy string, batch_id long, n_expected long, reply string")
    for _ in range(2):
        rep.coalesce(1).write.mode("append").parquet(src)
        S.stream_predictions(spark, src, rep.schema, out + "/p", out + "/ckpt", KEYS, replay_window="1 day")
    assert spark.read.parquet(out + "/p").count() == 4


def test_progress_at_every_epoch_and_old_epochs_go(spark):
    src, plan, out = folder(), folder(), folder()
    schema = "pair_id string, run_id long, strategy string, support long, pred_attack int, pred_support int, pred_neither int"
    pred = spark.createDataFrame([(f"p{i}", 1 + i % 2, "B", 0, 1, 0, None) for i in range(40)], schema)
    batches = spark.createDataFrame([(1, "B", 20), (2, "B", 20), (2, "B", 20), (3, "B", 5)], "run_id long, strategy string, n_items long")
    batches.coalesce(1).write.mode("append").parquet(plan)

    def run(keep):
        return {r.run_id: r for r in S.stream_run_summary(spark, src, pred.schema, out + "/cells", out + "/ckpt", expected_dir=plan, keep_epochs=keep).collect()}

    def at(epoch=None):
        return {r.run_id: (r.n_done, r.n_total, r.progress) for r in S.progress_at(spark, out + "/cells", pred.schema, epoch=epoch).collect()}

    assert run(100) == {}
    assert at() == {1: (0, 20, 0.0), 2: (0, 40, 0.0), 3: (0, 5, 0.0)}
    for k in range(4):
        pred.where(f"CAST(substring(pair_id, 2) AS INT) div 10 = {k}").coalesce(1).write.mode("append").parquet(src)
        got = run(100)
        assert {i: (r.n_done, r.n_total, r.progress, r.n_evaluated) for i, r in got.items()} == {
            1: (5 * (k + 1), 20, (k + 1) / 4, 5 * (k + 1)), 2: (5 * (k + 1), 40, (k + 1) / 8, 5 * (k + 1))}
    known = S.epochs(spark, out + "/cells")
    assert [at(e)[1][0] for e in known if at(e)[1][0]] == [5, 10, 15, 20]
    spark.createDataFrame([(4, "B", 7)], batches.schema).coalesce(1).write.mode("append").parquet(plan)
    run(2)
    assert len(S.epochs(spark, out + "/cells")) == 2 and at()[4] == (0, 7, 0.0) and at()[1] == (20, 20, 1.0)


def test_an_empty_folder_gives_an_empty_summary(spark):
    src, out = folder() + "/none", folder()
    pred = fx.predictions(spark, SF_SMALL)
    for _ in range(2):
        got = S.stream_run_summary(spark, src, pred.schema, out + "/cells", out + "/ckpt")
        assert got.collect() == [] and got.columns == scoring.run_summary(pred, keys=["run_id"]).columns
    assert S.stream_predictions(spark, out + "/no-replies", rfx.build(spark, SF_SMALL).schema, out + "/p", out + "/ckpt2") == out + "/p"
    assert not os.path.exists(out + "/p")


def test_stream_inputs_have_more_files_the_more_tasks_their_scan_has(spark):
    from relscope.plans import catalog
    rows = spark.range(0, 9600, 1, 12)
    assert catalog._for_stream(rows, 4).rdd.getNumPartitions() == 48
    assert catalog._for_stream(rows.coalesce(1), 4).rdd.getNumPartitions() == 4
    src = folder()
    catalog._for_stream(rows, 4).write.mode("append").parquet(src)
    assert catalog._share(spark, src, 4) == 12 and catalog._share(spark, src, 100) == 1 and catalog._share(spark, src + "/none", 4) == 1
