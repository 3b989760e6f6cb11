"""End-to-end jobs: the three workflows of the evaluated system as Spark jobs.

* ``evaluation_job``  pairs -> predictions (committed as a run, resumable) -> one
  summary row per strategy appended to the run overview (with metadata).
* ``comparison_job``  run overview -> annotated runs, z-tests, Markdown report.
* ``relevance_job``   predictions of strategy D -> rating agreement.

Settings are arguments (no constants edited in source); ``code_version``
replaces the git-hash lookup.
"""

from __future__ import annotations

import os
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relscope.operators import comparisons as C
from relscope.operators import inference, ratings, reply_store, scoring
from relscope.plans.specs import STUDY_SPECS, spec_frame
from relscope.schema import RUN_METADATA_COLS, RUN_METRIC_COLS
from relscope.sources import files, sinks
from relscope.sources.pairs import check_unique_ids, read_pairs
from relscope.sources.predictions import read_predictions
from relscope.sources.runs import read_runs


def run_metadata(spark: SparkSession, config: dict, strategies) -> DataFrame:
    """One metadata row per strategy (timestamp, code version, model, ...)."""
    from relscope.session import values_frame
    ts = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    rows = [(ts, config.get("code_version", "unknown"), config.get("model"), s,
             int(config.get("few_shot_n_used", {}).get(s, config.get("few_shot_n", 0))),
             config.get("dataset_file"), config.get("limit"), config.get("batch_size"),
             config.get("delay_seconds"), config.get("max_retries"))
            for s in strategies]
    return values_frame(spark, rows, "timestamp string, git_commit string, model string, "
                        "strategy string, few_shot_n int, dataset_file string, limit_config int, "
                        "batch_size int, delay_seconds double, max_retries int")


def overview_rows(predictions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Run summary per strategy joined to its metadata, in the published column order."""
    summ = scoring.run_summary(predictions, keys=[])
    j = metadata.join(summ, "strategy")  # one row per strategy on both sides
    return j.select(*RUN_METADATA_COLS, *RUN_METRIC_COLS)


def evaluation_job(spark: SparkSession, pairs_path: str, strategies, client_factory,
                   out_dir: str, few_shot_n: int = 0, limit: int | None = None,
                   batch_size: int = 10, max_retries: int = 2, retry_wait: float = 5.0,
                   delay_seconds: float = 0.0, model: str | None = None,
                   code_version: str = "unknown", relevance_col: str | None = None,
                   parallelism: int | None = None, seed: int = 42, run_id: str | None = None,
                   retry_failed: bool = False, chunk: int = reply_store.CHUNK) -> DataFrame:
    """Evaluate pairs with a model and record the results under ``run_id`` (a new one by default).

    Replies are kept in ``out_dir/replies`` every ``chunk`` calls or ten seconds, predictions committed as one run to
    ``out_dir/predictions``, where runs stay side by side, and one row per strategy is
    appended to ``out_dir/overview``; returns those rows.  A run that died is taken up
    by calling again with its ``run_id`` and the same arguments: prompts whose reply is kept aren't sent again
    (failed ones only with ``retry_failed``), and a finished run's overview rows aren't appended twice."""
    run_id = run_id or f"{model or 'model'}-{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    pairs = check_unique_ids(read_pairs(spark, pairs_path, identity="content"))
    if relevance_col is None and "relevance_human_labeled" in pairs.columns:
        relevance_col = "relevance_human_labeled"
    preds = inference.evaluate_pairs(pairs, strategies, client_factory, few_shot_n, limit,
                                     batch_size, seed, max_retries, retry_wait, delay_seconds,
                                     relevance_col, parallelism, persist=False,
                                     store=os.path.join(out_dir, "replies"), scope=run_id, retry_failed=retry_failed, chunk=chunk)
    pred_path = os.path.join(out_dir, "predictions")
    sinks.write_predictions(preds, pred_path, run_id=run_id, meta={"model": model, "dataset_file": pairs_path})
    stored = read_predictions(spark, pred_path, runs=[run_id])
    # The examples that the prompts really had: fewer than asked for where a class is short.
    used = {r["strategy"]: r["n"] for r in stored.groupBy("strategy").agg(F.max("few_shot_n").alias("n")).collect()}
    meta = run_metadata(spark, {"code_version": code_version, "model": model,
                                "few_shot_n": 0, "few_shot_n_used": used,
                                "dataset_file": pairs_path, "limit": limit,
                                "batch_size": batch_size, "delay_seconds": float(delay_seconds),
                                "max_retries": max_retries}, strategies)
    rows = overview_rows(stored, meta)
    # Later runs get later numbers; a run has one row per strategy.
    order = F.row_number().over(Window.orderBy("strategy"))
    numbered = rows.withColumn("run_seq", F.lit(time.time_ns() // 1000).cast("long") + order).withColumn("run_id", F.lit(run_id))
    overview = os.path.join(out_dir, "overview")
    if not _recorded(spark, overview, run_id):
        sinks.append_run_summary(numbered, overview)
    return rows


def _recorded(spark: SparkSession, overview: str, run_id: str) -> bool:
    """Whether the overview has this run's rows (it appends them in one write)."""
    if not files.exists(spark, overview):
        return False
    stored = spark.read.option("mergeSchema", True).parquet(overview)
    return "run_id" in stored.columns and not stored.where(F.col("run_id") == run_id).isEmpty()


def comparison_job(spark: SparkSession, runs_path: str, out_dir: str, specs=None) -> DataFrame:
    """Annotated runs, spec-driven z-tests and the report, written to ``out_dir``."""
    runs = C.annotate_runs(read_runs(spark, runs_path))
    cmp_ = C.compare_runs(spec_frame(spark, specs or STUDY_SPECS), runs)
    sinks.write_annotated_runs(runs.drop("run_seq"), os.path.join(out_dir, "runs_annotated"))
    sinks.write_comparisons(cmp_, os.path.join(out_dir, "pairwise_ztests_accuracy"))
    sinks.write_report(C.comparison_report(cmp_), os.path.join(out_dir, "evaluation_report"))
    return cmp_


def relevance_job(spark: SparkSession, predictions_path: str, labels_path: str | None = None,
                  key: str = "orig_idx", runs="current") -> DataFrame:
    """Rating agreement of strategy D, of the current run unless ``runs`` says; labels are joined by key when a label
    file is given (instead of trusting row positions), and a key that the file has twice stops the job."""
    preds = read_predictions(spark, predictions_path, runs=runs)
    preds = scoring.filter_strategy(preds, ["D"])
    if labels_path is not None:
        from relscope.sources.predictions import read_human_labels
        labels = read_human_labels(spark, labels_path)
        preds = ratings.attach_labels(preds, check_unique_ids(labels.where(F.col(key).isNotNull()), key), key)
    return ratings.rating_agreement_all(preds)
