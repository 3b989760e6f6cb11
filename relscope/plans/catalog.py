"""Registered queries: key -> (Spark query, DuckDB oracle SQL or None).

Each Spark query takes ``(spark, sf_dir)``, reads the driver's parquet tables
(through the fixture views) and returns a DataFrame over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.functions import labels as L
from relscope.operators import comparisons as cmp
from relscope.operators import human as hum
from relscope.operators import prompting
from relscope.operators import sampling
from relscope.operators.inference import persist_replies
from relscope.operators import ratings
from relscope.operators import replies as rep
from relscope.operators import scoring
from relscope.plans import fixtures as fx
from relscope.plans import oracle_compare as oc
from relscope.plans import oracle_ratings as orat
from relscope.plans import oracle_replies as orep
from relscope.plans import replies_fixture as rfx
from relscope.plans import oracle_sampling as osa
from relscope.plans import oracle_scoring as os_
from relscope.plans.specs import FIXTURE_SPECS, spec_frame
from relscope.schema import STRATEGIES

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, Callable[[], str] | None]] = {}


def register(key: str, oracle: Callable[[], str] | None = None):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = (fn, oracle)
        return fn
    return deco


# --------------------------------------------------------------------------- scoring
@register("run_summary", os_.run_summary)
def q_run_summary(spark, sf_dir):
    return scoring.run_summary(fx.predictions(spark, sf_dir))


@register("accuracy", os_.accuracy)
def q_accuracy(spark, sf_dir):
    return scoring.accuracy(fx.predictions(spark, sf_dir))


@register("gold_distribution", os_.gold_distribution)
def q_gold_distribution(spark, sf_dir):
    return scoring.gold_distribution(fx.predictions(spark, sf_dir))


@register("predicted_distribution", os_.predicted_distribution)
def q_predicted_distribution(spark, sf_dir):
    return scoring.predicted_distribution(fx.predictions(spark, sf_dir))


@register("predicted_flag_counts", os_.predicted_flag_counts)
def q_predicted_flag_counts(spark, sf_dir):
    return scoring.predicted_flag_counts(fx.predictions(spark, sf_dir))


@register("confusion_matrix", os_.confusion_matrix)
def q_confusion_matrix(spark, sf_dir):
    return scoring.confusion_matrix(fx.predictions(spark, sf_dir))


@register("class_counts", os_.class_counts)
def q_class_counts(spark, sf_dir):
    cm = scoring.class_metrics(fx.predictions(spark, sf_dir))
    return cm.select("run_id", "strategy", "class", "class_seq", "n_scored",
                     "tp", "fp", "fn", "tn", "count_ok")


@register("class_f1", os_.class_f1)
def q_class_f1(spark, sf_dir):
    cm = scoring.class_metrics(fx.predictions(spark, sf_dir))
    return cm.select("run_id", "strategy", "class", "class_seq", "precision", "recall", "f1")


@register("macro_f1", os_.macro_f1)
def q_macro_f1(spark, sf_dir):
    return scoring.macro_f1(fx.predictions(spark, sf_dir))


@register("count_check", os_.count_check)
def q_count_check(spark, sf_dir):
    return scoring.count_check(fx.predictions(spark, sf_dir))


@register("valid_predictions", os_.valid_predictions)
def q_valid_predictions(spark, sf_dir):
    return scoring.valid_predictions(fx.predictions(spark, sf_dir))


@register("valid_rows", os_.valid_rows)
def q_valid_rows(spark, sf_dir):
    return scoring.valid_rows(fx.predictions(spark, sf_dir)).select("pair_id", "run_id", "strategy", "support")


@register("rejected_predictions", os_.rejected_predictions)
def q_rejected_predictions(spark, sf_dir):
    moved = fx.predictions(spark, sf_dir).withColumn("support", F.col("support") + 1)
    return scoring.rejected_predictions(moved).select("pair_id", "run_id", "strategy", "support")


@register("strategies_present", os_.strategies_present)
def q_strategies_present(spark, sf_dir):
    return scoring.strategies_present(fx.predictions(spark, sf_dir))


@register("filter_strategy", os_.filter_strategy)
def q_filter_strategy(spark, sf_dir):
    # 'X' is not a strategy and is skipped, as in the reference's letter filter.
    df = scoring.filter_strategy(fx.predictions(spark, sf_dir), ["C", "D", "X"])
    return df.select("pair_id", "run_id", "strategy", "support")


@register("support_label", os_.support_label)
def q_support_label(spark, sf_dir):
    df = fx.predictions(spark, sf_dir)
    return df.select("pair_id", "run_id", "support", L.support_label("support").alias("support_label"))


def _derive(spark, sf_dir, letters):
    ok, _ = scoring.split_rejects(fx.predictions(spark, sf_dir))
    d = L.derive_labels(ok.filter(F.col("strategy").isin(*letters)))
    return d.select("pair_id", "run_id", "strategy", "valid", "y_true", "y_pred")


@register("derive_labels_a", lambda: os_.derive_labels(("A",)))
def q_derive_labels_a(spark, sf_dir):
    return _derive(spark, sf_dir, ("A",))


@register("derive_labels_b", lambda: os_.derive_labels(("B",)))
def q_derive_labels_b(spark, sf_dir):
    return _derive(spark, sf_dir, ("B",))


@register("derive_labels_c", lambda: os_.derive_labels(("C", "D")))
def q_derive_labels_c(spark, sf_dir):
    return _derive(spark, sf_dir, ("C", "D"))


@register("row_correct", os_.row_correct)
def q_row_correct(spark, sf_dir):
    ok, _ = scoring.split_rejects(fx.predictions(spark, sf_dir))
    return L.derive_labels(ok).select("pair_id", "run_id", "strategy", "correct")


# --------------------------------------------------------------------------- comparisons
def fixture_runs(spark, sf_dir):
    """fx_runs: run summaries of fx_predictions + metadata from run_id, annotated."""
    rs = scoring.run_summary(fx.predictions(spark, sf_dir))
    meta = spark.sql(fx.run_metadata_sql("{rs}"), rs=rs)
    return cmp.annotate_runs(meta)


def _specs(spark):
    return spec_frame(spark, FIXTURE_SPECS)


def _p6(df):
    """Compared results keep p to 6 decimals (the oracle integrates the normal
    density numerically; the library value itself is exact)."""
    return df.withColumn("p_value", F.round("p_value", 6))


_RUN_PAYLOAD = ["run_id", "run_seq", "model", "accuracy", "n_eff", "n_correct"]


@register("dataset_tag", oc.dataset_tag)
def q_dataset_tag(spark, sf_dir):
    return fixture_runs(spark, sf_dir).select("run_id", "dataset_file", "ds")


@register("n_eff", oc.n_eff)
def q_n_eff(spark, sf_dir):
    return fixture_runs(spark, sf_dir).select("run_id", "strategy", "ds", "accuracy", "n_eff",
                                               "n_correct")


@register("lookup_run", oc.lookup_run)
def q_lookup_run(spark, sf_dir):
    found = cmp.lookup_run(_specs(spark), fixture_runs(spark, sf_dir))
    return found.select("spec_seq", "side", "n_matches", *[F.col(f"run.{c}").alias(c) for c in _RUN_PAYLOAD])


@register("compare_runs", oc.compare_runs)
def q_compare_runs(spark, sf_dir):
    return _p6(cmp.compare_runs(_specs(spark), fixture_runs(spark, sf_dir)))


@register("ordered_report", oc.ordered_report)
def q_ordered_report(spark, sf_dir):
    from pyspark.sql import Window
    c = cmp.compare_runs(_specs(spark), fixture_runs(spark, sf_dir))
    # Result-sized (one row per spec): a global order is cheap here.
    w = Window.orderBy("group_seq", "spec_seq")
    return c.select(F.row_number().over(w).cast("long").alias("report_pos"), "group_seq", "spec_seq",
                    "group", "comparison")


@register("missing_runs", oc.missing_runs)
def q_missing_runs(spark, sf_dir):
    return cmp.missing_runs(_specs(spark), fixture_runs(spark, sf_dir))


@register("ambiguous_runs", oc.ambiguous_runs)
def q_ambiguous_runs(spark, sf_dir):
    return cmp.ambiguous_runs(_specs(spark), fixture_runs(spark, sf_dir))


@register("first_run_per_key", oc.first_run_per_key)
def q_first_run_per_key(spark, sf_dir):
    f = cmp.first_run_per_key(fixture_runs(spark, sf_dir))
    return f.select("strategy", "few_shot_n", "ds", "batch_size", "n_runs", *_RUN_PAYLOAD)


@register("few_shot_dose_response", oc.few_shot_dose_response)
def q_few_shot_dose_response(spark, sf_dir):
    return _p6(cmp.few_shot_dose_response(fixture_runs(spark, sf_dir)))


@register("cross_model", oc.cross_model)
def q_cross_model(spark, sf_dir):
    return _p6(cmp.cross_model(fixture_runs(spark, sf_dir)))


@register("significance_summary", oc.significance_summary)
def q_significance_summary(spark, sf_dir):
    return cmp.significance_summary(cmp.compare_runs(_specs(spark), fixture_runs(spark, sf_dir)))


@register("two_prop_ztest", oc.two_prop_ztest)
def q_two_prop_ztest(spark, sf_dir):
    """Every run against the first run (by run_seq) of its strategy."""
    runs = fixture_runs(spark, sf_dir)
    base = cmp.first_run_per_key(runs, ["strategy"]).select(
        "strategy", F.col("run_id").alias("base_run_id"), F.col("accuracy").alias("b_acc"),
        F.col("n_eff").alias("b_n"), F.col("n_correct").alias("b_x"))
    j = runs.join(F.broadcast(base), "strategy")  # one row per strategy: at most 4
    return _p6(j.select("run_id", "strategy", "base_run_id",
                        *cmp._ztest_cols(F.col("accuracy"), F.col("n_eff"), F.col("n_correct"),
                                         F.col("b_acc"), F.col("b_n"), F.col("b_x"))))


@register("comparison_report", oc.comparison_report)
def q_comparison_report(spark, sf_dir):
    return cmp.comparison_report(cmp.compare_runs(_specs(spark), fixture_runs(spark, sf_dir)))


# --------------------------------------------------------------------------- ratings
_ROUND = 9  # float sums depend on row order: compared results keep 9 decimals


@register("rating_agreement", orat.rating_agreement)
def q_rating_agreement(spark, sf_dir):
    return ratings.rating_agreement(fx.ratings(spark, sf_dir), "pred_relevance", "h1",
                                    keys=["run_id"], round_to=_ROUND)


@register("rating_correlation", orat.rating_correlation)
def q_rating_correlation(spark, sf_dir):
    return ratings.rating_correlation(fx.ratings(spark, sf_dir), "pred_relevance", "h1",
                                      keys=["run_id"], round_to=_ROUND)


@register("rating_agreement_all", orat.rating_agreement_all)
def q_rating_agreement_all(spark, sf_dir):
    return ratings.rating_agreement_all(fx.ratings(spark, sf_dir), keys=["run_id"],
                                        round_to=_ROUND)


@register("attach_labels", orat.attach_labels)
def q_attach_labels(spark, sf_dir):
    d = fx.predictions(spark, sf_dir).filter(F.col("strategy") == "D")
    labels = fx.ratings(spark, sf_dir).select("pair_id", "h1", "h2")
    j = ratings.attach_labels(d, labels, "pair_id")
    return j.select("pair_id", "run_id", "strategy", "pred_relevance", "h1", "h2")


@register("human_agreement", orat.human_agreement)
def q_human_agreement(spark, sf_dir):
    return hum.human_agreement(fx.human(spark, sf_dir))


@register("human_confusion", orat.human_confusion)
def q_human_confusion(spark, sf_dir):
    return hum.human_confusion(fx.human(spark, sf_dir))


# --------------------------------------------------------------------------- sampling
_C = (0, 1, 2)


def _pred_pairs(spark, sf_dir):
    return fx.predictions(spark, sf_dir).select("pair_id", "support")


@register("seeded_shuffle", osa.seeded_shuffle)
def q_seeded_shuffle(spark, sf_dir):
    return sampling.seeded_shuffle(_pred_pairs(spark, sf_dir)).select("pair_id", "shuffle_key", "pos")


@register("stratified_sample", osa.stratified_sample)
def q_stratified_sample(spark, sf_dir):
    fs = sampling.stratified_sample(_pred_pairs(spark, sf_dir), 10, _C)
    return fs.select("pair_id", "support", "example_seq")


@register("stratified_sample_large", osa.stratified_sample_large)
def q_stratified_sample_large(spark, sf_dir):
    fs = sampling.stratified_sample(_pred_pairs(spark, sf_dir), 6000, _C)
    return fs.select("pair_id", "support")


@register("union_class_samples", osa.union_class_samples)
def q_union_class_samples(spark, sf_dir):
    return sampling.union_class_samples(_pred_pairs(spark, sf_dir), 10, _C).select("pair_id", "support")


@register("eligible_pool", osa.eligible_pool)
def q_eligible_pool(spark, sf_dir):
    return sampling.eligible_pool(_pred_pairs(spark, sf_dir), STRATEGIES["B"].few_shot_pool)


def _eval_set(spark, sf_dir):
    pairs = _pred_pairs(spark, sf_dir)
    return sampling.exclude_few_shot(pairs, sampling.stratified_sample(pairs, 10, _C))


@register("exclude_few_shot", osa.exclude_few_shot)
def q_exclude_few_shot(spark, sf_dir):
    return _eval_set(spark, sf_dir).select("pair_id", "support")


@register("limit_sample", osa.limit_sample)
def q_limit_sample(spark, sf_dir):
    return sampling.limit_sample(_eval_set(spark, sf_dir), 1000).select("pair_id", "pos")


@register("assign_batches", osa.assign_batches)
def q_assign_batches(spark, sf_dir):
    ev = sampling.limit_sample(_eval_set(spark, sf_dir), None)
    return sampling.assign_batches(ev, 20).select("pair_id", "batch_id", "item_pos")


# --------------------------------------------------------------------------- prompts
_FS_N = {"A": 7, "B": 10, "C": 10, "D": 10}


def _text_pairs(spark, sf_dir):
    rel = (F.length("arg2") % 5) * F.lit(0.25).cast("double")
    return fx.pairs(spark, sf_dir).withColumn("relevance", rel)


def _strategy_inputs(spark, sf_dir, letter, batch_size=10):
    pairs = _text_pairs(spark, sf_dir)
    fs = sampling.stratified_sample(pairs, _FS_N[letter], STRATEGIES[letter].few_shot_pool)
    ev = sampling.limit_sample(sampling.exclude_few_shot(pairs, fs), None)
    batched = sampling.assign_batches(ev, batch_size).withColumn("strategy", F.lit(letter))
    return fs, batched


@register("format_answer", osa.format_answer)
def q_format_answer(spark, sf_dir):
    from relscope.functions import prompts as P
    p = _text_pairs(spark, sf_dir)
    return p.select("pair_id", "support", *[
        P.format_answer(s, F.col("support"), F.col("relevance")).alias(f"answer_{s.lower()}")
        for s in "ABCD"])


def _all_strategies(spark, sf_dir, fs_n=None):
    from relscope.operators import inference
    return inference.plan_batches(_text_pairs(spark, sf_dir), "ABCD", few_shot_n=fs_n or _FS_N,
                                  batch_size=10, relevance_col="relevance")


@register("format_few_shot", osa.format_few_shot)
def q_format_few_shot(spark, sf_dir):
    return _all_strategies(spark, sf_dir)[1]


@register("format_pairs", osa.format_pairs)
def q_format_pairs(spark, sf_dir):
    _, batched = _strategy_inputs(spark, sf_dir, "C")
    return prompting.format_pairs(batched).select("batch_id", "pairs_block", "n_items")


@register("build_prompts", osa.build_prompts)
def q_build_prompts(spark, sf_dir):
    batched, blocks = _all_strategies(spark, sf_dir)
    return prompting.build_prompts(batched, blocks)


# --------------------------------------------------------------------------- replies
_RKEYS = ("run_id", "strategy", "batch_id")


def _parsed(spark, sf_dir):
    return rep.parse_replies(rfx.build(spark, sf_dir), keys=_RKEYS)


@register("extract_json_array", orep.extract_json_array)
def q_extract_json_array(spark, sf_dir):
    from relscope.functions.replies import extract_json_array
    r = rfx.build(spark, sf_dir)
    return r.select("run_id", "batch_id", extract_json_array(F.col("reply")).alias("array_text"))


@register("parse_replies", orep.parse_replies)
def q_parse_replies(spark, sf_dir):
    return _parsed(spark, sf_dir).select("run_id", "batch_id", "n_expected", "n_items_reply",
                                         "parse_status")


@register("decode_predictions", orep.decode_predictions)
def q_decode_predictions(spark, sf_dir):
    d = rep.decode_predictions(_parsed(spark, sf_dir), keys=_RKEYS)
    return d.select("run_id", "batch_id", "item_pos", "pred_attack", "pred_support",
                    "pred_neither", "pred_relevance", "off_rubric")


@register("attach_replies", orep.attach_replies)
def q_attach_replies(spark, sf_dir):
    """Every pair with the item of its batch's reply: batched rows and parsed replies joined on the batch."""
    batched = rfx.batched_predictions(spark, sf_dir)
    parsed = rep.parse_replies(rfx.build(spark, sf_dir, batched), keys=_RKEYS)
    j = rep.attach_replies(batched.select("pair_id", *_RKEYS, "item_pos"), parsed, keys=_RKEYS)
    return j.select("pair_id", "run_id", "batch_id", "item_pos", "pred_attack", "pred_support",
                    "pred_neither", "pred_relevance", "parse_status")


@register("batch_failures", orep.batch_failures)
def q_batch_failures(spark, sf_dir):
    return rep.batch_failures(_parsed(spark, sf_dir), keys=("run_id",))


# --------------------------------------------------------------------------- inference
def _eval_inputs(spark, sf_dir):
    from relscope.operators import inference
    return inference.plan_batches(_text_pairs(spark, sf_dir), "ABCD", few_shot_n=10,
                                  batch_size=10, relevance_col="relevance")


@register("batched_inference", osa.batched_inference)
def q_batched_inference(spark, sf_dir):
    """Prompts of all four strategies through the local stub model."""
    from relscope.operators import inference
    from relscope.operators.stub_model import stub_factory
    batched, blocks = _eval_inputs(spark, sf_dir)
    prompts = prompting.build_prompts(batched, blocks)
    out = inference.batched_inference(prompts, stub_factory, max_retries=2, retry_wait=0.0)
    return out.select("strategy", "batch_id", "n_items", "reply", "attempts", "error")


@register("resumed_inference", osa.resumed_inference)
def q_resumed_inference(spark, sf_dir):
    """A run that stopped after two strategies, taken up from its reply store: their prompts aren't sent again."""
    from relscope.operators import inference
    from relscope.operators.stub_model import stub_factory
    batched, blocks = _eval_inputs(spark, sf_dir)
    prompts = inference.persist_replies(prompting.build_prompts(batched, blocks), "prompts")
    store = _scratch(spark, "replies")

    def infer(rows):
        return inference.batched_inference(rows, stub_factory, max_retries=2, retry_wait=0.0, store=store, scope="run")

    infer(prompts.filter("strategy IN ('A', 'B')")).write.format("noop").mode("overwrite").save()
    return infer(prompts).select("strategy", "batch_id", "n_items", "reply", "attempts", "error", "resumed")


@register("evaluate_pairs", osa.evaluate_pairs)
def q_evaluate_pairs(spark, sf_dir):
    """sample -> exclude -> batch -> prompt -> infer (stub) -> parse -> predictions."""
    from relscope.operators import inference
    from relscope.operators.stub_model import stub_factory
    preds = inference.evaluate_pairs(_text_pairs(spark, sf_dir), "ABCD", stub_factory,
                                     few_shot_n=10, batch_size=10, retry_wait=0.0,
                                     relevance_col="relevance")
    return preds.select("pair_id", "arg1", "arg2", "strategy", "support", "support_label", "batch_id", "item_pos", "pred_attack",
                        "pred_support", "pred_neither", "pred_relevance", "relevance_human_labeled", "few_shot_n", "parse_status")


# --------------------------------------------------------------------------- sources / sinks
_PAIR_COLS = ["arg1", "arg2", "support", "type"]
_CSV_W = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
          "ignoreTrailingWhiteSpace": False}


def _scratch(spark, name):
    from relscope.session import scratch_dir
    return scratch_dir(spark, name)


@register("read_pairs_csv", osa.read_pairs_content)
def q_read_pairs_csv(spark, sf_dir):
    """Pairs written as multi-line CSV and read back by ranges, with the ids of their content."""
    from relscope.sources.pairs import read_pairs_csv
    path = _scratch(spark, "pairs-csv") + "/pairs.csv"
    fx.pairs(spark, sf_dir).select(*_PAIR_COLS).write.options(**_CSV_W).csv(path)
    return read_pairs_csv(spark, path, identity="content").select("pair_id", *_PAIR_COLS)


@register("read_pairs", osa.read_pairs_content)
def q_read_pairs(spark, sf_dir):
    """Pairs written, rewritten in files of other names and sizes, and read: the ids are those of the content."""
    from relscope.sources.pairs import read_pairs
    first, path = (_scratch(spark, "pairs-parquet") + "/pairs.parquet" for _ in range(2))
    fx.pairs(spark, sf_dir).select(*_PAIR_COLS).write.parquet(first)
    spark.read.parquet(first).repartition(5).write.parquet(path)
    return read_pairs(spark, path, identity="content").select("pair_id", *_PAIR_COLS)


@register("read_pairs_arrow", osa.read_pairs_content)
def q_read_pairs_arrow(spark, sf_dir):
    """Pairs written as Arrow streams and read back by runs of record batches, with the ids of their content."""
    from relscope.sources.pairs import read_pairs_arrow, write_pairs_arrow
    path = _scratch(spark, "pairs-arrow")
    write_pairs_arrow(fx.pairs(spark, sf_dir).repartition(3), path).write.format("noop").mode("overwrite").save()
    return read_pairs_arrow(spark, path, identity="content").select("pair_id", *_PAIR_COLS)


@register("check_inputs", osa.check_inputs)
def q_check_inputs(spark, sf_dir):
    from relscope.sources.pairs import check_inputs
    return check_inputs(fx.pairs(spark, sf_dir)).select("pair_id")


_PRED_COLS = ["pair_id", "run_id", "strategy", "support", "pred_attack", "pred_support",
              "pred_neither", "pred_relevance"]


@register("read_predictions", osa.predictions_plain)
def q_read_predictions(spark, sf_dir):
    from relscope.sources.predictions import read_predictions
    from relscope.sources.sinks import write_predictions
    path = _scratch(spark, "pred-csv")
    write_predictions(fx.predictions(spark, sf_dir), path, fmt="csv")
    return read_predictions(spark, path, fmt="csv").select(*_PRED_COLS)  # support: long


@register("write_predictions", osa.predictions_plain)
def q_write_predictions(spark, sf_dir):
    from relscope.sources.predictions import read_predictions
    from relscope.sources.sinks import write_predictions
    path = _scratch(spark, "pred-parquet")
    rows = fx.predictions(spark, sf_dir)
    # All runs as a first version without answers, then the real rows as two commits that replace them.
    write_predictions(rows.withColumn("pred_attack", F.lit(None).cast("int")), path)
    write_predictions(rows.filter("run_id < 40"), path)
    write_predictions(rows.filter("run_id >= 40"), path)
    return read_predictions(spark, path, runs="all").select(*_PRED_COLS)


@register("rename_outputs", osa.rename_outputs)
def q_rename_outputs(spark, sf_dir):
    from relscope.sources.sinks import rename_outputs, with_support_label
    d = rename_outputs(with_support_label(fx.predictions(spark, sf_dir)))
    return d.select("pair_id", "`support [true value]`", "support_label")


_RUN_COLS = ["run_id", "model", "strategy", "few_shot_n", "dataset_file", "batch_size",
             "n_evaluated", "accuracy", "macro_f1", "true_positive_attack", "precision_attack",
             "f1_score_no_relation"]


@register("read_runs", oc.runs_plain)
def q_read_runs(spark, sf_dir):
    from relscope.sources.runs import read_runs
    path = _scratch(spark, "runs-csv")
    fixture_runs(spark, sf_dir).select(*_RUN_COLS).coalesce(1).write.options(**_CSV_W).csv(path)
    r = read_runs(spark, path)
    return r.select(F.col("run_id").try_cast("long").alias("run_id"), *_RUN_COLS[1:])


@register("union_runs", oc.union_runs)
def q_union_runs(spark, sf_dir):
    from relscope.sources.runs import union_runs
    runs = fixture_runs(spark, sf_dir).select(*_RUN_COLS)
    old = runs.filter("run_id < 40")
    new = runs.filter("run_id >= 40").drop("macro_f1")
    return union_runs(old, new).select(*_RUN_COLS)


@register("append_run_summary", os_.run_summary)
def q_append_run_summary(spark, sf_dir):
    from relscope.sources.sinks import append_run_summary
    path = _scratch(spark, "overview")
    summ = scoring.run_summary(fx.predictions(spark, sf_dir))
    append_run_summary(summ.filter("run_id < 40"), path)
    append_run_summary(summ.filter("run_id >= 40"), path)
    return spark.read.parquet(path)


@register("write_annotated_runs", oc.n_eff_plain)
def q_write_annotated_runs(spark, sf_dir):
    from relscope.sources.sinks import write_annotated_runs
    path = _scratch(spark, "annotated")
    write_annotated_runs(fixture_runs(spark, sf_dir).select("run_id", "ds", "n_eff", "n_correct"), path)
    r = spark.read.option("header", True).csv(path)
    return r.select(*[F.col(c).try_cast("long").alias(c) if c != "ds" else F.col(c)
                      for c in ("run_id", "ds", "n_eff", "n_correct")])


@register("write_comparisons", oc.comparisons_plain)
def q_write_comparisons(spark, sf_dir):
    from relscope.schema import COMPARISON_COLS
    from relscope.sources.sinks import write_comparisons
    path = _scratch(spark, "comparisons")
    write_comparisons(cmp.compare_runs(_specs(spark), fixture_runs(spark, sf_dir)), path)
    r = spark.read.option("header", True).option("escape", '"').csv(path)
    types = {"acc1": "double", "n1": "long", "acc2": "double", "n2": "long", "diff_pp": "double",
             "z": "double", "p_value": "double", "significant": "boolean"}
    out = r.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c)
                     for c in COMPARISON_COLS])
    return _p6(out)


@register("write_report", oc.report_plain)
def q_write_report(spark, sf_dir):
    from relscope.sources.sinks import write_report
    path = _scratch(spark, "report")
    write_report(cmp.comparison_report(cmp.compare_runs(_specs(spark), fixture_runs(spark, sf_dir))), path)
    return spark.read.text(path)


@register("write_annotation_sample", osa.annotation_sample)
def q_write_annotation_sample(spark, sf_dir):
    from relscope.sources.sinks import write_annotation_sample
    path = _scratch(spark, "annotation")
    write_annotation_sample(fx.pairs(spark, sf_dir), path, n=30)
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return r.select("pair_id", F.col("support").try_cast("long").alias("support"), "support_label",
                    F.col("relevance").try_cast("double").alias("relevance"))


@register("read_human_labels", orat.human_labels_plain)
def q_read_human_labels(spark, sf_dir):
    from relscope.sources.predictions import read_human_labels
    path = _scratch(spark, "labels")
    (fx.human(spark, sf_dir).select(F.col("doc_id").alias("orig_idx"), F.col("gold").alias("support"),
                                    F.col("human").alias("support human labeled"))
     .write.options(**_CSV_W).csv(path))
    return read_human_labels(spark, path).select("orig_idx", "support", "support_human")


# --------------------------------------------------------------------------- streaming
def _for_stream(df, least):
    """``df`` dealt over at least so many files, and over four for each task of its scan: files and tasks don't grow with the table."""
    return df.repartition(max(least, 4 * df.rdd.getNumPartitions()))


def _share(spark, folder, epochs):
    """Files an epoch takes so that a folder's files make so many."""
    from relscope.sources import files
    n = sum(name.endswith(".parquet") for name in files.names(spark, folder))
    return max(1, -(-n // epochs))


def _stream_replies(spark, sf_dir):
    """(folder of parsed batches, folder of decoded rows) after a stop, files that come twice, and a restart."""
    from relscope.streaming.jobs import stream_predictions
    src, out, decoded, ckpt = (_scratch(spark, f"stream-{n}") for n in ("replies", "batches", "decoded", "ckpt"))
    rows = persist_replies(rfx.build(spark, sf_dir), "stream-input")
    first, second = rows.filter("batch_id % 3 = 0"), rows.filter("batch_id % 3 <> 0")
    for part in (_for_stream(first, 2), _for_stream(second, 2).union(first)):
        part.write.mode("append").parquet(src)
        stream_predictions(spark, src, rows.schema, out, ckpt, max_files=_share(spark, src, 2), decoded_dir=decoded)
    return out, decoded


@register("stream_predictions", orep.parse_replies)
def q_stream_predictions(spark, sf_dir):
    out, _ = _stream_replies(spark, sf_dir)
    return spark.read.parquet(out).select("run_id", "batch_id", "n_expected", "n_items_reply", "parse_status")


@register("stream_decoded", orep.decode_predictions)
def q_stream_decoded(spark, sf_dir):
    """One row per pair of the replies that came as a stream, repeated ones dropped."""
    _, decoded = _stream_replies(spark, sf_dir)
    return spark.read.parquet(decoded).select("run_id", "batch_id", "item_pos", "pred_attack", "pred_support", "pred_neither",
                                              "pred_relevance", "off_rubric")


@register("stream_run_summary", os_.run_summary)
def q_stream_run_summary(spark, sf_dir):
    from relscope.streaming.jobs import stream_run_summary
    src = _scratch(spark, "prediction-files")
    _for_stream(fx.predictions(spark, sf_dir), 4).write.parquet(src)
    schema = spark.read.parquet(src).schema
    return stream_run_summary(spark, src, schema, _scratch(spark, "stream-cells"),
                              _scratch(spark, "stream-cells-ckpt"), max_files=_share(spark, src, 4))


@register("stream_progress", os_.progress)
def q_stream_progress(spark, sf_dir):
    """Pairs done of those planned, while one run in three still waits for its predictions."""
    from relscope.streaming.jobs import progress_at, stream_run_summary
    src, plan, cells, ckpt = (_scratch(spark, f"progress-{n}") for n in ("files", "plan", "cells", "ckpt"))
    rows = persist_replies(fx.predictions(spark, sf_dir), "progress-input")
    batches = rows.groupBy("run_id", "strategy").agg(F.count("*").alias("n"))
    batches.select("run_id", "strategy", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"), "n").selectExpr(
        "run_id", "strategy", "IF(half = 0, n div 2, n - n div 2) AS n_items").write.parquet(plan)
    _for_stream(rows.filter("run_id % 3 <> 0"), 2).write.parquet(src)
    stream_run_summary(spark, src, rows.schema, cells, ckpt, max_files=max(2, _share(spark, src, 1)), expected_dir=plan)
    return progress_at(spark, cells, rows.schema)


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in REGISTRY.items()}


def _bigint_counts(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; Spark's returns BIGINT.  Cast every
    count_if(...) in the oracle text so both schemas agree."""
    out, i, tag = [], 0, "count_if("
    while True:
        j = sql.find(tag, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth = j + len(tag), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(f"CAST({sql[j:k]} AS BIGINT)")
        i = k


def oracle_sql() -> dict[str, str]:
    return {k: _bigint_counts(v[1]()) for k, v in REGISTRY.items() if v[1] is not None}
