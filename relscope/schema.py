"""Types, fixed label values and the strategy registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the evaluated system's conventions)
# Gold label codes and names: 0 Attack, 1 Support, 2 No Relation.
# Binary strategy A uses the names Attack and Not-Attack.
# Strategy letters: A binary, B two-class, C three-class, D three-class + relevance.
# Relevance rubric values: 0.00, 0.25, 0.50, 0.75, 1.00.
# ---------------------------------------------------------------------------
ATTACK = "Attack"
SUPPORT = "Support"
NO_RELATION = "No Relation"
NOT_ATTACK = "Not-Attack"
SUPPORT_MAP = {0: ATTACK, 1: SUPPORT, 2: NO_RELATION}
RUBRIC = (0.0, 0.25, 0.5, 0.75, 1.0)

# Column suffix used in the run summary for each exported class.
CLASS_KEYS = {ATTACK: "attack", SUPPORT: "support", NO_RELATION: "no_relation"}


@dataclass(frozen=True)
class Strategy:
    letter: str
    classes: tuple[str, ...]          # classes scored by F1 (order = macro-F1 order)
    required_flags: tuple[str, ...]   # prediction columns that must be non-null
    few_shot_pool: tuple[int, ...]    # gold codes usable as few-shot examples
    reply_keys: tuple[str, ...]       # keys the model is asked to return


STRATEGIES: dict[str, Strategy] = {
    "A": Strategy("A", (ATTACK, NOT_ATTACK), ("pred_attack",), (0, 1), ("attack",)),
    "B": Strategy("B", (ATTACK, SUPPORT), ("pred_attack", "pred_support"), (0, 1),
                  ("attack", "support")),
    "C": Strategy("C", (ATTACK, SUPPORT, NO_RELATION),
                  ("pred_attack", "pred_support", "pred_neither"), (0, 1, 2),
                  ("attack", "support", "neither")),
    "D": Strategy("D", (ATTACK, SUPPORT, NO_RELATION),
                  ("pred_attack", "pred_support", "pred_neither"), (0, 1, 2),
                  ("attack", "support", "neither", "relevance")),
}

FLAG_COLS = ("pred_attack", "pred_support", "pred_neither")

PAIR_SCHEMA = T.StructType([
    T.StructField("arg1", T.StringType()),
    T.StructField("arg2", T.StringType()),
    T.StructField("support", T.LongType()),
    T.StructField("type", T.StringType()),
])

# Canonical prediction table (one row per pair and run).
PREDICTION_SCHEMA = T.StructType([
    T.StructField("pair_id", T.StringType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("support", T.LongType()),
    T.StructField("pred_attack", T.IntegerType()),
    T.StructField("pred_support", T.IntegerType()),
    T.StructField("pred_neither", T.IntegerType()),
    T.StructField("pred_relevance", T.DoubleType()),
])

# Run summary columns in the order of the published overview file.
RUN_METADATA_COLS = ("timestamp", "git_commit", "model", "strategy", "few_shot_n",
                     "dataset_file", "limit_config", "batch_size", "delay_seconds",
                     "max_retries")
RUN_METRIC_COLS = (
    "n_evaluated",
    "ground_truth_count_attack", "ground_truth_count_support", "ground_truth_count_no_relation",
    "predicted_count_attack", "predicted_count_support", "predicted_count_no_relation",
    "accuracy",
    "true_positive_attack", "false_positive_attack", "false_negative_attack", "true_negative_attack",
    "true_positive_support", "false_positive_support", "false_negative_support", "true_negative_support",
    "true_positive_no_relation", "false_positive_no_relation", "false_negative_no_relation",
    "true_negative_no_relation",
    "precision_attack", "precision_support", "precision_no_relation",
    "recall_attack", "recall_support", "recall_no_relation",
    "f1_score_attack", "f1_score_support", "f1_score_no_relation",
    "macro_f1",
)

COMPARISON_COLS = ("group", "comparison", "strategy", "factor", "ds", "group1", "acc1", "n1",
                   "group2", "acc2", "n2", "diff_pp", "z", "p_value", "significant")


def check_strategies(letters) -> list[str]:
    """Strategy letters must be known; raise before any job starts."""
    bad = [s for s in letters if s not in STRATEGIES]
    if bad:
        raise ValueError(f"Invalid strategies: {bad}. Must be one of {sorted(STRATEGIES)}")
    return list(letters)
