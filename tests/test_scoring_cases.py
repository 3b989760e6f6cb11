"""Hand-made scoring cases (FIXTURES.md C) and partition-invariance properties."""

import pytest
from pyspark.sql import functions as F

from relscope.functions.labels import dataset_tag
from relscope.operators import scoring

SCHEMA = ("pair_id string, run_id long, strategy string, support long, pred_attack int, "
          "pred_support int, pred_neither int, pred_relevance double")


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_row_rules_for_accuracy_and_f1(spark):
    rows = [
        ("c0", 1, "C", 1, 0, 0, 0, None),   # C all flags 0: valid, wrong, not in F1
        ("c1", 1, "C", 1, 1, 1, 0, None),   # two flags, gold 1: right for accuracy, label Attack
        ("b2", 2, "B", 2, 0, 1, None, None),  # B gold 2: always wrong
        ("a2", 3, "A", 2, 0, None, None, None),  # A gold 2, no attack: right
    ]
    from relscope.functions.labels import derive_labels
    got = {r.pair_id: r for r in derive_labels(_df(spark, rows)).collect()}
    assert got["c0"].valid and got["c0"].correct == 0 and got["c0"].y_pred is None
    assert got["c1"].correct == 1 and got["c1"].y_pred == "Attack"
    assert got["b2"].correct == 0 and got["b2"].y_true == "No Relation"
    assert got["a2"].correct == 1 and got["a2"].y_true == "Not-Attack"


def test_c_no_flag_row_left_out_of_f1_and_counts(spark):
    rows = [("x%d" % i, 1, "C", i % 3, int(i % 3 == 0), int(i % 3 == 1), int(i % 3 == 2), None)
            for i in range(9)] + [("z", 1, "C", 0, 0, 0, 0, None)]
    s = scoring.run_summary(_df(spark, rows)).collect()[0]
    assert s.n_evaluated == 10 and s.n_valid == 10 and s.n_scored == 9
    assert s.accuracy == pytest.approx(0.9)
    assert s.predicted_count_attack == 3      # flag sums: the no-flag row counts nowhere
    assert s.true_positive_attack + s.false_positive_attack + s.false_negative_attack \
        + s.true_negative_attack == 9
    assert s.macro_f1 == pytest.approx(1.0)


def test_b_gold2_is_negative_in_both_classes(spark):
    rows = [("a", 1, "B", 0, 1, 0, None, None), ("s", 1, "B", 1, 0, 1, None, None),
            ("n", 1, "B", 2, 0, 1, None, None)]
    s = scoring.run_summary(_df(spark, rows)).collect()[0]
    assert s.accuracy == pytest.approx(2 / 3)
    assert s.true_negative_attack == 2 and s.false_positive_support == 1
    assert s.precision_no_relation is None and s.f1_score_no_relation is None
    assert s.ground_truth_count_no_relation == 1


def test_strategy_a_exports_attack_only(spark):
    rows = [("a", 1, "A", 0, 1, None, None, None), ("b", 1, "A", 1, 0, None, None, None)]
    s = scoring.run_summary(_df(spark, rows)).collect()[0]
    assert s.f1_score_attack == 1.0 and s.macro_f1 == 1.0
    assert s.true_positive_support is None and s.recall_no_relation is None


def test_all_rows_of_a_run_null(spark):
    rows = [("a", 1, "C", 0, None, None, None, None), ("b", 1, "C", 1, None, None, None, None)]
    s = scoring.run_summary(_df(spark, rows)).collect()[0]
    assert s.n_evaluated == 2 and s.accuracy is None and s.macro_f1 == 0.0


def test_unknown_gold_goes_to_rejects(spark):
    rows = [("a", 1, "C", 5, 0, 0, 1, None), ("b", 1, "A", 5, 0, None, None, None)]
    ok, rej = scoring.split_rejects(_df(spark, rows))
    assert [r.pair_id for r in rej.collect()] == ["a"]
    assert [r.pair_id for r in ok.collect()] == ["b"]


def test_dataset_tags(spark):
    df = spark.createDataFrame([("NR_x",), ("x/QBAF.csv",), ("WebDataset/x",)], "dataset_file string")
    assert [r[0] for r in df.select(dataset_tag()).collect()] == ["NR_Web", "QBAF", "Web"]


def test_summary_independent_of_partitioning(spark):
    from conftest import SF_SMALL
    from relscope.plans import fixtures as fx
    pred = fx.predictions(spark, SF_SMALL)
    a = sorted(map(tuple, scoring.run_summary(pred.repartition(1)).collect()))
    b = sorted(map(tuple, scoring.run_summary(pred.repartition(7, "pair_id")).collect()))
    assert a == b


def test_wide_confusion_matrix(spark):
    rows = [("a", 1, "C", 0, 1, 0, 0, None), ("b", 1, "C", 0, 0, 1, 0, None)]
    w = scoring.confusion_matrix(_df(spark, rows), wide=True)
    r = {x.y_true: x for x in w.collect()}
    assert r["Attack"]["Attack"] == 1 and r["Attack"]["Support"] == 1
    assert r["Support"]["Attack"] == 0
