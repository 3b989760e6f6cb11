import pytest
from pyspark.sql import functions as F

from conftest import golden
from relscope.operators import human as H
from relscope.operators import ratings as R
from relscope.sources.predictions import read_human_labels, read_predictions


@pytest.fixture(scope="module")
def preds2(spark):
    return read_predictions(spark, golden("NR_WebDataset_D_Batch10_zeroShot_HumanLabeled_2.csv")).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return read_human_labels(spark, golden("QBAF_relevanceScoreHumanLabeled.csv")).cache()


def _by_cmp(df):
    return {r.comparison: r for r in df.collect()}


def test_rating_agreement_file_as_it_stands(preds2):
    got = _by_cmp(R.rating_agreement_all(preds2))
    m1 = got["model_vs_h1"]
    assert (m1.n, round(m1.mae, 6), round(m1.rmse, 6), round(m1.pearson_r, 6), round(m1.l2_distance, 6)) \
        == (100, 0.285, 0.379144, 0.591955, 3.791438)
    assert m1.pearson_p == pytest.approx(8.8e-11, rel=0.05)
    m2 = got["model_vs_h2"]
    assert (round(m2.mae, 6), round(m2.rmse, 6), round(m2.pearson_r, 6), round(m2.l2_distance, 6)) \
        == (0.48, 0.590551, -0.121983, 5.905506)
    assert m2.pearson_p == pytest.approx(0.227, abs=5e-4)
    mm = got["model_vs_mean"]
    assert (round(mm.mae, 6), round(mm.rmse, 6), round(mm.pearson_r, 6), round(mm.l2_distance, 5)) \
        == (0.37, 0.452424, 0.254447, 4.52424)
    ir = got["h1_vs_h2"]
    assert (round(ir.mae, 6), round(ir.rmse, 6), round(ir.pearson_r, 6), round(ir.l2_distance, 6)) \
        == (0.3, 0.407738, -0.134389, 4.077377)
    assert (round(m1.a_mean, 6), round(m1.a_std, 6), round(m1.b_mean, 6), round(m1.b_std, 6)) \
        == (0.465, 0.369154, 0.23, 0.217025)
    assert (round(m2.b_mean, 6), round(m2.b_std, 6)) == (0.17, 0.31201)


def test_rating_agreement_joined_on_key(preds2, labels):
    joined = R.attach_labels(preds2, labels, "orig_idx", ("h2",))
    got = _by_cmp(R.rating_agreement_all(joined))
    m2 = got["model_vs_h2"]
    assert (round(m2.mae, 6), round(m2.rmse, 6), round(m2.pearson_r, 6), round(m2.l2_distance, 5)) \
        == (0.39, 0.513566, 0.247005, 5.13566)
    mm = got["model_vs_mean"]
    assert (round(mm.mae, 6), round(mm.rmse, 6), round(mm.pearson_r, 6), round(mm.l2_distance, 6)) \
        == (0.3275, 0.424632, 0.461038, 4.246322)
    ir = got["h1_vs_h2"]
    assert (round(ir.mae, 6), round(ir.rmse, 6), round(ir.pearson_r, 6), round(ir.l2_distance, 6)) \
        == (0.22, 0.306186, 0.400951, 3.061862)


def test_constant_rater_gives_null_r(spark):
    df = spark.createDataFrame([(0.5, 0.25), (0.5, 0.75), (0.5, 1.0)], "pred_relevance double, h1 double")
    r = R.rating_agreement_all(df, h2=None).collect()[0]
    assert r.pearson_r is None and r.pearson_p is None and r.n == 3


def test_all_null_h2_gives_no_h2_rows(spark):
    df = spark.createDataFrame([(0.5, 0.25, None), (0.25, 0.75, None), (1.0, 1.0, None)],
                               "pred_relevance double, h1 double, h2 double")
    got = _by_cmp(R.rating_agreement_all(df))
    assert set(got) == {"model_vs_h1"}


def test_human_agreement_golden(labels):
    df = labels.select(F.col("support").alias("gold"), F.col("support_human").alias("human"))
    row = H.human_agreement(df).collect()[0]
    assert row.n == 100 and row.n_dropped == 0
    assert row.accuracy == pytest.approx(0.59)
    assert round(row.macro_f1, 6) == 0.578842
    cm = {(r.y_true, r.y_pred): r.n for r in H.human_confusion(df).collect()}
    order = ["Attack", "Support", "No Relation"]
    assert [[cm[(t, p)] for p in order] for t in order] == [[14, 7, 13], [4, 17, 12], [3, 2, 28]]


def test_strategy_d_logs_reproduce_published_rows(spark):
    from relscope.operators import scoring
    for name, acc, f1 in [("NR_WebDataset_D_Batch10_zeroShot_HumanLabeled.csv", 0.59, 0.585779),
                          ("NR_WebDataset_D_Batch10_zeroShot_HumanLabeled_2.csv", 0.53, 0.518959)]:
        r = scoring.run_summary(read_predictions(spark, golden(name))).collect()[0]
        assert r.accuracy == pytest.approx(acc) and round(r.macro_f1, 6) == f1
        assert r.n_evaluated == 100


def test_labels_are_written_and_read_as_several_files(spark, tmp_path):
    from relscope.plans import catalog
    src = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    src.repartition(8).write.parquet(str(tmp_path / "labels.parquet"))
    got = catalog.queries()["read_human_labels"](spark, str(tmp_path))
    assert len(got.inputFiles()) > 1
    assert sorted(tuple(r) for r in got.collect()) == [(i, i % 2, 1 - i % 3 % 2) for i in range(400)]


def test_human_agreement_reads_its_input_once_and_keeps_groups_without_a_complete_row(spark, tmp_path):
    rows = [("a", 0, 0), ("a", 1, 2), ("a", 5, 1), ("b", None, 1), ("b", 2, None), (None, 2, 2)]
    spark.createDataFrame(rows, "g string, gold long, human long").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    out = H.human_agreement(df, keys=["g"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    got = {r.g: r for r in out.collect()}
    assert (got["a"].n, got["a"].n_rejected, got["a"].n_dropped, got["a"].accuracy) == (2, 1, 0, 0.5)
    assert (got["b"].n, got["b"].n_dropped, got["b"].accuracy, got["b"].macro_f1, got["b"].human_count_support) == (0, 2, None, None, 1)
    assert got[None].accuracy == 1.0
    one = H.human_agreement(df.where("false")).first()
    assert (one.n, one.n_dropped, one.n_rejected, one.accuracy) == (0, 0, 0, None)
