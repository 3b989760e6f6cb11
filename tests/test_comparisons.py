import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import golden
from relscope.operators import comparisons as C
from relscope.plans.specs import STUDY_SPECS, spec_frame
from relscope.sources.runs import read_runs


@pytest.fixture(scope="module")
def runs(spark):
    return C.annotate_runs(read_runs(spark, golden("ResultOverview_allTests.csv"))).cache()


def test_read_runs_parses_dirty_values(runs):
    pdf = runs.orderBy("run_seq").toPandas()
    assert len(pdf) == 29
    assert pdf.timestamp.notna().all()          # both timestamp layouts
    assert pdf.macro_f1.iloc[6] == pytest.approx(0.6998)   # "0,6998 "
    assert pdf.true_positive_support.iloc[0] == 186


def test_annotated_runs_match_published(runs):
    exp = pd.read_csv(golden("runs_annotated.csv"))
    got = runs.orderBy("run_seq").select("ds", "n_eff", "n_correct").toPandas()
    assert list(got.ds) == list(exp.ds)
    assert list(got.n_eff) == [int(v) for v in exp.n_eff]
    assert list(got.n_correct) == list(exp.n_correct)


def test_compare_runs_reproduces_39_published_rows(spark, runs):
    specs = spec_frame(spark)
    got = C.compare_runs(specs, runs).orderBy("spec_seq").toPandas()
    exp = pd.read_csv(golden("pairwise_ztests_accuracy.csv"), float_precision="round_trip")
    assert len(got) == 39
    assert list(got.comparison) == list(exp.comparison)
    for col in ("group", "strategy", "factor", "ds", "group1", "group2"):
        assert list(got[col]) == list(exp[col]), col
    assert list(got.n1) == list(exp.n1) and list(got.n2) == list(exp.n2)
    for col in ("acc1", "acc2", "diff_pp", "z"):
        assert max(abs(a - b) for a, b in zip(got[col], exp[col])) == 0.0, col
    assert max(abs(a - b) for a, b in zip(got.p_value, exp.p_value)) < 1e-12
    assert list(got.significant) == list(exp.significant)
    assert int(got.significant.sum()) == 10


def test_missing_and_ambiguous(spark, runs):
    specs = spec_frame(spark)
    miss = C.missing_runs(specs, runs).toPandas()
    assert miss.spec_seq.nunique() == 4           # 43 specs, 39 results
    amb = C.ambiguous_runs(specs, runs).toPandas()
    assert (amb.n_matches > 1).all()


def test_report_matches_published_tables(spark, runs):
    specs = spec_frame(spark)
    cmp_ = C.compare_runs(specs, runs)
    lines = C.comparison_report(cmp_)
    text = C.report_text(lines)
    published = open(golden("evaluation_report.md"), encoding="utf-8").read()
    table_rows = [l for l in published.splitlines() if l.startswith("| ") and "Comparison" not in l]
    ours = set(text.splitlines())
    assert len(table_rows) == 35
    for row in table_rows:
        assert row in ours, row
    bullets = [l for l in published.splitlines() if l.startswith("- **")]
    for b in bullets:
        assert b in ours, b
    assert "Of 39 comparisons, **10** are significant at α = 0.05 and **29** are not." in ours


def test_ztest_edge_cases(spark):
    from relscope.functions.stats import two_prop_ztest
    df = spark.createDataFrame([(0, 10, 0, 10), (10, 10, 10, 10), (5, 10, 5, 10)],
                               "x1 long, n1 long, x2 long, n2 long")
    t = two_prop_ztest(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2"))
    rows = df.select(t["z"].alias("z"), t["p_value"].alias("p"),
                     t["significant"].alias("s")).collect()
    assert rows[0].z is None and rows[0].p is None and rows[0].s is False
    assert rows[1].z is None and rows[1].p is None and rows[1].s is False
    assert rows[2].z == 0.0 and rows[2].p == pytest.approx(1.0)


def test_n_correct_half_to_even(spark):
    df = spark.createDataFrame(
        [("C", 0.60875, 799, 0, 0, 0, 0), ("B", 0.696, 989, 0, 0, 0, 0),
         ("A", 0.5, 5, 1, 1, 1, 2), ("A", 0.5, 7, 1, 2, 2, 2)],
        "strategy string, accuracy double, n long, true_positive_attack long, "
        "false_positive_attack long, false_negative_attack long, true_negative_attack long")
    df = df.select("*", F.col("n").alias("predicted_count_attack"),
                   F.lit(0).alias("predicted_count_support"),
                   F.lit(0).alias("predicted_count_no_relation"),
                   F.lit("x").alias("dataset_file"))
    got = [r.n_correct for r in C.annotate_runs(df).collect()]
    assert got == [486, 688, 2, 4]


def test_the_report_sink_writes_title_headings_and_blank_lines(spark, tmp_path):
    import os
    import re

    from relscope.sources.runs import read_runs
    from relscope.sources.sinks import write_report
    runs = C.annotate_runs(read_runs(spark, golden("ResultOverview_allTests.csv")))
    lines = C.comparison_report(C.compare_runs(spec_frame(spark, STUDY_SPECS), runs))
    write_report(lines, str(tmp_path / "report"))
    got = "".join((tmp_path / "report" / f).read_text() for f in sorted(os.listdir(tmp_path / "report")) if f.startswith("part-"))
    assert got == C.report_text(lines)
    published = open(golden("evaluation_report.md")).read()
    # From the results on, but for group 6 (a table here, none there) and the closing prose.
    here = re.sub(r"### Group 6.*?(?=## Plain)", "", got[got.index("## Results"):], flags=re.S)
    count = re.search(r"Of \d+ comparisons, .*? are not\.", published).group(0)
    there = published[published.index("## Results"):published.index(count)] + count + "\n"
    assert here == there and got.startswith("# Statistical Evaluation Report\n\n## Results\n\n### ")


def test_runs_of_several_files_are_numbered_by_file_then_position(spark, tmp_path):
    from relscope.sources.runs import read_runs
    for name, models in (("b.csv", "xyz"), ("a.csv", "uv")):
        (tmp_path / name).write_text("model,strategy\n" + "".join(f'"{m}\n",B\n' for m in models))
    rows = read_runs(spark, str(tmp_path)).orderBy("run_seq").collect()
    assert [(r.run_seq, r.model[0]) for r in rows] == list(enumerate("uvxyz"))
