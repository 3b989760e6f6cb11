"""Run comparison: effective n, spec lookup, z-tests, report.

Inputs are run-level tables (one row per evaluated run), so they are small
next to the prediction rows; the spec table has a fixed, known size and is the
broadcast side of every lookup join.  Several matching runs for one condition
are resolved with ``min_by(run, run_seq)`` -- a partial aggregate, not a
window over an unbounded group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relscope.functions.labels import dataset_tag
from relscope.functions.stats import two_prop_ztest
from relscope.plans.specs import GROUP_NOTES, GROUP_TITLES

COND = ("strategy", "few_shot_n", "ds", "batch_size", "model")
_PAYLOAD = ("run_seq", "model", "accuracy", "n_eff", "n_correct")


def n_eff_expr() -> Column:
    """Effective sample size: C/D all flag sums, B attack+support, A the
    attack class's confusion total."""
    s = F.col("strategy")
    pa, ps, pn = (F.col(c) for c in ("predicted_count_attack", "predicted_count_support",
                                      "predicted_count_no_relation"))
    a = (F.col("true_positive_attack") + F.col("false_positive_attack")
         + F.col("false_negative_attack") + F.col("true_negative_attack"))
    return F.when(s.isin("C", "D"), pa + ps + pn).when(s == "B", pa + ps).otherwise(a)


def annotate_runs(runs: DataFrame) -> DataFrame:
    """Adds ``ds``, ``n_eff`` and ``n_correct = rint(accuracy * n_eff)``
    (half to even).  Existing metric columns are left as they are."""
    n_eff = n_eff_expr().cast("long")
    return runs.withColumns({
        "ds": dataset_tag("dataset_file"),
        "n_eff": n_eff,
        "n_correct": F.rint(F.col("accuracy") * n_eff).cast("long"),
    })


def spec_sides(specs: DataFrame) -> DataFrame:
    """Two lookup rows per spec: (spec_seq, side, condition)."""
    def side(i: int) -> DataFrame:
        return specs.select("spec_seq", F.lit(i).alias("side"),
                            *[F.col(f"{c}{i}").alias(f"c_{c}") for c in COND])
    return side(1).unionByName(side(2))


def _payload(runs: DataFrame) -> list[str]:
    extra = [c for c in ("run_id",) if c in runs.columns]
    return extra + list(_PAYLOAD)


def lookup_run(specs: DataFrame, runs: DataFrame) -> DataFrame:
    """First matching run (lowest ``run_seq``) per spec side, and how many matched.

    Sides without a match are absent (see ``missing_runs``)."""
    sides = F.broadcast(spec_sides(specs))  # fixed size: 2 rows per spec
    cond = None
    for c in COND[:-1]:
        e = sides[f"c_{c}"] == runs[c]
        cond = e if cond is None else cond & e
    cond = cond & (sides["c_model"].isNull() | (sides["c_model"] == runs["model"]))
    j = sides.join(runs, cond, "inner")
    payload = _payload(runs)
    return (j.groupBy("spec_seq", "side")
            .agg(F.min_by(F.struct(*[runs[c] for c in payload]), runs["run_seq"]).alias("run"),
                 F.count(F.lit(1)).alias("n_matches")))


def _ztest_cols(acc1, n1, x1, acc2, n2, x2) -> list[Column]:
    t = two_prop_ztest(x1, n1, x2, n2)
    return [acc1.alias("acc1"), n1.alias("n1"), acc2.alias("acc2"), n2.alias("n2"),
            t["diff_pp"].alias("diff_pp"), t["z"].alias("z"), t["p_value"].alias("p_value"),
            t["significant"].alias("significant")]


def compare_runs(specs: DataFrame, runs: DataFrame) -> DataFrame:
    """One z-test row per spec whose two conditions both have a run."""
    found = lookup_run(specs, runs)
    r1 = found.filter("side = 1").select("spec_seq", F.col("run").alias("r1"))
    r2 = found.filter("side = 2").select("spec_seq", F.col("run").alias("r2"))
    j = specs.join(r1, "spec_seq").join(r2, "spec_seq")
    return j.select("spec_seq", "group_seq", "group", "comparison", "strategy", "factor", "ds",
                    "group1", "group2",
                    *_ztest_cols(F.col("r1.accuracy"), F.col("r1.n_eff"), F.col("r1.n_correct"),
                                 F.col("r2.accuracy"), F.col("r2.n_eff"), F.col("r2.n_correct")))


def missing_runs(specs: DataFrame, runs: DataFrame) -> DataFrame:
    """Spec sides whose condition has no run (the comparison is skipped)."""
    found = lookup_run(specs, runs).select("spec_seq", "side")
    return (spec_sides(specs).join(found, ["spec_seq", "side"], "left_anti")
            .join(specs.select("spec_seq", "group", "comparison"), "spec_seq")
            .select("spec_seq", "side", "group", "comparison",
                    *[F.col(f"c_{c}").alias(c) for c in COND]))


def ambiguous_runs(specs: DataFrame, runs: DataFrame) -> DataFrame:
    """Spec sides matched by several runs; the first (lowest run_seq) is used."""
    found = lookup_run(specs, runs).filter("n_matches > 1")
    return found.select("spec_seq", "side", "n_matches",
                        F.col("run.run_seq").alias("chosen_run_seq"))


def first_run_per_key(runs: DataFrame, keys=COND[:-1]) -> DataFrame:
    """First run (lowest run_seq) per condition key and the number of runs."""
    payload = [c for c in runs.columns if c not in keys]
    return (runs.groupBy(*keys)
            .agg(F.min_by(F.struct(*payload), F.col("run_seq")).alias("run"),
                 F.count(F.lit(1)).alias("n_runs"))
            .select(*keys, "n_runs", "run.*"))


def _pair_test(runs: DataFrame, join_keys: list[str], order_col: str, label) -> DataFrame:
    """Self-join of one-run-per-condition rows on ``join_keys`` with
    ``a.order_col < b.order_col``.  The join input has one row per distinct
    condition, so each group holds only the distinct values of ``order_col``
    (few-shot sizes, or models) and the pair count is bounded by them, not by
    the data."""
    firsts = first_run_per_key(runs, COND)
    cols = join_keys + [order_col] + ["run_seq", "accuracy", "n_eff", "n_correct"]
    a = firsts.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = firsts.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    cond = F.col(f"a_{order_col}") < F.col(f"b_{order_col}")
    for k in join_keys:
        cond = cond & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    j = a.join(b, cond)
    return j.select(*[F.col(f"a_{k}").alias(k) for k in join_keys],
                    F.col(f"a_{order_col}").alias(f"{order_col}1"),
                    F.col(f"b_{order_col}").alias(f"{order_col}2"),
                    label(j).alias("comparison"),
                    *_ztest_cols(F.col("a_accuracy"), F.col("a_n_eff"), F.col("a_n_correct"),
                                 F.col("b_accuracy"), F.col("b_n_eff"), F.col("b_n_correct")))


def few_shot_dose_response(runs: DataFrame) -> DataFrame:
    """Every pair of few-shot sizes at a matched (strategy, ds, batch, model)."""
    def label(j):
        return F.format_string("%s %d-shot vs %d-shot (b%d) | %s", F.col("a_strategy"),
                               F.col("a_few_shot_n"), F.col("b_few_shot_n"),
                               F.col("a_batch_size"), F.col("a_model"))
    return _pair_test(runs, ["strategy", "ds", "batch_size", "model"], "few_shot_n", label)


def cross_model(runs: DataFrame) -> DataFrame:
    """Every model pair (one order) at a matched (strategy, few-shot, ds, batch)."""
    def label(j):
        return F.format_string("%s %d-shot %s b%d | %s vs %s", F.col("a_strategy"),
                               F.col("a_few_shot_n"), F.col("a_ds"), F.col("a_batch_size"),
                               F.col("a_model"), F.col("b_model"))
    return _pair_test(runs, ["strategy", "few_shot_n", "ds", "batch_size"], "model", label)


def significance_summary(comparisons: DataFrame) -> DataFrame:
    """Significant / not significant counts per group and overall ('all')."""
    def agg(df):
        return df.agg(F.count(F.lit(1)).alias("n_comparisons"),
                      F.count_if("significant").alias("n_significant"),
                      F.count_if(~F.col("significant")).alias("n_not_significant"))
    per_group = agg(comparisons.groupBy("group"))
    overall = agg(comparisons).select(F.lit("all").alias("group"), "*")
    return per_group.unionByName(overall)


# --------------------------------------------------------------------------- report
@F.pandas_udf(T.StringType())
def py_format(v: pd.Series, spec: pd.Series) -> pd.Series:
    """Python format spec on a number (exact-binary rounding, 'nan' for null):
    the report's numbers then read the same as the published report."""
    out = []
    for x, s in zip(v, spec):
        x = float("nan") if x is None or pd.isna(x) else float(x)
        out.append(format(x, s))
    return pd.Series(out, dtype=object)


def comparison_report(comparisons: DataFrame) -> DataFrame:
    """Markdown report as ordered lines ``(section, part, seq, line)``.

    Group tables in fixed group order with rows in spec order, notes for
    groups 3 and 3b, then the list of significant results and the count line.
    Every group with results gets a table (the published report omits group 6).
    The comparisons, a row a spec, are written once: every part of the report reads that table."""
    spark = comparisons.sparkSession
    from relscope.session import persisted, ship_package
    ship_package(spark)
    comparisons = persisted(comparisons, "comparisons")
    fmt = lambda c, s: py_format(F.col(c).cast("double"), F.lit(s))
    rows = comparisons.select(
        "group_seq", F.lit(3).alias("part"), F.col("spec_seq").alias("seq"),
        F.concat(F.lit("| "), F.col("comparison"),
                 F.lit(" | "), fmt("acc1", ".4f"), F.lit(" ("), F.col("n1").cast("string"),
                 F.lit(") | "), fmt("acc2", ".4f"), F.lit(" ("), F.col("n2").cast("string"),
                 F.lit(") | "), fmt("diff_pp", "+.2f"), F.lit(" | "), fmt("z", "+.3f"),
                 F.lit(" | "), fmt("p_value", ".4f"), F.lit(" | "),
                 F.when(F.col("significant"), F.lit("✓")).otherwise(F.lit("")),
                 F.lit(" |")).alias("line"))
    head = []
    for i, (g, title) in enumerate(GROUP_TITLES):
        head.append((i, g, 0, 0, f"### {title}"))
        if g in GROUP_NOTES:
            head.append((i, g, 1, 0, GROUP_NOTES[g]))
        head.append((i, g, 2, 0, "| Comparison | acc1 (n1) | acc2 (n2) | diff (pp) | z | p-value | Sig? |"))
        head.append((i, g, 2, 1, "|---|---|---|---|---|---|---|"))
    from relscope.session import values_frame
    heads = values_frame(spark, head, "group_seq int, group string, part int, seq int, line string")
    present = comparisons.select("group_seq").distinct()
    heads = heads.join(F.broadcast(present), "group_seq", "left_semi").drop("group")

    body = heads.unionByName(rows).withColumn("section", F.lit(1))
    sig = comparisons.filter("significant").select(
        F.lit(2).alias("section"), F.col("group_seq"), F.lit(1).alias("part"),
        F.col("spec_seq").alias("seq"),
        F.concat(F.lit("- **"), F.col("comparison"), F.lit("**: "), F.col("group1"), F.lit(" ("),
                 fmt("acc1", ".3f"), F.lit(") vs "), F.col("group2"), F.lit(" ("),
                 fmt("acc2", ".3f"), F.lit("), z = "), fmt("z", "+.3f"), F.lit(", p = "),
                 fmt("p_value", ".4f"), F.lit(", diff = "), fmt("diff_pp", "+.2f"),
                 F.lit(" pp.")).alias("line"))
    counts = comparisons.agg(F.count(F.lit(1)).alias("n"), F.count_if("significant").alias("k"))
    tail = counts.select(
        F.lit(3).alias("section"), F.lit(0).alias("group_seq"), F.lit(0).alias("part"),
        F.lit(0).alias("seq"),
        F.format_string("Of %d comparisons, **%d** are significant at α = 0.05 and **%d** are not.",
                        F.col("n"), F.col("k"), F.col("n") - F.col("k")).alias("line"))
    sig_head = counts.filter("k > 0").select(
        F.lit(2).alias("section"), F.lit(0).alias("group_seq"), F.lit(0).alias("part"),
        F.lit(0).alias("seq"),
        F.lit("**Statistically significant differences (α = 0.05):**").alias("line"))
    return (body.unionByName(sig_head).unionByName(sig).unionByName(tail)
            .select("section", "group_seq", "part", "seq", "line"))


def assembled_report(lines: DataFrame) -> DataFrame:
    """``(section, group_seq, part, seq, pos, line)``: the report's lines with title, headings and blank lines."""
    at = lambda section, part: (F.col("section") == section) & (F.col("part") == part)
    blank = F.lit("")
    around = (F.when(at(1, 0), F.array(blank, F.col("line"), blank))
              .when(at(1, 1) | at(2, 0), F.array(F.col("line"), blank))
              .when(F.col("section") == 3, F.array(blank, F.col("line"))).otherwise(F.array("line")))
    place = ["section", "group_seq", "part", "seq"]
    body = lines.select(*place, F.posexplode(around).alias("pos", "line"))
    from relscope.session import values_frame
    fixed = [(0, -1, 0, 0, i, t) for i, t in enumerate(("# Statistical Evaluation Report", "", "## Results"))]
    fixed += [(2, -1, -1, 0, i, t) for i, t in enumerate(("", "## Plain-Language Summary", ""))]
    return body.unionByName(values_frame(lines.sparkSession, fixed, "section int, group_seq int, part int, seq int, pos int, line string"))


REPORT_ORDER = ("section", "group_seq", "part", "seq", "pos")


def report_text(lines: DataFrame) -> str:
    """The assembled report (result-sized) as Markdown text."""
    return "".join(r["line"] + "\n" for r in assembled_report(lines).orderBy(*REPORT_ORDER).collect())
