"""Comparison specifications as data.

A spec row names two run conditions to test against each other; adding a
comparison means adding a row, not code.  Condition = (strategy, few_shot_n,
ds, batch_size, model); a null model matches any model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPEC_SCHEMA = ("group string, comparison string, strategy string, factor string, ds string, "
               "group1 string, strategy1 string, few_shot_n1 int, ds1 string, batch_size1 int, "
               "model1 string, group2 string, strategy2 string, few_shot_n2 int, ds2 string, "
               "batch_size2 int, model2 string")

# ---------------------------------------------------------------------------
# The 43 comparisons of the published study, in its order.
# Columns: group, comparison, strategy, factor, ds,
#          label 1, (strategy, few_shot_n, ds, batch_size, model) 1,
#          label 2, (strategy, few_shot_n, ds, batch_size, model) 2
# ---------------------------------------------------------------------------
G = "gemma4:latest"
CL = "claude-opus-4-8"
GP = "gpt-5.5"
STUDY_SPECS = [
    ("1_zeroshot_vs_fewshot", "A 7-shot vs 0-shot (b10)", "A", "few_shot", "Web", "7-shot", "A", 7, "Web", 10, G, "0-shot", "A", 0, "Web", 10, G),
    ("1_zeroshot_vs_fewshot", "A 10-shot vs 0-shot (b10)", "A", "few_shot", "Web", "10-shot", "A", 10, "Web", 10, G, "0-shot", "A", 0, "Web", 10, G),
    ("1_zeroshot_vs_fewshot", "A 14-shot vs 0-shot (b10)", "A", "few_shot", "Web", "14-shot", "A", 14, "Web", 10, G, "0-shot", "A", 0, "Web", 10, G),
    ("1_zeroshot_vs_fewshot", "A 20-shot vs 0-shot (b10)", "A", "few_shot", "Web", "20-shot", "A", 20, "Web", 10, G, "0-shot", "A", 0, "Web", 10, G),
    ("1_zeroshot_vs_fewshot", "C 10-shot vs 0-shot (b10)", "C", "few_shot", "NR_Web", "10-shot", "C", 10, "NR_Web", 10, G, "0-shot", "C", 0, "NR_Web", 10, G),
    ("1_zeroshot_vs_fewshot", "C 20-shot vs 0-shot (b10)", "C", "few_shot", "NR_Web", "20-shot", "C", 20, "NR_Web", 10, G, "0-shot", "C", 0, "NR_Web", 10, G),
    ("2_batch_size", "A b5 vs b10 (0-shot)", "A", "batch_size", "Web", "b5", "A", 0, "Web", 5, G, "b10", "A", 0, "Web", 10, G),
    ("2_batch_size", "A b5 vs b20 (0-shot)", "A", "batch_size", "Web", "b5", "A", 0, "Web", 5, G, "b20", "A", 0, "Web", 20, G),
    ("2_batch_size", "A b10 vs b20 (0-shot)", "A", "batch_size", "Web", "b10", "A", 0, "Web", 10, G, "b20", "A", 0, "Web", 20, G),
    ("2_batch_size", "C b5 vs b10 (0-shot)", "C", "batch_size", "NR_Web", "b5", "C", 0, "NR_Web", 5, G, "b10", "C", 0, "NR_Web", 10, G),
    ("2_batch_size", "C b10 vs b20 (0-shot)", "C", "batch_size", "NR_Web", "b10", "C", 0, "NR_Web", 10, G, "b20", "C", 0, "NR_Web", 20, G),
    ("2_batch_size", "C b5 vs b20 (0-shot)", "C", "batch_size", "NR_Web", "b5", "C", 0, "NR_Web", 5, G, "b20", "C", 0, "NR_Web", 20, G),
    ("2_batch_size", "B b5 vs b20 (0-shot)", "B", "batch_size", "Web", "b5", "B", 0, "Web", 5, G, "b20", "B", 0, "Web", 20, G),
    ("3_cross_strategy", "A vs B (b5, 0-shot)", "A+B", "strategy", "Web+Web", "A", "A", 0, "Web", 5, G, "B", "B", 0, "Web", 5, G),
    ("3_cross_strategy", "A vs B (b20, 0-shot)", "A+B", "strategy", "Web+Web", "A", "A", 0, "Web", 20, G, "B", "B", 0, "Web", 20, G),
    ("3_cross_strategy", "B vs C (b5, 0-shot)", "B+C", "strategy", "Web+NR_Web", "B", "B", 0, "Web", 5, G, "C", "C", 0, "NR_Web", 5, G),
    ("1b_fewshot_dose_response", "A 7-shot vs 10-shot (b10)", "A", "few_shot", "Web", "7-shot", "A", 7, "Web", 10, G, "10-shot", "A", 10, "Web", 10, G),
    ("1b_fewshot_dose_response", "A 7-shot vs 14-shot (b10)", "A", "few_shot", "Web", "7-shot", "A", 7, "Web", 10, G, "14-shot", "A", 14, "Web", 10, G),
    ("1b_fewshot_dose_response", "A 7-shot vs 20-shot (b10)", "A", "few_shot", "Web", "7-shot", "A", 7, "Web", 10, G, "20-shot", "A", 20, "Web", 10, G),
    ("1b_fewshot_dose_response", "A 10-shot vs 14-shot (b10)", "A", "few_shot", "Web", "10-shot", "A", 10, "Web", 10, G, "14-shot", "A", 14, "Web", 10, G),
    ("1b_fewshot_dose_response", "A 10-shot vs 20-shot (b10)", "A", "few_shot", "Web", "10-shot", "A", 10, "Web", 10, G, "20-shot", "A", 20, "Web", 10, G),
    ("1b_fewshot_dose_response", "A 14-shot vs 20-shot (b10)", "A", "few_shot", "Web", "14-shot", "A", 14, "Web", 10, G, "20-shot", "A", 20, "Web", 10, G),
    ("1b_fewshot_dose_response", "B 10-shot vs 20-shot (b10)", "B", "few_shot", "Web", "10-shot", "B", 10, "Web", 10, G, "20-shot", "B", 20, "Web", 10, G),
    ("1b_fewshot_dose_response", "C 10-shot vs 20-shot (b10)", "C", "few_shot", "NR_Web", "10-shot", "C", 10, "NR_Web", 10, G, "20-shot", "C", 20, "NR_Web", 10, G),
    ("3b_cross_strategy_fewshot", "A vs B 10-shot (b10)", "A+B", "strategy", "Web", "A 10-shot", "A", 10, "Web", 10, G, "B 10-shot", "B", 10, "Web", 10, G),
    ("3b_cross_strategy_fewshot", "A vs B 20-shot (b10)", "A+B", "strategy", "Web", "A 20-shot", "A", 20, "Web", 10, G, "B 20-shot", "B", 20, "Web", 10, G),
    ("4_C_vs_D", "C vs D (b10, 0-shot)", "C+D", "strategy", "NR_Web", "C", "C", 0, "NR_Web", 10, G, "D", "D", 0, "NR_Web", 10, G),
    ("5_cross_model", f"B 0-shot Web b20 | {G} vs {CL}", "B", "model", "Web", G, "B", 0, "Web", 20, G, CL, "B", 0, "Web", 20, CL),
    ("5_cross_model", f"B 0-shot Web b20 | {G} vs {GP}", "B", "model", "Web", G, "B", 0, "Web", 20, G, GP, "B", 0, "Web", 20, GP),
    ("5_cross_model", f"B 0-shot Web b20 | {CL} vs {GP}", "B", "model", "Web", CL, "B", 0, "Web", 20, CL, GP, "B", 0, "Web", 20, GP),
    ("5_cross_model", f"B 20-shot Web b20 | {G} vs {CL}", "B", "model", "Web", G, "B", 20, "Web", 20, G, CL, "B", 20, "Web", 20, CL),
    ("5_cross_model", f"B 20-shot Web b20 | {G} vs {GP}", "B", "model", "Web", G, "B", 20, "Web", 20, G, GP, "B", 20, "Web", 20, GP),
    ("5_cross_model", f"B 20-shot Web b20 | {CL} vs {GP}", "B", "model", "Web", CL, "B", 20, "Web", 20, CL, GP, "B", 20, "Web", 20, GP),
    ("5_cross_model", f"C 0-shot NR_Web b20 | {G} vs {CL}", "C", "model", "NR_Web", G, "C", 0, "NR_Web", 20, G, CL, "C", 0, "NR_Web", 20, CL),
    ("5_cross_model", f"C 0-shot NR_Web b20 | {G} vs {GP}", "C", "model", "NR_Web", G, "C", 0, "NR_Web", 20, G, GP, "C", 0, "NR_Web", 20, GP),
    ("5_cross_model", f"C 0-shot NR_Web b20 | {CL} vs {GP}", "C", "model", "NR_Web", CL, "C", 0, "NR_Web", 20, CL, GP, "C", 0, "NR_Web", 20, GP),
    ("5_cross_model", f"C 20-shot NR_Web b20 | {G} vs {CL}", "C", "model", "NR_Web", G, "C", 20, "NR_Web", 20, G, CL, "C", 20, "NR_Web", 20, CL),
    ("5_cross_model", f"C 20-shot NR_Web b20 | {G} vs {GP}", "C", "model", "NR_Web", G, "C", 20, "NR_Web", 20, G, GP, "C", 20, "NR_Web", 20, GP),
    ("5_cross_model", f"C 20-shot NR_Web b20 | {CL} vs {GP}", "C", "model", "NR_Web", CL, "C", 20, "NR_Web", 20, CL, GP, "C", 20, "NR_Web", 20, GP),
    ("6_zeroshot_vs_fewshot_new_models", f"{CL} B 20-shot vs 0-shot (b20)", "B", "few_shot", "Web", "20-shot", "B", 20, "Web", 20, CL, "0-shot", "B", 0, "Web", 20, CL),
    ("6_zeroshot_vs_fewshot_new_models", f"{CL} C 20-shot vs 0-shot (b20)", "C", "few_shot", "NR_Web", "20-shot", "C", 20, "NR_Web", 20, CL, "0-shot", "C", 0, "NR_Web", 20, CL),
    ("6_zeroshot_vs_fewshot_new_models", f"{GP} B 20-shot vs 0-shot (b20)", "B", "few_shot", "Web", "20-shot", "B", 20, "Web", 20, GP, "0-shot", "B", 0, "Web", 20, GP),
    ("6_zeroshot_vs_fewshot_new_models", f"{GP} C 20-shot vs 0-shot (b20)", "C", "few_shot", "NR_Web", "20-shot", "C", 20, "NR_Web", 20, GP, "0-shot", "C", 0, "NR_Web", 20, GP),
]

# Report order and titles of the comparison groups.
GROUP_TITLES = [
    ("1_zeroshot_vs_fewshot", "Group 1 — Zero-shot vs Few-shot (same strategy, batch 10)"),
    ("1b_fewshot_dose_response", "Group 1b — Few-shot dose-response (same strategy, batch 10)"),
    ("2_batch_size", "Group 2 — Batch size (same strategy, zero-shot)"),
    ("3_cross_strategy", "Group 3 — Cross-strategy (zero-shot, matched batch)"),
    ("3b_cross_strategy_fewshot", "Group 3b — A vs B at matched few-shot (batch 10, WebDataset)"),
    ("4_C_vs_D", "Group 4 — C vs D (zero-shot, batch 10)"),
    ("5_cross_model", "Group 5 — Cross-model comparison (matched b20 conditions)"),
    ("6_zeroshot_vs_fewshot_new_models",
     "Group 6 — Zero-shot vs Few-shot (claude-opus-4-8 and gpt-5.5, batch 20)"),
]
GROUP_NOTES = {
    "3_cross_strategy": ("> **Note:** A/B use `WebDataset` (binary, chance ≈ 50%); C uses "
                         "`NR_WebDataset` (ternary, chance ≈ 33%). Cross-task accuracy is only "
                         "loosely comparable — results are still reported."),
    "3b_cross_strategy_fewshot": ("> **Note:** Both A and B use `WebDataset` (binary); only the "
                                  "prompt strategy differs."),
}

# ---------------------------------------------------------------------------
# Specs over the fixture runs (fx_runs: models m0/m1/m2, 0 or 10 shots,
# batch 10 or 20).  Same shape as the study; includes conditions with no run
# and, where the model is left open (None), conditions with several runs.
# ---------------------------------------------------------------------------
FIXTURE_SPECS = [
    ("1_zeroshot_vs_fewshot", "A 10-shot vs 0-shot (b10)", "A", "few_shot", "Web", "10-shot", "A", 10, "Web", 10, "m0", "0-shot", "A", 0, "Web", 10, "m0"),
    ("1_zeroshot_vs_fewshot", "B 10-shot vs 0-shot (b10)", "B", "few_shot", "Web", "10-shot", "B", 10, "Web", 10, "m0", "0-shot", "B", 0, "Web", 10, "m0"),
    ("1_zeroshot_vs_fewshot", "C 10-shot vs 0-shot (b10)", "C", "few_shot", "NR_Web", "10-shot", "C", 10, "NR_Web", 10, "m0", "0-shot", "C", 0, "NR_Web", 10, "m0"),
    ("1_zeroshot_vs_fewshot", "D 10-shot vs 0-shot (b10)", "D", "few_shot", "NR_Web", "10-shot", "D", 10, "NR_Web", 10, "m0", "0-shot", "D", 0, "NR_Web", 10, "m0"),
    ("2_batch_size", "A b10 vs b20 (0-shot)", "A", "batch_size", "Web", "b10", "A", 0, "Web", 10, "m0", "b20", "A", 0, "Web", 20, "m0"),
    ("2_batch_size", "B b10 vs b20 (0-shot)", "B", "batch_size", "Web", "b10", "B", 0, "Web", 10, "m1", "b20", "B", 0, "Web", 20, "m1"),
    ("2_batch_size", "C b10 vs b20 (0-shot)", "C", "batch_size", "NR_Web", "b10", "C", 0, "NR_Web", 10, "m0", "b20", "C", 0, "NR_Web", 20, "m0"),
    ("2_batch_size", "D b10 vs b20 (0-shot)", "D", "batch_size", "NR_Web", "b10", "D", 0, "NR_Web", 10, "m0", "b20", "D", 0, "NR_Web", 20, "m0"),
    ("2_batch_size", "A b10 vs b20 (0-shot, any model)", "A", "batch_size", "Web", "b10", "A", 0, "Web", 10, None, "b20", "A", 0, "Web", 20, None),
    ("3_cross_strategy", "A vs B (b10, 0-shot)", "A+B", "strategy", "Web+Web", "A", "A", 0, "Web", 10, "m0", "B", "B", 0, "Web", 10, "m0"),
    ("3_cross_strategy", "B vs C (b10, 0-shot)", "B+C", "strategy", "Web+NR_Web", "B", "B", 0, "Web", 10, "m0", "C", "C", 0, "NR_Web", 10, "m0"),
    ("3b_cross_strategy_fewshot", "A vs B 10-shot (b10)", "A+B", "strategy", "Web", "A 10-shot", "A", 10, "Web", 10, "m2", "B 10-shot", "B", 10, "Web", 10, "m2"),
    ("4_C_vs_D", "C vs D (b10, 0-shot)", "C+D", "strategy", "NR_Web", "C", "C", 0, "NR_Web", 10, "m0", "D", "D", 0, "NR_Web", 10, "m0"),
    ("5_cross_model", "B 0-shot Web b10 | m0 vs m1", "B", "model", "Web", "m0", "B", 0, "Web", 10, "m0", "m1", "B", 0, "Web", 10, "m1"),
    ("5_cross_model", "B 0-shot Web b10 | m0 vs m2", "B", "model", "Web", "m0", "B", 0, "Web", 10, "m0", "m2", "B", 0, "Web", 10, "m2"),
    ("5_cross_model", "C 0-shot NR_Web b20 | m0 vs m1", "C", "model", "NR_Web", "m0", "C", 0, "NR_Web", 20, "m0", "m1", "C", 0, "NR_Web", 20, "m1"),
    ("5_cross_model", "C 0-shot NR_Web b20 | m0 vs m2", "C", "model", "NR_Web", "m0", "C", 0, "NR_Web", 20, "m0", "m2", "C", 0, "NR_Web", 20, "m2"),
    ("6_zeroshot_vs_fewshot_new_models", "m1 C 10-shot vs 0-shot (b20)", "C", "few_shot", "NR_Web", "10-shot", "C", 10, "NR_Web", 20, "m1", "0-shot", "C", 0, "NR_Web", 20, "m1"),
]


def spec_frame(spark: SparkSession, rows=None) -> DataFrame:
    """Spec table with ``spec_seq`` (row order) and ``group_seq`` (report order)."""
    rows = STUDY_SPECS if rows is None else rows
    order = {g: i for i, (g, _) in enumerate(GROUP_TITLES)}
    from relscope.session import values_frame
    data = [(i, order.get(r[0], len(order))) + tuple(r) for i, r in enumerate(rows)]
    return values_frame(spark, data, "spec_seq int, group_seq int, " + SPEC_SCHEMA)


def group_frame(spark: SparkSession) -> DataFrame:
    from relscope.session import values_frame
    data = [(i, g, t, GROUP_NOTES.get(g)) for i, (g, t) in enumerate(GROUP_TITLES)]
    return values_frame(spark, data, "group_seq int, group string, title string, note string")
