"""DuckDB oracle SQL for the run-comparison queries over fx_runs.

The normal tail has no closed form in DuckDB (no ``erf``): the oracle uses
Simpson's rule on the standard normal density, 2000 intervals on
[0, min(|z|, 10)], which agrees with ``erfc`` to ~1e-11.
"""

from __future__ import annotations

from relscope.plans import oracle_scoring as osc
from relscope.plans.fixtures import run_metadata_sql, with_clause
from relscope.plans.specs import FIXTURE_SPECS, GROUP_NOTES, GROUP_TITLES


def _lit(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def specs_sql(rows=FIXTURE_SPECS) -> str:
    order = {g: i for i, (g, _) in enumerate(GROUP_TITLES)}
    vals = []
    for i, r in enumerate(rows):
        vals.append("(" + ", ".join(_lit(v) for v in (i, order[r[0]]) + tuple(r)) + ")")
    names = ("spec_seq, group_seq, \"group\", comparison, strategy, factor, ds, group1, strategy1, "
             "few_shot_n1, ds1, batch_size1, model1, group2, strategy2, few_shot_n2, ds2, "
             "batch_size2, model2")
    return "\n  SELECT * FROM (VALUES\n    " + ",\n    ".join(vals) + f") AS t({names})"


_ANNOTATE = """
  SELECT *, CAST(round_even(accuracy * n_eff, 0) AS BIGINT) AS n_correct_eff
  FROM (
    SELECT *,
      CASE WHEN substr(dataset_file, 1, 3) = 'NR_' THEN 'NR_Web'
           WHEN position('QBAF' IN dataset_file) > 0 THEN 'QBAF' ELSE 'Web' END AS ds,
      CAST(CASE WHEN strategy IN ('C', 'D')
                THEN predicted_count_attack + predicted_count_support + predicted_count_no_relation
                WHEN strategy = 'B' THEN predicted_count_attack + predicted_count_support
                ELSE true_positive_attack + false_positive_attack + false_negative_attack
                     + true_negative_attack END AS BIGINT) AS n_eff
    FROM fx_runs) a"""

_SIDES = """
  SELECT spec_seq, 1 AS side, strategy1 AS c_strategy, few_shot_n1 AS c_few_shot_n, ds1 AS c_ds,
         batch_size1 AS c_batch_size, model1 AS c_model FROM o_specs
  UNION ALL
  SELECT spec_seq, 2 AS side, strategy2, few_shot_n2, ds2, batch_size2, model2 FROM o_specs"""

_MATCH = """
  SELECT s.spec_seq, s.side, r.run_id, r.run_seq, r.model, r.accuracy, r.n_eff, r.n_correct,
         row_number() OVER (PARTITION BY s.spec_seq, s.side ORDER BY r.run_seq) AS rn,
         count(*) OVER (PARTITION BY s.spec_seq, s.side) AS n_matches
  FROM o_sides s JOIN o_runs r
    ON s.c_strategy = r.strategy AND s.c_few_shot_n = r.few_shot_n AND s.c_ds = r.ds
   AND s.c_batch_size = r.batch_size AND (s.c_model IS NULL OR s.c_model = r.model)"""


def normal_p_sql(z: str) -> str:
    a = f"least(abs({z}), 10.0)"
    simpson = (f"list_sum(list_transform(range(0, 2001), lambda i: "
               f"(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
               f"* exp(-0.5 * pow(i * {a} / 2000, 2))))")
    return f"greatest(1 - 2 * ({a} / 2000 / 3) * {simpson} / sqrt(2 * pi()), 0.0)"


def ztest_select(x1, n1, x2, n2) -> str:
    """z-test columns over the pre-joined row (names of x1, n1, x2, n2)."""
    return f"""
    {x1} / {n1} AS p1, {x2} / {n2} AS p2, ({x1} + {x2}) / ({n1} + {n2}) AS pool,
    CAST(1 AS DOUBLE) / {n1} + CAST(1 AS DOUBLE) / {n2} AS nobs_fact"""


def _z_cols() -> str:
    return """
    (p1 - p2) * 100 AS diff_pp,
    CASE WHEN pool > 0 AND pool < 1 THEN (p1 - p2) / sqrt(pool * (1 - pool) * nobs_fact) END AS z"""


def _final_cols() -> str:
    return f"diff_pp, z, round({normal_p_sql('z')}, 6) AS p_value, coalesce({normal_p_sql('z')} < 0.05, FALSE) AS significant"


def ctes() -> dict[str, str]:
    c = osc.labeled_ctes()
    c["o_runsum"] = "\n  " + osc.run_summary_select()
    c["fx_runs"] = run_metadata_sql("o_runsum")
    c["o_runs"] = ("\n  SELECT * EXCLUDE (n_correct, n_correct_eff), n_correct_eff AS n_correct FROM ("
                   + _ANNOTATE + ") x")
    c["o_specs"] = specs_sql()
    c["o_sides"] = _SIDES
    c["o_match"] = _MATCH
    c["o_found"] = "\n  SELECT * FROM o_match WHERE rn = 1"
    c["o_cmp_raw"] = f"""
  SELECT s.spec_seq, s.group_seq, s."group", s.comparison, s.strategy, s.factor, s.ds,
         s.group1, s.group2, f1.accuracy AS acc1, f1.n_eff AS n1, f2.accuracy AS acc2,
         f2.n_eff AS n2, {ztest_select('f1.n_correct', 'f1.n_eff', 'f2.n_correct', 'f2.n_eff')}
  FROM o_specs s
  JOIN o_found f1 ON f1.spec_seq = s.spec_seq AND f1.side = 1
  JOIN o_found f2 ON f2.spec_seq = s.spec_seq AND f2.side = 2"""
    c["o_cmp_z"] = f"\n  SELECT *, {_z_cols()} FROM o_cmp_raw"
    c["o_cmp"] = f"""
  SELECT spec_seq, group_seq, "group", comparison, strategy, factor, ds, group1, group2,
         acc1, n1, acc2, n2, {_final_cols()}
  FROM o_cmp_z"""
    return c


def _w(*names) -> str:
    c = ctes()
    return with_clause(["fx_predictions", *names], c)


def dataset_tag() -> str:
    return _w("o_runs") + "SELECT run_id, dataset_file, ds FROM o_runs"


def n_eff() -> str:
    return _w("o_runs") + "SELECT run_id, strategy, ds, accuracy, n_eff, n_correct FROM o_runs"


def lookup_run() -> str:
    return _w("o_found") + """
SELECT spec_seq, side, n_matches, run_id, run_seq, model, accuracy, n_eff, n_correct FROM o_found"""


def compare_runs() -> str:
    return _w("o_cmp") + "SELECT * FROM o_cmp"


def ordered_report() -> str:
    return _w("o_cmp") + """
SELECT row_number() OVER (ORDER BY group_seq, spec_seq) AS report_pos, group_seq, spec_seq,
       "group", comparison FROM o_cmp"""


def missing_runs() -> str:
    return _w("o_found") + """
SELECT s.spec_seq, s.side, p."group", p.comparison, s.c_strategy AS strategy,
       s.c_few_shot_n AS few_shot_n, s.c_ds AS ds, s.c_batch_size AS batch_size, s.c_model AS model
FROM o_sides s JOIN o_specs p ON p.spec_seq = s.spec_seq
WHERE NOT EXISTS (SELECT 1 FROM o_found f WHERE f.spec_seq = s.spec_seq AND f.side = s.side)"""


def ambiguous_runs() -> str:
    return _w("o_found") + """
SELECT spec_seq, side, n_matches, run_seq AS chosen_run_seq FROM o_found WHERE n_matches > 1"""


def first_run_per_key() -> str:
    return _w("o_runs") + """
SELECT strategy, few_shot_n, ds, batch_size, n_runs, run_id, run_seq, model, accuracy, n_eff, n_correct
FROM (SELECT *, row_number() OVER (PARTITION BY strategy, few_shot_n, ds, batch_size ORDER BY run_seq) AS rn,
             count(*) OVER (PARTITION BY strategy, few_shot_n, ds, batch_size) AS n_runs
      FROM o_runs) t
WHERE rn = 1"""


def _pairs(join_keys, order_col, label_sql) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in join_keys)
    keys = ", ".join(f"a.{k} AS {k}" for k in join_keys)
    return _w("o_runs") + f""", o_first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, few_shot_n, ds, batch_size, model
                                               ORDER BY run_seq) AS rn FROM o_runs) t WHERE rn = 1
), o_pair AS (
  SELECT {keys}, a.{order_col} AS {order_col}1, b.{order_col} AS {order_col}2, {label_sql} AS comparison,
         a.accuracy AS acc1, a.n_eff AS n1, b.accuracy AS acc2, b.n_eff AS n2,
         {ztest_select('a.n_correct', 'a.n_eff', 'b.n_correct', 'b.n_eff')}
  FROM o_first a JOIN o_first b ON {on} AND a.{order_col} < b.{order_col}
), o_pair_z AS (SELECT *, {_z_cols()} FROM o_pair)
SELECT {', '.join(join_keys)}, {order_col}1, {order_col}2, comparison, acc1, n1, acc2, n2, {_final_cols()}
FROM o_pair_z"""


def few_shot_dose_response() -> str:
    label = ("printf('%s %d-shot vs %d-shot (b%d) | %s', a.strategy, a.few_shot_n, b.few_shot_n, "
             "a.batch_size, a.model)")
    return _pairs(["strategy", "ds", "batch_size", "model"], "few_shot_n", label)


def cross_model() -> str:
    label = ("printf('%s %d-shot %s b%d | %s vs %s', a.strategy, a.few_shot_n, a.ds, a.batch_size, "
             "a.model, b.model)")
    return _pairs(["strategy", "few_shot_n", "ds", "batch_size"], "model", label)


def significance_summary() -> str:
    return _w("o_cmp") + """
SELECT "group", count(*) AS n_comparisons, count_if(significant) AS n_significant,
       count_if(NOT significant) AS n_not_significant
FROM o_cmp GROUP BY "group"
UNION ALL
SELECT 'all', count(*), count_if(significant), count_if(NOT significant) FROM o_cmp"""


def two_prop_ztest() -> str:
    return _w("o_runs") + f""", o_base AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY run_seq) AS rn
                 FROM o_runs) t WHERE rn = 1
), o_t AS (
  SELECT r.run_id, r.strategy, b.run_id AS base_run_id, r.accuracy AS acc1, r.n_eff AS n1,
         b.accuracy AS acc2, b.n_eff AS n2,
         {ztest_select('r.n_correct', 'r.n_eff', 'b.n_correct', 'b.n_eff')}
  FROM o_runs r JOIN o_base b ON b.strategy = r.strategy
), o_tz AS (SELECT *, {_z_cols()} FROM o_t)
SELECT run_id, strategy, base_run_id, acc1, n1, acc2, n2, {_final_cols()} FROM o_tz"""


def comparison_report() -> str:
    heads = []
    for i, (g, title) in enumerate(GROUP_TITLES):
        heads.append(f"({i}, 0, 0, {_lit('### ' + title)})")
        if g in GROUP_NOTES:
            heads.append(f"({i}, 1, 0, {_lit(GROUP_NOTES[g])})")
        heads.append(f"({i}, 2, 0, {_lit('| Comparison | acc1 (n1) | acc2 (n2) | diff (pp) | z | p-value | Sig? |')})")
        heads.append(f"({i}, 2, 1, {_lit('|---|---|---|---|---|---|---|')})")
    head_sql = "SELECT * FROM (VALUES " + ", ".join(heads) + ") AS h(group_seq, part, seq, line)"
    return _w("o_cmp") + f"""
SELECT 1 AS section, group_seq, part, seq, line FROM ({head_sql}) h
WHERE group_seq IN (SELECT group_seq FROM o_cmp)
UNION ALL
SELECT 1, group_seq, 3, spec_seq,
       '| ' || comparison || ' | ' || printf('%.4f', acc1) || ' (' || CAST(n1 AS VARCHAR) || ') | '
       || printf('%.4f', acc2) || ' (' || CAST(n2 AS VARCHAR) || ') | ' || printf('%+.2f', diff_pp)
       || ' | ' || printf('%+.3f', z) || ' | ' || printf('%.4f', p_value) || ' | '
       || CASE WHEN significant THEN '✓' ELSE '' END || ' |'
FROM o_cmp
UNION ALL
SELECT 2, 0, 0, 0, '**Statistically significant differences (α = 0.05):**'
WHERE (SELECT count_if(significant) FROM o_cmp) > 0
UNION ALL
SELECT 2, group_seq, 1, spec_seq,
       '- **' || comparison || '**: ' || group1 || ' (' || printf('%.3f', acc1) || ') vs ' || group2
       || ' (' || printf('%.3f', acc2) || '), z = ' || printf('%+.3f', z) || ', p = '
       || printf('%.4f', p_value) || ', diff = ' || printf('%+.2f', diff_pp) || ' pp.'
FROM o_cmp WHERE significant
UNION ALL
SELECT 3, 0, 0, 0, printf('Of %d comparisons, **%d** are significant at α = 0.05 and **%d** are not.',
                          count(*), count_if(significant), count_if(NOT significant))
FROM o_cmp"""


_RUN_COLS = ("run_id, model, strategy, few_shot_n, dataset_file, batch_size, n_evaluated, accuracy, "
             "macro_f1, true_positive_attack, precision_attack, f1_score_no_relation")


def runs_plain() -> str:
    cols = _RUN_COLS.replace("few_shot_n,", "CAST(few_shot_n AS BIGINT) AS few_shot_n,").replace(
        "batch_size,", "CAST(batch_size AS BIGINT) AS batch_size,")
    return _w("fx_runs") + f"SELECT {cols} FROM fx_runs"


def union_runs() -> str:
    return _w("fx_runs") + f"""
SELECT {_RUN_COLS} FROM fx_runs WHERE run_id < 40
UNION ALL
SELECT {_RUN_COLS.replace("macro_f1", "CAST(NULL AS DOUBLE) AS macro_f1")} FROM fx_runs WHERE run_id >= 40"""


def n_eff_plain() -> str:
    return _w("o_runs") + "SELECT run_id, ds, n_eff, n_correct FROM o_runs"


def comparisons_plain() -> str:
    return _w("o_cmp") + """
SELECT "group", comparison, strategy, factor, ds, group1, acc1, n1, group2, acc2, n2, diff_pp, z,
       p_value, significant
FROM o_cmp"""


def report_plain() -> str:
    fixed = ", ".join(_lit(t) for t in ("# Statistical Evaluation Report", "", "## Results", "", "## Plain-Language Summary", ""))
    return "SELECT unnest(CASE WHEN section = 1 AND part = 0 THEN ['', line, ''] WHEN section = 1 AND part = 1 THEN [line, ''] " + \
        "WHEN section = 2 AND part = 0 THEN [line, ''] WHEN section = 3 THEN ['', line] ELSE [line] END) AS value FROM (" + \
        comparison_report() + f") r UNION ALL SELECT unnest([{fixed}])"
