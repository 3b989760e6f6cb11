"""DuckDB oracle SQL for the scoring queries (independent, row-level SQL).

The oracle deliberately does NOT follow the Spark plan (cells, then metrics):
it labels every row with CASE expressions and counts with ``count_if``
straight from the rows, so a bug in the cell logic cannot hide in both.
"""

from __future__ import annotations

from relscope.plans.fixtures import with_clause

# Classes scored per strategy (fixed values, same as relscope.schema).
_CLASS_SQL = """
  SELECT * FROM (VALUES
    ('A', 'Attack', 0), ('A', 'Not-Attack', 1),
    ('B', 'Attack', 0), ('B', 'Support', 1),
    ('C', 'Attack', 0), ('C', 'Support', 1), ('C', 'No Relation', 2),
    ('D', 'Attack', 0), ('D', 'Support', 1), ('D', 'No Relation', 2)) AS t(strategy, class, class_seq)"""

_LABELED = """
  SELECT pair_id, run_id, strategy, support, pred_attack, pred_support, pred_neither,
         valid, yt, CASE WHEN valid THEN yp END AS yp,
         CASE WHEN NOT valid THEN NULL
              WHEN strategy = 'A' THEN CASE WHEN (support = 0) = (pred_attack = 1) THEN 1 ELSE 0 END
              WHEN strategy = 'B' THEN CASE WHEN support = 0 AND pred_attack = 1 THEN 1
                                            WHEN support = 1 AND pred_support = 1 THEN 1 ELSE 0 END
              ELSE CASE WHEN support = 0 THEN CASE WHEN pred_attack = 1 THEN 1 ELSE 0 END
                        WHEN support = 1 THEN CASE WHEN pred_support = 1 THEN 1 ELSE 0 END
                        ELSE CASE WHEN pred_neither = 1 THEN 1 ELSE 0 END END
         END AS correct
  FROM (
    SELECT *,
      CASE strategy WHEN 'A' THEN pred_attack IS NOT NULL
                    WHEN 'B' THEN pred_attack IS NOT NULL AND pred_support IS NOT NULL
                    WHEN 'C' THEN pred_attack IS NOT NULL AND pred_support IS NOT NULL
                                  AND pred_neither IS NOT NULL
                    WHEN 'D' THEN pred_attack IS NOT NULL AND pred_support IS NOT NULL
                                  AND pred_neither IS NOT NULL
                    ELSE FALSE END AS valid,
      CASE WHEN strategy = 'A' THEN CASE WHEN support = 0 THEN 'Attack' ELSE 'Not-Attack' END
           WHEN support = 0 THEN 'Attack' WHEN support = 1 THEN 'Support'
           WHEN support = 2 THEN 'No Relation' END AS yt,
      CASE WHEN strategy = 'A' THEN CASE WHEN pred_attack = 1 THEN 'Attack' ELSE 'Not-Attack' END
           WHEN strategy = 'B' THEN CASE WHEN pred_attack = 1 THEN 'Attack'
                                         WHEN pred_support = 1 THEN 'Support'
                                         ELSE 'No Relation' END
           ELSE CASE WHEN pred_attack = 1 THEN 'Attack' WHEN pred_support = 1 THEN 'Support'
                     WHEN pred_neither = 1 THEN 'No Relation' END END AS yp
    FROM fx_predictions
    WHERE strategy = 'A' OR support IN (0, 1, 2)) s"""

_CLASSES = {"attack": "Attack", "support": "Support", "no_relation": "No Relation",
            "not_attack": "Not-Attack"}
_APPLIES = {"attack": "('A', 'B', 'C', 'D')", "support": "('B', 'C', 'D')",
            "no_relation": "('C', 'D')"}


def _agg_sql() -> str:
    sc = "valid AND yp IS NOT NULL"
    parts = ["count(*) AS n_evaluated",
             "count_if(valid) AS n_valid",
             f"count_if({sc}) AS n_scored",
             "CAST(coalesce(sum(CASE WHEN valid THEN correct END), 0) AS BIGINT) AS n_correct",
             "count_if(support = 0) AS ground_truth_count_attack",
             "count_if(support = 1) AS ground_truth_count_support",
             "count_if(support = 2) AS ground_truth_count_no_relation",
             "CAST(sum(coalesce(pred_attack, 0)) AS BIGINT) AS predicted_count_attack",
             "CAST(sum(coalesce(pred_support, 0)) AS BIGINT) AS predicted_count_support",
             "CAST(sum(coalesce(pred_neither, 0)) AS BIGINT) AS predicted_count_no_relation"]
    for k, name in _CLASSES.items():
        t, p = f"coalesce(yt = '{name}', FALSE)", f"coalesce(yp = '{name}', FALSE)"
        parts += [f"count_if({sc} AND {t} AND {p}) AS tp_{k}",
                  f"count_if({sc} AND NOT {t} AND {p}) AS fp_{k}",
                  f"count_if({sc} AND {t} AND NOT {p}) AS fn_{k}",
                  f"count_if({sc} AND NOT {t} AND NOT {p}) AS tn_{k}"]
    return ",\n    ".join(parts)


def _prf_sql() -> str:
    parts = []
    for k in _CLASSES:
        parts += [f"CASE WHEN tp_{k} + fp_{k} > 0 THEN tp_{k} / (tp_{k} + fp_{k}) ELSE 0.0 END AS p_{k}",
                  f"CASE WHEN tp_{k} + fn_{k} > 0 THEN tp_{k} / (tp_{k} + fn_{k}) ELSE 0.0 END AS r_{k}"]
    return ",\n    ".join(parts)


def _f1_sql() -> str:
    return ",\n    ".join(
        f"CASE WHEN p_{k} + r_{k} > 0 THEN 2 * p_{k} * r_{k} / (p_{k} + r_{k}) ELSE 0.0 END AS f1_{k}"
        for k in _CLASSES)


def labeled_ctes() -> dict[str, str]:
    return {
        "o_labeled": _LABELED,
        "o_classes": _CLASS_SQL,
        "o_agg": f"\n  SELECT run_id, strategy,\n    {_agg_sql()}\n  FROM o_labeled GROUP BY run_id, strategy",
        "o_prf": f"\n  SELECT *,\n    {_prf_sql()}\n  FROM o_agg",
        "o_f1": f"\n  SELECT *,\n    {_f1_sql()}\n  FROM o_prf",
    }


# Counted from the rows as they are, without the filter of o_labeled.
_REJECTED = """
  SELECT run_id, strategy, count_if(strategy <> 'A' AND (support IS NULL OR support NOT IN (0, 1, 2)))
         AS n_rejected
  FROM fx_predictions GROUP BY run_id, strategy"""


def run_summary_select(src: str = "o_f1") -> str:
    cols = ["run_id", "strategy", "n_evaluated", "n_valid", "n_scored",
            "ground_truth_count_attack", "ground_truth_count_support",
            "ground_truth_count_no_relation", "predicted_count_attack",
            "predicted_count_support", "predicted_count_no_relation", "n_correct",
            "CASE WHEN n_valid > 0 THEN n_correct / n_valid END AS accuracy"]
    for k, letters in _APPLIES.items():
        on = f"strategy IN {letters}"
        cols += [f"CASE WHEN {on} THEN tp_{k} END AS true_positive_{k}",
                 f"CASE WHEN {on} THEN fp_{k} END AS false_positive_{k}",
                 f"CASE WHEN {on} THEN fn_{k} END AS false_negative_{k}",
                 f"CASE WHEN {on} THEN tn_{k} END AS true_negative_{k}",
                 f"CASE WHEN {on} THEN p_{k} END AS precision_{k}",
                 f"CASE WHEN {on} THEN r_{k} END AS recall_{k}",
                 f"CASE WHEN {on} THEN f1_{k} END AS f1_score_{k}"]
    cols.append("CASE WHEN strategy = 'A' THEN (f1_attack + f1_not_attack) / 2 "
                "WHEN strategy = 'B' THEN (f1_attack + f1_support) / 2 "
                "ELSE (f1_attack + f1_support + f1_no_relation) / 3 END AS macro_f1")
    return "SELECT " + ",\n       ".join(cols) + f"\nFROM {src}"


def _w(extra_names=(), extra=None) -> str:
    ctes = labeled_ctes()
    ctes.update(extra or {})
    return with_clause(["fx_predictions", *ctes.keys(), *extra_names], ctes)


def run_summary() -> str:
    return _w(extra={"o_rej": _REJECTED, "o_sum": "\n  " + run_summary_select()}) + (
        "SELECT o_sum.*, n_rejected FROM o_sum JOIN o_rej USING (run_id, strategy)")


def accuracy() -> str:
    return _w(extra={"o_rej": _REJECTED}) + (
        "SELECT run_id, strategy, n_correct, n_valid, n_rejected, "
        "CASE WHEN n_valid > 0 THEN n_correct / n_valid END AS accuracy "
        "FROM o_agg JOIN o_rej USING (run_id, strategy)")


def gold_distribution() -> str:
    return _w() + """
SELECT r.run_id, r.strategy, c.class, c.class_seq,
       (SELECT count(*) FROM o_labeled l
        WHERE l.run_id = r.run_id AND l.strategy = r.strategy AND l.valid AND l.yt = c.class) AS n_gold
FROM (SELECT DISTINCT run_id, strategy FROM o_labeled) r JOIN o_classes c ON c.strategy = r.strategy"""


def predicted_distribution() -> str:
    return _w() + """
SELECT r.run_id, r.strategy, c.class, c.class_seq,
       (SELECT count(*) FROM o_labeled l
        WHERE l.run_id = r.run_id AND l.strategy = r.strategy AND l.valid AND l.yp = c.class) AS n_pred
FROM (SELECT DISTINCT run_id, strategy FROM o_labeled) r JOIN o_classes c ON c.strategy = r.strategy"""


def predicted_flag_counts() -> str:
    return with_clause(["fx_predictions"]) + """
SELECT run_id, strategy,
       CAST(sum(coalesce(pred_attack, 0)) AS BIGINT) AS predicted_count_attack,
       CAST(sum(coalesce(pred_support, 0)) AS BIGINT) AS predicted_count_support,
       CAST(sum(coalesce(pred_neither, 0)) AS BIGINT) AS predicted_count_no_relation
FROM fx_predictions GROUP BY run_id, strategy"""


def confusion_matrix() -> str:
    return _w() + """
SELECT r.run_id, r.strategy, t.class AS y_true, t.class_seq AS true_seq,
       p.class AS y_pred, p.class_seq AS pred_seq,
       (SELECT count(*) FROM o_labeled l
        WHERE l.run_id = r.run_id AND l.strategy = r.strategy AND l.valid
          AND l.yt = t.class AND l.yp = p.class) AS n
FROM (SELECT DISTINCT run_id, strategy FROM o_labeled) r
JOIN o_classes t ON t.strategy = r.strategy
JOIN o_classes p ON p.strategy = r.strategy"""


def _class_rows() -> str:
    picks = {part: "CASE c.class " + " ".join(
        f"WHEN '{name}' THEN a.{part}_{k}" for k, name in _CLASSES.items()) + " END"
        for part in ("tp", "fp", "fn", "tn")}
    return f"""
  SELECT a.run_id, a.strategy, c.class, c.class_seq, a.n_scored,
         {picks['tp']} AS tp, {picks['fp']} AS fp, {picks['fn']} AS fn, {picks['tn']} AS tn
  FROM o_agg a JOIN o_classes c ON c.strategy = a.strategy"""


def class_counts() -> str:
    return _w(extra={"o_cls": _class_rows()}) + """
SELECT run_id, strategy, class, class_seq, n_scored, tp, fp, fn, tn,
       tp + fp + fn + tn = n_scored AS count_ok
FROM o_cls"""


def _class_f1_ctes() -> dict[str, str]:
    return {"o_cls": _class_rows(),
            "o_cls_pr": """
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
            CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
  FROM o_cls""",
            "o_cls_f1": """
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                 ELSE 0.0 END AS f1
  FROM o_cls_pr"""}


def class_f1() -> str:
    return _w(extra=_class_f1_ctes()) + \
        "SELECT run_id, strategy, class, class_seq, precision, recall, f1 FROM o_cls_f1"


def macro_f1() -> str:
    return _w() + """
SELECT run_id, strategy,
       CASE WHEN strategy = 'A' THEN (f1_attack + f1_not_attack) / 2
            WHEN strategy = 'B' THEN (f1_attack + f1_support) / 2
            ELSE (f1_attack + f1_support + f1_no_relation) / 3 END AS macro_f1,
       n_valid - n_scored AS n_skipped, n_evaluated - n_valid AS n_missing
FROM o_f1"""


def count_check() -> str:
    return _w(extra={"o_cls": _class_rows()}) + """
SELECT run_id, strategy, bool_and(tp + fp + fn + tn = n_scored) AS all_sums_ok,
       max(n_scored) AS n_scored
FROM o_cls GROUP BY run_id, strategy"""


def valid_predictions() -> str:
    return _w(extra={"o_rej": _REJECTED}) + """
SELECT run_id, strategy, n_evaluated AS n_rows, n_valid, n_evaluated - n_valid AS n_dropped, n_rejected
FROM o_agg JOIN o_rej USING (run_id, strategy)"""


def valid_rows() -> str:
    return _w() + "SELECT pair_id, run_id, strategy, support FROM o_labeled WHERE valid"


def rejected_predictions() -> str:
    """Codes moved up by one, so that every third class becomes an unknown one."""
    return with_clause(["fx_predictions"]) + """
SELECT pair_id, run_id, strategy, support + 1 AS support
FROM fx_predictions WHERE strategy <> 'A' AND (support IS NULL OR support + 1 > 2)"""


def strategies_present() -> str:
    return with_clause(["fx_predictions"]) + "SELECT DISTINCT strategy FROM fx_predictions"


def filter_strategy() -> str:
    return with_clause(["fx_predictions"]) + """
SELECT pair_id, run_id, strategy, support FROM fx_predictions WHERE strategy IN ('C', 'D')"""


def support_label() -> str:
    return with_clause(["fx_predictions"]) + """
SELECT pair_id, run_id, support,
       CASE support WHEN 0 THEN 'Attack' WHEN 1 THEN 'Support' WHEN 2 THEN 'No Relation' END
         AS support_label
FROM fx_predictions"""


def derive_labels(letters: tuple[str, ...]) -> str:
    inlist = "(" + ", ".join(f"'{s}'" for s in letters) + ")"
    return _w() + f"""
SELECT pair_id, run_id, strategy, valid, yt AS y_true, yp AS y_pred
FROM o_labeled WHERE strategy IN {inlist}"""


def row_correct() -> str:
    return _w() + "SELECT pair_id, run_id, strategy, correct FROM o_labeled"


def progress() -> str:
    return with_clause(["fx_predictions"]) + """
SELECT run_id, strategy, CAST(count(*) FILTER (WHERE run_id % 3 <> 0) AS BIGINT) AS n_done, count(*) AS n_total,
       CAST(count(*) FILTER (WHERE run_id % 3 <> 0) AS DOUBLE) / count(*) AS progress
FROM fx_predictions GROUP BY run_id, strategy"""
