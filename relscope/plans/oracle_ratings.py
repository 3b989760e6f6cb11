"""DuckDB oracle SQL for rating agreement and human-vs-gold agreement.

The Student-t tail of Pearson r uses Simpson's rule on the t density
(``lgamma`` is available in DuckDB), 4000 intervals on [0, min(|t|, 40)].
"""

from __future__ import annotations

from relscope.plans.fixtures import with_clause

_R = 9   # decimals kept for order-dependent float sums (same as the Spark query)
_P = 6


def student_p_sql(r: str, n: str) -> str:
    nu = f"({n} - 2)"
    t = f"least(abs({r}) * sqrt({nu} / (1 - {r} * {r})), 40.0)"
    dens = (f"exp(lgamma(({nu} + 1) / 2.0) - lgamma({nu} / 2.0) - 0.5 * ln({nu} * pi()) "
            f"- ({nu} + 1) / 2.0 * ln(1 + pow(i * {t} / 4000, 2) / {nu}))")
    simpson = (f"list_sum(list_transform(range(0, 4001), lambda i: "
               f"(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {dens}))")
    return (f"CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 "
            f"ELSE greatest(1 - 2 * ({t} / 4000 / 3) * {simpson}, 0.0) END")


def _metrics(keys: str) -> str:
    return f"""
  SELECT {keys}, count(*) AS n, avg(abs(a - b)) AS mae, sqrt(avg((a - b) * (a - b))) AS rmse,
         sqrt(sum((a - b) * (a - b))) AS l2_distance,
         CASE WHEN stddev_pop(a) * stddev_pop(b) > 0
              THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS pearson_r,
         avg(a) AS a_mean, avg(b) AS b_mean, stddev_pop(a) AS a_std, stddev_pop(b) AS b_std
  FROM o_long GROUP BY {keys}"""


def _final(keys: str) -> str:
    cols = ", ".join(f"round({c}, {_R}) AS {c}" for c in
                     ("mae", "rmse", "l2_distance", "pearson_r"))
    cols2 = ", ".join(f"round({c}, {_R}) AS {c}" for c in ("a_mean", "b_mean", "a_std", "b_std"))
    return (f"SELECT {keys}, n, {cols}, round({student_p_sql('pearson_r', 'n')}, {_P}) AS pearson_p, "
            f"{cols2} FROM o_m")


def rating_agreement() -> str:
    long = """
  SELECT run_id, pred_relevance AS a, h1 AS b FROM fx_ratings
  WHERE pred_relevance IS NOT NULL AND h1 IS NOT NULL"""
    return with_clause(["fx_ratings", "o_long", "o_m"],
                       {"o_long": long, "o_m": _metrics("run_id")}) + _final("run_id")


def rating_correlation() -> str:
    return ("SELECT run_id, n, pearson_r, pearson_p FROM (" + rating_agreement() + ") t")


def rating_agreement_all() -> str:
    long = """
  SELECT run_id, comparison, a, b FROM (
    SELECT run_id, 'model_vs_h1' AS comparison, pred_relevance AS a, h1 AS b FROM fx_ratings
    UNION ALL SELECT run_id, 'model_vs_h2', pred_relevance, h2 FROM fx_ratings
    UNION ALL SELECT run_id, 'h1_vs_h2', h1, h2 FROM fx_ratings
    UNION ALL SELECT run_id, 'model_vs_mean', pred_relevance,
                     CASE WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN (h1 + h2) / 2 END FROM fx_ratings
  ) u WHERE a IS NOT NULL AND b IS NOT NULL"""
    return with_clause(["fx_ratings", "o_long", "o_m"],
                       {"o_long": long, "o_m": _metrics("run_id, comparison")}) \
        + _final("run_id, comparison")


def attach_labels() -> str:
    return with_clause(["fx_predictions", "fx_ratings"]) + """
SELECT p.pair_id, p.run_id, p.strategy, p.pred_relevance, r.h1, r.h2
FROM fx_predictions p LEFT JOIN fx_ratings r ON r.pair_id = p.pair_id
WHERE p.strategy = 'D'"""


def _class_block(k: str, name: str) -> list[str]:
    sc = "yp IS NOT NULL"
    t, p = f"coalesce(yt = '{name}', FALSE)", f"coalesce(yp = '{name}', FALSE)"
    return [f"count_if({sc} AND {t} AND {p}) AS tp_{k}",
            f"count_if({sc} AND NOT {t} AND {p}) AS fp_{k}",
            f"count_if({sc} AND {t} AND NOT {p}) AS fn_{k}",
            f"count_if({sc} AND NOT {t} AND NOT {p}) AS tn_{k}"]


def human_agreement() -> str:
    classes = {"attack": "Attack", "support": "Support", "no_relation": "No Relation"}
    lab = """
  SELECT gold, human,
         CASE gold WHEN 0 THEN 'Attack' WHEN 1 THEN 'Support' WHEN 2 THEN 'No Relation' END AS yt,
         CASE human WHEN 0 THEN 'Attack' WHEN 1 THEN 'Support' WHEN 2 THEN 'No Relation' END AS yp
  FROM fx_human WHERE gold IS NOT NULL AND human IS NOT NULL AND gold IN (0, 1, 2)"""
    agg = ["count(*) AS n", "count_if(gold = 0) AS ground_truth_count_attack",
           "count_if(gold = 1) AS ground_truth_count_support",
           "count_if(gold = 2) AS ground_truth_count_no_relation",
           "count_if(yt = yp) AS n_correct"]
    for k, name in classes.items():
        agg += _class_block(k, name)
    pr = []
    for k in classes:
        pr += [f"CASE WHEN tp_{k} + fp_{k} > 0 THEN tp_{k} / (tp_{k} + fp_{k}) ELSE 0.0 END AS p_{k}",
               f"CASE WHEN tp_{k} + fn_{k} > 0 THEN tp_{k} / (tp_{k} + fn_{k}) ELSE 0.0 END AS r_{k}"]
    f1 = [f"CASE WHEN p_{k} + r_{k} > 0 THEN 2 * p_{k} * r_{k} / (p_{k} + r_{k}) ELSE 0.0 END AS f1_{k}"
          for k in classes]
    ctes = {
        "o_hl": lab,
        "o_ha": "\n  SELECT " + ", ".join(agg) + " FROM o_hl",
        "o_hp": "\n  SELECT *, " + ", ".join(pr) + " FROM o_ha",
        "o_hf": "\n  SELECT *, " + ", ".join(f1) + " FROM o_hp",
        "o_hd": """
  SELECT count_if(gold IS NULL OR human IS NULL) AS n_dropped,
         count_if(human IS NOT NULL AND gold IS NOT NULL AND gold NOT IN (0, 1, 2)) AS n_rejected,
         count_if(gold IS NOT NULL AND human IS NOT NULL AND human NOT IN (0, 1, 2)) AS n_human_rejected,
         count_if(human = 0) AS human_count_attack, count_if(human = 1) AS human_count_support,
         count_if(human = 2) AS human_count_no_relation
  FROM fx_human""",
    }
    cols = ["n", "ground_truth_count_attack", "ground_truth_count_support",
            "ground_truth_count_no_relation", "n_correct",
            "CASE WHEN n > 0 THEN n_correct / n END AS accuracy"]
    for k in classes:
        cols += [f"tp_{k} AS true_positive_{k}", f"fp_{k} AS false_positive_{k}",
                 f"fn_{k} AS false_negative_{k}", f"tn_{k} AS true_negative_{k}",
                 f"p_{k} AS precision_{k}", f"r_{k} AS recall_{k}", f"f1_{k} AS f1_score_{k}"]
    cols += ["(f1_attack + f1_support + f1_no_relation) / 3 AS macro_f1", "n_dropped", "n_rejected", "n_human_rejected",
             "human_count_attack", "human_count_support", "human_count_no_relation"]
    return (with_clause(["fx_human", *ctes], ctes)
            + "SELECT " + ", ".join(cols) + " FROM o_hf CROSS JOIN o_hd")


def human_confusion() -> str:
    return with_clause(["fx_human"]) + """
, o_cls AS (SELECT * FROM (VALUES ('Attack', 0), ('Support', 1), ('No Relation', 2)) AS t(class, class_seq))
SELECT 'C' AS strategy, t.class AS y_true, t.class_seq AS true_seq, p.class AS y_pred,
       p.class_seq AS pred_seq,
       (SELECT count(*) FROM fx_human h WHERE h.gold = t.class_seq AND h.human = p.class_seq) AS n
FROM o_cls t, o_cls p"""


def human_labels_plain() -> str:
    return with_clause(["fx_human"]) + \
        ("SELECT doc_id AS orig_idx, CAST(gold AS BIGINT) AS support, "
         "CAST(human AS BIGINT) AS support_human FROM fx_human")
