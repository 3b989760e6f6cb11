"""Per-row label expressions: ``Column`` builders, all JVM-side.

Several strategies can share one frame, so every rule is one expression
switching on the ``strategy`` column instead of a per-strategy code path.
The rules are written as SQL expression text and parsed once by the JVM
(``F.expr``): the same Catalyst expressions as the Column API, built with one
call instead of dozens of Python-to-JVM round trips.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relscope.schema import ATTACK, NO_RELATION, NOT_ATTACK, SUPPORT, SUPPORT_MAP


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _q(name: str) -> str:
    return f"`{name}`"


def support_label_sql(gold: str = "support") -> str:
    whens = " ".join(f"WHEN {_q(gold)} = {code} THEN '{SUPPORT_MAP[code]}'" for code in sorted(SUPPORT_MAP))
    return f"CASE {whens} END"


def support_label(gold="support") -> Column:
    """0/1/2 -> label text; anything else -> null."""
    if isinstance(gold, str):
        return F.expr(support_label_sql(gold))
    g = gold
    expr = F.lit(None).cast("string")
    for code in sorted(SUPPORT_MAP, reverse=True):
        expr = F.when(g == code, F.lit(SUPPORT_MAP[code])).otherwise(expr)
    return expr


def dataset_tag(path="dataset_file") -> Column:
    """Dataset path -> NR_Web (prefix NR_), QBAF (contains), else Web."""
    p = _c(path).cast("string")
    return (F.when(p.startswith("NR_"), F.lit("NR_Web"))
            .when(p.contains("QBAF"), F.lit("QBAF"))
            .otherwise(F.lit("Web")))


def is_valid_sql(strategy: str = "strategy") -> str:
    s = _q(strategy)
    a = "pred_attack IS NOT NULL"
    b = f"{a} AND pred_support IS NOT NULL"
    c = f"{b} AND pred_neither IS NOT NULL"
    return (f"(CASE WHEN {s} = 'A' THEN {a} WHEN {s} = 'B' THEN ({b}) "
            f"WHEN {s} IN ('C', 'D') THEN ({c}) ELSE FALSE END)")


def is_valid(strategy="strategy") -> Column:
    """Row has every flag its strategy needs (A: attack; B: +support; C/D: +neither)."""
    return F.expr(is_valid_sql(strategy))


def known_gold(strategy="strategy", gold="support") -> Column:
    """Gold codes B/C/D can score; A folds any other code into Not-Attack."""
    return F.expr(f"({_q(strategy)} = 'A' OR {_q(gold)} IN (0, 1, 2))")


def row_correct_sql(strategy: str = "strategy", gold: str = "support") -> str:
    s, g = _q(strategy), _q(gold)
    a = f"(({g} = 0) = (pred_attack = 1))"
    b = f"(CASE WHEN {g} = 0 THEN pred_attack = 1 WHEN {g} = 1 THEN pred_support = 1 ELSE FALSE END)"
    c = (f"(CASE WHEN {g} = 0 THEN pred_attack = 1 WHEN {g} = 1 THEN pred_support = 1 "
         f"ELSE pred_neither = 1 END)")
    hit = f"(CASE WHEN {s} = 'A' THEN {a} WHEN {s} = 'B' THEN {b} ELSE {c} END)"
    return f"(CASE WHEN {is_valid_sql(strategy)} THEN CAST({hit} AS INT) END)"


def row_correct(strategy="strategy", gold="support") -> Column:
    """1 / 0 / null per row.  Looks only at the flag of the gold class, so a
    row with two flags set can be right here and wrong in the confusion matrix."""
    return F.expr(row_correct_sql(strategy, gold))


def y_true_sql(strategy: str = "strategy", gold: str = "support") -> str:
    s, g = _q(strategy), _q(gold)
    binary = f"(CASE WHEN {g} = 0 THEN '{ATTACK}' ELSE '{NOT_ATTACK}' END)"
    return f"(CASE WHEN {s} = 'A' THEN {binary} ELSE {support_label_sql(gold)} END)"


def y_true(strategy="strategy", gold="support") -> Column:
    return F.expr(y_true_sql(strategy, gold))


def y_pred_sql(strategy: str = "strategy") -> str:
    s = _q(strategy)
    a = f"(CASE WHEN pred_attack = 1 THEN '{ATTACK}' ELSE '{NOT_ATTACK}' END)"
    b = (f"(CASE WHEN pred_attack = 1 THEN '{ATTACK}' WHEN pred_support = 1 THEN '{SUPPORT}' "
         f"ELSE '{NO_RELATION}' END)")
    c = (f"(CASE WHEN pred_attack = 1 THEN '{ATTACK}' WHEN pred_support = 1 THEN '{SUPPORT}' "
         f"WHEN pred_neither = 1 THEN '{NO_RELATION}' END)")
    return (f"(CASE WHEN {is_valid_sql(strategy)} THEN "
            f"(CASE WHEN {s} = 'A' THEN {a} WHEN {s} = 'B' THEN {b} ELSE {c} END) END)")


def y_pred(strategy="strategy") -> Column:
    """Predicted label with priority Attack > Support > No Relation.

    A: Attack / Not-Attack.  B: both flags 0 -> No Relation.  C/D: no flag -> null
    (left out of F1, still counted wrong for accuracy).  Null on invalid rows."""
    return F.expr(y_pred_sql(strategy))


def derive_labels(df, strategy="strategy", gold="support"):
    """Adds ``valid``, ``y_true``, ``y_pred`` and ``correct`` to a prediction frame."""
    return df.withColumns({
        "valid": is_valid(strategy),
        "y_true": y_true(strategy, gold),
        "y_pred": y_pred(strategy),
        "correct": row_correct(strategy, gold),
    })
