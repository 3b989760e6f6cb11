"""Scoring: accuracy, confusion matrices, per-class P/R/F1, run summaries.

Plan shape.  One pass over the prediction rows collapses them into *cells*
keyed by ``(run keys, strategy, gold, valid, y_pred)`` with counts, correct
counts and flag sums.  Partial (map-side) aggregation means the only shuffle
that touches row-sized data carries ``cells x tasks`` rows, whatever the input
size and however skewed one run is.  Every metric is then computed from the
cells (a dozen rows per run), so accuracy, confusion, F1 and the summary row
never re-read the predictions and never touch the text columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relscope.functions.labels import derive_labels, is_valid, known_gold, y_true
from relscope.schema import (ATTACK, CLASS_KEYS, NO_RELATION, NOT_ATTACK, STRATEGIES,
                             SUPPORT)

_EVAL_CLASSES = (ATTACK, SUPPORT, NO_RELATION, NOT_ATTACK)


def _keys(df: DataFrame, keys) -> list[str]:
    if keys is not None:
        return list(keys)
    return [k for k in ("run_id",) if k in df.columns]


def filter_strategy(df: DataFrame, strategies=None) -> DataFrame:
    """Keep the given strategies (unknown letters are skipped); all rows when
    ``strategies`` is None or the frame has no strategy column."""
    if strategies is None or "strategy" not in df.columns:
        return df
    keep = [s for s in strategies if s in STRATEGIES]
    return df.filter(F.col("strategy").isin(keep))


def split_rejects(pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows B/C/D cannot score (gold outside 0/1/2) go to ``rejects``."""
    ok = known_gold()
    return pred.filter(ok), pred.filter(~ok | ok.isNull())


def rejected_predictions(pred: DataFrame) -> DataFrame:
    """The rows that no metric can use, as they came; ``n_rejected`` counts them per run."""
    return split_rejects(pred)[1]


def valid_rows(pred: DataFrame) -> DataFrame:
    """The rows that are scored: a known gold code and every flag the strategy needs."""
    return split_rejects(pred)[0].filter(is_valid())


def prediction_cells(pred: DataFrame, keys=None) -> DataFrame:
    """Collapse prediction rows into scoring cells (the one row-sized pass).

    The row-level stage only groups by the raw values -- run keys, strategy,
    gold and the three flags -- with a map-side partial count; the label rules
    (validity, predicted label, correctness) are then evaluated on the cells,
    which are few (runs x gold x flag combinations).  Consumers aggregate the
    cells with conditional sums, never with filters on derived labels, so the
    optimizer has nothing to push back into the row-level stage.

    Rows whose gold code the strategy cannot score count in ``n_rejected`` and
    in nothing else."""
    k = _keys(pred, keys)
    return label_cells(pred.groupBy(*k, *RAW_CELL).agg(F.count(F.lit(1)).alias("_rows")), k)


#: What a prediction row is reduced to before the label rules.
RAW_CELL = ("strategy", "support", "pred_attack", "pred_support", "pred_neither")


def label_cells(raw: DataFrame, keys, carry=()) -> DataFrame:
    """Scoring cells from counts (``_rows``) of the raw values; columns of ``carry`` go along."""
    k = [*keys, *carry]
    known = F.coalesce(known_gold(), F.lit(False))
    d = derive_labels(raw).withColumns(
        {"n": F.when(known, F.col("_rows")).otherwise(F.lit(0)),
         "n_rejected": F.when(known, F.lit(0)).otherwise(F.col("_rows"))})
    n = F.col("n")
    # Optimization fence: the labels reference the cell count (n >= 1 for every
    # scored cell; rejected ones have no labels).  Predicates on them -- including the not-null
    # constraints Catalyst infers from later joins -- then stay on the small
    # cell table instead of being inlined into the row-level scan filter.
    fence = n > 0
    d = d.withColumns({"valid": F.when(fence, F.col("valid")),
                       "y_pred": F.when(fence, F.col("y_pred")),
                       "correct": F.when(fence, F.col("correct"))})
    return d.select(*k, "strategy", "support", "valid", "y_pred", "n", "n_rejected",
                    (F.coalesce(F.col("correct"), F.lit(0)) * n).cast("long").alias("n_correct"),
                    (F.coalesce("pred_attack", F.lit(0)) * n).cast("long").alias("flag_attack"),
                    (F.coalesce("pred_support", F.lit(0)) * n).cast("long").alias("flag_support"),
                    (F.coalesce("pred_neither", F.lit(0)) * n).cast("long").alias("flag_neither"))


def _n_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).cast("long")


def _applies(cls: str) -> Column:
    letters = [s.letter for s in STRATEGIES.values() if cls in s.classes]
    return F.col("strategy").isin(letters)


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 on a zero denominator."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0))


def _key(cls: str) -> str:
    return cls.replace(" ", "_").replace("-", "_").lower()


def _n_if_sql(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN n ELSE 0 END) AS BIGINT)"


def _ratio_sql(num: str, den: str) -> str:
    """num / den, 0.0 on a zero denominator."""
    return f"coalesce(try_divide({num}, {den}), 0.0)"


def _f1_sql(p: str, r: str) -> str:
    return f"coalesce(try_divide(2.0 * {p} * {r}, {p} + {r}), 0.0)"


def _cell_aggregates(cells: DataFrame, k: list[str], extra=(), one: str | None = None) -> DataFrame:
    """Per run: totals plus TP/FP/FN/TN of every class (strategy applicability later), and the
    ``extra`` aggregates.  ``one`` is the strategy of all cells: then a group without cells counts too."""
    sc = "(valid AND y_pred IS NOT NULL)"
    aggs = ["CAST(sum(n) AS BIGINT) AS n_evaluated",
            "CAST(sum(n_rejected) AS BIGINT) AS n_rejected",
            f"{_n_if_sql('valid')} AS n_valid",
            f"{_n_if_sql(sc)} AS n_scored",
            "CAST(sum(CASE WHEN valid THEN n_correct ELSE 0 END) AS BIGINT) AS n_correct",
            f"{_n_if_sql('support = 0')} AS ground_truth_count_attack",
            f"{_n_if_sql('support = 1')} AS ground_truth_count_support",
            f"{_n_if_sql('support = 2')} AS ground_truth_count_no_relation",
            "CAST(sum(flag_attack) AS BIGINT) AS predicted_count_attack",
            "CAST(sum(flag_support) AS BIGINT) AS predicted_count_support",
            "CAST(sum(flag_neither) AS BIGINT) AS predicted_count_no_relation"]
    for cls in _EVAL_CLASSES:
        t, p, c = f"coalesce(_yt = '{cls}', FALSE)", f"coalesce(y_pred = '{cls}', FALSE)", _key(cls)
        aggs += [f"{_n_if_sql(f'{sc} AND {t} AND {p}')} AS _tp_{c}",
                 f"{_n_if_sql(f'{sc} AND NOT {t} AND {p}')} AS _fp_{c}",
                 f"{_n_if_sql(f'{sc} AND {t} AND NOT {p}')} AS _fn_{c}",
                 f"{_n_if_sql(f'{sc} AND NOT {t} AND NOT {p}')} AS _tn_{c}"]
    with_yt = cells.withColumn("_yt", y_true("strategy", "support"))
    aggs += list(extra)
    if one is not None:
        return with_yt.groupBy(*k).agg(*[F.expr(a) for a in aggs]).withColumn("strategy", F.lit(one))
    return with_yt.groupBy(*k, "strategy").agg(*[F.expr(a) for a in aggs])


def run_summary(pred: DataFrame, keys=None, cells: DataFrame | None = None, extra: dict[str, str] | None = None,
                one: str | None = None) -> DataFrame:
    """One flat row per run and strategy: counts, accuracy, P/R/F1, macro F1, and ``extra``
    aggregates (name -> SQL) of the cells.

    Classes a strategy does not score are null (A exports Attack only, B
    Attack and Support).  Accuracy is null when no row is valid."""
    k = _keys(pred, keys) if cells is None else list(keys or [])
    if cells is None:
        cells = prediction_cells(pred, k)
    extra = extra or {}
    a = _cell_aggregates(cells, k, [f"{sql} AS {name}" for name, sql in extra.items()], one)
    out = [f"`{c}`" for c in k] + [
        "strategy", "n_evaluated", "n_rejected", "n_valid", "n_scored", "ground_truth_count_attack",
        "ground_truth_count_support", "ground_truth_count_no_relation", "predicted_count_attack",
        "predicted_count_support", "predicted_count_no_relation", "n_correct",
        "try_divide(n_correct, n_valid) AS accuracy"]
    f1s = {}
    for cls in _EVAL_CLASSES:
        c = _key(cls)
        prec = _ratio_sql(f"_tp_{c}", f"_tp_{c} + _fp_{c}")
        rec = _ratio_sql(f"_tp_{c}", f"_tp_{c} + _fn_{c}")
        f1s[cls] = _f1_sql(prec, rec)
        if cls in CLASS_KEYS:
            key = CLASS_KEYS[cls]
            letters = ", ".join(f"'{x.letter}'" for x in STRATEGIES.values() if cls in x.classes)
            on = f"strategy IN ({letters})"
            out += [f"CASE WHEN {on} THEN _tp_{c} END AS true_positive_{key}",
                    f"CASE WHEN {on} THEN _fp_{c} END AS false_positive_{key}",
                    f"CASE WHEN {on} THEN _fn_{c} END AS false_negative_{key}",
                    f"CASE WHEN {on} THEN _tn_{c} END AS true_negative_{key}",
                    f"CASE WHEN {on} THEN {prec} END AS precision_{key}",
                    f"CASE WHEN {on} THEN {rec} END AS recall_{key}",
                    f"CASE WHEN {on} THEN {f1s[cls]} END AS f1_score_{key}"]
    out.append(f"CASE WHEN strategy = 'A' THEN ({f1s[ATTACK]} + {f1s[NOT_ATTACK]}) / 2 "
               f"WHEN strategy = 'B' THEN ({f1s[ATTACK]} + {f1s[SUPPORT]}) / 2 "
               f"ELSE ({f1s[ATTACK]} + {f1s[SUPPORT]} + {f1s[NO_RELATION]}) / 3 END AS macro_f1")
    return a.selectExpr(*out, *extra)


def accuracy(pred: DataFrame, keys=None) -> DataFrame:
    """(n_correct, n_valid, accuracy, n_rejected) per run and strategy."""
    k = _keys(pred, keys)
    cells = prediction_cells(pred, k)
    v = F.col("valid")
    return (cells.groupBy(*k, "strategy")
            .agg(F.sum(F.when(v, F.col("n_correct")).otherwise(F.lit(0))).cast("long")
                 .alias("n_correct"),
                 _n_if(v).alias("n_valid"),
                 F.sum("n_rejected").cast("long").alias("n_rejected"))
            .withColumn("accuracy", F.try_divide(F.col("n_correct"), F.col("n_valid"))))


def _per_class(agg: DataFrame, k: list[str], fields, keep=()) -> DataFrame:
    """One row per run and class of its strategy, unfolded from the run's one
    aggregate row: no join, so the predictions are read once.

    ``fields`` maps a class to ``name -> expression`` over the aggregate's columns."""
    def row(cls: str, seq: int) -> str:
        parts = ", ".join(f"'{n}', {e}" for n, e in fields(cls).items())
        return f"named_struct('class', '{cls}', 'class_seq', {seq}, {parts})"
    return agg.selectExpr(*[f"`{c}`" for c in k], "strategy", *keep,
                          f"inline({_by_strategy(lambda x: [row(c, i) for i, c in enumerate(x)])})")


def _by_strategy(rows) -> str:
    """An array chosen by strategy; ``rows`` makes its elements from the strategy's
    classes.  Strategies with the same classes share one branch."""
    letters: dict[tuple, list[str]] = {}
    for s in STRATEGIES.values():
        letters.setdefault(tuple(s.classes), []).append(f"'{s.letter}'")
    return "CASE " + " ".join(f"WHEN strategy IN ({', '.join(x)}) THEN array({', '.join(rows(c))})"
                              for c, x in letters.items()) + " END"


def _counts_by(cells: DataFrame, k: list[str], label: str, name: str) -> DataFrame:
    agg = cells.groupBy(*k, "strategy").agg(
        *[F.expr(_n_if_sql(f"valid AND {label} = '{c}'")).alias(f"_{_key(c)}") for c in _EVAL_CLASSES])
    return _per_class(agg, k, lambda c: {name: f"_{_key(c)}"})


def gold_distribution(pred: DataFrame, keys=None) -> DataFrame:
    """Valid rows per true label, for each class of the strategy (0 when absent)."""
    k = _keys(pred, keys)
    cells = prediction_cells(pred, k).withColumn("_yt", y_true("strategy", "support"))
    return _counts_by(cells, k, "_yt", "n_gold")


def predicted_distribution(pred: DataFrame, keys=None) -> DataFrame:
    """Valid rows per predicted label (nulls left out), for each class of the strategy."""
    k = _keys(pred, keys)
    return _counts_by(prediction_cells(pred, k), k, "y_pred", "n_pred")


def predicted_flag_counts(pred: DataFrame, keys=None) -> DataFrame:
    """Sum of each flag per run, null as 0: a two-flag row counts twice."""
    k = _keys(pred, keys)
    return (pred.groupBy(*k, "strategy")
            .agg(F.sum(F.coalesce("pred_attack", F.lit(0))).cast("long").alias("predicted_count_attack"),
                 F.sum(F.coalesce("pred_support", F.lit(0))).cast("long").alias("predicted_count_support"),
                 F.sum(F.coalesce("pred_neither", F.lit(0))).cast("long")
                 .alias("predicted_count_no_relation")))


def confusion_matrix(pred: DataFrame, keys=None, wide: bool = False) -> DataFrame:
    """True x predicted counts over scored rows, every class pair of the strategy.

    Long form ``(keys, strategy, y_true, y_pred, n)``; ``wide=True`` pivots the
    predicted labels with an explicit value list (no extra distinct pass).
    Every class pair is a conditional sum of one aggregate, unfolded per strategy:
    the prediction rows are read once and nothing is joined."""
    k = _keys(pred, keys)
    cells = prediction_cells(pred, k).withColumn("_yt", y_true("strategy", "support"))
    agg = cells.groupBy(*k, "strategy").agg(
        *[F.expr(_n_if_sql(f"valid AND _yt = '{t}' AND y_pred = '{p}'")).alias(f"_{_key(t)}_{_key(p)}")
          for t in _EVAL_CLASSES for p in _EVAL_CLASSES])

    def pairs(classes) -> list[str]:
        return [f"named_struct('y_true', '{t}', 'true_seq', {i}, 'y_pred', '{p}', 'pred_seq', {j}, "
                f"'n', _{_key(t)}_{_key(p)})"
                for i, t in enumerate(classes) for j, p in enumerate(classes)]

    long = agg.selectExpr(*[f"`{c}`" for c in k], "strategy", f"inline({_by_strategy(pairs)})")
    if not wide:
        return long
    return (long.groupBy(*k, "strategy", "y_true", "true_seq")
            .pivot("y_pred", list(_EVAL_CLASSES)).agg(F.first("n")))


def class_metrics(pred: DataFrame, keys=None, cells: DataFrame | None = None) -> DataFrame:
    """TP, FP, FN, TN, precision, recall, F1 per run and class of the strategy,
    plus ``count_ok``: TP+FP+FN+TN equals the scored rows for every class."""
    k = _keys(pred, keys)
    cells = prediction_cells(pred, k) if cells is None else cells
    a = _cell_aggregates(cells, k)
    out = _per_class(a, k, lambda c: {p: f"_{p}_{_key(c)}" for p in ("tp", "fp", "fn", "tn")},
                     keep=("n_scored", "n_valid", "n_evaluated"))
    prec, rec = _ratio_sql("tp", "tp + fp"), _ratio_sql("tp", "tp + fn")
    return out.selectExpr("*", f"{prec} AS precision", f"{rec} AS recall",
                          f"{_f1_sql(prec, rec)} AS f1",
                          "(tp + fp + fn + tn) = n_scored AS count_ok")


def macro_f1(pred: DataFrame, keys=None) -> DataFrame:
    """Mean F1 over the strategy's classes (summed in class order, so the value
    is bit-identical to the summary's) and the count of skipped rows."""
    k = _keys(pred, keys)
    cells = prediction_cells(pred, k)
    cm = class_metrics(pred, k, cells=cells)
    ordered = F.array_sort(F.collect_list(F.struct("class_seq", "f1")))
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x["f1"])
    return cm.groupBy(*k, "strategy").agg(
        (total / F.count(F.lit(1))).alias("macro_f1"),
        F.max(F.col("n_valid") - F.col("n_scored")).alias("n_skipped"),
        F.max(F.col("n_evaluated") - F.col("n_valid")).alias("n_missing"))


def count_check(pred: DataFrame, keys=None) -> DataFrame:
    """Per run: does TP+FP+FN+TN equal the scored rows for every class?"""
    k = _keys(pred, keys)
    return (class_metrics(pred, k).groupBy(*k, "strategy")
            .agg(F.bool_and("count_ok").alias("all_sums_ok"),
                 F.max("n_scored").alias("n_scored")))


def valid_predictions(pred: DataFrame, keys=None) -> DataFrame:
    """Rows per run, rows whose needed flags are all present, rows dropped for a
    missing flag, and rows rejected for their gold code (``valid_rows`` and
    ``rejected_predictions`` give the rows)."""
    k = _keys(pred, keys)
    return (prediction_cells(pred, k).groupBy(*k, "strategy")
            .agg(F.sum("n").cast("long").alias("n_rows"),
                 _n_if(F.col("valid")).alias("n_valid"),
                 _n_if(~F.col("valid")).alias("n_dropped"),
                 F.sum("n_rejected").cast("long").alias("n_rejected")))


def strategies_present(pred: DataFrame) -> DataFrame:
    return pred.select("strategy").distinct().orderBy("strategy")
