"""Human labels against gold: the same scoring machinery as model runs.

A human label is a three-class prediction with exactly one flag set, so the
pair (gold, human) is recast as a strategy-C prediction and scored by
``run_summary`` / ``confusion_matrix``: accuracy is then exact agreement and
macro F1 is over all three classes, as for the model runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relscope.operators import scoring
from relscope.schema import FLAG_COLS


def as_predictions(df: DataFrame, gold: str = "gold", human: str = "human", keys=()) -> DataFrame:
    """Rows with both labels present, as a strategy-C prediction frame."""
    keys = list(keys)
    h = F.col(human).cast("long")
    d = df.filter(F.col(gold).isNotNull() & F.col(human).isNotNull())
    return d.select(*keys, F.lit("C").alias("strategy"), F.col(gold).cast("long").alias("support"),
                    (h == 0).cast("int").alias("pred_attack"),
                    (h == 1).cast("int").alias("pred_support"),
                    (h == 2).cast("int").alias("pred_neither"))


def human_agreement(df: DataFrame, gold: str = "gold", human: str = "human", keys=()) -> DataFrame:
    """Label distributions, confusion totals, P/R/F1, macro F1 and accuracy of
    human vs gold.  Counted beside them: rows with a missing value (``n_dropped``),
    complete rows whose gold (``n_rejected``) or human code (``n_human_rejected``)
    is none of the three.  The counts are there even if no row is complete, the metrics
    are null then.

    One scan: rows are counted by their two labels, and everything is a sum over these few counts."""
    keys = list(keys)
    h = F.col("_human")
    raw = df.groupBy(*keys, F.col(gold).cast("long").alias("support"), F.col(human).cast("long").alias("_human")).agg(F.count(F.lit(1)).alias("_all"))
    both = F.col("support").isNotNull() & h.isNotNull()
    raw = raw.select(*keys, F.lit("C").alias("strategy"), "support", "_human", "_all", both.alias("_both"),
                     F.when(both, F.col("_all")).otherwise(F.lit(0)).alias("_rows"),
                     *[(h == code).cast("int").alias(flag) for code, flag in enumerate(FLAG_COLS)])
    cells = scoring.label_cells(raw, keys, ("_human", "_all", "_both"))

    def count(cond: str) -> str:
        return f"CAST(coalesce(sum(CASE WHEN {cond} THEN _all ELSE 0 END), 0) AS BIGINT)"

    counts = {"n_dropped": count("NOT _both"), "n_human_rejected": count("support IS NOT NULL AND _human NOT IN (0, 1, 2)"),
              "human_count_attack": count("_human = 0"), "human_count_support": count("_human = 1"),
              "human_count_no_relation": count("_human = 2"), "_complete": count("_both")}
    summ = scoring.run_summary(cells, keys=keys, cells=cells, extra=counts, one="C")
    summ = summ.drop("strategy", "n_valid", "n_scored", "predicted_count_attack",
                     "predicted_count_support", "predicted_count_no_relation").withColumnRenamed("n_evaluated", "n")
    always = [*keys, "n", "n_rejected", *counts]
    told = [F.col(c) if c in always else F.when(F.col("_complete") > 0, F.col(c)).alias(c) for c in summ.columns if c != "_complete"]
    return summ.select(*told).fillna(0, subset=["n", "n_rejected"])


def human_confusion(df: DataFrame, gold: str = "gold", human: str = "human", keys=()) -> DataFrame:
    return scoring.confusion_matrix(as_predictions(df, gold, human, keys), keys=list(keys))
