"""Agreement between numeric ratings (model relevance vs human labelers).

All comparisons run as one aggregation: the rows are unpivoted to
``(keys, comparison, a, b)`` inside the scan stage (no shuffle), each
comparison drops only its own null pairs, and one ``groupBy`` with partial
aggregation computes n, MAE, RMSE, L2, means, population stds and Pearson r.
The p-value of r is computed afterwards on the aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relscope.functions.stats import nan_to_null, pearson_p

METRIC_COLS = ("n", "mae", "rmse", "l2_distance", "pearson_r", "pearson_p",
               "a_mean", "b_mean", "a_std", "b_std")


def _agg_exprs() -> list[Column]:
    a, b = F.col("a"), F.col("b")
    d = a - b
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.sqrt(F.sum(d * d)).alias("l2_distance"),
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("pearson_r"),
        F.avg(a).alias("a_mean"),
        F.avg(b).alias("b_mean"),
        F.stddev_pop(a).alias("a_std"),
        F.stddev_pop(b).alias("b_std"),
    ]


def _finish(agg: DataFrame, keys: list[str], round_to: int | None) -> DataFrame:
    from relscope.session import ship_package
    ship_package(agg.sparkSession)
    out = agg.withColumn("pearson_p", nan_to_null(pearson_p(F.col("pearson_r"), F.col("n"))))
    cols = [F.col(k) for k in keys]
    for c in METRIC_COLS:
        e = F.col(c)
        if round_to is not None and c != "n":
            # float sums depend on row order; p is a tail probability (keep 6)
            e = F.round(e, min(round_to, 6) if c == "pearson_p" else round_to)
        cols.append(e.alias(c))
    return out.select(*cols)


def rating_agreement(df: DataFrame, a: str, b: str, keys=(), round_to: int | None = None) -> DataFrame:
    """n, MAE, RMSE, L2, Pearson r and p, means and population stds of two
    rating columns over the rows where both are present."""
    keys = list(keys)
    d = df.select(*keys, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    d = d.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return _finish(d.groupBy(*keys).agg(*_agg_exprs()), keys, round_to)


def rating_correlation(df: DataFrame, a: str, b: str, keys=(), round_to: int | None = None) -> DataFrame:
    """Pearson r with its two-sided p (Student t, n-2 dof); null on constant input."""
    return rating_agreement(df, a, b, keys, round_to).select(*keys, "n", "pearson_r", "pearson_p")


# The four comparisons reported for relevance ratings.
COMPARISONS = ("model_vs_h1", "model_vs_h2", "h1_vs_h2", "model_vs_mean")


def rating_agreement_all(df: DataFrame, model: str = "pred_relevance", h1: str = "h1",
                         h2: str | None = "h2", keys=(), round_to: int | None = None) -> DataFrame:
    """Model vs labeler 1, model vs labeler 2, labeler 1 vs 2, model vs mean of
    both; each drops nulls only in its own columns.  Comparisons without a
    single complete pair produce no row."""
    keys = list(keys)
    m, x = F.col(model).cast("double"), F.col(h1).cast("double")
    pairs = [("model_vs_h1", m, x)]
    if h2 is not None and h2 in df.columns:
        y = F.col(h2).cast("double")
        mean = F.when(x.isNotNull() & y.isNotNull(), (x + y) / 2)
        pairs += [("model_vs_h2", m, y), ("h1_vs_h2", x, y), ("model_vs_mean", m, mean)]
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(name).alias("comparison"), a.alias("a"), b.alias("b"))
        for name, a, b in pairs])))
    long = long.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    k = keys + ["comparison"]
    return _finish(long.groupBy(*k).agg(*_agg_exprs()), k, round_to)


def attach_labels(pred: DataFrame, labels: DataFrame, key: str = "orig_idx",
                  cols=("h1", "h2")) -> DataFrame:
    """Bring human labels to the predictions by key (not by row position).

    The label table holds one row per pair; it is joined by key, so Spark
    picks a broadcast or a shuffle join from its measured size (AQE)."""
    keep = [c for c in cols if c in labels.columns]
    drop = [c for c in keep if c in pred.columns]
    return pred.drop(*drop).join(labels.select(key, *keep), key, "left")
