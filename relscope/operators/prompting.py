"""Prompts per batch: few-shot block + numbered pairs + template, all JVM-side.

Grouping by batch collects at most ``batch_size`` pairs per group, and the
few-shot block is one row per strategy (built from a sample whose size is a
parameter), joined on the strategy key as the broadcast side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relscope.functions import prompts as P
from relscope.schema import STRATEGIES


def few_shot_block(sample: DataFrame | None, strategy: str, relevance_col: str | None = None,
                   class_col: str = "support") -> DataFrame:
    """One row ``(strategy, n_examples, few_shot_block)``; empty block when zero-shot.

    Strategy D needs a relevance per example; without one the run is zero-shot
    (the sampled rows still leave the evaluation set)."""
    spark = sample.sparkSession if sample is not None else None
    if sample is None or (strategy == "D" and (relevance_col is None
                                               or relevance_col not in sample.columns)):
        base = sample if sample is not None else spark.range(0)
        return base.limit(1).select(F.lit(strategy).alias("strategy"),
                                    F.lit(0).cast("long").alias("n_examples"),
                                    F.lit("").alias("few_shot_block"))
    rel = F.col(relevance_col) if strategy == "D" else None
    ans = P.format_answer(strategy, F.col(class_col), rel)
    ex = P.format_example(F.col("example_seq"), F.col("arg1"), F.col("arg2"), ans)
    agg = sample.agg(F.count(F.lit(1)).alias("n_examples"),
                     P.ordered_join(ex, F.col("example_seq"), "\n\n").alias("_examples"))
    block = F.when(F.col("n_examples") > 0, F.concat(
        F.format_string(P.FEW_SHOT_HEADER, F.col("n_examples")), F.lit("\n\n"),
        F.col("_examples"), F.lit("\n\n"), F.lit(P.FEW_SHOT_FOOTER))).otherwise(F.lit(""))
    return agg.select(F.lit(strategy).alias("strategy"), "n_examples",
                      block.alias("few_shot_block"))


def few_shot_blocks(sample: DataFrame, strategies, relevance_col: str | None = None,
                    class_col: str = "support") -> DataFrame:
    """``few_shot_block`` for several strategies in one aggregation over a
    sample carrying a ``strategy`` column; every listed strategy gets a row
    (zero-shot ones an empty block).  D without a relevance column is zero-shot."""
    from relscope.session import values_frame
    letters = list(strategies)
    has_rel = relevance_col is not None and relevance_col in sample.columns
    rel = F.col(relevance_col) if has_rel else F.lit(None).cast("double")
    ans = F.lit(None).cast("string")
    for s in letters:
        ans = F.when(F.col("strategy") == s, P.format_answer(s, F.col(class_col), rel)).otherwise(ans)
    ex = P.format_example(F.col("example_seq"), F.col("arg1"), F.col("arg2"), ans)
    usable = sample if has_rel else sample.filter(F.col("strategy") != "D")
    agg = usable.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_examples"),
        P.ordered_join(ex, F.col("example_seq"), "\n\n").alias("_examples"))
    block = F.concat(F.format_string(P.FEW_SHOT_HEADER, F.col("n_examples")), F.lit("\n\n"),
                     F.col("_examples"), F.lit("\n\n"), F.lit(P.FEW_SHOT_FOOTER))
    names = values_frame(sample.sparkSession, [(s,) for s in letters], "strategy string")
    return (names.join(agg, "strategy", "left")   # <= 4 strategies on the left
            .select("strategy", F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
                    F.coalesce(block, F.lit("")).alias("few_shot_block")))


def format_pairs(batched: DataFrame, keys=("strategy", "batch_id"), member_cols=()) -> DataFrame:
    """Per batch: the numbered pairs block and the item count; with
    ``member_cols``, also ``members`` = the batch's rows (item_pos + those
    columns) in order, so replies can later be attached without a join."""
    keys = [k for k in keys if k in batched.columns]
    item = P.format_pair(F.col("item_pos"), F.col("arg1"), F.col("arg2"))
    aggs = [P.ordered_join(item, F.col("item_pos"), "\n\n").alias("pairs_block"),
            F.count(F.lit(1)).alias("n_items")]
    if member_cols:
        aggs.append(F.array_sort(F.collect_list(F.struct("item_pos", *member_cols))).alias("members"))
    return batched.groupBy(*keys).agg(*aggs)


def build_prompts(batched: DataFrame, blocks: DataFrame | None = None, member_cols=()) -> DataFrame:
    """``(strategy, batch_id, n_items, prompt[, members, few_shot_n])`` for every batch;
    ``few_shot_n`` is the number of examples the prompt has.

    ``batched`` has strategy, batch_id, item_pos, arg1, arg2; ``blocks`` has
    one few-shot row per strategy (or is None for zero-shot everywhere)."""
    pairs = format_pairs(batched, member_cols=member_cols)
    if blocks is not None:
        pairs = pairs.join(F.broadcast(blocks.select("strategy", "few_shot_block", F.col("n_examples").alias("few_shot_n"))),
                           "strategy", "left")  # <= 4 rows: one per strategy
    else:
        pairs = pairs.withColumn("few_shot_block", F.lit("")).withColumn("few_shot_n", F.lit(0).cast("long"))
    fsb, pb, n = F.col("few_shot_block"), F.col("pairs_block"), F.col("n_items")
    expr = F.lit(None).cast("string")
    for letter in sorted(STRATEGIES, reverse=True):
        expr = F.when(F.col("strategy") == letter, P.prompt(letter, fsb, pb, n)).otherwise(expr)
    extra = ["members", "few_shot_n"] if member_cols else []
    return pairs.select("strategy", "batch_id", "n_items", expr.alias("prompt"), *extra)
