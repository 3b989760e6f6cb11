"""fx_replies: model replies built from fx_predictions, bent by batch_id % 10.

Batches of 10 per run in seeded order; the reply is the JSON array of the
rows' flags in item order, bent by ``batch_id % 10``: 0 one item short, 1 in a
code fence, 2 prose on both sides, 3 cut off mid-object, 4 no array, 5 values as
strings, 6 one null value, 7 one item too many, 8 and 9 plain.

The Spark builder numbers rows per run with the bucketed ``seeded_shuffle``
(never a window over a whole run); the DuckDB text uses a plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relscope.operators import sampling
from relscope.plans import fixtures as fx

BATCH = 10
# The bent reply wrappers.
PROSE_BEFORE = "Here are the labels: "
PROSE_AFTER = " Let me know if you need more."
NO_ARRAY_TEXT = "I am not able to classify these pairs."
CUT_CHARS = 6


def _val(c: Column, quoted: bool) -> Column:
    v = c.cast("string")
    return F.concat(F.lit('"'), v, F.lit('"')) if quoted else v


def _item(quoted: bool, null_attack: Column | None = None) -> Column:
    s = F.col("strategy")
    a = _val(F.coalesce("pred_attack", F.lit(0)), quoted)
    if null_attack is not None:
        a = F.when(null_attack, F.lit("null")).otherwise(a)
    sup = _val(F.coalesce("pred_support", F.lit(0)), quoted)
    nei = _val(F.coalesce("pred_neither", F.lit(0)), quoted)
    rel = _val(F.coalesce("pred_relevance", F.lit(0.0)), quoted)
    return F.concat(
        F.lit('{"attack": '), a,
        F.when(s != "A", F.concat(F.lit(', "support": '), sup)).otherwise(F.lit("")),
        F.when(s.isin("C", "D"), F.concat(F.lit(', "neither": '), nei)).otherwise(F.lit("")),
        F.when(s == "D", F.concat(F.lit(', "relevance": '), rel)).otherwise(F.lit("")),
        F.lit("}"))


def batched_predictions(spark, sf_dir) -> DataFrame:
    pred = fx.predictions(spark, sf_dir)
    pos = sampling.seeded_shuffle(pred, group_cols=["run_id"])
    return sampling.assign_batches(pos, BATCH)


def build(spark, sf_dir, batched: DataFrame | None = None) -> DataFrame:
    """(run_id, strategy, batch_id, n_expected, reply)."""
    b = batched if batched is not None else batched_predictions(spark, sf_dir)
    items = b.select("run_id", "strategy", "batch_id", "item_pos",
                     _item(False).alias("it"), _item(True).alias("it_s"),
                     _item(False, F.col("item_pos") == 0).alias("it_n"))
    parts = F.array_sort(F.collect_list(F.struct("item_pos", "it", "it_s", "it_n")))
    g = items.groupBy("run_id", "strategy", "batch_id").agg(
        F.count(F.lit(1)).alias("n_expected"), parts.alias("p"))
    its = F.transform("p", lambda x: x["it"])

    def arr(a: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))

    plain = arr(its)
    bend = F.col("batch_id") % 10
    reply = (F.when(bend == 0, arr(F.slice(its, 1, F.size(its) - 1)))
             .when(bend == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
             .when(bend == 2, F.concat(F.lit(PROSE_BEFORE), plain, F.lit(PROSE_AFTER)))
             .when(bend == 3, F.expr(f"substring(__plain, 1, length(__plain) - {CUT_CHARS})"))
             .when(bend == 4, F.lit(NO_ARRAY_TEXT))
             .when(bend == 5, arr(F.transform("p", lambda x: x["it_s"])))
             .when(bend == 6, arr(F.transform("p", lambda x: x["it_n"])))
             .when(bend == 7, arr(F.concat(its, F.array(F.element_at(its, -1)))))
             .otherwise(plain))
    return (g.withColumn("__plain", plain)
            .select("run_id", "strategy", "batch_id", "n_expected", reply.alias("reply")))


def _sql_item(quoted: bool, null_first: bool = False) -> str:
    def v(c, dflt):
        e = f"CAST(coalesce({c}, {dflt}) AS STRING)"
        return f"'\"' || {e} || '\"'" if quoted else e
    a = v("pred_attack", "0")
    if null_first:
        a = f"CASE WHEN item_pos = 0 THEN 'null' ELSE {a} END"
    return ("'{\"attack\": ' || " + a
            + " || CASE WHEN strategy <> 'A' THEN ', \"support\": ' || " + v("pred_support", "0") + " ELSE '' END"
            + " || CASE WHEN strategy IN ('C', 'D') THEN ', \"neither\": ' || " + v("pred_neither", "0") + " ELSE '' END"
            + " || CASE WHEN strategy = 'D' THEN ', \"relevance\": ' || "
            + v("pred_relevance", "CAST(0.0 AS DOUBLE)") + " ELSE '' END || '}'")


def oracle_ctes() -> dict[str, str]:
    """DuckDB text of fx_replies (plain per-run window numbering)."""
    return {
        "fxr_pos": """
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY md5(concat_ws('|', '42', pair_id)), pair_id) - 1 AS pos
  FROM fx_predictions""",
        "fxr_items": f"""
  SELECT run_id, strategy, pair_id, CAST(floor(pos / {BATCH}) AS BIGINT) AS batch_id,
         CAST(pos % {BATCH} AS INTEGER) AS item_pos, pred_attack, pred_support, pred_neither,
         pred_relevance
  FROM fxr_pos""",
        "fxr_txt": f"""
  SELECT run_id, strategy, batch_id, item_pos, {_sql_item(False)} AS it, {_sql_item(True)} AS it_s,
         {_sql_item(False, True)} AS it_n,
         max(item_pos) OVER (PARTITION BY run_id, batch_id) AS mx
  FROM fxr_items""",
        "fxr_b": """
  SELECT run_id, strategy, batch_id, count(*) AS n_expected,
         '[' || string_agg(it, ', ' ORDER BY item_pos) || ']' AS plain,
         '[' || coalesce(string_agg(it, ', ' ORDER BY item_pos) FILTER (WHERE item_pos < mx), '') || ']' AS short,
         '[' || string_agg(it_s, ', ' ORDER BY item_pos) || ']' AS strs,
         '[' || string_agg(it_n, ', ' ORDER BY item_pos) || ']' AS nulled,
         '[' || string_agg(it, ', ' ORDER BY item_pos) || ', ' || max_by(it, item_pos) || ']' AS extra
  FROM fxr_txt GROUP BY run_id, strategy, batch_id""",
        "fx_replies": f"""
  SELECT run_id, strategy, batch_id, n_expected,
         CASE batch_id % 10
           WHEN 0 THEN short
           WHEN 1 THEN '```json' || chr(10) || plain || chr(10) || '```'
           WHEN 2 THEN '{PROSE_BEFORE}' || plain || '{PROSE_AFTER}'
           WHEN 3 THEN substr(plain, 1, length(plain) - {CUT_CHARS})
           WHEN 4 THEN '{NO_ARRAY_TEXT}'
           WHEN 5 THEN strs
           WHEN 6 THEN nulled
           WHEN 7 THEN extra
           ELSE plain END AS reply
  FROM fxr_b""",
    }
