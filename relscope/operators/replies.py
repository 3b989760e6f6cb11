"""Parse model replies per batch and attach the decoded items to their pairs.

Every step is per batch (a reply holds at most ``batch_size`` items), so the
work is row-local: ``posexplode`` of a bounded array, then an equi-join back to
the pairs on ``(keys, batch_id, item_pos)`` -- a left join, so the pairs of a
failed batch keep null predictions, as the reference does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relscope.functions import replies as R
from relscope.schema import STRATEGIES

_FLAG_KEYS = R.FLAG_KEYS


def parse_replies(replies: DataFrame, keys=("strategy", "batch_id")) -> DataFrame:
    """Per batch: extracted array, item count and ``parse_status``.

    ``replies`` has the batch keys, ``n_expected`` and ``reply`` (null when the
    call failed)."""
    keys = [k for k in keys if k in replies.columns]
    arr = R.extract_json_array(F.col("reply"))
    items = F.transform(R.json_items(F.col("array_text")), R.parse_item)
    d = replies.withColumn("array_text", arr).withColumn("_items", items)
    is_d = (F.col("strategy") == "D") if "strategy" in replies.columns else F.lit(True)
    bad_any = F.exists(F.col("_items"), lambda it: R.item_bad(it, is_d))
    status = (F.when(F.col("reply").isNull(), F.lit(R.STATUS_CALL_FAILED))
              .when(F.col("array_text").isNull(), F.lit(R.STATUS_NO_ARRAY))
              .when(F.col("_items").isNull(), F.lit(R.STATUS_BAD_JSON))
              .when(F.size("_items") != F.col("n_expected"), F.lit(R.STATUS_WRONG_COUNT))
              .when(bad_any, F.lit(R.STATUS_BAD_VALUE))
              .otherwise(F.lit(R.STATUS_OK)))
    return d.select(*keys, "n_expected", "array_text",
                    F.when(F.col("_items").isNotNull(), F.size("_items")).cast("long").alias("n_items_reply"),
                    status.alias("parse_status"), F.col("_items").alias("items"))


def decode_predictions(parsed: DataFrame, keys=("strategy", "batch_id")) -> DataFrame:
    """One row per item of an ``ok`` batch: nullable int flags and, for D, the
    relevance (kept as given; ``off_rubric`` marks values outside the rubric)."""
    from relscope.schema import RUBRIC
    keys = [k for k in keys if k in parsed.columns]
    ok = parsed.filter(F.col("parse_status") == R.STATUS_OK)
    ex = ok.select(*keys, F.posexplode("items").alias("item_pos", "item"))
    s = F.col("strategy") if "strategy" in keys else F.lit("D")
    # Every flag key present is decoded, whatever the strategy asked for.
    out = ex.select(*keys, F.col("item_pos").cast("int").alias("item_pos"),
                    *_decoded_cols(F.col("item"), s))
    rel = F.col("pred_relevance")
    return out.withColumn("off_rubric", rel.isNotNull() & ~rel.isin(*RUBRIC))


def _decoded_cols(item, strategy):
    """Flags and relevance from a parsed item (struct of keys and text fields)."""
    cols = [R.decode_flag(item["f"][k]).alias(f"pred_{k}") for k in _FLAG_KEYS]
    rel = F.when(strategy == "D", R.decode_relevance(item["f"]["relevance"]))
    return cols + [rel.alias("pred_relevance")]


def attach_replies(batched: DataFrame, parsed: DataFrame, keys=("strategy", "batch_id")) -> DataFrame:
    """Item *i* of a reply belongs to row *i* of its batch.

    One left join of the pair rows with the per-batch parse result (a batch
    row holds at most ``batch_size`` items); the item is then picked by
    position, so the pairs of a failed batch keep their rows with null flags."""
    keys = [k for k in keys if k in batched.columns and k in parsed.columns]
    j = batched.join(parsed.select(*keys, "parse_status", "items"), keys, "left")
    ok = F.col("parse_status") == R.STATUS_OK
    item = F.when(ok, F.try_element_at(F.col("items"), F.col("item_pos") + 1))
    s = F.col("strategy") if "strategy" in j.columns else F.lit("D")
    return j.select(*batched.columns, *_decoded_cols(item, s), "parse_status")


def explode_replies(parsed: DataFrame, members: str = "members") -> DataFrame:
    """Row-local attach for batch rows that carry their members
    (``array<struct<item_pos, pair_id, ...>>``): one output row per member with
    its decoded item -- no join, no shuffle.  Failed batches keep their rows."""
    keep = [c for c in parsed.columns if c not in (members, "items", "array_text", "reply")]
    ex = parsed.select(*keep, "items", F.explode(members).alias("_m"))
    ok = F.col("parse_status") == R.STATUS_OK
    item = F.when(ok, F.try_element_at(F.col("items"), F.col("_m.item_pos") + 1))
    s = F.col("strategy") if "strategy" in keep else F.lit("D")
    return ex.select(*keep, "_m.*", *_decoded_cols(item, s)).drop("items")


def batch_failures(parsed: DataFrame, keys=("strategy",)) -> DataFrame:
    """Batches and rows (expected items) per parse status."""
    keys = [k for k in keys if k in parsed.columns]
    return (parsed.groupBy(*keys, "parse_status")
            .agg(F.count(F.lit(1)).alias("n_batches"),
                 F.sum("n_expected").cast("long").alias("n_rows")))


def strategy_keys(letter: str) -> tuple[str, ...]:
    return STRATEGIES[letter].reply_keys
