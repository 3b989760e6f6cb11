"""Row identity by content: the same rows get the same ids, however their files are cut, named or ordered.

``pair_id`` is a hash of the row's own content and, for the second and later
of equal rows, the number of equal rows before it.  Equal rows are
interchangeable, so rewriting, compacting or renaming files changes no id and
with it no seeded order, sample, batch or prompt.

Only equal rows need numbers, and only their hashes travel: rows are counted by
(content, file, block of positions), running sums over a content's blocks give
each block's first number, and rows are numbered within their block.  A content
that a third of all rows share is dealt over all its blocks.  The numbers of
extra copies meet the rows by place; without many copies that table is small
and AQE broadcasts it, so the texts aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a file that are numbered together, the most rows one window task sorts of a content.
BLOCK = 65_536


def content_hash(*columns: str) -> Column:
    """Hash of the columns' values, told apart from nulls and from each other by their lengths."""
    told = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told), 256)


def content_ids(df: DataFrame, columns, file: str = "_file", row: str = "_row", id_col: str = "pair_id", block: int = BLOCK) -> DataFrame:
    """Adds ``id_col``: content hash, and ``#k`` for the k-th extra copy.  ``file`` and ``row`` name a row's place
    (they are unique and stay the same within the run)."""
    d = df.withColumn("_content", content_hash(*columns))
    places = d.select("_content", F.col(file).alias("_f"), F.col(row).alias("_r"), F.expr(f"`{row}` div {block}").alias("_b"))
    key = ["_content", "_f", "_b"]
    counts = places.groupBy(*key).agg(F.count("*").alias("_n"))
    of_content = Window.partitionBy("_content")
    before = F.sum("_n").over(of_content.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_total", F.sum("_n").over(of_content))
    copies = places.join(counts.where("_total > 1").select(*key, "_before"), key)
    number = F.col("_before") + F.row_number().over(Window.partitionBy(*key).orderBy("_r")) - 1
    extra = copies.select("_f", "_r", number.alias("_copy")).where("_copy > 0")
    out = d.join(extra, (d[file] == extra["_f"]) & (d[row] == extra["_r"]), "left")
    told = F.concat(F.col("_content"), F.when(F.col("_copy").isNotNull(), F.concat(F.lit("#"), F.col("_copy").cast("string"))).otherwise(F.lit("")))
    return out.withColumn(id_col, told).drop("_content", "_f", "_r", "_copy")
