"""Seeded shuffling, balanced few-shot sampling, exclusion, limits and batches.

Randomness is a seeded md5 order: ``md5(seed || '|' || pair_id)``.  The same
key in Spark and DuckDB gives the same multiset semantics as a random shuffle
and is reproducible.

Positions and selections from one histogram of keys
---------------------------------------------------
``ranked`` numbers every row 0..N-1 in key order, or the first rows of it:

1. one aggregate counts rows per (group, cell), a cell being the first digits
   of the key.  Their number is derived from the planner's size of the input, so
   that a cell holds about ``ROWS_PER_BUCKET`` rows; a wrong guess costs time only;
2. running sums over the cells give the rows before each cell: over the first
   three digits of a group (4,096 sums at most) and over the cells below each of these;
3. position = rows before the cell + row_number() inside the cell.

A quota or limit keeps the cells that start below it, and the rest of the rows
goes before any shuffle: the kept cells are broadcast, as there are never more of them than rows asked for.
The input is read twice, once for the histogram and once for the rows, which
are shuffled once; no task sorts more than a cell, however large or skewed a group
is.  Quotas of any size take this one path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42
#: Rows that a cell should hold: what one window task sorts.
ROWS_PER_BUCKET = 200_000
#: Digits whose running sums one window holds; digits where the planner can't tell the input's size.
TOP_DIGITS, UNKNOWN_DIGITS = 3, 4
#: Cells kept for a quota are broadcast up to this many rows asked for (24 bytes each), beyond it AQE decides.
BROADCAST_ROWS = 1_000_000
#: Not read any more (every quota takes one path); the name stays for callers that set it.
SMALL_QUOTA = 1000


def order_key(seed: int = DEFAULT_SEED, id_col: str = "pair_id") -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def key_digits(df: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hex digits of the key that split ``df`` into cells of about ``rows_per_bucket`` rows, by the planner's estimate."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= int(str(spark._jsparkSession.sessionState().conf().defaultSizeInBytes())):
        return UNKNOWN_DIGITS
    width = 8 + int(df._jdf.schema().defaultSize())
    return min(12, max(1, math.ceil(math.log(max(1.0, size / width / rows_per_bucket), 16))))


def _before_cells(cells: DataFrame, keys: list[str], digits: int) -> DataFrame:
    """Adds ``_before``: the rows of the group in earlier cells."""
    low = max(0, digits - TOP_DIGITS)
    cells = cells.withColumn("_top", F.expr(f"_cell div {16 ** low}L"))

    def sums(of: DataFrame, within: list[str], order: str) -> Column:
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(w), F.lit(0))

    if not low:
        return cells.withColumn("_before", sums(cells, keys, "_cell")).drop("_top")
    tops = cells.groupBy(*keys, "_top").agg(F.sum("_n").alias("_n"))
    tops = tops.select(*keys, "_top", sums(tops, keys, "_top").alias("_base"))
    inner = cells.withColumn("_in", sums(cells, [*keys, "_top"], "_cell"))
    return inner.join(tops, [*keys, "_top"]).withColumn("_before", F.col("_base") + F.col("_in")).drop("_top", "_base", "_in")


def ranked(df: DataFrame, key: Column, id_col: str, group_cols=(), pos_col: str = "pos", key_col: str = "shuffle_key",
           digits: int = 1, quota: Column | None = None, most: int | None = None, total: int | None = None) -> DataFrame:
    """Adds ``key_col`` and ``pos_col``, the 0-based position in key order, per group.

    With ``quota`` (a column over the group columns, at most ``most``; ``total`` over all groups)
    only the rows with a position below it stay.  ``digits`` 0 means that a group
    is known to fit one window task: no histogram is taken."""
    groups = list(group_cols)
    keyed = df.withColumn(key_col, key)
    if not groups:
        # One value for all rows, told from the key: a constant would be optimized away, and with it the partitioning.
        keyed = keyed.withColumn("_g", F.length(key_col) > 32)
    else:
        # Groups as texts without nulls: join and window then agree on one partitioning, and the rows are shuffled once.
        keyed = keyed.withColumns({f"_g{i}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for i, c in enumerate(groups)})
    gk = [f"_g{i}" for i in range(len(groups))] or ["_g"]
    if digits:
        keyed = keyed.withColumn("_cell", F.conv(F.substring(key_col, 1, digits), 16, 10).cast("long"))
        cells = _before_cells(keyed.groupBy(*gk, *groups, "_cell").agg(F.count(F.lit(1)).alias("_n")), gk, digits)
        if quota is not None:
            cells = cells.where(F.col("_before") < quota)
        cells = cells.select(*gk, "_cell", "_before")
        if total is not None and total <= BROADCAST_ROWS:
            cells = F.broadcast(cells)  # no more cells than rows asked for
        keyed = keyed.join(cells, [*gk, "_cell"])
    else:
        keyed = keyed.withColumn("_cell", F.lit(0)).withColumn("_before", F.lit(0).cast("long"))
    inner = Window.partitionBy(*gk, *(["_cell"] if digits else [])).orderBy(key_col, id_col)
    out = keyed.withColumn("_rn", F.row_number().over(inner))
    if quota is not None:
        # No cell gives more rows than the largest quota: with a literal bound Catalyst cuts each task's rows before the shuffle.
        out = out.where((F.col("_rn") <= most) & (F.col("_before") + F.col("_rn") <= quota))
    out = out.withColumn(pos_col, (F.col("_before") + F.col("_rn") - 1).cast("long"))
    return out.drop("_rn", "_cell", "_before", *gk)


def seeded_shuffle(df: DataFrame, seed: int = DEFAULT_SEED, id_col: str = "pair_id",
                   group_cols=(), pos_col: str = "pos", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``pos`` (0-based position in seeded random order, per group) and
    ``shuffle_key``."""
    return ranked(df, order_key(seed, id_col), id_col, group_cols, pos_col, digits=key_digits(df, rows_per_bucket))


def class_quotas(n: int, classes) -> dict:
    """n split evenly over the classes, the remainder to the first classes."""
    classes = list(classes)
    per, rem = divmod(n, len(classes))
    return {c: per + (1 if i < rem else 0) for i, c in enumerate(classes)}


def eligible_pool(df: DataFrame, classes, class_col: str = "support") -> DataFrame:
    return df.filter(F.col(class_col).isin(list(classes)))


def _numbered_examples(picked: DataFrame, n: int, id_col: str, group_cols=()) -> DataFrame:
    """Adds ``example_seq``, the 1-based order of at most ``n`` examples (per group)."""
    digits = 0 if n <= ROWS_PER_BUCKET else math.ceil(math.log(n / ROWS_PER_BUCKET, 16))
    key = F.md5(F.concat_ws("|", F.lit("fs"), F.col("shuffle_key")))
    if not digits and not group_cols:
        # The limit drops nothing, but tells the planner how few rows a sample has (an exclusion then broadcasts it).
        few = picked.withColumn("_fs", key).orderBy("_fs", id_col).limit(n)
        return few.withColumn("example_seq", F.row_number().over(Window.orderBy("_fs", id_col)).cast("long")).drop("_fs")
    out = ranked(picked, key, id_col, group_cols, "_seq", "_fs", digits)
    return out.withColumn("example_seq", (F.col("_seq") + 1).cast("long")).drop("_seq", "_fs")


def stratified_sample(df: DataFrame, n: int, classes, seed: int = DEFAULT_SEED,
                      id_col: str = "pair_id", class_col: str = "support") -> DataFrame:
    """n rows balanced over ``classes`` (at most what a class has), in seeded
    order; adds ``shuffle_key`` and ``example_seq`` (1-based order of the examples).

    The histogram of a class tells the key at which its quota ends; rows beyond go before the shuffle."""
    quotas = {c: q for c, q in class_quotas(max(n, 0), classes).items() if q > 0}
    pool = eligible_pool(df, quotas.keys(), class_col) if quotas else df.where("false")
    quota = F.lit(0)
    for c, q in quotas.items():
        quota = F.when(F.col(class_col) == c, F.lit(q)).otherwise(quota)
    picked = ranked(pool, order_key(seed, id_col), id_col, [class_col], "_pos", digits=key_digits(pool),
                    quota=quota, most=max(quotas.values(), default=1), total=sum(quotas.values()))
    return _numbered_examples(picked.drop("_pos"), sum(quotas.values()), id_col)


def stratified_sample_by(df: DataFrame, n_by_group: dict, pools: dict, group_col: str = "strategy",
                         seed: int = DEFAULT_SEED, id_col: str = "pair_id",
                         class_col: str = "support") -> DataFrame:
    """``stratified_sample`` for several groups (e.g. strategies) in one plan:
    each group has its own n and class pool; histogram, cut-off and order are per
    (group, class)."""
    quota, all_quotas = F.lit(0), []
    for g, n in n_by_group.items():
        for c, q in class_quotas(n, pools[g]).items():
            all_quotas.append(q)
            quota = F.when((F.col(group_col) == g) & (F.col(class_col) == c), F.lit(q)).otherwise(quota)
    pool = df.filter(quota > 0)
    picked = ranked(pool, order_key(seed, id_col), id_col, [group_col, class_col], "_pos", digits=key_digits(pool),
                    quota=quota, most=max([1, *all_quotas]), total=sum(all_quotas))
    return _numbered_examples(picked.drop("_pos"), max(n_by_group.values(), default=0), id_col, [group_col])


def union_class_samples(df: DataFrame, n: int, classes, seed: int = DEFAULT_SEED,
                        id_col: str = "pair_id", class_col: str = "support") -> DataFrame:
    """Per-class samples concatenated with unionByName: equivalent to
    ``stratified_sample`` (kept as the explicit form of that equivalence)."""
    parts = []
    for c, q in class_quotas(n, classes).items():
        if q <= 0:
            continue
        one = df.filter(F.col(class_col) == c).withColumn("shuffle_key", order_key(seed, id_col))
        parts.append(one.orderBy("shuffle_key", id_col).limit(q))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exclude_few_shot(df: DataFrame, few_shot: DataFrame, id_col: str = "pair_id",
                     group_cols=()) -> DataFrame:
    """Evaluation rows = all rows minus the sampled examples (per group when
    ``group_cols`` is given).  The sample's size is the caller's choice, so
    the join is left to AQE, which broadcasts a side only below the threshold."""
    keys = list(group_cols) + [id_col]
    return df.join(few_shot.select(*keys), keys, "left_anti")


def limit_sample(df: DataFrame, limit: int | None, seed: int = DEFAULT_SEED,
                 id_col: str = "pair_id", pos_col: str = "pos", group_cols=()) -> DataFrame:
    """First ``limit`` rows in seeded order (all rows when limit is None), with
    their 0-based position (per group when ``group_cols`` is given).  The
    histogram tells the key at which the limit is reached; rows beyond go before the shuffle."""
    if limit is None:
        return seeded_shuffle(df, seed, id_col, group_cols=group_cols, pos_col=pos_col)
    # The number of groups isn't known: their kept cells are broadcast without groups only.
    return ranked(df, order_key(seed, id_col), id_col, group_cols, pos_col, digits=key_digits(df), quota=F.lit(limit),
                  most=max(limit, 1), total=None if group_cols else limit)


def assign_batches(df: DataFrame, batch_size: int, pos_col: str = "pos") -> DataFrame:
    """Consecutive groups of ``batch_size`` in position order; the last one is short.
    ``item_pos`` is the 0-based place inside the batch."""
    return df.withColumns({
        "batch_id": F.floor(F.col(pos_col) / batch_size).cast("long"),
        "item_pos": (F.col(pos_col) % batch_size).cast("int"),
    })
