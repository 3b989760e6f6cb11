"""Operator 1: mix sources to target weights.

The words of each source, in a pseudorandom order of its documents, form one
stream cut into blocks of ``block_words``.  Every output shard draws its source
counts from a multinomial; the n-th draw of a source becomes block
``permutation(n mod blocks)`` of pass ``n div blocks``; draws meet blocks by a
join on (source, block).

Defined cases: null or blank text has size 0 and is taken 0 times; a null
source is a source of its own, last in order; repeated rows count as separate
documents; a table without words takes nothing; very long texts span many
blocks; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relscope.llm.common import WORD, n_words, offsets, written

CAP = 3  # a document is taken this often at most
SEED = 42
#: The mixing plan (one row per source) is made on the driver; more sources than this is an error.
MAX_SOURCES = 100_000
ROWS_PER_BUCKET = 1_000
SHARDS_PER_TASK = 64


def source_targets(sizes: list[int], weights: list[float], total: float, cap: int = CAP) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size: the excess goes by weight to the rest."""
    out, rest, weight = [0.0] * len(sizes), float(total), float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i]):
        out[i] = min(float(cap * sizes[i]), rest * weights[i] / weight)
        rest, weight = rest - out[i], weight - weights[i]
    return out


def shard_counts(shard: int, slots: int, p: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Multinomial source counts of one shard.

    Whole expected slots are given outright and the rest drawn from the
    remaining fractions, which has the same mean and a far smaller spread.
    """
    want = slots * p
    counts = np.floor(want).astype(np.int64)
    rest = want - counts
    left = slots - int(counts.sum())
    if left > 0:
        rng = np.random.Generator(np.random.Philox(key=np.array([seed, shard], np.uint64)))
        counts += rng.multinomial(left, rest / rest.sum() if rest.sum() > 0 else p)
    return counts


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """``index`` under a pseudorandom permutation of range(n), one for each key: a Feistel
    network on the least even number of bits that holds n, repeated until inside the range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    bound, key = n.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(rounds):
            f = (right + k * np.uint64(2 * r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= bound[todo]]
    return x.astype(np.int64)


def _plan(sizes: DataFrame, block_words: int):
    """Per source: number, size, blocks, target, expected draws -- and the same as a small table."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: map them to fewer mixture components first")
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    n = [int(r.n) for r in rows]
    targets = source_targets(n, [1.0 + i % 3 for i in range(len(n))], sum(n)) if n else []
    plan = []
    for i, r in enumerate(rows):
        blocks = math.ceil(n[i] / block_words)
        plan.append({"src": i, "source": r.source, "source_size": n[i], "target": targets[i], "blocks": blocks,
                     "draws": targets[i] * blocks / n[i] if n[i] else 0.0})
    spark = sizes.sparkSession
    schema = "array<struct<src int, source string, source_size bigint, target double, blocks bigint>>"
    small = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), schema)))
    return plan, F.broadcast(small)  # at most MAX_SOURCES rows


def _placed(docs: DataFrame, block_words: int):
    """Documents with their source and first word in the source's stream."""
    sizes = written(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                                n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    plan, small = _plan(sizes, block_words)
    buckets = max(1, math.ceil(sizes.count() / ROWS_PER_BUCKET))
    order = F.xxhash64("doc_id", "size", "text_hash")
    placed = (sizes.withColumnRenamed("source", "_source").join(small, F.col("_source").eqNullSafe(F.col("source")))
              .drop("_source").withColumn("order", order)
              .withColumn("bucket", F.pmod(F.col("order"), F.lit(buckets))))
    parts = placed.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    parts = offsets(parts, "src", "bucket", "words").select(F.col("src").alias("_src"), F.col("bucket").alias("_bucket"), "before")
    w = Window.partitionBy("src", "bucket").orderBy("order", "doc_id", "size", "text_hash")
    placed = (placed.withColumn("nth", F.row_number().over(w))
              .withColumn("_in", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    placed = (placed.join(parts, (F.col("src") == F.col("_src")) & (F.col("bucket") == F.col("_bucket")))
              .withColumn("start", F.col("before") + F.col("_in")).drop("_src", "_bucket", "before", "_in", "order"))
    return plan, small, placed


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """One row per document and block it lies in (documents without words: one, without a block)."""
    b = F.lit(block_words)
    spanned = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block_words}"),
                                                   F.expr(f"(start + size - 1) div {block_words}")))
    p = placed.withColumn("block", F.explode_outer(spanned))
    first = F.greatest(F.col("start"), F.col("block") * b) - F.col("start")
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.col("start")
    return p.withColumn("first", first).withColumn("last", last)


def draws(spark, plan: list[dict], small: DataFrame, shard_slots: int = 4096, seed: int = SEED) -> DataFrame:
    """The mix's slots: (shard, src, nth draw of the source, pass, block)."""
    want = np.array([s["draws"] for s in plan], float)
    total = int(round(want.sum()))
    p = want / want.sum() if total else want
    shards = math.ceil(total / shard_slots)

    def count(batches):
        for pdf in batches:
            for shard in pdf["id"]:
                c = shard_counts(int(shard), int(min(shard_slots, total - shard * shard_slots)), p, seed)
                src = np.nonzero(c)[0]
                yield pd.DataFrame({"shard": np.full(len(src), shard), "src": src.astype(np.int32), "n": c[src]})

    @F.pandas_udf("long")
    def block(src: pd.Series, turn: pd.Series, index: pd.Series, blocks: pd.Series) -> pd.Series:
        key = (src.to_numpy(np.uint64) * np.uint64(8) + turn.to_numpy(np.uint64)) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(seed)
        return pd.Series(permuted(index.to_numpy(np.int64), blocks.to_numpy(np.int64), key))

    counts = spark.range(shards).mapInPandas(count, "shard long, src int, n long")
    counts = offsets(written(counts, "mix-counts"), "src", "shard", "n")
    # A few bytes of counts become many slots: dealt out by their number, which no size estimate sees.
    counts = counts.repartition(max(8, math.ceil(shards / SHARDS_PER_TASK)), "src", "shard")
    slots = (counts.withColumn("nth", F.explode(F.expr("sequence(before, before + n - 1)")))
             .join(small.select(F.col("src").alias("_src"), "blocks"), F.col("src") == F.col("_src")).drop("_src")
             .where(F.col("nth") < CAP * F.col("blocks"))
             .withColumn("turn", F.expr("nth div blocks")).withColumn("index", F.expr("nth % blocks")))
    return slots.select("shard", "src", "nth", "turn", block("src", "turn", "index", "blocks").alias("block"))


def mix_counts(docs: DataFrame, block_words: int = 64, shard_slots: int = 4096) -> DataFrame:
    """Per document: size, its source's size and target, and the words the mix takes of it."""
    plan, small, placed = _placed(docs, block_words)
    times = (draws(docs.sparkSession, plan, small, shard_slots).groupBy(F.col("src").alias("_src"), F.col("block").alias("_block"))
             .agg(F.count("*").alias("times")))
    p = _pieces(placed, block_words)
    # "merge": size estimates take the slots for as small as their counts, and would broadcast them.
    p = p.join(times.hint("merge"), (p["src"] == times["_src"]) & (p["block"] == times["_block"]), "left")
    words = (F.col("last") - F.col("first")) * F.col("times")
    return (p.groupBy("src", "bucket", "nth", "doc_id", "size", "source", "source_size", "target")
            .agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken", "source"))


def taken_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of the spans (first word, word after the last), verbatim; a line break at each gap."""
    at, runs = [m.span() for m in re.finditer(WORD, text)], []
    for first, last in spans:
        if runs and runs[-1][1] == first:
            runs[-1][1] = last
        else:
            runs.append([first, last])
    return "\n".join(text[at[a][0]:at[b - 1][1]] for a, b in runs)


def mix_documents(docs: DataFrame, block_words: int = 64, shard_slots: int = 4096) -> DataFrame:
    """The mixed corpus: for each document and pass that takes words of it, one row with those words.

    Columns are those of ``docs``; ``text`` is cut to the taken words (whole
    where all are taken) and ``n_chars``, if present, follows it.
    """
    plan, small, placed = _placed(docs, block_words)
    d = draws(docs.sparkSession, plan, small, shard_slots).select(
        F.col("src").alias("_src"), F.col("block").alias("_block"), "turn")
    p = _pieces(placed, block_words).where(F.col("block").isNotNull())
    taken = p.join(d.hint("merge"), (p["src"] == d["_src"]) & (p["block"] == d["_block"]))
    # Spans of one document in one pass, then all of one text's passes: bounded by the text's length.
    taken = (taken.groupBy("doc_id", "text_hash", "source", "size", "bucket", "nth", "turn")
             .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"), F.sum(F.col("last") - F.col("first")).alias("n")))
    takes = taken.groupBy(F.col("doc_id").alias("__mix_id"), F.col("text_hash").alias("__mix_hash"), F.col("source").alias("__mix_source"))
    takes = takes.agg(F.collect_list(F.struct(F.when(F.col("n") < F.col("size"), F.col("spans")).alias("spans"))).alias("__mix_takes"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else taken_text(t, [(x["first"], x["last"]) for x in s]) for t, s in zip(text, spans)])

    key = (docs["doc_id"].eqNullSafe(F.col("__mix_id")) & (F.xxhash64(docs["text"]) == F.col("__mix_hash"))
           & docs["source"].cast("string").eqNullSafe(F.col("__mix_source")))
    joined = docs.join(takes, key)
    # Repeated rows: their takes are listed together, so one of them carries the list.
    one = Window.partitionBy("__mix_id", "__mix_hash", "__mix_source").orderBy(F.lit(1))
    joined = joined.withColumn("__mix_one", F.row_number().over(one)).where("__mix_one = 1").withColumn("__mix_take", F.explode("__mix_takes"))
    out = joined.withColumn("text", cut(F.col("text"), F.col("__mix_take.spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
