"""Batched model inference as a Spark job, and the whole evaluation chain.

``batched_inference`` is the one Python-worker step of the main path: each
task opens a client once (from a picklable factory), calls it once per prompt
with bounded retries, and never fails the job for a bad batch -- the error is
recorded and the batch's pairs get null predictions, as in the reference.

Fault tolerance: model calls are the expensive, non-repeatable part, so the
replies are written to the shared checkpoint folder as soon as they exist and
read back; scoring then reads that table, and a lost executor downstream never
triggers a second round of calls.  With a reply store (``reply_store``) every
chunk of calls is kept the moment it is done, and a killed run goes on from there.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relscope.functions.labels import support_label
from relscope.operators import prompting, replies, reply_store, sampling
from relscope.schema import STRATEGIES, check_strategies
from relscope.session import persisted

ClientFactory = Callable[[], object]
#: Prompts of an Arrow batch that a task has as Python strings at a time; the other columns stay in Arrow.
SLICE = 64


def _call(client, prompt: str, max_retries: int, retry_wait: float) -> tuple[str | None, int, str | None]:
    """Up to ``max_retries`` tries with a fixed wait between them."""
    err = None
    for attempt in range(1, max(1, max_retries) + 1):
        try:
            if hasattr(client, "invoke"):
                out = client.invoke(prompt)
                out = getattr(out, "content", out)
            else:
                out = client(prompt)
            return str(out), attempt, None
        except Exception as exc:  # noqa: BLE001 - any client failure is recorded
            err = f"{type(exc).__name__}: {exc}"
            if attempt < max_retries:
                time.sleep(retry_wait)
    return None, max(1, max_retries), err


def batched_inference(prompts: DataFrame, client_factory: ClientFactory, max_retries: int = 2,
                      retry_wait: float = 5.0, delay_seconds: float = 0.0,
                      parallelism: int | None = None, store: str | None = None, scope: str = "",
                      retry_failed: bool = False, chunk: int = reply_store.CHUNK) -> DataFrame:
    """Adds ``reply`` (null on failure), ``attempts`` and ``error`` to each prompt row.

    With ``store`` (a shared folder) replies are durable: kept chunk by chunk inside the tasks and found
    again by prompt and ``scope``, so a run that is started again calls only what is missing; a
    column ``resumed`` tells those rows.

    ``parallelism`` spreads the prompts over that many tasks (each with its own
    client); by default as many as the cluster has cores.  The number is explicit,
    so adaptive execution doesn't merge the small prompt partitions into one task."""
    from relscope.session import ship_package
    ship_package(prompts.sparkSession)
    if store is not None:
        return reply_store.durable_replies(prompts, partial(_call, max_retries=max_retries, retry_wait=retry_wait), client_factory, store,
                                           scope, retry_failed, parallelism, chunk, delay_seconds=delay_seconds)
    prompts = prompts.repartition(parallelism or prompts.sparkSession.sparkContext.defaultParallelism)
    out_schema = T.StructType(prompts.schema.fields + [
        T.StructField("reply", T.StringType()), T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType())])

    names = out_schema.names

    def run(batches):
        client = client_factory()  # once per task
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                res = []
                for p in part.column("prompt").to_pylist():
                    res.append(_call(client, p, max_retries, retry_wait))
                    if delay_seconds:
                        time.sleep(delay_seconds)
                done = [pa.array([r[k] for r in res], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *done], names=names)

    return prompts.mapInArrow(run, out_schema)


def persist_replies(replies_df: DataFrame, name: str = "replies") -> DataFrame:
    """The replies as a written table, see ``session.persisted``."""
    return persisted(replies_df, name)


def plan_batches(pairs: DataFrame, strategies, few_shot_n=0, limit: int | None = None,
                 batch_size: int = 10, seed: int = sampling.DEFAULT_SEED,
                 relevance_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All strategies in one plan, texts late: ids and gold codes are written once as a narrow table, repeated per
    strategy (a generator, not a join), sampled, excluded, numbered and dealt to batches.  Then
    each pair's places, as many as strategies, meet its texts by ``pair_id`` (which must be unique): the
    texts are read once beside the ids and cross one shuffle before the prompts are put together.

    ``few_shot_n`` is an int or a dict strategy -> n.  Returns (batched rows,
    few-shot blocks); both carry ``strategy``."""
    letters = check_strategies(strategies)
    n_by = few_shot_n if isinstance(few_shot_n, dict) else {s: few_shot_n for s in letters}
    narrow = persisted(pairs.select("pair_id", "support"), "pair-ids")
    per = narrow.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in letters])))
    pools = {s: STRATEGIES[s].few_shot_pool for s in letters}
    n_pos = {s: n for s, n in n_by.items() if n > 0 and s in letters}
    if n_pos:
        fs = sampling.stratified_sample_by(per, n_pos, pools, "strategy", seed)
        fs = persisted(fs.select("pair_id", "strategy", "example_seq"), "few-shot")  # a few rows
        ev = sampling.exclude_few_shot(per, fs, group_cols=["strategy"])
    else:
        fs, ev = None, per
    ev = sampling.limit_sample(ev, limit, seed, group_cols=["strategy"])
    places = sampling.assign_batches(ev, batch_size).select("pair_id", F.struct("strategy", "batch_id", "item_pos", "pos", "shuffle_key").alias("place"))
    places = places.groupBy(F.col("pair_id").alias("_id")).agg(F.collect_list("place").alias("_places"))
    batched = pairs.join(places, pairs["pair_id"] == places["_id"]).select(*pairs.columns, F.inline("_places"))
    if fs is not None:
        sample = pairs.join(fs.withColumnRenamed("pair_id", "_id"), pairs["pair_id"] == F.col("_id")).drop("_id")
    else:
        sample = pairs.limit(0).withColumn("strategy", F.lit("")).withColumn("example_seq", F.lit(0))
    blocks = prompting.few_shot_blocks(sample, letters, relevance_col)
    return batched, blocks


def evaluate_pairs(pairs: DataFrame, strategies, client_factory: ClientFactory,
                   few_shot_n: int = 0, limit: int | None = None, batch_size: int = 10,
                   seed: int = sampling.DEFAULT_SEED, max_retries: int = 2,
                   retry_wait: float = 5.0, delay_seconds: float = 0.0,
                   relevance_col: str | None = None, parallelism: int | None = None,
                   persist: bool = True, store: str | None = None, scope: str = "",
                   retry_failed: bool = False, chunk: int = reply_store.CHUNK) -> DataFrame:
    """The whole chain for one or more strategies:
    sample -> exclude -> limit -> batch -> prompt -> infer -> parse -> predictions.

    Returns one row per evaluated pair: pair columns (texts, gold code and its
    label, the human relevance where the pairs have one), strategy, batch_id,
    item_pos, the number of few-shot examples its prompt really had
    (``few_shot_n``), decoded flags and the batch's ``parse_status``.  ``store`` makes the
    replies durable, see ``batched_inference``."""
    batched, blocks = plan_batches(pairs, strategies, few_shot_n, limit, batch_size, seed,
                                   relevance_col)
    # Each batch row carries its members, so the replies are attached row-locally.
    human = relevance_col or "relevance_human_labeled"
    if human in batched.columns:
        batched = batched.withColumn("relevance_human_labeled", F.col(human).cast("double"))
    members = [c for c in ("pair_id", "orig_idx", "arg1", "arg2", "support", "relevance_human_labeled") if c in batched.columns]
    prompts = prompting.build_prompts(batched, blocks, member_cols=members)
    raw = batched_inference(prompts, client_factory, max_retries, retry_wait, delay_seconds,
                            parallelism, store, scope, retry_failed, chunk)
    raw = raw.select("strategy", "batch_id", F.col("n_items").alias("n_expected"), "reply", "attempts", "error", "members", "few_shot_n")
    if persist:
        raw = persist_replies(raw)
    parsed = replies.parse_replies(raw, keys=("strategy", "batch_id", "members", "few_shot_n"))
    out = replies.explode_replies(parsed).withColumn("support_label", support_label("support"))
    if "relevance_human_labeled" not in out.columns:
        out = out.withColumn("relevance_human_labeled", F.lit(None).cast("double"))
    return out
