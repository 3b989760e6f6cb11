"""Reply parsing cases and the inference chain with a local model."""

import pytest
from pyspark.sql import functions as F

from relscope.operators import replies as R


def _parse(spark, reply, n, strategy="C"):
    df = spark.createDataFrame([(strategy, 0, n, reply)],
                               "strategy string, batch_id long, n_expected long, reply string")
    return R.parse_replies(df)


def test_value_decoding(spark):
    reply = '[{"attack": 0.9, "support": "1", "neither": true}, {"attack": 1}]'
    p = _parse(spark, reply, 2)
    assert p.collect()[0].parse_status == "ok"
    rows = sorted(R.decode_predictions(p).collect(), key=lambda r: r.item_pos)
    assert (rows[0].pred_attack, rows[0].pred_support, rows[0].pred_neither) == (0, 1, 1)
    assert (rows[1].pred_attack, rows[1].pred_support) == (1, None)


@pytest.mark.parametrize("reply,n,status", [
    ("[[1,2],[3]]", 2, "bad_json"),                 # shortest-bracket rule cuts it
    ("no json here", 1, "no_array"),
    ('```json\n[{"attack": 1}]\n```', 1, "ok"),
    ('[{"attack": 1}]', 2, "wrong_count"),
    ('[{"attack": null}]', 1, "bad_value"),
    ('[{"attack": "yes"}]', 1, "bad_value"),
    ('[1]', 1, "bad_value"),
    ("[{'attack': 1}]", 1, "bad_json"),
    (None, 1, "call_failed"),
])
def test_statuses(spark, reply, n, status):
    assert _parse(spark, reply, n).collect()[0].parse_status == status


def test_relevance_only_for_d(spark):
    p = _parse(spark, '[{"attack": 1, "relevance": "x"}]', 1, "C")
    assert p.collect()[0].parse_status == "ok"
    p = _parse(spark, '[{"attack": 1, "support": 0, "neither": 0, "relevance": 0.3}]', 1, "D")
    r = R.decode_predictions(p).collect()[0]
    assert r.pred_relevance == 0.3 and r.off_rubric


def test_failed_batch_keeps_rows_with_null_flags(spark):
    batched = spark.createDataFrame([("C", 0, 0, "p0"), ("C", 0, 1, "p1")],
                                    "strategy string, batch_id long, item_pos int, pair_id string")
    parsed = _parse(spark, "oops", 2)
    out = R.attach_replies(batched, parsed).collect()
    assert len(out) == 2 and all(r.pred_attack is None and r.parse_status == "no_array" for r in out)


def test_inference_retries_and_records_errors(spark):
    from relscope.operators.inference import batched_inference

    class Flaky:
        def __init__(self):
            self.calls = 0

        def __call__(self, prompt):
            self.calls += 1
            if "fail" in prompt:
                raise RuntimeError("down")
            return "[]"

    prompts = spark.createDataFrame([("ok",), ("fail",)], "prompt string")
    got = {r.prompt: r for r in batched_inference(prompts, Flaky, max_retries=3, retry_wait=0).collect()}
    assert got["ok"].reply == "[]" and got["ok"].attempts == 1
    assert got["fail"].reply is None and got["fail"].attempts == 3 and "down" in got["fail"].error


def test_evaluate_pairs_end_to_end(spark):
    from conftest import SF_SMALL
    from relscope.operators import scoring
    from relscope.operators.inference import evaluate_pairs
    from relscope.operators.stub_model import stub_factory
    from relscope.plans import fixtures as fx
    pairs = fx.pairs(spark, SF_SMALL)
    preds = evaluate_pairs(pairs, ["A", "C"], stub_factory, few_shot_n=4, limit=50,
                           batch_size=10, retry_wait=0)
    counts = {r.strategy: r["count"] for r in preds.groupBy("strategy").count().collect()}
    assert counts == {"A": 50, "C": 50}
    summ = scoring.run_summary(preds, keys=[])
    assert summ.count() == 2


def test_type_suffixes_are_no_numbers(spark):
    from pyspark.sql import functions as F
    from relscope.functions.replies import decode_flag, decode_relevance
    d = spark.createDataFrame([("1d",), ("1f",), ("0.9",), ("+1",), ("1e0",), (".5",), ("true",)], "v string")
    got = d.select(decode_flag(F.col("v")).alias("f"), decode_relevance(F.col("v")).alias("r")).collect()
    assert [r.f for r in got] == [None, None, 0, 1, 1, 0, 1]
    assert [r.r for r in got] == [None, None, 0.9, 1.0, 1.0, 0.5, 1.0]


def test_model_calls_spread_over_tasks(spark):
    from pyspark.sql import functions as F
    from relscope.operators import inference
    prompts = spark.range(40).coalesce(1).select(F.col("id"), F.col("id").cast("string").alias("prompt"))
    out = inference.batched_inference(prompts, lambda: (lambda prompt: "[]"), retry_wait=0)
    tasks = out.select("id", F.spark_partition_id().alias("task"))
    assert tasks.select("task").distinct().count() > 1
    assert out.count() == 40


def test_every_prompt_of_every_slice_is_called(spark):
    from pyspark.sql import functions as F
    from relscope.operators import inference
    n = 5 * inference.SLICE + 7
    prompts = spark.range(n).coalesce(1).select("id", F.when(F.col("id") != 3, F.col("id").cast("string")).alias("prompt"),
                                                F.array(F.struct(F.col("id").alias("x"))).alias("members"))
    out = inference.batched_inference(prompts, lambda: (lambda prompt: f"[{prompt}]"), retry_wait=0, parallelism=1)
    rows = out.collect()
    assert {r.id: r.reply for r in rows} == {i: f"[{i if i != 3 else None}]" for i in range(n)}
    assert all(r.members[0].x == r.id and r.attempts == 1 for r in rows)


def test_inference_gives_slices_of_an_arrow_batch():
    import pyarrow as pa
    from relscope.operators import inference

    class Prompts:  # what batched_inference asks of a DataFrame
        from pyspark.sql import types as T
        schema = T.StructType([T.StructField("prompt", T.StringType())])
        sparkSession = None

        def repartition(self, n):
            return self

        def mapInArrow(self, run, schema):
            return run

    import relscope.session as session
    shipped, session.ship_package = session.ship_package, lambda spark: None
    try:
        run = inference.batched_inference(Prompts(), lambda: (lambda prompt: "[]"), parallelism=1)
    finally:
        session.ship_package = shipped
    sizes = [b.num_rows for b in run([pa.record_batch({"prompt": [str(i) for i in range(1000)]})])]
    assert sum(sizes) == 1000 and max(sizes) <= inference.SLICE
