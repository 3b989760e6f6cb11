"""Sampling, batching, prompts (FIXTURES.md C and properties)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from relscope.functions import prompts as P
from relscope.operators import prompting, sampling
from relscope.plans import fixtures as fx


def _ids(spark, n, classes=(0, 1, 2)):
    return spark.createDataFrame([(f"p{i}", classes[i % len(classes)], f"a{i}", f"b{i}")
                                  for i in range(n)], "pair_id string, support long, arg1 string, arg2 string")


def test_quotas():
    assert sampling.class_quotas(10, (0, 1, 2)) == {0: 4, 1: 3, 2: 3}
    assert sampling.class_quotas(7, (0, 1)) == {0: 4, 1: 3}


def test_class_with_fewer_rows_than_quota(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "pair_id string, support long")
    got = sampling.stratified_sample(df, 10, (0, 1)).collect()
    assert sorted(r.pair_id for r in got) == ["a", "b", "c"]


def test_seeded_shuffle_positions_are_dense_and_match_brute_force(spark):
    pred = fx.predictions(spark, SF_SMALL).select("pair_id")
    got = sampling.seeded_shuffle(pred, rows_per_bucket=50).select("pair_id", "pos").toPandas()
    assert sorted(got.pos) == list(range(len(got)))
    import hashlib
    brute = sorted(got.pair_id, key=lambda p: (hashlib.md5(f"42|{p}".encode()).hexdigest(), p))
    assert list(got.sort_values("pos").pair_id) == brute


def test_grouped_positions_with_many_buckets(spark):
    df = _ids(spark, 600)
    got = sampling.seeded_shuffle(df, group_cols=["support"], rows_per_bucket=7).toPandas()
    for _, g in got.groupby("support"):
        assert sorted(g.pos) == list(range(len(g)))
        assert list(g.sort_values("pos").shuffle_key) == sorted(g.shuffle_key)


def test_large_quota_path_equals_small_quota_path(spark):
    df = _ids(spark, 3000)
    old = sampling.SMALL_QUOTA
    try:
        small = {r.pair_id for r in sampling.stratified_sample(df, 900, (0, 1, 2)).collect()}
        sampling.SMALL_QUOTA = 10
        large = {r.pair_id for r in sampling.stratified_sample(df, 900, (0, 1, 2)).collect()}
    finally:
        sampling.SMALL_QUOTA = old
    assert small == large and len(small) == 900


def test_sampled_and_evaluated_sets_partition_the_data(spark):
    df = _ids(spark, 200)
    fs = sampling.stratified_sample(df, 10, (0, 1, 2))
    ev = sampling.exclude_few_shot(df, fs)
    a = {r.pair_id for r in fs.collect()}
    b = {r.pair_id for r in ev.collect()}
    assert not a & b and len(a | b) == 200


def test_batches_of_23(spark):
    df = sampling.assign_batches(sampling.limit_sample(_ids(spark, 23), None), 10)
    sizes = sorted(r["count"] for r in df.groupBy("batch_id").count().collect())
    assert sizes == [3, 10, 10]


def test_limit_after_exclusion(spark):
    df = _ids(spark, 100)
    fs = sampling.stratified_sample(df, 6, (0, 1, 2))
    lim = sampling.limit_sample(sampling.exclude_few_shot(df, fs), 20)
    rows = lim.collect()
    assert len(rows) == 20 and sorted(r.pos for r in rows) == list(range(20))


def test_prompt_layout(spark):
    df = _ids(spark, 3).withColumn("strategy", F.lit("A"))
    b = sampling.assign_batches(sampling.limit_sample(df, None), 10)
    prompt = prompting.build_prompts(b).collect()[0].prompt
    assert prompt.startswith(P.TEMPLATES["A"][0] + "\nPair 1:\nArg1: ")
    assert "exactly 3 objects" in prompt and prompt.endswith('{"attack": 1}.\n')


def test_few_shot_block_and_answers(spark):
    df = _ids(spark, 30).withColumn("rel", F.lit(0.5))
    fs = sampling.stratified_sample(df, 3, (0, 1, 2))
    blk = prompting.few_shot_block(fs, "D", "rel").collect()[0].few_shot_block
    assert blk.startswith("Here are 3 labeled example(s) to guide your classification:\n\n\nExample 1:")
    assert blk.endswith("Now classify the following pairs:\n")
    assert '"relevance": 0.5}' in blk
    zero = prompting.few_shot_block(fs, "D", None).collect()[0]
    assert zero.n_examples == 0 and zero.few_shot_block == ""


def _brute_order(ids, mark="42"):
    import hashlib
    return sorted(ids, key=lambda p: (hashlib.md5(f"{mark}|{p}".encode()).hexdigest(), p))


@pytest.mark.parametrize("digits", [1, 2, 4, 6])
def test_ranked_equals_brute_force_at_any_number_of_digits(spark, digits):
    rows = [(f"p{i}", [None, "a", "b"][i % 3 if i % 11 else 1]) for i in range(900)]
    df = spark.createDataFrame(rows, "pair_id string, g string")
    brute = {}
    for g in (None, "a", "b"):
        for pos, p in enumerate(_brute_order([i for i, x in rows if x == g])):
            brute[p] = pos
    got = sampling.ranked(df, sampling.order_key(), "pair_id", ["g"], digits=digits).collect()
    assert {r.pair_id: r.pos for r in got} == brute and len(got) == 900
    for quota in (1, 40, 250, 5000):
        for total in (None, 10_000):
            kept = sampling.ranked(df, sampling.order_key(), "pair_id", ["g"], digits=digits, quota=F.lit(quota), most=quota, total=total)
            assert {r.pair_id: r.pos for r in kept.collect()} == {p: k for p, k in brute.items() if k < quota}
    one = {r.pair_id: r.pos for r in sampling.ranked(df, sampling.order_key(), "pair_id", digits=digits).collect()}
    assert one == {p: k for k, p in enumerate(_brute_order([i for i, _ in rows]))}


@pytest.mark.parametrize("n", [-1, 0, 1, 7, 2999, 10_000])
def test_one_schema_and_order_for_every_sample_size(spark, n):
    df = _ids(spark, 3000)
    got = sampling.stratified_sample(df, n, (0, 1, 2))
    assert got.dtypes == sampling.stratified_sample(df, 5, (0, 1, 2)).dtypes
    rows = got.collect()
    want = set()
    for c, q in sampling.class_quotas(max(n, 0), (0, 1, 2)).items():
        want |= set(_brute_order([f"p{i}" for i in range(c, 3000, 3)])[:max(q, 0)])
    assert {r.pair_id for r in rows} == want
    by_seq = sorted(rows, key=lambda r: r.example_seq)
    assert [r.example_seq for r in by_seq] == list(range(1, len(rows) + 1))
    assert [r.pair_id for r in by_seq] == [p for _, p in sorted((k, p) for k, p in _fs_keys(rows))]


def _fs_keys(rows):
    import hashlib
    return [(hashlib.md5(f"fs|{r.shuffle_key}".encode()).hexdigest(), r.pair_id) for r in rows]


def test_large_samples_are_numbered_without_one_task(spark, monkeypatch):
    df = _ids(spark, 600)
    small = {r.pair_id: r.example_seq for r in sampling.stratified_sample(df, 300, (0, 1, 2)).collect()}
    monkeypatch.setattr(sampling, "ROWS_PER_BUCKET", 20)
    large = sampling.stratified_sample(df, 300, (0, 1, 2))
    assert {r.pair_id: r.example_seq for r in large.collect()} == small
    assert "SinglePartition" not in large._jdf.queryExecution().executedPlan().toString()


def test_shuffles_read_the_input_twice_and_use_no_single_task(spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/p"
    fx.predictions(spark, SF_SMALL).select("pair_id", "support").write.parquet(path)
    df = spark.read.parquet(path)
    for out in (sampling.seeded_shuffle(df), sampling.assign_batches(sampling.limit_sample(df, None), 20),
                sampling.limit_sample(df, 500), sampling.limit_sample(df, 5000)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and "SinglePartition" not in plan
    # Cells: counted, summed, joined; rows: one exchange that join and window share.
    for out in (sampling.seeded_shuffle(df), sampling.seeded_shuffle(df, group_cols=["support"])):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
    # A selection cuts its rows by the kept cells before they are shuffled.
    assert "BroadcastHashJoin" in sampling.limit_sample(df, 500)._jdf.queryExecution().executedPlan().toString()


def test_digits_follow_the_size_of_the_input(spark):
    wide = spark.range(10_000_000).select(F.col("id").cast("string").alias("pair_id"))
    assert sampling.key_digits(wide, 10 ** 9) == 1
    assert sampling.key_digits(wide, 1000) > sampling.key_digits(wide, 100_000) >= 1
    assert sampling.key_digits(spark.createDataFrame([("a",)], "pair_id string")) <= sampling.UNKNOWN_DIGITS


def test_texts_are_read_late_and_cross_one_shuffle(spark):
    import tempfile

    from relscope.operators import inference
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/pairs"
    fx.pairs(spark, SF_SMALL).write.parquet(path)
    pairs = spark.read.parquet(path)
    batched, blocks = inference.plan_batches(pairs, "ABCD", few_shot_n=4, batch_size=10)
    plan = batched._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and path in line]
    assert len(scans) == 1 and "arg1" in scans[0]  # ids and gold codes were written aside, in one more read
    n = pairs.count()
    for letter, rows in {r.strategy: r["count"] for r in batched.groupBy("strategy").count().collect()}.items():
        assert rows == n - 4, letter
    again, _ = inference.plan_batches(pairs.repartition(3), "ABCD", few_shot_n=4, batch_size=10)
    place = ["strategy", "batch_id", "item_pos", "pair_id", "arg1", "arg2", "support"]
    assert batched.select(place).exceptAll(again.select(place)).count() == 0
    zero, empty = inference.plan_batches(pairs, "AD", few_shot_n=0, limit=7)
    assert zero.count() == 14 and {r.few_shot_block for r in empty.collect()} == {""}
