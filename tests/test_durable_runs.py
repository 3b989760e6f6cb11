"""Durable replies, committed runs, identity by content, and sources read by ranges."""

import glob
import os
import random
import sys
import tempfile
import uuid

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import SF_SMALL
from relscope.operators import inference, reply_store, sampling
from relscope.plans import fixtures as fx
from relscope.plans import jobs
from relscope.sources import arrow_ranges, csv_ranges, identity, run_store, sinks
from relscope.sources import pairs as P
from relscope.sources.predictions import read_predictions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # clients travel to the workers, this file doesn't


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


class Counting:
    """A client that leaves one file per call, and once kills its worker at a given prompt."""

    def __init__(self, log, deadly=None):
        self.log, self.deadly = log, deadly

    def __call__(self):
        return self.answer

    def answer(self, prompt):
        if prompt == self.deadly and not os.path.exists(f"{self.log}/dead"):
            open(f"{self.log}/dead", "w").close()
            os._exit(1)
        with open(f"{self.log}/{uuid.uuid4().hex}.call", "w") as f:
            f.write(prompt)
        if prompt.startswith("bad"):
            raise RuntimeError("down")
        return f"reply to {prompt}"

    def calls(self):
        return sorted(open(f).read() for f in glob.glob(f"{self.log}/*.call"))


def infer(prompts, client, store, **settings):
    settings = {"retry_wait": 0, "max_retries": 1, "chunk": 1, "store": store} | settings
    return inference.batched_inference(prompts, client, **settings)


def test_each_batch_is_called_once_over_a_killed_and_a_second_run(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id long, prompt string")
    client, store = Counting(folder(), deadly="p13"), folder()
    with pytest.raises(Exception):
        infer(prompts, client, store, parallelism=1).collect()
    before = client.calls()
    assert 0 < len(before) < 40 or os.path.exists(f"{client.log}/dead")
    got = infer(prompts, client, store, parallelism=4).collect()
    assert client.calls() == sorted(f"p{i}" for i in range(40))
    assert sorted((r.id, r.reply, r.attempts, r.error) for r in got) == [(i, f"reply to p{i}", 1, None) for i in range(40)]
    assert sorted(r.prompt for r in got if r.resumed) == before
    # A third run calls nothing, however the prompts are dealt.
    assert all(r.resumed for r in infer(prompts.repartition(7), client, store, parallelism=3).collect())
    assert len(client.calls()) == 40


def test_equal_null_and_failed_prompts(spark):
    rows = [(1, "same"), (2, "same"), (3, "same"), (4, None), (5, None), (6, "bad"), (7, "")]
    prompts = spark.createDataFrame(rows, "id long, prompt string")
    log, store = folder(), folder()

    class Tolerant(Counting):
        def answer(self, prompt):
            return super().answer(str(prompt))

    client = Tolerant(log)
    first = {r.id: r for r in infer(prompts, client, store).collect()}
    assert client.calls() == ["", "None", "bad", "same"]
    assert first[1].reply == first[3].reply == "reply to same" and first[4].reply == "reply to None"
    assert first[6].reply is None and "down" in first[6].error and first[6].attempts == 1
    again = {r.id: r for r in infer(prompts, client, store).collect()}
    assert len(client.calls()) == 4 and again[6].resumed and again[6].error == first[6].error
    retried = {r.id: r for r in infer(prompts, client, store, retry_failed=True).collect()}
    assert client.calls().count("bad") == 2 and len(client.calls()) == 5 and not retried[6].resumed
    # Another scope (another run or model) has its own replies.
    assert not any(r.resumed for r in infer(prompts, client, store, scope="m2").collect())
    reply_store.compact_replies(spark, store)
    assert all(n.startswith("compact=") for n in os.listdir(store))
    assert all(r.resumed for r in infer(prompts, client, store).collect())


def test_an_empty_store_and_no_prompts(spark):
    none = spark.createDataFrame([], "id long, prompt string")
    store = folder() + "/new"
    assert reply_store.stored_replies(spark, store).collect() == []
    out = infer(none, Counting(folder()), store)
    assert out.collect() == [] and out.columns == ["id", "prompt", "reply", "attempts", "error", "resumed"]
    reply_store.compact_replies(spark, store)


def test_a_task_tried_again_finds_its_chunks_and_no_torn_ones():
    where = folder()
    writer = reply_store.ChunkWriter(where, 1, chunk=2, seconds=1e9)
    for k in "abc":
        writer.add(k, (k.upper(), 1, None))
    assert reply_store.ChunkWriter(where, 2).earlier() == {"a": ("A", 1, None), "b": ("B", 1, None)}
    open(f"{where}/.1-000009.parquet", "w").write("torn")
    writer.commit()
    assert set(reply_store.ChunkWriter(where, 2).earlier()) == {"a", "b", "c"}
    timed = reply_store.ChunkWriter(where, 3, chunk=1000, seconds=0)
    timed.add("d", (None, 2, "E"))
    assert timed.rows == [] and "d" in timed.earlier()


# --- committed runs

PRED = "pair_id string, strategy string, support long, pred_attack int"


def some(spark, n, mark, strategies="BD"):
    return spark.createDataFrame([(f"{mark}{i}", strategies[i % len(strategies)], 0, i % 2) for i in range(n)], PRED)


def ids(df):
    return sorted(r.pair_id for r in df.collect())


def test_two_models_in_one_folder_keep_both(spark):
    path = folder()
    sinks.write_predictions(some(spark, 6, "a"), path, run_id="first/run 1%=é")
    sinks.write_predictions(some(spark, 4, "b"), path, run_id="second", meta={"model": "m2"})
    assert ids(read_predictions(spark, path, runs="all")) == sorted([f"a{i}" for i in range(6)] + [f"b{i}" for i in range(4)])
    assert ids(read_predictions(spark, path)) == [f"b{i}" for i in range(4)]  # the current run of each strategy
    first = read_predictions(spark, path, runs=["first/run 1%=é"])
    assert ids(first) == [f"a{i}" for i in range(6)] and {r.run_id for r in first.collect()} == {"first/run 1%=é"}
    listed = {(r.run, r.strategy): r for r in run_store.list_runs(spark, path).collect()}
    assert {k: (r.rows, r.current) for k, r in listed.items()} == {("first/run 1%=é", "B"): (3, False), ("first/run 1%=é", "D"): (3, False),
                                                                    ("second", "B"): (2, True), ("second", "D"): (2, True)}
    assert listed["second", "B"].meta == '{"model": "m2"}'
    # A later run of one strategy only: the other one stays current as it was.
    sinks.write_predictions(some(spark, 2, "c", "D"), path, run_id="third")
    assert ids(read_predictions(spark, path)) == ["b0", "b2", "c0", "c1"]


def test_a_torn_write_is_invisible(spark, monkeypatch):
    path = folder()
    sinks.write_predictions(some(spark, 4, "a"), path, run_id="x")
    monkeypatch.setattr(run_store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        sinks.write_predictions(some(spark, 9, "torn"), path, run_id="x")
    monkeypatch.undo()
    assert ids(read_predictions(spark, path, runs="all")) == ids(read_predictions(spark, path)) == [f"a{i}" for i in range(4)]
    assert run_store.vacuum(spark, path) == []  # it may still be under way
    assert len(run_store.vacuum(spark, path, older_than_seconds=0)) == 1
    assert ids(read_predictions(spark, path)) == [f"a{i}" for i in range(4)]
    assert run_store.vacuum(spark, path, older_than_seconds=0) == []


def test_a_run_written_again_replaces_its_own_rows(spark):
    path = folder()
    many = some(spark, 12, "a").withColumn("run_id", F.expr("CAST(substring(pair_id, 2) AS LONG) % 3"))
    sinks.write_predictions(many, path)
    assert ids(read_predictions(spark, path)) == sorted(f"a{i}" for i in range(12))
    sinks.write_predictions(some(spark, 2, "z").withColumn("run_id", F.lit(1).cast("long")).withColumn("more", F.lit("m")), path)
    got = read_predictions(spark, path, runs="all")
    assert ids(got) == sorted([f"a{i}" for i in range(12) if i % 3 != 1] + ["z0", "z1"])
    assert {r.more for r in got.collect()} == {None, "m"} and dict(got.dtypes)["run_id"] == "bigint"
    assert ids(read_predictions(spark, path, runs=[1])) == ["z0", "z1"]


def test_csv_runs_and_empty_runs(spark):
    path = folder()
    sinks.write_predictions(some(spark, 5, 'a"\n,'), path, fmt="csv", run_id="x")
    got = read_predictions(spark, path)
    assert ids(got) == sorted(f'a"\n,{i}' for i in range(5)) and dict(got.dtypes)["support"] == "bigint"
    assert "support_label" in got.columns
    empty = folder()
    sinks.write_predictions(some(spark, 0, "a").where("false"), empty, run_id="x")
    assert read_predictions(spark, empty).collect() == []
    with pytest.raises(ValueError):
        sinks.write_predictions(spark.range(1), empty)


# --- identity by content

def orders(df):
    return [(r.arg1, r.arg2, r.support) for r in sampling.limit_sample(df, None).orderBy("pos").collect()]


def test_rewritten_files_keep_ids_and_orders(spark):
    base = spark.range(500).selectExpr("CAST(id % 180 AS STRING) AS arg1", "IF(id % 7 = 0, NULL, 'b') AS arg2", "id % 3 AS support", "'t' AS type")
    want, first = None, None
    for n, cut in enumerate((1, 5, 3)):
        for kind in ("parquet", "csv", "arrow"):
            path = f"{folder()}/pairs{n}.{kind}"
            out = base.repartition(cut, F.rand(n))
            if kind == "arrow":
                P.write_pairs_arrow(out, path).collect()
            else:
                out.write.option("header", True).format(kind).save(path)
            df = P.read_pairs(spark, path, identity="content")
            P.check_unique_ids(df)
            got = sorted(r.pair_id for r in df.select("pair_id").collect())
            want, first = want or got, first or orders(df)
            assert got == want and orders(df) == first, (kind, cut)


def test_equal_base_names_do_not_collide(spark):
    root = folder()
    for sub in "ab":
        os.makedirs(f"{root}/{sub}")
        table = pa.table({"arg1": ["x", "y"], "arg2": ["p", "q"], "support": [0, 1], "type": ["t", "t"]})
        with pa.ipc.new_stream(f"{root}/{sub}/same.arrow", table.schema) as w:
            w.write_table(table)
    for how in ("file", "content"):
        df = P.read_pairs_arrow(spark, f"{root}/*/", identity=how)
        assert df.count() == 4
        P.check_unique_ids(df)
    with pytest.raises(ValueError):
        P.read_pairs_arrow(spark, root + "/a", identity="name")


def test_copies_of_one_content_are_numbered_over_blocks(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS arg1", "CAST(NULL AS STRING) AS arg2",
                                        "CONCAT('f', id % 4) AS _file", "id AS _row")
    got = identity.content_ids(rows, ["arg1", "arg2"], block=16).collect()
    hot = [r.pair_id for r in got if r.arg1 == "hot"]
    name = min(hot, key=len)
    assert sorted(hot) == sorted([name] + [f"{name}#{i}" for i in range(1, 1000)])
    assert len({r.pair_id for r in got}) == 3000 and all("#" not in r.pair_id for r in got if r.arg1 != "hot")
    one, two = (spark.createDataFrame([v], "a string, b string").select(identity.content_hash("a", "b")).first()[0] for v in (("1", None), (None, "1")))
    assert one != two


# --- CSV by ranges

def whole(spark, path):
    return sorted(map(str, spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).collect()))


def by_ranges(spark, path):
    df = csv_ranges.read_csv(spark, path)
    return sorted(map(str, df.drop("_file", "_row").collect())), df


@pytest.mark.parametrize("seed", range(4))
def test_csv_ranges_equal_the_whole_read(spark, tiny_splits, seed):
    r = random.Random(seed)
    values = ["", "plain", 'a "quoted" word', "two\nlines", '"', "comma, here", "\n\n\n", "é" * 30, " spaced ", '""', "x" * 700, "tab\t", "end\n"]
    path = folder()
    rows = {}
    for name in ("one.csv", "two.csv"):
        with open(f"{path}/{name}", "w", newline="") as f:
            f.write('id,"a\nb",c\n')
            rows[name] = []
            for i in range(r.randrange(60, 120)):
                row = [f"{name}{i}", r.choice(values), r.choice(values)]
                rows[name].append(row)
                f.write(",".join(v if v and not set(v) & set('",\n') and r.random() < 0.7 else ('"' + v.replace('"', '""') + '"' if v else "") for v in row))
                f.write("\n" if i % 9 else "\n\n")  # blank lines between
    got, df = by_ranges(spark, path)
    assert got == whole(spark, path)
    assert df.select("_file", "_row").distinct().count() == sum(map(len, rows.values()))
    for x in df.select("_file", "_row", "id").collect():
        assert rows[os.path.basename(x["_file"])][x["_row"]][0] == x["id"]
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 10


@pytest.mark.parametrize("text", ["a,b\r\n1,2\r\n\"x\r\ny\",\"z\"\"\"\r\n\r\n3,4", "a,b\n", "a,b", "a,b\n,\n\"\",\"\"\n1\n1,2,3\n", "﻿a,b\n1,2\n"])
def test_csv_odd_files(spark, tiny_splits, text):
    path = folder() + "/x.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    got, df = by_ranges(spark, path)
    assert got == whole(spark, path) and df.columns[:2] == ["a", "b"]
    assert sorted(r["_row"] for r in df.collect()) == list(range(df.count()))


def test_csv_with_an_open_quote_stops(spark):
    path = folder() + "/x.csv"
    open(path, "w").write('a,b\n1,"2\n3,4\n')
    with pytest.raises(ValueError, match="never ends"):
        csv_ranges.read_csv(spark, path)


def test_one_csv_file_is_read_by_many_tasks_and_no_text_is_shuffled(spark, tiny_splits):
    path = folder() + "/pairs.csv"
    with open(path, "w") as f:
        f.write("arg1,arg2,support\n" + "".join(f"a{i},b{i},{i % 3}\n" for i in range(400)))
    df = P.read_pairs_csv(spark, path)
    assert df.rdd.getNumPartitions() > 10
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert all(r.arg1 == f"a{r.orig_idx}" and r.pair_id == f"pairs.csv#{r.orig_idx}" for r in df.collect())


# --- Arrow streams by ranges

def stream(path, batches, schema=None):
    with pa.ipc.new_stream(path, schema or batches[0].schema) as w:
        for b in batches:
            w.write_batch(b)


def test_one_arrow_file_is_read_by_several_tasks(spark):
    path = folder() + "/pairs.arrow"
    schema = pa.schema([("arg1", pa.string()), ("arg2", pa.string()), ("support", pa.int32()), ("type", pa.string())])
    batches = [pa.RecordBatch.from_pydict({"arg1": [f"a{k}-{i}" for i in range(k % 5)], "arg2": ["b"] * (k % 5),
                                           "support": [k] * (k % 5), "type": ["t"] * (k % 5)}, schema=schema) for k in range(60)]
    stream(path, batches)
    want = [v for b in batches for v in b.column(0).to_pylist()]
    whole = P.read_pairs_arrow(spark, path)
    split = P.read_pairs_arrow(spark, path, range_bytes=1)
    for df in (whole, split):
        assert [r.arg1 for r in sorted(df.collect(), key=lambda r: r.orig_idx)] == want
    index = arrow_ranges.index(spark.createDataFrame([(path, path)], "path string, root string"), 1).collect()
    assert len(index) == 60 and [r.first_row for r in index] == [sum(b.num_rows for b in batches[:i]) for i in range(60)]
    assert split.select(F.spark_partition_id()).distinct().count() > 3


def test_arrow_dictionaries_empty_files_and_torn_ones(spark):
    path = folder()
    words = [pa.DictionaryArray.from_arrays(pa.array([0, 1, 0]), pa.array([f"x{k}", f"y{k}"])) for k in range(5)]
    stream(f"{path}/d.arrow", [pa.RecordBatch.from_arrays([w, pa.array(["b"] * 3), pa.array([0] * 3)], names=["arg1", "arg2", "support"]) for w in words])
    stream(f"{path}/none.arrow", [], pa.schema([("arg1", pa.string()), ("arg2", pa.string()), ("support", pa.int64())]))
    got = sorted((r.orig_idx, r.arg1, r.type) for r in P.read_pairs_arrow(spark, path, range_bytes=1).collect())
    assert got == [(3 * k + i, v, None) for k in range(5) for i, v in enumerate((f"x{k}", f"y{k}", f"x{k}"))]
    whole = open(f"{path}/d.arrow", "rb").read()
    torn = folder() + "/torn.arrow"
    open(torn, "wb").write(whole[:-40])
    with pytest.raises(Exception, match="ends inside"):
        P.read_pairs_arrow(spark, torn).collect()


# --- the evaluation job

def write_pairs(spark, n=None):
    path = folder() + "/WebDataset.parquet"
    df = fx.pairs(spark, SF_SMALL).select("arg1", "arg2", "support", "type").withColumn("relevance_human_labeled", F.lit(0.5))
    (df if n is None else df.limit(n)).write.parquet(path)
    return path


class Stub:
    """The stub model behind a counter; kills its worker at its n-th call, once."""

    def __init__(self, log, deadly=None):
        self.log, self.deadly = log, deadly

    def __call__(self):
        from relscope.operators.stub_model import StubModel
        model, log, deadly = StubModel(), self.log, self.deadly

        def answer(prompt):
            done = len(glob.glob(f"{log}/*.call"))
            if deadly is not None and done == deadly and not os.path.exists(f"{log}/dead"):
                open(f"{log}/dead", "w").close()
                os._exit(1)
            open(f"{log}/{uuid.uuid4().hex}.call", "w").write(prompt)
            return model(prompt)
        return answer


def test_a_killed_evaluation_goes_on(spark):
    path, out, log = write_pairs(spark), folder(), folder()
    run = dict(strategies=["B", "D"], out_dir=out, limit=60, batch_size=5, retry_wait=0, max_retries=1, model="m", run_id="r1", parallelism=1, chunk=1)
    with pytest.raises(Exception):
        jobs.evaluation_job(spark, path, client_factory=Stub(log, deadly=7), **run)
    with pytest.raises(Exception):
        read_predictions(spark, os.path.join(out, "predictions")).collect()  # nothing was committed
    rows = {r.strategy: r for r in jobs.evaluation_job(spark, path, client_factory=Stub(log, deadly=7), **run).collect()}
    calls = [open(f).read() for f in glob.glob(f"{log}/*.call")]
    assert len(calls) == len(set(calls)) == 24  # 12 batches a strategy, each once
    assert {k: r.n_evaluated for k, r in rows.items()} == {"B": 60, "D": 60}
    # Finished already: the same rows again, no call, no second overview row.
    jobs.evaluation_job(spark, path, client_factory=Stub(log), **run)
    assert len(glob.glob(f"{log}/*.call")) == 24
    overview = spark.read.parquet(os.path.join(out, "overview"))
    assert sorted((r.run_id, r.strategy) for r in overview.collect()) == [("r1", "B"), ("r1", "D")]
    # Another model beside it.
    jobs.evaluation_job(spark, path, client_factory=Stub(log), **{**run, "model": "n", "run_id": "r2"})
    both = read_predictions(spark, os.path.join(out, "predictions"), runs="all")
    assert {(r.run_id, r["count"]) for r in both.groupBy("run_id").count().collect()} == {("r1", 120), ("r2", 120)}
    assert {"arg1", "arg2", "support_label", "h1"} <= set(both.columns) and both.where("h1 = 0.5").count() == 240


def test_the_overview_has_the_examples_that_prompts_had(spark):
    path = folder() + "/x.parquet"
    rows = [(f"a{i}", f"b{i}", 0 if i < 2 else 1, "t") for i in range(30)]  # two attacks only, for four asked
    spark.createDataFrame(rows, "arg1 string, arg2 string, support long, type string").write.parquet(path)
    got = jobs.evaluation_job(spark, path, ["B", "D"], Stub(folder()), folder(), few_shot_n=8, retry_wait=0, max_retries=1).collect()
    assert {r.strategy: r.few_shot_n for r in got} == {"B": 6, "D": 0}  # D has no relevance, so no examples


def test_label_keys_must_be_unique(spark):
    out = folder()
    sinks.write_predictions(spark.createDataFrame([(1, "D", 0.5)], "orig_idx long, strategy string, pred_relevance double"), out, run_id="x")
    labels = folder() + "/l.csv"
    open(labels, "w").write("orig_idx,relevance human labeled\n1,0.5\n1,0.25\n")
    with pytest.raises(ValueError):
        jobs.relevance_job(spark, out, labels)
