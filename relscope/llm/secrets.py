"""Operator 4: secret scanning with an incremental ledger of blobs (DataFrame functions only).

Every version of every path is addressed by the SHA-256 of its text.  The
ledger is a table of (blob, rules scanned with their versions, spans found).
An update scans only the (blob, rule version) pairs that the ledger lacks, each
blob once however many paths hold it, and appends what it found; findings are
then joined back to all paths.

A rule is a pattern; its matches are leftmost and non-overlapping, and those
that fail the rule's length are dropped.  Positions are code points.

Defined cases: a null text is the empty text; repeated rows and paths with
equal text share one scan and each get its findings; a null id is a path like
any other; an empty table gives no row; texts of any length are scanned whole;
other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm.common import written
from relscope.session import scratch_dir


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1


#: Kinds in the order in which spans with one start are listed.  The first three are the base
#: kinds; in "hex" and "access" the length is part of the pattern, which finds the same runs.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE_KINDS = ("assign", "access", "hex")
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


#: Matches whose lengths are summed together.
BLOCK = 128


def _once(value: F.Column, body) -> F.Column:
    """``body`` of a value that is computed once (a lambda's body is computed for each element)."""
    return F.transform(F.array(value), body)[0]


def rule_spans(text: F.Column, rule: Rule, rank: int, wanted: F.Column, name: str):
    """Two steps, as (columns, spans): the matches, and their spans by summing the lengths of what lies between."""
    pattern = F.lit(rule.pattern)
    matches = F.when(wanted, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    m = F.col(name)
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(m))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc, x):
        a = acc["at"] + F.length(x["gap"])
        z = a + F.length(x["match"])
        span = F.struct(a.cast("long").alias("start"), F.lit(rank).alias("rank"), z.cast("long").alias("end"), F.lit(rule.kind).alias("kind"))
        good = F.length(F.regexp_extract(x["match"], rule.pattern, rule.group)) >= rule.least
        return F.struct(z.cast("long").alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def whole(x):
        return (F.length(x["gap"]) + F.length(x["match"])).cast("long")

    def in_blocks(zipped):
        """Spans block by block: appending copies a block, never all matches."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / BLOCK).cast("int")), lambda b: F.slice(zipped, b * BLOCK + 1, F.lit(BLOCK)))
        bases = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, blk: F.array_append(
            acc, F.element_at(acc, -1) + F.aggregate(blk, F.lit(0).cast("long"), lambda s, x: s + whole(x))))
        return _once(F.struct(blocks.alias("blocks"), bases.alias("bases")), lambda of: F.flatten(F.transform(
            of["blocks"], lambda blk, i: F.aggregate(blk, F.struct(of["bases"][i].alias("at"), none.alias("out")), step, lambda acc: acc["out"]))))

    found = _once(F.arrays_zip(between.alias("gap"), m.alias("match")), in_blocks)
    return matches, F.when(F.size(m) > 0, found).otherwise(none)


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Spans of every blob (blob, text, todo: kinds to scan), in the order of start and kind."""
    columns, spans = [], []
    for i, r in enumerate(rules):
        c, s = rule_spans(F.col("text"), r, i, F.array_contains("todo", r.kind), f"_m{i}")
        columns.append(c.alias(f"_m{i}"))
        spans.append(s)
    versions = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    return (blobs.select("blob", "text", "todo", *columns)
            .select("blob", F.filter(versions, lambda v: F.array_contains("todo", v["kind"])).alias("scanned"),
                    F.sort_array(F.concat(*spans)).alias("spans")))


def address(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the text's content address."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


def update_ledger(docs: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """Scans what the ledger table at ``ledger`` (a folder, one Parquet part per update) lacks; returns (doc_id, blob)."""
    spark = docs.sparkSession
    versions = address(docs)
    paths = written(versions.select("doc_id", "blob"), "secret-paths")
    pairs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    todo = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    seen = read_ledger(spark, ledger)
    if seen is not None:
        done = seen.select("blob", F.explode("scanned").alias("s")).select("blob", "s.kind", "s.version").distinct()
        done = done.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))  # as many as there are rules
        pairs = pairs.join(done, "blob", "left")
        todo = F.array_except(todo, F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>")))
    pairs = pairs.withColumn("todo", F.transform(todo, lambda r: r["kind"])).where(F.size("todo") > 0)
    new = pairs.select(F.col("blob").alias("_blob"), F.col("doc_id").alias("_id"), "todo")
    # One path of each unseen blob brings the text; repeated rows of that path leave one ledger row.
    blobs = versions.join(new, (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    scan(blobs.select("blob", "text", "todo"), rules).dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    return paths


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger so far (None before the first update)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules=RULES) -> DataFrame:
    """Spans of each blob under the current rule versions (blobs without findings left out)."""
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    kept = F.transform(F.array_intersect("scanned", current), lambda r: r["kind"])
    rows = read_ledger(spark, ledger).where(F.size("spans") > 0).select("blob", "spans", kept.alias("kinds"))
    rows = rows.select("blob", F.filter("spans", lambda s: F.array_contains("kinds", s["kind"])).alias("spans"))
    # A blob scanned in several updates has a row for each; spans are as many as its text holds.
    return rows.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def scan_documents(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """doc_id and spans of every row of ``docs``, through the ledger (a new one unless given)."""
    spark = docs.sparkSession
    ledger = ledger or scratch_dir(spark, "secret-ledger")
    paths = update_ledger(docs, ledger, rules)
    found = written(findings(spark, ledger, rules), "secret-findings")
    return paths.join(found, "blob", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    def text(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
