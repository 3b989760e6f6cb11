"""Operator 9: quality rules with host verdicts (DataFrame functions only).

Each document is measured and fails or passes a few rules.  Failures are
counted per host (the ``source``), each host's rate per rule is shrunk towards
a beta prior fitted to all hosts by its moments, and a host whose shrunk rate
exceeds ``max_rate`` under any rule is rejected; verdicts are joined back.

Defined cases: a null or blank text has no words and fails; a null host is a
host of its own; one host, or hosts that all have one rate, give that rate as a
firm prior; an empty table gives no row; repeated rows count each; texts of any
length are measured whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relscope.llm.common import WORD, written

WINDOW = 8
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight in documents; the upper one holds where all hosts have one rate.
PRIOR_WEIGHT = (1.0, 1e6)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules: true for a document that fails.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "n_dup_lines >= 10",
}
BASE_FAILED = f"({RULES['short']}) OR ({RULES['repeats']})"


def _pairs_sql(name: str, shift: int, f: str) -> str:
    """``f`` of elements a, b that stand ``shift`` apart in an array column."""
    n = f"greatest(size({name}) - {shift}, 0)"
    return f"zip_with(slice({name}, 1, {n}), slice({name}, {shift + 1}, {n}), (a, b) -> {f})"


def _pairs(name: str, shift: int, f: str) -> F.Column:
    return F.expr(_pairs_sql(name, shift, f))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source and the metrics of every whole text.

    Windows of eight words are hashed by doubling (1, 2, 4, 8 words).  Texts
    without a repeated window end there; in the others the windows are sorted
    with their places, and repeated ones are those equal to a neighbour.  Each
    step is a column used more than once by the next, so it is computed once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    d = d.select(
        "doc_id", "source",
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    keep = ["doc_id", "source", "word_chars", "n_symbols"]
    d = d.select(*keep, (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.size("words").cast("long").alias("n_words"), F.expr("transform(words, w -> xxhash64(w))").alias("w1"))
    keep += ["n_dup_lines", "n_words"]
    d = d.select(*keep, _pairs("w1", 1, "xxhash64(a, b)").alias("w2"))
    d = d.select(*keep, _pairs("w2", 2, "xxhash64(a, b)").alias("w4"))
    d = d.select(*keep, _pairs("w4", 4, "xxhash64(a, b)").alias("w8"))
    d = d.select(*keep, F.expr("CASE WHEN size(array_distinct(w8)) < size(w8) THEN "
                               "sort_array(transform(w8, (x, i) -> named_struct('h', x, 'i', i))) END").alias("s"))
    d = d.select(*keep, "s", _pairs("s", 1, "a.h = b.h").alias("eq"))
    d = d.select(*keep, F.expr("sort_array(filter(zip_with(s, zip_with(concat(array(false), eq), concat(eq, array(false)), "
                               "(p, q) -> p OR q), (a, f) -> CASE WHEN f THEN a.i END), i -> i IS NOT NULL))").alias("at"))
    covered = f"aggregate({_pairs_sql('at', 1, f'least(b - a, {WINDOW})')}, 0L, (x, y) -> x + y) + {WINDOW}"
    return d.select(*keep, F.expr(f"CASE WHEN size(at) > 0 THEN {covered} ELSE 0L END").alias("n_repeat_words"))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE, rules=RULES) -> DataFrame:
    """host and failed for every host (a null host too); the prior is fitted per rule to all hosts."""
    fails = [F.sum(F.expr(r).cast("long")).alias(f"fails_{k}") for k, r in rules.items()]
    hosts = measured.groupBy("source").agg(F.count("*").alias("docs"), *fails)
    hosts = written(hosts, "hosts")
    moments = []
    for k in rules:
        rate = F.col(f"fails_{k}") / F.col("docs")
        moments += [F.avg(rate).alias(f"mean_{k}"), F.var_pop(rate).alias(f"var_{k}")]
    out, low, high = hosts.join(F.broadcast(hosts.agg(*moments))), *PRIOR_WEIGHT  # one row
    bad = F.lit(False)
    for k in rules:
        mean, var = F.col(f"mean_{k}"), F.col(f"var_{k}")
        weight = F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(F.try_divide(mean * (1 - mean), var) - 1, F.lit(high))))
        bad = bad | ((F.col(f"fails_{k}") + mean * weight) / (F.col("docs") + weight) > max_rate)
    return out.select(F.col("source").alias("host"), bad.alias("host_failed"))


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Metrics, base verdict, host verdict and the document's final verdict."""
    measured = written(measure(docs), "quality-metrics")
    verdicts = written(host_verdicts(measured, max_rate), "host-verdicts")
    out = measured.join(verdicts, measured["source"].eqNullSafe(verdicts["host"]), "left")
    failed = F.expr(BASE_FAILED)
    return out.select("doc_id", *METRICS, failed.alias("base_failed"),
                      (~failed & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
                      F.coalesce("host_failed", F.lit(False)).alias("host_failed"))
