"""Operator 12: URL filters by logistic regression on hashed character n-grams.

The n-grams (3 to 5 characters) of host and path, each with its side's mark, are
hashed into 2^16 buckets (presence, not counts, so a long path weighs no more than a short one)
and a logistic regression is trained on a small labelled URL table.  All steps
are Spark's own ML stages; n-grams are built from one split of a text, so the
work is linear in its length.  Rules come first: a rule (host, path start) fits
its host and all subdomains where the path starts with the rule's, and of the
fitting rules the longest decides.

Defined cases: a null url and one without ``://`` have empty host and path; such
a url has no n-gram and gets ``NO_URL`` unless a rule fits (none does).  A null
id stays null; repeated rows count each.  Equally long fitting rules: the one
first in order of text.  A labelled table with one label only gives that label to all, an empty
one ``allow``; a probability of exactly one half is ``block``.  Unlabelled or
null urls in it are left out.  An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm.common import written
from relscope.session import values_frame

ALLOW, BLOCK = "allow", "block"
#: Verdict, host and path of the contract's rules.
RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))
#: Verdict of a row without a host and a path: nothing speaks against it.
NO_URL = ALLOW
SIZES = (3, 4, 5)
BUCKETS = 1 << 16
PENALTY, STEPS = 0.0005, 60
#: A missed unwanted url costs as much as so many wrongly blocked ones.
MISSED = 2.0

#: Words of unwanted sites' names and paths, by the usual categories of public blocklists: gambling, medicines, adult, spam, tracking, fraud.
UNWANTED = ("casino", "poker", "slots", "jackpot", "roulette", "betting", "bets", "bookmaker", "lottery", "gambling", "pills", "pharmacy",
            "viagra", "cialis", "steroids", "adult", "porn", "xxx", "sex", "escort", "nude", "camgirls", "hentai", "spam", "linkfarm", "backlinks",
            "ads", "adserver", "track", "tracker", "tracking", "clickbait", "banner", "popup", "doorway", "malware", "phishing", "warez",
            "torrent", "keygen", "crack", "payday", "loans", "replica", "counterfeit", "miracle", "weightloss", "winner", "prize", "lucky")
#: Words around them and around ordinary ones; they say little.
AROUND = ("cheap", "free", "best", "online", "my", "hot", "new", "zone", "24", "live", "club", "top")
#: Words of ordinary sites' names and paths.
ORDINARY = ("library", "museum", "university", "school", "gardening", "weather", "recipes", "kitchen", "history", "science", "physics", "biology",
            "music", "orchestra", "theatre", "travel", "hiking", "railway", "harbour", "village", "city", "council", "parliament", "housing", "medicine",
            "hospital", "clinic", "daily", "herald", "tribune", "journal", "gazette", "review", "letters", "books", "poetry", "software",
            "compiler", "docs", "wiki", "forum", "mathematics", "astronomy", "engineering", "sailing", "forest", "mountain", "baking", "chess", "painting")
#: Invented ordinary names are made of these, so that a name of unknown pieces is ordinary.
ONSETS, VOWELS, CODAS = "bcdfghjklmnprstvwz", "aeiou", ("", "n", "r", "s", "l", "nd", "st", "th", "ng", "ck")
#: Names are dealt over these beginnings, endings and paths in turn, on both sides alike.
BEGIN = ("", "www.", "m.", "blog.", "shop.")
END = (".example.com", ".example.net", ".example.org", ".com", ".net", ".org", ".info", ".co.uk", ".de", ".fr")
PATHS = ("", "/", "/en/17", "/de/230.html", "/fr/9/", "/es/88#top", "/news/2021/05/a-day", "/index.html", "/p?id=7", "/en/512?ref=x")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule = F.when(fits, F.lit(domain + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(text: str, mark: str) -> str:
    """SQL: the marked n-grams of a text column, with ``^`` and ``$`` at its ends."""
    cut = f"split(concat('^', {text}, '$'), '')"
    parts = [f"transform(sequence(1, greatest(size(_c) - {n - 1}, 1)), i -> array_join(slice(_c, i, {n}), ''))" for n in SIZES]
    found = f"flatten(transform(array({cut}), _c -> array_distinct(concat({', '.join(parts)}))))"
    return f"transform({found}, g -> concat('{mark}', g))"


def featured(urls: DataFrame) -> DataFrame:
    """Adds ``_features``: hashed n-grams of the columns ``host`` and ``path``."""
    grams = F.expr(f"concat({_grams('host', 'h')}, {_grams('path', 'p')})")
    with_grams = urls.withColumn("_grams", F.when((F.col("host") == "") & (F.col("path") == ""), F.array().cast("array<string>")).otherwise(grams))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_features").transform(with_grams).drop("_grams")


@dataclass(frozen=True)
class Model:
    """A fitted regression, or the one verdict of a table without two labels."""

    regression: LogisticRegressionModel | None
    only: str = ALLOW


def train(labelled: DataFrame, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Fits the regression to ``labelled`` (url, blocked boolean).

    The table is small by its meaning, a list that people keep; its distinct
    rows are written once, and training runs over them as a DataFrame.
    """
    host, path = split_url(F.col("url"))
    rows = labelled.select("url", "blocked").where("url IS NOT NULL AND blocked IS NOT NULL")
    rows = rows.select(host.alias("host"), path.alias("path"), F.col("blocked").cast("double").alias("_label"))
    rows = written(featured(rows.where("host <> '' OR path <> ''").distinct()).select("_features", "_label").coalesce(4), "url-training")
    labels = sorted(r[0] for r in rows.select("_label").distinct().collect())  # two at most
    if len(labels) < 2:
        return Model(None, BLOCK if labels == [1.0] else ALLOW)
    fitted = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", probabilityCol="_probability",
                                rawPredictionCol="_raw", predictionCol="_prediction", regParam=penalty, maxIter=steps, standardization=False)
    return Model(fitted.fit(rows.withColumn("_weight", F.col("_label") * (MISSED - 1) + 1)))


def blocked(p: Column, host: Column, path: Column) -> Column:
    """The method's verdict where no rule fits."""
    return F.when((host == "") & (path == ""), F.lit(NO_URL)).when(p >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's probability of ``block`` for every row of ``pages`` (page_id, url)."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if model.regression is None:
        scored = urls.withColumn("p_block", F.lit(1.0 if model.only == BLOCK else 0.0))
    else:
        scored = model.regression.transform(featured(urls)).withColumn("p_block", vector_to_array("_probability")[1])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = blocked(F.col("p_block"), F.col("host"), F.col("path"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "p_block")


def invented(i: int) -> str:
    """The i-th invented name: two or three syllables."""
    parts = [ONSETS[(i * k + k) % len(ONSETS)] + VOWELS[(i * (k + 1) + i // 7) % len(VOWELS)] + CODAS[(i * k + i // 5) % len(CODAS)] for k in (1, 5, 7)]
    return "".join(parts[:2 + i % 2])


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, blocked): the words above, alone and with others, as host names and in paths of
    invented hosts, dealt over beginnings, endings and paths; ordinary and invented names likewise."""
    rows = []

    def deal(host: str, blocked: bool, inside: str = "") -> None:
        at = len(rows)
        begin, end, path = BEGIN[at % len(BEGIN)], END[(at + at // 10) % len(END)], PATHS[(at + at // 7) % len(PATHS)]
        rows.append((f"https://{begin}{host}{end}{inside}{path}", blocked))

    for words, blocked in ((UNWANTED, True), (ORDINARY, False)):
        for i, word in enumerate(words):
            other = words[(i * 7 + 3) % len(words)]
            for host in (word, f"{AROUND[i % len(AROUND)]}-{word}", f"{word}-{AROUND[(i * 5 + 1) % len(AROUND)]}", f"{word}{AROUND[(i * 5 + 2) % len(AROUND)]}", f"{other}-{word}"):
                deal(host, blocked)
            deal(invented(i), blocked, f"/{word}")
            deal(invented(3 * i + 1), blocked, f"/{AROUND[i % len(AROUND)]}-{word}/{other}")
    for i in range(800):
        deal(invented(i), False)
    return values_frame(spark, rows, "url string, blocked boolean")
