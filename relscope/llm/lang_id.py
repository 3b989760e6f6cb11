"""Operator 3: language identification with language-bitmask n-gram filters.

Training counts the letter n-grams of a bounded sample of labelled documents
per language and keeps, for each n-gram, the languages that use it at least
``share`` times as often as its heaviest user.  The n-grams go into a
bit-sliced Bloom filter: row r of the table holds one bit per language, in as
many 64-bit words as the languages need, an n-gram sets its languages' bits in
``hashes`` rows, and the AND of these rows returns all languages that contain it.  A text's n-grams are counted per
language from those masks (popcounts), corrected for each language's
false-positive rate; the highest corrected share decides.

Defined cases: a null text, or one without letters, gets ``und`` and score 0;
ties go to the first language in code-point order; without any training text
every prediction is ``und``; texts are used whole, batch by batch; other
columns are ignored; repeated rows are predicted alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

N = 3
ROWS = 1 << 18
HASHES = 3
SHARE = 0.5
MIN_COUNT = 3
#: Documents of each language that training reads, about: the bound of the sample.
SAMPLE_PER_LANG = 2_000
#: Languages in one word of a Bloom row.
WORD_BITS = 64
_NON_LETTERS = re.compile(r"[\W\d_]+")
BATCH_CHARS = 2_000_000


def held_out(doc_id) -> F.Column:
    """Documents never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _has_letter(cleaned: str) -> bool:
    """Whether anything is a letter: numbers such as fractions, circled digits and Roman numerals are left, too."""
    return any(map(str.isalpha, cleaned))


def ngram_hashes(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of many texts in one row, and each text's [start, end) among them.

    Letters are lower-cased, anything else becomes one space; two spaces stand
    on either side of a text, so no n-gram reaches into the next one.
    """
    clean = [("  " + c.strip() + "  ") if t and _has_letter(c := _NON_LETTERS.sub(" ", t.lower())) else "" for t in texts]
    sizes = np.array([len(c) for c in clean], np.int64)
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = max(0, len(codes) - n + 1)
    h = np.zeros(total, np.uint64)
    for i in range(n):
        h *= np.uint64(0x100000001B3)
        h += codes[i:i + total]
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(30)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    return h, np.stack([start, np.where(sizes > 0, start + sizes - n + 1, start)], axis=1)


def slots(h: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The k-th Bloom row of each hash."""
    return ((h >> np.uint64(20 * k)) % np.uint64(rows)).astype(np.int64)


def _small_batches(texts: list) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def train(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> dict:
    """The filter learned from text and lang of documents that aren't held out."""
    known = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return {"langs": [], "table": np.zeros((1, 1), np.uint8), "fpr": np.zeros(0)}
    shares = json.dumps([{"_lang": r["lang"], "share": min(1.0, sample_per_lang / r["count"])} for r in sizes])
    shares = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(shares), "array<struct<_lang string, share double>>")))
    sample = known.join(F.broadcast(shares), F.col("lang") == F.col("_lang"))  # one row of each language, from the driver
    sample = sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def count(batches):
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                h, _ = ngram_hashes(part["text"].tolist())
                g, n = np.unique(h, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": g.view(np.int64), "n": n})

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(totals), F.col("lang") == F.col("_lang"))  # one row of each language
    rate = rate.withColumn("rate", F.col("n") / F.col("total"))
    rate = rate.withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
    kept = rate.where((F.col("n") >= MIN_COUNT) & (F.col("rate") >= SHARE * F.col("most"))).select("lang", "gram")
    bit = {x: i for i, x in enumerate(langs)}

    def bits(batches):
        for pdf in batches:
            h = pdf["gram"].to_numpy(np.int64).view(np.uint64)
            at = pdf["lang"].map(bit).to_numpy(np.int64)
            mask = np.left_shift(np.int64(1), at % WORD_BITS)
            for k in range(HASHES):
                yield pd.DataFrame({"row": slots(h, ROWS, k), "word": at // WORD_BITS, "mask": mask})

    # At most ROWS rows for each word come back, whatever the corpus.
    rows = kept.mapInPandas(bits, "row long, word long, mask long").groupBy("row", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    kind = np.uint8 if len(langs) <= 8 else np.uint16 if len(langs) <= 16 else np.uint64
    table = np.zeros((-(-len(langs) // WORD_BITS), ROWS), kind)
    table[rows["word"].to_numpy(np.int64), rows["row"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64).astype(kind)
    fill = np.array([np.mean((table[i // WORD_BITS] >> kind(i % WORD_BITS)) & kind(1)) for i in range(len(langs))])
    return {"langs": langs, "table": table, "fpr": fill ** HASHES}


def predict_texts(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, table, fpr = model["langs"], model["table"], model["fpr"]
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not langs:
        return names, scores
    for part in _small_batches(texts):
        h, spans = ngram_hashes(texts[part])
        n = spans[:, 1] - spans[:, 0]
        rows = np.nonzero(n > 0)[0]
        if not len(rows):
            continue
        at = [slots(h, ROWS, k) for k in range(HASHES)]
        kind = table.dtype.type
        corrected = np.empty((len(rows), len(langs)))
        for i in range(len(langs)):
            if i % WORD_BITS == 0:
                mask = np.bitwise_and.reduce([table[i // WORD_BITS][a] for a in at])
            # prefix sums, so that a text's count is a difference at its ends
            upto = np.concatenate([[0], np.cumsum((mask >> kind(i % WORD_BITS)) & kind(1), dtype=np.int64)])
            hits = (upto[spans[rows, 1]] - upto[spans[rows, 0]]) / n[rows]
            corrected[:, i] = np.clip((hits - fpr[i]) / max(1e-9, 1 - fpr[i]), 0, 1)
        best = corrected.argmax(axis=1)
        for r, b, c in zip(rows, best, corrected):
            names[part.start + r] = langs[b]
            scores[part.start + r] = c[b]
    return names, scores


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS masks for each 64 languages

    def predict(batches):
        for pdf in batches:
            names, scores = predict_texts(shared.value, [None if t is None or t != t else t for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": names, "score": scores})

    # Ids travel as texts: beside a null, pandas would turn longs into doubles.
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out("doc_id").alias("held_out"), "text").mapInPandas(
        predict, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
