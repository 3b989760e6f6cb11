"""Operator 10: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded
(shape of its words, repetition, hashed words) and projected; gated attention
weighs the passages, and the weighted sum is scored.  Only documents have
labels; attention learns which passages matter.

Training uses a bounded sample of the labelled documents (``SAMPLE`` of each
label, weighted back to their true shares) without those held out; every
document is scored, whole, batch by batch.

Defined cases: a null or empty text is one passage of zeros; missing or null
labels don't train; without two labels every score is the share of label 1 (1
without any label); repeated rows are scored alike; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
HASHED = 32
SHAPE = 8
#: Labelled documents of each label that training reads, about: the bound of the sample.
SAMPLE = 3_000
HIDDEN, STEPS, RATE, DECAY, SEED = 24, 400, 0.02, 1e-4, 7
THRESHOLD = 0.3
RECENT_WORDS = 300_000
BATCH_CHARS = 1_000_000
SYMBOLS = frozenset("#*$%&|<>~^=_{}[]\\/+@")


def held_out(doc_id) -> F.Column:
    """Documents never learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _kinds(char: int) -> tuple[bool, bool, bool, bool]:
    c = chr(char)
    return c.isupper(), c.isdigit(), c in SYMBOLS, c.isalpha()


def _shapes(words: list[str]) -> np.ndarray:
    """Of each word: length, shares of capitals, digits, symbols and other punctuation, all capitals, a first capital, bucket."""
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    chars, at = np.unique(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    kinds = np.array([_kinds(c) for c in chars.tolist()], float)
    n = np.array([np.add.reduceat(k[at], first) for k in kinds.T])  # of each kind, in each word
    upper, letters = n[0], n[3]
    buckets = np.fromiter((zlib.crc32(w.lower().encode()) for w in words), np.int64, len(words)) % (2 * HASHED)
    return np.column_stack([np.minimum(size, 40) / 10, upper / size, n[1] / size, n[2] / size, (size - letters - n[1] - n[2]) / size,
                            (upper > 1) & (upper == letters), kinds[at[first], 0], buckets]).astype(float)


class Encoder:
    """Features of all passages of many texts; remembers the shapes of recent words."""

    WIDTH = SHAPE + 4 + HASHED

    def __init__(self):
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.shapes = np.zeros((0, SHAPE))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Features (passages, WIDTH) and the first passage of each text."""
        if len(self.number) > RECENT_WORDS:
            self.__init__()
        lists = [re.findall(r"[^\x20\x09-\x0D]+", t) if t else [] for t in texts]
        number, known = self.number, len(self.number)
        word = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64)
        if len(number) > known:
            self.shapes = np.concatenate([self.shapes, _shapes(list(islice(number, known, None)))])
        sizes = np.array([len(x) for x in lists], np.int64)
        bags = np.maximum(1, -(-sizes // PASSAGE))
        first = np.cumsum(bags) - bags
        doc = np.repeat(np.arange(len(lists)), sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, total = first[doc] + place // PASSAGE, int(bags.sum())
        n = np.bincount(at, minlength=total).astype(float)
        safe = np.maximum(n, 1)
        out = np.zeros((total, self.WIDTH))
        s = self.shapes[word] if len(word) else np.zeros((0, SHAPE))
        for j in range(SHAPE - 1):
            out[:, j] = np.bincount(at, s[:, j], total) / safe
        out[:, SHAPE - 1] = np.sqrt(np.maximum(0, np.bincount(at, s[:, 0] ** 2, total) / safe - out[:, 0] ** 2))
        pair = np.unique(at * (len(number) + 1) + word)
        out[:, SHAPE] = np.bincount(pair // (len(number) + 1), minlength=total) / safe
        again = (word[1:] == word[:-1]) & (at[1:] == at[:-1]) if len(word) else np.zeros(0, bool)
        out[:, SHAPE + 1] = np.bincount(at[1:][again], minlength=total) / safe if len(word) else 0
        out[:, SHAPE + 2] = n / PASSAGE
        out[:, SHAPE + 3] = np.log1p(bags)[np.repeat(np.arange(len(lists)), bags)]
        bucket = s[:, -1].astype(np.int64)
        sign = np.where(bucket < HASHED, 1.0, -1.0)
        out[:, SHAPE + 4:] = (np.bincount(at * HASHED + bucket % HASHED, sign, total * HASHED).reshape(total, HASHED)
                              / np.sqrt(safe)[:, None])
        return out, first


def _softmax(x: np.ndarray, first: np.ndarray, bag: np.ndarray) -> np.ndarray:
    e = np.exp(x - np.maximum.reduceat(x, first)[bag])
    return e / np.add.reduceat(e, first)[bag]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """h = tanh(xW + b); attention softmax(w . (tanh(hV) * sigmoid(hU))); score sigmoid(z . c + d), z the weighted h."""

    def __init__(self, width: int, rng: np.random.Generator):
        k = HIDDEN
        self.p = {"W": rng.normal(0, width ** -0.5, (width, k)), "b": np.zeros(k), "V": rng.normal(0, k ** -0.5, (k, k)),
                  "U": rng.normal(0, k ** -0.5, (k, k)), "w": rng.normal(0, k ** -0.5, k), "c": np.zeros(k), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def forward(self, x, first):
        p = self.p
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = _softmax((t * g) @ p["w"], first, bag)
        z = np.add.reduceat(a[:, None] * h, first)
        return bag, h, t, g, a, z, _sigmoid(z @ p["c"] + p["d"])

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0)
        return self.forward(np.clip((features - self.mean) / self.scale, -8, 8), first)[-1]

    def fit(self, features: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Adam on the weighted log loss, all documents of the sample in each step."""
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-3
        x, p = np.clip((features - self.mean) / self.scale, -8, 8), self.p
        weight = weight / weight.sum()
        m, v = {k: 0.0 for k in p}, {k: 0.0 for k in p}
        for step in range(1, STEPS + 1):
            bag, h, t, g, a, z, s = self.forward(x, first)
            e = (s - y) * weight
            dz = e[:, None] * p["c"]
            da = (dz[bag] * h).sum(1)
            do = a * (da - np.add.reduceat(a * da, first)[bag])
            dt, dg = do[:, None] * p["w"] * g * (1 - t * t), do[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ do, "c": z.T @ e, "d": np.array([e.sum()])}
            for k in p:
                q = grad[k] + DECAY * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Where each stretch of a column of texts begins, and its texts: only these become Python strings, the others stay in Arrow."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        size += n
        if size >= BATCH_CHARS:
            yield start, texts[start:i + 1].to_pylist()
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:].to_pylist()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """The model, or a constant score where there aren't two labels."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    n = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(n) < 2:
        return float(next(iter(n), 1))
    share = F.when(F.col("quality") == 1, min(1.0, sample / n[1])).otherwise(min(1.0, sample / n[0]))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")  # about 2 * sample rows

    def encode(batches):
        encoder = Encoder()
        for batch in batches:
            for start, texts in _parts(batch.column("text")):
                x, first = encoder(texts)
                bags = pa.array([b.tobytes() for b in np.split(x.astype(np.float32), first[1:])], pa.binary())
                ids, quality = (batch.column(c).slice(start, len(texts)) for c in ("doc_id", "quality"))
                yield pa.RecordBatch.from_arrays([ids, quality, bags], ["doc_id", "quality", "x"])

    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    data = rows.mapInArrow(encode, "doc_id long, quality int, x binary").toPandas().sort_values(["doc_id", "x"])
    if data["quality"].nunique() < 2:
        return float(n[1] / (n[0] + n[1]))
    bags = [np.frombuffer(b, np.float32).reshape(-1, Encoder.WIDTH) for b in data["x"]]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    y = data["quality"].to_numpy(float)
    weight = np.where(y == 1, n[1] / max(1, (y == 1).sum()), n[0] / max(1, (y == 0).sum()))
    model = Model(Encoder.WIDTH, np.random.default_rng(SEED))
    model.fit(np.concatenate(bags).astype(float), first, y, weight)
    return model


def _scores(encoder: Encoder, model: Model | float, texts: pa.Array) -> np.ndarray:
    """Scores of a column of texts, stretch by stretch."""
    if isinstance(model, float):
        return np.full(len(texts), model)
    return np.concatenate([model.score(*encoder(part)) for _, part in _parts(texts)] or [np.zeros(0)])


def score(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (with doc_id, text) -> doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        encoder, m = Encoder(), shared.value
        for batch in batches:
            s = _scores(encoder, m, batch.column("text"))
            columns = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= threshold).astype(np.int32)}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored below the threshold, columns as they are (no join: rows are scored in place)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, m = Encoder(), shared.value
        for texts in batches:
            yield pa.array(_scores(encoder, m, texts), pa.float64())

    return docs.where(quality(F.col("text")) >= threshold)
