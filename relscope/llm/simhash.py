"""Operator 6: SimHash near-duplicates with pivot distance tables.

A fingerprint bit is 1 if set in over half of the hashes of a text's word
shingles.  Distinct fingerprints meet where they agree on ``CHOSEN`` of
``PIECES`` bit fields: with at most ``bits`` differing bits, at most that many
fields differ, so every link meets at least once.  In each meeting place the
fingerprints' Hamming distances to ``PIVOTS`` reference fingerprints are
tabulated once; a pair whose tables differ by more than ``bits`` in any
coordinate can't link (triangle inequality) and is discarded, the rest is
verified.  (The tables alone can't deal pairs to tasks: distances to a pivot
lie close together, so a window on them would leave a fixed share of all
pairs.)  A meeting place sends on a spanning forest of its links, never all
pairs; a large one is cut into chunks whose pairs are compared in blocks by
separate tasks.

Defined cases: a null or blank text has fingerprint zero and links like any
other; fewer words than a shingle give one shingle; repeated rows and ids share
a fingerprint; null ids never name a component unless all its ids are null; an
empty table gives no row; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relscope.llm.common import components, written

SHINGLE = 4
BITS = 4
HASH_SEED = 42
PIVOTS = 16
#: Fields of the fingerprint; at most BITS of them differ, so CHOSEN agree.
PIECES, CHOSEN = 7, 3
#: Fingerprints of a meeting place that one task compares; larger places are cut into chunks of about this many.
CHUNK = 1_024
TASK_ROWS = 200_000


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """64-bit SimHash of a text's shingles of ``words`` words, A-Z lower-cased."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only 0x09-0x0D and space split
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), HASH_SEED)  # over half of one hash is that hash
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], HASH_SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())), np.uint64, len(starts))
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, the text's hash, and fp, the fingerprint as a signed long."""
    def run(batches):
        for pdf in batches:
            fp = [fingerprint(t if isinstance(t, str) else None, words) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "fp": np.array(fp, np.uint64).view(np.int64)})
    # Ids travel as texts: beside a null, pandas would turn longs into doubles.
    d = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return d.mapInPandas(run, "doc_id string, text_hash long, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def _fields(pieces: int = PIECES) -> list[tuple[int, int]]:
    """(first bit, bits) of each field of a 64-bit fingerprint."""
    edges = [round(64 * i / pieces) for i in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def meeting_keys(fp: str = "fp", pieces: int = PIECES, chosen: int = CHOSEN) -> F.Column:
    """A key for every choice of fields: the choice's number and the fields' bits (below 58 together)."""
    keys = []
    for n, choice in enumerate(combinations(_fields(pieces), chosen)):
        parts, at = [f"shiftleft({n}L, 58)"], 0
        for first, bits in choice:
            parts.append(f"shiftleft(shiftrightunsigned({fp}, {first}) & {(1 << bits) - 1}L, {at})")
            at += bits
        keys.append(" | ".join(parts))
    return F.expr("array(" + ", ".join(keys) + ")")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every task."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64)


def pivot_table(fp: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return np.bitwise_count(fp[:, None] ^ references[None, :]).astype(np.int8)


def linked_pairs(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs (places a, b) link: coordinates first, then the survivors' own distance."""
    alive = np.arange(len(a))
    for k in range(0, table.shape[1], 4):
        x, y = a[alive], b[alive]
        alive = alive[(np.abs(table[x, k:k + 4] - table[y, k:k + 4]) <= bits).all(axis=1)]
    out = np.zeros(len(a), bool)
    out[alive] = np.bitwise_count(fp[a[alive]] ^ fp[b[alive]]) <= bits
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place each of n places reaches over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    while (root != root[root]).any():
        root = root[root]
    return root


def compare_places(place: np.ndarray, side: np.ndarray, fp: np.ndarray, references: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``place``, as a forest over the fingerprints: (fingerprint, least one it reaches).

    ``side`` 0 meets 1 only (two chunks of a large place); 2 meets all of its run.
    Pairs are formed by shifting the run against itself, so as many rows are in
    hand at a time as there are fingerprints.
    """
    known, at = np.unique(fp, return_inverse=True)
    table = pivot_table(known, references)
    left, right, live, shift = [], [], np.arange(len(fp)), 1
    while True:
        live = live[live + shift < len(fp)]
        live = live[place[live] == place[live + shift]]
        if not len(live):
            break
        other = live + shift
        meet = (side[live] != side[other]) | (side[live] == 2)
        a, b = at[live[meet]], at[other[meet]]
        good = linked_pairs(known, table, a, b, bits)
        left.append(a[good])
        right.append(b[good])
        if sum(map(len, left)) > 4 * len(known) + 100_000:  # keep a forest, not the pairs
            root = forest(len(known), np.concatenate(left), np.concatenate(right))
            left, right = [np.nonzero(root != np.arange(len(known)))[0]], [root[root != np.arange(len(known))]]
        shift += 1
    none = np.zeros(0, np.int64)
    root = forest(len(known), np.concatenate([none, *left]), np.concatenate([none, *right]))
    moved = np.nonzero(root != np.arange(len(known)))[0]
    return known[moved].view(np.int64), known[root[moved]].view(np.int64)


def links(distinct: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) whose components are those of all links."""
    if bits > PIECES - CHOSEN:
        raise ValueError(f"at most {PIECES - CHOSEN} differing bits with {PIECES} fields, {CHOSEN} chosen")
    members = distinct.select("fp", F.explode(meeting_keys()).alias("key"))
    places = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    places = written(places, "simhash-places")  # a written side leaves large places to the skew split
    met = members.join(places, "key").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    # A place in one chunk meets itself; otherwise chunk i meets each chunk j, one task per pair.
    met = met.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(
        F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"),
        F.when(F.col("mine") == j, 2).when(F.col("mine") < j, 0).otherwise(1).alias("side")))
    met = met.select("fp", "key", F.explode(pair).alias("p")).select("fp", "key", "p.*")
    spread = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    references = pivots()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def edges(pdf):
            where = pdf.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
            u, v = compare_places(where, pdf["side"].to_numpy(), pdf["fp"].to_numpy(np.int64).view(np.uint64), references, bits)
            return pd.DataFrame({"u": u, "v": v})

        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < TASK_ROWS:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = (pdf[["key", "i", "j"]] == pdf[["key", "i", "j"]].iloc[-1]).all(axis=1)  # may go on in the next batch
            held = [pdf[last]]
            if not last.all():
                yield edges(pdf[~last].reset_index(drop=True))
        if held:
            yield edges(pd.concat(held, ignore_index=True))

    return spread.mapInPandas(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint of the component) and component_id (least doc_id reachable) of every row."""
    prints = written(fingerprints(docs, words), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, bits), "simhash")
    # Components by fingerprint, named by the least id of all their fingerprints.
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    by_print = written(named.select("fp", "root").join(names, "root").select("fp", "root", "component_id"), "simhash-components")
    return prints.join(by_print, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_first(docs: DataFrame, words: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component (its least doc_id, nulls last), columns as they are.

    Rows that go are listed by id and text hash and leave by an anti join.  A
    row that stays but is repeated leaves its repetitions by dropDuplicates;
    only such rows take that way.
    """
    found = written(near_duplicates(docs, words, bits).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "simhash-found")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    heads = written(found.groupBy("root").agg(F.min(place).alias("head")), "simhash-heads")
    ranked = found.join(heads, "root").withColumn("first", place.eqNullSafe(F.col("head")))
    marked = ranked.where(~F.col("first") | (F.col("n") > 1)).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("first").alias("__first"))
    marked = written(marked, "simhash-marked")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    kept = docs.join(marked, same, "left_anti")
    again = marked.where("__first")
    if again.isEmpty():
        return kept
    once = docs.join(again, same).dropDuplicates(["__id", "__hash"]).select(*docs.columns)
    return kept.union(once)
