"""Operator 13: a Merkle manifest of a dataset, with a tree of SHA-256 states.

Every document is a leaf.  Leaves of a source, in order of doc_id, hang under
a tree of fan 16, and the sources' roots under another one.  A parent hashes
its children's digests one after the other and keeps a copy of the hash state before each child slot;
folding a changed child resumes the state before its slot with the
replacement and the siblings to its right, and never hashes those to its left again.

The work goes by chunks of 16^3 consecutive nodes, each three levels of the tree in one group of a
bounded size, however many documents a source has:

* up: every chunk gives its top node, the nodes of the next stage, until one node is left of each tree;
* down: every node of the upper stages gets its path (what lies left and right of it at each level up to
  the root), from its own chunk and the path of the chunk's top node;
* across: every chunk of leaves rebuilds its parents with their states, meets the path of its top
  node, and proves and folds each of its leaves.

Defined cases: every null field counts as ``-``; documents without a source are
a source of their own, the first; a null doc_id comes before all others and
is never tampered with; equal
doc_ids of a source are ordered by their leaves, and fully equal rows are leaves
each.  A lone leaf is its source's subroot, a lone subroot the root, and the
proof of a lone leaf of a lone source the hash of nothing.  Empty texts have a
length of 0.  An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relscope.llm.common import offsets, written

FAN, LEVELS = 16, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One document in so many (by crc32 of its id) gets a tampered text.
TAMPERED = 5


@dataclass
class Parent:
    """A node's digest, its children's, and the hash states kept before each child slot."""

    children: list[bytes]
    states: list = field(default_factory=list)
    digest: bytes = b""

    def __post_init__(self) -> None:
        state = hashlib.sha256()
        for child in self.children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child: the state before the slot, the child, the siblings to its right."""
        state = self.states[slot].copy()
        state.update(child)
        for sibling in self.children[slot + 1:]:
            state.update(sibling)
        return state.hexdigest().encode()


def grow(leaves: list[bytes], levels: int, fan: int) -> list[list[Parent]]:
    """The parents of each level above ``leaves``, exactly ``levels`` of them."""
    out, nodes = [], leaves
    for _ in range(levels):
        out.append([Parent(nodes[i:i + fan]) for i in range(0, len(nodes), fan)])
        nodes = [p.digest for p in out[-1]]
    return out


def _levels(n: Column, levels: int, fan: int) -> Column:
    """Levels that a chunk of a tree of n nodes spans: all if the tree ends in it."""
    rest = F.lit(levels)
    for k in range(levels - 1, -1, -1):
        rest = F.when(n <= fan ** k, F.lit(k)).otherwise(rest)
    return rest


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``at``, the place of each row in the order (from 0), by sorted ranges and the rows of the ranges before."""
    ranges = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    ranges = ranges.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    placed = written(ranges.withColumn("_id", F.monotonically_increasing_id()), "merkle-order")
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_nth", F.expr("_id & 8589934591L"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_all", F.lit(0))
    sizes = offsets(sizes, "_all", "_part", "_rows").select(F.col("_part").alias("_p"), "before")  # a row a range
    return placed.join(sizes, F.col("_part") == F.col("_p")).withColumn("at", F.col("before") + F.col("_nth")).drop("_id", "_part", "_nth", "_p", "before")


def leaf_of(*fields: Column) -> Column:
    """SHA-256 (hex) of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and tampered leaf (the same where nothing is tampered) of every document."""
    docs = docs.select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % TAMPERED == 0
    tampered = F.when(F.col("doc_id").isNotNull() & chosen, leaf_of(*fields, F.translate("text", UPPER, LOWER)))
    leaves = docs.select("doc_id", "source", leaf_of(*fields, F.col("text")).alias("leaf"), tampered.alias("_tampered"))
    return leaves.withColumn("tampered", F.coalesce("_tampered", "leaf")).drop("_tampered")


def _up(nodes: DataFrame, levels: int, fan: int) -> DataFrame:
    """The top node of every chunk: (tree, idx, n, digest) of the next stage."""
    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        digests = [d.encode() for d in table.column("digest").to_pylist()]
        span = table.column("span")[0].as_py()
        top_digest = grow(digests, span, fan)[-1][0].digest if span else digests[0]
        return pa.table({"tree": table.column("tree")[:1], "idx": table.column("chunk")[:1], "n": table.column("next")[:1], "digest": pa.array([top_digest.decode()])})

    size = fan ** levels
    keyed = nodes.select("tree", "idx", "digest", F.expr(f"idx div {size}").alias("chunk"), _levels(F.col("n"), levels, fan).alias("span"),
                         F.expr(f"(n + {size - 1}) div {size}").alias("next"))
    return keyed.groupBy("tree", "chunk").applyInArrow(top, "tree long, idx long, n long, digest string")


def _sides(above: list[list[Parent]], i: int, fan: int) -> Iterator[tuple[Parent, int]]:
    """The parents over leaf i of a chunk, with its slot in each."""
    for level in above:
        yield level[i // fan], i % fan
        i //= fan


def _down(nodes: DataFrame, tops: DataFrame, levels: int, fan: int) -> DataFrame:
    """The path of every node of a stage: (tree, idx, lefts, rights, subroot, root), lefts and rights by level up to the root."""
    def paths(group: pa.Table, top: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        digests = [d.encode() for d in group.column("digest").to_pylist()]
        above = grow(digests, group.column("span")[0].as_py(), fan)
        rest = top.to_pylist()[0]
        lefts, rights = [], []
        for i in range(len(digests)):
            steps = list(_sides(above, i, fan))
            lefts.append([b"".join(p.children[:s]).decode() for p, s in steps] + rest["lefts"])
            rights.append([b"".join(p.children[s + 1:]).decode() for p, s in steps] + rest["rights"])
        n = len(digests)
        return pa.table({"tree": group.column("tree"), "idx": group.column("idx"), "lefts": pa.array(lefts, pa.list_(pa.string())),
                         "rights": pa.array(rights, pa.list_(pa.string())), "subroot": pa.array([rest["subroot"]] * n, pa.string()),
                         "root": pa.array([rest["root"]] * n, pa.string())})

    keyed = nodes.select("tree", "idx", "digest", F.expr(f"idx div {fan ** levels}").alias("chunk"), _levels(F.col("n"), levels, fan).alias("span"))
    return (keyed.groupBy("tree", "chunk").cogroup(tops.groupBy("tree", "idx"))
            .applyInArrow(paths, "tree long, idx long, lefts array<string>, rights array<string>, subroot string, root string"))


def _across(leaves: DataFrame, tops: DataFrame, levels: int, fan: int) -> DataFrame:
    """Proof and folded root of every leaf, with the subroot and root of its chunk's path."""
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                        ("proof_sha256", pa.string()), ("folded_root", pa.string())])

    def prove(group: pa.Table, top: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        leaf, changed = group.column("digest").to_pylist(), group.column("tampered").to_pylist()
        digests = [d.encode() for d in leaf]
        above = grow(digests, group.column("span")[0].as_py(), fan)
        rest = top.to_pylist()[0]
        # The chunk's ancestors: the state before the chunk's slot, kept once for all its leaves, and what follows.
        ancestors = [(hashlib.sha256(left.encode()), right.encode()) for left, right in zip(rest["lefts"], rest["rights"])]
        beyond = "".join(left + right for left, right in zip(rest["lefts"], rest["rights"])).encode()
        proofs, folded = [], []
        for i, now in enumerate(changed):
            proof, digest = hashlib.sha256(), now.encode()
            for parent, slot in _sides(above, i, fan):
                proof.update(b"".join(parent.children[:slot] + parent.children[slot + 1:]))
                digest = parent.fold(slot, digest)
            proof.update(beyond)
            for kept, right in ancestors:
                state = kept.copy()
                state.update(digest + right)
                digest = state.hexdigest().encode()
            proofs.append(proof.hexdigest())
            folded.append(digest.decode())
        n = len(leaf)
        return pa.Table.from_arrays([group.column("doc_id"), group.column("digest"), pa.array([rest["subroot"]] * n, pa.string()),
                                     pa.array([rest["root"]] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string())], schema=schema)

    keyed = leaves.select("tree", "idx", "doc_id", "digest", "tampered", F.expr(f"idx div {fan ** levels}").alias("chunk"), _levels(F.col("n"), levels, fan).alias("span"))
    return (keyed.groupBy("tree", "chunk").cogroup(tops.groupBy("tree", "idx"))
            .applyInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"))


def _stages(nodes: DataFrame, name: str, levels: int, fan: int) -> list[DataFrame]:
    """The stages above ``nodes`` (tree, idx, n, digest), each a written table; the last one has one node a tree."""
    stages = [nodes]
    while len(stages) == 1 or stages[-1].where("n > 1").limit(1).count():
        stages.append(written(_up(stages[-1], levels, fan), f"merkle-{name}-{len(stages)}"))
    return stages


def manifest(docs: DataFrame, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``."""
    leaves = numbered(written(leaves_of(docs), "merkle-leaves"), "source", "doc_id", "leaf")
    leaves = written(leaves, "merkle-places")
    # A source is named by the place of its first leaf, which also orders the sources.
    sources = written(leaves.groupBy("source").agg(F.min("at").alias("tree"), F.count("*").alias("n")), "merkle-sources")
    if sources.isEmpty():
        return leaves.where("false").selectExpr("doc_id", "leaf", "leaf AS subroot", "leaf AS root", "leaf AS proof_sha256", "leaf AS folded_root", "true AS verified")
    s = sources.select(F.col("source").alias("_source"), "tree", "n")
    leaves = leaves.join(s, F.col("source").eqNullSafe(F.col("_source")))
    leaves = written(leaves.select("doc_id", F.col("leaf").alias("digest"), "tampered", "tree", "n", (F.col("at") - F.col("tree")).alias("idx")), "merkle-nodes")
    below = _stages(leaves, "source", levels, fan)
    # The subroots, in order of their sources, are the nodes of the tree above.
    subroots = numbered(below[-1].select(F.col("tree").alias("source_tree"), "digest"), "source_tree")
    total = subroots.count()
    subroots = written(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("at").alias("idx"), F.lit(total).cast("long").alias("n"), "digest", "source_tree"), "merkle-subroots")
    above = _stages(subroots, "top", levels, fan)
    none = F.array().cast("array<string>")
    paths = above[-1].select("tree", "idx", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for stage in reversed(above[:-1]):
        paths = written(_down(stage, paths, levels, fan), "merkle-paths")
    # The paths of the subroots are the paths of the sources' tops.
    paths = paths.join(subroots.select("idx", "source_tree", F.col("digest").alias("_subroot")), "idx")
    paths = paths.select(F.col("source_tree").alias("tree"), F.lit(0).cast("long").alias("idx"), "lefts", "rights", F.col("_subroot").alias("subroot"), "root")
    for stage in reversed(below[1:-1]):
        paths = written(_down(stage, paths, levels, fan), "merkle-paths")
    return _across(leaves, paths, levels, fan).withColumn("verified", F.col("folded_root") == F.col("root"))
