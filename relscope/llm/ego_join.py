"""Operator 7: embedding near-duplicates by an epsilon grid order join.

Unit vectors within cosine ``least`` lie within ``eps`` of each other, and so do
their projections on any orthonormal axes.  Distinct vectors are sorted by the
cells (width eps) of their leading principal projections and cut into sequence
intervals of ``BLOCK`` vectors.  Pairs of intervals are joined recursively: a
pair whose bounding boxes are more than eps apart is skipped with all its
parts, the others split into ``FAN`` parts each until single intervals meet,
whose parts are skipped the same way inside the task.  What meets is compared
by cosine in double precision.  Every join step is a DataFrame; tiles of interval
pairs send on link counts and a spanning forest, never the links themselves.

A task compares a tile: the pairs of one run of intervals with another.  An
interval is sent once to each tile that has a pair of it, and tiles go in
rounds that send about as much as the intervals' own size, so the disk taken
doesn't grow with the pairs.

Exact copies count as one vector with a weight, whatever their number.

Defined cases: null or empty vectors, zero vectors and those with null or
non-finite components link with nothing and are their own component; vectors of
different lengths don't link; a null id never names a component unless all its
ids are null (such a row is kept); repeated rows link with each other; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relscope.llm.common import components, discard, offsets, written
from relscope.llm.simhash import forest

LEAST = 0.9
AXES = 6
#: Vectors from which the principal axes are taken (those with the least hashes): a bound; any axes give the same links.
SAMPLE = 5_000
BLOCK, FAN, PART = 1_024, 8, 64
#: Intervals are cut into so many runs at least, tiles hold about so many bytes of vectors at most, rounds send so many at least.
RUNS, TILE_BYTES, ROUND_BYTES = 16, 16 << 20, 64 << 20
NODE = "struct<a:bigint,b:bigint>"


def eps_of(least: float) -> float:
    """Distance of unit vectors with this cosine, a little widened against rounding."""
    return math.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-9) + 1e-9


def principal_axes(vectors: np.ndarray, k: int = AXES) -> np.ndarray:
    """Orthonormal rows: the directions in which the unit vectors vary most."""
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.linalg.svd(u - u.mean(0), full_matrices=False)[2][:k]


def axes_for(axes: np.ndarray, dim: int, k: int = AXES) -> np.ndarray:
    """The principal axes, or coordinate axes for vectors of another length; always k rows."""
    a = axes if axes.shape[1] == dim else np.eye(min(k, dim), dim)
    return np.vstack([a, np.zeros((k - len(a), dim))])


def unit(values: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision (scaled first, so no norm overflows)."""
    v = values.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def box_gap(lo1, hi1, lo2, hi2) -> np.ndarray:
    """Squared distance of bounding boxes, all pairs of the first with the second."""
    gap = np.maximum(lo1[:, None] - hi2[None], lo2[None] - hi1[:, None])
    return (np.maximum(gap, 0) ** 2).sum(-1)


def join_intervals(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked places (i in x, j in y; i < j in x where y is None), skipping distant parts."""
    eps2 = eps_of(least) ** 2

    def parts(v):
        p = v @ axes.T
        order = np.lexsort(tuple(np.floor(p / math.sqrt(eps2)).T[::-1])) if eps2 > 0 else np.arange(len(v))
        first = np.arange(0, len(v), PART)
        return order, v[order], first, np.minimum.reduceat(p[order], first), np.maximum.reduceat(p[order], first)

    ox, vx, fx, lx, hx = parts(x)
    oy, vy, fy, ly, hy = (ox, vx, fx, lx, hx) if y is None else parts(y)
    left, right = [], []
    for a, near in enumerate(box_gap(lx, hx, ly, hy) <= eps2):
        if y is None:
            near[:a] = False
        for b in np.nonzero(near)[0]:
            i, j = np.nonzero(vx[fx[a]:fx[a] + PART] @ vy[fy[b]:fy[b] + PART].T >= least)
            if y is None and a == b:
                i, j = i[i < j], j[i < j]
            left.append(ox[i + fx[a]])
            right.append(oy[j + fy[b]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _projected(classes: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Adds the projections p0.. and the cell of each."""
    single = classes.schema["v"].dataType.simpleString() == "array<float>"
    value = pa.float32() if single else pa.float64()
    fields = [("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("v", pa.list_(value))]
    fields += [(f"p{k}", pa.float64()) for k in range(AXES)] + [(f"c{k}", pa.int32()) for k in range(AXES)]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                p = unit(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)) @ axes_for(axes, int(dim)).T
                cells = np.floor(p / max(eps, 1e-6)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("a", "b", "n", "dim", "v")]
                                                 + [pa.array(p[:, k]) for k in range(AXES)] + [pa.array(cells[:, k]) for k in range(AXES)],
                                                 schema=schema)

    sql = f"a long, b long, n long, dim int, v array<{'float' if single else 'double'}>, " + ", ".join([f"p{k} double" for k in range(AXES)] + [f"c{k} int" for k in range(AXES)])
    return classes.select("a", "b", "n", "dim", "v").mapInArrow(run, sql)


def _intervals(classes: DataFrame, axes: np.ndarray, eps: float, count: int):
    """(boxes by interval, vectors by interval): consecutive runs of BLOCK vectors in grid order."""
    order = ["dim", *[f"c{k}" for k in range(AXES)], "p0", "a", "b"]
    parts = max(1, math.ceil(count / (8 * BLOCK)))
    placed = _projected(classes, axes, eps).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_ = written(placed.withColumn("at", F.monotonically_increasing_id()), "ego-sorted")
    placed = sorted_.withColumn("part", F.shiftright("at", 33)).withColumn("nth", F.expr("at & 8589934591L"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows")).withColumn("all", F.lit(0))
    sizes = offsets(sizes, "all", "part", "rows").select(F.col("part").alias("_part"), "before")
    placed = placed.join(F.broadcast(sizes), F.col("part") == F.col("_part"))  # one row per 8 intervals
    seq = placed.withColumn("block", F.expr(f"(before + nth) div {BLOCK}"))
    low, high = [F.min(f"p{k}").alias(f"lo{k}") for k in range(AXES)], [F.max(f"p{k}").alias(f"hi{k}") for k in range(AXES)]
    dims = [F.min("dim").alias("dlo"), F.max("dim").alias("dhi")]
    lists = [F.collect_list(c).alias(c) for c in ("a", "b", "n", "dim")]  # BLOCK rows each
    blocks = written(seq.groupBy("block").agg(*low, *high, *dims, *lists, F.flatten(F.collect_list("v")).alias("v")), "ego-blocks")
    discard(sorted_)
    bounds = [f"{s}{k}" for k in range(AXES) for s in ("lo", "hi")] + ["dlo", "dhi"]
    return blocks.select("block", *bounds), blocks.select("block", "a", "b", "n", "dim", "v")


def _pairs(boxes: DataFrame, eps: float, count: int) -> DataFrame:
    """Pairs (i <= j) of intervals that may hold links: down a tree of FAN-fold larger intervals, level by level."""
    spark = boxes.sparkSession
    levels = max(0, math.ceil(math.log(max(1, count), FAN) - 1e-9))
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    for level in range(levels - 1, -1, -1):
        node = F.expr(f"block div {FAN ** level}L")
        low = [F.min(f"lo{k}").alias(f"lo{k}") for k in range(AXES)] + [F.min("dlo").alias("dlo")]
        high = [F.max(f"hi{k}").alias(f"hi{k}") for k in range(AXES)] + [F.max("dhi").alias("dhi")]
        nodes = written(boxes.groupBy(node.alias("node")).agg(*low, *high), "ego-nodes")
        x, y = (nodes.select(*[F.col(c).alias(f"{s}_{c}") for c in nodes.columns]) for s in "xy")
        gap = " + ".join(f"power(greatest(x_lo{k} - y_hi{k}, y_lo{k} - x_hi{k}, 0D), 2)" for k in range(AXES))
        near = F.expr(f"x_dlo <= y_dhi AND y_dlo <= x_dhi AND {gap} <= {eps * eps!r}D")
        steps = [F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1)).alias(c) for c in "ij"]
        pairs = pairs.select(steps[0], "j").select("i", steps[1]).where("i <= j")
        pairs = written(pairs.join(x, F.col("i") == F.col("x_node")).join(y, F.col("j") == F.col("y_node")).where(near)
                        .select("i", "j"), "ego-pairs")
    return pairs


def _tiles(pairs: DataFrame, side: int) -> DataFrame:
    """The intervals (block) that each tile (p, q) of ``side`` times ``side`` intervals needs, with those (js) that each is compared with there."""
    of = [F.expr(f"{c} div {side}").alias(t) for c, t in (("i", "p"), ("j", "q"))]
    needs = F.explode(F.expr("array(struct(i AS block, j AS j), struct(j AS block, CAST(NULL AS BIGINT) AS j))")).alias("m")
    return pairs.select(*of, needs).groupBy("p", "q", F.col("m.block").alias("block")).agg(F.collect_list("m.j").alias("js"))


def _compare(pairs: DataFrame, blocks: DataFrame, axes: np.ndarray, least: float) -> list[DataFrame]:
    """For each vector of a tile that links in it: its links there (with copies) and a forest edge; one written table a round."""
    item = 4 if dict(blocks.dtypes)["v"] == "array<float>" else 8
    size = blocks.agg(F.count("*"), F.sum(F.size("v") * item + F.size("a") * 28)).first()
    count, whole = size[0], size[1]
    side = max(1, min(count // RUNS, TILE_BYTES * count // (2 * whole)))
    needs = written(_tiles(pairs, side), "ego-tiles")
    sent, tiles = needs.count(), needs.select("p", "q").distinct().count()
    rounds = max(1, math.ceil(sent * whole / count / max(whole, ROUND_BYTES)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = {c: table.column(c).combine_chunks() for c in ("a", "b", "n", "dim", "v")}
        row = {block: r for r, block in enumerate(table.column("block").to_pylist())}

        def numpy(c, r):
            return column[c][r].values.to_numpy(zero_copy_only=False)

        a, b, weight = (np.concatenate([numpy(c, r) for r in row.values()]) for c in ("a", "b", "n"))
        base = dict(zip(row, np.cumsum([0] + [len(numpy("n", r)) for r in row.values()])))
        units = {}
        for block, r in row.items():  # by dimension: places in the tile, unit vectors
            dims, values = numpy("dim", r), numpy("v", r)
            at = np.concatenate([[0], np.cumsum(dims, dtype=np.int64)])
            units[block] = {int(d): (base[block] + (rows := np.nonzero(dims == d)[0]), unit(values[at[rows][:, None] + np.arange(d)])) for d in np.unique(dims)}
        more, root = np.zeros(len(a), np.int64), np.arange(len(a))
        for x, js in zip(row, table.column("js").to_pylist()):
            for y in js:
                for dim in units[x].keys() & units[y].keys():
                    (rx, ux), (ry, uy) = units[x][dim], units[y][dim]
                    i, j = join_intervals(ux, None if x == y else uy, axes_for(axes, dim), least)
                    if len(i):
                        i, j = rx[i], ry[j]
                        more += (np.bincount(i, weight[j], len(a)) + np.bincount(j, weight[i], len(a))).astype(np.int64)
                        root = forest(len(a), root[i], root[j])[root]
        hit = np.nonzero(more)[0]
        return pa.table({"a": a[hit], "b": b[hit], "more": more[hit], "ra": a[root[hit]], "rb": b[root[hit]]})

    def linked(k):
        here = needs.where(F.pmod(F.xxhash64("p", "q"), F.lit(rounds)) == k)  # about as many rows as there are intervals
        met = blocks.join(F.broadcast(here), "block").repartition(max(1, math.ceil(tiles / rounds)), "p", "q")
        return written(met.groupBy("p", "q").applyInArrow(run, "a long, b long, more long, ra long, rb long"), "ego-links")
    return [linked(k) for k in range(rounds)]


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    eps = eps_of(least)
    good = ("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND "
            "abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    # Single precision stays so until a task compares: half the bytes to shuffle.
    stored = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"coalesce({good}, false)").alias("good"),
                          F.col("embedding").cast(stored).alias("v"))
    rows = rows.withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit(1), "v"))
    classes = rows.where("good").groupBy("a", "b").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = written(classes.withColumn("dim", F.size("v")), "ego-classes")
    count = classes.count()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
    sample = classes.where(F.col("dim") == dim).orderBy("a", "b").limit(SAMPLE).select("v").toPandas()["v"]
    axes = principal_axes(unit(np.stack(sample.to_list())))
    boxes, blocks = _intervals(classes, axes, eps, count)
    names = written(classes.select("a", "b", "least", "n"), "ego-ids")
    discard(classes)  # the vectors are in the intervals
    classes = names
    found = reduce(DataFrame.union, _compare(_pairs(boxes, eps, math.ceil(count / BLOCK)), blocks, axes, least))
    discard(blocks)
    more = found.groupBy("a", "b").agg(F.sum("more").alias("more"))
    node = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    roots = components(found.select(node("a", "b").alias("u"), node("ra", "rb").alias("v")), "ego")
    roots = roots.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), "root")
    named = classes.select("a", "b", "least", "n").join(more, ["a", "b"], "left").join(roots, ["a", "b"], "left")
    named = named.select("a", "b", "least", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
                         F.coalesce("root", node("a", "b")).alias("root"))
    named = written(named, "ego-named")
    names = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "ego-names")
    by_class = written(named.join(names, "root").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "n_links", "component_id"), "ego-by-class")
    out = rows.join(by_class, F.col("good") & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
