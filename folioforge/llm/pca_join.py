"""Embedding near-duplicates: all pairs by cosine, PCA-ordered and tiled.

Unit vectors are turned into the basis of their principal components, fitted on
a bounded sample; that changes no product. For a pair the leading components are
accumulated first; the rest of the product is at most the product of the
vectors' suffix norms, and work on a pair stops when even that can't reach the
threshold. The same bound holds for boxes: a splitting tree of the sample deals
the vectors into regions, and regions, or strips of a tile, whose boxes in the
leading components are too far apart are never compared.

A region with many vectors is cut into blocks of bounded size in bytes; there are
no more of them than keep the cores busy, as each vector is sent to all blocks that
its own may hold links with. Each pair of such blocks is one unit of work; it
returns a row per linked vector, with its number of links and a vector of its local
component, never its pairs. Equal vectors are compared once and counted by their
number. Components come from alternating large-star and small-star.

Nothing is approximate: the sample only decides what is compared first. Bounds are
taken in the turned basis, the products that are held against the threshold from
the unit vectors themselves.

Defined results: null vectors, vectors with null, infinite or NaN components,
without components or of length zero link with nothing, nor do vectors of
another dimension than most of the sample. A row with a null id is kept, counts
as no one's link and has a null component. Of rows with equal ids, each counts and
has the links of its own vector. Other columns are not read. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.columns import giving_back
from folioforge.llm.components import connected_components
from folioforge.llm.workspace import Workspace

SAMPLE = 4096
BLOCK_BYTES = 1 << 24  # of vectors in a block at most
LEAST_BLOCK = 2048  # vectors, unless that is more than a block may have
STRIP = 512
#: Lists of components up to this many (16 bytes each) are sent to every executor; longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000
BOX = 8
LEVELS = 10  # of the splitting tree at most: 2**10 regions, so 2**20 pairs of regions
SLACK = 1e-12


@dataclass(frozen=True)
class Basis:
    """Rotation (columns: principal directions, leading first) and the splitting tree, level by level."""

    rotation: np.ndarray
    axes: list[np.ndarray]
    cuts: list[np.ndarray]

    @property
    def dim(self) -> int:
        return len(self.rotation)

    def region(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each rotated vector."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for axis, cut in zip(self.axes, self.cuts, strict=True):
            at = 2 * at + (x[rows, axis[at]] > cut[at])
        return at


def unit_rows(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can be compared, their unit vectors) of a list column; without ``dim`` of the most frequent length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if dim is None:
        seen, times = np.unique(sizes[sizes > 0], return_counts=True)
        dim = int(seen[times.argmax()]) if len(seen) else 0
    rows = np.flatnonzero(sizes == dim) if dim else np.zeros(0, np.int64)
    if not len(rows):
        return rows, np.zeros((0, dim))
    values = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
    x = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    top = np.abs(x).max(axis=1)
    ok = np.isfinite(top) & (top > 0)
    rows, x = rows[ok], x[ok] / top[ok, None]  # keeps the norm of huge and tiny vectors finite
    return rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_basis(sample: np.ndarray, levels: int) -> Basis:
    """Principal directions of the second moments, and a tree of median cuts along the widest axes."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    rotation = np.ascontiguousarray(vectors[:, ::-1])
    x = sample @ rotation
    axes, cuts, at = [], [], np.zeros(len(x), np.int64)
    for level in range(levels):
        axis, cut = np.zeros(1 << level, np.int64), np.zeros(1 << level)
        for k in range(1 << level):
            own = x[at == k][:, :BOX]
            if len(own):
                axis[k] = np.argmax(own.max(axis=0) - own.min(axis=0))
                cut[k] = np.median(own[:, axis[k]])
        axes.append(axis)
        cuts.append(cut)
        at = 2 * at + (x[np.arange(len(x)), axis[at]] > cut[at])
    return Basis(rotation, axes, cuts)


def gap2(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Least squared distance between boxes."""
    d = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return (d * d).sum(axis=-1)


def tile_links(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of u, row of v) with product of at least the threshold; x and y are the same vectors turned, of which the leading components come first."""
    dim = x.shape[1]
    steps = sorted({min(BOX, dim), min(3 * BOX, dim)})
    lead = steps[0]
    part = x[:, :lead] @ y[:, :lead].T
    rest_x, rest_y = (np.sqrt((w[:, lead:] ** 2).sum(axis=1)) for w in (x, y))
    i, j = np.nonzero(part + rest_x[:, None] * rest_y[None, :] >= threshold - SLACK)
    if len(i) > 0.02 * part.size:
        return np.nonzero(u @ v.T >= threshold)
    value = part[i, j]
    for a, b in zip(steps, steps[1:], strict=False):
        value = value + np.einsum("ij,ij->i", x[i, a:b], y[j, a:b])
        rx, ry = (np.sqrt((w[:, b:] ** 2).sum(axis=1)) for w in (x, y))
        ok = value + rx[i] * ry[j] >= threshold - SLACK
        i, j, value = i[ok], j[ok], value[ok]
    ok = np.einsum("ij,ij->i", u[i], v[j]) >= threshold
    return i[ok], j[ok]


def strip_order(x: np.ndarray) -> np.ndarray:
    """An order of turned vectors in which each run of ``STRIP`` lies close together: halves along the widest leading axis, again and again."""
    order, todo, done = np.arange(len(x)), [(0, len(x))], []
    while todo:
        a, b = todo.pop()
        if b - a <= STRIP:
            done.append((a, b))
            continue
        own = x[order[a:b], :BOX]
        axis = np.argmax(own.max(axis=0) - own.min(axis=0))
        half = max(1, (b - a) // STRIP // 2) * STRIP
        order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
        todo += [(a, a + half), (a + half, b)]
    return order


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after joining a with b: each is the least of its component."""
    while len(a):
        la, lb = label[a], label[b]
        least = np.minimum(la, lb)
        before = label.copy()
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        label = label[label]
        if (label == before).all():
            break
    while (label[label] != label).any():
        label = label[label]
    return label


def block_links(us: np.ndarray, vs: np.ndarray | None, weight_x: np.ndarray, weight_y: np.ndarray | None, rotation: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weighted links, local component) of the unit vectors us, then of vs; vs None: within us."""
    same = vs is None
    xs = us @ rotation
    if same:
        vs, ys, weight_y = us, xs, weight_x
    else:
        ys = vs @ rotation
    nx = len(xs)
    n = nx if same else nx + len(ys)
    links, label = np.zeros(n, np.int64), np.arange(n)
    shift = 0 if same else nx

    def strips(x: np.ndarray, u: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        order = strip_order(x)
        parts = [(r := order[s : s + STRIP], x[r], u[r]) for s in range(0, len(order), STRIP)]
        return parts, np.array([p[:, :BOX].min(axis=0) for _, p, _ in parts]), np.array([p[:, :BOX].max(axis=0) for _, p, _ in parts])

    far = 2 - 2 * threshold + SLACK
    left, lo_l, hi_l = strips(xs, us)
    right, lo_r, hi_r = (left, lo_l, hi_l) if same else strips(ys, vs)
    for a, (rows_a, x, u) in enumerate(left):
        for c in np.flatnonzero(gap2(lo_l[a], hi_l[a], lo_r, hi_r) <= far).tolist():
            if same and c < a:
                continue
            rows_c, y, v = right[c]
            i, j = tile_links(x, y, u, v, threshold)
            if same and c == a:
                i, j = i[i < j], j[i < j]
            i, j = rows_a[i], rows_c[j]
            if not len(i):
                continue
            links[:nx] += np.bincount(i, weight_y[j], nx).astype(np.int64)
            links[shift : shift + len(ys)] += np.bincount(j, weight_x[i], len(ys)).astype(np.int64)
            label = _roots(n, i, j + shift, label)
    return links, label


def similar_vectors(table: DataFrame, ws: Workspace, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``table``."""
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"))
    picked = rows.filter("v is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v")
    _, sample = unit_rows(picked) if len(picked) else (None, np.zeros((0, 1)))
    count = rows.count()
    basis = None
    if len(sample):
        most = max(1, BLOCK_BYTES // (8 * sample.shape[1]))
        cores = table.sparkSession.sparkContext.defaultParallelism
        # blocks of a full grid of pairs with two tasks for each core, unless a block would be too large
        blocks = max(-(-count // most), min(-(-count // min(LEAST_BLOCK, most)), int(np.ceil(np.sqrt(4 * cores)))))
        size = -(-max(count, 1) // blocks)
        basis = fit_basis(sample, min(LEVELS, int(np.log2(blocks))))
    lead = min(BOX, basis.dim) if basis else 0

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ok, x = unit_rows(batch.column("v"), basis.dim) if basis else (np.zeros(0, np.int64), np.zeros((0, 1)))
            turned = x @ basis.rotation if basis else x
            x = x + 0.0  # no negative zeros: equal vectors have equal bytes
            digest: list[bytes | None] = [None] * n
            vector: list[bytes | None] = [None] * n
            region = np.full(n, -1)
            if len(ok):
                region[ok] = basis.region(turned)
            for i, u in zip(ok.tolist(), x, strict=True):
                vector[i] = u.tobytes()
                digest[i] = hashlib.blake2b(vector[i], digest_size=16).digest()
            box = np.zeros((n, BOX))
            if len(ok):
                box[ok, :lead] = turned[:, :lead]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digest, pa.binary()), pa.array(vector, pa.binary()), pa.array(region, pa.int32()), *(pa.array(np.ascontiguousarray(box[:, k])) for k in range(BOX))], ["vec_id", "digest", "x", "region", *(f"c{k}" for k in range(BOX))])

    boxes = ", ".join(f"c{k} double" for k in range(BOX))
    turned = ws.save(rows.mapInArrow(giving_back(turn), f"vec_id bigint, digest binary, x binary, region int, {boxes}"), "turned")
    good = turned.filter("vec_id is not null and digest is not null")
    # the numbers of the classes are fixed once they are written
    classes = good.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = ws.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = good.withColumnRenamed("vec_id", "least").join(classes, ["least", "digest"]).dropDuplicates(["rep"])
    reps = ws.save(reps.select("rep", "weight", "x", "region", *(f"c{k}" for k in range(BOX))), "representatives")
    info = reps.groupBy("region").agg(F.count("*").alias("n"), *(f(f"c{k}").alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in range(BOX))).orderBy("region").collect()
    parts = {r["region"]: -(-r["n"] // min(2 * size, most)) for r in info}  # medians are of a sample: a region may have more than a block's share
    names = np.array([r["region"] for r in info])
    lo, hi = (np.array([[r[f"{f}{k}"] for k in range(BOX)] for r in info]).reshape(-1, BOX) for f in ("min", "max"))
    partners = []  # at most 2**LEVELS squared rows
    for p in range(len(names)):
        near = np.flatnonzero(gap2(lo[p], hi[p], lo, hi) <= 2 - 2 * threshold + SLACK)
        partners += [(int(names[p]), int(names[q]), parts[int(names[p])], parts[int(names[q])]) for q in near]
    spark = table.sparkSession
    near = spark.createDataFrame(partners, "region int, other int, parts int, other_parts int")
    block = reps.join(F.broadcast(near), "region").withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    own, other = F.struct("region", "part"), F.struct(F.col("other").alias("region"), F.col("other_part").alias("part"))
    work = block.select(F.least(own, other).alias("l"), F.greatest(own, other).alias("r"), (own > other).alias("side"), "rep", "weight", "x")
    work = work.select(F.col("l.region").alias("lr"), F.col("l.part").alias("lp"), F.col("r.region").alias("rr"), F.col("r.part").alias("rp"), "side", "rep", "weight", "x")
    keys = ["lr", "lp", "rr", "rp"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table) -> pa.RecordBatch:
            ids, weight, side = (t.column(c).to_numpy() for c in ("rep", "weight", "side"))
            x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(len(ids), -1)
            twins = all(t.column(a)[0].equals(t.column(b)[0]) for a, b in (("lr", "rr"), ("lp", "rp")))
            k = len(ids) if twins else int((~side).sum())
            n, root = block_links(x[:k], None if twins else x[k:], weight[:k], None if twins else weight[k:], basis.rotation, threshold)
            hit = n > 0
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, root, ids)
            return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit]), pa.array(least[root][hit])], ["rep", "n", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            new = np.any([np.diff(held.column(c).to_numpy()) != 0 for c in keys], axis=0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield done(held.slice(a, b - a).combine_chunks())
            held = held.slice(cuts[-1])
        if held is not None:
            yield done(held.combine_chunks())

    pairs = work.repartition(*keys).sortWithinPartitions(*keys, "side", "rep").mapInArrow(giving_back(solve), "rep bigint, n bigint, root bigint")
    found = ws.save(pairs, "links")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), ws).withColumnRenamed("id", "rep")
    linked = classes.select("rep", "least").join(labels, "rep")
    least = ws.save(linked.groupBy("component").agg(F.min("least").alias("c")), "least")
    # sent out where it can be: a shuffle by component would put a large one into one task
    least = linked.join(F.broadcast(least) if least.count() <= BROADCAST_IDS else least, "component").select("rep", "c")
    named = classes.join(links, "rep", "left").join(least, "rep", "left").select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("c", "least").alias("c"))
    out = turned.select("vec_id", "digest").join(named, "digest", "left")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("c", "vec_id"))
    return out.select("vec_id", F.when(known, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
