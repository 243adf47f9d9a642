"""Near-duplicate documents by MinHash, banding, verification and components.

1. One pass makes, for each document, a digest of its word sequence, its number
   of distinct word shingles, the minima of many universal hash functions over
   them, and a key for each band of those minima.
2. Documents with the same words become one class.
3. Classes that share a band key meet in a bucket. Links are looked for in three
   steps, so that no bucket is ever expanded into all its pairs: (a) each class
   with the least class of the bucket it meets most often; (b) the other pairs of
   a class and the least of its buckets, where components still differ; (c) in
   buckets that still hold several components, the pairs between those, compared
   by signature in tiles of bounded size: a component with many members in a
   bucket has blocks of its own, which never meet each other, and the others share
   blocks; the members that have a pair whose
   signatures leave 0.8 possible meet again with their full sets, and each tile
   returns only links that join components.
4. Every link is confirmed on the full shingle sets. Components come from
   alternating large-star and small-star.

A pair at the threshold exactly escapes all bands with probability
(1 - 0.8^6)^42 = 3e-6, and fails the signature test with about the same.

Words are maximal runs of non-space bytes, with A-Z in lower case. A shingle is
held as a 64-bit hash of its words. A class has a number of its own, so rows that
share an id but not their words are told apart.

Defined results: null and empty texts, and texts without words, have no
shingles and link with nothing; with fewer words than a shingle has, the whole
sequence is the one shingle. A row with a null id is kept, links with nothing
and has a null component. Rows are the vertices: of rows that share an id, each
links by its own text and has the least id that it reaches. Repeated rows give
repeated results. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.columns import giving_back, text_slices, utf8
from folioforge.llm.components import connected_components
from folioforge.llm.workspace import Workspace

ROWS = 6
BANDS = 42
HASHES = ROWS * BANDS
TILE = 256
#: Classes up to this many are sent to every executor as a list of ids (8 bytes each); beyond it they are shuffled.
BROADCAST_IDS = 1_000_000

_U64 = np.uint64
_M1, _M2 = _U64(0x9E3779B97F4A7C15), _U64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value of each byte with A-Z folded, is it white space, multipliers, addends, band multipliers)."""
    rng = np.random.default_rng(20240607)
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U64(1)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    a = rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
    return value, space, a, b, rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | _U64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U64(32))
    h = h * _M2
    h ^= h >> _U64(29)
    h = h * _M1
    return h ^ (h >> _U64(32))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * _U64(step & (1 << 64) - 1)])
        step = step * step % (1 << 64)
    return out[:n]


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, from the UTF-8 bytes of all of them."""
    value, space, *_ = _tables()
    n_docs = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n_docs
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    if not len(start):
        return [np.zeros(0, np.uint64)] * n_docs
    # hash of a word: a polynomial in its bytes, from running sums
    sums = np.concatenate([[_U64(0)], np.cumsum(value[data] * _powers(len(data), _BASE))])
    word = _mix((sums[end] - sums[start]) * _powers(len(data), _INVERSE)[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offsets)
    roll = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        roll = roll * _M1 + word[j : j + len(roll)]
    roll = _mix(roll)
    out = []
    for d in range(n_docs):
        a, b = first[d], first[d + 1]
        if b - a >= k:
            out.append(np.unique(roll[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for i in range(a, b):
                h = h * _M1 + word[i]
            out.append(_mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the universal hash functions a * x + b modulo 2 ** 32 over a set."""
    *_, a, b, _ = _tables()
    x = (shingles >> _U64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        low = np.minimum(low, (a[:, None] * x[at : at + 2048][None, :] + b[:, None]).min(axis=1))
    return low


def _sequence_digest(text: bytes) -> bytes:
    """Digest of the words: bytes.split() and bytes.lower() use the same white space and letters as the words' definition."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def _features(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    bands = _tables()[-1]
    for batch in batches:
        for a, b, texts in text_slices(batch, "text"):
            data, offsets = utf8(texts)
            sets = shingle_sets(data, offsets, k)
            keys, sigs, buckets = [], [], []
            whole = data.tobytes()
            for d, s in enumerate(sets):
                if not len(s):
                    keys.append(None), sigs.append(None), buckets.append(None)
                    continue
                low = signature(s)
                keys.append(_sequence_digest(whole[offsets[d] : offsets[d + 1]]))
                sigs.append((low & np.uint32(0xFF)).astype(np.uint8).tobytes())
                with np.errstate(over="ignore"):
                    band = _mix((low.reshape(BANDS, ROWS).astype(np.uint64) * bands).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                buckets.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "n", "key", "sig", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, shingles) of the rows whose words have the digest ``key``."""
    for batch in batches:
        for a, b, texts in text_slices(batch, "text"):
            data, offsets = utf8(texts)
            whole, keys = data.tobytes(), batch.column("key").slice(a, b - a).to_pylist()
            own = pa.array([_sequence_digest(whole[offsets[d] : offsets[d + 1]]) == key for d, key in enumerate(keys)], pa.bool_())
            sets = [s.view(np.int64) for s in shingle_sets(data, offsets, k)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a).filter(own), pa.array(sets, pa.list_(pa.int64())).filter(own)], ["id", "shingles"])


def least_match(percent: int) -> int:
    """Equal minima that a pair at the threshold falls short of with probability below 1e-5."""
    p = percent / 100
    return int(HASHES * p - 4.4 * (HASHES * p * (1 - p)) ** 0.5)


def _similar(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sig_a, sig_b) whose signatures leave the threshold possible."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        ok = pa.array((x == y).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])


TILE_KEYS = ["bucket", "left", "right"]


def _tile_pairs(rows: dict[str, np.ndarray], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, other rows, equal minima) between components in one tile: pairs that meet first in this band and may be similar."""
    sig, bands, label, block = rows["sig"], rows["bands"], rows["label"], rows["block"]
    left, right, band = (int(rows[c][0]) for c in ("left", "right", "band_no"))
    cols = np.flatnonzero(block == right)
    for i in np.flatnonzero(block == left):
        js = cols[cols > i] if left == right else cols
        js = js[label[js] != label[i]]
        if not len(js):
            continue
        met = (sig[js] == sig[i]).sum(axis=1)
        js, met = js[met >= least], met[met >= least]
        if band and len(js):
            # by the keys themselves: remnants of minima may agree where the keys don't
            new = ~(bands[js, :band] == bands[i, :band]).any(axis=1)
            js, met = js[new], met[new]
        if len(js):
            yield i, js, met


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tiles of rows sorted by tile; holds one batch and one tile at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in TILE_KEYS]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
            key = tuple(int(k[a]) for k in keys)
            if held and key != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    out = {c: t.column(c).to_numpy() for c in (*TILE_KEYS, "id", "label", "block", "band_no")}
    bands = t.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    return out | {"sig": np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES), "bands": bands}


def _active(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows of each tile that have a pair to be confirmed: at most the rows it came with."""
    for t in _by_tile(batches):
        if t.num_rows < 2:
            continue
        use = np.zeros(t.num_rows, bool)
        for i, js, _ in _tile_pairs(_columns(t), least):
            use[i] = True
            use[js] = True
        if use.any():
            yield from t.filter(pa.array(use)).to_batches()


def _tile_links(batches: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each tile that join components, fewer than its rows; likely pairs are tried first."""
    for t in _by_tile(batches):
        rows = _columns(t)
        found = list(_tile_pairs(rows, least))
        if not found:
            continue
        a = np.concatenate([np.full(len(js), i) for i, js, _ in found])
        b, met = (np.concatenate([x[k] for x in found]) for k in (1, 2))
        sets = [s.values.to_numpy() for s in t.column("shingles").chunk(0)]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        u, v = [], []
        for k in np.argsort(-met, kind="stable"):
            i, j = int(a[k]), int(b[k])
            x, y = find(int(rows["label"][i])), find(int(rows["label"][j]))
            if x == y:
                continue
            s, o = sets[i], sets[j]
            if 100 * min(len(s), len(o)) < percent * max(len(s), len(o)):
                continue
            common = len(np.intersect1d(s, o, assume_unique=True))
            if 100 * common >= percent * (len(s) + len(o) - common):
                root[max(x, y)] = min(x, y)
                u.append(int(rows["id"][i]))
                v.append(int(rows["id"][j]))
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold, as edges (u, v)."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _tiles(named: DataFrame) -> DataFrame:
    """Members (bucket, band_no, id, label) of buckets with several components, once for each tile that they are in, with (left, right, block).

    A tile is a pair of blocks. A component with more than ``TILE`` members in a bucket has
    blocks of its own, the others share blocks; two blocks of one component make no tile. So
    a bucket of one large component and a few others gives about as many rows as it has members.
    """
    sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("n") <= TILE, F.col("n"))).alias("few")).filter("labels > 1")
    large = sizes.filter(F.col("n") > TILE).join(mixed.select("bucket"), "bucket").select("bucket", F.col("label").alias("own"), F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    shared = mixed.filter("few is not null").select("bucket", F.lit(-1).cast("bigint").alias("own"), F.ceil(F.col("few") / TILE).cast("int").alias("parts"))
    groups = large.unionByName(shared)
    rows = named.join(mixed.select("bucket"), "bucket").join(large.withColumnRenamed("own", "label"), ["bucket", "label"], "left")
    rows = rows.withColumn("own", F.when(F.col("parts").isNull(), F.lit(-1).cast("bigint")).otherwise(F.col("label"))).drop("parts")
    rows = rows.join(groups, ["bucket", "own"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    others = groups.select("bucket", F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other_part"))
    met = rows.join(others, "bucket").filter((F.col("own") != F.col("other")) | (F.col("own") == -1))
    # two blocks whose hashes agree would only be compared once more than needed
    met = met.withColumn("block", F.xxhash64("own", "part")).withColumn("with", F.xxhash64("other", "other_part"))
    return met.select("bucket", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"), "band_no", "id", "label", "block")


def near_duplicates(docs: DataFrame, ws: Workspace, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    least = least_match(percent)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = ws.save(texts.mapInArrow(giving_back(lambda it: _features(it, k)), "doc_id bigint, n bigint, key binary, sig binary, bands array<bigint>"), "features")
    # the numbers of the classes are fixed once they are written
    classes = found.filter("doc_id is not null and key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = ws.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    # one row per class; a row may be repeated
    reps = found.withColumnRenamed("doc_id", "rep").join(classes, ["rep", "key"]).select("id", "rep", "key", "sig", "bands").dropDuplicates(["id"])
    reps = ws.save(reps, "representatives")
    member = reps.select("id", F.posexplode("bands").alias("band_no", "bucket"))
    buckets = member.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("size")).filter("size > 1")
    member = ws.save(member.join(buckets.drop("size"), "bucket"), "members")
    stars = ws.save(member.filter("id != least").groupBy(F.col("id").alias("a"), F.col("least").alias("b")).agg(F.count("*").alias("met")), "stars")
    ids = ws.save(member.select("id").distinct().join(reps.select("id", "rep", "key"), "id"), "candidates")
    few = ids.count() <= BROADCAST_IDS
    source = texts.withColumnRenamed("doc_id", "rep").join(F.broadcast(ids) if few else ids, "rep").select("id", "key", "text")
    sets = ws.save(source.mapInArrow(giving_back(lambda it: _sets(it, k)), "id bigint, shingles array<bigint>").dropDuplicates(["id"]), "shingles")
    sigs = reps.select("id", "sig")

    def with_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose components differ."""
        one = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        two = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        return pairs.join(one, "a", "left").join(two, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def joined(labels: DataFrame, more: DataFrame, name: str) -> DataFrame:
        """Labels after joining components by more links."""
        if more.isEmpty():
            return labels
        known = labels.select(F.col("id").alias("u"), F.col("component").alias("v"))
        return ws.save(connected_components(known.unionByName(more), ws), name)

    # (a) the least class that a class meets most often
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("met", -F.col("b"))).alias("b"))
    links = ws.save(_confirm(best, sets, percent), "links-a")
    labels = ws.save(connected_components(links, ws), "labels-a")
    # (b) the other least classes
    rest = with_labels(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), labels)
    rest = rest.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    rest = ws.save(rest.mapInArrow(giving_back(lambda it: _similar(it, least)), "a bigint, b bigint"), "pairs-b")
    labels = joined(labels, ws.save(_confirm(rest, sets, percent), "links-b"), "labels-b")
    # (c) between the components that are left in a bucket
    named = member.join(labels, "id", "left").select("bucket", "band_no", "id", F.coalesce("component", "id").alias("label"))
    tile = _tiles(named).join(reps.select("id", "sig", "bands"), "id").select(*TILE_KEYS, "band_no", "id", "label", "block", "sig", "bands")
    kind = "bucket bigint, left bigint, right bigint, band_no int, id bigint, label bigint, block bigint, sig binary, bands array<bigint>"
    active = ws.save(tile.repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS, "id").mapInArrow(giving_back(lambda it: _active(it, least)), kind), "active")
    full = active.join(sets, "id").repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS, "id")
    labels = joined(labels, ws.save(full.mapInArrow(giving_back(lambda it: _tile_links(it, least, percent)), "u bigint, v bigint"), "links-c"), "labels-c")
    ws.drop(sets, member, reps)
    # the least id of each component; a class without links stands for itself
    linked = classes.join(labels, "id")
    names = ws.save(linked.groupBy("component").agg(F.min("rep").alias("c")), "least")
    # sent out where it can be: a shuffle by component would put a large one into one task
    names = F.broadcast(names) if names.count() <= BROADCAST_IDS else names
    named = ws.save(classes.join(linked.join(names, "component").select("id", "c"), "id", "left").select("key", F.coalesce("c", "rep").alias("c")), "names")
    out = found.select("doc_id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
