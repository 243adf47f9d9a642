"""Token-id files as directly addressable codes (Brisaboa, Ladra, Navarro).

An id is cut into 8-bit chunks, lowest first. Level k holds chunk k of every id
that has more than k chunks, and one continuation bit for each: set if the id
goes on. The rank of a set bit is the id's place in level k + 1, so any id is
found by one look at each level; a directory of running ranks makes that look
constant-time. No block has to be decoded.

File image (all integers little-endian)::

    magic "FDAC" | u32 version | u32 levels | u32 documents | u64 ids
    i64 doc_id[documents] | u8 null_id[documents] | u64 end[documents]     running ends of the documents, in ids
    per level: u64 entries | chunk bytes | bitmap bytes (low bit first) | u32 rank[ceil(bitmap bits / 512) + 1]

Executors and driver need share no local folder: an image is one row of a
Parquet table, written by Spark to whatever store it can reach, and read back
from there. An image holds whole documents and about ``shard_ids`` ids at most
(a longer document has an image of its own).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.bpe import PieceBytes, PieceEncoder, encoding
from folioforge.llm.columns import giving_back, text_slices
from folioforge.llm.workspace import Workspace

MAGIC = b"FDAC"
VERSION = 1
RANK_BITS = 512
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The file image of these documents."""
    values = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    ends = np.cumsum([len(x) for x in ids]).astype("<u8")
    out, rest = [], values
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bitmap) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
        padded[: len(bitmap)] = bitmap
        blocks = _POPCOUNT[padded].reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.tobytes()]
        if not more.any():
            break
        rest = rest[more] >> 8
    head = struct.pack("<4sIIIQ", MAGIC, VERSION, len(out) // 4, len(doc_ids), len(values))
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, names.tobytes(), nulls.tobytes(), ends.tobytes(), *out])


class Image:
    """Reads a file image: single ids, documents, or all of it."""

    def __init__(self, data: bytes) -> None:
        magic, version, levels, docs, self.n_ids = struct.unpack_from("<4sIIIQ", data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = struct.calcsize("<4sIIIQ")
        names = np.frombuffer(data, "<i8", docs, at)
        nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(names, nulls, strict=True)]
        self.ends = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            ranks = np.frombuffer(data, "<u4", -(-n // RANK_BITS) + 1, at)
            at += ranks.nbytes
            self.levels.append((chunks, bitmap, ranks))

    def get(self, i: int) -> int:
        """Id number ``i``, by one look at each of its levels."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                break
            first = i // RANK_BITS * (RANK_BITS // 8)
            i = int(ranks[i // RANK_BITS]) + int(_POPCOUNT[bitmap[first:byte]].sum()) + bin(int(bitmap[byte]) & ((1 << bit) - 1)).count("1")
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        value = np.zeros(self.n_ids, np.uint32)
        where = np.arange(self.n_ids)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value[where] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            where = where[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return value

    def rank(self, level: int, i: int) -> int:
        """Set bits of a level before place ``i``: the directory's entry and the bits of one block."""
        _, bitmap, ranks = self.levels[level]
        byte, bit = divmod(i, 8)
        first = i // RANK_BITS * (RANK_BITS // 8)
        rest = bin(int(bitmap[byte]) & ((1 << bit) - 1)).count("1") if bit else 0
        return int(ranks[i // RANK_BITS]) + int(_POPCOUNT[bitmap[first:byte]].sum()) + rest

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from number ``a`` up to ``b``: those that go on lie side by side in the next level, from the rank of the first."""
        if not 0 <= a <= b <= self.n_ids:
            raise IndexError((a, b))
        value, where = np.zeros(b - a, np.uint32), np.arange(b - a)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if not len(where):
                break
            value[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where = where[more]
            a = self.rank(k, a) if len(where) else 0
            b = a + len(where)
        return value

    def document(self, k: int) -> np.ndarray:
        """Ids of document number ``k`` of this image; no other document is decoded."""
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def encode_text(encoder: PieceEncoder, table: PieceBytes, text: str, width: int) -> bytes:
    """Ids of one text as integers of ``width`` bytes."""
    if encoder.unsettled(text):
        return np.array(encoder.library_ids(text), f"<u{width}").tobytes()
    out = []
    for pieces, mark in encoder.segments(text):
        out.extend(map(table.__getitem__, pieces))
        if mark is not None:
            out.append(encoder.special[mark].to_bytes(width, "little"))
    return b"".join(out)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, ws: Workspace, shard_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """Encode every text, append ``end_id``, and write images in ascending order of id.

    Returns the images as read back, (bucket, start, image), where ``start`` counts the
    ids before the image within its bucket, and the number of ids before each bucket.
    Buckets are ranges of ids, as many as shuffle partitions, cut at quantiles of the id
    column, and each goes to a partition of its own; an id that fills several quantiles is
    spread over as many buckets. The driver holds the bounds and one total per bucket,
    nothing else.

    Defined results: null and empty texts hold ``end_id`` only; a null id sorts first;
    rows with equal ids are ordered by their token ids within a bucket; other columns are
    not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    width = 2 if PieceEncoder(text).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    spec = spark.sparkContext.broadcast(text)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).cast("int").alias("salt"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = narrow.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n)).head()[0] or []
    bounds = np.array(sorted(bounds), np.int64)
    # a whole number for each bucket that the hash of a shuffle deals to the bucket's own partition
    dealt = spark.range(40 * n).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    deal = {r["p"]: r["id"] for r in dealt}
    deals = np.array([deal.get(b, b) for b in range(n)], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = encoding(spec.value, width)
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                ids = batch.column("doc_id").slice(a, b - a)
                known = np.array(ids.fill_null(np.iinfo(np.int64).min))
                bucket = np.searchsorted(bounds, known, "left")
                filled = np.searchsorted(bounds, known, "right") - bucket
                bucket += np.where(filled > 1, batch.column("salt").slice(a, b - a).to_numpy() % np.maximum(filled, 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(deals[bucket], pa.int32()), pa.array(bucket, pa.int32()), ids, pa.array([encode_text(encoder, table, t, width) + end for t in texts.to_pylist()], pa.binary())], ["deal", "bucket", "doc_id", "ids"])

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, np.ndarray]] = []
        bucket, start, size = None, 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([pack([d for d, _ in held], [x for _, x in held])], pa.binary())], ["bucket", "start", "n_ids", "image"])

        for batch in batches:
            for k, d, raw in zip(*(batch.column(c) for c in ("bucket", "doc_id", "ids")), strict=True):
                k, x = k.as_py(), np.frombuffer(raw.as_buffer(), f"<u{width}")
                if held and (k != bucket or size + len(x) > shard_ids):
                    yield flush()
                    start, size, held = start + size, 0, []
                if k != bucket:
                    bucket, start = k, 0
                held.append((d.as_py(), x.copy()))
                size += len(x)
        if held:
            yield flush()

    rows = narrow.mapInArrow(giving_back(encode), "deal int, bucket int, doc_id bigint, ids binary").repartition(n, "deal").sortWithinPartitions("bucket", "doc_id", "ids")
    files = ws.save(rows.mapInArrow(giving_back(images), "bucket int, start bigint, n_ids bigint, image binary"), "token-files")
    totals = {r["bucket"]: r["n"] for r in files.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}
    before = np.concatenate([[0], np.cumsum([totals.get(k, 0) for k in range(len(bounds) + 1)])]).astype(np.int64).tolist()
    return files.select("bucket", "start", "image"), before


def read_documents(files: DataFrame, before: list[int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the images alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, start, data in zip(*(batch.column(c) for c in ("bucket", "start", "image")), strict=True):
                image = Image(data.as_buffer())
                first = before[k.as_py()] + start.as_py()
                starts = np.concatenate([[0], image.ends[:-1]])
                crcs = [zlib.crc32(image.document(d).astype("<u4")) for d in range(len(starts))]
                yield pa.RecordBatch.from_arrays([pa.array(image.doc_ids, pa.int64()), pa.array(starts + first), pa.array(image.ends - starts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(giving_back(decode), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
