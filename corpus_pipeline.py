"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage gets all that its predecessor kept, and its decisions take effect:
toxic documents, documents of no known language, all but one of each group of
near-duplicates (five-word shingles, similarity 0.8 or more) and documents that
hold benchmark items go; what is left is packed into sequences. All stages but
the last return the columns of documents.

Rows are told apart by more than their id: the near-duplicate stage numbers them,
and the decontamination knows them by their text. So rows with a null id and
different texts of one id are judged by their text like others, and never
dropped for an id. Of each group of near-duplicates the row with the least id
stays (one with a null id only if no other has one). Null and empty texts go with
the language stage; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontam, language_id, minhash, packing, token_count, toxicity
from folioforge.llm.workspace import Workspace

#: Lists of rows up to this many (16 bytes each) are sent to every executor; longer ones are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of ``rows`` (key, row) whose key isn't among ``gone`` (a saved table of one column)."""
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, "key", "left_anti").select("row.*")


def _as_rows(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the others of each row as one column: none of documents can clash with theirs, and no text goes to Python twice."""
    return docs.select("doc_id", "text", "lang", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (text, row) with the columns of ``docs`` again."""
    return rows.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents scored 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(_as_rows(docs), labels, keep=("row", "text"))
    return _as_documents(scored.filter(F.col("predicted") == 0), docs)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without letters, or below the calibrated limits for every language, go."""
    return _as_documents(language_id.identify(_as_rows(docs), keep=("row", "text")).filter(~F.col("rejected")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near-duplicates the document with the least id stays."""
    ws = Workspace(spark, "pipeline-near")
    # the rows' numbers are fixed once they are written
    rows = ws.save(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "rows")
    found = minhash.near_duplicates(rows.select("key", F.col("row.text").alias("text")), ws, k=5, percent=80, id_col="key")
    found = found.select(F.col("doc_id").alias("key"), "component_id").join(rows.select("key", F.col("row.doc_id").alias("id")), "key")
    found = ws.save(found, "components")
    best = found.groupBy("component_id").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("best"), F.count("*").alias("n"))
    best = ws.save(best.filter("n > 1").drop("n"), "best")
    # sent out where it can be: a shuffle by component would put a large one into one task
    best = F.broadcast(best) if best.count() <= BROADCAST_KEYS else best
    return _without(rows, ws.save(found.join(best, "component_id").filter("key != best").select("key"), "gone"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ws = Workspace(spark, "pipeline-leaks")
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b")).alias("key")
    leaks = decontam.find_leaks(docs.select(key, "text"), items, ws, id_col="key").select(F.col("doc_id").alias("key")).distinct()
    return _without(docs.select(key, F.struct("*").alias("row")), ws.save(leaks, "leaks"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token counts, then best-fit packing; one row per piece of a document."""
    counted = token_count.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(counted, Workspace(spark, "pipeline-pack"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: No SQL: the classifiers are fitted and the packing is a fold. The tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read back as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
