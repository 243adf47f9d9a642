"""Sources: pages of documents from texts, text files, PDF files and wiki folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.schema import PAGES, SOURCE_PAGES


def from_texts(docs: DataFrame, id_col: str = "doc_id", texts_col: str = "texts") -> DataFrame:
    """Ready-made pages: an array of texts per document, numbered from 1."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(texts_col).alias("pos", "content")).select("doc_id", (F.col("pos") + 1).alias("page"), "content")


def from_text(docs: DataFrame, words_per_page: int = 500, id_col: str = "doc_id", text_col: str = "text", ascii_spaces: bool = False) -> DataFrame:
    """Pages of plain text, cut at line ends."""
    return from_texts(docs.select(F.col(id_col).alias("doc_id"), T.split_pages(F.coalesce(F.col(text_col), F.lit("")), words_per_page, ascii_spaces).alias("texts")))


def page_text(text: Column, items: Column) -> Column:
    """Text of a decoded page: its own text if it has one, even an empty one, else its items' texts joined by a space."""
    return F.coalesce(text, F.array_join(F.transform(items, lambda i: i["text"]), " "))


def read_text_files(spark: SparkSession, path: str, words_per_page: int = 500) -> DataFrame:
    """Pages of text files; ``doc_id`` is the file's stem."""
    files = spark.read.text(path, wholetext=True).select(T.stem(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))
    return from_text(files, words_per_page)


def read_binary(spark: SparkSession, path: str, decode: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of binary documents such as PDF, by a decoder from bytes to page texts.

    Files are read and decoded on the executors, a file at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["doc_id"], batch["content"], strict=True):
                texts = decode(bytes(content))
                yield pd.DataFrame({"doc_id": [name] * len(texts), "page": range(1, len(texts) + 1), "content": texts})

    files = spark.read.format("binaryFile").load(path).select(T.stem(F.col("path")).alias("doc_id"), "content")
    return files.mapInPandas(run, PAGES.replace("doc_id bigint", "doc_id string"))


def read_page_images(spark: SparkSession, path: str, render: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(doc_id, page, image) of binary documents, by a renderer from bytes to page images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["doc_id"], batch["content"], strict=True):
                images = render(bytes(content))
                yield pd.DataFrame({"doc_id": [name] * len(images), "page": range(1, len(images) + 1), "image": images})

    files = spark.read.format("binaryFile").load(path).select(T.stem(F.col("path")).alias("doc_id"), "content")
    return files.mapInPandas(run, "doc_id string, page int, image binary")


def pdf_decoder(data: bytes) -> list[str]:
    """Page texts of a PDF file, if a public PDF library is installed."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf; pass another decoder to read_binary()") from e
    return [p.extract_text() for p in PdfReader(io.BytesIO(data)).pages]


def read_wiki_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the Markdown files of a wiki folder, paths relative to it."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    base = path.rstrip("/").removeprefix("file:").lstrip("/")
    return raw.select(F.regexp_replace(F.input_file_name(), rf"^.*\Q{base}\E/", "").alias("path"), F.col("value").alias("content"))


def read_source_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a wiki folder's per-document page files."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(f"{path.rstrip('/')}/sources", wholetext=True)
    rows = raw.select(T.stem(F.input_file_name()).alias("doc_name"), F.explode(F.from_json("value", SOURCE_PAGES)).alias("p"))
    return rows.select("doc_name", "p.page", "p.content", "p.images")
