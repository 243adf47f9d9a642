"""Figures at the head of a line, and documents over a group's budget, against the SQL of the queries."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from folioforge.operators import sections
from folioforge.plans import catalog

LONG = "\n".join("Chapter\n" + "w " * 99 for _ in range(120))  # 12,000 words, more than 20,000 tokens
TEXTS = [
    "0997523947200283 | chlich. " + "w " * 120 + "\nHead\nbody. " + "w " * 90,
    "Top\n20.118.157.107 Betz +1 (726) 555-7857 das ist ein Satz. Noch einer.\n98.128.108.35 Wort",
    "4.2 a b c d e f g h. More here.\n3 Words",
    LONG,
]
NAMES = ["doc_description", "document_index", "fallback_sections", "flat_sections", "flat_sections_grouped", "index_text", "outline", "overview", "summary_md", "unified_entries", "unified_index", "preface", "section_summaries", "section_text"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_figures_and_long_documents_as_in_sql(spark, folder, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, folder), db.sql(catalog.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_numbers_of_headings(spark):
    lines = ["# A b", "2.10.3 Deep " + "w " * 9, "7. Last " + "w " * 9, "0997523947200283 | no " + "w " * 9, "20.118.157.107 no " + "w " * 9, "1.2.3.4 Fourth", "98.128.108.35 Short"]
    got = spark.range(1).select(sections.headings(F.lit("\n".join(lines))).alias("h")).head()["h"]
    assert [(h["level"], " ".join(h["title"].split()[:1])) for h in got] == [(1, "A"), (3, "Deep"), (1, "Last"), (4, "Fourth"), (1, "98.128.108.35")]


@pytest.mark.parametrize("name", ["flat_sections", "flat_sections_grouped", "fallback_sections", "preface", "section_summaries", "outline", "summary_md"])
def test_white_space_of_headings_as_in_sql(spark, tmp_path, name):
    texts = ["Start\r\n" + "w " * 120 + "\r\nTwo words \r\n\tThree\t\nend.", "x\na\u00a0b c d e f g\nx " + "w " * 9, "x\none\u3000\nx\n\u00a0\nx"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)), db.sql(catalog.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_unified_index_of_odd_texts_as_in_sql(spark, tmp_path):
    spaces = "\t\v\f\r\x1c\x1f\x85   　"
    texts = [f"{c}One two.{c}Three four. " + "word " * 20 + f"\n{c}Tail{c}\n" + c.join(["w"] * 99) + f" a b.\n{c}\nLast one.{c}Not yet.{c}" for c in spaces]
    texts += [" ", "İSTANBUL Kelvin", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["unified_index"](spark, str(tmp_path)).head()["index"]
    assert got.split("\n") == db.sql(catalog.ORACLE_SQL["unified_index"]).fetchall()[0][0].split("\n")
