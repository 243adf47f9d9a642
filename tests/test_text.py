"""Goldens of the column functions, derived by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("spec", "pages"),
    [("3-5,7,10-12", [3, 4, 5, 7, 10, 11, 12]), ("3-7,12,x,5-3,-2", [3, 4, 5, 6, 7, 12]), ("5-3", []), ("1-2-3", []), ("-5", []), ("abc", []), ("", []), ("0,1, 2 ,2", [1, 2]), ("+3,1_0", [3, 10]), ("99999999999", [])],
)
def test_parse_pages(spark, spec, pages):
    assert one(spark, T.parse_pages(F.lit(spec))) == pages


@pytest.mark.parametrize(("text", "n", "pages"), [("a b\nc d\ne", 3, ["a b\nc d", "e"]), ("a b\n\n", 2, ["a b"]), ("a b c", 1, ["a b c"]), ("a\nb\n", 0, ["a", "b"]), ("", 5, []), (" \n\t", 1, [])])
def test_split_pages(spark, text, n, pages):
    assert one(spark, T.split_pages(F.lit(text), n)) == pages


def test_split_pages_keeps_the_words(spark):
    text = "\n".join("w " * (i % 7) for i in range(60))
    pages = one(spark, T.split_pages(F.lit(text), 10))
    assert " ".join(pages).split() == text.split()


@pytest.mark.parametrize(("name", "slug"), [("attention-mechanism", "attention-mechanism"), ("Self Attention", "Self-Attention"), ("a  b", "a--b"), ("!!", "unnamed-concept"), ("é", "é"), ("x²", "x2")])
def test_slug(spark, name, slug):
    assert one(spark, T.slug(F.lit(name))) == slug
    assert T.slug_of(name) == slug


def test_ghost_links(spark):
    allowed = F.array(F.lit("concepts/a"))
    assert one(spark, T.strip_ghost_links(F.lit("see [[concepts/a]] and [[concepts/b]]"), allowed)) == "see [[concepts/a]] and concepts/b"
    assert one(spark, T.strip_ghost_links(F.lit("[[concepts/a|A]]"), allowed)) == "concepts/a|A"


def test_citations(spark):
    got = one(spark, T.cited_pages(F.lit(r"A. \source{d1, p.3} B. \source{d2, p.4-5, p.9} C. \source{d3} \source{, p.1}")))
    assert [(c["doc_name"], c["pages"]) for c in got] == [("d1", [3]), ("d2", [4, 5, 9])]


def test_normalize_and_stem(spark):
    assert one(spark, T.normalize(F.lit(" A  b\n"))) == "a b"
    assert one(spark, T.stem(F.lit("/x/y.tar.gz"))) == "y.tar"
    assert one(spark, T.first_sentences(F.lit("One. Two! Three"), 2)) == "One. Two!"
