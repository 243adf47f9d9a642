"""Goldens of the wiki operators, derived by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioforge.config import TreeConfig
from folioforge.operators import ask, concepts, expand, render, sections, tree, verify, wiki


def sections_of(spark, rows):
    return spark.createDataFrame([(1, i, s, t, p) for i, (s, t, p) in enumerate(rows, 1)], "doc_id bigint, ord int, structure string, title string, physical_index int")


@pytest.mark.parametrize(
    ("tokens", "most", "overlap", "groups"),
    [([5, 5, 5], 15, 1, [(1, 3)]), ([5, 5, 5, 5, 5, 9], 12, 1, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]), ([20, 1], 12, 0, [(1, 1), (2, 2)])],
)
def test_group_ranges(spark, tokens, most, overlap, groups):
    counts = spark.createDataFrame([(1, i, n) for i, n in enumerate(tokens, 1)], "doc_id bigint, page int, tokens int")
    got = sections.group_ranges(counts, most, overlap).orderBy("group_no").collect()
    assert [(r["first_page"], r["last_page"]) for r in got] == groups


def test_tree_with_colliding_numbers(spark):
    rows = [("1", 1), ("1.1", 3), ("1", 5), ("1.1", 6), ("1.2.1", 7), ("2.1", 4), ("2", 9), ("1.1.1", 8)]
    flat = sections_of(spark, [(s, s, p) for s, p in rows])
    totals = spark.createDataFrame([(1, 11)], "doc_id bigint, total_pages int")
    first = [r["end_index"] for r in tree.end_indices(flat, totals).orderBy("ord").collect()]
    assert first == [2, 4, 5, 6, 7, 8, 9, 11]
    got = tree.build_tree(flat, totals).orderBy("ord").collect()
    assert [list(r["path"])[-2] if len(r["path"]) > 1 else None for r in got] == [None, 1, None, 3, None, None, None, 4]
    assert [r["end_index"] for r in got] == [4, 4, 11, 11, 7, 8, 9, 11]
    assert [r["depth"] for r in got] == [0, 1, 0, 1, 2, 1, 0, 2]


def test_preorder_and_json(spark):
    flat = sections_of(spark, [("1", 'A "q"', 1), ("2", "B", 2), ("1.1", "C", 3)])
    totals = spark.createDataFrame([(1, 3)], "doc_id bigint, total_pages int")
    nodes = tree.build_tree(flat, totals)
    assert [r["structure"] for r in nodes.orderBy("path").collect()] == ["1", "1.1", "2"]
    got = json.loads(tree.node_json(nodes).head()["json"])
    assert got == [{"title": 'A "q"', "start_index": 1, "end_index": 3, "depth": 0, "children": [{"title": "C", "start_index": 3, "end_index": 3, "depth": 1, "children": []}]}, {"title": "B", "start_index": 2, "end_index": 2, "depth": 0, "children": []}]


def test_preface_and_fallback(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id bigint, doc_name string")
    got = sections.with_preface(sections.with_fallback(sections_of(spark, [("1", "A", 3)]), docs)).orderBy("doc_id", "ord").collect()
    assert [tuple(r)[2:] for r in got] == [("0", "Preface", 1), ("1", "A", 3), ("1", "two", 1)]


def test_search_windows(spark):
    stated = [(1, True), (9, False), (4, False), (7, True), (2, False)]
    rows = spark.createDataFrame([(1, i, p, ok) for i, (p, ok) in enumerate(stated)], "doc_id bigint, ord int, physical_index int, ok boolean")
    totals = spark.createDataFrame([(1, 9)], "doc_id bigint, total_pages int")
    got = {r["ord"]: (r["win_start"], r["win_end"]) for r in verify.search_windows(rows, totals, 5).filter("not ok").collect()}
    assert got == {1: (4, 7), 2: (1, 7), 4: (7, 7)}


def test_fix_keeps_what_it_cannot_find(spark):
    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, "Alpha  Beta"), (1, 3, "y")], "doc_id bigint, page int, content string")
    totals = spark.createDataFrame([(1, 3)], "doc_id bigint, total_pages int")
    got = verify.verify_and_fix(sections_of(spark, [("1", "alpha beta", 1), ("2", "gone", 3), ("3", "y", 9)]), pages, totals).orderBy("ord").collect()
    assert [(r["physical_index"], r["ok"]) for r in got] == [(2, True), (3, False), (9, False)]


def test_expand_stops_at_a_level_without_large_leaves(spark):
    text = "Head\n" + "w " * 50
    pages = spark.createDataFrame([(1, p, text.replace("Head", f"Head {p}")) for p in range(1, 9)], "doc_id bigint, page int, content string")
    totals = spark.createDataFrame([(1, 8)], "doc_id bigint, total_pages int")
    nodes = tree.build_tree(sections_of(spark, [("1", "all", 1)]), totals)
    config = TreeConfig(max_pages_per_node=2, max_tokens_per_node=100)
    got = expand.expand_large_nodes(nodes, pages, totals, config).orderBy("path").collect()
    assert [r["title"] for r in got] == ["all", *(f"Head {p}" for p in range(1, 9))]
    assert all(r["depth"] == 0 for r in got)
    # the large leaf is a child here, and no root is large: nothing happens
    nodes = tree.build_tree(sections_of(spark, [("1", "top", 1), ("1.1", "all", 1)]), totals)
    assert expand.expand_large_nodes(nodes, pages, totals, config).count() == 2


def test_render(spark):
    rows = spark.createDataFrame([(1, [1], 1, "A", 1, 2, "s"), (1, [1, 2], 2, "B", 2, 2, "")], "doc_id bigint, path array<int>, tree_depth int, title string, start_index int, end_index int, summary string")
    assert render.render_nodes(rows).head()["body"] == "# A (pages 1–2)\n\nSummary: s\n\n## B (pages 2–2)\n"


def test_unified_index(spark):
    docs = spark.createDataFrame([(1, "d1", "D"), (2, "d2", "")], "doc_id bigint, doc_name string, description string")
    found = spark.createDataFrame([(1, "d1", 1, "z", "bz", ""), (2, "d2", 1, "a", "", ""), (2, "d2", 2, "z", "other", "")], "doc_id bigint, doc_name string, place int, slug string, brief string, content string")
    text = wiki.unified_index(docs, concepts.first_wins(found)).head()["index"]
    assert text.split("\n") == ["# Knowledge Base Index", "", "## Documents", "", "- [[summaries/d1]] (pageindex) — D", "- [[summaries/d2]] (pageindex)", "", "## Concepts", "", "- [[concepts/a]]", "- [[concepts/z]] — bz"]


def test_upsert_twice_is_once_and_keeps_the_place(spark):
    empty = spark.createDataFrame([], "key string, first_seq bigint, last_seq bigint, brief string")
    rows = spark.createDataFrame([("d1", 1, "a"), ("d2", 2, "b"), ("d1", 3, "c")], "key string, seq bigint, brief string")
    once = wiki.upsert(empty, rows, "key")
    got = {r["key"]: (r["first_seq"], r["brief"]) for r in once.collect()}
    assert got == {"d1": (1, "c"), "d2": (2, "b")}
    assert sorted(map(tuple, wiki.upsert(once, rows, "key").collect())) == sorted(map(tuple, once.collect()))


def test_page_content(spark):
    pages = spark.createDataFrame([("d", i, c) for i, c in enumerate("xyz", 1)], "doc_name string, page int, content string")
    asked = spark.createDataFrame([(1, "d", "3,1"), (2, "d", "9"), (3, "e", "1"), (4, "../x", "1")], "q_id bigint, doc_name string, pages string")
    got = {r["q_id"]: r["result"] for r in ask.page_content(asked, pages).collect()}
    assert got == {1: "[Page 1]\nx\n\n[Page 3]\nz\n\n", 2: "No content found for pages 9 in d.", 3: "File not found: sources/e.json", 4: "File not found: sources/../x.json"}


def test_unfetched(spark):
    answers = spark.createDataFrame([(1, r"A. \source{d1, p.3} B. \source{d2, p.4-5, p.9} C. \source{d3}")], "q_id bigint, answer string")
    fetched = spark.createDataFrame([(1, "d1", 3), (1, "d2", 4)], "q_id bigint, doc_name string, page int")
    got = ask.unfetched_citations(ask.cited_pages(answers), fetched).collect()
    assert [r["citation"] for r in got] == ["d2 p.5,9"]


def test_bullets_below_a_heading(spark):
    rows = spark.createDataFrame([("body\n\n",), ("a\n## Related Documents\n- old\n\n## More",)], "t string")
    got = [r[0] for r in rows.select(wiki.put_bullets(F.col("t"), "## Related Documents", F.array(F.lit("- n")))).collect()]
    assert got == ["body\n\n## Related Documents\n- n\n", "a\n## Related Documents\n- n\n- old\n\n## More"]


def test_prepend_source(spark):
    def put(t):
        return spark.range(1).select(wiki.prepend_source(F.lit(t), F.lit("summaries/d.md"))).head()[0]

    assert put("x") == '---\nsources: ["summaries/d.md"]\n---\n\nx'
    assert put("---\nopen") == "---\nopen"
    assert put('---\nsources: ["a"]\n---\nx') == '---\nsources: ["summaries/d.md", "a"]\n---\nx'
    assert put('---\nbrief: "b"\n---\nx') == '---\nsources: ["summaries/d.md"]\nbrief: "b"\n---\nx'
    assert put('---\nsources: ["summaries/d.md"]\n---\nx') == '---\nsources: ["summaries/d.md"]\n---\nx'
