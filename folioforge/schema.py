"""Row types of the wiki tables."""

from __future__ import annotations

PAGES = "doc_id bigint, page int, content string"
SECTIONS = "doc_id bigint, ord int, structure string, title string, physical_index int"
NODES = "doc_id bigint, ord int, path array<int>, parent_path array<int>, tree_depth int, depth int, structure string, title string, start_index int, end_index int"
VERIFY_RESULT = "is_correct boolean, reason string"
LOCATE_RESULT = "is_correct boolean, physical_index int"
SOURCE_PAGES = "array<struct<page:int,content:string,images:array<struct<path:string>>>>"
CONCEPT_PLAN = "doc_name string, action string, pos int, name string, title string"
CONCEPTS = "doc_name string, gen_ord int, slug string, brief string, content string"
WIKI_DICT = f"doc_name string, description string, summary string, sources {SOURCE_PAGES}, concepts map<string,struct<brief:string,content:string>>, related array<string>, index string"
WIKI_FILES = "path string, content string"
TOOL_CALLS = "q_id bigint, call_ord int, tool_name string, tool_args map<string,string>"
ANSWERS = "q_id bigint, question string, answer string"
