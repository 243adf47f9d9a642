"""The engine from texts to files and answers, the file sources, the stream and the HTTP backend."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from folioforge import HttpBackend, WikiEngine, read_binary, read_text_files
from folioforge.operators import wiki
from folioforge.sources.pages import read_page_images, read_source_pages, read_wiki_files
from folioforge.streaming.incremental import WikiState, document_entries, run_stream

TEXT = "Rivers\n" + "The river carries gravel. Gravel forms banks.\n" * 20 + "Lakes\n" + "A lake holds water. Water stays.\n" * 20


def documents(spark):
    return spark.createDataFrame([(1, "one", TEXT), (2, "two", TEXT.replace("lake", "pond"))], "doc_id bigint, doc_name string, text string")


def test_build_ask_and_files(spark, tmp_path):
    engine = WikiEngine(spark)
    out = engine.build_wiki(documents(spark), str(tmp_path / "wiki"), words_per_page=60)
    titles = [r["title"] for r in out.build.nodes.filter("doc_id = 1").orderBy("path").collect()]
    assert "Rivers" in titles and "Lakes" in titles
    said = engine.describe(out.build)
    assert said.startswith("# one (") and "\n- **Rivers** (pp. 1–" in said and "# two (" in said
    paths = {str(p.relative_to(tmp_path / "wiki")) for p in (tmp_path / "wiki").rglob("*.*") if not p.name.startswith(".")}
    assert {"index.md", "summaries/one.md", "sources/two.json"} <= paths
    index = (tmp_path / "wiki/index.md").read_text()
    assert "- [[summaries/one]] (pageindex)" in index
    files = read_wiki_files(spark, str(tmp_path / "wiki"))
    assert {r["path"] for r in files.collect()} == {p for p in paths if p.endswith(".md")}
    assert read_source_pages(spark, str(tmp_path / "wiki")).count() == out.build.pages.count()
    # every link leads to a page or is plain text
    targets = {r["target"] for r in wiki.targets(files).collect()}
    links = files.select(F.explode(F.regexp_extract_all("content", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("l")).distinct().collect()
    assert {r["l"] for r in links} <= targets
    got = engine.ask(out.build, spark.createDataFrame([(1, "what does the pond hold")], "q_id bigint, question string")).head()
    assert "\\source{two, p." in got["answer"] and list(got["unfetched"]) == []
    assert "source" not in engine.ask(out.build, spark.createDataFrame([(1, "pond water")], "q_id bigint, question string"), cite=False).head()["answer"]


def test_text_and_binary_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x y\nz\n")
    got = read_text_files(spark, str(tmp_path), 2).orderBy("page").collect()
    assert [tuple(r) for r in got] == [("a", 1, "x y"), ("a", 2, "z")]
    got = read_binary(spark, str(tmp_path), lambda b: b.decode().split("\n")).orderBy("page").collect()
    assert [r["content"] for r in got] == ["x y", "z", ""]
    assert read_page_images(spark, str(tmp_path), lambda b: [b, b]).count() == 2


def test_stream_upserts(spark, tmp_path):
    state = WikiState(spark, str(tmp_path / "state"))
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id bigint, doc_name string, description string").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("doc_id bigint, doc_name string, description string").parquet(source)
    run_stream(stream(), document_entries, state, str(tmp_path / "cp")).awaitTermination(60)
    spark.createDataFrame([(3, "a", "z")], "doc_id bigint, doc_name string, description string").coalesce(1).write.mode("append").parquet(source)
    run_stream(stream(), document_entries, state, str(tmp_path / "cp")).awaitTermination(60)
    got = {r["key"]: (r["first_seq"], r["brief"]) for r in state.version(1).collect()}
    assert got == {"summaries/a": (1, "z"), "summaries/b": (2, "y")}


def serve(reply):
    """(server, address) of a chat endpoint that answers prompts by a function."""

    class Reply(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = json.dumps({"choices": [{"message": {"content": reply(body["messages"][0]["content"])}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Reply)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}/v1"


def test_http_backend(spark):
    server, url = serve(str.upper)
    backend = HttpBackend("m", url)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i bigint, t string")
    assert sorted(map(tuple, backend.answer(rows, F.col("t")).collect())) == [(1, "a", "A"), (2, "b", "B")]
    server.shutdown()


def test_build_with_a_model(spark):
    def reply(prompt: str) -> str:
        if prompt.startswith("List the sections"):
            return json.dumps([{"structure": "1", "title": "Rivers", "physical_index": 1}, {"structure": "2", "title": "Lakes", "physical_index": 1}])
        if prompt.startswith("Does a section"):
            return json.dumps({"is_correct": "Rivers" in prompt.split("\n")[0]})
        if prompt.startswith("On which"):
            page = prompt.split("Lakes\nA ")[0].rsplit("<physical_index_", 1)[1].split(">")[0]
            return json.dumps({"is_correct": True, "physical_index": int(page)})
        if prompt.startswith("Which concept"):
            return json.dumps({"create": [{"name": "gravel bank", "title": "Gravel bank"}], "update": [{"name": "Lake!", "title": "Lake"}], "related": ["x"]})
        if prompt.startswith("Write a Markdown"):
            return json.dumps({"brief": "b", "content": "see [[concepts/gravel-bank]] and [[concepts/none]]"})
        return "Said." if not prompt.startswith("Begin") else "not json {"

    server, url = serve(reply)
    engine = WikiEngine(spark, backend=HttpBackend("m", url))
    out = engine.build_wiki(documents(spark), words_per_page=60)
    nodes = out.build.nodes.filter("doc_id = 1").orderBy("path").collect()
    assert [(r["title"], r["start_index"], r["summary"]) for r in nodes][0] == ("Rivers", 1, "Said.") and nodes[1]["start_index"] > 1
    assert {r["description"] for r in out.build.docs.collect()} == {"Said."}
    files = {r["path"]: r["content"] for r in out.files.collect()}
    assert "see [[concepts/gravel-bank]] and concepts/none" in files["concepts/gravel-bank.md"] and "concepts/Lake.md" in files
    server.shutdown()


def test_documents_without_pages_have_a_section(spark):
    docs = spark.createDataFrame([(1, "full", "Word one.\nMore of it, here."), (2, "empty", ""), (3, "none", None)], "doc_id bigint, doc_name string, text string")
    out = WikiEngine(spark).build_wiki(docs)
    assert sorted((r["doc_id"], r["title"], r["start_index"], r["end_index"]) for r in out.build.nodes.filter("doc_id > 1").collect()) == [(2, "empty", 1, 1), (3, "none", 1, 1)]
    assert {r["doc_name"]: r["n_pages"] for r in out.build.docs.collect()} == {"full": 1, "empty": 0, "none": 0}
    assert {"summaries/empty.md", "summaries/none.md"} <= {r["path"] for r in out.files.collect()}


def test_two_builds_in_sequence(spark):
    """An incremental build by hand: a page is updated, another one created anew, a third related to, a fourth left alone."""
    head = lambda *sources: "---\nsources: [" + ", ".join(f'"summaries/{s}.md"' for s in sources) + ']\nbrief: "b"\n---\n\n'
    existing = [
        ("index.md", "# Knowledge Base Index\n\n## Documents\n- [[summaries/old]] (pageindex) — Old one\n\n## Concepts\n- [[concepts/lake]] — b\n- [[concepts/bank]] — b\n- [[concepts/reed]]\n- [[concepts/tide]] — b\n\n## Explorations\n"),
        ("summaries/old.md", "old summary [[concepts/lake]]"),
        ("concepts/lake.md", head("old") + "Old lake. [[summaries/old]]"),
        ("concepts/bank.md", head("old") + "Old bank."),
        ("concepts/reed.md", head("old") + "Old reed."),
        ("concepts/tide.md", "no head"),
    ]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = wiki.updated_files(
        frame(existing, "path string, content string"),
        frame([(7, "new", "New one")], "doc_id bigint, doc_name string, description string"),
        frame([(7, "[]")], "doc_id bigint, sources string"),
        frame([(7, "new", "new summary")], "doc_id bigint, doc_name string, summary_md string"),
        frame([(7, "new", "bank", 1, "made", "Bank anew.", False), (7, "new", "lake", 2, "more", "New lake. [[summaries/new]]", True), (7, "new", "dam", 3, "", "A dam.", True)], "doc_id bigint, doc_name string, slug string, place int, brief string, content string, is_update boolean"),
        frame([(7, "new", "related", 1, "reed", "Reed")], "doc_id bigint, doc_name string, action string, pos int, name string, title string"),
        frame([(7, 1, "bank"), (7, 2, "lake"), (7, 3, "dam"), (7, 4, "reed")], "doc_id bigint, pos int, slug string"),
    ).collect()
    files = {r["path"]: r["content"] for r in got}
    assert len(files) == len(got)
    assert files == {
        "index.md": "# Knowledge Base Index\n\n## Documents\n- [[summaries/new]] (pageindex) — New one\n- [[summaries/old]] (pageindex) — Old one\n\n## Concepts\n- [[concepts/dam]]\n- [[concepts/lake]] — more\n- [[concepts/bank]] — made\n- [[concepts/reed]]\n- [[concepts/tide]] — b\n\n## Explorations\n",
        "sources/new.json": "[]",
        "summaries/old.md": "old summary [[concepts/lake]]",
        "summaries/new.md": "new summary\n\n## Related Concepts\n- [[concepts/bank]]\n- [[concepts/lake]]\n- [[concepts/dam]]\n- [[concepts/reed]]\n",
        "concepts/lake.md": '---\nsources: ["summaries/new.md", "summaries/old.md"]\nbrief: "more"\n---\n\nNew lake. [[summaries/new]]',
        "concepts/bank.md": '---\nsources: ["summaries/new.md"]\nbrief: "made"\n---\n\nBank anew.\n\n## Related Documents\n- [[summaries/new]]\n',
        "concepts/dam.md": '---\nsources: ["summaries/new.md"]\nbrief: ""\n---\n\nA dam.\n\n## Related Documents\n- [[summaries/new]]\n',
        # named by the related link, so no bullet is added
        "concepts/reed.md": head("new", "old") + "Old reed.\n\nSee also: [[summaries/new]]",
        "concepts/tide.md": "no head",
    }


def test_a_second_build_goes_on_with_the_folder(spark, tmp_path):
    folder = str(tmp_path / "wiki")
    engine = WikiEngine(spark)
    first = documents(spark)
    engine.build_wiki(first.filter("doc_id = 1"), folder, words_per_page=60)
    engine.build_wiki(first.filter("doc_id = 2"), folder, words_per_page=60)
    index = (tmp_path / "wiki/index.md").read_text()
    assert index.index("summaries/two") < index.index("summaries/one")
    gravel = (tmp_path / "wiki/concepts/gravel.md").read_text()
    assert gravel.startswith('---\nsources: ["summaries/two.md", "summaries/one.md"]')
    assert (tmp_path / "wiki/summaries/one.md").exists() and (tmp_path / "wiki/sources/one.json").exists()


def test_ask_a_model(spark):
    def reply(prompt: str) -> str:
        if "never fetched: two p.9" in prompt:
            return "The pond holds water. \\source{two, p.1}"
        if "Question: pond" in prompt:
            if "get_page_content {" in prompt:
                return json.dumps({"answer": "The pond. \\source{two, p.1} \\source{two, p.9}"})
            if "read_file {" in prompt:
                return "Let me see. " + json.dumps({"tool": "get_page_content", "args": {"doc_name": "two", "pages": "1-2"}})
            return json.dumps({"tool": "read_file", "args": {"path": "summaries/two.md"}})
        if "Finish now" in prompt:
            return "No idea."
        return json.dumps({"tool": "list_wiki_files", "args": {"directory": "summaries"}})

    out = WikiEngine(spark).build_wiki(documents(spark), words_per_page=60)
    server, url = serve(reply)
    engine = WikiEngine(spark, backend=HttpBackend("m", url))
    questions = spark.createDataFrame([(1, "pond"), (2, "what else")], "q_id bigint, question string")
    got = {r["q_id"]: (r["answer"], list(r["unfetched"])) for r in engine.ask(out.build, questions, compiled=out).collect()}
    assert got == {1: ("The pond holds water. \\source{two, p.1}", ["two p.9"]), 2: ("No idea.", [])}
    server.shutdown()
