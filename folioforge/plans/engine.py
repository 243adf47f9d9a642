"""The engine: pages to trees, trees to a wiki, questions to answers, over all documents at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.config import TreeConfig
from folioforge.functions import text as T
from folioforge.log import get_logger
from folioforge.operators import ask as A
from folioforge.operators import concepts as C
from folioforge.operators import expand, render, sections, summarize, tree, verify, wiki
from folioforge.plans import model_steps as M
from folioforge.plans.backends import HttpBackend
from folioforge.plans.storage import checkpointed
from folioforge.sources import pages as sources


log = get_logger("engine")


@dataclass(frozen=True)
class Build:
    """Tables of built documents: docs (doc_id, doc_name, description, n_pages), pages, nodes."""

    docs: DataFrame
    pages: DataFrame
    nodes: DataFrame


@dataclass(frozen=True)
class Wiki:
    """Tables of a compiled wiki and its files (path, content)."""

    build: Build
    plan: DataFrame
    concepts: DataFrame
    wanted: DataFrame
    files: DataFrame


class WikiEngine:
    """Entry points. Without a backend the rules are used: deterministic stand-ins for a model's answers.

    With one it is asked for sections (also of large nodes), checks, relocations, summaries,
    descriptions, overviews, plans, concept pages and answers. ``count_tokens`` is a Column function
    from a page's text to its tokens; by default twice its words.
    """

    def __init__(self, spark: SparkSession, config: TreeConfig = TreeConfig(), backend: HttpBackend | None = None, count_tokens: Callable[[Column], Column] = T.token_count) -> None:
        self.spark = spark
        self.count_tokens = count_tokens
        self.config = config
        self.backend = backend

    def pages(self, docs: DataFrame, words_per_page: int = 500) -> DataFrame:
        """Pages of documents (doc_id, text), or of ready-made pages (doc_id, texts)."""
        if "texts" in docs.columns:
            return sources.from_texts(docs)
        if "text" in docs.columns:
            return sources.from_text(docs, words_per_page)
        raise ValueError("documents need a column texts or text")

    def build(self, docs: DataFrame, words_per_page: int = 500) -> Build:
        """Trees with summaries and descriptions of documents (doc_id, doc_name, text or texts)."""
        log.info("build: pages and sections")
        pages = checkpointed(self.pages(docs, words_per_page))
        names = docs.select("doc_id", "doc_name")
        # a document without a page has a section all the same
        totals = checkpointed(names.join(pages.groupBy("doc_id").agg(F.max("page").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("total_pages")))
        counts = checkpointed(pages.select("doc_id", "page", self.count_tokens(F.col("content")).alias("tokens")))
        c, model = self.config, self.backend
        if model:
            generate = lambda p, _, n: M.generate(p, model, c.max_tokens_per_group, c.page_overlap, c.max_sections, n)
            repair = lambda found, p, t, _, doc="doc_id": M.verify_and_fix(found, p, t, model, c.max_fix_attempts, c.fix_search_radius, doc)
        else:
            generate, repair = sections.flat_sections, expand.repair_by_rules
        flat = checkpointed(sections.with_preface(sections.with_fallback(generate(pages, c, counts), names)))
        fixed = repair(flat, pages, totals, c, "doc_id")
        log.info("build: tree, expansion, summaries")
        nodes = expand.expand_large_nodes(tree.build_tree(checkpointed(fixed.drop("ok")), totals), pages, totals, c, counts, generate, repair)
        nodes = M.summaries(summarize.section_text(nodes, pages), model) if model else checkpointed(summarize.add_summaries(nodes, pages))
        told = M.descriptions(nodes, names, model) if model else summarize.descriptions(nodes, names)
        described = names.join(told, "doc_id").join(totals, "doc_id").withColumnRenamed("total_pages", "n_pages")
        return Build(described, pages, nodes)

    def compile(self, build: Build, merge: bool = False, existing: DataFrame | None = None) -> Wiki:
        """Concept pages, links and files. ``merge``: documents, in order of id, update the concepts of earlier ones.

        ``existing``: files (path, content) of a wiki that this build goes on with: its concepts can be
        updated, linked to and related to, and the files are those of the wiki afterwards.
        """
        log.info("compile: plan and concept pages")
        old = None if existing is None else checkpointed(wiki.read_concepts(existing))
        texts = build.pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "content"))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["content"]), "\n").alias("text"))
        docs = build.docs.join(texts, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
        if self.backend:
            seen = M.overviews(render.summary_pages(build.nodes, build.docs), self.backend)
            briefs = None if existing is None else wiki.concept_briefs(existing).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("b")).head()["b"]
            plan = checkpointed(M.plan(seen, self.backend, briefs or "(none yet)"))
            pages = M.concept_pages(plan, seen, C.known_targets(plan), self.backend, old, None if existing is None else wiki.targets(existing))
        else:
            plan = checkpointed(C.concept_plan(docs, C.term_scores(docs), old, merge or old is not None))
            pages = C.concept_pages(plan, docs, C.known_targets(plan))
        generated = checkpointed(pages)
        pages = checkpointed(C.last_wins(generated))
        wanted = C.related_minus_concepts(plan, pages)
        if existing is not None:
            written = generated.withColumnRenamed("gen_ord", "place")
            wanted = checkpointed(wanted)
            files = wiki.updated_files(existing, build.docs, render.sources_json(build.pages), render.summary_pages(build.nodes, build.docs), written, plan, wanted)
            return Wiki(build, plan, pages, wanted, files)
        files = wiki.wiki_files(build.docs, render.sources_json(build.pages), render.summary_pages(build.nodes, build.docs), pages, wanted)
        return Wiki(build, plan, pages, wanted, files)

    def build_wiki(self, docs: DataFrame, folder: str | None = None, words_per_page: int = 500) -> Wiki:
        """Build and compile; with ``folder`` (shared by driver and executors) the files are written there, onto the wiki that it holds."""
        existing = None
        if folder is not None and (Path(folder) / "index.md").exists():
            existing = checkpointed(sources.read_wiki_files(self.spark, folder))
        out = self.compile(self.build(docs, words_per_page), existing=existing)
        if folder is not None:
            log.info("write files below %s", folder)
            # the files are read from the folder that they are written to
            wiki.save_files(checkpointed(out.files), folder)
        return out

    def ask(self, build: Build, questions: DataFrame, cite: bool = True, compiled: Wiki | None = None) -> DataFrame:
        """(q_id, answer, unfetched) for questions (q_id, question); ``unfetched`` lists citations of pages never fetched.

        One retry is made of answers with such citations; as rules repeat themselves theirs drops the marks.
        With a model, ``compiled`` must be given: the model reads its files and pages by tools.
        """
        if self.backend:
            if compiled is None:
                raise ValueError("a model answers from a compiled wiki")
            pages = build.pages.join(build.docs.select("doc_id", "doc_name"), "doc_id").select("doc_name", "page", "content")
            return M.ask(questions, checkpointed(compiled.files), pages, self.backend, cite)
        texts = summarize.section_text(build.nodes, build.pages)
        ranked = checkpointed(A.rank_sections(questions, texts))
        found = A.answers(questions, ranked, build.nodes, build.pages, build.docs)
        if not cite:
            return found.select("q_id", F.regexp_replace("answer", r"\s*\\source\{[^}]*\}", "").alias("answer"), F.array().cast("array<string>").alias("unfetched"))
        best = ranked.filter("rank = 1").join(build.nodes.select("doc_id", "path", "start_index", "end_index"), ["doc_id", "path"]).join(build.docs.select("doc_id", "doc_name"), "doc_id")
        spec = F.concat(F.col("start_index").cast("string"), F.lit("-"), F.col("end_index").cast("string"))
        calls = best.select("q_id", F.lit(1).alias("call_ord"), F.lit("get_page_content").alias("tool_name"), F.create_map(F.lit("doc_name"), F.col("doc_name"), F.lit("pages"), spec).alias("tool_args"))
        bad = A.unfetched_citations(A.cited_pages(found), A.fetched_pages(calls)).groupBy("q_id").agg(F.array_sort(F.collect_list("citation")).alias("bad"))
        rows = found.join(bad, "q_id", "left")
        again = F.when(F.col("bad").isNotNull(), F.regexp_replace("answer", r"\s*\\source\{[^}]*\}", "")).otherwise(F.col("answer"))
        return rows.select("q_id", F.when(again == "", F.col("answer")).otherwise(again).alias("answer"), F.coalesce("bad", F.array().cast("array<string>")).alias("unfetched"))

    def describe(self, build: Build) -> str:
        """The outlines of the documents as one text, in order of id."""
        return "\n\n".join(r["outline"] for r in tree.outlines(build.nodes, build.docs).orderBy("doc_id").toLocalIterator())
