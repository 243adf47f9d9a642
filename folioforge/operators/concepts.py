"""Concepts of documents: plan, pages, link whitelist, merging.

The plan is (doc_id, doc_name, action, pos, name, title) with the actions create,
update and related. Documents have an order, ``doc_id``: a concept that an earlier
document planned is updated by a later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T

#: Terms that a document plans, and terms by which it relates to concepts of others.
PLANNED, RELATED = 5, 20


def term_scores(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, score) of words of four ASCII letters or more; score is tf times the log of inverse frequency."""
    terms = F.regexp_extract_all(T.lower(F.col(text_col)), F.lit(r"[a-z]{4,}"), F.lit(0))
    tf = docs.select("doc_id", F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.count()
    scored = tf.join(df, "term")
    return scored.select("doc_id", "term", "tf", F.round(F.col("tf") * F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)), 6).alias("score"))


def concept_plan(docs: DataFrame, scores: DataFrame, existing: DataFrame | None = None, merge: bool = True) -> DataFrame:
    """Plan of each document by the rule backend.

    The best terms are planned: created by the first document that has them, updated by
    later ones (always created if not ``merge``) and by all if in ``existing`` (slug).
    Good terms that are concepts of earlier documents are related.
    """
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term"))
    ranked = scores.withColumn("rank", order).filter(F.col("rank") <= RELATED)
    planned = ranked.filter(F.col("rank") <= PLANNED)
    first = planned.groupBy("term").agg(F.min("doc_id").alias("first_doc"))
    if existing is not None:
        known = existing.select(F.col("slug").alias("term"), F.lit(-1).cast("bigint").alias("first_doc"))
        first = first.unionByName(known).groupBy("term").agg(F.min("first_doc").alias("first_doc"))
    rows = ranked.join(first, "term")
    earlier = F.col("first_doc") < F.col("doc_id")
    action = F.when((F.col("rank") <= PLANNED) & ~(earlier & F.lit(merge)), "create").when(F.col("rank") <= PLANNED, "update").when(earlier & F.lit(merge), "related")
    rows = rows.withColumn("action", action).filter(F.col("action").isNotNull())
    pos = F.row_number().over(Window.partitionBy("doc_id", "action").orderBy("rank"))
    return rows.join(docs.select("doc_id", "doc_name"), "doc_id").select("doc_id", "doc_name", "action", pos.alias("pos"), F.col("term").alias("name"), F.initcap("term").alias("title"), "tf")


def overview(nodes: DataFrame) -> DataFrame:
    """(doc_id, overview): first sentences of the first five root summaries."""
    roots = nodes.filter("tree_depth = 1").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", F.col("summary").alias("s")))).alias("r"))
    parts = F.filter(F.transform(F.slice("r", 1, 5), lambda x: T.first_sentences(x["s"], 1)), lambda s: s != "")
    return roots.select("doc_id", F.array_join(parts, " ").alias("overview"))


def known_targets(plan: DataFrame) -> DataFrame:
    """(doc_id, targets): what a document's own concept pages may link to: planned concepts and its summary.

    Related concepts aren't among them by themselves; pages that exist already are added by
    ``strip_ghosts``, by a join, as there may be any number of them.
    """
    own = plan.filter("action != 'related'").select("doc_id", F.concat(F.lit("concepts/"), T.slug(F.col("name"))).alias("target"))
    rows = own.unionByName(plan.select("doc_id", F.concat(F.lit("summaries/"), "doc_name").alias("target")))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def strip_ghosts(pages: DataFrame, targets: DataFrame, existing: DataFrame) -> DataFrame:
    """``pages`` (doc_id, gen_ord, content, ...) with links outside ``targets`` (doc_id, targets) and ``existing`` (target) as plain text."""
    links = pages.select("doc_id", "gen_ord", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))).alias("target"))
    own = targets.select("doc_id", F.explode("targets").alias("target"))
    ghosts = links.join(own, ["doc_id", "target"], "left_anti").join(existing, "target", "left_anti").groupBy("doc_id", "gen_ord").agg(F.collect_set("target").alias("ghosts"))
    rows = pages.join(ghosts, ["doc_id", "gen_ord"], "left")
    plain = F.aggregate(F.coalesce("ghosts", F.array().cast("array<string>")), F.col("content"), lambda t, x: F.replace(t, F.concat(F.lit("[["), x, F.lit("]]")), x))
    return rows.withColumn("content", plain).select(pages.columns)


def known_targets_text(targets: Column) -> Column:
    """The whitelist as bullets for a prompt."""
    return F.when(F.size(targets) == 0, "(no pages to link to yet)").otherwise(F.array_join(F.transform(F.array_sort(targets), lambda t: F.concat(F.lit("- "), t)), "\n"))


def concept_pages(plan: DataFrame, docs: DataFrame, targets: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, doc_name, gen_ord, slug, brief, content, is_update) by the rule backend.

    Content: up to three sentences with the term, and links to the document and to the
    related concepts; links that aren't allowed become plain text. Creates come before updates.
    """
    related = plan.filter("action = 'related'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: F.concat(F.lit("[[concepts/"), x["name"], F.lit("]]"))), ", ").alias("see"))
    base = docs.select("doc_id", T.sentences(F.col(text_col)).alias("s"))
    rows = plan.filter("action != 'related'").join(base, "doc_id").join(related, "doc_id", "left").join(targets, "doc_id")
    said = F.slice(F.filter("s", lambda x: T.lower(x).contains(F.col("name"))), 1, 3)
    content = F.concat(F.lit("# "), "title", F.lit("\n\n"), F.array_join(said, " "), F.lit("\n\n[[summaries/"), "doc_name", F.lit("]]"), F.coalesce(F.concat(F.lit(", "), "see"), F.lit("")))
    gen = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("action"), "pos"))
    brief = F.concat("title", F.lit(": "), F.col("tf").cast("string"), F.lit(" mentions in "), "doc_name")
    return rows.select("doc_id", "doc_name", gen.alias("gen_ord"), T.slug(F.col("name")).alias("slug"), brief.alias("brief"), T.strip_ghost_links(content, F.col("targets")).alias("content"), (F.col("action") == "update").alias("is_update"))


def last_wins(pages: DataFrame) -> DataFrame:
    """Of pages of one document with one slug the last counts, at the place of the first: (doc_id, doc_name, slug, place, brief, content).

    Grouped, so that what loses is dropped before the shuffle.
    """
    rows = pages.groupBy("doc_id", "slug").agg(F.min("gen_ord").alias("place"), F.max_by(F.struct("doc_name", "brief", "content"), "gen_ord").alias("v"))
    return rows.select("doc_id", "v.doc_name", "slug", "place", "v.brief", "v.content")


def first_wins(pages: DataFrame) -> DataFrame:
    """Of pages of several documents with one slug the first counts: (slug, doc_id, doc_name, place, brief, content)."""
    rows = pages.groupBy("slug").agg(F.min_by(F.struct("doc_id", "doc_name", "place", "brief", "content"), F.struct("doc_id", "place")).alias("v"))
    return rows.select("slug", "v.*")


def related_minus_concepts(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, pos, slug): the document's concepts in order, then related ones that aren't among them."""
    own = pages.select("doc_id", F.col("place").alias("k"), "slug", F.lit(0).alias("part"))
    related = plan.filter("action = 'related'").select("doc_id", F.col("pos").alias("k"), T.slug(F.col("name")).alias("slug"))
    more = related.join(own.select("doc_id", "slug"), ["doc_id", "slug"], "left_anti").withColumn("part", F.lit(1))
    rows = own.unionByName(more)
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "k")).alias("pos"), "slug")


def document_index(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, index): index page of a document built by itself; the description is set off even if empty."""
    line = F.concat(F.lit("- [[concepts/"), "slug", F.lit("]]"), F.when(F.col("brief") != "", F.concat(F.lit(" — "), F.col("brief"))).otherwise(""))
    lines = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("slug", line.alias("line")))).alias("l"))
    rows = docs.select("doc_id", "doc_name", "description").join(lines, "doc_id", "left")
    head = F.concat(F.lit("# Knowledge Base Index\n\n## Documents\n\n- [[summaries/"), "doc_name", F.lit("]] (pageindex) — "), "description", F.lit("\n\n## Concepts\n"))
    return rows.select("doc_id", F.concat(head, F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")), F.lit(""))).alias("index"))
