"""From flat sections to a tree: page ranges, parents, paths.

A node's identity is (doc_id, path), path being the list positions from its root
down to itself; ordering by path is the depth-first order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parent_key(structure: Column) -> Column:
    """The number without its last component; null if there is none."""
    return F.when(structure.contains("."), F.nullif(F.regexp_replace(structure, r"\.[^.]*$", ""), F.lit("")))


def end_indices(sections: DataFrame, totals: DataFrame) -> DataFrame:
    """Sections with ``start_index`` and the first ``end_index``: the page before the next listed section, whatever its level."""
    following = F.lead("physical_index").over(Window.partitionBy("doc_id").orderBy("ord"))
    rows = sections.join(totals, "doc_id")
    return rows.withColumns({"start_index": F.col("physical_index"), "end_index": F.greatest(F.col("physical_index"), F.coalesce(following - 1, F.col("total_pages")))}).drop("total_pages")


def parents(sections: DataFrame) -> DataFrame:
    """Sections with ``parent_ord``: the latest earlier row that has the parent's number, null for roots.

    An as-of join by one window: each row appears as a holder of its own number and as a
    seeker of its parent's; within a number the last holder before the seeker is wanted.
    """
    kept = F.struct(*(c for c in sections.columns if c != "doc_id"))
    hold = sections.select("doc_id", F.col("structure").alias("key"), "ord", F.col("ord").alias("holds"), F.lit(None).cast(sections.select(kept.alias("s")).schema["s"].dataType).alias("row"))
    # rows without a parent's number seek under a key that nothing holds, spread by their position
    seek = sections.select("doc_id", F.coalesce(parent_key(F.col("structure")), F.concat(F.lit("\x00"), F.col("ord").cast("string"))).alias("key"), "ord", F.lit(None).cast("int").alias("holds"), kept.alias("row"))
    w = Window.partitionBy("doc_id", "key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    found = hold.unionByName(seek).withColumn("parent_ord", F.last("holds", ignorenulls=True).over(w)).filter(F.col("row").isNotNull())
    return found.select("doc_id", "row.*", "parent_ord")


def build_tree(sections: DataFrame, totals: DataFrame) -> DataFrame:
    """Nodes of the tree of each document: path, ranges, depths. ``totals``: (doc_id, total_pages).

    Paths come from one fold over the parents of a document (a parent is listed before its
    children); a node's end is raised to the largest end below it by one grouped maximum.
    """
    # by their places in the list, so that a parent is found by its place and not searched for
    placed = end_indices(sections, totals).withColumnRenamed("ord", "own").withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("own")))
    rows = parents(placed)
    fields = ["ord", "parent_ord", "own", "structure", "title", "start_index", "end_index"]
    per_doc = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("s"))
    per_doc = per_doc.withColumn("paths", F.expr("aggregate(s, cast(array() as array<array<int>>), (a, x) -> array_append(a, if(x.parent_ord is null, array(cast(x.own as int)), array_append(a[x.parent_ord - 1], cast(x.own as int)))))"))
    nodes = per_doc.select("doc_id", F.inline(F.expr("transform(s, (x, i) -> named_struct('x', x, 'path', paths[i]))"))).select("doc_id", F.col("x.own").alias("ord"), "x.structure", "x.title", "x.start_index", "x.end_index", "path")
    lowest = nodes.select("doc_id", F.explode("path").alias("ord"), "end_index").groupBy("doc_id", "ord").agg(F.max("end_index").alias("last"))
    nodes = nodes.join(lowest, ["doc_id", "ord"])
    return nodes.select(
        "doc_id",
        "ord",
        "path",
        F.slice("path", 1, F.size("path") - 1).alias("parent_path"),
        F.size("path").alias("tree_depth"),
        (F.length("structure") - F.length(F.replace("structure", F.lit("."), F.lit("")))).alias("depth"),
        "structure",
        "title",
        "start_index",
        F.greatest("end_index", "last").alias("end_index"),
    )


def tree_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): one line a node in depth-first order, indented by tree depth, marked by its number's depth."""
    line = F.concat(F.repeat(F.lit("  "), F.col("tree_depth") - 1), F.repeat(F.lit("#"), F.col("depth") + 1), F.lit(" "), F.col("title"), F.lit(" (pages "), F.col("start_index").cast("string"), F.lit("–"), F.col("end_index").cast("string"), F.lit(")"))
    lines = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("l"))
    return lines.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def outlines(nodes: DataFrame, docs: DataFrame, summary_chars: int = 120) -> DataFrame:
    """(doc_id, outline) of documents (doc_id, doc_name, description, n_pages): a nested Markdown list of the sections, with the beginnings of their summaries.

    Null and empty descriptions and summaries leave nothing; a document without nodes has its head only.
    """
    said = F.coalesce(F.col("summary"), F.lit(""))
    brief = F.when(said == "", "").otherwise(F.concat(F.lit(": "), F.when(F.length(said) > summary_chars, F.concat(F.rtrim(F.substring(said, 1, summary_chars)), F.lit("…"))).otherwise(said)))
    pages = F.when(F.col("start_index") == F.col("end_index"), F.format_string("p. %d", "start_index")).otherwise(F.format_string("pp. %d–%d", "start_index", "end_index"))
    item = F.concat(F.lpad(F.lit("- "), F.col("tree_depth") * 2, " "), F.lit("**"), "title", F.lit("** ("), pages, F.lit(")"), brief)
    lists = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", item.alias("item")))).alias("items")).select("doc_id", F.array_join(F.transform("items", lambda x: x["item"]), "\n").alias("list"))
    head = F.concat(F.lit("# "), "doc_name", F.format_string(" (%d pages)", "n_pages"), F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.concat(F.lit("\n\n"), "description")).otherwise(""))
    return docs.join(lists, "doc_id", "left").select("doc_id", F.concat(head, F.coalesce(F.concat(F.lit("\n\n"), "list"), F.lit(""))).alias("outline"))


def node_json(nodes: DataFrame, summary_col: str | None = None) -> DataFrame:
    """(doc_id, json): the nested tree of each document; a summary appears only if it isn't empty.

    Built bottom-up, a grouped concatenation for each level of the deepest tree.
    """
    summary = F.coalesce(F.col(summary_col), F.lit("")) if summary_col else F.lit("")
    rows = nodes.select("doc_id", "path", "parent_path", "tree_depth", "title", "start_index", "end_index", "depth", summary.alias("summary"))
    deepest = rows.agg(F.max("tree_depth")).head()[0] or 0

    def own(children: Column) -> Column:
        quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":|\}$", "")
        tail = F.when(F.col("summary") != "", F.concat(F.lit(',"summary":'), quoted(F.col("summary")))).otherwise(F.lit(""))
        number = lambda c: F.col(c).cast("string")
        return F.concat(F.lit('{"title":'), quoted(F.col("title")), F.lit(',"start_index":'), number("start_index"), F.lit(',"end_index":'), number("end_index"), F.lit(',"depth":'), number("depth"), F.lit(',"children":['), children, F.lit("]"), tail, F.lit("}"))

    below = None
    for level in range(deepest, 0, -1):
        at = rows.filter(F.col("tree_depth") == level)
        if below is not None:
            at = at.join(below, ["doc_id", "path"], "left")
            inner = F.coalesce("inner", F.lit(""))
        else:
            inner = F.lit("")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", own(inner).alias("j")))), lambda x: x["j"]), ",")
        below = at.groupBy("doc_id", F.col("parent_path").alias("path")).agg(joined.alias("inner"))
    if below is None:
        return rows.select("doc_id", F.lit("[]").alias("json")).limit(0)
    return below.select("doc_id", F.concat(F.lit("["), "inner", F.lit("]")).alias("json"))
