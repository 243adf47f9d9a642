"""Recursive expansion of large leaves.

Nodes without pages are never large; null token counts count as nothing; no nodes give no nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import TreeConfig
from folioforge.functions import text as T
from folioforge.operators import sections as S
from folioforge.operators.tree import build_tree
from folioforge.operators.verify import verify_and_fix
from folioforge.plans.storage import checkpointed


def large_nodes(nodes: DataFrame, counts: DataFrame, config: TreeConfig) -> DataFrame:
    """Leaves that span more pages and hold at least as many tokens as allowed, (doc_id, path, start_index, end_index).

    The cheap tests come first. The tokens of a range are the difference of two running sums, met
    by (document, page); pages are numbered without gaps.
    """
    inner = nodes.select("doc_id", F.col("parent_path").alias("path")).filter(F.size("path") > 0).distinct()
    leaves = nodes.join(inner, ["doc_id", "path"], "left_anti").filter(F.col("end_index") - F.col("start_index") + 1 > config.max_pages_per_node)
    leaves = leaves.select("doc_id", "path", "title", "start_index", "end_index")
    w = Window.partitionBy("doc_id")
    sums = counts.select("doc_id", "page", F.sum("tokens").over(w.orderBy("page")).alias("sum"), F.max("page").over(w).alias("last"))
    first = sums.select("doc_id", (F.col("page") + 1).alias("start_index"), F.col("sum").alias("before"))
    end = sums.select("doc_id", F.col("page").alias("_end"), F.col("sum").alias("upto"))
    rows = leaves.join(sums.select("doc_id", "last").distinct(), "doc_id").withColumn("_end", F.least("end_index", "last")).filter("start_index <= _end")
    rows = rows.join(end, ["doc_id", "_end"]).join(first, ["doc_id", "start_index"], "left")
    large = rows.filter(F.col("upto") - F.coalesce("before", F.lit(0)) >= config.max_tokens_per_node)
    return large.select("doc_id", "path", "title", "start_index", "end_index")


def repair_by_rules(found: DataFrame, pages: DataFrame, totals: DataFrame, config: TreeConfig, doc: str) -> DataFrame:
    """Sections checked and repaired by the rules; ``doc``: where they name the document of ``pages``."""
    return verify_and_fix(found, pages, totals, config, doc=doc)


def _children(large: DataFrame, pages: DataFrame, counts: DataFrame, totals: DataFrame, config: TreeConfig, generate: Callable[..., DataFrame], repair: Callable[..., DataFrame]) -> DataFrame:
    """New nodes below the large ones; a node that would only get one child of its own title gets none."""
    key = F.struct("doc_id", "path")
    part = large.select(F.col("doc_id"), "path", "start_index", "end_index")
    paged = part.select("doc_id", "path", F.explode(F.sequence("start_index", "end_index")).alias("page"))
    own = lambda df: df.join(paged, ["doc_id", "page"]).select(key.alias("doc_id"), *(c for c in df.columns if c != "doc_id"))
    # kept: the repair passes and the tree refer to these rows many times
    found = checkpointed(generate(own(pages), config, own(counts)))
    # sections are checked against the pages of the whole document, which are not copied for each node
    all_pages = large.select("doc_id", "path").join(totals, "doc_id").select(key.alias("doc_id"), "total_pages")
    fixed = checkpointed(repair(found, pages, all_pages, config, "doc_id.doc_id"))
    tree = build_tree(fixed.drop("ok"), large.select(key.alias("doc_id"), F.col("end_index").alias("total_pages")))
    tree = checkpointed(tree)
    roots = tree.filter("tree_depth = 1").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("title").alias("only"))
    roots = roots.join(large.select(key.alias("doc_id"), F.col("title").alias("own")), "doc_id").filter(~((F.col("n") == 1) & (F.col("only") == F.col("own")))).select("doc_id")
    tree = tree.join(roots, "doc_id", "left_semi")
    path = F.concat("doc_id.path", "path")
    return tree.select(F.col("doc_id.doc_id").alias("doc_id"), "ord", path.alias("path"), F.slice(path, 1, F.size(path) - 1).alias("parent_path"), F.size(path).alias("tree_depth"), "depth", "structure", "title", "start_index", "end_index")


def expand_large_nodes(nodes: DataFrame, pages: DataFrame, totals: DataFrame, config: TreeConfig = TreeConfig(), counts: DataFrame | None = None, generate: Callable[..., DataFrame] = S.flat_sections, repair: Callable[..., DataFrame] = repair_by_rules) -> DataFrame:
    """Nodes with large leaves expanded, level by level.

    A list of siblings is worked on only if one of them is large; then the children of all
    of them, old and new, are looked at. ``generate`` and ``repair`` find the sections of a
    large node's pages and check them; the rules by default. Lists without a large member end there, whatever
    lies below. Each level is one bounded plan; a level without large leaves ends the loop.
    """
    counts = counts if counts is not None else pages.select("doc_id", "page", T.token_count(F.col("content")).alias("tokens"))
    nodes = checkpointed(nodes)
    frontier = nodes.filter("tree_depth = 1")
    for level in range(1, config.max_expansion_depth + 1):
        # a node is only a leaf in view of all nodes
        large = checkpointed(large_nodes(nodes, counts, config).join(frontier.select("doc_id", "path"), ["doc_id", "path"], "left_semi"))
        if large.isEmpty():
            break
        lists = large.select("doc_id", F.slice("path", 1, F.size("path") - 1).alias("parent_path")).distinct()
        new = _children(large, pages, counts, totals, config, generate, repair)
        # checkpointed: the plan of a level holds that of the one before several times
        nodes = checkpointed(nodes.unionByName(new))
        members = frontier.join(lists, ["doc_id", "parent_path"], "left_semi").select("doc_id", F.col("path").alias("parent_path"))
        frontier = nodes.join(members, ["doc_id", "parent_path"], "left_semi")
    return nodes
