"""Verification of sections against their pages, and repair in bounded passes.

Sections are (doc_id, ord, structure, title, physical_index). A pass works on a
snapshot: all relocations follow from its input. The passes are unrolled into
one plan; nothing runs on the driver. Windows are short, so pages are met by equi-joins on
(document, page), however many pages a document has.

A section whose page is null or doesn't exist, and one with a null title, is wrong; repeated
rows give repeated results as long as (doc_id, ord) is a key; documents without pages lose
their sections in the search windows; no rows give no rows. Other columns of pages are not read;
of sections those named ``content``, ``found`` or ``page`` must not be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import TreeConfig
from folioforge.functions import text as T


def string_check(title: Column, content: Column) -> Column:
    """Does the page hold the title, but for case and white space? False without a page."""
    return F.coalesce(T.normalize(content).contains(T.normalize(title)), F.lit(False))


def verify_sections(sections: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Sections with ``ok``: the stated page exists and holds the title. ``doc``: where sections name the document of ``pages``."""
    at = pages.select(F.col("doc_id").alias("_doc"), F.col("page").alias("physical_index"), "content")
    rows = sections.withColumn("_doc", F.col(doc)).join(at, ["_doc", "physical_index"], "left").withColumn("ok", string_check(F.col("title"), F.col("content")))
    return rows.select(*(c for c in sections.columns if c != "ok"), "ok")


def search_windows(checked: DataFrame, totals: DataFrame, radius: int, start_index: int = 1) -> DataFrame:
    """``checked`` (with ``ok``) and the pages (win_start, win_end) to search for each row.

    Between the nearest rows that aren't wrong, before and after in list order, and within
    the radius. ``totals``: (doc_id, total_pages).
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    right = F.when(F.col("ok"), F.col("physical_index"))
    rows = checked.join(totals, "doc_id")
    before = F.coalesce(F.last(right, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(start_index))
    after = F.coalesce(F.first(right, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), F.col("total_pages") + (start_index - 1))
    rows = rows.withColumns({"before": before, "after": after})
    return rows.withColumns(
        {
            "win_start": F.greatest("before", F.col("physical_index") - radius, F.lit(start_index)),
            "win_end": F.least("after", F.col("physical_index") + radius, F.col("total_pages") + (start_index - 1)),
        }
    ).drop("before", "after")


def in_windows(rows: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``rows`` with (win_start, win_end), once for each page of their window, with ``page`` and ``content``."""
    each = rows.filter("win_start <= win_end").withColumn("_doc", F.col(doc)).withColumn("page", F.explode(F.sequence("win_start", "win_end")))
    return each.join(pages.select(F.col("doc_id").alias("_doc"), "page", "content"), ["_doc", "page"]).drop("_doc")


def fix_pass(checked: DataFrame, pages: DataFrame, totals: DataFrame, radius: int, start_index: int = 1, doc: str = "doc_id") -> DataFrame:
    """One pass: each wrong row moves to the first page of its window that holds its title, and is checked again."""
    columns = checked.columns
    rows = search_windows(checked, totals, radius, start_index)
    wrong = rows.filter(~F.col("ok")).select("doc_id", "ord", "title", "win_start", "win_end")
    near = in_windows(wrong, pages, doc).filter(string_check(F.col("title"), F.col("content")))
    moved = near.groupBy("doc_id", "ord").agg(F.min("page").alias("found")).filter("found > 0")
    # a row that moved holds its title by the search; one that didn't was wrong and stays so
    out = rows.join(moved, ["doc_id", "ord"], "left")
    return out.withColumn("physical_index", F.when(~F.col("ok"), F.coalesce("found", "physical_index")).otherwise(F.col("physical_index"))).withColumn("ok", F.col("ok") | F.col("found").isNotNull()).select(columns)


def verify_and_fix(sections: DataFrame, pages: DataFrame, totals: DataFrame, config: TreeConfig = TreeConfig(), start_index: int = 1, doc: str = "doc_id") -> DataFrame:
    """Sections with repaired pages and ``ok``; rows that stay wrong are kept as they are."""
    checked = verify_sections(sections, pages, doc).select("doc_id", "ord", "structure", "title", "physical_index", "ok")
    for _ in range(config.max_fix_attempts):
        checked = fix_pass(checked, pages, totals, config.fix_search_radius, start_index, doc)
    return checked
