"""Page groups under a token budget, and flat sections.

Pages are (doc_id, page, content). Everything is keyed by document: one exchange
on doc_id serves the folds, windows and range joins that follow. Folds carry
page numbers and token counts only, never content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import TreeConfig
from folioforge.functions import text as T


def tagged(page: Column, content: Column) -> Column:
    """A page between its number tags; the closing tag is spelled like the opening one."""
    tag = F.concat(F.lit("<physical_index_"), page.cast("string"), F.lit(">"))
    return F.concat(tag, F.lit("\n"), content, F.lit("\n"), tag)


def tag_pages(pages: DataFrame, start_index: int = 1) -> DataFrame:
    """(doc_id, page, tagged); numbers run on from ``start_index``."""
    return pages.select("doc_id", "page", tagged(F.col("page") + (start_index - 1), F.col("content")).alias("tagged"))


def _grouped(rows: DataFrame, max_tokens: int, overlap: int) -> DataFrame:
    """(doc_id, p, g): the rows of each document by page, and its groups as ranges [s, e) of places in ``p``.

    ``rows``: (doc_id, page, tokens, ...). The fold carries places and token counts only.
    """
    rest = [c for c in rows.columns if c not in ("doc_id", "page", "tokens")]
    per_doc = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "tokens", *rest))).alias("p"))
    t = "transform(p, x -> cast(x.tokens as bigint))"
    whole = F.expr("array(named_struct('s', 0, 'e', size(p)))")
    if not max_tokens:
        return per_doc.select("doc_id", "p", whole.alias("g"))
    per_doc = per_doc.select("doc_id", "p", F.expr(t).alias("t"), F.expr(f"aggregate({t}, 0L, (a, x) -> a + x)").alias("total"))
    per_doc = per_doc.withColumn("target", F.expr(f"ceil((total / ceil(total / {max_tokens}D) + {max_tokens}) / 2)"))
    fold = F.expr(f"""
        aggregate(
          sequence(0, size(t) - 1),
          named_struct('s', 0, 'n', 0L, 'out', cast(array() as array<struct<s:int,e:int>>)),
          (a, i) -> if(a.n + t[i] > target and i > a.s,
            named_struct(
              's', greatest(i - {overlap}, 0),
              'n', aggregate(slice(t, greatest(i - {overlap}, 0) + 1, i - greatest(i - {overlap}, 0)), 0L, (b, x) -> b + x) + t[i],
              'out', array_append(a.out, named_struct('s', a.s, 'e', i))),
            named_struct('s', a.s, 'n', a.n + t[i], 'out', a.out)),
          a -> array_append(a.out, named_struct('s', a.s, 'e', size(t))))""")
    return per_doc.select("doc_id", "p", F.when(F.col("total") <= max_tokens, whole).otherwise(fold).alias("g"))


def group_ranges(counts: DataFrame, max_tokens: int, overlap: int = 1) -> DataFrame:
    """(doc_id, group_no, first_page, last_page) of each group, from (doc_id, page, tokens).

    One group if all fits; else groups of about equal size: a page that would exceed the
    target starts a new group with the last ``overlap`` pages before it.
    """
    groups = _grouped(counts.select("doc_id", "page", "tokens"), max_tokens, overlap)
    return groups.select("doc_id", "p", F.posexplode("g").alias("group_no", "r")).select("doc_id", "group_no", F.expr("p[r.s].page").alias("first_page"), F.expr("p[r.e - 1].page").alias("last_page"))


def group_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, group_no, text): the tagged pages of each group, joined by a blank line."""
    rows = ranges.select("doc_id", "group_no", F.explode(F.sequence("first_page", "last_page")).alias("page")).join(pages, ["doc_id", "page"])
    joined = rows.groupBy("doc_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("page", tagged(F.col("page"), F.col("content")).alias("t")))).alias("p"))
    return joined.select("doc_id", "group_no", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def section_budget(max_sections: int, groups: Column) -> Column:
    """Sections that each group may have; 0 means no limit."""
    return F.ceil(F.lit(max_sections) / groups).cast("int") if max_sections > 0 else F.lit(0)


def _short(line: Column) -> Column:
    return T.word_count(line).between(1, 6)


def short_lines(content: Column) -> Column:
    """Headings of a page in order, (level, title), where texts mark none: every line of one to six words, all of one level.

    Words are told apart by ASCII white space, and titles lose Unicode spaces but no tabs or returns, as in the queries' SQL.
    """
    words = lambda line: F.size(F.regexp_extract_all(line, F.lit(r"[^ \t\n\f\r]+"), F.lit(0)))
    lines = F.filter(F.transform(F.split(content, "\n"), lambda line: F.btrim(line, F.lit(" \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"))), lambda line: words(line).between(1, 6))
    return F.transform(lines, lambda line: F.struct(F.lit(1).alias("level"), line.alias("title")))


def headings(content: Column) -> Column:
    """Headings of a page in order, (level, title): Markdown, numbered, or a line of one to six words.

    A part of a number has three digits at most, and four parts with three digits in one are an
    address: other figures at the head of a line number no section.
    """

    def one(line: Column) -> Column:
        mark = F.regexp_extract(line, r"^(#{1,6})\s+\S", 1)
        number = F.regexp_extract(line, r"^(?!(?=[0-9.]*[0-9]{3})[0-9]+(?:\.[0-9]+){3}\.?\s)([0-9]{1,3}(?:\.[0-9]{1,3})*)\.?\s+\S", 1)
        level = F.when(mark != "", F.length(mark)).when(number != "", F.size(F.split(number, r"\."))).when(_short(line), 1)
        title = F.when(mark != "", F.regexp_replace(line, r"^#+\s+", "")).when(number != "", F.regexp_replace(line, r"^[0-9.]+\s+", "")).otherwise(line)
        return F.struct(level.alias("level"), T.strip(title).alias("title"))

    return F.filter(F.transform(F.transform(F.split(content, "\n"), T.strip), one), lambda h: h["level"].isNotNull())


def numbered(levels: Column) -> Column:
    """Dotted numbers for a list of heading levels: a counter per level, deeper ones start again; a skipped level counts 0."""
    return F.expr(f"""
        aggregate({levels}, named_struct('c', cast(array() as array<int>), 'out', cast(array() as array<string>)),
          (a, l) -> named_struct(
            'c', transform(sequence(1, l), k -> if(k = l, coalesce(try_element_at(a.c, k), 0) + 1, coalesce(try_element_at(a.c, k), 0))),
            'out', array_append(a.out, array_join(transform(sequence(1, l), k -> if(k = l, coalesce(try_element_at(a.c, k), 0) + 1, coalesce(try_element_at(a.c, k), 0))), '.'))),
          a -> a.out)""")


def flat_sections(pages: DataFrame, config: TreeConfig = TreeConfig(), counts: DataFrame | None = None, rule: Callable[[Column], Column] = headings) -> DataFrame:
    """Flat sections of each document by the rule backend, in the order of groups.

    ``rule`` finds the headings of a page: ``headings``, or ``short_lines`` for texts that mark none.

    Each group numbers its own sections and sees no other group; overlap pages give their
    headings twice, as they would to a model.
    """
    found = pages.select("doc_id", "page", *([] if counts is not None else [T.token_count(F.col("content")).alias("tokens")]), rule(F.col("content")).alias("h"))
    rows = found.join(counts.select("doc_id", "page", "tokens"), ["doc_id", "page"]) if counts is not None else found
    # pages are read once: groups are slices of the headings that the fold's rows carry along
    groups = _grouped(rows, config.max_tokens_per_group, config.page_overlap).select("doc_id", "p", F.posexplode("g").alias("group_no", "r"))
    flat = groups.select("doc_id", "group_no", F.expr("flatten(transform(slice(p, r.s + 1, r.e - r.s), x -> transform(x.h, y -> named_struct('page', x.page, 'level', y.level, 'title', y.title))))").alias("s")).filter(F.size("s") > 0)
    flat = flat.withColumn("n", numbered("transform(s, x -> x.level)"))
    out = flat.select("doc_id", "group_no", "n", F.posexplode("s").alias("pos", "x"))
    out = out.select("doc_id", "group_no", "pos", F.expr("n[pos]").alias("structure"), F.col("x.title").alias("title"), F.col("x.page").alias("physical_index"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("group_no", "pos"))
    return out.select("doc_id", order.alias("ord"), "structure", "title", "physical_index")


def with_fallback(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents (doc_id, doc_name) without a section get one, named after them, on page 1."""
    bare = docs.join(sections.select("doc_id").distinct(), "doc_id", "left_anti")
    return sections.unionByName(bare.select("doc_id", F.lit(1).alias("ord"), F.lit("1").alias("structure"), F.col("doc_name").alias("title"), F.lit(1).alias("physical_index")))


def with_preface(sections: DataFrame, start_index: int = 1) -> DataFrame:
    """Documents whose first listed section starts later get a preface before it."""
    first = sections.groupBy("doc_id").agg(F.min_by("physical_index", "ord").alias("p"), F.min("ord").alias("o")).filter(F.col("p") > start_index)
    return sections.unionByName(first.select("doc_id", (F.col("o") - 1).alias("ord"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(start_index).alias("physical_index")))
