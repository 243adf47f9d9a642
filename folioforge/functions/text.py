"""Column functions on text: all native but the Unicode slug."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)\s+"
#: Fixed value: the characters of Unicode white space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: White space of the queries' SQL.
ASCII_SPACES = " \t\n\f\r"
UNNAMED = "unnamed-concept"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` made once, also where ``f`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space."""
    # extraction keeps its compiled pattern from row to row; split() would compile it for every text
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def ascii_word_count(text: Column) -> Column:
    """Words told apart by ASCII white space only."""
    return F.size(F.regexp_extract_all(text, F.lit(f"[^{ASCII_SPACES}]+"), F.lit(0)))


def token_count(text: Column) -> Column:
    """Estimate: two tokens a word. Plug a tokenizer in by another count column."""
    return word_count(text) * 2


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(SPACES))


def ascii_strip(text: Column) -> Column:
    """The text without ASCII white space at its ends."""
    return F.btrim(text, F.lit(ASCII_SPACES))


def lower(text: Column) -> Column:
    """Lower case, each character by itself: a capital I with a dot becomes one i, as in the queries' SQL, and not i and a mark."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def normalize(text: Column) -> Column:
    """Runs of white space as one space, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def split_pages(text: Column, words_per_page: int = 500, ascii_spaces: bool = False) -> Column:
    """Pages of whole lines: a page ends with the line on which its words reach the limit.

    Pages are trimmed and empty ones dropped. A fold over the word counts of the lines;
    only integers are carried, the text is cut once at the end. ``ascii_spaces``: only ASCII
    white space parts words and is trimmed.
    """
    counted, trimmed = (ascii_word_count, ascii_strip) if ascii_spaces else (word_count, strip)

    def ends(lines: Column) -> Column:
        return F.aggregate(
            F.transform(lines, counted),
            F.expr("named_struct('n', 0, 'i', 0, 'ends', cast(array() as array<int>))"),
            lambda a, n: F.struct(
                F.when(a["n"] + n >= words_per_page, 0).otherwise(a["n"] + n).alias("n"),
                (a["i"] + 1).alias("i"),
                F.when(a["n"] + n >= words_per_page, F.array_append(a["ends"], a["i"] + 1)).otherwise(a["ends"]).alias("ends"),
            ),
            lambda a: F.when(F.coalesce(F.try_element_at(a["ends"], F.lit(-1)) == a["i"], F.lit(False)), a["ends"]).otherwise(F.array_append(a["ends"], a["i"])),
        )

    def cut(lines: Column) -> Column:
        page = lambda s, e: trimmed(F.array_join(F.slice(lines, s + 1, e - s), "\n"))
        return let(ends(lines), lambda e: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)), e, page))

    return F.filter(let(F.split(text, "\n"), cut), lambda p: p != "")


_NUMBER = r"^\+?[0-9]+(_[0-9]+)*$"


def _number(text: Column) -> Column:
    trimmed = strip(text)
    return F.when(trimmed.rlike(_NUMBER), F.regexp_replace(trimmed, "[+_]", "").try_cast("int"))


def parse_pages(spec: Column) -> Column:
    """Sorted distinct page numbers of a specification such as ``3-5,7``; what isn't a number or a range is ignored."""

    def part(p: Column) -> Column:
        ends = F.split(p, "-")
        lo, hi = _number(F.get(ends, F.lit(0))), _number(F.get(ends, F.lit(1)))
        single = _number(p)
        span = F.when((F.size(ends) == 2) & (lo <= hi), F.sequence(lo, hi))
        return F.coalesce(F.when(p.contains("-"), span).otherwise(F.when(single.isNotNull(), F.array(single))), F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.split(spec, ","), part)), lambda n: n > 0)))


def slug_ascii(name: Column) -> Column:
    """File-safe name, for names in ASCII; native."""
    cut = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_\-]", "-"), r"^-+|-+$", "")
    return F.when(cut == "", UNNAMED).otherwise(cut)


def slug_of(name: str) -> str:
    """File-safe name: compatibility form, every character outside word characters and hyphen as a hyphen."""
    return re.sub(r"[^\w\-]", "-", unicodedata.normalize("NFKC", name)).strip("-") or UNNAMED


@F.pandas_udf(StringType())
def slug(names: pd.Series) -> pd.Series:
    """File-safe name for any script; Unicode normal forms have no native function."""
    return names.map(slug_of, na_action="ignore")


def strip_ghost_links(text: Column, targets: Column) -> Column:
    """Links whose target isn't among ``targets`` become their plain target text."""
    links = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))
    return F.aggregate(links, text, lambda t, x: F.when(F.array_contains(targets, x), t).otherwise(F.replace(t, F.concat(F.lit("[["), x, F.lit("]]")), x)))


def cited_pages(answer: Column) -> Column:
    """(document, pages) of each ``\\source{document, p.3, p.5-6}`` in order; those without document or pages are left out."""
    marks = F.regexp_extract_all(answer, F.lit(r"\\source\{([^}]+)\}"), F.lit(1))

    def one(mark: Column) -> Column:
        parts = F.transform(F.split(mark, ","), strip)
        pages = F.flatten(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: parse_pages(strip(F.regexp_replace(p, r"^p\.", "")))))
        return F.struct(F.get(parts, F.lit(0)).alias("doc_name"), pages.alias("pages"))

    return F.filter(F.transform(marks, one), lambda c: (c["doc_name"] != "") & (F.size(c["pages"]) > 0))


def sentences(text: Column) -> Column:
    """Sentences of a text; one ends with . ! or ? before ASCII white space, or with the text."""
    return F.filter(F.split(F.regexp_replace(ascii_strip(text), rf"([.!?]+)[{ASCII_SPACES}]+", "$1\u0001"), "\u0001"), lambda s: s != "")


def first_sentences(text: Column, n: int) -> Column:
    """The first sentences of a text, joined by a space."""
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def stem(path: Column) -> Column:
    """File name without folders and without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
