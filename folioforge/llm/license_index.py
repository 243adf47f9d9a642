"""License scan by a positional index of rare licence words, in DataFrame functions only.

Each template is a notice with a mandatory key phrase. Indexed are the words of the
key phrases and the rarest other words of each notice, with their positions. A few
words cover all key phrases; a text without any of those can hold no key phrase, so
one cheap test settles most texts. Each template is looked up by its anchor, the word
of its key phrase with the highest inverse document frequency over all texts (whole
words). Every posting of an anchor proposes one placement of its template; postings
of its indexed words are intersected by relative position: those of the key phrase
must all stand there, of the others at least the template's share. Then the whole key
phrase is verified word by word, and the share of all the notice's words that stand in
place must reach the template's least share. Phrases of ``base`` templates count
wherever they stand, whatever surrounds them.

Words are maximal runs of characters other than ASCII controls, punctuation and
space, after A-Z in lower case; positions count from 0.

Defined results: null and empty texts have 0 words, no labels and score 0; null
ids pass through; repeated rows give repeated results (rows are never joined by
id); other columns are not read; an empty table gives no rows. No shuffle but that
of one count per word. The texts are read twice: once for the frequencies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same for texts in any case, as a list of single characters: the JVM makes a bit set of those,
# where ranges are tried one after another.
_GAP = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD_ANY_CASE = f"[^{_GAP}]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A notice; ``key`` counts words of it from ``at`` on."""

    label: str
    words: tuple[str, ...]
    at: int
    key: tuple[str, ...]
    least: float = 0.5  # share of the words that must stand in place; 0 for a base phrase


def template(label: str, notice: str, key: str, least: float = 0.5) -> Template:
    """A template from plain text; the key phrase must occur in the notice."""
    words, wanted = tuple(notice.split()), tuple(key.split())
    at = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
    return Template(label, words, at, wanted, least)


# Well-known licence notices, their labels and mandatory phrases.
TEMPLATES = [
    template("mit", "released under the mit license", "mit license", 0.0),
    template("apache", "licensed under the apache license version 2 0", "apache license", 0.0),
    template("gpl", "this work is licensed under the gnu general public license version 3", "general public license", 0.0),
    template("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "you may not use this file except in compliance with the license"),
    template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "it under the terms of the gnu general public license"),
    template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission is hereby granted free of charge"),
    template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    template("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute"),
    template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
]

def triggers(templates: list[Template]) -> list[str]:
    """A few indexed words of which every key phrase has one: again and again the word that most of the phrases left share."""
    left, out = [[w for w in t.key if w not in COMMON] for t in templates], []
    while left:
        out.append(max(sorted({w for k in left for w in k}), key=lambda w: (sum(w in k for k in left), len(w))))
        left = [k for k in left if out[-1] not in k]
    return out


#: Indexed words of a notice besides those of its key phrase, at most.
PROBES = 6
#: Words too common to be indexed; every key phrase has others.
COMMON = frozenset("a and any by for free in is of or the this to use under with public general software source forms charge copy work 0 2 3 4".split())


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words, without making them."""
    # each word to one "a", each gap to one space: 2 n - 1 characters for n words
    marks = F.trim(F.regexp_replace(F.regexp_replace(text, WORD_ANY_CASE, "a"), "[^a]+", " "))
    return F.floor((F.length(marks) + 1) / 2).cast("bigint")


def probes(t: Template) -> list[int]:
    """Places of a notice's indexed words outside its key phrase: the longest ones, the first place of each."""
    first = {w: i for i, w in reversed(list(enumerate(t.words)))}
    rest = [i for w, i in first.items() if w not in t.key and len(w) >= 6]
    return sorted(rest, key=lambda i: (-len(t.words[i]), i))[:PROBES]


def indexed_words(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.key if w not in COMMON} | {t.words[i] for t in templates for i in probes(t)})


def _places(words: Column, t: Template, df: dict[str, int]) -> Column | None:
    """Verified placements of a template in an array of words; None if its anchor is in no text."""
    rare = [i for i, w in enumerate(t.key) if w not in COMMON]
    at = min(rare, key=lambda i: (df.get(t.key[i], 0), i))
    if not df.get(t.key[at]):
        return None
    posts = F.filter(F.transform(words, lambda w, i: F.when(w == t.key[at], i - at)), lambda p: p.isNotNull() & (p >= 0))
    # the notice's other indexed words, the rarest first
    others = sorted(probes(t), key=lambda i: (df.get(t.words[i], 0), i))

    def aligned(p: Column) -> Column:
        ok = F.lit(True)
        for i in rare:
            ok = ok & (F.get(words, p + i) == t.key[i])
        return F.coalesce(ok, F.lit(False)) & (F.slice(words, p + 1, F.lit(len(t.key))) == F.array(*map(F.lit, t.key)))

    def in_place(p: Column, which: list[int]) -> Column:
        # the notice's places and words as one literal each; get() gives null before the first word and after the last
        pairs = F.arrays_zip(F.array(*(F.lit(i - t.at) for i in which)).alias("i"), F.array(*(F.lit(t.words[i]) for i in which)).alias("w"))
        return F.size(F.filter(pairs, lambda x: F.get(words, p + x["i"]).eqNullSafe(x["w"])))

    def place(p: Column) -> Column:
        return F.struct(F.lit(t.label).alias("label"), p.cast("bigint").alias("at"), F.round(in_place(p, list(range(len(t.words)))) / len(t.words), 6).alias("share"), F.lit(t.least == 0).alias("base"))

    found = F.filter(posts, aligned)
    if t.least and others:
        found = F.filter(found, lambda p: in_place(p, others) >= t.least * len(others))
    return F.filter(F.transform(found, place), lambda x: x["share"] >= t.least)


def scan(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) of every row.

    ``places`` lists (template label, first word of its key phrase, share in place).
    """
    templates = TEMPLATES if templates is None else templates
    index = indexed_words(templates)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def whole(t: Column, w: str) -> Column:
        # looks at a word's surroundings where it occurs at all
        return t.contains(w) & t.rlike(rf"(?<![^{_GAP}]){w}(?![^{_GAP}])")

    def mentions(t: Column) -> Column:
        any_of = F.lit(False)
        for w in triggers(templates):
            any_of = any_of | whole(t, w)
        return any_of

    # bound to a lambda's variable, the text in lower case is made once and not once for each word
    maybe = F.exists(F.array(F.lower(text)), mentions)
    # document frequency of each indexed word, over all texts
    seen = rows.select(F.transform(F.array(F.lower(text)), lambda t: F.array(*(whole(t, w).cast("int") for w in index))).alias("f")).select(F.get("f", F.lit(0)).alias("f"))
    counts = seen.agg(*(F.sum(F.get("f", F.lit(i))).alias(f"n{i}") for i in range(len(index)))).head()
    df = {w: counts[i] or 0 for i, w in enumerate(index)}
    found = [places for t in templates if (places := _places(F.col("words"), t, df)) is not None]
    kind = "array<struct<label:string,at:bigint,share:double,base:boolean>>"
    none = F.array().cast(kind)
    all_places = F.concat(*found).cast(kind) if found else none
    out = rows.select("doc_id", word_count(text).alias("n_words"), F.when(maybe, words_of(text)).otherwise(F.array().cast("array<string>")).alias("words"))
    out = out.select("doc_id", "n_words", F.when(F.size("words") > 0, all_places).otherwise(none).alias("places"))
    base = F.filter("places", lambda p: p["base"])
    at = F.transform(base, lambda p: p["at"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return out.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"), "places")


def oracle_sql(table: str = "documents", templates: list[Template] | None = None) -> str:
    """The same rows without ``places``, by trying every template at every word, for DuckDB."""
    templates = TEMPLATES if templates is None else templates
    values = ", ".join(f"('{t.label}', {list(t.words)!r}, {t.at}, {list(t.key)!r}, {t.least == 0}, {t.least}, {probes(t) if t.least else []!r}::INT[])" for t in templates)
    return f"""
WITH t(label, words, key_at, key, base, least, probes) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM {table}),
r AS (SELECT row_number() OVER () AS r, doc_id, w FROM d),
e AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM r),
c AS (SELECT r.r, t.*, p, w[p + 1 : p + len(key)] AS said, w[greatest(p - key_at, 0) + 1 : p - key_at + len(words)] AS around FROM e JOIN t ON e.word = t.key[1] JOIN r ON r.r = e.r),
m AS (SELECT *, list_transform(list_zip(around, words[greatest(key_at - p, 0) + 1 :]), lambda z: coalesce(z[1] = z[2], false)) AS same, greatest(key_at - p, 0) AS cut FROM c WHERE said = key),
f AS (
  SELECT * FROM (SELECT *, len(list_filter(probes, lambda i: i >= cut AND same[i - cut + 1])) >= least * len(probes) AS met, round(len(list_filter(same, lambda x: x)) / len(words), 6) AS share FROM m)
  WHERE met AND share >= least
)
SELECT doc_id, len(any_value(w)) AS n_words, count(p) FILTER (WHERE base) AS n_base, min(p) FILTER (WHERE base) AS first_word, max(p) FILTER (WHERE base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
FROM r LEFT JOIN f USING (r) GROUP BY r, doc_id"""
