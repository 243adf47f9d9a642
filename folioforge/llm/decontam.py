"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts and benchmark items become template words: lower-case words, with typed
placeholders for numbers, for units after a number, and for names (words with a
capital first letter, not at the start of a sentence; a run of names is one).
Windows of template words are hashed and joined. Matching windows of a document
and an item that agree on the offset between them form one alignment; its
coverage is the share of the item's windows that match. In an alignment the
values that fill the placeholders of matching windows must be consistent: wherever
the item repeats a value, the document repeats its counterpart. So a question that
has been given other numbers and names is caught, with the values it was given. An
alignment with a value out of line still counts, without the windows that hold
it, if all else in it is verbatim and reaches ``VERBATIM`` coverage.

Items that have at most one window that says something (up to eight template
words, or mostly numbers and names) are looked for in two more ways: word by word
with all values, and read as if they stood within a sentence, where a capital
first word looks like a name ("Question: What ..."); that word must stay the same.

The item table is small; its window hashes are counted, and broadcast only up to
``BROADCAST_WINDOWS``, beyond which the join is shuffled. Documents are read in
one pass for the windows; the texts of documents with an alignment are read
again for its slots.

Defined results: null and empty texts and items match nothing, nor do items with
fewer than ``SHORTEST`` template words or without any plain word. A null id is an
id like others, of documents and of items; rows that share an id are looked at each
by its own text. Repeated rows and ties give one row per document id and item id:
the one with the highest coverage, then verbatim, then the earliest. The windows of
all consistent alignments of a text and an item count together; inconsistent ones
beside them don't hide them. Other columns are not read. ``kind`` is verbatim if
the whole item is there with its values, partial if only a part of it, and
re-parameterised if it has other values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.workspace import Workspace

WINDOW = 8
SHORTEST = 4
VERBATIM = 0.75
BROADCAST_WINDOWS = 2_000_000

# Words that are units when they follow a number.
UNITS = "% percent kg kilogram kilograms g gram grams mg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes km kilometer kilometers kilometre kilometres m meter meters metre metres cm mm mile miles ft foot feet inch inches yard yards s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years l liter liters litre litres ml gallon gallons dollar dollars euro euros cent cents usd eur degree degrees celsius fahrenheit mph kph w kw kwh v hz".split()

_MARK = "\x01"
_NUMBER = r"[0-9]++(?:[.,:/][0-9]++)*+"
#: A unit behind a number that has been marked.
_UNIT = rf"(?<={_MARK} )\s*+(?i:({'|'.join(sorted(UNITS, key=len, reverse=True))}))(?![\p{{L}}\p{{M}}])"
#: A run of capitalised words that does not begin a sentence.
_NAME = r"(?=\p{Lu})(?<=[^\s.!?][ \t]{1,3})((?:\p{Lu}[\p{Ll}\p{M}]++(?:[ \t]++(?=\p{Lu}[\p{Ll}\p{M}]))?)++)(?![\p{L}\p{M}])"
_WORD = r"[\p{L}\p{M}]++(?:['’][\p{L}\p{M}]++)*+"
_TOKEN = rf"{_MARK}[^{_MARK}]*+{_MARK}|{_WORD}"


def _marked(text: Column) -> Column:
    """The text with placeholders between marks: #n, #u, #a, each with its value behind it."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(" "))
    # numbers come first, while there are no values that hold digits
    for kind, pattern in (("n", f"({_NUMBER})"), ("u", _UNIT), ("a", _NAME)):
        out = F.regexp_replace(out, pattern, f" {_MARK}#{kind}$1{_MARK} ")
    return out


def template_words(text: Column) -> Column:
    """Template words of a text in order: the marked text without the values."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(_marked(text), rf"({_MARK}#[nua])[^{_MARK}]++", "$1")), F.lit(_TOKEN), F.lit(0))


def template_slots(text: Column) -> Column:
    """For each template word of a text the value behind a placeholder, null for a plain word."""
    tokens = F.regexp_extract_all(_marked(text), F.lit(_TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.when(t.startswith(_MARK), F.lower(F.substring(t, 4, 1 << 30)).substr(F.lit(1), F.length(t) - 4)))


def windows(words: Column, size: int) -> Column:
    """Hash of each window of ``size`` template words."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(size)), F.lit(size)))).otherwise(F.array().cast("array<bigint>"))


def exact_words(text: Column) -> Column:
    """Words, numbers and percent signs behind numbers of a text in order, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{_NUMBER}|(?<=[0-9]\s{{0,9}})%|{_WORD}"), F.lit(0))


def _exact(texts: DataFrame, brief: DataFrame, ws: Workspace) -> DataFrame:
    """Rows of ``find_leaks`` for items that a text holds word by word with their values: the first up to ``WINDOW`` words by hash, then all."""
    worded = F.exists("w", lambda w: ~w.startswith(_MARK))  # numbers and names alone say nothing
    items = brief.filter(worded).select("item", exact_words(F.col("say")).alias("e"), F.size(F.filter("iv", lambda v: v.isNotNull())).alias("n_slots")).filter(F.size("e") > 0)
    items = items.withColumn("size", F.least(F.size("e"), F.lit(WINDOW)))
    items = ws.save(items.withColumn("h", F.xxhash64(F.slice("e", F.lit(1), F.col("size")), "size")), "exact-items")
    few = items.count() <= BROADCAST_WINDOWS
    sizes = [r["size"] for r in items.select("size").distinct().collect()]
    hashes = F.flatten(F.array(*(windows(F.col("e"), n) for n in sizes))) if sizes else F.array().cast("array<bigint>")
    keys = items.select("item", "h")
    met = texts.select("doc", exact_words(F.col("text")).alias("e")).select("doc", F.explode(F.array_distinct(hashes)).alias("h")).join(F.broadcast(keys) if few else keys, "h")
    met = ws.save(met.select("doc", "item").distinct(), "exact-met")
    # the texts with a hit again, whole items against them
    pairs = texts.join(met, "doc").join(F.broadcast(items) if few else items, "item").select("doc", "item", "n_slots", F.col("e").alias("x"), exact_words(F.col("text")).alias("e"), template_slots(F.col("text")).alias("dv"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("e") - F.size("x") + 1, F.lit(1))), lambda i: F.slice("e", i, F.size("x")) == F.col("x"))
    pairs = pairs.withColumn("start", F.get(starts, F.lit(0)) - 1).filter("start is not null")
    # a placeholder stands for the words of its value
    width = F.transform("dv", lambda v: F.when(v.isNull() | (v == "%"), 1).otherwise(F.size(exact_words(v))))
    ahead = F.aggregate(width, F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), lambda a, k: F.struct((a["words"] + k).alias("words"), (a["n"] + F.when(a["words"] + k <= F.col("start"), 1).otherwise(0)).alias("n")))
    one = F.lit(1).cast("bigint")
    return pairs.select("doc", "item", one.alias("n_windows"), one.alias("n_matched"), F.lit(1.0).alias("coverage"), ahead["n"].alias("first_word"), "n_slots", F.lit(0).alias("n_changed"), F.lit("verbatim").alias("kind"))


def _judged(pairs: DataFrame, coverage: float) -> DataFrame:
    """Rows of ``find_leaks`` from alignments (doc, item, inner, off, places, size, n_windows, iv, dv)."""
    # slots at matching windows only: what lies between them may have been edited
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1))))
    slot = lambda p: F.struct(p.alias("p"), F.get("iv", p).alias("i"), F.get("dv", p + F.col("off")).alias("d"))
    pairs = pairs.withColumn("filled", F.transform(F.filter(covered, lambda p: F.get("iv", p).isNotNull()), slot))
    # the counterpart of each value: the most frequent, the value itself among equals
    values = F.array_distinct(F.transform("filled", lambda x: x["i"]))

    def counterpart(v: Column) -> Column:
        own = F.transform(F.filter("filled", lambda x: x["i"] == v), lambda x: x["d"])
        best = F.array_max(F.transform(F.array_distinct(own), lambda d: F.struct(F.size(F.filter(own, lambda o: o.eqNullSafe(d))).alias("n"), d.eqNullSafe(v).alias("same"), d.alias("d"))))
        return F.struct(v.alias("i"), best["d"].alias("d"))

    pairs = pairs.withColumn("known", F.transform(values, counterpart))
    # the item's first word stays the same, also where it looks like a name
    first = lambda v: F.regexp_extract(v, r"^\S+", 0)
    wrong = lambda x: ~F.exists("known", lambda k: (k["i"] == x["i"]) & k["d"].eqNullSafe(x["d"])) | (F.col("inner") & (x["p"] == 0) & ~first(x["i"]).eqNullSafe(first(x["d"])))
    pairs = pairs.withColumn("bad", F.transform(F.filter("filled", wrong), lambda x: x["p"]))
    left = F.filter("places", lambda p: ~F.exists("bad", lambda b: (b >= p) & (b < p + F.col("size"))))
    kept = F.filter("filled", lambda x: F.exists("left", lambda p: (x["p"] >= p) & (x["p"] < p + F.col("size"))))
    pairs = pairs.withColumn("left", left).withColumn("kept", kept).filter(F.size("left") > 0)
    changed = F.size(F.filter("kept", lambda x: ~x["i"].eqNullSafe(x["d"])))
    line = F.struct(F.size("left").alias("k"), (-F.col("off")).alias("before"), (F.col("off") + F.array_min("left")).alias("first_word"), F.size("kept").alias("n_slots"), changed.alias("n_changed"))
    pairs = pairs.select("doc", "item", "inner", "n_windows", "left", (F.size("bad") == 0).alias("good"), line.alias("line")).filter(F.col("good") | (F.col("line.n_changed") == 0))
    union = lambda x: F.size(F.array_distinct(F.flatten(F.collect_list(x))))
    judged = pairs.groupBy("doc", "item", "inner", "n_windows").agg(union(F.when(F.col("good"), F.col("left"))).alias("n_good"), union(F.when(F.col("good") | (F.col("line.n_changed") == 0), F.col("left"))).alias("n_all"), F.max(F.when(F.col("good"), F.col("line"))).alias("line"), F.max("line").alias("any_line"))
    share = lambda n: F.round(F.col(n) / F.col("n_windows"), 6)
    held = share("n_good") >= coverage
    judged = judged.filter(held | (share("n_all") >= max(VERBATIM, coverage)))
    judged = judged.withColumn("line", F.when(held, F.col("line")).otherwise(F.col("any_line"))).withColumn("n_matched", F.when(held, F.col("n_good")).otherwise(F.col("n_all")).cast("bigint")).withColumn("coverage", share("n_matched"))
    kind = F.when(F.col("line.n_changed") > 0, "re-parameterised").when(F.col("n_matched") < F.col("n_windows"), "partial").otherwise("verbatim")
    return judged.select("doc", "item", "n_windows", "n_matched", "coverage", "line.first_word", "line.n_slots", "line.n_changed", kind.alias("kind"))


def find_leaks(docs: DataFrame, items: DataFrame, ws: Workspace, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that it holds: (doc_id, item_id, n_windows, n_matched, coverage, first_word, n_slots, n_changed, kind)."""
    # a text is known by its id and two hashes, so that texts of one id, or without one, are told apart
    key = lambda i, t: F.struct(F.col(i).alias("id"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit(7), t).alias("b"))
    asked = items.select(key(item_col, item_text_col).alias("item"), F.col(item_text_col).alias("say"), template_words(F.col(item_text_col)).alias("w"), template_slots(F.col(item_text_col)).alias("iv"))
    asked = asked.filter(F.size("w") >= SHORTEST).dropDuplicates(["item"]).withColumn("inner", F.lit(False))
    asked = ws.save(asked.withColumn("size", F.least(F.size("w"), F.lit(WINDOW))), "items")
    texts = docs.select(key(id_col, text_col).alias("doc"), F.col(text_col).alias("text")).filter("text is not null")

    def at_size(words: Column, size: int) -> Column:
        # windows made of placeholders for the most part say nothing; an item's first word is a word, whatever its letters
        plain = F.transform(words, lambda w, i: F.when(w.startswith(_MARK) & ~(F.col("inner") & (i == 0)), 0).otherwise(1))
        keep = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: F.aggregate(F.slice(plain, i + 1, F.lit(size)), F.lit(0), lambda a, b: a + b) * 2 >= size)
        return F.filter(F.arrays_zip(windows(words, size).alias("h"), keep.alias("keep"), F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))).alias("i")), lambda x: x["keep"] & x["h"].isNotNull())

    def windows_of(table: DataFrame) -> DataFrame:
        out = table.select("item", "inner", "size", F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("ipos")).limit(0)
        for n in (r["size"] for r in table.select("size").distinct().collect()):  # SHORTEST to WINDOW: five at most
            out = out.unionByName(table.filter(F.col("size") == n).select("item", "inner", "size", F.explode(at_size(F.col("w"), n)).alias("x")).select("item", "inner", "size", F.col("x.h").alias("h"), F.col("x.i").alias("ipos")))
        return out

    wanted = ws.save(windows_of(asked), "wanted")
    total = wanted.groupBy("item", "inner").agg(F.count("*").alias("n_windows"))
    # brief items, which fall short once the window of their first word is lost, are also read as they stand within a sentence, and word by word
    n_windows = F.coalesce("n_windows", F.lit(0))
    brief = ws.save(asked.join(total.drop("inner"), "item", "left").filter(n_windows - 1 < coverage * n_windows).select(asked.columns), "brief")
    exact = None
    if not brief.isEmpty():
        exact = _exact(texts, brief, ws)
        within = F.concat(F.lit("x "), F.regexp_replace("say", r"^\s+", ""))
        inner = brief.select("item", "say", F.expr("w").alias("outer"), F.slice(template_words(within), 2, 1 << 30).alias("w"), F.slice(template_slots(within), 2, 1 << 30).alias("iv"), F.lit(True).alias("inner"))
        inner = inner.filter((F.size("w") >= SHORTEST) & (F.col("w") != F.col("outer"))).drop("outer").withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
        asked = ws.save(asked.unionByName(inner), "readings")
        wanted = ws.save(windows_of(asked), "all-wanted")
        total = wanted.groupBy("item", "inner").agg(F.count("*").alias("n_windows"))
    sizes = [r["size"] for r in wanted.select("size").distinct().collect()]
    few = wanted.count() <= BROADCAST_WINDOWS

    words = texts.select("doc", template_words(F.col("text")).alias("w"))
    every = F.flatten(F.array(*(windows(F.col("w"), n) for n in sizes))) if len(sizes) > 1 else windows(F.col("w"), sizes[0]) if sizes else F.array().cast("array<bigint>")
    # position counted over the windows of all sizes; its place among those of the own size follows from the size
    met = words.select("doc", F.size("w").alias("n"), F.posexplode(every).alias("at", "h")).join(F.broadcast(wanted) if few else wanted, "h")
    shift = F.lit(0)
    ahead = F.lit(0)
    for n in sizes:
        shift = F.when(F.col("size") == n, ahead).otherwise(shift)
        ahead = ahead + F.greatest(F.col("n") - n + 1, F.lit(0))
    met = met.select("doc", "item", "inner", "ipos", (F.col("at") - shift).alias("dpos"))
    # written once: all that follows works on these few rows, and the texts are not canonicalised again
    met = ws.save(met.distinct(), "met")
    lines = met.groupBy("doc", "item", "inner", (F.col("dpos") - F.col("ipos")).alias("off")).agg(F.array_sort(F.collect_set("ipos")).alias("places"))
    covered = met.groupBy("doc", "item", "inner").agg(F.countDistinct("ipos").alias("n"))
    pairs = covered.join(F.broadcast(total) if few else total, ["item", "inner"]).filter(F.round(F.col("n") / F.col("n_windows"), 6) >= coverage).drop("n")
    pairs = pairs.join(lines, ["doc", "item", "inner"])
    # slots of the alignments: texts of the documents concerned only
    with_slots = asked.select("item", "inner", "iv", "size", (F.size(F.filter("iv", lambda v: v.isNotNull())) > 0).alias("has"))
    pairs = ws.save(pairs.join(F.broadcast(with_slots) if few else with_slots, ["item", "inner"]), "pairs")
    concerned = pairs.filter("has").select("doc").distinct()
    if concerned.isEmpty():
        texts = texts.limit(0)
    values = texts.join(concerned, "doc", "left_semi").dropDuplicates(["doc"]).select("doc", template_slots(F.col("text")).alias("dv"))
    out = _judged(pairs.join(values, "doc", "left"), coverage)
    if exact is not None:
        out = out.unionByName(exact)
    rest = [c for c in out.columns if c not in ("doc", "item")]
    rank = F.struct("coverage", F.col("kind") == "verbatim", -F.col("first_word"))
    return out.groupBy(F.col("doc.id").alias("doc_id"), F.col("item.id").alias("item_id")).agg(F.max_by(F.struct(*rest), rank).alias("row")).select("doc_id", "item_id", "row.*")
