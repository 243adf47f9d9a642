"""Operators on single texts: extraction, licence scan, token counts and files, classifiers."""

from __future__ import annotations

import html
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioforge.llm import dac_codes, html_paths, language_id, license_index, token_count, toxicity
from folioforge.llm.bpe import PieceCounts, PieceEncoder
from folioforge.llm.workspace import Workspace

ODD = [None, "", " ", "\n", "a", "É", "İstanbul ΣΑΣ ẞ", "x" * 70_000, "word " * 30_000, "tab\tnbsp end ", "can't WE'LL don’t", "<|endoftext|>mid<|endoftext|>", "é́ é H̱", "日本語 한국어 عربى", "\x1c\x1f \x85", "😀👩‍👩‍👧", "12345 6.7", "<|startoftext|> a"]


def frame(spark, texts, extra=True):
    """Texts with clashing extra columns, a null id and a repeated row."""
    rows = [(i, t, "en", i) for i, t in enumerate(texts)] + [(None, "null id", None, None), (0, texts[0], "en", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, n_tokens bigint")


# --- 1: extraction ------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="ad-free">
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies, sorry.</div>
<main><article><h1>The  title</h1><p>First paragraph, with <b>bold</b>&nbsp;text &amp; more.<p>Second one, longer than the first; it goes on.
<aside class="sidebar">Related, not this.</aside><form><input><button>Send</button></form><div class="advert">Buy it, now.</div>
<ul><li>Point one<li>Point two</ul></article></main><section id="comments"><p>Reader comment, long enough to be prose.</p></section><footer>&copy; 2020</footer>"""


def test_article_alone_remains():
    assert html_paths.main_text(PAGE) == "The title\nFirst paragraph, with bold text & more.\nSecond one, longer than the first; it goes on.\nPoint one\nPoint two"


def test_links_in_lists_of_the_article_remain():
    page = "<body><article><p>A first paragraph, long enough to be prose; it goes on.</p><ul><li>See <a href=x>the guide</a> first.<li><a href=y>A reference</a></ul></article></body>"
    assert html_paths.main_text(page) == "A first paragraph, long enough to be prose; it goes on.\nSee the guide first.\nA reference"
    loose = "<body><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul><p>A first paragraph, long enough to be prose.</p><p>See also, in short.</p></body>"
    assert html_paths.main_text(loose) == "A first paragraph, long enough to be prose.\nSee also, in short."


LONG = "A sentence of some length, with a comma; and it goes on. " * 40


@pytest.mark.parametrize("page", ["<body><div id=content><div class=part>{a}</div><div class=part>{b}</div></div></body>", "<body><article><p>{a}</p></article><article><p>{b}</p></article></body>", "<body><p>{a}</p><table><tr><td>{b}</table></body>", "<body><p>{a}</p><ul><li>one</ul><p>x, y.</p><blockquote>{b}</blockquote></body>"])
def test_short_parts_beside_long_ones_remain(page):
    short = "A short part, also prose."
    text = html_paths.main_text(page.format(a=LONG, b=short))
    assert text.startswith(LONG.strip()) and text.endswith(short)


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p>Hello", "Hello"), ("text only", "text only"), ("<div><div>One block, only.</div></div>", "One block, only."), ("<!-- <p>x</p>", ""), ("<script>x", ""), ("a < b &lt; c", "a < b < c")])
def test_small_pages(page, text):
    assert html_paths.main_text(page) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/=\"'pdivab &;!-\n", max_size=80))
def test_broken_markup_never_fails(page):
    text = html_paths.main_text(page)
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n") if x.strip())


def test_extract_rows(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "v", "<p>a" * 3000, "z")], "page_id bigint, url string, html string, text string")
    got = html_paths.extract(rows).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_paths.extract(rows.limit(0)).collect() == []


PROSE = "<p>A first paragraph, long enough to be prose; it goes on and on, as prose does, with commas. And more.</p><p>Second one, about as long as the first; it goes on. Sentences follow, one after the other.</p>"
TEXT = html_paths.main_text(f"<article>{PROSE}</article>")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # marks on what holds the article refute themselves
        (f'<nav><a href=x>Home</a></nav><div class="with-sidebar"><article><h1>T</h1>{PROSE}</article></div><div class="ad">Buy now, cheap, best.</div><footer>c 2024, all.</footer>', f"T\n{TEXT}"),
        (f'<div id="post-comment-system-design"><h1>T</h1>{PROSE}</div><div class="comments">{PROSE}{PROSE}</div>', f"T\n{TEXT}"),
        (f'<form id=page><div class=top-menu><a href=a>a</a></div><h1>T</h1>{PROSE}</form>', f"T\n{TEXT}"),
        # words among others hardly weigh, titles of boxes do
        (f'<article><h1>T</h1><section class="related-work"><h2>Related work</h2>{PROSE}</section></article>', f"T\nRelated work\n{TEXT}"),
        (f"<article><h1>T</h1>{PROSE}<div><h3>Popular</h3><ul><li><a href=x>One post</a></li></ul></div></article>", f"T\n{TEXT}"),
        (f"<article><h1>T</h1>{PROSE}<div><h3>Latest posts</h3><ul><li>One post, here</li></ul></div></article>", f"T\n{TEXT}"),
        (f"<main><article><h1>A</h1>{PROSE}</article><article><h1>B</h1><p>Short.</p></article></main>", f"A\n{TEXT}\nB\nShort."),
        (f"<article>{PROSE}<ul><li><a href=x>Ref one</a></li><li><a href=y>Ref two</a></li></ul></article>", f"{TEXT}\nRef one\nRef two"),
        ("<div>" * 300 + f"<nav><a href=x>menu</a> words of a menu</nav>{PROSE}" + "</div>" * 300, TEXT),
        (f'<header><h1>Site</h1></header><main><h1>T</h1><article>{PROSE}</article><section class="comments"><article>{PROSE}</article></section></main><aside>{PROSE}</aside>', f"T\n{TEXT}"),
        ("<nav><a href=x>Home</a></nav><footer>c 2024, all.</footer>", ""),
    ],
)
def test_marks_weigh(page, text):
    assert html_paths.main_text(f"<html><body>{page}</body></html>") == text


def test_sample_pages_against_a_plain_parser():
    # every sample page has one article; the ratios must find it, nothing else says what is to be dropped
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for page in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li)[^<>]*>", re.sub(r"<br[^<>]*>", " ", inner))
        lines = (" ".join(html.unescape(re.sub(r"<[^<>]*>", "", x)).split()) for x in blocks)
        assert html_paths.main_text(page["html"]) == "\n".join(x for x in lines if x)


def test_ratios_decide(monkeypatch):
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    before = [html_paths.main_text(p["html"]) for p in pages]
    monkeypatch.setattr(html_paths, "path_scores", lambda nodes: np.ones(len(nodes)))
    assert sum(html_paths.main_text(p["html"]) != x for p, x in zip(pages, before, strict=True)) > len(pages) / 2


def test_path_ratios_against_sums_by_hand():
    elements, nodes = html_paths.parse("<div><p>One, two.</p><p>Three <a>four</a>.</p></div><div><p>Five!</p></div>")
    html_paths._weigh(elements, nodes)
    sums = {"p": (len("One, two.") + len("Three") + len(".") + len("Five!"), 4, 4), "a": (4, 0, 1)}
    raw = [0.0 if n.tag == "a" else np.log1p(sums["p"][0] / sums["p"][2]) * np.log1p(1 + sums["p"][1] / sums["p"][2]) for n, _, _ in nodes]
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    padded = [raw[0]] * 2 + raw + [raw[-1]] * 2
    fused = [np.sqrt(raw[i] * sum(padded[i + j] * kernel[j] for j in range(5)) / kernel.sum()) for i in range(len(raw))]
    assert np.allclose(html_paths.path_scores(nodes), fused)


# --- 2: licence scan ----------------------------------------------------------


def test_licence_scan_against_sql(spark):
    notices = [" ".join(t.words) for t in license_index.TEMPLATES]
    cut = ["so " + " ".join(n.split()[: len(n.split()) * k // 10]) for n in notices for k in (4, 6)] + [" ".join("no" if i % 3 == 1 else w for i, w in enumerate(n.split())) for n in notices]
    texts = [*(t for t in ODD if len(t or "") < 9999), *notices, *cut, "submit the admitted license", "Released under the MIT License. mit-license, MIT\nLICENSE", "GNU general public license", "cc by-nc 4.0 and CC BY 4.0", "a mit éa license", "Permission is hereby granted, free of charge, to any person", "accept nd cc", "mit license " * 50, "x mit license"]
    docs = frame(spark, texts)
    got = license_index.scan(docs).drop("places").toArrow().to_pylist()
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(license_index.oracle_sql()).arrow().read_all().to_pylist()
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert max(r["n_base"] for r in got) == 50


def test_licence_scan_of_long_texts_and_none(spark):
    texts = ["word " * 60_000 + "MIT License", "mit license " * 20_000, "x" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(tuple(r[:6]) for r in license_index.scan(docs).collect())
    assert got == [(0, 60_002, 1, 60_000, 60_000, "mit"), (1, 40_000, 20_000, 0, 39_998, "mit"), (2, 1, 0, None, None, "")]
    assert license_index.scan(docs.limit(0)).collect() == []


def test_triggers_cover_every_key_phrase():
    found = license_index.triggers(license_index.TEMPLATES)
    assert all(set(t.key) & set(found) for t in license_index.TEMPLATES)


# --- 3 and 4: tokens ----------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_splitting_agrees_with_the_library_on_every_code_point(name):
    with open(P.path(name), encoding="utf-8") as f:
        spec = f.read()
    encoder, library = PieceEncoder(spec), Tokenizer.from_str(spec)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}1" for c in points]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if not encoder.unsettled(t) and e.ids != [i for pieces, _ in encoder.segments(t) for p in pieces for i in encoder.piece_ids(p)]]
    assert not wrong
    assert sum(map(encoder.unsettled, texts)) < 0.05 * len(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_counts_equal_the_library(text):
    encoder, counts, library = tools()
    text = text if len(text) % 2 else text.encode("ascii", "ignore").decode() + " don't 'sx  \n\n y\x1c"
    assert token_count.count_tokens(encoder, counts, text) == len(library.encode(text, add_special_tokens=False).ids)


_TOOLS: list = []


def tools():
    if not _TOOLS:
        with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            spec = f.read()
        encoder = PieceEncoder(spec)
        _TOOLS.append((encoder, PieceCounts(encoder), Tokenizer.from_str(spec)))
    return _TOOLS[0]


def test_token_count_rows(spark):
    docs = frame(spark, ODD)
    library = tools()[2]
    got = token_count.token_counts(docs, P.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        if r["doc_id"] is not None:
            t = ODD[r["doc_id"]] or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert token_count.token_counts(docs.limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_token_files(spark):
    docs = frame(spark, ODD)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for shard in (1 << 20, 8):
        files, before = dac_codes.write_token_files(docs, P.path("word_bpe_49k.json"), 1, Workspace(spark, "t"), shard_ids=shard)
        got = sorted(map(tuple, dac_codes.read_documents(files, before).collect()), key=lambda r: r[1])
        ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in ["null id", ODD[0], *ODD]]
        starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
        assert [r[0] for r in got] == [None, 0, *range(len(ODD))]
        assert [r[1] for r in got] == starts
        assert [r[2] for r in got] == [len(x) for x in ids]
        assert [r[3] for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    files, before = dac_codes.write_token_files(docs.limit(0), P.path("word_bpe_49k.json"), 1, Workspace(spark, "t"))
    assert dac_codes.read_documents(files, before).collect() == []


def test_an_id_of_most_rows_is_spread_over_buckets(spark):
    texts = [f"word {i % 7} " * (i % 5) for i in range(400)]
    docs = spark.createDataFrame([(50 if i % 3 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    files, before = dac_codes.write_token_files(docs, P.path("word_bpe_49k.json"), 1, Workspace(spark, "t"))
    assert files.select("bucket").distinct().count() == 4
    got = sorted(map(tuple, dac_codes.read_documents(files, before).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in texts]
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((50 if i % 3 else i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids))
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=700), max_size=5))
def test_codes_give_every_id_without_decoding(documents):
    arrays = [np.array(d, np.uint32) for d in documents]
    image = dac_codes.Image(dac_codes.pack(list(range(len(arrays))), arrays))
    flat = [x for d in documents for x in d]
    assert image.all().tolist() == flat
    assert [image.get(i) for i in range(0, len(flat), 7)] == flat[::7]
    for k, d in enumerate(documents):
        assert image.document(k).tolist() == d
    with pytest.raises(IndexError):
        image.get(len(flat))


# --- 5 and 8: classifiers -----------------------------------------------------


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, keep=("lang",)).toPandas()
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.rejected.mean() < 0.01 and got.score.between(0, 1).all()


def test_language_id_odd_texts(spark):
    docs = frame(spark, ODD).withColumn("lang", F.lit("en"))
    got = language_id.identify(docs).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        t = None if r["doc_id"] is None else ODD[r["doc_id"]]
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, t or "")))
    alone = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in alone} == {"und"} and all(r["rejected"] for r in alone)
    assert language_id.identify(docs.limit(0)).collect() == []


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.toxic == held.predicted).mean() > 0.9
    assert held[held.toxic == 1].score.mean() > 3 * held[held.toxic == 0].score.mean()


def test_toxicity_odd_texts(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else i % 2) for i in range(12)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.score_toxicity(docs, labels.filter("toxic = 0")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert toxicity.score_toxicity(docs.limit(0), labels).collect() == []


def test_words_are_those_of_the_definition(spark):
    text = "A-b É_x 1é\x00z"
    want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    row = spark.range(1).select(license_index.words_of(F.lit(text)).alias("w"), license_index.word_count(F.lit(text)).alias("n")).head()
    assert (row["w"], row["n"]) == (want, len(want))


def test_toxicity_against_a_dense_fit():
    # the same objective over n-grams as strings, minimised by plain gradient descent
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(40)]
    y = np.array([i % 3 == 0 for i in range(90)], float)
    texts = [" ".join([*rng.choice(words, 6), *(["Moron,", "IDIOT"] if t and rng.random() < 0.8 else ["kindly"])]) for t in y]
    fit = toxicity.Fit(rounds=3000)
    model = toxicity.train(pa.array(texts), y, fit)
    sets = []
    for t in texts:
        plain = " " + "".join(c if c.isalnum() else " " for c in t.lower()) + " "
        sets.append({plain[i : i + n] for n in toxicity.SIZES for i in range(len(plain) - n + 1)})
    grams = sorted(set().union(*sets))
    x = np.array([[g in s for g in grams] for s in sets], float)
    p, q, toxic, other = x[y == 1].sum(axis=0), x[y == 0].sum(axis=0), y.sum(), len(y) - y.sum()
    share = (p + q) / len(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        test = 2 * sum(np.nan_to_num(k * np.log(k / m)) for k, m in ((p, share * toxic), (toxic - p, (1 - share) * toxic), (q, share * other), (other - q, (1 - share) * other)))
    keep = (test >= fit.least_ratio) & (np.maximum(p, q) >= 3)
    x = x[:, keep] * (np.log((p + 0.5) / (toxic + 1)) - np.log((q + 0.5) / (other + 1)))[keep]
    w, b = np.zeros(x.shape[1]), 0.0
    step = 4 / (np.linalg.eigvalsh(x.T @ x / len(y))[-1] + 1)
    for _ in range(20_000):
        err = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= step * (x.T @ err / len(y) + fit.penalty * w)
        b -= step * err.mean()
    assert keep.sum() > 20
    assert np.abs(toxicity.scores(model, texts) - 1 / (1 + np.exp(-(x @ w + b)))).max() < 0.02


def test_many_languages(spark):
    rng = np.random.default_rng(4)
    own = [[chr(0x61 + (7 * k + j * (k % 5 + 1)) % 26) + chr(0x3B1 + (k + j) % 20) for j in range(6)] for k in range(30)]
    rows = [(i, "".join(rng.choice(own[i % 30], 30)), f"l{i % 30:02}") for i in range(1500)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), keep=("lang",)).toPandas()
    assert got.lang_pred.nunique() == 30 and (got.lang == got.lang_pred)[got.held_out].mean() > 0.9
