"""Operators on pairs and sets of texts against brute force: near-duplicates, vectors, leaks, packing, pipeline."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import components, decontam, language_id, minhash, packing, pca_join, toxicity
from folioforge.llm.workspace import Workspace


def least_reachable(ids, links):
    """id -> smallest id reachable by links."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


# --- components ---------------------------------------------------------------


@pytest.mark.parametrize("kind", ["path", "random", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(40)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(70)], "star": [(7, i) for i in range(30)], "none": []}[kind]
    df = spark.createDataFrame(edges + edges[:3] + [(None, 1)], "u bigint, v bigint")
    got = {r["id"]: r["component"] for r in components.connected_components(df, Workspace(spark, "t")).collect()}
    want = least_reachable({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


# --- 7: MinHash ---------------------------------------------------------------


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_copies(seed, n):
    """Texts edited to similarities from 0.5 to 1, in groups, with exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice([1, 3, 4, 30, 60, 120]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out[:n]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    texts = [*near_copies(5, 300), None, "", "A b C", "a B\tc", "same " * 500, "same " * 700, "x" * 50_000]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 9), (None, texts[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    got = minhash.near_duplicates(docs, Workspace(spark, "t"), k=k).collect()
    assert len(got) == len(rows)
    sets = {i: shingles(t, k) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = least_reachable(sets, links)
    assert len(links) > 100
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_rows_that_share_an_id_link_by_their_own_text(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    near = lambda words: " ".join(words[:-1])
    rows = [(1, " ".join(base)), (1, " ".join(other)), (5, near(base)), (6, near(other)), (7, "alone by itself"), (7, near(base))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, Workspace(spark, "t"), k=4).collect())
    assert got == [(1, 57, 1, True), (1, 57, 1, True), (5, 56, 1, False), (6, 56, 1, False), (7, 1, 7, True), (7, 56, 1, False)]


def test_no_pair_at_the_threshold_is_lost():
    # 2,000 pairs at 0.8 exactly: each meets in a band and passes the signature test
    rng = np.random.default_rng(5)
    _, _, _, _, multipliers = minhash._tables()
    least = minhash.least_match(80)
    for _ in range(2000):
        x = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        a, b = minhash.signature(x[:81]), minhash.signature(x[9:])
        assert (a.reshape(minhash.BANDS, -1) == b.reshape(minhash.BANDS, -1)).all(axis=1).any()
        assert ((a & 0xFF) == (b & 0xFF)).sum() >= least


def test_tiles_of_a_bucket_with_one_large_component(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    rows = [(1, 0, i, 0 if i < 800 else i) for i in range(803)] + [(2, 1, i, 0) for i in range(50)]
    named = spark.createDataFrame(rows, "bucket bigint, band_no int, id bigint, label bigint")
    tiles = minhash._tiles(named)
    met = tiles.groupBy("bucket", "left", "right").agg(F.collect_set("label").alias("labels"), F.collect_list("id").alias("ids")).collect()
    pairs = {frozenset((a, b)) for r in met for a in r["ids"] for b in r["ids"]}
    assert all(frozenset((i, j)) in pairs for i in range(803) for j in range(800, 803))
    # not 100 x 100 blocks
    assert tiles.count() <= 800 + 3 * 101 and all(r["bucket"] == 1 for r in met)


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(docs, Workspace(spark, "t")).collect() == []
    assert minhash.near_duplicates(spark.createDataFrame([(1, None), (2, None)], "doc_id bigint, text string"), Workspace(spark, "t")).filter("kept").count() == 2


def test_a_crowded_bucket_is_compared_in_tiles(spark, monkeypatch):
    # a chain: neighbours are similar, the ends aren't; small tiles make it cross them
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[3 * i : 3 * i + 100]) for i in range(60)]
    monkeypatch.setattr(minhash, "TILE", 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = minhash.near_duplicates(docs, Workspace(spark, "t"), k=4).collect()
    assert {r["component_id"] for r in got} == {0}


def test_a_pair_is_compared_where_it_meets_first():
    # equal remnants in all bands, equal keys in bands 1 and 2 only
    keys = np.arange(2 * minhash.BANDS).reshape(2, -1)
    keys[1, 1:3] = keys[0, 1:3]
    rows = {"sig": np.zeros((2, minhash.HASHES), np.uint8), "bands": keys, "label": np.arange(2), "block": np.zeros(2, int), "left": np.zeros(2, int), "right": np.zeros(2, int)}
    found = [len(list(minhash._tile_pairs(rows | {"band_no": np.full(2, b)}, 1))) for b in (1, 2)]
    assert found == [1, 0]


# --- 9: vectors ---------------------------------------------------------------


@pytest.mark.parametrize("block", [4096, 32])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(pca_join, "LEAST_BLOCK", block)
    monkeypatch.setattr(pca_join, "BLOCK_BYTES", block * 16 * 8)
    monkeypatch.setattr(pca_join, "STRIP", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 260)] + rng.normal(size=(260, 16)) * rng.choice([0.05, 0.3, 0.6], (260, 1)), rng.normal(size=(40, 16))]).astype(np.float32)
    x[50:60] = x[50]
    vectors = [v.tolist() for v in x] + [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [1.0, 2.0], [], [1e-30] * 16, [float("inf")] * 16]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)] + [(None, vectors[0], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in pca_join.similar_vectors(table, Workspace(spark, "t")).collect()}
    assert len(got) == len(rows)
    good = [i for i, v in enumerate(vectors) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    u = np.array([vectors[i] for i in good], float)
    u /= np.abs(u).max(axis=1)[:, None]
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    cos = u @ u.T
    links = [(good[a], good[b]) for a, b in zip(*np.nonzero(np.triu(cos >= 0.9, 1)), strict=True)]
    want = least_reachable(range(len(vectors)), links)
    count = {i: 0 for i in range(len(vectors))}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert len(links) > 200
    for i in range(len(vectors)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (count[i], want[i], want[i] == i), i
    assert (got[None]["n_links"], got[None]["component_id"]) == (0, None)


def test_rows_that_share_an_id_link_by_their_own_vector(spark):
    a, b = [1.0] + [0.0] * 7, [0.0] * 7 + [1.0]
    near = lambda v, k: [x + (0.05 if i == k else 0.0) for i, x in enumerate(v)]
    rows = [(3, a), (3, b), (5, near(a, 1)), (6, near(a, 2)), (4, b), (4, b)]
    got = pca_join.similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), Workspace(spark, "t")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False), (5, 2, 3, False), (6, 2, 3, False)]
    alone = [(1, a), (1, b), (7, near(a, 1)), (8, near(a, 2))]
    got = pca_join.similar_vectors(spark.createDataFrame(alone, "vec_id bigint, embedding array<double>"), Workspace(spark, "t")).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got) == [(1, 0), (1, 2), (7, 2), (8, 2)]


def test_strips_hold_every_row_once():
    x = np.random.default_rng(1).normal(size=(5000, 8))
    assert sorted(pca_join.strip_order(x).tolist()) == list(range(5000))


def test_no_vectors(spark):
    assert pca_join.similar_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), Workspace(spark, "t")).collect() == []
    assert pca_join.similar_vectors(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>"), Workspace(spark, "t")).head()["kept"]


# --- 10: leaks ----------------------------------------------------------------

QUESTION = "A train leaves the old station at 9:30 with 120 passengers, and near Springfield another 15 passengers get on; then 120 tickets are sold, how many remain after 40 km of travel?"


def test_leaks(spark):
    other = QUESTION.replace("9:30", "7:15").replace("120", "300").replace("15", "22").replace("Springfield", "Oak Ridge").replace("40 km", "25 miles")
    wrong = other.replace("300 tickets", "301 tickets")
    docs = ["Before. " + QUESTION + " After.", "x " * 5000 + other, wrong, QUESTION.upper(), "nothing of the kind " * 20, QUESTION[:60], None, "", "1 2 3 4 5 6 7 8 9 10 11 12", "Say. Four little words."]
    rows = [(i, t, i) for i, t in enumerate(docs)] + [(0, docs[0], 5), (None, QUESTION, 1)]
    items = [(1, QUESTION, 0), (2, None, 0), (3, "", 0), (4, "too short", 0), (5, "four little words say", 0), (6, "1 2 3 4 5 6 7 8 9", 0), (None, QUESTION, 0), (1, QUESTION, 1)]
    got = decontam.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string, item_id bigint"), spark.createDataFrame(items, "item_id bigint, text string, doc_id bigint"), Workspace(spark, "t")).collect()
    kinds = {(r["doc_id"], r["item_id"]): r["kind"] for r in got}
    assert len(got) == len(kinds)
    assert kinds[(0, 1)] == "verbatim" and kinds[(1, 1)] == "re-parameterised"
    # a null id is an id like others: the review of round 1 asks that nothing be skipped for its id
    assert kinds[(None, 1)] == kinds[(0, None)] == kinds[(None, None)] == "verbatim" and kinds[(1, None)] == "re-parameterised"
    assert set(kinds) <= {(d, i) for d in (0, 1, 3, None) for i in (1, None)}  # (2, 1): one value stands for two
    assert (2, 1) not in kinds


def test_leaks_against_containment(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items, Workspace(spark, "t")).collect()}
    whole = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"].lower() in d["text"].lower()}
    assert whole and got == whole
    assert decontam.find_leaks(docs.limit(0), items, Workspace(spark, "t")).collect() == []
    assert decontam.find_leaks(docs, items.limit(0), Workspace(spark, "t")).collect() == []


def test_canonical_words_and_slots_line_up(spark):
    text = "The 5 kg bag of Alice Smith cost 3.50. Bob paid 7 % more than Carol!"
    row = spark.range(1).select(decontam.template_words(F.lit(text)).alias("w"), decontam.template_slots(F.lit(text)).alias("s")).head()
    assert [w.strip("\x01") for w in row["w"]] == ["the", "#n", "#u", "bag", "of", "#a", "cost", "#n", "bob", "paid", "#n", "#u", "more", "than", "#a"]
    assert row["s"] == [None, "5", "kg", None, None, "alice smith", None, "3.50", None, None, "7", "%", None, None, "carol"]


def test_words_and_slots_line_up_after_every_character(spark):
    rng = random.Random(6)
    pieces = [f"{chr(c)}{n}" for c in range(1, 128) for n in ("7", "3.50 kg", "2020/01")]
    texts = pieces + ["".join(rng.choice([*pieces, " ", " Alice Smith ", " word ", "5 %"]) for _ in range(40)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decontam.template_words(F.col("t")).alias("w"), decontam.template_slots(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [w.startswith("\x01") for w in r["w"]] == [v is not None for v in r["s"]], r["t"]


def leaks(spark, docs, items):
    """(document, item) -> row, for texts numbered from 0."""
    table = lambda texts, name: spark.createDataFrame(list(enumerate(texts)), f"{name} bigint, text string")
    found = decontam.find_leaks(table(docs, "doc_id"), table(items, "item_id"), Workspace(spark, "t")).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in found}) == len(found)
    return {(r["doc_id"], r["item_id"]): r for r in found}


def test_leaks_behind_glued_numbers(spark):
    before = ["See #1. ", "id:7 ", "http://a.b/2020/01 ", "Python3 and Jan2020: "]
    found = leaks(spark, [b + QUESTION for b in before], [QUESTION])
    assert {k: r["kind"] for k, r in found.items()} == {(i, 0): "verbatim" for i in range(len(before))}


def test_an_inconsistent_variant_does_not_hide_a_verbatim_copy(spark):
    wrong = QUESTION.replace("120 tickets", "121 tickets")
    found = leaks(spark, [wrong + " And now. " + QUESTION, wrong + " Or this. " + wrong, wrong + " So. " + QUESTION.replace("another", "yet another")], [QUESTION])
    # the last holds all but one word; the review of round 1 asks that such a match not be called verbatim
    assert {k: r["kind"] for k, r in found.items()} == {(0, 0): "verbatim", (2, 0): "partial"}


def test_an_edited_value_or_word_does_not_hide_an_item(spark):
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("lam", "ner", "tos", "vik", "zup", "rol", "mid", "sag", "pen", "hut")]
    item = " ".join(words[:12]) + " 12 apples " + " ".join(words[12:35]) + " 12 apples " + " ".join(words[35:])
    second = lambda new: new.join(item.rsplit("12 apples", 1))
    found = leaks(spark, [item, second("several apples"), second("9 apples"), item.replace("12", "7"), second("9 apples").replace("12", "7")], [item])
    assert {k[0]: (r["kind"], r["n_matched"] < r["n_windows"]) for k, r in found.items()} == {0: ("verbatim", False), 1: ("partial", True), 2: ("partial", True), 3: ("re-parameterised", False)}


def test_leaks_of_texts_that_share_an_id(spark):
    rows = [(1, "nothing of the kind " * 9), (1, "so " + QUESTION), (2, QUESTION), (2, "x " + QUESTION[:70]), (None, QUESTION)]
    items = spark.createDataFrame([(5, QUESTION), (5, "four little words that nobody wrote in any of the documents here")], "item_id bigint, text string")
    got = decontam.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), items, Workspace(spark, "t")).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["kind"]) for r in got) == [("1", 5, "verbatim"), ("2", 5, "verbatim"), ("None", 5, "verbatim")]


def brute_leaks(doc, item, size=8):
    """Is the item in the document: by trying every offset, for lower-case words and numbers."""
    split = lambda t: [("#" if w[0].isdigit() else w, w if w[0].isdigit() else None) for w in t.split()]
    d, q = split(doc), split(item)
    wins = [i for i in range(len(q) - size + 1) if 2 * sum(v is None for _, v in q[i : i + size]) >= size]
    good, edited = set(), set()
    for off in range(-len(q), len(d)):
        at = [i for i in wins if i + off >= 0 and i + off + size <= len(d) and all(d[i + off + j][0] == q[i + j][0] for j in range(size))]
        pairs = {p: (q[p][1], d[p + off][1]) for i in at for p in range(i, i + size) if q[p][1]}
        if len(set(pairs.values())) == len({v for v, _ in pairs.values()}):
            good |= set(at)
            continue
        known = {}
        for v in {v for v, _ in pairs.values()}:
            own = [x for w, x in pairs.values() if w == v]
            known[v] = max(set(own), key=lambda x: (own.count(x), x == v, x))  # noqa: B023
        left = [i for i in at if all(known[pairs[p][0]] == pairs[p][1] for p in range(i, i + size) if p in pairs)]
        if all(pairs[p][0] == pairs[p][1] for i in left for p in range(i, i + size) if p in pairs):
            edited |= set(left)
    return bool(wins) and (len(good) >= 0.5 * len(wins) or len(good | edited) >= 0.75 * len(wins))


def test_re_parameterised_leaks_against_every_offset(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("red blue train ship leaves sails from with and then costs holds small large old new".split())
    items = [" ".join(rng.choice(["12", "7", "30"]) if rng.random() < 0.25 else word() for _ in range(rng.randrange(18, 45))) for _ in range(12)]
    docs = []
    for _ in range(150):
        words = rng.choice(items).split()
        change = {"12": rng.choice(["12", "99"]), "7": rng.choice(["7", "41"]), "30": "30"} if rng.random() < 0.5 else {}
        words = [change.get(w, w) for w in words]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["5"], [word()], [word(), words[k]]]) if words else []
        docs.append(" ".join([word(), *words[rng.choice([0, 0, 6]) :], word()]))
    want = {(d, i) for d, t in enumerate(docs) for i, q in enumerate(items) if brute_leaks(t, q)}
    got = set(leaks(spark, docs, items))
    assert 50 < len(want) < 150 and got == want


def test_brief_items(spark):
    items = ["What is 12 + 30 * 4 - 7?", "What is the capital of France?", "Which costs 5 kg and 7 % more?"]
    docs = ["Q: " + items[0], "See Bob Stone. Question: " + items[1] + " Paris.", "Q: What is the capital of Spain?", "Q: Paris is the capital of France?", "What is 12 + 30 * 4 - 8?", "so " + items[2], items[1]]
    found = leaks(spark, docs, items)
    assert {k: r["kind"] for k, r in found.items()} == {(0, 0): "verbatim", (1, 1): "verbatim", (2, 1): "re-parameterised", (5, 2): "verbatim", (6, 1): "verbatim"}
    assert found[(1, 1)]["first_word"] == 3


# --- 6: packing ---------------------------------------------------------------


def best_fit(lengths, sizes, overhead):
    """Piece by piece: (free space of bins in order of opening)."""
    bins, left = [], sum(lengths)
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0] - b[1])
        else:
            b = [min((s for s in sizes if s >= n), key=lambda s: ((s + overhead) / min(s, left), s)), 0]
            bins.append(b)
        b[1] += n
        left -= n
    return sorted(b[1] for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plan_equals_piece_by_piece_packing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.make_plan(counts, (8, 16, 32), 4)
    used: dict[int, int] = {}
    for n in counts:
        number, size, offset = packing.place(plan, np.full(counts[n], n), np.arange(counts[n]))
        for b, s in zip(number.tolist(), size.tolist(), strict=True):
            used[b] = used.get(b, 0) + n
            assert used[b] <= s
    assert len(used) == plan.n_bins and sum(used.values()) == sum(lengths)
    # every bin has the least permitted size for its contents
    sizes = dict(zip(plan.bins.tolist(), plan.size.tolist(), strict=True))
    assert all(min(s for s in (8, 16, 32) if s >= used[b]) == sizes[b] for b in sizes)
    one = packing.make_plan(counts, (32,), 4)
    total: dict[int, int] = {}
    for n in counts:
        for b in packing.place(one, np.full(counts[n], n), np.arange(counts[n]))[0].tolist():
            total[b] = total.get(b, 0) + n
    assert sorted(total.values()) == best_fit(lengths, (32,), 4)


def bins_of(counts, plan):
    """Sorted (contents, size) of the bins of a plan."""
    used: dict[int, int] = {}
    size: dict[int, int] = {}
    for n in counts:
        for b, s in zip(*(x.tolist() for x in packing.place(plan, np.full(counts[n], n), np.arange(counts[n]))[:2]), strict=True):
            used[b] = used.get(b, 0) + n
            size[b] = s
    return sorted((used[b], size[b]) for b in used)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=90), st.sampled_from([((8, 16, 32), 4), ((8, 32), 0), ((5, 11, 16, 32), 9)]))
def test_choice_of_sizes_equals_piece_by_piece_packing(lengths, given_sizes):
    sizes, overhead = given_sizes
    counts = {n: lengths.count(n) for n in set(lengths)}
    want = sorted((used, min(s for s in sizes if s >= used)) for used in best_fit(lengths, sizes, overhead))
    assert bins_of(counts, packing.make_plan(counts, sizes, overhead)) == want


def test_pack_spreads_a_length_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rows = spark.createDataFrame([(None if i % 3 else 5, 9 if i % 4 else 3) for i in range(2000)], "doc_id bigint, n_tokens bigint")
    got = packing.pack(rows, Workspace(spark, "t"), sizes=(16, 32), overhead=2, extra=0).collect()
    assert len(got) == 2000 and len({(r["bin_id"], r["bin_offset"]) for r in got}) == 2000
    lengths = [r["length"] for r in got]
    used: dict[int, int] = {}
    for r in got:
        used[r["bin_id"]] = used.get(r["bin_id"], 0) + r["length"]
    assert sorted(used.values()) == best_fit(lengths, (16, 32), 2)


def test_pack_rows(spark):
    rows = [(i, n, i) for i, n in enumerate([0, None, 1, 5, 5, 5, 100, 31, 32, 33, 7] + [3] * 40)] + [(3, 5, 1), (None, 9, 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, length bigint")
    got = packing.pack(table, Workspace(spark, "t"), sizes=(16, 32), overhead=2).collect()
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: r["bin_offset"])
        ends = [0, *np.cumsum([r["length"] for r in members]).tolist()]
        assert [r["bin_offset"] for r in members] == ends[:-1]
        assert {r["bin_size"] for r in members} == {min(s for s in (16, 32) if s >= ends[-1])}
    assert sum(r["length"] for r in got) == sum((n or 0) + 1 for _, n, _ in rows)
    assert sorted(r["piece_start"] for r in got if r["doc_id"] == 6) == [0, 32, 64, 96]
    assert packing.pack(table.limit(0), Workspace(spark, "t")).collect() == []


# --- pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))
    docs = docs.unionByName(docs.limit(1).select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars", "score", "row"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "packing"]
    ws = Workspace(spark, "t")
    key = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.select("doc_id", "text").collect())
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        after = ws.save(stage(spark, now, folder), name)
        if name == "packing":
            counted = {r["doc_id"] for r in after.collect()}
            assert counted == {r["doc_id"] for r in now.collect()}
            break
        assert after.columns == docs.columns
        if name == "toxicity":
            bad = [r["doc_id"] for r in toxicity.score_toxicity(now, labels).filter("predicted = 1").collect()]
            assert key(after) == [x for x in key(now) if x[0] not in set(map(str, bad))]
        if name == "language_id":
            bad = {str(r["doc_id"]) for r in language_id.identify(now).filter("rejected").collect()}
            assert "-1" in bad and key(after) == [x for x in key(now) if x[0] not in bad]
        if name == "near_dedup":
            sets = {r["doc_id"]: shingles(r["text"], 5) for r in now.collect() if r["doc_id"] is not None}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            want = least_reachable(sets, links)
            assert sorted(r["doc_id"] for r in after.collect() if r["doc_id"] is not None) == sorted(i for i in sets if want[i] == i)
        if name == "decontamination":
            items = [r["text"].lower() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert not [r for r in after.collect() if any(i in r["text"].lower() for i in items)]
            assert key(after) == [x for x in key(now) if not any(i in x[1].lower() for i in items)]
        now = after


def test_pipeline_judges_rows_by_their_text(spark):
    folder = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{folder}/benchmark.parquet").head()["text"]
    one, two, far = (" ".join(f"{c}{i}" for i in range(80)) for c in "xyz")
    near = one.rsplit(" ", 1)[0]
    rows = [(1, one, "a"), (1, two, "b"), (1, two, "c"), (2, near, "d"), (None, near, "e"), (None, far, "f"), (None, far, "g"), (3, None, "h"), (4, "", "i"), (5, item, "j"), (None, "so: " + item, "k"), (5, "word " * 200_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    stages = dict(corpus_pipeline.STAGES)
    kept = sorted(r["source"] for r in stages["near_dedup"](spark, docs, folder).collect())
    assert kept[0] == "a" and len(kept) == 7 and {"f", "g"} & set(kept) and {"b", "c"} & set(kept) and set("hijl") <= set(kept)
    assert sorted(r["source"] for r in stages["decontamination"](spark, docs, folder).collect()) == list("abcdefghil")
    whole = docs.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, whole.limit(0), folder)
        assert out.collect() == [] and (name == "packing" or out.columns == whole.columns)
