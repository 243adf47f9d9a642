"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams. The log ratio of an n-gram's
(smoothed) rates in toxic and other sampled texts scales its feature; a logistic
regression with a quadratic penalty then weighs the scaled features (the NB-SVM
construction of Wang and Manning, with a logistic loss). N-grams that don't tell
the classes apart are left out by a likelihood-ratio test on the sample; all
others are features, however many.

The fit runs in numpy on the driver on a bounded sample of labelled rows, which
it reads in slices: what it holds is the sample, a few arrays over the buckets,
and four bytes for each feature of each text.
Scoring covers every row and whole texts in one narrow pass: no shuffle; the
model, of fixed size, is broadcast.

Defined results: null and empty texts get the score of a text without n-grams;
without both classes to learn from, every score is 0. Null ids pass through, not
held out and never learned from. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.columns import give_back, giving_back, text_slices
from folioforge.llm.grams import gram_buckets, normal_points
from folioforge.llm.language_id import held_out

BITS = 20
SIZES = (3, 4, 5, 6)


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample and of the regression."""

    toxic_rows: int = 2000
    other_rows: int = 4000
    max_chars: int = 20_000  # longer texts aren't sampled, so that the sample is bounded
    least_ratio: float = 12.0  # of the likelihood-ratio test
    smoothing: float = 0.5
    penalty: float = 2e-4
    rounds: int = 250


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # (2**BITS + 1), 0 for n-grams left out
    bias: float


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit: Fit) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of a bounded sample in hash order of the id."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).filter(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
    key = F.xxhash64("i")
    # twice the rows wanted of each class at most: some belong to texts that are too long or gone
    ids = known.filter("y = 1").orderBy(key, "i").limit(2 * fit.toxic_rows).unionByName(known.filter("y = 0").orderBy(key, "i").limit(2 * fit.other_rows)).distinct()
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull() & (F.length("t") <= fit.max_chars))
    rows = texts.join(F.broadcast(ids), "i")
    parts = [rows.filter(F.col("y") == y).orderBy(key, "i", "t").limit(n).select("t").toArrow().column("t") for y, n in ((1, fit.toxic_rows), (0, fit.other_rows))]
    y = np.repeat([1.0, 0.0], [len(x) for x in parts])
    return pa.chunked_array([c for x in parts for c in x.chunks], pa.string()).combine_chunks(), y


def distinct_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of a text, bucket) of each distinct n-gram of each text, in order of the texts."""
    points, offsets, _ = normal_points(texts, digits=True)
    keys = []
    for n in SIZES:
        at = gram_buckets(points, offsets, n, BITS)
        where = np.flatnonzero(at < 1 << BITS)
        keys.append((np.searchsorted(offsets, where, "right") - 1 << BITS) + at[where])
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def train(texts: pa.Array, y: np.ndarray, fit: Fit) -> Model | None:
    """Log-count ratios, choice of features, regression; None without both classes."""
    toxic, other = y.sum(), len(y) - y.sum()
    if not toxic or not other:
        return None
    size = 1 << BITS

    def slices() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        # made again rather than kept: all n-grams of the sample would not fit a small driver
        for a, _, part in text_slices(pa.record_batch([texts], ["t"]), "t"):
            yield a, *distinct_grams(part.to_pylist())

    p, q = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for a, doc, at in slices():
        label = y[a + doc] > 0
        p += np.bincount(at[label], minlength=size).astype(np.int32)
        q += np.bincount(at[~label], minlength=size).astype(np.int32)
    chosen = np.flatnonzero(np.maximum(p, q) >= 3)
    p, q, a = p[chosen].astype(np.float64), q[chosen].astype(np.float64), fit.smoothing
    rate = (p + q) / len(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        test = 2 * sum(np.nan_to_num(k * np.log(k / m)) for k, m in ((p, rate * toxic), (toxic - p, (1 - rate) * toxic), (q, rate * other), (other - q, (1 - rate) * other)))
    r = np.log((p + a) / (toxic + 2 * a)) - np.log((q + a) / (other + 2 * a))
    chosen, r = chosen[test >= fit.least_ratio], r[test >= fit.least_ratio]
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    cols, counts = [], np.zeros(len(y), np.int64)
    for a, doc, at in slices():
        col = place[at]
        cols.append(col[col >= 0])
        counts += np.bincount(a + doc[col >= 0], minlength=len(y))
    col = np.concatenate(cols)
    ends = np.concatenate([[0], np.cumsum(counts)])
    # texts in runs of about a million features, so that what is made of them stays small
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(1 << 20, ends[-1], 1 << 20)), [len(y)]]))
    runs = [(i, j, col[ends[i] : ends[j]], np.repeat(np.arange(j - i, dtype=np.int32), counts[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]
    # accelerated gradient descent on the mean logistic loss; the step follows from the mean square of a text
    norm = sum((r[c] ** 2).sum() for _, _, c, _ in runs) / len(y) + 1
    w, b = np.zeros(len(chosen)), float(np.log(toxic / other))
    v, vb, step = w.copy(), b, 4.0 / (4 * norm)
    for k in range(fit.rounds):
        weighed, back, err_sum = v * r, np.zeros(len(chosen)), 0.0
        for i, j, c, row in runs:
            z = np.bincount(row, weighed[c], j - i) + vb
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i:j]) / len(y)
            back += np.bincount(c, err[row], len(chosen))
            err_sum += err.sum()
        new = v - step * (back * r + fit.penalty * v)
        new_b = vb - step * err_sum * norm / 4
        v = new + k / (k + 3) * (new - w)
        vb = new_b + k / (k + 3) * (new_b - b)
        w, b = new, new_b
    weight = np.zeros(size + 1, np.float32)
    weight[chosen] = w * r
    return Model(weight, b)


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of each text to be toxic: each n-gram of a text counts once."""
    points, offsets, _ = normal_points(texts, digits=True)
    keys = []
    for n in SIZES:
        at = gram_buckets(points, offsets, n, BITS)
        hit = np.flatnonzero(model.weight[at])
        doc = np.searchsorted(offsets, hit, "right") - 1
        keys.append(doc * np.int64(1 << BITS) + at[hit])
    keys = np.unique(np.concatenate(keys))
    z = np.bincount(keys >> BITS, model.weight[keys & ((1 << BITS) - 1)], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit: Fit = Fit(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, after the columns named in ``keep``."""
    model = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels, id_col, text_col, label_col, fit), fit))
    give_back()

    # a text that is kept isn't sent to Python twice
    told, gone = (text_col, ()) if text_col in keep else ("_text", ("_text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for a, b, part in text_slices(batch, told):
                part = part.to_pylist()
                s = scores(m, part) if m is not None else np.zeros(len(part))
                rest = [batch.column(c).slice(a, b - a) for c in range(batch.num_columns) if batch.schema.names[c] not in gone]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*(c for c in batch.schema.names if c not in gone), "score", "predicted"])

    narrow = docs.select(*(F.col(c) for c in keep), F.col(id_col).alias("doc_id" if "doc_id" not in keep else "_id"), held_out(F.col(id_col)).alias("held_out"), *([] if text_col in keep else [F.col(text_col).alias("_text")]))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name not in gone)
    return narrow.mapInArrow(giving_back(run), f"{kept}, score double, predicted int")
