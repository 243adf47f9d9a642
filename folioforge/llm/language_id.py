"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its character n-grams (hashed into a
fixed number of buckets); a linear layer and a softmax give the languages. Both
are trained together by stochastic gradient descent in numpy on the driver, on a
bounded sample of labelled rows. A part of the sample that the descent doesn't
see sets the softmax's temperature, and the limits below which a text is
rejected: too little probability for any language, or too few known n-grams.

Every language that occurs is learned; the sample's bounds are those of ``Fit``.
Everything but that fit covers all rows and whole texts. Scoring is one narrow
pass: no shuffle; the model, of fixed size, is broadcast.

Defined results: a null text or one without a letter is ``und`` with score 0 and
rejected; so is every text if there is nothing to learn from. Null ids pass
through, not held out and never learned from. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.columns import give_back, giving_back, text_slices
from folioforge.llm.grams import gram_buckets, normal_points

UNKNOWN = "und"
BITS = 17
SIZES = (1, 2, 3, 4)
DIM = 16


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample and of the descent."""

    rows_per_language: int = 600
    max_rows: int = 20_000  # of all languages together, but one of each at least
    max_chars: int = 2_000  # of a longer text as many from a place that its id decides
    window: int = 160  # each sampled text is also shown by windows of this many characters
    windows: int = 3
    epochs: int = 6
    rate: float = 0.6
    lost: float = 0.001  # share of right calibration texts that may fall below a limit


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # (2**BITS + 1, columns): embeddings times the linear layer, or embeddings alone
    layer: np.ndarray | None  # (columns, languages) if the table has embeddings alone, as for many languages
    bias: np.ndarray
    known: np.ndarray  # (2**BITS + 1): buckets seen in training
    temperature: float
    least: float
    least_known: float


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text divisible by 5; not for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fit: Fit) -> list[tuple[str, str]]:
    """(text, language) of a bounded sample in hash order of the id; about the same number for each language, of which the driver holds one row each."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("g"))
    rows = rows.filter(F.col("i").isNotNull() & F.col("g").isNotNull() & ~held_out(F.col("i")))
    rows = rows.filter(F.col("t").isNotNull())
    counts = rows.groupBy("g").count().orderBy("g").collect()  # a number for each language
    if not counts:
        return []
    wanted = max(1, min(fit.rows_per_language, fit.max_rows // len(counts)))
    share = docs.sparkSession.createDataFrame([(r["g"], min(1.0, (1.3 * wanted + 8) / r["count"])) for r in counts], "g string, share double")
    key = F.xxhash64("i", "t")
    rows = rows.join(F.broadcast(share), "g").filter(F.pmod(key, F.lit(1 << 20)) / float(1 << 20) <= F.col("share"))
    spare = F.length("t") - fit.max_chars
    piece = F.when(spare > 0, F.substr("t", (F.pmod(F.xxhash64(key), F.greatest(spare, F.lit(1))) + 1).cast("int"), F.lit(fit.max_chars))).otherwise(F.col("t"))
    order = Window.partitionBy("g").orderBy("key", "i", "piece")
    rows = rows.select("g", "i", key.alias("key"), piece.alias("piece")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 2 * wanted)
    top = rows.orderBy("key", "i", "piece").select("piece", "g").toArrow()
    return list(zip(top.column("piece").to_pylist(), top.column("g").to_pylist(), strict=True))


class Bags:
    """The distinct buckets of many texts and how often each occurs, a number for both: 4 bytes where that will do."""

    def __init__(self, texts: list[str]) -> None:
        most = len(SIZES) * (max(map(len, texts), default=0) + 2)
        kind = np.uint32 if most < 1 << (32 - BITS) else np.uint64
        self._kind, self._bags = kind, []
        for t in texts:
            points, offsets, _ = normal_points([t], digits=False)
            at = np.concatenate([gram_buckets(points, offsets, n, BITS) for n in SIZES])
            own, times = np.unique(at[at < 1 << BITS], return_counts=True)
            self._bags.append(own.astype(kind) | times.astype(kind) << kind(BITS))

    def __len__(self) -> int:
        return len(self._bags)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, how often) of one text."""
        both = self._bags[k]
        return (both & self._kind((1 << BITS) - 1)).astype(np.int32), (both >> self._kind(BITS)).astype(np.float32)


def train(rows: list[tuple[str, str]], fit: Fit) -> Model | None:
    """Embeddings and linear layer by stochastic gradient descent; None if there is nothing to learn."""
    rows = [(t, g) for t, g in rows if any(map(str.isalpha, t))]
    languages = sorted({g for _, g in rows})
    if not languages:
        return None
    number = {g: k for k, g in enumerate(languages)}
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    texts, labels, calibration = [], [], []
    for k, i in enumerate(order):
        t, g = rows[i]
        parts = [t] + [t[s : s + fit.window] for s in rng.integers(0, max(1, len(t) - fit.window), fit.windows)]
        parts = [x for x in parts if any(map(str.isalpha, x))]
        if k % 5 == 0 and len(rows) >= 20:
            calibration += [(x, g) for x in parts]
        else:
            texts += parts
            labels += [number[g]] * len(parts)
    data = Bags(texts)
    del texts
    size, n = 1 << BITS, len(languages)
    e = rng.normal(0, 1 / DIM, (size + 1, DIM)).astype(np.float32)
    e[size] = 0
    w, b = np.zeros((DIM, n), np.float32), np.zeros(n, np.float32)
    steps, done = fit.epochs * len(data), 0
    for _ in range(fit.epochs):
        for i in rng.permutation(len(data)):
            at, many = data[i]
            weight = many / many.sum()
            x = weight @ e[at]
            z = x @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            rate = np.float32(fit.rate * (1 - done / steps))
            back = w @ p
            w -= rate * np.outer(x, p)
            b -= rate * 0.1 * p
            # a bucket's share of the average is small; its step is scaled up to the text's size
            e[at] -= rate * np.sqrt(weight)[:, None] * back
            done += 1
    known = np.zeros(size + 1, bool)
    for i in range(len(data)):
        known[data[i][0]] = True
    table, layer = (e @ w, None) if n <= DIM else (e, w)
    model = Model(languages, np.ascontiguousarray(table), layer, b, known, 1.0, 0.0, 0.0)
    if not calibration:
        return model
    some = [logits(model, [t for t, _ in calibration[i : i + 200]]) for i in range(0, len(calibration), 200)]
    z, share = (np.concatenate([x[k] for x in some]) for k in (0, 1))
    truth = np.array([number[g] for _, g in calibration])

    def nll(t: float) -> float:
        s = z / t
        top = s.max(axis=1)
        return float((np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(s)), truth]).mean())

    temperature = min(np.geomspace(0.02, 5, 80), key=nll)
    p = softmax(z / temperature)
    right = p.argmax(axis=1) == truth
    if not right.any():
        return model
    return Model(languages, model.table, layer, b, known, float(temperature), float(min(0.4, np.quantile(p.max(axis=1)[right], fit.lost))), float(0.9 * np.quantile(share[right], fit.lost)))


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def logits(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores of each language, share of known n-grams, letters) of each text."""
    points, offsets, letters = normal_points(texts, digits=False)
    total = np.zeros((len(texts), model.table.shape[1]))
    grams, known = np.zeros(len(texts)), np.zeros(len(texts))
    columns = [np.ascontiguousarray(c) for c in model.table.T]
    for n in SIZES:
        at = gram_buckets(points, offsets, n, BITS)
        for k, column in enumerate(columns):
            total[:, k] += np.add.reduceat(column[at], offsets[:-1], dtype=np.float64)
        grams += np.add.reduceat(at < 1 << BITS, offsets[:-1], dtype=np.int64)
        known += np.add.reduceat(model.known[at], offsets[:-1], dtype=np.int64)
    grams = np.maximum(grams, 1)
    mean = total / grams[:, None]
    return (mean if model.layer is None else mean @ model.layer) + model.bias, known / grams, letters


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit: Fit = Fit(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, after the columns named in ``keep``."""
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, id_col, text_col, lang_col, fit), fit))
    give_back()

    # a text that is kept isn't sent to Python twice
    told, gone = (text_col, ()) if text_col in keep else ("_text", ("_text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for a, b, texts in text_slices(batch, told):
                texts = texts.to_pylist()
                pred, score, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if m is not None:
                    z, share, letters = logits(m, texts)
                    p = softmax(z / m.temperature)
                    best = p.argmax(axis=1)
                    has = letters > 0
                    pred = [m.languages[k] if y else UNKNOWN for k, y in zip(best, has, strict=True)]
                    score = np.where(has, p.max(axis=1), 0.0)
                    out = ~has | (score < m.least) | (share < m.least_known)
                rest = [batch.column(c).slice(a, b - a) for c in range(batch.num_columns) if batch.schema.names[c] not in gone]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [*(c for c in batch.schema.names if c not in gone), "lang_pred", "score", "rejected"])

    narrow = docs.select(*(F.col(c) for c in keep), F.col(id_col).alias("doc_id" if "doc_id" not in keep else "_id"), held_out(F.col(id_col)).alias("held_out"), *([] if text_col in keep else [F.col(text_col).alias("_text")]))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name not in gone)
    return narrow.mapInArrow(giving_back(run), f"{kept}, lang_pred string, score double, rejected boolean")
