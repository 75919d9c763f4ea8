"""Toxicity by a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are its distinct n-grams of 3 to 6 code points, in lower case, hashed to ``BUCKETS``. The classifier is
fitted to a bounded sample, at most ``FIT_ROWS`` labelled rows: those with the smallest hash of their id. The sample's ids
and labels are broadcast (their number has that bound), so no text is shuffled.

1. Sums of fixed size tell in how many texts of each label a bucket occurs, and from that each bucket's log-count ratio r.
2. The ``FEATURES`` buckets whose ratio is most standard errors from 0 become the features, with value r where present.
3. A logistic regression with L2 penalty is fitted to them.

Scoring is one pass over the texts, without a shuffle. Labels, language, source and id are never inputs of a score.

Defined cases: a null text counts as empty, and an empty text scores as the intercept alone; rows with a null label or id
are not learned from; repeated ids learn the larger of their labels; without labelled rows of both kinds the score is the smoothed share of
the label; repeated rows, ties and other columns have no effect on a row's score; texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import bound_batches, durable, lean

ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 19
FEATURES = 2000
FIT_ROWS = 20_000
PARTS = 64
SMOOTH, PENALTY, ROUNDS = 1.0, 1e-3, 400
_BLOCK = 1 << 13
#: Code points hashed at a time; n-grams across the cut are kept by an overlap.
_SPAN = 1 << 18
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spans(text: str) -> Iterator[np.ndarray]:
    text = text.lower()
    for lo in range(0, max(1, len(text)), _SPAN):
        part = text[lo : lo + _SPAN + ORDERS[-1] - 1]
        yield np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, with repetitions."""
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    for c in _spans(text):
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, ORDERS[-1] + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = h[:m] * _BASE + c[n - 1 :] + np.uint64(1)
            if n >= ORDERS[0]:
                x = h ^ (h >> np.uint64(31))
                yield ((x * _MIX) >> shift).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """``slots``: a bucket's place among the features, or -1; ``weights`` include the log-count ratios."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def present(self, text: str) -> np.ndarray:
        found = []
        for b in buckets(text):
            s = self.slots[b]
            found.append(s[s >= 0])
        return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=self.slots.dtype)

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    total, texts = np.zeros((2, BUCKETS), dtype=np.int32), [0, 0]
    seen = np.zeros(BUCKETS, dtype=bool)
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[:] = False
            for x in buckets(text or ""):
                seen[x] = True
            total[label] += seen
            texts[label] += 1
    for label in (0, 1):
        if texts[label]:
            rows = [(label, k, total[label, k * _BLOCK : (k + 1) * _BLOCK].astype("<i8").tobytes()) for k in range(BUCKETS // _BLOCK)]
            rows.append((label, -1, np.array([texts[label]], dtype="<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["label", "block", "counts"])


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, dtype="<i8") for c in rows["counts"])
    return pd.DataFrame({"label": rows["label"].iloc[:1], "block": rows["block"].iloc[:1], "counts": [total.astype("<i8").tobytes()]})


def _fit(label: np.ndarray, row: np.ndarray, slot: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; ``row, slot`` are the places of the ones in the features."""
    n, k = len(label), len(ratio)
    value = ratio[slot]
    w, bias, prior = np.zeros(k), 0.0, label.mean()
    bias = float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(k + 1), np.zeros(k + 1), 0
    for t in range(1, ROUNDS + 1):
        z = bias + np.bincount(row, weights=value * w[slot], minlength=n)
        off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label
        g = np.append(np.bincount(slot, weights=value * off[row], minlength=k) / n + PENALTY * w, off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - float(step[-1])
    return w * ratio, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model learned from the labelled rows that are not held out."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    # a bounded table in a bounded number of parts, each of which adds one vector of counts
    rows = durable(rows.select("__id", "__text", "__label"), "labelled").coalesce(PARTS)
    sums = rows.select("__text", "__label").mapInArrow(_counts, "label int, block int, counts binary").groupBy("label", "block").applyInPandas(_added, "label int, block int, counts binary")
    count, texts = np.zeros((2, BUCKETS)), [0, 0]
    for r in sums.collect():
        part = np.frombuffer(bytes(r["counts"]), dtype="<i8")
        if r["block"] < 0:
            texts[r["label"]] = int(part[0])
        else:
            count[r["label"], r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = part
    share = (texts[1] + 1) / (sum(texts) + 2)
    flat = Model(np.full(BUCKETS, -1, dtype=np.int16), np.zeros(1), float(np.log(share / (1 - share))))
    if not all(texts):
        return flat
    p, q = count[1] + SMOOTH, count[0] + SMOOTH
    ratio = np.log(p / (texts[1] + 2 * SMOOTH)) - np.log(q / (texts[0] + 2 * SMOOTH))
    sure = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    sure[(count[0] + count[1]) < 3] = 0
    best = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    best = best[sure[best] > 0]
    if not len(best):
        return flat
    slots = np.full(BUCKETS, -1, dtype=np.int16)
    slots[best] = np.arange(len(best), dtype=np.int16)
    blank = spark.sparkContext.broadcast(Model(slots, np.zeros(len(best)), 0.0))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            cells = [blank.value.present(t or "").astype("<i2").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(cells, pa.binary())], names=["label", "id", "slots"])

    # at most fit_rows ids: bounded on the driver by that number times the features
    found = rows.select("__text", "__label", "__id").mapInArrow(present, "label int, id long, slots binary").collect()
    fit = [(r["label"], np.frombuffer(bytes(r["slots"]), dtype="<i2")) for r in sorted(found, key=lambda r: (r["id"], r["label"], bytes(r["slots"])))]
    label = np.array([x for x, _ in fit], dtype=float)
    if not 0 < label.mean() < 1:
        return flat
    row = np.repeat(np.arange(len(fit)), [len(s) for _, s in fit])
    weights, bias = _fit(label, row, np.concatenate([s for _, s in fit]).astype(np.int64), ratio[best])
    return Model(slots, weights, bias)


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out double`` added."""
    spark = df.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            scores = [held.value.score(t or "") for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, out])

    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(run, T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.DoubleType(), False)]))


def crc_remainder(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
