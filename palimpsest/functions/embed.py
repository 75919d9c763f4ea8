"""Text vectors: a deterministic hash embedding built in, a model where one is given."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 384


def hash_vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit vector drawn from a generator seeded by the text's SHA-256."""
    seed = int.from_bytes(hashlib.sha256(text.encode("utf-8")).digest()[:8], "little")
    v = np.random.default_rng(seed).normal(size=dimensions)
    return (v / np.linalg.norm(v)).astype(np.float32)


def embedder(model: Callable[[list[str]], np.ndarray] | None = None, dimensions: int = DIMENSIONS) -> Callable[[Column], Column]:
    """A column function from text to ``array<float>``; null gives null, and equal texts of a batch are embedded once."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            distinct = list(dict.fromkeys(t for t in texts if t is not None))
            vectors = model(distinct) if model and distinct else [hash_vector(t, dimensions) for t in distinct]
            known = dict(zip(distinct, vectors, strict=True))
            yield pd.Series([None if t is None else known[t] for t in texts])

    return run


def question_vectors(questions: Column, model: Callable[[list[str]], np.ndarray] | None = None, dimensions: int = DIMENSIONS) -> Column:
    """An array of questions as ``array<struct<text, embedding>>``."""

    @F.pandas_udf("array<struct<text:string,embedding:array<float>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            distinct = list(dict.fromkeys(q for row in rows if row is not None for q in row))
            vectors = model(distinct) if model and distinct else [hash_vector(q, dimensions) for q in distinct]
            known = dict(zip(distinct, vectors, strict=True))
            yield pd.Series([None if row is None else [{"text": q, "embedding": known[q]} for q in row] for row in rows])

    return run(questions)


#: What a turn's vector is held against (fixed values).
STYLE_ANCHORS = {
    "vulnerability": "struggling overwhelmed scared anxious worried lonely",
    "gratitude": "thankful grateful appreciate blessed happy touched",
    "formal": "sir madam please kindly respectfully formal correspondence",
    "casual": "hey yeah gonna kinda sorta whatever dude",
}


def decode_vector(blob: bytes | None) -> list[float] | None:
    """A stored little-endian float32 vector; empty gives None."""
    return None if not blob else list(struct.unpack(f"<{len(blob) // 4}f", blob))


def style_deltas(text_vector: Column, anchors: dict[str, Column], dot: Callable[[Column, Column], Column]) -> Column:
    """How a turn moves a profile: warmth by vulnerability and gratitude, formality by formal less casual, in hundredths."""
    d = {k: dot(text_vector, v) for k, v in anchors.items()}
    return F.struct(((d["vulnerability"] + d["gratitude"]) / 100).alias("warmth"), ((d["formal"] - d["casual"]) / 100).alias("formality"))


def direction(similarities: dict[str, Column]) -> Column:
    """The anchor with the largest similarity; ties in the order past, future, ongoing, present."""
    order = ["past", "future", "ongoing", "present"]
    return F.array_max(F.array(*[F.struct(similarities[k].alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(order) if k in similarities]))["k"]


def has_supersession_shape(change: Column, others: list[Column]) -> Column:
    """Whether a text is nearer to the anchor of change than to the mean of the others, and nearest to it."""
    mean = sum(others[1:], others[0]) / len(others)
    return (change >= F.greatest(*others)) & (change > mean)
