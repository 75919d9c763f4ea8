from __future__ import annotations

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import bpe, packing
from tests.llm import helpers

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
HARD = ["", " ", "aaaaaaaaaaaaaaa", "  \n\n  x", "it's we'll 'S", "\0\0\0ab", "日本語🎉🎉", "<|endoftext|>", "a" * 20_001, "é" * 999 + " " * 77, "x  y", "\r\n\t12345 6_7"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_the_library(library):
    m = bpe.MergeReplay(open(RANKS, "rb").read(), P.PATTERN)
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice("abc 'é1\n_") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for ids, t in zip(m.encode(texts), texts, strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode_ordinary(t)
        assert m.decode(ids).decode() == t


def test_the_cache_may_overflow(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    m = bpe.MergeReplay(open(RANKS, "rb").read(), P.PATTERN)
    for texts in (["one two two three three"], ["three four four five five six six"], ["one two"]):
        assert [np.frombuffer(x, "<i4").tolist() for x in m.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_encode_and_decode_columns(spark, library):
    rows = [(i, t, "kept") for i, t in enumerate(HARD)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded2 string")
    got = bpe.encode(df, RANKS, P.PATTERN, block_bytes=100)
    back = bpe.decode(got, RANKS).collect()
    assert got.columns == ["doc_id", "decoded2", "ids"]
    for r in back:
        text = dict((i, t) for i, t, _ in rows)[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert bytes(r["decoded"]).decode() == text
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_op3_digests(spark, small, library):
    from palimpsest.llm import registry

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = registry.op3_merge_replay(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def fewest(items: list[int], capacity: int) -> int:
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i: int, open_: list[int]) -> None:
        if len(open_) >= best[0]:
            return
        if i == len(items):
            best[0] = len(open_)
            return
        for k in {room: k for k, room in enumerate(open_) if room + items[i] <= capacity}.values():
            open_[k] += items[i]
            go(i + 1, open_)
            open_[k] -= items[i]
        go(i + 1, [*open_, items[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = random.Random(1)
    for _ in range(800):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        counts: dict[int, int] = defaultdict(int)
        for s in items:
            counts[s] += 1
        fixed, left = packing.reduce_by_dominance(counts, capacity)
        assert sum(fixed.values()) + fewest([s for s, n in left.items() for _ in range(n)], capacity) == fewest(items, capacity)
        used: dict[int, int] = defaultdict(int)
        for pattern, n in packing.solve(counts, capacity).items():
            assert sum(s * q for s, q in pattern) <= capacity
            for s, q in pattern:
                used[s] += q * n
        assert used == counts


def test_packing_a_large_histogram_is_near_the_bound():
    rng = random.Random(4)
    counts = {s: rng.randint(1, 10**6) for s in range(1, 2049)}
    n = sum(packing.solve(counts, 2048).values())
    bound = -(-sum(s * c for s, c in counts.items()) // 2048)
    assert bound <= n <= 1.01 * bound


def check_packing(rows, texts, encode, capacity=2048):
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = [*encode(texts[doc]), 0]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // capacity) and all(r["length"] == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == helpers.crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    total = sum(r["length"] for r in rows)
    assert len(places) <= 1.05 * total / capacity + 2


def test_op2_against_the_tokenizer(spark, small):
    from palimpsest.llm import registry

    own = Tokenizer.from_file(JSON)
    own.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check_packing(registry.op2_best_fit_packing(spark, small).collect(), texts, lambda t: own.encode(t, add_special_tokens=False).ids)


def test_ranks_from_the_file_give_the_same_ids():
    own = packing.encoder(open(JSON).read())
    ranks = packing.ranks_of(open(JSON).read())
    fast = packing._encoding(ranks).encode_ordinary
    for t in HARD:
        assert own(t) == fast(t)


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x"), (3, "word " * 9000)], "doc_id long, text string")
    rows = packing.pack_documents(df, JSON).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack_documents(df.limit(0), JSON).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(spark.createDataFrame([(1, 3000)], "k int, length int"))


def test_pack_takes_any_table(spark):
    df = spark.range(500).select("id", (F.col("id") % 37 + 1).cast("int").alias("size"), F.lit("x").alias("sequence"))
    got = packing.pack(df, "size", ["id"], capacity=64)
    assert got.columns == ["id", "size", "sequence", "sequence_id", "offset"]
    fill = got.groupBy("sequence_id").agg(F.sum("size").alias("n"), F.max(F.col("offset") + F.col("size")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 64 for r in fill)
