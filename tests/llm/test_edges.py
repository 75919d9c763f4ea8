"""Columns that clash with an operator's own, repeated rows, and other cases each operator defines."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from palimpsest.llm import bpe, chat, common, exact_dedup, hnsw, near_dedup, packing, registry, toxicity, url_filter, warc
from tests.llm import helpers

RANKS = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string"


def with_columns(df, names: str):
    return df.withColumns({c: F.lit(f"own {c}") for c in names.split()})


# near dedup: sets whose keys agree in their first 64 bits


def test_sets_are_told_apart_by_the_whole_key(spark):
    rng = random.Random(9)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(30)] for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(10, " ".join(words[0])), (11, " ".join([*words[1][:29], "x"]))]
    half = lambda hashes: bytes(8) + near_dedup.set_key(hashes)[8:]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), words=3, percent=85, key=half).collect()}
    assert got == helpers.components(rows, 3, 85)


# exact dedup: a level between for hot texts


@pytest.mark.parametrize("memory", [150, 1 << 20])
def test_hot_texts_meet_in_two_levels(spark, memory):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot text", "warm  text", f"cold {rng.randrange(40)}", None, ""])) for i in range(400)]
    df = with_columns(spark.createDataFrame(rows, DOCS).repartition(12), "g h n first rep content keep_id")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.duplicates(df, memory=memory, meet=3).collect()}
    assert got == helpers.copies(rows)


# packing and tokens


def test_packing_replaces_and_keeps_columns(spark):
    df = spark.range(60).select("id", (F.col("id") % 7 + 1).cast("int").alias("length"), F.lit(-1).alias("sequence_id"), F.lit(-1).alias("offset"), F.lit("x").alias("nth"), F.lit("y").alias("per"))
    got = packing.pack(df, "length", ["id"], capacity=16)
    assert got.columns == ["id", "length", "nth", "per", "sequence_id", "offset"]
    assert got.where("sequence_id < 0 or offset < 0 or nth <> 'x'").count() == 0


def test_encoding_keeps_rows_and_columns(spark):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for t, i in bpe.MergeReplay(open(RANKS, "rb").read(), P.PATTERN).ranks.items()}, special_tokens={})
    rows = [(1, "twice said", "a"), (1, "twice said", "a"), (None, None, "b"), (2, "long " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("decoded", F.lit(7))
    got = bpe.encode(df, RANKS, P.PATTERN, ids_col="tokens", decoded_col="bytes")
    assert got.columns == ["doc_id", "ids", "decoded", "tokens", "bytes"]
    assert sorted((r["doc_id"] or 0, r["ids"] or "", list(r["tokens"]), bytes(r["bytes"])) for r in got.collect()) == sorted((i or 0, x or "", own.encode_ordinary(t or ""), (t or "").encode()) for i, t, x in rows)


def test_rank_files_that_one_pass_cannot_replay_are_refused():
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 299}
    bad = b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items())
    with pytest.raises(ValueError, match="ascending"):
        bpe.MergeReplay(bad, P.PATTERN).check()
    bpe.MergeReplay(open(RANKS, "rb").read(), P.PATTERN).check()


# nearest neighbours


def test_vectors_at_the_ends_of_the_range(spark):
    v = {1: [1.0, 0.0], 2: [1e-200, 0.0], 3: [1e200, 1.0], 4: [0.0, 1e-300], 5: [1e300, 1e300], 6: [-1e-310, 1e-310]}
    df = with_columns(spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>"), "shard rank score width item")
    got = defaultdict(list)
    for r in hnsw.nearest(hnsw.build_index(df), df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = {i: np.array(x) / np.abs(x).max() for i, x in v.items()}
    for q, found in got.items():
        want = helpers.nearest(unit, q, 5)
        assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=1e-9)
        assert all(np.isfinite(s) for _, s in found)
    assert got[1][0] == (2, 1.0) and len(got) == 6


def test_queries_visit_their_nearest_cells_alone(spark):
    draw = np.random.default_rng(8)
    middle = draw.normal(size=(40, 16))
    v = {i: middle[i % 40] + 0.6 * draw.normal(size=16) for i in range(2400)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>")
    index = hnsw.build_index(df, shard_rows=40)
    sizes = [len(r["ids"]) // 8 for r in index.select("ids").collect()]
    assert len(sizes) > 40 and sum(sizes) == 2400 and max(sizes) <= 80
    asked = df.where("vec_id % 50 = 0")
    got = defaultdict(set)
    for r in hnsw.nearest(index, asked, probes=12).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = [len(got[q] & {i for i, _ in helpers.nearest(v, q, 5)}) for q in range(0, 2400, 50)]
    assert sum(hits) >= 0.9 * 5 * len(hits)


# URL filter


def test_repeated_captures_are_evaluated_as_rows(spark):
    rows = [(1, "http://bad.org/", "2024-02-01", "mine")] * 3 + [(2, None, None, "mine")] * 2
    df = with_columns(spark.createDataFrame(rows, "n long, url string, at string, kind string").withColumn("fetched_at", F.col("at").cast("timestamp_ntz")), "list value valid_from valid_to host")
    entries = spark.createDataFrame([("a", "domain", "bad.org", "add", "2024-01-10")] * 2, "list string, kind string, value string, action string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = url_filter.evaluate(df, entries)
    assert Counter((r["n"], r["blocked"], r["n_matches"], r["kind"], r["list"]) for r in got.collect()) == {(1, True, 1, "mine", "own list"): 3, (2, False, 0, "mine", "own list"): 2}


# chat: random trees against walking up from every leaf


def test_random_trees_against_brute_force(spark):
    rng = random.Random(11)
    nodes = []
    for tree in range(25):
        n = rng.randint(1, 30)
        for k in range(n):
            parent = None if k == 0 or rng.random() < 0.05 else rng.randrange(max(0, k - 6), k) if rng.random() < 0.95 else rng.choice([99, rng.randrange(n)])
            nodes.append((f"t{tree}", k, parent, rng.choice([None, 0.0, 1.0, 1.0, 2.5, -1.0])))
    want = {}
    for tree in {t for t, *_ in nodes}:
        own = {k: (p, s or 0.0) for t, k, p, s in nodes if t == tree}
        up = {k: p if p in own else None for k, (p, _) in own.items()}
        paths = []
        for leaf in own.keys() - {p for p in up.values() if p is not None}:
            path, at = [], leaf
            while at is not None and at not in path:
                path.insert(0, at)
                at = up[at]
            if at is None:
                paths.append((-sum(own[k][1] for k in path), -len(path), leaf, path))
        for branch, (*_, leaf, path) in enumerate(sorted(paths)[:3], 1):
            want[tree, branch, leaf] = path
    df = with_columns(spark.createDataFrame(nodes, "tree string, node long, parent long, score double"), "n up total branch step")
    got = defaultdict(list)
    for r in chat.reply_paths(df.select("tree", "node", "parent", "score"), branches=3).orderBy("step").collect():
        got[r["tree"], r["branch"], r["leaf"]].append(r["node"])
    assert got == want
    texts = df.withColumn("role", F.when(F.col("node") % 2 == 0, "user").otherwise("assistant")).withColumn("text", F.concat(F.lit("said <| "), F.col("node")))
    back = chat.read_back(chat.format_trees(texts, branches=3), ["tree", "branch", "leaf"]).collect()
    assert {(r["tree"], r["branch"], r["leaf"]): [t["text"] for t in r["turns"]] for r in back} == {k: [f"said <| {n}" for n in p] for k, p in want.items()}


# toxicity


def bucket_set(text: str) -> set[int]:
    """The buckets of a text's n-grams, one n-gram at a time in plain integers."""
    out, mask = set(), (1 << 64) - 1
    low = text.lower()
    for n in toxicity.ORDERS:
        for k in range(len(low) - n + 1):
            h = 0
            for c in low[k : k + n]:
                h = (h * 0x100000001B3 + ord(c) + 1) & mask
            out.add((((h ^ (h >> 31)) * 0x9E3779B97F4A7C15) & mask) >> 45)
    return out


@pytest.fixture(scope="module")
def scored(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    got = {r["doc_id"]: r for r in registry.op9_nb_ngram_toxicity(spark, medium).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    return got, texts, {r["doc_id"]: r["toxic"] for r in labels.collect()}, toxicity.train(docs, labels)


def test_recall_and_precision_of_toxic_texts(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = registry.op9_nb_ngram_toxicity(spark, folder).where("held_out").select("doc_id", "predicted").collect()
    own = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["doc_id"] in toxic]
    hit, real = sum(p and t for p, t in own), sum(t for _, t in own)
    assert real >= 50 and hit >= 0.9 * real and hit >= 0.9 * sum(p for p, _ in own)


def test_scores_against_brute_force(scored):
    """Ratios, features and scores computed again with sets and dictionaries; the fit is held against its own condition."""
    got, texts, toxic, model = scored
    known = {i: t for i, t in toxic.items() if t in (0, 1) and toxicity.crc_remainder(i) != 2}
    sets = {i: bucket_set(texts[i]) for i in known}
    count, total = (Counter(), Counter()), [0, 0]
    for i, t in known.items():
        count[t].update(sets[i])
        total[t] += 1
    ratio, sure = {}, {}
    for b in count[0].keys() | count[1].keys():
        p, q = count[1][b] + 1.0, count[0][b] + 1.0
        ratio[b] = np.log(p / (total[1] + 2)) - np.log(q / (total[0] + 2))
        sure[b] = abs(ratio[b]) / np.sqrt(1 / p + 1 / q) if count[0][b] + count[1][b] >= 3 else 0.0
    best = sorted(sure, key=lambda b: (-round(sure[b], 9), b))[: toxicity.FEATURES]
    features = {int(b): int(s) for b, s in enumerate(model.slots) if s >= 0}
    # of equally sure buckets any may be chosen
    least = min(sure[b] for b in best)
    assert len(features) == len(best) and min(sure[b] for b in features) == pytest.approx(least, rel=1e-6)
    weight = {b: model.weights[s] for b, s in features.items()}
    for i in list(texts)[:150]:
        z = model.bias + sum(weight.get(b, 0.0) for b in bucket_set(texts[i][:3000]))
        assert model.score(texts[i][:3000]) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        if len(texts[i]) <= 3000:
            assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    # the slope of the penalised loss is near 0 in every weight: w = weight / ratio
    off = {i: 1 / (1 + np.exp(-(model.bias + sum(weight.get(b, 0.0) for b in s)))) - known[i] for i, s in sets.items()}
    slope = {b: toxicity.PENALTY * weight[b] / ratio[b] for b in features}
    for i, s in sets.items():
        for b in s & features.keys():
            slope[b] += ratio[b] * off[i] / len(known)
    assert max(map(abs, slope.values())) < 0.01 and abs(sum(off.values())) / len(known) < 0.01


def test_repeated_rows_score_alike(spark):
    docs = with_columns(spark.createDataFrame([(i % 30, ("vile scum " if i % 3 == 0 else "kind words ") * 3) for i in range(90)], DOCS), "label slots score id")
    labels = with_columns(spark.createDataFrame([(i % 30, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int"), "text score")
    got = toxicity.score(docs, toxicity.train(docs, labels), out="p")
    assert got.columns == [*docs.columns, "p"]
    by = defaultdict(set)
    for r in got.collect():
        by[r["doc_id"]].add(r["p"])
    assert all(len(s) == 1 for s in by.values()) and got.count() == 90


# WARC


def test_colliding_digests_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(warc.F, "sha1", lambda c: F.lit("0" * 40))
    df = with_columns(spark.createDataFrame([(1, "u", "ab"), (2, "u", "cd"), (3, "u", "ab"), (4, "u", "abc")], "page_id long, url string, html string"), "page payload row same digest")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None)}


@pytest.mark.parametrize("size", [0, 1, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 64 << 20])
def test_inflated_pieces_are_bounded(size):
    packed = gzip.compress(bytes(size)) + gzip.compress(b"tail" * 10)
    digest, n = hashlib.sha1(), 0
    for piece in warc.inflate(io.BytesIO(packed)):
        assert len(piece) <= 1 << 20
        digest.update(piece)
        n += len(piece)
    assert n == size + 40 and digest.digest() == hashlib.sha1(bytes(size) + b"tail" * 10).digest()


# pipeline


def test_pipeline_on_odd_documents(spark, small):
    base = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    long = " ".join(f"w{k % 9000}" for k in range(60_000))
    odd = [(9001, None), (9002, None), (9003, ""), (9004, long), (9004, long), (9005, long + " x"), (9006, "word"), (None, "no id at all")]
    rows = spark.createDataFrame([(i, t) for i, t in odd], DOCS)
    docs = base.unionByName(rows.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast(base.schema["n_chars"].dataType)))
    docs = common.durable(with_columns(docs, "node band g first rep __key length piece"), "odd")
    start = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.durable(stage(spark, docs, small), name)
        assert docs.schema == T.StructType(start.schema.fields)
    left = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    # one of the empty texts, of the long ones the first, and all else that nothing resembles
    assert left[9001] + left[9002] + left[9003] == 1 and left[9004] == 1 and left[9005] == 0 and left[9006] == 1 and left[None] == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in packed} == set(left)


def test_a_settled_table_leaves_nothing_else(spark):
    before = set(common._made)
    docs = common.durable(spark.range(5), "read")
    out = common.settled(docs, lambda: common.durable(docs, "inner").where("id > 1"), "out")
    assert sorted(r["id"] for r in out.collect()) == [2, 3, 4]
    assert len(set(common._made) - before) == 1


def test_tables_of_others_are_never_deleted(spark, tmp_path):
    path = str(tmp_path / "palimpsest" / "theirs")
    spark.range(3).write.parquet(path)
    common.discard(spark, spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 3


# repeated ids, and values of columns that clash


FOX = "the quick brown fox jumps over the lazy dog and runs far away into the deep green forest at night"


def test_near_copies_go_by_row_not_by_id(spark):
    keep = lambda rows: sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()), key=repr)
    other = "nothing of this text is like any other text that stands in the same small table of rows"
    assert keep([(1, FOX), (2, FOX + " again"), (2, other)]) == [(1, FOX), (2, other)]
    assert keep([(5, "w"), (5, "v"), (4, "w")]) == [(4, "w"), (5, "v")]
    # rows that agree in id and text are one document; of texts without words all stay
    assert keep([(3, FOX), (3, FOX), (7, ""), (7, ""), (8, None)]) == sorted([(3, FOX), (7, ""), (7, ""), (8, None)], key=repr)
    # known ids stay before null ones, and of null ones one does
    assert keep([(None, FOX), (9, FOX)]) == [(9, FOX)]
    assert len(keep([(None, FOX), (None, FOX), (None, FOX.upper())])) == 1
    # one id, one set, two texts
    assert len(keep([(1, FOX), (1, FOX.upper()), (1, other)])) == 2


def test_without_a_screen_every_pair_of_a_bucket_is_compared(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**5)}" for _ in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(10**5)}" for w in base)) for i in range(12)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), words=3, percent=85, margin=None).collect()}
    assert got == helpers.components(rows, 3, 85)


def test_the_odds_of_the_screen():
    """The binomial tail that the docstring states: registers of a pair at the threshold that agree, of all in use."""
    from math import comb

    for p in (0.8, 0.85):
        n = near_dedup.REGISTERS
        cut = float(near_dedup.least_estimate(p, np.array([n]))[0]) * n
        tail = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1) if k < cut)
        assert tail < 1e-8


def test_clashing_columns_keep_their_values(spark, small):
    rows = [(1, FOX, "a"), (2, FOX, "b"), (3, "another text", "c")]
    names = "id key own mark known seen first row best n at score doc_sha"
    df = with_columns(spark.createDataFrame(rows, "doc_id long, text string, tag string"), names)
    wide = lambda out: {(r["doc_id"], r["tag"], *(r[c] for c in names.split())) for r in out.collect()}
    same = lambda *ids: {(i, tag, *(f"own {c}" for c in names.split())) for i, _, tag in rows if i in ids}
    for out in (exact_dedup.deduplicate(df), near_dedup.keep_one(df), corpus_pipeline.drop_near_copies(spark, df, small)):
        assert out.columns == df.columns and wide(out) == same(1, 3)
    kept = corpus_pipeline.drop_toxic(spark, df, small)
    assert kept.columns == df.columns and wide(kept) <= same(1, 2, 3)
    marked = df.withColumn("url", F.lit("http://a.example/en")).withColumn("fetched_at", F.lit("2024-01-05").cast("timestamp_ntz")).withColumn("__row", F.lit("mine"))
    entries = spark.createDataFrame([("l", "host", "a.example", "add", None)], "list string, kind string, value string, action string, at timestamp_ntz").withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    found = url_filter.evaluate(marked, entries)
    assert wide(found) == same(1, 2, 3) and {(r["__row"], r["blocked"], r["n_matches"]) for r in found.collect()} == {("mine", True, 1)}


def test_of_a_repeated_query_id_the_smallest_vector_asks(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 40)] + [(50, [9.0, 1.0]), (50, [-1.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for _ in range(3):
        got = hnsw.nearest(hnsw.build_index(df), df.where("vec_id = 50").repartition(4), k=3).collect()
        assert [(r["rank"], r["vec_id"]) for r in got] == [(k + 1, v) for k, (v, _) in enumerate(helpers.nearest({i: np.array(v) for i, v in rows if i != 50} | {50: np.array([-1.0, 5.0])}, 50, 3))]


def test_a_block_in_which_no_pair_passes_the_screen():
    import pyarrow as pa

    near, far = (near_dedup.shingles(b" ".join(b"%s%d" % (w, i) for i in range(60)), 3) for w in (b"a", b"b"))
    sketches = [near_dedup.sketch(x).copy() for x in (near, far)]
    sketches[1][: near_dedup.BAND] = sketches[0][: near_dedup.BAND]  # one band in common
    at = int(max(near_dedup.size_class(np.array([len(near)]), 80)))
    rows = {"band": [1, 1], "i": [0, 0], "j": [0, 0], "node": [1, 2], "n_shingles": [len(near), len(far)], "component": [1, 2], "block": [0, 0], "place": [0, 0], "class": [at, at], "sketch": [x.tobytes() for x in sketches], "grams": [np.sort(x).view(np.int64) for x in (near, far)]}
    batch = pa.RecordBatch.from_pydict(rows)
    assert list(near_dedup._block_links(80, near_dedup.MARGIN)(iter([batch]))) == []
    assert sum(b.num_rows for b in near_dedup._open_nodes(80, near_dedup.MARGIN)(iter([batch]))) == 0
    # without a screen the pair is looked at on its full sets, and is no link
    assert sum(b.num_rows for b in near_dedup._open_nodes(80, None)(iter([batch]))) == 2
    assert list(near_dedup._block_links(80, None)(iter([batch]))) == []
