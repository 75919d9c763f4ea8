from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import common, toxicity
from tests.llm import helpers
from tests.llm.test_tokens import check_packing


def test_each_stage_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    left = {i: t for i, t in rows.items() if model.score(t or "") < corpus_pipeline.TOXIC_FROM}
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def step(name: str) -> None:
        nonlocal docs
        docs = common.durable(stages[name](spark, docs, small), name)
        assert docs.columns == columns
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == left

    step("toxicity")
    left = {i: left[i] for i, (_, _, kept, _) in helpers.copies(list(left.items())).items() if kept}
    step("exact_dedup")
    left = {i: left[i] for i, (_, _, kept) in helpers.components(list(left.items()), 5, 80).items() if kept}
    step("near_dedup")
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    packed = [r.asDict() | {"ids_crc32": helpers.zlib.crc32(bytes(r["ids"]))} for r in stages["packing"](spark, docs, small).collect()]
    check_packing(packed, {i: t or "" for i, t in left.items()}, lambda t: own.encode(t, add_special_tokens=False).ids)
    assert corpus_pipeline.run(spark, small).count() == len(packed)


def test_an_empty_table_runs_through(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0
