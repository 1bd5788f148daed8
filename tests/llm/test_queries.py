"""Registered queries against their SQL twins, and the pipeline against brute force."""

import importlib.util
import os

import numpy as np
import pytest

import brute
import corpus_pipeline
from tallyglass.llm import mixing, quality
from tallyglass.llm.queries import QUERIES, TWINS, tokenizer_file
from tallyglass.llm.store import written

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_spec = importlib.util.spec_from_file_location("compare", os.path.join(_ROOT, "tools", "compare.py"))
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf_dir, name, monkeypatch):
    monkeypatch.setitem(compare.QUERIES, name, QUERIES[name])
    monkeypatch.setitem(compare.TWINS, name, TWINS[name])
    ok, message, _ = compare.compare(spark, compare.duck(sf_dir), name, sf_dir)
    assert ok, message


def test_pipeline_keeps_the_order_of_the_mix(spark):
    docs = spark.range(900).selectExpr(
        "id AS doc_id", "repeat(concat('word', id, ' '), CAST(1 + id % 97 * (id DIV 300) AS INT)) AS text", "'en' AS lang",
        "concat('s', id % 7 * (id % 3)) AS source", "0L AS n_chars",
    )
    want = [x.doc_id for x in mixing.mix_sources(docs).orderBy("slot", "place").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = written(corpus_pipeline.source_mixing(spark, docs, ""), "mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(mixed.inputFiles()) > 2
    got = sorted((x.position, x.doc_id) for x in corpus_pipeline.bpe_tokens(spark, mixed, "").collect())
    assert got == list(enumerate(want))


def test_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {x.doc_id for x in quality.judge(docs, model).collect() if x.kept}
    rows = sorted((x.doc_id, x.text) for x in docs.collect() if x.doc_id in good)
    rows = [(d, new) for (d, old), new in zip(rows, brute.kept_lines(rows)) if new == old or new.split()]
    _, part = brute.similar(rows)
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in rows if part[d] == d}
    got = {x.doc_id: np.frombuffer(bytes(x.ids), "<u4").tolist() for x in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want
