import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyglass.functions.text import STOPWORDS, keyword_tokens
from tallyglass.operators import bm25 as kw
from tallyglass.operators import encode, fusion, knn
from tallyglass.operators import tokens
from tallyglass.plans.retrieval import retrieve, trace
from tallyglass.session import shared_dir

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(40)] + ["order_status", "the", "of"]
# Word 0 stands in almost every chunk: its idf is negative and floored.
TEXTS = ["w0 " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["", "the of", "w0", "w0"]
KINDS = [("a", "b", "c")[i % 3] for i in range(len(TEXTS))]
ASKED = ["w1 w2 w2 order_status", "w0", "the of", "absent", "w3 " * 5 + "w0 w4", ""]


def plain(text):
    return [t for t in "".join(ch if ch.isascii() and (ch.isalnum() or ch == "_") else " " for ch in text.lower()).split() if t not in STOPWORDS]


def okapi(asked):
    """Plain-loop BM25 over the whole corpus."""
    docs = [plain(t) for t in TEXTS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = max(0.25 * sum(idf.values()) / len(idf), 0.0)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    scores = []
    for d in docs:
        tf = Counter(d)
        scores.append(round(sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in plain(asked)), 9))
    return scores


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(zip(KINDS, TEXTS))], "chunk_id bigint, doc_type string, content string").repartition(3)


@pytest.fixture(scope="module")
def index(chunks, tmp_path_factory):
    return kw.build_index(chunks).save(str(tmp_path_factory.mktemp("index")))


def queries(spark, want=None):
    return spark.createDataFrame([(i, t, want) for i, t in enumerate(ASKED)], "query_id bigint, text string, doc_type string")


@pytest.mark.parametrize("want", [None, "b"])
def test_bm25_is_the_full_scan(spark, index, want):
    got = {}
    for r in kw.bm25(queries(spark, want), index, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for i, text in enumerate(ASKED):
        scores = okapi(text)
        ids = [j for j in range(len(TEXTS)) if want is None or KINDS[j] == want]
        expect = [(j, scores[j]) for j in sorted(ids, key=lambda j: (-scores[j], j))[:10]]
        assert [j for j, _ in got[i]] == [j for j, _ in expect], text
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in expect], abs=1e-8)


def test_lazy_index_equals_the_stored_one(spark, chunks, index):
    a = kw.bm25(queries(spark), kw.build_index(chunks), 10).collect()
    b = kw.bm25(queries(spark), index, 10).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("bound", [{"max_terms": 0}, {"max_terms": 5}, {"max_queries": 2}])
def test_blocks_of_queries_give_the_same(spark, index, bound):
    a = kw.bm25(queries(spark), index, 10).collect()
    b = kw.bm25(queries(spark), index, 10, **bound).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_more_queries_than_a_block_equal_the_full_scan(spark, index):
    asked = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    many = spark.createDataFrame([(i, asked[i % 60]) for i in range(4300)], "query_id bigint, text string")
    got = {}
    for r in kw.bm25(many, index, 3, fill=False).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    for i, text in enumerate(asked):
        scores = okapi(text)
        best = sorted((j for j in range(len(TEXTS)) if scores[j] > 0), key=lambda j: (-scores[j], j))[:3]
        for q in range(i, 4300, 60):
            assert [c for _, c in sorted(got.get(q, []))] == best, text


def test_blocks_below_the_bar_are_passed_over(spark, tmp_path, monkeypatch):
    """Chunks of falling score in many small blocks, and near ties that differ in the ninth digit."""
    monkeypatch.setattr(kw, "BLOCK_CHUNKS", 4)
    texts = ["apple " * (1 + (200 - i) // 10) + "pear " * (i % 7) + "x" * (i % 3) for i in range(200)] + [f"filler{i}" for i in range(400)]
    chunks = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "chunk_id bigint, doc_type string, content string").coalesce(1)
    index = kw.build_index(chunks).save(str(tmp_path))
    assert index.blocks.count() == 150
    monkeypatch.setattr(f"{__name__}.TEXTS", texts)
    many = spark.createDataFrame([(i, "apple pear pear") for i in range(400)], "query_id bigint, text string")
    scores = okapi("apple pear pear")
    best = sorted(range(200), key=lambda j: (-scores[j], j))[:30]
    got = kw.bm25(many, index, 30, fill=False).where("query_id IN (0, 399)").orderBy("query_id", "rank").collect()
    assert [r["chunk_id"] for r in got] == best * 2


def test_search_reads_only_pages_of_its_terms(index, capsys):
    kw.wanted_postings(index, ["w1", "w3"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "Or(And(GreaterThanOrEqual(term,w1),LessThanOrEqual(term,w1))" in plan or "Or(EqualTo(term,w1),EqualTo(term,w3))" in plan
    terms = sorted(r["term"] for r in index.terms.collect())
    assert {r["term"] for r in kw.wanted_postings(index, terms).collect()} == set(terms)
    assert {r["term"] for r in kw.wanted_postings(index, terms[::3]).collect()} == set(terms[::3])


def test_index_is_removed(spark, chunks, tmp_path):
    index = kw.build_index(chunks).save(str(tmp_path / "gone"))
    assert sorted(p.name for p in (tmp_path / "gone").iterdir()) == ["blocks", "chunks", "postings", "stats", "terms"]
    index.remove()
    assert not (tmp_path / "gone").exists()


def test_string_ids_in_the_index(spark, tmp_path):
    chunks = spark.createDataFrame([("b", None, "one two"), ("a", "k", "one two"), ("c", "k", "two"), ("d", None, "three"), ("e", None, "four"), ("f", None, "")], "chunk_id string, doc_type string, content string")
    q = spark.createDataFrame([("q", "one", None), ("r", "one", "k")], "query_id string, text string, doc_type string")
    got = kw.bm25(q, kw.build_index(chunks).save(str(tmp_path)), 5, fill=False).collect()
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in got) == [("q", 1, "a"), ("q", 2, "b"), ("r", 1, "a")]


def test_statistics_count_empty_chunks(index):
    s = index.stats.first()
    assert s["n_docs"] == len(TEXTS) and s["avg_len"] == pytest.approx(sum(len(plain(t)) for t in TEXTS) / len(TEXTS))


def test_tokens(spark):
    df = spark.createDataFrame([("What does Order_Status mean? it's É_x-9",)], "t string")
    assert df.select(keyword_tokens("t")).first()[0] == ["order_status", "s", "_x", "9"]


# ---------------------------------------------------------------- vectors


@pytest.fixture(scope="module")
def vectors(spark):
    gen = np.random.default_rng(3)
    m = gen.normal(size=(300, 8)).astype("float32")
    m[100:200] = m[100]  # a third of all rows are copies
    m[250] = 0
    rows = [(i, KINDS[i % 60], [float(x) for x in v]) for i, v in enumerate(m)] + [(300, "a", None)]
    return m, spark.createDataFrame(rows, "chunk_id bigint, doc_type string, embedding array<float>").repartition(5)


def brute(m, q, ids, k):
    def dist(a, b):
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        return math.inf if na == 0 or nb == 0 else round(1 - float(a.astype(float) @ b.astype(float)) / float(np.linalg.norm(a.astype(float)) * np.linalg.norm(b.astype(float))), 9)

    return sorted((dist(m[i], q), i) for i in ids)[:k]


@pytest.mark.parametrize("kw_", [{}, {"max_queries": 7, "tile_rows": 40}])
def test_knn_is_exact(spark, vectors, kw_):
    m, corpus = vectors
    qs = [(i, None if i % 2 else "b", [float(x) for x in m[i * 9]]) for i in range(20)]
    hits = knn.knn(spark.createDataFrame(qs, "query_id bigint, doc_type string, embedding array<float>"), corpus, 15, **kw_)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["chunk_id"]))
    for i, want, v in qs:
        ids = [j for j in range(300) if want is None or KINDS[j % 60] == want]
        expect = brute(m, np.asarray(v, "float32"), ids, 15)
        assert [j for _, j in got[i]] == [j for _, j in expect]
        assert [d for d, _ in got[i]] == pytest.approx([d for d, _ in expect], abs=1e-8)


def test_knn_without_queries_or_corpus(spark, vectors):
    _, corpus = vectors
    none = spark.createDataFrame([], "query_id bigint, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0] * 8)], "query_id bigint, embedding array<float>")
    assert knn.knn(none, corpus, 3).count() == 0
    assert knn.knn(one, corpus.limit(0), 3).count() == 0


def test_string_ids_and_short_corpus(spark):
    corpus = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 0.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<double>")
    got = [tuple(r) for r in knn.knn(q, corpus, 5).orderBy("rank").collect()]
    assert got == [("q", "a", 0.0, 1), ("q", "b", 0.0, 2), ("q", "c", None, 3)]


def test_approximate_search(spark, vectors):
    m, corpus = vectors
    corpus = corpus.where("chunk_id <> 250")
    centres = knn.fit_cells(corpus, 6)
    cells = knn.assign_cells(corpus, centres)
    q = spark.createDataFrame([(i, [float(x) for x in m[i * 7]]) for i in range(30)], "query_id bigint, embedding array<float>")
    exact = knn.knn(q, corpus, 5)
    every = knn.ann(q, cells, centres, 5, n_probe=6)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    some = knn.ann(q, cells, centres, 5, n_probe=2)
    tiled = knn.ann(q, cells, centres, 5, n_probe=2, max_queries=4, tile_rows=16)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, tiled.collect()))
    assert knn.recall_at_k(some, exact).first()["recall"] > 0.5


def test_cell_index_reaches_its_recall(spark, tmp_path):
    gen = np.random.default_rng(4)
    m = np.repeat(gen.normal(size=(60, 12)), 20, 0) + 0.4 * gen.normal(size=(1200, 12))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    corpus = spark.createDataFrame(rows + [(5000, None)], "chunk_id bigint, embedding array<float>")
    q = spark.createDataFrame([(i, v) for i, v in rows if i % 20 == 0], "query_id bigint, embedding array<float>")
    index = knn.build_cells(corpus, str(tmp_path))
    assert len(index.centres) == 35 == knn.cell_count(1200) and index.cells.count() == 1200
    probes = knn.choose_probes(q, index, sample=40)
    assert 1 <= probes < 20
    exact = knn.knn(q, corpus, 10)
    some = knn.ann(q, index.cells, index.centres, 10, n_probe=probes)
    assert knn.recall_at_k(some, exact).first()["recall"] >= 0.9
    every = knn.ann(q, index.cells, index.centres, 10, n_probe=35)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    plan = index.cells.where("cell IN (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    assert knn.build_cells(corpus.limit(0), str(tmp_path / "none")).cells.count() == 0


def test_bounded_search_is_exact_and_leaves_cells_unread(spark, tmp_path):
    gen = np.random.default_rng(9)
    m = np.repeat(gen.normal(size=(40, 16)), 25, 0) + 0.08 * gen.normal(size=(1000, 16))
    m[30:40] = m[30]  # ties
    m[990:] = 0  # no direction
    corpus = spark.createDataFrame(
        [(i, [float(x) for x in v], "ab"[i % 2]) for i, v in enumerate(m)] + [(5000, None, "a")], "chunk_id bigint, embedding array<double>, doc_type string"
    )
    asked = [(i, [float(x) for x in m[i]], (None, "a", "none")[i % 3] if i else "b") for i in range(0, 1000, 33)] + [(5001, None, None)]
    q = spark.createDataFrame(asked, "query_id bigint, embedding array<double>, doc_type string")
    index = knn.build_cells(corpus, str(tmp_path))
    want = sorted(map(tuple, knn.knn(q, corpus, 6).collect()), key=repr)
    assert len(want) > 100
    assert sorted(map(tuple, knn.knn_in_cells(q, index, 6).collect()), key=repr) == want
    assert sorted(map(tuple, knn.knn_in_cells(q, index, 6, max_queries=3, tile_rows=16).collect()), key=repr) == want
    read = knn.cells_to_read(q, index, knn.cell_radii(index), 6).selectExpr("query_id", "scope", "size(cells) AS n").collect()
    read = {r["query_id"]: (r["scope"], r["n"]) for r in read}
    assert all(n == len(index.centres) for scope, n in read.values() if scope == "none")  # no bound: everything is read
    pruned = [n for i, (scope, n) in read.items() if scope != "none" and 40 < i < 990]
    assert np.mean(pruned) < len(index.centres) / 4
    zeros = knn.build_cells(corpus.where("chunk_id BETWEEN 990 AND 999"), str(tmp_path / "zeros"))
    got = knn.knn_in_cells(q.limit(2), zeros, 3).collect()
    assert {(r["chunk_id"], r["distance"]) for r in got if r["query_id"] == 0} == {(991, None), (993, None), (995, None)}
    nothing = knn.build_cells(corpus.limit(0), str(tmp_path / "none"))
    assert knn.knn_in_cells(q, nothing, 6).count() == 0 == knn.knn_in_cells(q.limit(0), index, 6).count()


def test_encoder_and_dims(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "B a!"), (3, ""), (4, None)], "id int, t string")
    out = encode.embed(df, "t", lambda: encode.HashEncoder(16)).orderBy("id")
    rows = [r["embedding"] for r in out.collect()]
    assert np.linalg.norm(rows[0]) == pytest.approx(1, abs=1e-6) and rows[0] != rows[1] and set(rows[2]) == {0.0} == set(rows[3])
    assert tuple(encode.check_dims(out, "embedding", 16).first()) == (4, 0, 2, True)
    assert encode.check_dims(out, "embedding", 8).first()["ok"] is False


def test_hashed_vectors(spark):
    import hashlib

    texts = ["a b b", "B a! b", "", None, "the_x é 9 9 9 9", "z " * 50_000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, t string, embedding int")
    out = encode.hash_embed(df, "t", dims=16)
    got = {r["id"]: r["embedding"] for r in out.collect()}
    assert out.columns == ["id", "t", "embedding"] and got[0] == got[1] and set(got[2]) == {0.0} == set(got[3])
    for i, text in enumerate(texts):
        want = np.zeros(16)
        for w, n in Counter(re.findall("[a-z0-9_]+", (text or "").lower())).items():
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:4], 16) % 16] += (1 if h[4] >= "8" else -1) * (1 + math.log(n))
        size = np.linalg.norm(want)
        assert got[i] == pytest.approx((want / size if size else want).tolist(), abs=1e-5)


# ---------------------------------------------------------------- fusion


def test_published_fusion_scores(spark):
    """Ranks of a published run and the scores they gave."""
    ranks = [("x", 4, 1, 0.032018), ("y", 2, 4, 0.031754), ("z", 3, 5, 0.031258), ("u", 5, 26, 0.027013), ("v", 35, 3, 0.026399)]
    vec = spark.createDataFrame([(1, c, 0.5, v) for c, v, _, _ in ranks], "query_id int, chunk_id string, distance double, rank int")
    key = spark.createDataFrame([(1, c, 1.0, b) for c, _, b, _ in ranks], "query_id int, chunk_id string, score double, rank int")
    out = fusion.rrf(vec, key).orderBy("rrf_rank").collect()
    assert [(r["chunk_id"], round(r["rrf_score"], 6)) for r in out] == [(c, s) for c, _, _, s in ranks]


def test_fusion_keeps_both_lists(spark):
    vec = spark.createDataFrame([(1, "a", 0.1, 1), (1, "b", 0.2, 2)], "query_id int, chunk_id string, distance double, rank int")
    key = spark.createDataFrame([(1, "c", 3.0, 1), (1, "b", 2.0, 2), (2, "c", 1.0, 1)], "query_id int, chunk_id string, score double, rank int")
    out = {(r["query_id"], r["chunk_id"]): r for r in fusion.rrf(vec, key).collect()}
    assert out[1, "b"]["rrf_score"] == 2 / 62 and out[1, "b"]["vector_distance"] == 0.2 and out[1, "b"]["bm25_score"] == 2.0
    # a and c tie: the vector list goes first.
    assert [out[1, c]["rrf_rank"] for c in "bac"] == [1, 2, 3] and out[2, "c"]["rrf_score"] == 1 / 61


def test_rerank_ties_keep_the_fused_order(spark):
    rows = [(1, "a", "x y", "z", 1), (1, "b", "x y", "y", 2), (1, "c", "x y", "x", 3), (2, "d", "the", "the", 1)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, text string, content string, rrf_rank int")
    out = fusion.rerank(df, k=2).orderBy("query_id", "final_rank").collect()
    assert [(r["chunk_id"], r["reranker_score"]) for r in out] == [("b", 0.5), ("c", 0.5), ("d", 0.0)]


def test_end_to_end_with_a_plugged_scorer(spark, chunks, index):
    corpus = encode.embed(chunks, "content", lambda: encode.HashEncoder(32))
    q = encode.embed(queries(spark).limit(3), "text", lambda: encode.HashEncoder(32))
    out = retrieve(q, corpus, 4, index)
    assert out.groupBy("query_id").count().where("count <> 4").count() == 0
    by_length = retrieve(q, corpus, 4, index, scorer=lambda text, content: F.length(content).cast("double"))
    best = by_length.where("final_rank = 1").select("content").collect()
    assert all(len(r[0]) > 40 for r in best)
    steps = trace(q, corpus, 4, index)
    top = {tuple(r) for r in steps.where("in_rerank_top").select("query_id", "chunk_id", "final_rank").collect()}
    assert top == {tuple(r) for r in out.select("query_id", "chunk_id", "final_rank").collect()}
    assert steps.where("final_rank is null").count() > 0


def test_model_scorer_as_a_pandas_udf(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def score(text: pd.Series, content: pd.Series) -> pd.Series:
        return content.str.len().astype(float) - text.str.len()

    rows = [(1, "a", "xx", "z", 1), (1, "b", "xx", "yyyy", 2), (1, "c", "xx", "zz", 3)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, text string, content string, rrf_rank int")
    out = fusion.rerank(df, score, k=2).orderBy("final_rank").collect()
    assert [(r["chunk_id"], r["reranker_score"]) for r in out] == [("b", 2.0), ("c", 0.0)]


def test_pairs_are_the_same_beyond_the_broadcast_bound(spark, chunks, monkeypatch):
    from tallyglass.plans import retrieval

    q = queries(spark)
    cands = q.select("query_id").crossJoin(chunks.select("chunk_id").limit(5)).withColumn("rrf_rank", F.lit(1))
    a = retrieval.with_pair(cands, q, chunks)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    b = retrieval.with_pair(cands, q, chunks)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_projection(spark, vectors):
    from tallyglass.operators.projection import project_2d

    m, corpus = vectors
    corpus = corpus.where("embedding is not null")
    q = spark.createDataFrame([(1, [float(x) for x in m[7]])], "query_id int, embedding array<float>")
    out = project_2d(corpus, q).collect()
    x = m.astype(float) - m.astype(float).mean(axis=0)
    var = np.linalg.svd(x, compute_uv=False) ** 2
    assert out[0]["variance_x"] == pytest.approx(var[0] / var.sum(), abs=1e-4)
    pts = {(r["kind"], r["id"]): (r["x"], r["y"]) for r in out}
    assert pts["query", "1"] == pts["chunk", "7"] and len(pts) == 301
    assert abs(sum(v[0] for k, v in pts.items() if k[0] == "chunk")) < 0.1


def test_bm25_scores_have_every_chunk_that_shares_a_term(spark):
    """Also beyond a top list, with a weight of zero, and within a document type."""
    chunks = spark.createDataFrame([(i, "a" if i % 2 else "b", f"common w{i % 5}" if i < 90 else "other") for i in range(120)], "chunk_id long, doc_type string, content string")
    queries = spark.createDataFrame([(1, "common", None), (2, "w3 nobody", "a"), (3, "absent", None)], "query_id long, text string, doc_type string")
    index = kw.build_index(chunks)
    got = {(r.query_id, r.chunk_id): r.score for r in kw.bm25_scores(queries, index, max_queries=1).collect()}
    assert set(got) == {(1, i) for i in range(90)} | {(2, i) for i in range(90) if i % 5 == 3 and i % 2}
    top = {(r.query_id, r.chunk_id): r.score for r in kw.bm25(queries, index, 5, fill=False).collect()}
    assert top and all(abs(got[key] - score) < 1e-9 for key, score in top.items())


def test_vectors_of_more_texts_than_are_added_up_at_once(spark):
    texts = [f"w{i % 7} w{i % 11} w{i % 7}" for i in range(2 * encode.SUM_ROWS + 77)]
    own = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: r.embedding for r in encode.hash_embed(own, "text").collect()}
    assert len(got) == len(texts) and all(got[i] == got[i % 77] for i in got)


def test_queries_with_the_same_terms_are_answered_once(spark):
    chunks = spark.createDataFrame([(i, "a" if i % 2 else "b", f"common w{i % 5}" if i else None) for i in range(60)], "chunk_id long, doc_type string, content string")
    rows = [(i, f"zzz_{i} w3", "a" if i % 3 else None) for i in range(30)] + [(30, None, "b"), (31, "w3 w3", "a"), (32, "", "nowhere")]
    queries = spark.createDataFrame(rows, "query_id long, text string, doc_type string")
    index = kw.build_index(chunks).save(shared_dir(spark))
    asked = kw._asked(queries, index)
    assert (asked.n_queries, asked.n_classes) == (33, 5)
    got = {}
    for r in kw.bm25(queries, index, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.rank, r.score > 0))
    assert [x[0] for x in got[1]] == [3, 13, 23, 33] and got[1] == got[29] and all(x[2] for x in got[1])
    assert [x[0] for x in got[0]] == [3, 8, 13, 18] and got[0] == got[27]
    assert got[30] == [(0, 1, False), (2, 2, False), (4, 3, False), (6, 4, False)]
    assert len(got) == 32 and 32 not in got
    every = kw.bm25_scores(queries, index).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in every} == {i: 6 if i % 3 else 12 for i in range(30)} | {31: 6}


def test_tokens_of_a_batch_are_those_of_its_texts():
    texts = ["a_1 b--b", None, "", "b", "the\u00e9x\U0001f600y the", "é", "end", "x" * 9 + " of of", "-"] * 3
    for first in (0, 1, 4):
        own = pa.array(texts).slice(first)
        got = [Counter() for _ in own]
        size = []
        for i, j in tokens.slices(own, np.arange(0, len(own), 2), rows=5, most=12):
            names, row, code, count, n = tokens.counted_tokens(own.slice(i, j - i), ("of",))
            size += n.tolist()
            for r, c, m in zip(row, code, count):
                got[i + r][names[int(c)].as_py()] += int(m)
        want = [Counter(w for w in re.findall("[a-z0-9_]+", x or "") if w != "of") for x in texts[first:]]
        assert got == want and size == [x.total() for x in want]


def test_the_index_works_on_a_bounded_part_of_a_batch_of_long_texts():
    text = " ".join(f"t{i}" for i in range(4000))
    rows = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["a"] * 600), pa.array([text] * 600), pa.array(range(600))], ["a", "b", "c", "d"])
    entries = [sum(map(len, b.column("places").to_pylist())) for b in kw._runs(iter([rows])) if b.column("term").null_count == 0]
    assert sum(entries) == 600 * 4000 and max(entries) * len(text) / 4000 <= tokens.SLICE_BYTES
