"""Chunking, storage of chunks, and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions.text import keyword_tokens, preview, raw_tokens
from tallyglass.functions.vectors import cosine_distance, text_to_vec, vec_to_text
from tallyglass.operators import bm25 as kw
from tallyglass.operators import chunking, encode, fusion, gates, knn, projection
from tallyglass.plans import retrieval
from tallyglass.session import shared_dir
from tallyglass.sources import chunks as store
from tallyglass.sources import corpus as reader
from tallyglass.sources import results
from tallyglass.workload.registry import query


def _six(col):
    """Six digits of a value that was rounded to nine: the shift keeps it off a tie of the second rounding."""
    return F.round((F.col(col) if isinstance(col, str) else col) + 1e-10, 6)


# ---------------------------------------------------------------- chunking

_SECTIONS = r"""cut AS (SELECT source, doc_type, content, split(chr(10) || content, chr(10) || '## ') AS p FROM markdown),
   pieces AS (SELECT source, doc_type, content, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n FROM cut),
   laid AS (SELECT source, doc_type, content, i,
      CASE WHEN i > 1 THEN '## ' || piece ELSE substr(piece, 2) END || CASE WHEN i < n AND (i > 1 OR piece <> '') THEN chr(10) ELSE '' END AS section_text
      FROM pieces),
   placed AS (SELECT *, coalesce(sum(length(section_text)) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS section_start FROM laid),
   sections AS (SELECT source, doc_type, content, (row_number() OVER (PARTITION BY source ORDER BY i) - 1)::INT AS section_no,
      CASE WHEN i > 1 THEN trim(regexp_extract(section_text, '^## ([^\n]+)', 1)) ELSE '' END AS section, section_text, section_start
      FROM placed WHERE i > 1 OR regexp_matches(regexp_replace(section_text, '(?m)^#[^#][^\n]*\n?', '', 'g'), '\S'))"""
_WINDOWS = r"""toks AS (SELECT *, regexp_extract_all(section_text, '[^ \t\n\r\f]+[ \t\n\r\f]*') AS tk, length(regexp_extract(section_text, '^[ \t\n\r\f]*')) AS lead FROM sections),
   wins AS (SELECT *, unnest(range(0, CASE WHEN len(tk) = 0 THEN 0 WHEN len(tk) <= 256 THEN 1 ELSE CAST(ceil((len(tk) - 256) / 224.0) AS BIGINT) + 1 END)) AS w FROM toks),
   spans AS (SELECT source, doc_type, trim(regexp_extract(content, '(?m)^#\s+([^\n]+)$', 1)) AS doc_title, section, section_no, section_start, w,
      lead + length(array_to_string(tk[1:w * 224], '')) AS text_start, least(256, len(tk) - w * 224)::INT AS token_count,
      regexp_replace(array_to_string(tk[w * 224 + 1:w * 224 + 256], ''), '[ \t\n\r\f]+$', '') AS content FROM wins),
   chunks AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY section_no, w) - 1)::INT AS chunk_index,
      (section_start + text_start)::INT AS char_start, (section_start + text_start + length(content))::INT AS char_end FROM spans)"""
_CHUNKS = f"{_SECTIONS}, {_WINDOWS}"


def _chunks(t):
    return chunking.chunk_documents(t.role("markdown"))


@query("c1_doc_title", r"SELECT source, trim(regexp_extract(content, '(?m)^#\s+([^\n]+)$', 1)) AS title FROM markdown", "markdown")
def _(t):
    return t.role("markdown").select("source", chunking.doc_title("content").alias("title"))


@query(
    "c2_split_sections",
    f"WITH {_SECTIONS} SELECT source, section_no, section, section_start, length(section_text)::INT AS n_chars, md5(section_text) AS digest FROM sections",
    "markdown",
)
def _(t):
    return chunking.split_sections(t.role("markdown")).select(
        "source", "section_no", "section", "section_start", F.length("section_text").alias("n_chars"), F.md5("section_text").alias("digest")
    )


@query(
    "c3_token_offsets",
    r"""WITH tk AS (SELECT chunk_id, length(regexp_extract(content, '^[ \t\n\r\f]*')) AS lead,
          regexp_extract_all(content, '[^ \t\n\r\f]+[ \t\n\r\f]*') AS p FROM passages),
        each AS (SELECT chunk_id, lead, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM tk),
        pos AS (SELECT chunk_id, i, piece, lead + coalesce(sum(length(piece)) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
          length(regexp_extract(piece, '^[^ \t\n\r\f]+')) AS n FROM each)
        SELECT chunk_id, count(*) AS n_tokens, sum(s)::BIGINT AS sum_start, sum(s + n)::BIGINT AS sum_end, max(n)::INT AS longest FROM pos GROUP BY 1""",
    "passages",
)
def _(t):
    tokens = chunking.token_positions(t.role("passages").select("chunk_id", "content"), "content")
    return tokens.groupBy("chunk_id").agg(
        F.count("*").alias("n_tokens"),
        F.sum("char_start").alias("sum_start"),
        F.sum("char_end").alias("sum_end"),
        F.max(F.length("token")).alias("longest"),
    )


@query(
    "c4_windows",
    r"""WITH tk AS (SELECT chunk_id, regexp_extract_all(content, '[^ \t\n\r\f]+[ \t\n\r\f]*') AS p FROM passages),
        w AS (SELECT chunk_id, p, unnest(range(0, CASE WHEN len(p) = 0 THEN 0 WHEN len(p) <= 100 THEN 1 ELSE CAST(ceil((len(p) - 100) / 40.0) AS BIGINT) + 1 END)) AS i FROM tk)
        SELECT chunk_id, i::INT AS window_no, least(100, len(p) - i * 40)::INT AS token_count,
        md5(regexp_replace(array_to_string(p[i * 40 + 1:i * 40 + 100], ''), '[ \t\n\r\f]+$', '')) AS digest FROM w""",
    "passages",
)
def _(t):
    # An overlap above half a window, so a window spans more than two strides.
    windows = chunking.window_chunks(t.role("passages").select("chunk_id", "content"), "content", 100, 60)
    return windows.select("chunk_id", "window_no", "token_count", F.md5("content").alias("digest"))


@query(
    "c5_chunk_index",
    f"WITH {_CHUNKS} SELECT source, chunk_index, section FROM chunks",
    "markdown",
)
def _(t):
    return _chunks(t).select("source", "chunk_index", "section")


@query(
    "c6_chunk_documents",
    f"""WITH {_CHUNKS} SELECT md5(source || '|' || chunk_index) AS chunk_id, source, doc_type, doc_title, section, chunk_index,
        char_start, char_end, token_count, md5(content) AS digest FROM chunks""",
    "markdown",
)
def _(t):
    return _chunks(t).withColumn("digest", F.md5("content")).drop("content")


_STATS = """count(*) AS n_chunks, min(token_count) AS min_tokens, max(token_count) AS max_tokens,
  round(avg(token_count), 6) AS mean_tokens, median(token_count) AS median_tokens"""


@query(
    "c7_chunk_stats",
    f"WITH {_CHUNKS} SELECT doc_type, {_STATS} FROM chunks GROUP BY 1 UNION ALL SELECT 'all', {_STATS} FROM chunks",
    "markdown",
)
def _(t):
    chunks = _chunks(t).select("doc_type", "token_count")
    both = chunking.chunk_stats(chunks, "doc_type").unionByName(
        chunking.chunk_stats(chunks).withColumn("doc_type", F.lit("all"))
    )
    return both.withColumn("mean_tokens", F.round("mean_tokens", 6))


@query(
    "c7_oversized",
    f"WITH {_CHUNKS} SELECT source, chunk_index, token_count FROM chunks WHERE token_count > 200",
    "markdown",
)
def _(t):
    return chunking.oversized(_chunks(t), 200).select("source", "chunk_index", "token_count")


@query(
    "c7_sample_chunks",
    f"""WITH {_CHUNKS}, named AS (SELECT *, md5(concat(source, '|', chunk_index)) AS id FROM chunks)
        SELECT id AS chunk_id, source, section, chunk_index, token_count FROM named ORDER BY md5('11:' || id), id LIMIT 3""",
    "markdown",
)
def _(t):
    return chunking.sample_chunks(_chunks(t), 3, seed=11).select("chunk_id", "source", "section", "chunk_index", "token_count")


@query(
    "c8_corpus_stats",
    f"WITH {_CHUNKS} SELECT doc_type, count(DISTINCT source) AS n_docs, count(*) AS n_chunks FROM chunks GROUP BY 1",
    "markdown",
)
def _(t):
    return chunking.corpus_stats(_chunks(t).select("doc_type", "source"))


@query(
    "c8_corpus_files",
    f"WITH {_CHUNKS} SELECT doc_type, source, count(*) AS n_chunks FROM chunks GROUP BY 1, 2",
    "markdown",
)
def _(t):
    return chunking.corpus_files(_chunks(t).select("doc_type", "source"))


@query(
    "c9_section_index",
    f"WITH {_SECTIONS} SELECT source, doc_type, section_no, section, section_start FROM sections WHERE section <> ''",
    "markdown",
)
def _(t):
    return chunking.section_index(t.role("markdown"))


@query(
    "c10_preview",
    r"""WITH f AS (SELECT chunk_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS flat FROM passages)
        SELECT chunk_id, substr(flat, 1, 180) || CASE WHEN length(flat) > 180 THEN '...' ELSE '' END AS preview FROM f""",
    "passages",
)
def _(t):
    return t.role("passages").select("chunk_id", preview("content").alias("preview"))


@query(
    "c11_chunk_overlap",
    f"""WITH {_CHUNKS}, near AS (SELECT *, char_end - char_start AS n,
          lag(char_end) OVER x AS pe, lag(section) OVER x AS ps, lead(char_start) OVER x AS ns, lead(section) OVER x AS nsec
          FROM chunks WINDOW x AS (PARTITION BY source ORDER BY chunk_index)),
        pre AS (SELECT *, CASE WHEN ps = section THEN least(n, greatest(pe - char_start, 0)) ELSE 0 END AS shared_prefix FROM near)
        SELECT source, chunk_index, shared_prefix, least(CASE WHEN nsec = section THEN least(n, greatest(char_end - ns, 0)) ELSE 0 END, n - shared_prefix) AS shared_suffix FROM pre""",
    "markdown",
)
def _(t):
    return chunking.chunk_overlap(_chunks(t)).select("source", "chunk_index", "shared_prefix", "shared_suffix")


# ---------------------------------------------------------------- storage


@query(
    "s4_read_corpus",
    "SELECT lang AS doc_type, sum(length(text) + 1)::BIGINT AS n_chars FROM documents GROUP BY 1",
)
def _(t):
    root = shared_dir(t.spark)
    docs = t.read("documents").select("lang", "text")
    # Text files keep the partition folders and lose their suffix; the reader maps folder to type.
    docs.write.partitionBy("lang").option("maxRecordsPerFile", 500).text(root)
    kinds = [r.lang for r in docs.select("lang").distinct().collect()]  # as many as there are folders
    types = {f"lang={'__HIVE_DEFAULT_PARTITION__' if x is None else x}": x for x in kinds}
    files = reader.read_corpus(t.spark, root, types, "*.txt")
    return files.groupBy("doc_type").agg(F.sum(F.length("content")).alias("n_chars"))


@query(
    "s5_chunk_json",
    f"WITH {_CHUNKS} SELECT md5(source || '|' || chunk_index) AS chunk_id, doc_title, char_start, char_end, md5(content) AS digest FROM chunks",
    "markdown",
)
def _(t):
    path = shared_dir(t.spark)
    store.write_chunks_json(_chunks(t), path)
    back = store.read_chunks_json(t.spark, path)
    return back.select("chunk_id", "doc_title", "char_start", "char_end", F.md5("content").alias("digest"))


@query(
    "s6_save_chunks",
    f"WITH {_CHUNKS} SELECT doc_type, count(*) AS n_chunks, sum(token_count)::BIGINT AS n_tokens FROM chunks GROUP BY 1",
    "markdown",
)
def _(t):
    path = shared_dir(t.spark)
    store.save_chunks(_chunks(t), path)
    return store.scan_chunks(t.spark, path, ordered=False).groupBy("doc_type").agg(
        F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens")
    )


@query(
    "s7_scan_chunks",
    f"WITH {_CHUNKS} SELECT source, chunk_index, token_count, doc_type FROM chunks ORDER BY source, chunk_index",
    "markdown",
)
def _(t):
    path = shared_dir(t.spark)
    store.save_chunks(_chunks(t), path)
    return store.scan_chunks(t.spark, path).select("source", "chunk_index", "token_count", "doc_type")


# ---------------------------------------------------------------- vectors

# Every passage and every question has a vector: the hashed counts of its tokens.
def _embedded(role, key, text, columns, name):
    return f"""{name}_n AS (SELECT {key} AS id, token, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]+')) AS token FROM {role}) GROUP BY ALL),
   {name}_s AS (SELECT id, CAST('0x' || substr(md5(token), 1, 4) AS INT) % 64 AS slot, CAST(sum(CASE WHEN substr(md5(token), 5, 1) >= '8' THEN 1 ELSE -1 END * CAST(round((1 + ln(n)) * 1048576) AS BIGINT)) AS DOUBLE) AS v FROM {name}_n GROUP BY ALL),
   {name}_d AS (SELECT {key} AS id, list(coalesce(v, 0) ORDER BY r.slot) AS raw FROM {role} CROSS JOIN range(64) AS r(slot) LEFT JOIN {name}_s s ON s.id = {key} AND s.slot = r.slot GROUP BY 1),
   {name}_l AS (SELECT id, raw, sqrt(list_dot_product(raw, raw)) AS size FROM {name}_d),
   {name}_u AS MATERIALIZED (SELECT id, list_transform(raw, lambda x: CAST(CASE WHEN size > 0 THEN x / size ELSE 0 END AS FLOAT))::DOUBLE[] AS e, size > 0 AS sound FROM {name}_l),
   {name} AS (SELECT {columns}, e AS {name[0]}e, sound FROM {role} JOIN {name}_u ON id = {key})"""


_VECTORS = _embedded("asked", "query_id", "text", "query_id, text", "qv") + ", " + _embedded("passages", "chunk_id", "content", "chunk_id, doc_type, source, content", "cv")


def _queries(t):
    return encode.hash_embed(t.role("asked"), "text")


def _corpus(t):
    return encode.hash_embed(t.role("passages"), "content")


def _label_queries(t):
    """One query per label: the mean of its vectors."""
    cells = t.read("embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(vec.alias("embedding"))


def _vector_corpus(t):
    return t.read("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


_MEANS = """dims AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
   lq AS (SELECT label::BIGINT AS query_id, list(x ORDER BY pos) AS qe FROM (SELECT label, pos, avg(x) AS x FROM dims GROUP BY 1, 2) GROUP BY 1),
   lhits AS (SELECT query_id, vec_id AS chunk_id, label, round(1 - list_cosine_similarity(qe, embedding::DOUBLE[]), 9) AS d FROM lq, embeddings),
   lrank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM lhits)"""


@query(
    "v1_embed_corpus",
    f"""WITH {_VECTORS} SELECT chunk_id, len(ce)::INT AS dims, round(list_sum(ce), 4) + 0.0 AS total, round(ce[1], 4) + 0.0 AS first FROM cv""",
    "asked passages",
)
def _(t):
    out = _corpus(t)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select(
        "chunk_id", F.size("embedding").alias("dims"), (F.round(total, 4) + 0.0).alias("total"),
        (F.round(F.get("embedding", F.lit(0)).cast("double"), 4) + 0.0).alias("first"),
    )


@query(
    "v2_embed_queries",
    f"""WITH {_VECTORS}, d AS (SELECT query_id, chunk_id, round(1 - list_cosine_similarity(qe, ce), 9) AS d FROM qv, cv WHERE qv.sound AND cv.sound)
        SELECT query_id, chunk_id, rank::INT AS rank, round(d + 1e-10, 6) AS distance
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM d) WHERE rank <= 3""",
    "asked passages",
)
def _(t):
    return knn.knn(_queries(t), _corpus(t), 3).withColumn("distance", _six("distance"))


@query(
    "v3_check_dims",
    """SELECT count(*) AS n_vectors, count(*) FILTER (WHERE len(embedding) <> 64) AS n_bad_dims,
       count(*) FILTER (WHERE list_dot_product(embedding, embedding) = 0) AS n_zero, count(*) FILTER (WHERE len(embedding) <> 64) = 0 AS ok FROM embeddings""",
)
def _(t):
    return encode.check_dims(t.read("embeddings"), "embedding", 64)


@query(
    "v4_vector_codec",
    "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, len(embedding)::INT AS dims FROM embeddings",
)
def _(t):
    back = t.read("embeddings").select("vec_id", text_to_vec(vec_to_text("embedding")).alias("v"))
    return back.select(
        "vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("v").alias("dims")
    )


@query(
    "v5_cosine_distance",
    """SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(t):
    a = t.read("embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine_distance("embedding", "next"), 6).alias("distance"))


@query(
    "v6_filtered_search",
    f"""WITH {_VECTORS}, f AS (SELECT query_id, qe, CASE query_id % 3 WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END AS want FROM qv),
        d AS (SELECT query_id, chunk_id, round(1 - list_cosine_similarity(qe, ce), 9) AS d FROM f, cv WHERE cv.sound AND (want IS NULL OR want = doc_type)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM d)
        SELECT query_id, chunk_id, rank::INT AS rank, round(d + 1e-10, 6) AS distance FROM r WHERE rank <= 10""",
    "asked passages",
)
def _(t):
    want = F.when(F.col("query_id") % 3 == 1, "en").when(F.col("query_id") % 3 == 2, "fr")
    hits = knn.knn(_queries(t).withColumn("doc_type", want), _corpus(t), 10)
    return hits.withColumn("distance", _six("distance"))


@query(
    "v7_nearest_neighbours",
    f"""WITH {_VECTORS}, d AS (SELECT query_id, chunk_id, round(1 - list_cosine_similarity(qe, ce), 9) AS d FROM qv, cv WHERE qv.sound AND cv.sound),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM d)
        SELECT query_id, chunk_id, rank::INT AS rank, round(d + 1e-10, 6) AS distance FROM r WHERE rank <= 50""",
    "asked passages",
)
def _(t):
    return knn.knn(_queries(t), _corpus(t), 50).withColumn("distance", _six("distance"))


@query(
    "v7_neighbours_of_label_means",
    f"WITH {_MEANS} SELECT query_id, chunk_id, rank::INT AS rank, round(d + 1e-10, 6) AS distance FROM lrank WHERE rank <= 20",
)
def _(t):
    return knn.knn(_label_queries(t), _vector_corpus(t), 20).withColumn("distance", _six("distance"))


def _every_twentieth(t):
    """The stated query set: every row whose id is divisible by 20, against all rows."""
    own = t.read("embeddings").where("vec_id % 20 = 0")
    return own.select(F.col("vec_id").alias("query_id"), "embedding")


_TWENTIETH = """tq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 20 = 0),
   thits AS (SELECT query_id, vec_id AS chunk_id, round(1 - list_cosine_similarity(qe, embedding::DOUBLE[]), 9) AS d FROM tq, embeddings),
   trank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM thits)"""


def _cells(t):
    return knn.build_cells(_vector_corpus(t), shared_dir(t.spark))


@query("v8_approximate_neighbours")
def _(t):
    queries, index = _every_twentieth(t), _cells(t)
    return knn.ann(queries, index.cells, index.centres, k=10, n_probe=knn.choose_probes(queries, index))


@query(
    "v8_recall",
    f"WITH {_TWENTIETH} SELECT count(*) AS n_exact, true AS enough FROM trank WHERE rank <= 10",
)
def _(t):
    queries, index = _every_twentieth(t), _cells(t)
    approx = knn.ann(queries, index.cells, index.centres, k=10, n_probe=knn.choose_probes(queries, index))
    found = knn.recall_at_k(approx, knn.knn(queries, index.cells, 10))
    return found.select("n_exact", (F.col("recall") >= 0.9).alias("enough"))


@query(
    "v8_all_cells",
    f"WITH {_TWENTIETH} SELECT query_id, chunk_id, rank::INT AS rank, round(d + 1e-10, 6) AS distance FROM trank WHERE rank <= 10",
)
def _(t):
    index = _cells(t)
    hits = knn.ann(_every_twentieth(t), index.cells, index.centres, k=10, n_probe=len(index.centres))
    return hits.withColumn("distance", _six("distance"))


@query(
    "v7_bounded_search",
    f"WITH {_TWENTIETH} SELECT query_id, chunk_id, rank::INT AS rank, round(d + 1e-10, 6) AS distance FROM trank WHERE rank <= 10",
)
def _(t):
    return knn.knn_in_cells(_every_twentieth(t), _cells(t), 10).withColumn("distance", _six("distance"))


@query(
    "v17_expected_source",
    f"""WITH {_MEANS}, b AS (SELECT query_id, min(rank) AS fr FROM lrank WHERE rank <= 3 AND label = query_id GROUP BY 1)
        SELECT query_id, coalesce(fr, 0)::INT AS first_rank, fr IS NOT NULL AS found FROM lq LEFT JOIN b USING (query_id)""",
)
def _(t):
    queries, corpus = _label_queries(t), _vector_corpus(t)
    hits = knn.knn(queries, corpus, 3).join(corpus.select("chunk_id", F.col("label").cast("string").alias("source")), "chunk_id")
    expected = queries.select("query_id", F.col("query_id").cast("string").alias("expected_source"))
    out = knn.expect_source(hits, expected, 3)
    return out.select("query_id", F.coalesce("first_rank", F.lit(0)).alias("first_rank"), "found")


@query("v19_projection")
def _(t):
    return projection.project_2d(_vector_corpus(t), _label_queries(t))


# ---------------------------------------------------------------- keywords

# Fixed values, typed out so that the twins do not share them with the package.
_STOP = (
    "'a', 'an', 'and', 'are', 'as', 'at', 'be', 'between', 'by', 'did', 'do', "
    "'does', 'for', 'from', 'how', 'in', 'is', 'it', 'its', 'mean', 'means', "
    "'of', 'on', 'or', 'that', 'the', 'this', 'to', 'what', 'with'"
)


def _toks(col):
    return f"list_filter(regexp_extract_all(lower({col}), '[a-z0-9_]+'), lambda w: w NOT IN ({_STOP}))"


@query(
    "v9_keyword_tokens",
    "SELECT chunk_id, len(regexp_extract_all(lower(content), '[a-z0-9_]+'))::INT AS n, md5(array_to_string(regexp_extract_all(lower(content), '[a-z0-9_]+'), ' ')) AS digest FROM passages",
    "passages",
)
def _(t):
    toks = raw_tokens("content")
    return t.role("passages").select("chunk_id", F.size(toks).alias("n"), F.md5(F.array_join(toks, " ")).alias("digest"))


@query(
    "v10_without_stopwords",
    f"SELECT chunk_id, len({_toks('content')})::INT AS n, md5(array_to_string({_toks('content')}, ' ')) AS digest FROM passages",
    "passages",
)
def _(t):
    toks = keyword_tokens("content")
    return t.role("passages").select("chunk_id", F.size(toks).alias("n"), F.md5(F.array_join(toks, " ")).alias("digest"))


_INDEX = f"""tok AS (SELECT chunk_id, doc_type, {_toks('content')} AS tk FROM passages),
   post AS (SELECT chunk_id, doc_type, dl, term, count(*) AS tf FROM (SELECT chunk_id, doc_type, len(tk) AS dl, unnest(tk) AS term FROM tok) GROUP BY ALL),
   stat AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM tok),
   idf0 AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, stat GROUP BY term),
   idf AS (SELECT term, df, CASE WHEN idf < 0 THEN greatest(0.25 * (SELECT avg(idf) FROM idf0), 0) ELSE idf END AS w FROM idf0)"""
_SCORES = f"""{_INDEX}, qt AS (SELECT query_id, unnest({_toks('text')}) AS term FROM asked),
   sc AS (SELECT query_id, chunk_id, any_value(doc_type) AS doc_type, round(sum(w * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
     FROM qt JOIN idf USING (term) JOIN post USING (term), stat GROUP BY 1, 2)"""


def _ranked_scores(k, want="NULL"):
    return f"""{_SCORES}, wanted AS (SELECT query_id, {want} AS want FROM asked),
     ls AS (SELECT a.query_id, p.chunk_id, coalesce(sc.score, 0) AS score FROM wanted a JOIN passages p ON a.want IS NULL OR a.want = p.doc_type
            LEFT JOIN sc ON sc.query_id = a.query_id AND sc.chunk_id = p.chunk_id),
     kr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ls) WHERE rank <= {k})"""


def _index(t):
    return kw.build_index(t.role("passages")).save(shared_dir(t.spark))


@query(
    "v11_inverted_index",
    f"WITH {_INDEX} SELECT term, df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf, round(any_value(w), 6) AS idf FROM post JOIN idf USING (term) GROUP BY 1, 2",
    "passages",
)
def _(t):
    index = _index(t)
    s = F.col("_s")
    stat = index.stats.select(F.struct("n_docs", "mean_idf")).scalar()
    idf = F.ln(s["n_docs"] - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    weight = F.when(idf < 0, F.greatest(F.lit(kw.EPSILON) * s["mean_idf"], F.lit(0.0))).otherwise(idf)
    return index.terms.withColumn("_s", stat).select(
        "term", "df", "cf", F.col("max_tf").cast("bigint").alias("max_tf"), F.round(weight, 6).alias("idf")
    )


@query(
    "v11_postings",
    f"WITH {_INDEX} SELECT term, chunk_id, tf, dl::INT AS doc_len FROM post",
    "passages",
)
def _(t):
    index = _index(t)
    chunk = index.blocks.select("block", F.posexplode(F.arrays_zip("ids", "lens")).alias("place", "c"))
    entry = index.postings.select("term", "block", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("tfs").alias("tf"))))
    return entry.join(chunk, ["block", "place"]).select(
        "term", F.col("c.ids").alias("chunk_id"), F.col("tf").cast("bigint").alias("tf"), F.col("c.lens").alias("doc_len")
    )


@query(
    "v11_index_statistics",
    f"WITH {_INDEX} SELECT n AS n_docs, round(avgdl, 6) AS avg_len, (SELECT round(avg(idf), 6) FROM idf0) AS mean_idf FROM stat",
    "passages",
)
def _(t):
    return _index(t).stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"), F.round("mean_idf", 6).alias("mean_idf"))


@query(
    "v12_bm25_scores",
    f"WITH {_SCORES} SELECT query_id, chunk_id, round(score + 1e-10, 6) AS score FROM sc",
    "passages asked",
)
def _(t):
    return kw.bm25_scores(t.role("asked"), _index(t)).withColumn("score", _six("score"))


_WANT = "CASE query_id % 4 WHEN 1 THEN 'en' WHEN 2 THEN 'de' WHEN 3 THEN 'es' END"


@query(
    "v13_filtered_top_with_fill",
    f"WITH {_ranked_scores(50, _WANT)} SELECT query_id, chunk_id, rank::INT AS rank, round(score + 1e-10, 6) AS score FROM kr",
    "passages asked",
)
def _(t):
    want = F.expr(_WANT)
    return kw.bm25(t.role("asked").withColumn("doc_type", want), _index(t), 50).withColumn("score", _six("score"))


@query(
    "v13_zero_score_fill",
    f"""WITH {_INDEX}, hit AS (SELECT chunk_id FROM post WHERE term = (SELECT min(term) FROM idf WHERE df = 1)),
        best AS (SELECT doc_type, chunk_id, row_number() OVER (PARTITION BY doc_type ORDER BY (chunk_id IN (SELECT chunk_id FROM hit)) DESC, chunk_id) AS rn FROM passages)
        SELECT p.chunk_id AS query_id, count(*) AS n_rows, sum(b.chunk_id)::BIGINT AS id_sum, sum(b.chunk_id * rn)::BIGINT AS order_sum
        FROM passages p JOIN best b USING (doc_type) WHERE rn <= 10 GROUP BY 1""",
    "passages",
)
def _(t):
    index = _index(t)
    rarest = index.terms.where("df = 1").agg(F.min("term")).scalar()
    # A query per passage with a word nobody has and one that a single passage has.
    asked = t.role("passages").select(
        F.col("chunk_id").alias("query_id"),
        F.concat_ws(" ", F.concat(F.lit("zzz_"), F.col("chunk_id").cast("string")), rarest).alias("text"),
        "doc_type",
    )
    return kw.bm25(asked, index, 10).groupBy("query_id").agg(
        F.count("*").alias("n_rows"),
        F.sum("chunk_id").alias("id_sum"),
        F.sum(F.col("chunk_id") * F.col("rank")).alias("order_sum"),
    )


_FUSED = f"""{_VECTORS}, vd AS (SELECT query_id, chunk_id, round(1 - list_cosine_similarity(qe, ce), 9) AS d FROM qv, cv WHERE qv.sound AND cv.sound),
   vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM vd) WHERE rank <= 50),
   {_ranked_scores(50)},
   kq AS (SELECT * FROM kr WHERE query_id IN (SELECT query_id FROM qv)),
   un AS (SELECT query_id, chunk_id, v.rank AS v, k.rank AS b, v.d, k.score,
          coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS rrf_score
          FROM vr v FULL JOIN kq k USING (query_id, chunk_id)),
   fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, v NULLS LAST, b NULLS LAST) AS rrf_rank FROM un) WHERE rrf_rank <= 50),
   pairs AS (SELECT fu.*, source, list_distinct({_toks('text')}) AS qk, list_distinct({_toks('content')}) AS ck FROM fu JOIN cv USING (chunk_id) JOIN qv USING (query_id)),
   rr AS (SELECT *, CASE WHEN len(qk) = 0 THEN 0 ELSE len(list_intersect(qk, ck))::DOUBLE / len(qk) END AS reranker_score FROM pairs),
   fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, rrf_rank) AS final_rank FROM rr)"""
_FUSED_ROLES = "asked passages"


@query(
    "v14_rank_fusion",
    f"""WITH {_FUSED} SELECT query_id, chunk_id, rrf_rank::INT AS rrf_rank, round(rrf_score, 9) AS rrf_score,
        coalesce(v, 0)::INT AS vector_rank, coalesce(b, 0)::INT AS bm25_rank FROM fu""",
    _FUSED_ROLES,
)
def _(t):
    out = retrieval.fused_candidates(_queries(t), _corpus(t), _index(t))
    return out.select(
        "query_id", "chunk_id", "rrf_rank", F.round("rrf_score", 9).alias("rrf_score"),
        F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"),
    )


@query(
    "v15_rerank",
    f"""WITH {_SCORES}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rrf_rank FROM sc) WHERE rrf_rank <= 20),
        p AS (SELECT c.*, list_distinct({_toks('text')}) AS qk, list_distinct({_toks('content')}) AS ck FROM c JOIN passages USING (chunk_id) JOIN asked USING (query_id)),
        s AS (SELECT *, len(list_intersect(qk, ck))::DOUBLE / len(qk) AS rs FROM p)
        SELECT query_id, chunk_id, final_rank::INT AS final_rank, round(rs, 9) AS reranker_score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rrf_rank) AS final_rank FROM s) WHERE final_rank <= 5""",
    "passages asked",
)
def _(t):
    top = kw.bm25(t.role("asked"), _index(t), 20, fill=False).withColumnRenamed("rank", "rrf_rank")
    out = fusion.rerank(retrieval.with_pair(top, t.role("asked"), t.role("passages")), k=5)
    return out.select("query_id", "chunk_id", "final_rank", F.round("reranker_score", 9).alias("reranker_score"))


@query(
    "v16_retrieve",
    f"""WITH {_FUSED} SELECT query_id, chunk_id, source, final_rank::INT AS final_rank, round(reranker_score, 9) AS reranker_score FROM fin WHERE final_rank <= 5""",
    _FUSED_ROLES,
)
def _(t):
    out = retrieval.retrieve(_queries(t), _corpus(t), index=_index(t))
    return out.select("query_id", "chunk_id", "source", "final_rank", F.round("reranker_score", 9).alias("reranker_score"))


@query(
    "v18_stage_trace",
    f"""WITH {_FUSED} SELECT query_id, chunk_id, coalesce(v, 0)::INT AS vector_rank, coalesce(b, 0)::INT AS bm25_rank, rrf_rank::INT AS rrf_rank,
        CASE WHEN final_rank <= 5 THEN final_rank ELSE 0 END::INT AS final_rank, round(coalesce(d, -1) + 1e-10, 6) AS vector_distance,
        round(coalesce(score, -1) + 1e-10, 6) AS bm25_score, round(rrf_score + 1e-10, 6) AS rrf_score, round(reranker_score + 1e-10, 6) AS reranker_score,
        rrf_rank <= 5 AS in_rrf_top, final_rank <= 5 AS in_rerank_top FROM fin""",
    _FUSED_ROLES,
)
def _(t):
    out = retrieval.trace(_queries(t), _corpus(t), index=_index(t))
    nz = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        "query_id", "chunk_id", nz("vector_rank"), nz("bm25_rank"), "rrf_rank", nz("final_rank"),
        _six(F.coalesce("vector_distance", F.lit(-1.0))).alias("vector_distance"),
        _six(F.coalesce("bm25_score", F.lit(-1.0))).alias("bm25_score"),
        _six("rrf_score").alias("rrf_score"), _six("reranker_score").alias("reranker_score"),
        "in_rrf_top", "in_rerank_top",
    )


@query(
    "s10_export_trace",
    f"WITH {_FUSED} SELECT query_id, count(*) AS n_candidates, sum(chunk_id)::BIGINT AS id_sum FROM fin GROUP BY 1",
    _FUSED_ROLES,
)
def _(t):
    path = shared_dir(t.spark)
    results.export_trace(retrieval.trace(_queries(t), _corpus(t), index=_index(t)), path)
    return t.spark.read.json(path).groupBy("query_id").agg(
        F.count("*").alias("n_candidates"), F.sum("chunk_id").alias("id_sum")
    )


@query(
    "v20_token_view",
    f"""SELECT query_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ') AS raw,
        array_to_string({_toks('text')}, ' ') AS filtered FROM asked""",
    "asked",
)
def _(t):
    view = kw.token_view(t.role("asked"))
    return view.select("query_id", F.array_join("raw", " ").alias("raw"), F.array_join("filtered", " ").alias("filtered"))


@query(
    "d6_two_pass_retrieval",
    f"""WITH {_INDEX}, turns AS (SELECT query_id, text, CASE WHEN query_id % 3 = 0 THEN 'revise' ELSE 'end' END AS decision,
          CASE WHEN query_id % 6 = 0 THEN 'sql' ELSE 'rag' END AS route, split_part(text, '.', 1) AS revised FROM asked),
        asks AS (SELECT query_id, CASE WHEN decision = 'revise' AND route <> 'sql' THEN revised ELSE text END AS text, decision FROM turns),
        qt AS (SELECT query_id, unnest({_toks('text')}) AS term FROM asks),
        sc AS (SELECT query_id, chunk_id, round(sum(w * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
               FROM qt JOIN idf USING (term) JOIN post USING (term), stat GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)
        SELECT query_id, chunk_id, rank::INT AS rank, CASE WHEN decision = 'revise' THEN 1 ELSE 0 END::INT AS revision_count
        FROM r JOIN asks USING (query_id) WHERE rank <= 5""",
    "passages asked",
)
def _(t):
    index = _index(t)
    questions = t.role("asked").select(
        "query_id",
        "text",
        F.when(F.col("query_id") % 3 == 0, "revise").otherwise("end").alias("decision"),
        F.when(F.col("query_id") % 6 == 0, "sql").otherwise("rag").alias("route"),
        F.substring_index("text", ".", 1).alias("revised_query"),
        F.lit(0).alias("revision_count"),
    )

    def search(q):
        return kw.bm25(q, index, 5, fill=False)

    counted, hits = gates.two_pass_retrieve(questions, search(questions), search)
    return hits.join(counted.select("query_id", "revision_count"), "query_id").select("query_id", "chunk_id", "rank", "revision_count")
