"""Keyword scoring: inverted index and Okapi BM25 over a table of queries.

The index holds the postings of a term in blocks of chunks, one row for each (term, block), with the largest frequency
and the shortest length among them. Every file is sorted by term, so a search reads only the pages of its terms. Inside a task the two figures bound what a block can add to a query; a block that cannot reach a query's ``k``-th
score so far is passed over without looking at its postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyglass.functions.joins import BROADCAST_ROWS
from tallyglass.functions.text import STOPWORDS, keyword_tokens, raw_tokens
from tallyglass.operators.knn import QUERY_BLOCK
from tallyglass.operators.latest import top_per_key, top_per_key_in_shares
from tallyglass.operators.keys import require_unique
from tallyglass.operators.tasks import tidy
from tallyglass.operators.tokens import counted_tokens, slices
from tallyglass.operators.topk import DIGITS, TopK, output_types
from tallyglass.session import remove_dir, shared_dir

# Fixed values of the scoring formula.
K1 = 1.5
B = 0.75
EPSILON = 0.25


# Chunks of a block, and terms of a block of queries: with 4,096 queries a dense block is 16 MB of doubles.
BLOCK_CHUNKS = 512
QUERY_TERMS = 50_000
# Ranges of terms that a scan is asked for.
TERM_RANGES = 8


@dataclass(frozen=True)
class Bm25Index:
    """postings(term, block, places, tfs, max_tf, min_len) · blocks(block, ids, kinds, lens) ·
    terms(term, df, cf, max_tf) · stats(n_docs, avg_len, mean_idf) · chunks(chunk_id, doc_type)

    ``places`` are positions in the arrays of the block's row.
    """

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    chunks: DataFrame
    path: str

    def remove(self) -> None:
        """Delete the index; nothing may read it any more."""
        remove_dir(self.postings.sparkSession, self.path)


@dataclass(frozen=True)
class IndexSource:
    """Chunks whose index is yet to be written."""

    chunks: DataFrame
    text: str

    def save(self, path: str) -> Bm25Index:
        """Write the index and return it on the written tables.

        Texts are tokenised once, in the tasks that read them, into rows by term and block and one row for each block;
        the others derive from it. A term that stands in a third of all chunks is spread over its blocks.
        """
        spark = self.chunks.sparkSession
        # Numbers of rows do not run on from one partition to the next, and neither do blocks.
        numbered = self.chunks.select("chunk_id", "doc_type", F.lower(self.text).alias("_t"), F.monotonically_increasing_id().alias("_n"))
        own = numbered.schema["chunk_id"].dataType.simpleString()
        numbered.mapInArrow(tidy(_runs), f"{_RUNS}, ids array<{own}>, kinds array<string>").write.mode("overwrite").parquet(f"{path}/runs")
        runs = spark.read.parquet(f"{path}/runs")
        # Blocks of a term are dealt over the files; each file is in the order of its terms.
        dealt = runs.where("term is not null").drop("ids", "kinds").repartition("term", "block").sortWithinPartitions("term", "block")
        dealt.write.mode("overwrite").parquet(f"{path}/postings")
        heads = runs.where("term is null").select("block", F.arrays_zip("places", "ids", "kinds", F.col("tfs").alias("lens")).alias("_c"))
        blocks = heads.groupBy("block").agg(F.sort_array(F.flatten(F.collect_list("_c"))).alias("_c")).select(
            "block", F.col("_c.ids").alias("ids"), F.col("_c.kinds").alias("kinds"), F.col("_c.lens").alias("lens")
        )
        blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        chunks = spark.read.parquet(f"{path}/blocks").select(F.inline(F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("kinds").alias("doc_type"))))
        chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        sums = F.aggregate("tfs", F.lit(0).cast("bigint"), lambda a, x: a + x)
        terms = spark.read.parquet(f"{path}/postings").groupBy("term").agg(
            F.sum(F.size("places")).alias("df"), F.sum(sums).alias("cf"), F.max("max_tf").alias("max_tf")
        )
        terms.write.mode("overwrite").parquet(f"{path}/terms")
        _stats(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/chunks")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        remove_dir(spark, f"{path}/runs")
        return load_index(spark, path)


_RUNS = "term string, block long, places array<int>, tfs array<int>, max_tf int, min_len int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings by (term, block) from rows of ``chunk_id, doc_type, lower-cased text, number``.

    A row without a term has the chunks of a block: places, lengths in place of frequencies, ids and types. A block that
    is cut, at the end of a batch or of a task, gives two rows for a term; a search adds them up.
    """
    for batch in batches:
        number = batch.column(3).to_numpy()
        starts = np.flatnonzero(np.r_[True, number[1:] // BLOCK_CHUNKS != number[:-1] // BLOCK_CHUNKS])
        for i, j in slices(batch.column(2), starts):
            yield from _slice_runs(batch.slice(i, j - i))


def _slice_runs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _RUNS.split(", ")] + ["ids", "kinds"]
    own, kinds = rows.column(0), rows.column(1)
    at_block, at_place = np.divmod(rows.column(3).to_numpy(), BLOCK_CHUNKS)
    at_place = at_place.astype(np.int32)
    terms, row, code, tf, size = counted_tokens(rows.column(2), STOPWORDS)
    size = size.astype(np.int32)

    def lists(first, values):
        return pa.ListArray.from_arrays(pa.array(np.r_[first, len(values)].astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))

    def none(n, kind):
        return pa.nulls(n, pa.list_(kind))

    first = np.flatnonzero(np.r_[True, at_block[1:] != at_block[:-1]])
    n = len(first)
    head = [pa.nulls(n, pa.string()), pa.array(at_block[first]), lists(first, at_place), lists(first, size), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), lists(first, own), lists(first, kinds)]
    yield pa.RecordBatch.from_arrays(head, names)
    if not len(row):
        return
    order = np.lexsort((row, code, at_block[row]))
    block, code, row, tf = at_block[row][order], code[order], row[order], tf[order].astype(np.int32)
    first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (code[1:] != code[:-1])])
    n = len(first)
    yield pa.RecordBatch.from_arrays(
        [
            terms.take(pa.array(code[first])), pa.array(block[first]), lists(first, at_place[row]), lists(first, tf),
            pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(size[row], first)), none(n, own.type), none(n, kinds.type),
        ],
        names,
    )


def load_index(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(*[spark.read.parquet(f"{path}/{p}") for p in ("postings", "blocks", "terms", "stats", "chunks")], path)


def _idf(n, df):
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def _stats(terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row from the term table and the number of chunks; chunks without a token count as well."""
    n = chunks.agg(F.count("*").alias("n")).scalar()
    return (
        terms.withColumn("_n", n)
        .agg(
            F.max("_n").alias("n_docs"),
            (F.sum("cf").cast("double") / F.max("_n")).alias("avg_len"),
            F.avg(_idf(F.col("_n"), F.col("df"))).alias("mean_idf"),
        )
    )


def build_index(chunks: DataFrame, text: str = "content") -> IndexSource:
    """What the index of ``chunk_id, doc_type, <text>`` is made of; frequencies and lengths cover the whole corpus.

    :meth:`IndexSource.save` it to search more than once; a search writes an unsaved one to the shared folder.
    """
    return IndexSource(chunks, text)


def _stored(index: Bm25Index | IndexSource) -> Bm25Index:
    return index if isinstance(index, Bm25Index) else index.save(shared_dir(index.chunks.sparkSession))


def token_view(queries: DataFrame) -> DataFrame:
    """Tokens of each query before and after the stopwords."""
    return queries.select(
        "query_id", raw_tokens("text").alias("raw"), keyword_tokens("text").alias("filtered")
    )


@dataclass(frozen=True)
class _Asked:
    """queries(query_id, scope, terms) · classes(query_id, scope, terms), one query for all of one scope and the same terms.

    ``terms`` are those of the corpus, sorted, with repeats. Words that no chunk has make no difference to a result.
    """

    queries: DataFrame
    classes: DataFrame
    n_queries: int
    n_classes: int

    def spread(self, results: DataFrame, k: int | None) -> DataFrame:
        """Results of the classes, at most ``k`` rows each, for all their queries."""
        if self.n_classes == self.n_queries:
            return results
        rest = [c for c in results.columns if c != "query_id"]
        key, of = F.struct("scope", "terms").alias("_key"), F.col("query_id").alias("_class")
        classes, queries = self.classes.select(key, of), self.queries.select(key, "query_id")
        small = self.n_classes <= BROADCAST_ROWS
        members = queries.join(F.broadcast(classes) if small else classes, "_key").select("query_id", "_class")
        results = results.withColumnRenamed("query_id", "_class")
        if self.n_queries <= BROADCAST_ROWS:
            members = F.broadcast(members)
        elif k is not None and self.n_classes * k <= BROADCAST_ROWS:
            results = F.broadcast(results)
        return members.join(results, "_class").select("query_id", *rest)


def _asked(queries: DataFrame, index: Bm25Index) -> _Asked:
    spark = queries.sparkSession
    require_unique(queries, ["query_id"], "queries")
    scope = F.col("doc_type") if "doc_type" in queries.columns else F.lit(None).cast("string")
    words = queries.select("query_id", scope.alias("scope"), F.explode_outer(keyword_tokens("text")).alias("term"))
    known = words.join(index.terms.select("term", F.lit(True).alias("_known")), "term", "left")
    own = known.groupBy("query_id", "scope").agg(F.sort_array(F.collect_list(F.when(F.col("_known"), F.col("term")))).alias("terms"))
    path = shared_dir(spark)
    own.write.parquet(f"{path}/queries")
    own = spark.read.parquet(f"{path}/queries")
    own.groupBy("scope", "terms").agg(F.min("query_id").alias("query_id")).write.parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    return _Asked(own, classes, own.count(), classes.count())


def _weighted_terms(asked: DataFrame, index: Bm25Index, epsilon: float) -> DataFrame:
    """query_id, scope, term, weight of queries with their terms: how often each stands there x idf."""
    s = F.col("_s")
    idf = _idf(s["n_docs"], F.col("df"))
    floor = F.greatest(F.lit(epsilon) * s["mean_idf"], F.lit(0.0))
    counted = asked.select("query_id", "scope", F.explode("terms").alias("term")).groupBy("query_id", "scope", "term").agg(F.count("*").alias("qtf"))
    return (
        counted.join(index.terms, "term")
        .withColumn("_s", index.stats.select(F.struct("n_docs", "mean_idf")).scalar())
        .select("query_id", "scope", "term", (F.col("qtf") * F.when(idf < 0, floor).otherwise(idf)).alias("weight"))
    )


def _in_ranges(terms: list[str], most: int = TERM_RANGES) -> Column:
    """A condition on sorted ``terms`` that the scan can check against its statistics; it may let others through."""
    cut = np.array_split(np.arange(len(terms)), min(most, len(terms)))
    return reduce(Column.__or__, [F.col("term").between(terms[i[0]], terms[i[-1]]) for i in cut])


def wanted_postings(index: Bm25Index, terms: list[str]) -> DataFrame:
    """Rows of the sorted ``terms`` with their number in the list."""
    numbers = index.postings.sparkSession.createDataFrame(list(enumerate(terms)), "term_no int, term string")
    return index.postings.where(_in_ranges(terms)).join(F.broadcast(numbers), "term")


def _search(asked: pa.Table, index: Bm25Index, k: int | None, k1: float, b: float, schema: pa.Schema, ddl: str) -> DataFrame:
    """query_id, chunk_id, value: the best ``k`` chunks of each task for one block of queries; without ``k``, all that share a term."""
    spark = index.postings.sparkSession
    terms, number = np.unique(np.asarray(asked.column("term").to_pylist(), dtype=object).astype(str), return_inverse=True)
    by_query = dict(zip(asked.column("query_id").to_pylist(), asked.column("scope").to_pylist()))
    at = {q: i for i, q in enumerate(by_query)}
    by_term = np.argsort(number, kind="stable")
    first = np.searchsorted(number[by_term], np.arange(len(terms) + 1))
    query = np.asarray([at[q] for q in asked.column("query_id").to_pylist()], dtype=np.int64)[by_term]
    weight = asked.column("weight").to_numpy()[by_term]
    avg = index.stats.first()["avg_len"]
    shared = spark.sparkContext.broadcast((list(by_query), list(by_query.values()), first, query, weight))

    hits = wanted_postings(index, [str(t) for t in terms]).select("block", "term_no", "places", "tfs", "max_tf", "min_len")
    # The row of a block comes before those of its terms.
    heads = index.blocks.select("block", F.lit(-1).alias("term_no"), "ids", "kinds", "lens")
    rows = hits.unionByName(heads, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "term_no")
    names = ["block", "term_no", "places", "tfs", "max_tf", "min_len", "ids", "kinds", "lens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scopes, first, query, weight = shared.value
        every: list[pa.RecordBatch] = []  # of one block, where all are wanted
        if k is not None:
            best = TopK(ids, scopes, k)
            best.limit = 2 * k * len(ids) + 20_000  # the bar of each query rises with every cut
        asked_scope = np.asarray([s or "" for s in scopes], dtype=object)
        own_id = np.asarray(ids)

        def expand(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For entries of terms: the entry and the place in ``query`` of each query that asks for it."""
            n = first[term + 1] - first[term]
            return np.repeat(np.arange(len(term)), n), np.repeat(first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())

        def share(tf, length):
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))

        def block(head: dict, rows: pa.Table) -> None:
            term = rows.column("term_no").to_numpy()
            entry, asks = expand(term)
            if k is None:
                return whole(head, rows, term)
            bound = share(rows.column("max_tf").to_numpy().astype(float), rows.column("min_len").to_numpy())[entry] * weight[asks]
            most = np.bincount(query[asks], bound, len(ids))
            # A query stays if the block may hold a score as good as its k-th one; sums differ by rounding only.
            stays = np.flatnonzero((most > 0) & (most + 1e-6 >= -best.worst))
            if not len(stays):
                return
            column = np.full(len(ids), -1, np.int64)
            column[stays] = np.arange(len(stays))
            place, tf, size = (rows.column(c).combine_chunks() for c in ("places", "tfs", "places"))
            size = np.diff(size.offsets.to_numpy())
            place, tf = place.flatten().to_numpy(), tf.flatten().to_numpy()
            part = share(tf, np.asarray(head["lens"])[place])
            entry, asks = expand(np.repeat(term, size))
            kept = column[query[asks]] >= 0
            entry, asks = entry[kept], asks[kept]
            cell = place[entry].astype(np.int64) * len(stays) + column[query[asks]]
            total = np.bincount(cell, part[entry] * weight[asks], len(head["ids"]) * len(stays)).reshape(len(head["ids"]), -1)
            own, kinds = (np.asarray(head[c], dtype=object) for c in ("ids", "kinds"))
            own = own.astype(str) if isinstance(head["ids"][0], str) else np.asarray(head["ids"])
            best.add(own, kinds, -total, keep=np.round(total, DIGITS) > 0, queries=stays)

        def whole(head: dict, rows: pa.Table, term: np.ndarray) -> None:
            place, tf, size = (rows.column(c).combine_chunks() for c in ("places", "tfs", "places"))
            size = np.diff(size.offsets.to_numpy())
            place, tf = place.flatten().to_numpy(), tf.flatten().to_numpy()
            part = share(tf, np.asarray(head["lens"])[place])
            entry, asks = expand(np.repeat(term, size))
            stays, column = np.unique(query[asks], return_inverse=True)
            cell, at = np.unique(place[entry].astype(np.int64) * max(1, len(stays)) + column, return_inverse=True)
            total = np.bincount(at, part[entry] * weight[asks], len(cell))
            chunk, column = np.divmod(cell, max(1, len(stays)))
            kinds, scope = np.asarray([x or "" for x in head["kinds"]], dtype=object)[chunk], asked_scope[stays[column]]
            fits = (np.asarray([s is None for s in scopes])[stays[column]]) | (scope == kinds)
            chunk, total, asked_by = chunk[fits], total[fits], stays[column[fits]]
            own = np.asarray(head["ids"], dtype=object if isinstance(head["ids"][0], str) else None)[chunk]
            columns = [pa.array(own_id[asked_by].tolist(), schema.field(0).type), pa.array(own.tolist(), schema.field(1).type), pa.array(-np.round(total, DIGITS))]
            every.append(pa.RecordBatch.from_arrays(columns, schema=schema))

        held = None  # rows of the last block, which may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            number = rows.column("block").to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, number[1:] != number[:-1]]), len(number)]
            for i, j in zip(cuts[:-2], cuts[1:-1]):
                if j - i > 1:
                    block(_head(rows.slice(i, 1)), rows.slice(i + 1, j - i - 1))
                    while every:
                        yield every.pop()
            held = rows.slice(cuts[-2]) if len(number) else held
        if held is not None and held.num_rows > 1:
            block(_head(held.slice(0, 1)), held.slice(1))
        yield from every
        out = best.batch(schema) if k is not None else None
        if out is not None:
            yield out

    return rows.select(*names).mapInArrow(tidy(run), ddl)


def _head(row: pa.Table) -> dict:
    return {c: row.column(c)[0].as_py() for c in ("ids", "kinds", "lens")}


def _hits(
    asked: _Asked, index: Bm25Index, k: int | None, k1: float = K1, b: float = B, epsilon: float = EPSILON,
    max_terms: int = QUERY_TERMS, max_queries: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, chunk_id, score of the classes of queries: the best ``k`` chunks of each task, or all that share a term.

    They are taken in blocks of about ``max_queries`` queries and ``max_terms`` terms, dealt by a hash of their id, so
    what is broadcast does not grow with their number. A block reads the rows of its terms, brings them together by
    block of chunks, and adds up a chunk's shares in the order of the terms, whatever the block.
    """
    spark = asked.queries.sparkSession
    schema, ddl = output_types(asked.queries, index.chunks)
    path = shared_dir(spark)
    weighted = _weighted_terms(asked.classes, index, epsilon)
    weighted.write.parquet(path)
    weighted = spark.read.schema(weighted.schema).parquet(path)
    size = weighted.agg(F.count("*").alias("terms"), F.count_distinct("query_id").alias("queries")).first()
    n = max(-(-size["terms"] // max(1, max_terms)), -(-size["queries"] // max(1, max_queries)))
    hits = spark.createDataFrame([], ddl)
    for number in range(n):
        own = weighted if n == 1 else weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == number)
        block = own.toArrow()
        if block.num_rows:
            hits = hits.unionByName(_search(block, index, k, k1, b, schema, ddl))
    return hits.select("query_id", "chunk_id", (-F.col("value")).alias("score"))


def bm25_scores(queries: DataFrame, index: Bm25Index | IndexSource, **kw) -> DataFrame:
    """query_id, chunk_id, score of every chunk that shares a term with the query."""
    index = _stored(index)
    asked = _asked(queries, index)
    return asked.spread(_hits(asked, index, None, **kw), None)


def _scored_top(asked: _Asked, index: Bm25Index, k: int, **kw) -> DataFrame:
    """Best ``k`` chunks with a score above zero per class of queries: query_id, chunk_id, score, rank.

    Scores of single (query, chunk) pairs never become rows.
    """
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    return top_per_key_in_shares(_hits(asked, index, k, **kw), ["query_id"], order, k, "chunk_id")


def _fill_pool(index: Bm25Index, k: int) -> DataFrame:
    """Per document type, and for all types together, the 2k lowest chunk ids.

    Fewer than k chunks of a query score above zero when a zero is needed at all, so at least k of
    these 2k score zero, and they are the lowest such ids.
    """
    per_type = top_per_key(index.chunks, ["doc_type"], [F.col("chunk_id").asc()], 2 * k, "_rn")
    own = per_type.select(F.col("doc_type").alias("scope"), "chunk_id")
    every = own.select(F.lit("*").alias("scope"), "chunk_id").orderBy("chunk_id").limit(2 * k)
    return own.select(F.concat(F.lit("="), "scope").alias("scope"), "chunk_id").unionByName(every)


def bm25(queries: DataFrame, index: Bm25Index | IndexSource, k: int = 50, fill: bool = True, **kw) -> DataFrame:
    """Best ``k`` chunks per query: ``query_id, chunk_id, score, rank``.

    ``queries``: query_id, text and optionally doc_type (null = all). Chunks without a shared term
    score 0 and fill the list in chunk-id order, as a full scan of the corpus would: the best ``k``
    scored chunks are joined by a bounded pool of zeros and ranked again. Queries of one type with the same terms of the
    corpus are answered once. A repeated query id is refused.
    """
    index = _stored(index)
    asked = _asked(queries, index)
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    best = _scored_top(asked, index, k, **kw)
    if not fill:
        return asked.spread(best, k)
    wanted = asked.classes.select("query_id", F.coalesce(F.concat(F.lit("="), "scope"), F.lit("*")).alias("scope"))
    zeros = wanted.join(_fill_pool(index, k), "scope").select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    both = best.drop("rank").unionByName(zeros).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return asked.spread(top_per_key(both, ["query_id"], order, k), k)
