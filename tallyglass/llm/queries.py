"""The operators as registered queries over whole tables, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.llm import bpe, chat, fim, identifiers, jaccard, lines, mixing, near_vectors, quality, ranked, repair, sharding, substrings

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = (1.0,) * 16
END_ID = 2


def tokenizer_file() -> str:
    """The public tokenizer that the queries use; the operators take any file of its kind."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "block", "slot", "place")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.remove_repeated_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no preference labels: conversation 2k stands for the chosen one of pair k, 2k + 1 for the rejected."""
    own = chat.conversations(_read(spark, sf_dir, "conversations"))
    side = F.pmod("conv_id", F.lit(2))
    pairs = own.groupBy(F.shiftright("conv_id", 1).alias("pair_id")).agg(
        F.first(F.when(side == 0, F.col("turns")), ignorenulls=True).alias("chosen"),
        F.first(F.when(side == 1, F.col("turns")), ignorenulls=True).alias("rejected"),
    )
    spans = "array_join(transform({0}, x -> concat(x.first, '-', x.stop)), ',')"
    return chat.preference_pairs(pairs).select(
        "pair_id", "n_prompt_turns", "n_chosen_turns", "n_rejected_turns", "prompt", "chosen", "rejected",
        F.expr(spans.format("chosen_mask")).alias("chosen_mask"),
        F.expr(spans.format("rejected_mask")).alias("rejected_mask"), "usable",
    )


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = repair.write_shards(_read(spark, sf_dir, "documents"), tokenizer_file(), END_ID)
    return repair.read_shards(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_read(spark, sf_dir, "documents"), SHARDS)


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_texts(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_texts(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "component_id")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.train(docs, _read(spark, sf_dir, "labels")))
    return judged.drop("probability")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokenizer_file()
    encoded = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), file).drop("text")
    return bpe.decode(encoded, file).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def identifier_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.find_identifiers(_read(spark, sf_dir, "documents"))
    text = "array_join(transform({0}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"
    return found.select(
        "doc_id", *(f"n_{kind}" for kind in identifiers.KINDS),
        F.sha2(F.expr(text.format("filter(spans, x -> x.base)")), 256).alias("base_sha256"),
        F.expr(text.format("spans")).alias("spans"),
    )


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(_read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "documents"))


def whole_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_embedding_near_dedup": embedding_near_dedup,
    "op2_substring_dedup": substring_dedup,
    "op3_source_mixing": source_mixing,
    "op4_line_dedup": line_dedup,
    "op5_preference_formatting": preference_formatting,
    "op6_token_files": token_files,
    "op7_rendezvous_sharding": rendezvous_sharding,
    "op8_ngram_jaccard": ngram_jaccard,
    "op8_ngram_jaccard_links": ngram_jaccard_links,
    "op9_quality_rules": quality_rules,
    "op10_bpe_round_trip": bpe_round_trip,
    "op11_identifiers": identifier_extraction,
    "op12_fill_in_middle": fill_in_middle,
    "op13_ranked_search": ranked_search,
    "pipeline": whole_pipeline,
}

# Components by the least id over links, walked from every node.
_WALK = """
walk AS (
    SELECT id AS node, id AS seen FROM nodes
    UNION
    SELECT w.node, l.b FROM walk w JOIN links l ON l.a = w.seen
)
"""

TWINS: dict[str, str] = {
    "op1_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), nodes AS (SELECT vec_id AS id FROM v),
        sound AS (
            SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0
              AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS MATERIALIZED (
            SELECT s.vec_id AS a, t.vec_id AS b FROM sound s JOIN sound t ON s.vec_id <> t.vec_id AND len(s.e) = len(t.e)
            WHERE list_dot_product(s.e, t.e) / sqrt(list_dot_product(s.e, s.e)) / sqrt(list_dot_product(t.e, t.e)) >= 0.95
        ), {_WALK}, least AS (SELECT node, min(seen) AS c FROM walk GROUP BY node),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, least.c AS component_id, vec_id = least.c AS kept
        FROM v JOIN least ON least.node = vec_id LEFT JOIN n ON n.a = vec_id
    """,
    "op2_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), win AS MATERIALIZED (
            SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS k
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
        ), least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
        gone AS (
            SELECT DISTINCT doc_id, i + j AS i
            FROM (SELECT win.doc_id, win.i FROM win JOIN least USING (k) WHERE least.d < win.doc_id), range(13) AS r(j)
        ), flat AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t
            FROM flat LEFT JOIN (SELECT doc_id, i, 1 AS x FROM gone) g USING (doc_id, i) WHERE x IS NULL GROUP BY doc_id
        ), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op3_source_mixing": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce(source, '') AS src,
                row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) - 1 AS nth FROM documents
        ), sizes AS (SELECT src, count(*) AS n FROM d GROUP BY src),
        s AS (
            SELECT src, CAST(greatest(1, round(sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) * 256)) AS BIGINT) AS u,
                (n + 15) // 16 AS blocks, row_number() OVER (ORDER BY src) AS k FROM sizes
        ), breaks AS (
            SELECT 0 AS b UNION SELECT blocks // u FROM s UNION SELECT blocks // u + 1 FROM s
        ), kinds AS (
            SELECT b, list(least(greatest(blocks - b * u, 0), u) ORDER BY k) AS units,
                CAST(sum(least(greatest(blocks - b * u, 0), u)) AS BIGINT) AS total
            FROM breaks, s GROUP BY b HAVING total > 0
        ), run AS (
            SELECT b, units, total, CAST(0 AS BIGINT) AS t, list_transform(units, lambda x: CAST(0 AS BIGINT)) AS c,
                CAST(0 AS BIGINT) AS k FROM kinds
            UNION ALL
            SELECT b, units, total, t + 1, list_transform(c, lambda x, i: x + CASE WHEN i = best THEN 1 ELSE 0 END), best
            FROM (
                SELECT *, list_min(list_filter(list_transform(units, lambda u, i:
                    CASE WHEN c[i] < u AND (c[i] * total) // greatest(u, 1) <= t
                        THEN (((c[i] + 1) * total + greatest(u, 1) - 1) // greatest(u, 1)) * 100000 + i END),
                    lambda x: x IS NOT NULL)) % 100000 AS best
                FROM run WHERE t < total
            )
        ), turns AS (
            SELECT b, k, t - 1 AS in_period, row_number() OVER (PARTITION BY b, k ORDER BY t) - 1 AS turn FROM run WHERE t > 0
        ), placed AS (
            SELECT d.doc_id, d.source, nth // 16 AS block, nth % 16 AS place, s.k, (nth // 16) // s.u AS period,
                (nth // 16) % s.u AS turn FROM d JOIN s USING (src)
        ), periods AS (SELECT DISTINCT period FROM placed),
        ahead AS (
            SELECT period, (SELECT max(b) FROM breaks WHERE b <= period) AS b,
                (SELECT CAST(sum(least(blocks, period * u)) AS BIGINT) FROM s) AS before FROM periods
        )
        SELECT doc_id, source, block, before + in_period AS slot, place
        FROM placed JOIN ahead USING (period) JOIN turns USING (b, k, turn)
    """,
    "op4_line_dedup": r"""
        WITH d AS (
            SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
        ), win AS MATERIALIZED (
            SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c
            FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d WHERE len(ls) >= 3)
            WHERE regexp_matches(concat(ls[i], ls[i + 1], ls[i + 2]), '[^\x20\x09-\x0D]')
        ), first AS (SELECT a, b, c, min({'d': doc_id, 'i': i}) AS f FROM win GROUP BY a, b, c),
        gone AS (
            SELECT DISTINCT doc_id, i + j AS i
            FROM (SELECT doc_id, i FROM win JOIN first USING (a, b, c) WHERE {'d': doc_id, 'i': i} > f), range(3) AS r(j)
        ), flat AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM d),
        kept AS (
            SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS t
            FROM flat LEFT JOIN (SELECT doc_id, i, 1 AS x FROM gone) g USING (doc_id, i) WHERE x IS NULL GROUP BY doc_id
        ), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, coalesce(n.n, 0) AS n_removed,
            sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op5_preference_formatting": """
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
                coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), p AS (
            SELECT conv_id // 2 - CASE WHEN conv_id < 0 AND conv_id % 2 <> 0 THEN 1 ELSE 0 END AS pair_id, abs(conv_id % 2) AS side, i, role, text,
                concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)) AS shown, length(role) + 5 AS head FROM t
        ), pairs AS (
            SELECT pair_id, count(DISTINCT i) FILTER (side = 0) AS n0, count(DISTINCT i) FILTER (side = 1) AS n1 FROM p GROUP BY pair_id
        ), miss AS (
            SELECT a.pair_id, min(a.i) AS i FROM p a JOIN p b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
            WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id
        ), cut AS (
            SELECT pair_id, n0, n1, coalesce(miss.i - 1, least(n0, n1)) AS k FROM pairs LEFT JOIN miss USING (pair_id)
        ), tail AS (
            SELECT p.*, k, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY p.i
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM p JOIN cut USING (pair_id) WHERE p.i > k
        ), sides AS (
            SELECT pair_id, side, string_agg(shown, '' ORDER BY i) AS body,
                string_agg(concat(CAST(before + head AS BIGINT), '-', CAST(before + length(shown) AS BIGINT)), ',' ORDER BY i) FILTER (role = 'assistant') AS mask
            FROM tail GROUP BY pair_id, side
        ), prompts AS (
            SELECT pair_id, string_agg(shown, '' ORDER BY p.i) AS body FROM p JOIN cut USING (pair_id)
            WHERE p.i <= k AND side = 0 GROUP BY pair_id
        )
        SELECT c.pair_id, k AS n_prompt_turns, n0 - k AS n_chosen_turns, n1 - k AS n_rejected_turns,
            coalesce(q.body, '') AS prompt, coalesce(a.body, '') AS chosen, coalesce(b.body, '') AS rejected,
            coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask,
            a.mask IS NOT NULL AND b.mask IS NOT NULL AS usable
        FROM cut c LEFT JOIN prompts q ON q.pair_id = c.pair_id
            LEFT JOIN sides a ON a.pair_id = c.pair_id AND a.side = 0 LEFT JOIN sides b ON b.pair_id = c.pair_id AND b.side = 1
    """,
    "op7_rendezvous_sharding": """
        WITH RECURSIVE bits AS (
            SELECT n AS byte, CAST(n AS BIGINT) AS c, 0 AS step FROM range(256) AS r(n)
            UNION ALL
            SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8
        ), crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE step = 8),
        d AS (
            SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size,
                coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents
        ), summed AS (
            SELECT doc_id, size, key, xor(list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(concat('0x', x) AS BIGINT))),
                lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS text_crc32
            FROM d, crc
        ), scores AS (
            SELECT doc_id, size, text_crc32, s, 1.0 / -ln((CAST(concat('0x', substr(md5(concat(key, '/', s)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS score
            FROM summed, range(17) AS r(s)
        ), best AS (
            SELECT doc_id, size, text_crc32, CAST(arg_max(s, score) FILTER (s < 16) AS INT) AS shard,
                CAST(arg_max(s, score) AS INT) AS grown_shard FROM scores GROUP BY doc_id, size, text_crc32
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
            row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM best
    """,
    "op8_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), nodes AS (SELECT id FROM w),
        sh AS MATERIALIZED (
            SELECT DISTINCT id, array_to_string(words[i : i + 4], ' ') AS k
            FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
        ), n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
        sets AS (SELECT id, md5(string_agg(k, chr(10) ORDER BY k)) AS s FROM sh GROUP BY id),
        class AS (SELECT s, min(id) AS c, count(*) AS copies FROM sets GROUP BY s),
        lead AS (SELECT sh.id, sh.k FROM sh JOIN class ON class.c = sh.id),
        near AS (
            SELECT a.id AS a, b.id AS b, count(*) AS i FROM lead a JOIN lead b ON a.k = b.k AND a.id <> b.id GROUP BY a.id, b.id
        ), pairs AS MATERIALIZED (
            SELECT a, b FROM near JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
        ), others AS (SELECT a, sum(copies) AS n FROM pairs JOIN class ON class.c = b GROUP BY a),
        links AS MATERIALIZED (
            SELECT a, b FROM pairs
            UNION SELECT id, c FROM sets JOIN class USING (s) WHERE id <> c
            UNION SELECT c, id FROM sets JOIN class USING (s) WHERE id <> c
        ), {_WALK}, least AS (SELECT node, min(seen) AS c FROM walk GROUP BY node)
        SELECT w.id AS doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(class.c, w.id) AS class_id,
            CAST(coalesce(others.n, 0) + coalesce(class.copies, 1) - 1 AS BIGINT) AS n_links, least.c AS component_id
        FROM w JOIN least ON least.node = w.id LEFT JOIN n ON n.id = w.id LEFT JOIN sets ON sets.id = w.id LEFT JOIN class USING (s) LEFT JOIN others ON others.a = class.c
    """,
    "op8_ngram_jaccard_links": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), nodes AS (SELECT id FROM w),
        sh AS MATERIALIZED (
            SELECT DISTINCT id, array_to_string(words[i : i + 4], ' ') AS k
            FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
        ), n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
        sets AS (SELECT id, md5(string_agg(k, chr(10) ORDER BY k)) AS s FROM sh GROUP BY id),
        class AS (SELECT s, min(id) AS c, count(*) AS copies FROM sets GROUP BY s),
        lead AS (SELECT sh.id, sh.k FROM sh JOIN class ON class.c = sh.id),
        near AS (
            SELECT a.id AS a, b.id AS b, count(*) AS i FROM lead a JOIN lead b ON a.k = b.k AND a.id <> b.id GROUP BY a.id, b.id
        ), pairs AS MATERIALIZED (
            SELECT a, b FROM near JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
        ), others AS (SELECT a, sum(copies) AS n FROM pairs JOIN class ON class.c = b GROUP BY a),
        links AS MATERIALIZED (
            SELECT a, b FROM pairs
            UNION SELECT id, c FROM sets JOIN class USING (s) WHERE id <> c
            UNION SELECT c, id FROM sets JOIN class USING (s) WHERE id <> c
        ), {_WALK}, least AS (SELECT node, min(seen) AS c FROM walk GROUP BY node)
        SELECT w.id AS doc_id, coalesce(class.c, w.id) AS class_id,
            CAST(coalesce(others.n, 0) + coalesce(class.copies, 1) - 1 AS BIGINT) AS n_links, least.c AS component_id
        FROM w JOIN least ON least.node = w.id LEFT JOIN sets ON sets.id = w.id LEFT JOIN class USING (s) LEFT JOIN others ON others.a = class.c
    """,
    "op12_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls,
                sha256(concat('7:', CAST(doc_id AS VARCHAR))) AS h FROM documents
        ), drawn AS (
            SELECT doc_id, t, ls, len(ls) AS n, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % (len(ls) + 1) AS a,
                CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) % (len(ls) + 1) AS b,
                CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) % 100 AS side FROM d
        ), cut AS (
            SELECT doc_id, t, n, side, array_to_string(ls[1 : least(a, b)], '') AS p,
                array_to_string(ls[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(ls[greatest(a, b) + 1 :], '') AS s,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                    WHEN side < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m)
                ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM cut
    """,
    "op13_ranked_search": r"""
        WITH d AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
        lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lens),
        m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM lens, totals),
        w AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
            FROM tf, totals GROUP BY term, docs
        ), asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), scores AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
        ) WHERE rank <= 50
    """,
}
