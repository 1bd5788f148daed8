"""Scoring of cases and the scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import bm25 as kw
from tallyglass.operators import gates, scoring
from tallyglass.plans import scorecard as card
from tallyglass.session import shared_dir
from tallyglass.sources import cases as labelled
from tallyglass.sources import results
from tallyglass.workload.corpora import _index, _ranked_scores
from tallyglass.workload.governance import _SCORED, _audited
from tallyglass.workload.registry import query

_OOS = "category IN ('sql_oos', 'rag_oos')"


def _routed(t):
    return scoring.score_route(t.cases())


@query("e1_route_match", "SELECT case_id, expected_route = actual_route AS route_passed FROM cases", "cases")
def _(t):
    return _routed(t).select("case_id", "route_passed")


@query(
    "e2_confusion",
    """SELECT expected, count(*) FILTER (WHERE actual_route = 'sql') AS actual_sql, count(*) FILTER (WHERE actual_route = 'rag') AS actual_rag,
       count(*) FILTER (WHERE actual_route = 'hybrid') AS actual_hybrid, count(*) FILTER (WHERE actual_route = 'none') AS actual_none
       FROM (SELECT expected_route AS expected, actual_route FROM cases) GROUP BY 1 UNION ALL SELECT 'none', 0, 0, 0, 0""",
    "cases",
)
def _(t):
    return scoring.confusion(t.cases(), [*scoring.ROUTES, "none"])


@query(
    "e3_accuracy_by_scope",
    f"""SELECT CASE WHEN {_OOS} THEN 'out_of_scope' ELSE 'in_scope' END AS scope,
        count(*) FILTER (WHERE expected_route = actual_route) AS n_passed, count(*) AS n_total FROM cases GROUP BY 1""",
    "cases",
)
def _(t):
    return scoring.by_scope(_routed(t))


@query(
    "e4_measure_match",
    """SELECT case_id, expected_measure IS NOT DISTINCT FROM raw_measure AS measure_passed,
       CASE WHEN expected_measure IS NULL AND raw_measure IS NULL THEN 'correct refusal (no measure for out-of-scope question)'
            WHEN expected_measure IS NULL THEN 'hallucinated measure ''' || raw_measure || ''' for out-of-scope question'
            WHEN raw_measure IS NULL THEN 'refused but a measure was expected'
            WHEN expected_measure <> raw_measure THEN 'wrong measure' ELSE '' END AS measure_detail FROM cases""",
    "cases",
)
def _(t):
    return scoring.score_measure(t.cases(), actual="raw_measure").select("case_id", "measure_passed", "measure_detail")


_GLOSS = """gl AS (SELECT *, list_transform(split(expected_refs, ','), lambda r: split_part(r, '.', -1)) AS el,
     list_transform(split(actual_refs, ','), lambda r: split_part(r, '.', -1)) AS al FROM cases),
   gm AS (SELECT *, list_sort(list_distinct(list_filter(el, lambda r: NOT list_contains(al, r)))) AS missing,
     list_sort(list_distinct(list_filter(al, lambda r: NOT list_contains(el, r)))) AS extra FROM gl)"""


@query(
    "e5_glossary_match",
    f"""WITH {_GLOSS} SELECT case_id, len(missing) = 0 AND len(extra) = 0 AS glossary_passed, array_to_string(missing, ',') AS missing,
        array_to_string(extra, ',') AS extra, concat_ws('; ', CASE WHEN len(missing) > 0 THEN 'missing [''' || array_to_string(missing, ''', ''') || ''']' END,
        CASE WHEN len(extra) > 0 THEN 'extra [''' || array_to_string(extra, ''', ''') || ''']' END) AS detail FROM gm""",
    "cases",
)
def _(t):
    return scoring.score_glossary(t.cases()).select(
        "case_id",
        "glossary_passed",
        F.array_join("glossary_missing", ",").alias("missing"),
        F.array_join("glossary_extra", ",").alias("extra"),
        F.col("glossary_detail").alias("detail"),
    )


_STATUS = "CASE WHEN raw_measure IS NULL OR raw_confidence < 0.5 THEN 'no_measure_matched' ELSE 'success' END"


@query(
    "e6_status_match",
    f"SELECT case_id, coalesce(expected_status, 'success') = {_STATUS} AS status_passed FROM cases",
    "cases",
)
def _(t):
    gated = gates.gate_measure(t.cases(), "raw_measure", "raw_confidence").withColumns(
        {
            "actual_status": F.when(F.col("accepted_measure").isNull(), "no_measure_matched").otherwise("success"),
            "expected_status": F.coalesce("expected_status", F.lit("success")),
        }
    )
    return scoring.score_status(gated).select("case_id", "status_passed")


_EVAL = f"""{_GLOSS}, ev AS (SELECT *, coalesce(raw_measure IS NOT NULL AND raw_confidence < 0.5, false) AS gated_out,
     CASE WHEN raw_confidence >= 0.5 THEN raw_measure END AS picked, {_STATUS} AS status FROM gm),
   me AS (SELECT *, expected_measure IS NOT DISTINCT FROM picked AS measure_passed, coalesce(expected_status, 'success') = status AS status_passed,
     CASE WHEN expected_measure IS NOT NULL THEN picked IS NOT NULL AND len(missing) = 0 AND len(extra) = 0 END AS glossary_passed FROM ev)"""


@query(
    "e7_measure_eval",
    f"""WITH {_EVAL} SELECT case_id, gated_out, coalesce(picked, '') AS selected_measure, status AS actual_status, measure_passed, status_passed,
        coalesce(glossary_passed::VARCHAR, '') AS glossary_passed FROM me""",
    "cases",
)
def _(t):
    return scoring.measure_eval(t.cases()).select(
        "case_id", "gated_out", F.coalesce("selected_measure", F.lit("")).alias("selected_measure"), "actual_status",
        "measure_passed", "status_passed", F.coalesce(F.col("glossary_passed").cast("string"), F.lit("")).alias("glossary_passed"),
    )


@query(
    "e7_measure_eval_summary",
    f"""WITH {_EVAL} SELECT count(*) FILTER (WHERE measure_passed) AS measure_passed, count(*) FILTER (WHERE status_passed) AS status_passed,
        count(*) FILTER (WHERE glossary_passed) AS glossary_passed, count(glossary_passed) AS glossary_total, count(*) AS n_total,
        count(*) FILTER (WHERE gated_out) AS refusals_via_gate FROM me""",
    "cases",
)
def _(t):
    return scoring.measure_eval_summary(scoring.measure_eval(t.cases()))


# ---------------------------------------------------------------- retrieval scoring
# Hits are the keyword top 20 of every benchmark item; any of two sources is expected.

_HITS = f"""{_ranked_scores(20)}, hits AS (SELECT query_id, source, rank FROM kr JOIN passages USING (chunk_id)),
   firsts AS (SELECT query_id, source, min(rank) AS f FROM hits GROUP BY 1, 2),
   srcs AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY f) AS rank FROM firsts),
   want AS (SELECT query_id, 'src' || query_id % 20 AS source FROM asked UNION SELECT query_id, 'src' || query_id * 3 % 20 FROM asked),
   found AS (SELECT w.query_id, min(s.rank) AS rank FROM want w LEFT JOIN srcs s ON s.query_id = w.query_id AND s.source = w.source GROUP BY 1)"""


def _sources(t):
    hits = kw.bm25(t.role("asked"), _index(t), 20)
    return scoring.dedupe_sources(hits.join(t.role("passages").select("chunk_id", "source"), "chunk_id"))


def _expected(t):
    n = F.col("query_id")
    both = F.array(F.concat(F.lit("src"), (n % 20).cast("string")), F.concat(F.lit("src"), (n * 3 % 20).cast("string")))
    return t.role("asked").select("query_id", F.explode(both).alias("source"))


@query("e8_distinct_sources", f"WITH {_HITS} SELECT query_id, source, rank::INT AS rank FROM srcs", "passages asked")
def _(t):
    return _sources(t)


@query(
    "e9_retrieval_score",
    f"""WITH {_HITS} SELECT query_id, coalesce(rank, 0)::INT AS rank, rank IS NOT NULL AS hit, round(coalesce(1.0::DOUBLE / rank, 0), 9) AS reciprocal_rank FROM found""",
    "passages asked",
)
def _(t):
    out = scoring.score_retrieval(_sources(t), _expected(t))
    return out.select("query_id", F.coalesce("rank", F.lit(0)).alias("rank"), "hit", F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


@query(
    "e10_retrieval_summary",
    f"WITH {_HITS} SELECT round(avg((rank IS NOT NULL)::INT), 9) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr, count(*) AS n FROM found",
    "passages asked",
)
def _(t):
    out = scoring.retrieval_summary(scoring.score_retrieval(_sources(t), _expected(t)))
    return out.withColumns({"hit_rate": F.round("hit_rate", 9), "mrr": F.round("mrr", 9)})


# ---------------------------------------------------------------- hedge and labels


@query(
    "e11_hedge_match",
    "SELECT case_id, confidence < 0.7 AS predicted_hedge, (confidence < 0.7) = expects_hedge AS hedge_passed FROM cases",
    "cases",
)
def _(t):
    return scoring.score_hedge(t.cases()).select("case_id", "predicted_hedge", "hedge_passed")


_HEDGE = """he AS (SELECT *, revision_count >= 1 OR confidence < 0.7 AS gate_fired, revision_count >= 1 AND confidence >= 0.7 AS recovered FROM cases)"""


@query(
    "e12_hedge_eval",
    f"WITH {_HEDGE} SELECT case_id, gate_fired, recovered, gate_fired = expects_hedge AS hedge_passed FROM he",
    "cases",
)
def _(t):
    return scoring.hedge_eval(t.cases()).select("case_id", "gate_fired", "recovered", "hedge_passed")


@query(
    "e12_hedge_summary",
    f"""WITH {_HEDGE} SELECT count(*) FILTER (WHERE gate_fired = expects_hedge) AS n_passed, count(*) AS n_total,
        count(*) FILTER (WHERE NOT expects_hedge AND NOT gate_fired) AS resolving_pass, count(*) FILTER (WHERE NOT expects_hedge) AS resolving_total,
        count(*) FILTER (WHERE expects_hedge AND gate_fired) AS hedge_pass, count(*) FILTER (WHERE expects_hedge) AS hedge_total,
        count(*) FILTER (WHERE recovered) AS recoveries FROM he""",
    "cases",
)
def _(t):
    return scoring.hedge_summary(scoring.hedge_eval(t.cases()))


_DIMS = f"""{_EVAL}, {_HEDGE}, {_SCORED}, {_HITS}, res AS (SELECT 'routing' AS dimension, expected_route = actual_route AS passed FROM cases
     UNION ALL SELECT 'measure_selection', measure_passed FROM me WHERE category IN ('sql_positive', 'hybrid_positive', 'sql_oos')
     UNION ALL SELECT 'pipeline_status', status_passed FROM me WHERE category IN ('sql_positive', 'hybrid_positive', 'sql_oos')
     UNION ALL SELECT 'glossary', glossary_passed FROM me WHERE glossary_passed IS NOT NULL
     UNION ALL SELECT 'guardrails', case_passed FROM scored
     UNION ALL SELECT 'retrieval', rank IS NOT NULL FROM found
     UNION ALL SELECT 'hedge_calibration', gate_fired = expects_hedge FROM he)"""
_DIM_ROLES = "cases statements passages asked"


def _measured(t):
    return scoring.measure_eval(scoring.select_cases(t.cases(), "sql"))


def _dimensions(t):
    def part(df, name, passed):
        return df.select(F.lit(name).alias("dimension"), F.col(passed).alias("passed"))

    sql = _measured(t)
    return (
        part(_routed(t), "routing", "route_passed")
        .unionByName(part(sql, "measure_selection", "measure_passed"))
        .unionByName(part(sql, "pipeline_status", "status_passed"))
        .unionByName(part(sql.where("glossary_passed is not null"), "glossary", "glossary_passed"))
        .unionByName(part(scoring.score_guardrail(_audited(t)), "guardrails", "case_passed"))
        .unionByName(part(scoring.score_retrieval(_sources(t), _expected(t)), "retrieval", "hit"))
        .unionByName(part(scoring.hedge_eval(t.cases()), "hedge_calibration", "hedge_passed"))
    )


@query(
    "e14_dimension_summary",
    f"WITH {_DIMS} SELECT dimension, count(*) FILTER (WHERE passed) AS n_passed, count(*) AS n_total, round(count(*) FILTER (WHERE passed) / count(*), 9) AS accuracy FROM res GROUP BY 1",
    _DIM_ROLES,
)
def _(t):
    return scoring.summarize(_dimensions(t)).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "e15_select_cases",
    """SELECT case_id, 'sql' AS dimension FROM cases WHERE category IN ('sql_positive', 'hybrid_positive', 'sql_oos')
       UNION ALL SELECT case_id, 'rag' FROM cases WHERE category IN ('rag_positive', 'hybrid_positive', 'rag_oos')
       UNION ALL SELECT case_id, 'hedge' FROM cases WHERE category = 'rag_oos' OR (category = 'rag_positive' AND expected_route = actual_route)
       UNION ALL SELECT case_id, 'retrieval' FROM cases WHERE category IN ('rag_positive', 'hybrid_positive')""",
    "cases",
)
def _(t):
    has_source = F.col("category").isin("rag_positive", "hybrid_positive")
    cases = t.cases().withColumn(
        "expected_sources", F.when(has_source, F.array(F.lit("a.md"))).otherwise(F.array().cast("array<string>"))
    )
    resolving = _routed(t).where("category = 'rag_positive' AND route_passed")
    out = None
    for d in ("sql", "rag", "hedge", "retrieval"):
        one = scoring.select_cases(cases, d, resolving).select("case_id", F.lit(d).alias("dimension"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "e16_label_rules",
    """SELECT case_id, concat_ws(';', CASE WHEN category = 'sql_oos' AND raw_measure IS NOT NULL THEN 'sql_oos must not expect a measure' END,
         CASE WHEN category = 'sql_oos' AND coalesce(expected_status, '') <> 'no_measure_matched' THEN 'sql_oos must expect no_measure_matched' END,
         CASE WHEN category = 'rag_oos' AND confidence > 0.5 THEN 'rag_oos must expect a hedge' END,
         CASE WHEN category IN ('sql_positive', 'hybrid_positive') AND raw_measure IS NULL THEN 'must expect a measure' END,
         CASE WHEN category IN ('rag_positive', 'hybrid_positive') AND case_id % 2 = 1 THEN 'must name an expected source' END) AS errors FROM cases""",
    "cases",
)
def _(t):
    # Labels taken from observed values, so that every rule is broken somewhere.
    cases = t.cases().withColumns(
        {
            "expected_measure": F.col("raw_measure"),
            "expects_hedge": F.col("confidence") <= 0.5,
            "expected_sources": F.when(F.col("case_id") % 2 == 0, F.array(F.lit("a.md"))),
        }
    )
    return scoring.check_labels(cases).select("case_id", F.array_join("label_errors", ";").alias("errors"))


def _pct(p, n):
    return f"{p} || '/' || {n} || ' (' || CAST(round_even(100.0::DOUBLE * {p} / {n}, 0) AS BIGINT) || '%)'"


@query(
    "e17_scorecard",
    f"""WITH {_DIMS}, s AS (SELECT dimension, count(*) FILTER (WHERE passed) AS p, count(*) AS n FROM res GROUP BY 1),
        hs AS (SELECT count(*) FILTER (WHERE NOT expects_hedge AND NOT gate_fired) AS rp, count(*) FILTER (WHERE NOT expects_hedge) AS rn,
               count(*) FILTER (WHERE expects_hedge AND gate_fired) AS hp, count(*) FILTER (WHERE expects_hedge) AS hn FROM he),
        os AS (SELECT count(*) FILTER (WHERE expected_route = actual_route) AS p, count(*) AS n FROM cases WHERE {_OOS})
        SELECT 1 AS line, 'Routing accuracy' AS dimension, {_pct('p', 'n')} AS score, (SELECT 'out-of-scope ' || {_pct('p', 'n')} FROM os) AS notes FROM s WHERE dimension = 'routing'
        UNION ALL SELECT 2, 'Measure selection', {_pct('p', 'n')}, (SELECT count(*) FILTER (WHERE gated_out) || ' refused via confidence gate' FROM me WHERE category IN ('sql_positive', 'hybrid_positive', 'sql_oos')) FROM s WHERE dimension = 'measure_selection'
        UNION ALL SELECT 3, 'Trust boundary (refuse/proceed)', {_pct('p', 'n')}, 'gate threshold 0.5' FROM s WHERE dimension = 'pipeline_status'
        UNION ALL SELECT 4, 'Glossary resolution', {_pct('p', 'n')}, '' FROM s WHERE dimension = 'glossary'
        UNION ALL SELECT 5, 'Guardrail efficacy', {_pct('p', 'n')}, 'every layer isolated' FROM s WHERE dimension = 'guardrails'
        UNION ALL SELECT 6, 'Retrieval hit@20', {_pct('p', 'n')}, (SELECT printf('MRR %.3f', round_even(round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9), 3)) FROM found) FROM s WHERE dimension = 'retrieval'
        UNION ALL SELECT 7, 'Hedge calibration', {_pct('p', 'n')}, (SELECT 'resolving ' || {_pct('rp', 'rn')} || ', hedge ' || {_pct('hp', 'hn')} FROM hs) FROM s WHERE dimension = 'hedge_calibration'""",
    _DIM_ROLES,
)
def _(t):
    probes, found = scoring.score_guardrail(_audited(t)), scoring.score_retrieval(_sources(t), _expected(t))
    return card.scorecard(card.governance_lines(_routed(t), _measured(t), probes, found, scoring.hedge_eval(t.cases()), 20))


@query(
    "e17_misses",
    f"""WITH {_EVAL}, {_HEDGE}, {_SCORED}, {_HITS} SELECT 'routing' AS dimension, case_id::VARCHAR AS case_id, expected_route AS expected, actual_route AS actual FROM cases WHERE expected_route <> actual_route
        UNION ALL SELECT 'measure_selection', case_id::VARCHAR, coalesce(expected_measure, 'None'), coalesce(picked, 'None') FROM me
          WHERE category IN ('sql_positive', 'hybrid_positive', 'sql_oos') AND NOT (measure_passed AND status_passed AND coalesce(glossary_passed, true))
        UNION ALL SELECT 'guardrails', stmt_id::VARCHAR, 'reject@' || target_layer, CASE WHEN passed THEN 'passed' ELSE 'rejected' END FROM scored WHERE NOT case_passed
        UNION ALL SELECT 'retrieval', query_id::VARCHAR, (SELECT string_agg(source, ',' ORDER BY source) FROM want w WHERE w.query_id = found.query_id),
          coalesce((SELECT string_agg(source, ',' ORDER BY s.rank) FROM srcs s WHERE s.query_id = found.query_id), '') FROM found WHERE rank IS NULL
        UNION ALL SELECT 'hedge_calibration', case_id::VARCHAR, 'hedge=' || expects_hedge, 'gate_fired=' || gate_fired FROM he WHERE gate_fired <> expects_hedge""",
    _DIM_ROLES,
)
def _(t):
    # The ranked sources are read three times; at most 20 a question, they are searched for once.
    path = shared_dir(t.spark)
    _sources(t).write.parquet(path)
    hedged, ranked, wanted = scoring.hedge_eval(t.cases()), t.spark.read.parquet(path), _expected(t)
    a = card.misses(_routed(t), "route_passed", "routing", "case_id", F.col("expected_route"), F.col("actual_route"))
    b = card.misses(scoring.score_guardrail(_audited(t)), "case_passed", "guardrails", "stmt_id", F.col("expected"), F.col("actual"))
    c = card.misses(
        hedged, "hedge_passed", "hedge_calibration", "case_id",
        F.concat(F.lit("hedge="), F.col("expects_hedge").cast("string")),
        F.concat(F.lit("gate_fired="), F.col("gate_fired").cast("string")),
    )
    lost = card.retrieval_misses(scoring.score_retrieval(ranked, wanted), ranked, wanted)
    return a.unionByName(b).unionByName(c).unionByName(card.measure_misses(_measured(t))).unionByName(lost)


@query(
    "e18_reliability",
    """SELECT run_group AS case_id, count(*) AS n_runs, round(avg((confidence < 0.7)::INT), 9) AS share_fired, min(confidence) AS min_confidence,
       max(confidence) AS max_confidence, min((confidence < 0.7)::INT) = max((confidence < 0.7)::INT) AS stable FROM cases GROUP BY 1""",
    "cases",
)
def _(t):
    runs = t.cases().drop("case_id").withColumnRenamed("run_group", "case_id").withColumn("fired", F.col("confidence") < 0.7)
    return scoring.reliability(runs).withColumn("share_fired", F.round("share_fired", 9))


@query(
    "s8_result_envelope",
    """SELECT case_id, expected_route, actual_route, expected_route = actual_route AS route_passed,
       (SELECT count(*) FILTER (WHERE expected_route = actual_route) FROM cases) AS passed_in_summary FROM cases""",
    "cases",
)
def _(t):
    root = shared_dir(t.spark)
    routed = _routed(t).select("case_id", "expected_route", "actual_route", "route_passed")
    summary = routed.agg(F.count_if("route_passed").alias("n_passed"), F.count("*").alias("n_total"))
    results.save_results("routing", summary, routed, root)
    back = results.load_results(t.spark, "routing", root, "case_id bigint, expected_route string, actual_route string, route_passed boolean")
    passed = back.summary.select("summary.n_passed").scalar()
    return back.cases.withColumn("passed_in_summary", passed)


@query(
    "s9_eval_cases",
    """SELECT case_id::VARCHAR AS id, category, expected_route, coalesce(expected_measure, '') AS expected_measure, expected_refs AS expected_glossary,
       coalesce(expected_status, '') AS expected_status, expects_hedge FROM cases""",
    "cases",
)
def _(t):
    path = f"{shared_dir(t.spark)}/cases"
    # A hedge that is not expected is left out of the file, as in hand-written cases.
    t.cases().select(
        F.col("case_id").cast("string").alias("id"), "category", "expected_route", "expected_measure", "expected_glossary",
        "expected_status", F.when(F.col("expects_hedge"), True).alias("expects_hedge"),
    ).write.json(path)
    text = {c: F.coalesce(c, F.lit("")) for c in ("expected_measure", "expected_status")}
    back = labelled.load_eval_cases(t.spark, path).withColumns(text | {"expected_glossary": F.array_join("expected_glossary", ",")})
    return back.select("id", "category", "expected_route", "expected_measure", "expected_glossary", "expected_status", "expects_hedge")


@query(
    "s9_adversarial_set",
    "SELECT stmt_id::VARCHAR AS id, md5(sql) AS digest, target_layer AS fails, fragments AS reason_fragments FROM statements",
    "statements",
)
def _(t):
    path = f"{shared_dir(t.spark)}/probes"
    t.role("statements").select(
        F.col("stmt_id").cast("string").alias("id"), "sql", F.col("target_layer").alias("fails"),
        F.split("fragments", r"\|").alias("reason_fragments"),
    ).write.json(path)
    back = labelled.load_adversarial_set(t.spark, path)
    return back.select("id", F.md5("sql").alias("digest"), "fails", F.array_join("reason_fragments", "|").alias("reason_fragments"))
