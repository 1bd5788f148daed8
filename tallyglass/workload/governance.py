"""Resolution of selections, audit of statements, decision gates and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.catalog import MEASURES
from tallyglass.operators import audit, evidence, gates, glossary, profile
from tallyglass.operators.latest import top_per_key
from tallyglass.workload.registry import query

# ---------------------------------------------------------------- glossary resolution

_PARAMS = "params(measure, pos, param, kind, category_, required, default_) AS (VALUES " + ", ".join(
    f"('{m}', {i}, '{p[0]}', '{p[1]}', '{p[2]}', {p[3]}, {'NULL' if p[4] is None else repr(p[4])})"
    for m, ps in MEASURES.items()
    for i, p in enumerate(ps)
) + ")"

_GLOSSARY = f"""{_PARAMS}, asked AS (SELECT *, list_filter(split(refs, ','), lambda r: starts_with(r, category_ || '.')) AS hit,
     CASE category_ WHEN 'time_periods' THEN '[''last_quarter'', ''last_month'', ''this_year'']' ELSE '[''europe'', ''asia'']' END AS valid
     FROM selections JOIN params USING (measure) WHERE kind = 'glossary'),
   glossary_rows AS (SELECT selection_id, pos, param, CASE
       WHEN len(hit) > 1 THEN 'Parameter ''' || param || ''': ambiguous — multiple glossary refs match category ''' || category_ || ''': [''' || array_to_string(hit, ''', ''') || ''']. Supply at most one.'
       WHEN hit[1] = 'time_periods.dataset_reference_date' THEN 'Parameter ''' || param || ''': glossary ref ''' || hit[1] || ''' exists but has no ''sql'' fragment. Valid keys for ''' || category_ || ''': ' || valid
       WHEN len(hit) = 1 AND hit[1] NOT IN ('time_periods.last_quarter', 'time_periods.last_month', 'time_periods.this_year', 'regions.europe', 'regions.asia')
         THEN 'Parameter ''' || param || ''': unknown glossary ref ''' || hit[1] || '''. Valid keys for ''' || category_ || ''': ' || valid END AS error,
       CASE WHEN error IS NULL THEN CASE WHEN len(hit) = 1 THEN split_part(hit[1], '.', 2) ELSE default_ END END AS value FROM asked)"""

_SCALAR = r"""given AS (SELECT *, CASE WHEN param = 'top_n' THEN top_n ELSE category END AS raw FROM selections JOIN params USING (measure) WHERE kind = 'scalar'),
   scalar_rows AS (SELECT selection_id, pos, param, CASE
       WHEN raw IS NOT NULL AND category_ = 'integer' AND NOT regexp_matches(raw, '^\s*[+-]?\d+(_\d+)*\s*$')
         THEN 'Parameter ''' || param || ''': cannot coerce ''' || raw || ''' to integer'
       WHEN raw IS NULL AND required THEN 'Parameter ''' || param || ''': required scalar parameter not found in filters and no default is set.' END AS error,
       CASE WHEN error IS NULL THEN CASE WHEN raw IS NULL THEN default_ WHEN category_ = 'integer' THEN CAST(CAST(replace(trim(raw), '_', '') AS BIGINT) AS VARCHAR) ELSE raw END END AS value FROM given)"""


def _resolved(t):
    return glossary.resolve_selections(t.selections(), t.catalog)


@query(
    "g6_resolve_glossary",
    f"WITH {_GLOSSARY} SELECT selection_id, param, value, error FROM glossary_rows",
    "selections",
)
def _(t):
    return glossary.resolution_rows(_resolved(t), "selection_id").where("param LIKE '%_filter'")


@query(
    "g7_coerce_scalars",
    f"WITH {_PARAMS}, {_SCALAR} SELECT selection_id, param, value, error FROM scalar_rows",
    "selections",
)
def _(t):
    return glossary.resolution_rows(_resolved(t), "selection_id").where("param NOT LIKE '%_filter'")


@query(
    "g8_check_templates",
    r"""SELECT event_id AS measure, array_to_string(list_sort(list_distinct(list_filter(
        regexp_extract_all('SELECT {metric} FROM t WHERE {' || event_type || '} LIMIT {top_n} -- {' || event_type || '} ' || props, '\{(\w+)\}', 1),
        lambda p: p NOT IN ('metric', 'top_n', 'click')))), ',') AS undeclared,
        event_type = 'click' AS ok FROM events""",
)
def _(t):
    templates = t.read("events").select(
        F.col("event_id").alias("measure"),
        F.concat(
            F.lit("SELECT {metric} FROM t WHERE {"), "event_type", F.lit("} LIMIT {top_n} -- {"), "event_type", F.lit("} "), "props"
        ).alias("template"),
        F.array(F.lit("metric"), F.lit("top_n"), F.lit("click")).alias("declared"),
    )
    return glossary.check_templates(templates).withColumn("undeclared", F.array_join("undeclared", ","))


@query(
    "g10_parameters_applied",
    f"""WITH {_GLOSSARY}, {_SCALAR}, all_rows AS (SELECT * FROM glossary_rows UNION ALL SELECT * FROM scalar_rows),
        per AS (SELECT selection_id, string_agg(param || '=' || value, ';' ORDER BY param) AS applied,
                count(error) AS n_err, arg_min(error, pos) FILTER (WHERE error IS NOT NULL) AS first_error FROM all_rows GROUP BY 1)
        SELECT selection_id, CASE WHEN measure = 'profit_by_moon' OR n_err > 0 THEN '-' ELSE coalesce(applied, '') END AS applied,
        CASE WHEN measure = 'profit_by_moon' THEN 'unknown measure profit_by_moon' ELSE coalesce(first_error, '') END AS error
        FROM selections LEFT JOIN per USING (selection_id)""",
    "selections",
)
def _(t):
    entries = F.array_sort(F.transform(F.map_entries("parameters_applied"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return _resolved(t).select(
        "selection_id",
        F.coalesce(F.array_join(entries, ";"), F.lit("-")).alias("applied"),
        F.coalesce("resolution_error", F.lit("")).alias("error"),
    )


# ---------------------------------------------------------------- statement audit

# Fixed values, typed out so that the twins do not share them with the package.
_KNOWN = (
    "'dim_category_translation', 'dim_customers', 'dim_products', 'dim_sellers', "
    "'fact_order_items', 'fact_order_payments', 'fact_order_reviews', 'fact_orders'"
)
_NOTE = (
    "FORBIDDEN for revenue measures. payments has multiple rows per order (installments/split). "
    "Causes fan-out. This is the join the guardrail must reject."
)
_AUDIT = rf"""audit AS (SELECT *,
     list_distinct(list_transform(regexp_extract_all(sql, '(?i)\b(INSERT|UPDATE|DELETE|DROP|CREATE|TRUNCATE|ALTER|GRANT|REVOKE)\b'), lambda w: upper(w))) AS words,
     list_filter(regexp_extract_all(sql, '(?i)\b(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1), lambda x: lower(x) NOT IN ({_KNOWN})) AS strangers,
     contains(upper(sql), 'FACT_ORDER_ITEMS') AND contains(upper(sql), 'FACT_ORDER_PAYMENTS') AS fanned,
     regexp_extract(sql, '(?i)\bLIMIT\s+(\d+)', 1) AS lim FROM statements),
   verdicts AS (SELECT *, len(words) = 0 AS is_read_only, len(strangers) = 0 AS schema_valid, NOT fanned AS joins_safe,
     lim <> '' AND CAST(nullif(lim, '') AS BIGINT) <= max_rows AS row_limit_enforced0 FROM audit),
   audited AS (SELECT * EXCLUDE (row_limit_enforced0), coalesce(row_limit_enforced0, false) AS row_limit_enforced,
     is_read_only AND schema_valid AND joins_safe AND coalesce(row_limit_enforced0, false) AS passed,
     concat_ws('~',
       CASE WHEN len(words) > 0 THEN 'Write operation not allowed: ' || array_to_string(list_sort(words), ', ') END,
       CASE WHEN len(strangers) > 0 THEN array_to_string(list_transform(strangers, lambda x: 'Unknown table referenced: ''' || x || ''''), '~') END,
       CASE WHEN fanned THEN 'Forbidden join detected: fact_order_items -> fact_order_payments. {_NOTE}' END,
       CASE WHEN lim = '' THEN 'No LIMIT clause found. All queries must be row-limited.'
            WHEN CAST(lim AS BIGINT) > max_rows THEN 'LIMIT ' || CAST(lim AS BIGINT) || ' exceeds max_rows=' || max_rows || '.' END) AS messages
     FROM verdicts)"""


def _audited(t):
    log = t.role("statements").withColumn("reason_fragments", F.split("fragments", r"\|"))
    return audit.audit_sql(log, t.catalog, "sql", "max_rows")


@query(
    "q1_read_only",
    rf"WITH {_AUDIT} SELECT stmt_id, array_to_string(list_sort(words), ',') AS words, is_read_only FROM audited",
    "statements",
)
def _(t):
    msg = F.get(audit.read_only_violations("sql"), F.lit(0))
    words = F.array_sort(F.split(F.regexp_replace(msg, "^Write operation not allowed: ", ""), ", "))
    return t.role("statements").select(
        "stmt_id", F.coalesce(F.array_join(words, ","), F.lit("")).alias("words"), msg.isNull().alias("is_read_only")
    )


@query(
    "q2_table_allow_list",
    rf"WITH {_AUDIT} SELECT stmt_id, array_to_string(list_transform(strangers, lambda x: 'Unknown table referenced: ''' || x || ''''), '~') AS messages FROM audited",
    "statements",
)
def _(t):
    bad = audit.schema_violations("sql", t.catalog.known_tables())
    return t.role("statements").select("stmt_id", F.array_join(bad, "~").alias("messages"))


@query("q3_forbidden_join", rf"WITH {_AUDIT} SELECT stmt_id, joins_safe FROM audited", "statements")
def _(t):
    bad = audit.join_violations("sql", t.catalog.unsafe_joins())
    return t.role("statements").select("stmt_id", (F.size(bad) == 0).alias("joins_safe"))


@query(
    "q4_row_limit",
    rf"""WITH {_AUDIT} SELECT stmt_id, CASE WHEN lim = '' THEN 'No LIMIT clause found. All queries must be row-limited.'
         WHEN CAST(lim AS BIGINT) > max_rows THEN 'LIMIT ' || CAST(lim AS BIGINT) || ' exceeds max_rows=' || max_rows || '.' ELSE '' END AS message FROM audited""",
    "statements",
)
def _(t):
    bad = audit.limit_violations("sql", "max_rows")
    return t.role("statements").select("stmt_id", F.array_join(bad, "~").alias("message"))


@query(
    "q5_audit_sql",
    rf"""WITH {_AUDIT} SELECT stmt_id, passed, is_read_only, schema_valid, joins_safe, row_limit_enforced, messages FROM audited""",
    "statements",
)
def _(t):
    # SQL's list of distinct words has no order, so both sides sort the words of the first message.
    head = "Write operation not allowed: "
    told = F.transform(
        "violations",
        lambda m: F.when(
            F.startswith(m, F.lit(head)),
            F.concat(F.lit(head), F.array_join(F.array_sort(F.split(F.replace(m, F.lit(head), F.lit("")), F.lit(", "))), ", ")),
        ).otherwise(m),
    )
    return _audited(t).select("stmt_id", "passed", *audit.LAYERS, F.array_join(told, "~").alias("messages"))


_SCORED = rf"""{_AUDIT}, scored AS (SELECT *,
     NOT passed
     AND CASE target_layer WHEN 'is_read_only' THEN NOT is_read_only AND schema_valid AND joins_safe AND row_limit_enforced
          WHEN 'schema_valid' THEN is_read_only AND NOT schema_valid AND joins_safe AND row_limit_enforced
          WHEN 'joins_safe' THEN is_read_only AND schema_valid AND NOT joins_safe AND row_limit_enforced
          ELSE is_read_only AND schema_valid AND joins_safe AND NOT row_limit_enforced END
     AND len(list_filter(split(fragments, '|'), lambda f: NOT contains(
           replace(messages, '~', ' '), f))) = 0 AS case_passed
   FROM audited)"""


@query(
    "q6_catch_rate_by_layer",
    rf"WITH {_SCORED} SELECT target_layer, count(*) FILTER (WHERE case_passed) AS n_passed, count(*) AS n_total FROM scored GROUP BY 1",
    "statements",
)
def _(t):
    from tallyglass.operators.scoring import score_guardrail

    return audit.by_layer(score_guardrail(_audited(t)))


@query(
    "e13_guardrail_isolation",
    rf"WITH {_SCORED} SELECT stmt_id, case_passed, 'reject@' || target_layer AS expected, CASE WHEN passed THEN 'passed' ELSE 'rejected' END AS actual FROM scored",
    "statements",
)
def _(t):
    from tallyglass.operators.scoring import score_guardrail

    return score_guardrail(_audited(t)).select("stmt_id", "case_passed", "expected", "actual")


@query(
    "q7_capped_result",
    """SELECT 'customer_state,n' AS columns, count(*) AS row_count, 1000 AS max_rows
       FROM (SELECT customer_state, count(*) AS n FROM customers GROUP BY 1 LIMIT 1000)""",
    "customers",
)
def _(t):
    return audit.result_summary(t.role("customers").groupBy("customer_state").agg(F.count("*").alias("n")))


@query(
    "q7_result_rows",
    """SELECT '{"customer_state":"' || customer_state || '","n":' || count(*) || '}' AS row_json FROM customers GROUP BY customer_state""",
    "customers",
)
def _(t):
    return audit.execute_capped(t.role("customers").groupBy("customer_state").agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- decisions

_OUT_OK = """parsed AS (SELECT output_id, k, output_id % 5 AS m, CASE k % 13 WHEN 0 THEN 1.5 ELSE k / 100 END AS conf,
     k % 17 <> 0 AND k % 9 <> 0 AND k % 13 <> 0 AND k % 5 <> 4 AS ok FROM outputs)"""
_NAMES = "['top_categories_by_revenue', 'aov_by_state', 'seller_ratings_by_state', 'return_rate_by_category', 'profit_by_moon']"


@query(
    "d1_parse_selections",
    f"""WITH {_OUT_OK} SELECT output_id, ok AS accepted, CASE WHEN ok THEN {_NAMES}[k % 5 + 1] ELSE '' END AS measure,
        CASE WHEN ok THEN conf ELSE -1 END::DOUBLE AS confidence, CASE WHEN ok THEN k::VARCHAR ELSE '' END AS top_n,
        CASE WHEN ok THEN 'time_periods.last_month' ELSE '' END AS refs FROM parsed""",
    "outputs",
)
def _(t):
    s = F.col("selection")
    return gates.parse_selections(t.role("outputs"), "output").select(
        "output_id",
        s.isNotNull().alias("accepted"),
        F.coalesce(s["measure"], F.lit("")).alias("measure"),
        F.coalesce(s["confidence"], F.lit(-1.0)).alias("confidence"),
        F.coalesce(s["filters"]["top_n"], F.lit("")).alias("top_n"),
        F.coalesce(F.array_join(s["glossary_refs"], ","), F.lit("")).alias("refs"),
    )


_GATED = """gated AS (SELECT *, coalesce(raw_measure IS NOT NULL AND raw_confidence < 0.5, false) AS gated_out,
     CASE WHEN raw_measure IS NOT NULL AND raw_confidence >= 0.5 THEN raw_measure END AS accepted FROM cases)"""


@query(
    "d2_measure_gate",
    f"""WITH {_GATED} SELECT case_id, gated_out, coalesce(accepted, '') AS accepted_measure,
        CASE WHEN gated_out THEN raw_measure ELSE '' END AS rejected_measure,
        CASE WHEN raw_measure IS NULL THEN 'The model could not select a declared measure for this question.'
             WHEN gated_out THEN 'Closest measure ''' || raw_measure || ''' was selected at confidence ' || format('{{:.2f}}', raw_confidence)
               || ', below the 0.5 threshold. The question likely falls outside the governed measures.' ELSE '' END AS failure_reason FROM gated""",
    "cases",
)
def _(t):
    out = gates.gate_measure(t.role("cases"), "raw_measure", "raw_confidence")
    return out.select("case_id", "gated_out", *[F.coalesce(c, F.lit("")).alias(c) for c in ("accepted_measure", "rejected_measure", "failure_reason")])


@query(
    "d3_status_ladder",
    f"""WITH {_GATED}, {_AUDIT}, {_GLOSSARY}, {_SCALAR},
        bad AS (SELECT DISTINCT selection_id FROM (SELECT * FROM glossary_rows UNION ALL SELECT * FROM scalar_rows) WHERE error IS NOT NULL
                UNION SELECT selection_id FROM selections WHERE measure = 'profit_by_moon')
        SELECT case_id, CASE WHEN accepted IS NULL THEN 'no_measure_matched' WHEN b.selection_id IS NOT NULL THEN 'resolution_failed'
          WHEN NOT passed THEN 'guardrail_violation' WHEN case_id % 50 = 7 THEN 'execution_failed' ELSE 'success' END AS status
        FROM gated LEFT JOIN bad b ON b.selection_id = case_id JOIN audited ON stmt_id = case_id""",
    "cases statements selections",
)
def _(t):
    gated = gates.gate_measure(t.role("cases"), "raw_measure", "raw_confidence").select("case_id", "accepted_measure")
    resolved = _resolved(t).select(F.col("selection_id").alias("case_id"), "resolution_error")
    checked = _audited(t).select(F.col("stmt_id").alias("case_id"), "passed")
    failed = F.when(F.col("case_id") % 50 == 7, "connection lost")
    joined = gated.join(resolved, "case_id", "left").join(checked, "case_id")
    return joined.select("case_id", gates.status_ladder("accepted_measure", "resolution_error", "passed", failed).alias("status"))


_REVIEWED = "case_id % 3 <> 0 AS grounded, CASE WHEN case_id % 4 <> 0 THEN 'again ' || case_id END AS revised_query"


@query(
    "d4_review_gate",
    f"""SELECT case_id, CASE WHEN grounded AND confidence >= 0.7 THEN 'end' WHEN revision_count >= 1 THEN 'end'
        WHEN revised_query IS NULL THEN 'end' ELSE 'revise' END AS decision FROM (SELECT *, {_REVIEWED} FROM cases)""",
    "cases",
)
def _(t):
    n = F.col("case_id")
    cases = t.role("cases").withColumns(
        {"grounded": n % 3 != 0, "revised_query": F.when(n % 4 != 0, F.concat(F.lit("again "), n.cast("string")))}
    )
    return cases.select("case_id", gates.review_decision("grounded", "confidence", "revision_count", "revised_query").alias("decision"))


@query(
    "d5_route_dispatch",
    """SELECT case_id, CASE WHEN case_id % 9 = 0 OR case_id % 9 = 1 THEN 'hybrid' ELSE actual_route END AS effective_route,
       effective_route IN ('sql', 'hybrid') AS use_sql, effective_route IN ('rag', 'hybrid') AS use_rag FROM cases""",
    "cases",
)
def _(t):
    q = t.role("cases").withColumn(
        "route", F.when(F.col("case_id") % 9 == 0, None).when(F.col("case_id") % 9 == 1, "").otherwise(F.col("actual_route"))
    )
    return gates.apply_route(q).select("case_id", "effective_route", "use_sql", "use_rag")


@query(
    "d10_confidence_band",
    """SELECT case_id, CASE WHEN confidence >= 0.85 THEN 'green' WHEN confidence >= 0.7 THEN 'orange' ELSE 'red' END AS band,
       CASE WHEN revision_count + case_id % 3 = 1 THEN 'Self-corrected once' WHEN revision_count + case_id % 3 > 1
       THEN 'Revised ×' || (revision_count + case_id % 3) ELSE '' END AS label FROM cases""",
    "cases",
)
def _(t):
    n = F.col("revision_count") + F.col("case_id") % 3
    return t.role("cases").select(
        "case_id", gates.confidence_band("confidence").alias("band"), F.coalesce(gates.revision_label(n), F.lit("")).alias("label")
    )


@query(
    "d11_result_profile",
    """SELECT 0 AS position, 'customer_city' AS column_name, 'categorical' AS kind, count(DISTINCT customer_city) AS n_distinct, 'bar' AS chart FROM customers
       UNION ALL SELECT 1, 'n_customers', 'numeric', -1, 'bar'""",
    "customers",
)
def _(t):
    result = t.role("customers").groupBy("customer_city").agg(F.count("*").alias("n_customers"))
    return profile.profile_result(result).withColumn("n_distinct", F.coalesce("n_distinct", F.lit(-1)))


@query(
    "d11_time_series_profile",
    """SELECT 0 AS position, 'order_date' AS column_name, 'datetime' AS kind, count(DISTINCT order_purchase_timestamp) AS n_distinct, 'line' AS chart FROM purchases
       UNION ALL SELECT 1, 'revenue', 'numeric', -1, 'line'""",
    "purchases",
)
def _(t):
    result = t.role("purchases").groupBy(F.col("order_purchase_timestamp").alias("order_date")).agg(F.sum("order_total").alias("revenue"))
    return profile.profile_result(result).withColumn("n_distinct", F.coalesce("n_distinct", F.lit(-1)))


# ---------------------------------------------------------------- evidence
# A question per order: its lines are the result rows, the reviews of its number the passages.

_SQL_SIDE = """res AS (SELECT order_id AS question_id, 'order_lines' AS measure,
      CASE order_status WHEN 'P' THEN 'execution_failed' ELSE 'success' END AS status,
      CASE order_status WHEN 'P' THEN CASE WHEN order_id % 2 = 0 THEN 'timeout' END END AS failure_reason,
      'product | price' AS header FROM purchases),
    numbered AS (SELECT order_id AS question_id, row_number() OVER (PARTITION BY order_id ORDER BY order_item_id, product_id, seller_id, price) AS row_no,
      product_id || ' | ' || CAST(floor(price) AS BIGINT) AS line FROM items),
    lines AS (SELECT question_id, string_agg(line, chr(10) ORDER BY row_no) AS lines, count(*) AS n FROM numbered WHERE row_no <= 1000 GROUP BY 1)"""
_HITS = """hits AS (SELECT user_id * 7 AS question_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank,
      event_type || '.md' AS source, 'k ' || regexp_extract(props, '([0-9]+)', 1) AS section, 'Event ' || event_id AS content FROM events),
    passages AS (SELECT question_id, string_agg(chr(10) || '[' || rank || '] source: ' || source || ' | section: ' || section || chr(10) || content, chr(10) ORDER BY rank) AS passages,
      list(source ORDER BY rank) AS sources FROM hits WHERE rank <= 5 GROUP BY 1)"""


def _evidence(t):
    orders = t.role("purchases")
    failed = F.col("order_status") == "P"
    results = orders.select(
        F.col("order_id").alias("question_id"),
        F.lit("order_lines").alias("measure"),
        F.when(failed, "execution_failed").otherwise("success").alias("status"),
        F.when(failed & (F.col("order_id") % 2 == 0), "timeout").alias("failure_reason"),
        F.lit("product | price").alias("header"),
        F.when(failed, F.array(F.concat(F.lit("sql: "), F.col("order_id").cast("string")))).alias("errors"),
    )
    rows = top_per_key(t.role("items"), ["order_id"], ["order_item_id", "product_id", "seller_id", "price"], 1000, "row_no").select(
        F.col("order_id").alias("question_id"),
        "row_no",
        F.concat_ws(" | ", F.col("product_id").cast("string"), F.floor("price").cast("string")).alias("line"),
    )
    hits = top_per_key(t.read("events"), ["user_id"], ["ts", "event_id"], 5).select(
        (F.col("user_id") * 7).alias("question_id"),
        "rank",
        F.concat("event_type", F.lit(".md")).alias("source"),
        F.concat(F.lit("k "), F.regexp_extract("props", "([0-9]+)", 1)).alias("section"),
        F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("content"),
    )
    passages = evidence.passage_evidence(hits).withColumn(
        "errors", F.when(F.col("question_id") % 5 == 0, F.array(F.lit("rag: partial")))
    )
    return evidence.merge_evidence(evidence.sql_evidence(results, rows), passages)


@query(
    "d7_merge_evidence",
    f"""WITH {_SQL_SIDE}, {_HITS} SELECT question_id, coalesce(status, '-') AS status, coalesce(n, 0)::INT AS n_lines,
        coalesce(len(sources), 0)::INT AS n_passages,
        concat_ws(';', CASE WHEN status = 'execution_failed' THEN 'sql: ' || question_id END,
                  CASE WHEN sources IS NOT NULL AND question_id % 5 = 0 THEN 'rag: partial' END) AS errors
        FROM res LEFT JOIN lines USING (question_id) FULL JOIN passages USING (question_id)""",
    "purchases items",
)
def _(t):
    return _evidence(t).select(
        "question_id",
        F.coalesce("status", F.lit("-")).alias("status"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("passages"), F.lit(0)).alias("n_passages"),
        F.array_join("errors", ";").alias("errors"),
    )


@query(
    "d8_collect_sources",
    f"""WITH {_SQL_SIDE}, {_HITS}, spread AS (SELECT question_id, s, i FROM (SELECT question_id, unnest(sources) AS s, generate_subscripts(sources, 1) AS i FROM passages)),
        uniq AS (SELECT question_id, string_agg(s, ',' ORDER BY i) AS srcs FROM (SELECT question_id, s, min(i) AS i FROM spread GROUP BY 1, 2) GROUP BY 1)
        SELECT question_id, concat_ws(',', CASE WHEN status = 'success' THEN measure END, srcs) AS sources_used,
        coalesce(status = 'success' AND n > 0, false) AS has_sql, srcs IS NOT NULL AS has_rag
        FROM res LEFT JOIN lines USING (question_id) FULL JOIN uniq USING (question_id)""",
    "purchases items",
)
def _(t):
    out = evidence.collect_sources(_evidence(t))
    return out.select("question_id", F.array_join("sources_used", ",").alias("sources_used"), "has_sql", "has_rag")


@query(
    "d9_render_context",
    f"""WITH {_SQL_SIDE}, {_HITS} SELECT question_id, CASE
          WHEN status IS NULL THEN 'SQL result: none (no database query was run for this question).'
          WHEN status = 'success' THEN 'SQL result from the order_lines measure (' || coalesce(n, 0) || ' rows):' || chr(10) || concat_ws(chr(10), header, lines)
          ELSE 'SQL result: could not be computed (status=' || status || '). Reason: ' || coalesce(failure_reason, 'unknown error') END
        || chr(10) || chr(10) || CASE WHEN passages IS NULL THEN 'Document excerpts: none retrieved.'
          ELSE 'Document excerpts (most relevant first):' || chr(10) || passages END AS context
        FROM res LEFT JOIN lines USING (question_id) FULL JOIN passages USING (question_id)""",
    "purchases items",
)
def _(t):
    return evidence.render_context(_evidence(t)).select("question_id", "context")


@query(
    "d12_grounding_audit",
    r"""WITH a AS (SELECT event_id, 'The ' || event_type || ' event reached ' || CAST(floor(value) AS BIGINT) || ' reais, about ' || (user_id * 1000 + 5) || ' in error.' AS answer,
          event_type || ' event of user ' || user_id || ' worth ' || CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END || ', reference ' || (user_id * 1000 + CASE WHEN event_id % 3 = 0 THEN 5 ELSE 6 END) AS evidence FROM events),
        n AS (SELECT *, list_filter(list_distinct(regexp_extract_all(answer, '[0-9]+')), lambda x: NOT list_contains(regexp_extract_all(evidence, '[0-9]+'), x)) AS nums,
          list_filter(['click', 'view', 'error'], lambda w: regexp_matches(answer, '\b' || w || '\b') AND NOT regexp_matches(evidence, '\b' || w || '\b')) AS toks FROM a)
        SELECT event_id, array_to_string(list_sort(nums), ',') AS numbers, array_to_string(list_sort(toks), ',') AS tokens, len(nums) = 0 AND len(toks) = 0 AS grounded FROM n""",
)
def _(t):
    worth = F.floor("value").cast("string")
    df = t.read("events").select(
        "event_id",
        F.concat(
            F.lit("The "), "event_type", F.lit(" event reached "), worth, F.lit(" reais, about "),
            (F.col("user_id") * 1000 + 5).cast("string"), F.lit(" in error."),
        ).alias("answer"),
        F.concat(
            "event_type", F.lit(" event of user "), F.col("user_id").cast("string"), F.lit(" worth "),
            F.when(F.col("event_id") % 2 == 0, worth).otherwise("0"), F.lit(", reference "),
            (F.col("user_id") * 1000 + F.when(F.col("event_id") % 3 == 0, 5).otherwise(6)).cast("string"),
        ).alias("evidence"),
        F.array(F.lit("click"), F.lit("view"), F.lit("error")).alias("names"),
    )
    out = evidence.grounding_audit(df, "answer", "evidence", "names")
    return out.select(
        "event_id",
        F.array_join(F.array_sort("ungrounded_numbers"), ",").alias("numbers"),
        F.array_join(F.array_sort("ungrounded_tokens"), ",").alias("tokens"),
        "grounded",
    )
