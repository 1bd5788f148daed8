"""Safety audit of logged SQL statements.

Four independent text rules over a table of statements. All are row-local column expressions: one
narrow pass over the log, no shuffle, and the same code runs on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.catalog import MAX_ROWS, Catalog

# Keywords that make a statement a write.
WRITE_KEYWORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "TRUNCATE", "ALTER", "GRANT", "REVOKE",
)
LAYERS = ("is_read_only", "schema_valid", "joins_safe", "row_limit_enforced")

_WRITE = r"(?iU)\b(" + "|".join(WRITE_KEYWORDS) + r")\b"
_TABLE = r"(?iU)\b(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
_LIMIT = r"(?iU)\bLIMIT\s+(\d+)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _none() -> Column:
    return F.array().cast("array<string>")


def read_only_violations(sql: Column | str) -> Column:
    """One message naming the distinct write keywords, in order of appearance."""
    words = F.array_distinct(
        F.transform(F.regexp_extract_all(_col(sql), F.lit(_WRITE), F.lit(1)), lambda w: F.upper(w))
    )
    msg = F.concat(F.lit("Write operation not allowed: "), F.array_join(words, ", "))
    return F.when(F.size(words) > 0, F.array(msg)).otherwise(_none())


def referenced_tables(sql: Column | str) -> Column:
    return F.regexp_extract_all(_col(sql), F.lit(_TABLE), F.lit(1))


def schema_violations(sql: Column | str, allowed: list[str]) -> Column:
    """One message per mention of a table that is not declared."""
    known = [t.lower() for t in allowed]
    unknown = F.filter(referenced_tables(sql), lambda t: ~F.lower(t).isin(*known))
    return F.transform(
        unknown, lambda t: F.concat(F.lit("Unknown table referenced: '"), t, F.lit("'"))
    )


def join_violations(sql: Column | str, unsafe: list[tuple[str, str, str]]) -> Column:
    """One message per forbidden pair whose two names both occur in the text."""
    text = F.upper(_col(sql))
    if not unsafe:
        return _none()
    hits = [
        F.when(
            F.contains(text, F.lit(a.upper())) & F.contains(text, F.lit(b.upper())),
            F.lit(f"Forbidden join detected: {a} -> {b}. {note}"),
        )
        for a, b, note in unsafe
    ]
    return F.filter(F.array(*hits), lambda m: m.isNotNull())


def limit_violations(sql: Column | str, max_rows: Column | str) -> Column:
    """The first LIMIT must exist and stay within ``max_rows``."""
    digits = F.regexp_extract(_col(sql), _LIMIT, 1)
    shown = F.regexp_replace(digits, r"^0+(?=\d)", "")
    too_big = (F.length(shown) > 18) | (shown.try_cast("bigint") > _col(max_rows))
    return (
        F.when(digits == "", F.array(F.lit("No LIMIT clause found. All queries must be row-limited.")))
        .when(
            too_big,
            F.array(
                F.concat(
                    F.lit("LIMIT "), shown, F.lit(" exceeds max_rows="), _col(max_rows).cast("string"), F.lit(".")
                )
            ),
        )
        .otherwise(_none())
    )


def audit_sql(
    df: DataFrame, catalog: Catalog, sql: str = "sql", max_rows: Column | str | None = None
) -> DataFrame:
    """All four rules, none cut short: four booleans, ``passed`` and the joined list of messages."""
    cap = F.lit(MAX_ROWS) if max_rows is None else max_rows
    layers = {
        "is_read_only": read_only_violations(sql),
        "schema_valid": schema_violations(sql, catalog.known_tables()),
        "joins_safe": join_violations(sql, catalog.unsafe_joins()),
        "row_limit_enforced": limit_violations(sql, cap),
    }
    out = df.withColumns({f"_v_{k}": v for k, v in layers.items()})
    out = out.withColumns({k: F.size(f"_v_{k}") == 0 for k in LAYERS})
    out = out.withColumns(
        {
            "passed": F.col(LAYERS[0]) & F.col(LAYERS[1]) & F.col(LAYERS[2]) & F.col(LAYERS[3]),
            "violations": F.concat(*[F.col(f"_v_{k}") for k in LAYERS]),
        }
    )
    return out.drop(*[f"_v_{k}" for k in LAYERS])


def by_layer(scored: DataFrame, layer: str = "target_layer", passed: str = "case_passed") -> DataFrame:
    """Catch count per targeted layer."""
    return scored.groupBy(layer).agg(F.count_if(passed).alias("n_passed"), F.count("*").alias("n_total"))


def execute_capped(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The first ``max_rows`` rows as JSON text: what a caller of a governed query may receive."""
    return df.limit(max_rows).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row_json"))


def result_summary(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Column names and number of delivered rows under the cap."""
    return df.limit(max_rows).agg(
        F.lit(",".join(df.columns)).alias("columns"),
        F.count("*").alias("row_count"),
        F.lit(max_rows).alias("max_rows"),
    )
