"""Glossary terms as filters, and resolution of whole tables of measure selections."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyglass.catalog import DEFAULT_TOP_N, Catalog
from tallyglass.operators.quantile import below_median, top_quartile


@dataclass(frozen=True)
class TimeWindow:
    start: dt.date
    end: dt.date
    closed: bool  # True: end belongs to the window


def time_window(name: str, ref: dt.date) -> TimeWindow:
    """Bounds of a relative period against a fixed reference date.

    ``last_quarter`` and ``last_month`` are the previous full calendar quarter and month, half open;
    ``this_year`` runs from 1 January to the reference date, closed.
    """
    month = ref.replace(day=1)
    if name == "last_month":
        start = (month - dt.timedelta(days=1)).replace(day=1)
        return TimeWindow(start, month, False)
    if name == "last_quarter":
        end = month.replace(month=ref.month - (ref.month - 1) % 3)
        prev = end - dt.timedelta(days=1)
        return TimeWindow(prev.replace(day=1, month=prev.month - 2), end, False)
    if name == "this_year":
        return TimeWindow(ref.replace(month=1, day=1), ref, True)
    raise ValueError(f"unknown period: {name!r}")


def filter_window(df: DataFrame, col: str, window: TimeWindow, whole_last_day: bool = False) -> DataFrame:
    """Rows of ``col`` inside ``window``.

    Bounds are literals of the column's own type, so the filter reaches the Parquet scan. Text stamps
    compare as text. The closed end is the start of that day; ``whole_last_day`` takes in all of it.
    """
    kind = df.schema[col].dataType
    end, closed = window.end, window.closed
    if closed and whole_last_day:
        end, closed = end + dt.timedelta(days=1), False

    def bound(d: dt.date) -> Column:
        return F.lit(d.isoformat()).cast(kind)

    c = F.col(col)
    return df.where((c >= bound(window.start)) & ((c <= bound(end)) if closed else (c < bound(end))))


def window_cells(col: Column, kind, windows: dict[str, TimeWindow]) -> tuple[Column, Column]:
    """The cell of a stamp, and the names of the windows that hold a cell.

    The bounds of all windows cut time into cells, numbered from 0. Facts that are summed per cell answer every window in
    one pass, however many of them overlap. A null stamp has cell -1. Returns the cell of ``col`` (a column of type
    ``kind``) and an array column over a column called ``cell``: the names of its windows and "" for no window at all.
    """
    edges = sorted({(w.start, False) for w in windows.values()} | {(w.end, w.closed) for w in windows.values()})
    passed = F.lit(0)
    for day, closed in edges:
        bound = F.lit(day.isoformat()).cast(kind)
        passed = passed + ((col > bound) if closed else (col >= bound)).cast("int")
    at = {edge: n + 1 for n, edge in enumerate(edges)}
    held = [
        F.when(F.col("cell").between(at[w.start, False], at[w.end, w.closed] - 1), F.lit(name)) for name, w in windows.items()
    ]
    return F.coalesce(passed, F.lit(-1)), F.array_compact(F.array(F.lit(""), *held))


def filter_region(df: DataFrame, col: str, states: list[str]) -> DataFrame:
    return df.where(F.col(col).isin(*states))


def default_top_n(n: Column | str, default: int = DEFAULT_TOP_N) -> Column:
    return F.coalesce(F.col(n) if isinstance(n, str) else n, F.lit(default))


def underperforming(df: DataFrame, metric: str) -> DataFrame:
    return below_median(df, metric)


def high(df: DataFrame, metric: str) -> DataFrame:
    return top_quartile(df, metric)


# ---------------------------------------------------------------- resolution of selections


def _py_list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _resolve_ref(p: Column, refs: Column, catalog: Catalog) -> Column:
    """(value, error) of one glossary parameter."""
    matches = F.filter(refs, lambda r: F.startswith(r, F.concat(p["category"], F.lit("."))))
    ref = F.element_at(matches, 1)
    known = [f"{ns}.{k}" for ns, keys in catalog.glossary_keys().items() for k in keys]
    bare = [f"{ns}.{k}" for ns, keys in catalog.metadata_keys().items() for k in keys]
    valid = F.lit("[]")
    for ns, keys in catalog.glossary_keys().items():
        valid = F.when(p["category"] == ns, F.lit(_py_list(keys))).otherwise(valid)
    head = F.concat(F.lit("Parameter '"), p["name"], F.lit("': "))

    error = (
        F.when(
            F.size(matches) > 1,
            F.concat(
                head,
                F.lit("ambiguous — multiple glossary refs match category '"),
                p["category"],
                F.lit("': ['"),
                F.array_join(matches, "', '"),
                F.lit("']. Supply at most one."),
            ),
        )
        .when(
            (F.size(matches) == 1) & ref.isin(*bare),
            F.concat(
                head, F.lit("glossary ref '"), ref, F.lit("' exists but has no 'sql' fragment. Valid keys for '"),
                p["category"], F.lit("': "), valid,
            ),
        )
        .when(
            (F.size(matches) == 1) & ~ref.isin(*known),
            F.concat(
                head, F.lit("unknown glossary ref '"), ref, F.lit("'. Valid keys for '"),
                p["category"], F.lit("': "), valid,
            ),
        )
        .when(
            (F.size(matches) == 0) & p["required"],
            F.concat(
                head, F.lit("required glossary ref for category '"), p["category"],
                F.lit("' not provided and no default is set."),
            ),
        )
    )
    key = F.substring_index(ref, ".", -1)
    value = F.when(error.isNull(), F.when(F.size(matches) == 1, key).otherwise(p["default"]))
    return F.struct(p["name"].alias("param"), value.alias("value"), error.alias("error"))


def coerce_scalar(raw: Column, kind: Column) -> Column:
    """Text form of ``raw`` read as a declared type; null when it cannot be read."""
    whole = F.when(F.rlike(raw, F.lit(r"^\s*[+-]?\d+(_\d+)*\s*$")), F.translate(raw, "_", "").try_cast("bigint"))
    return (
        F.when(kind == "integer", whole.cast("string"))
        .when(kind == "float", raw.try_cast("double").cast("string"))
        .when(kind == "boolean", F.initcap(F.lower(raw).isin("true", "1", "yes").cast("string")))
        .when(kind.isin("string", "date"), raw)
    )


def _resolve_scalar(p: Column, filters: Column) -> Column:
    """(value, error) of one scalar parameter. Defaults are taken as declared."""
    raw = F.try_element_at(filters, p["name"])
    given = F.map_contains_key(filters, p["name"])
    kinds = ["boolean", "date", "float", "integer", "string"]
    value = coerce_scalar(raw, p["category"])
    head = F.concat(F.lit("Parameter '"), p["name"], F.lit("': "))
    error = (
        F.when(
            ~p["category"].isin(*kinds),
            F.concat(head, F.lit("unknown scalar type '"), p["category"], F.lit(f"'. Valid types: {_py_list(kinds)}")),
        )
        .when(given & value.isNull(), F.concat(head, F.lit("cannot coerce '"), raw, F.lit("' to "), p["category"]))
        .when(
            ~given & p["required"],
            F.concat(head, F.lit("required scalar parameter not found in filters and no default is set.")),
        )
    )
    picked = F.when(error.isNull(), F.when(given, value).otherwise(p["default"]))
    return F.struct(p["name"].alias("param"), picked.alias("value"), error.alias("error"))


def resolve_selections(selections: DataFrame, catalog: Catalog) -> DataFrame:
    """Resolve the declared parameters of every selection.

    ``selections`` has ``measure``, ``glossary_refs`` (array) and ``filters`` (map) next to its own
    columns. Adds ``resolved`` (array of param, value, error), ``parameters_applied`` (map, null on
    error) and ``resolution_error`` (first error in declared order). Only declared parameters are
    read: other refs and filters are ignored. The measure table has one row per measure of the catalog
    object and is broadcast; everything else is row-local, nothing is exploded or shuffled.
    """
    table = catalog.measure_table(selections.sparkSession)
    df = selections.join(F.broadcast(table), "measure", "left")
    refs = F.coalesce(F.col("glossary_refs"), F.array().cast("array<string>"))
    filters = F.coalesce(F.col("filters"), F.create_map().cast("map<string,string>"))
    df = df.withColumn(
        "resolved",
        F.transform(
            "params",
            lambda p: F.when(p["kind"] == "glossary", _resolve_ref(p, refs, catalog)).otherwise(
                _resolve_scalar(p, filters)
            ),
        ),
    ).drop("params")
    errors = F.filter("resolved", lambda r: r["error"].isNotNull())
    df = df.withColumn(
        "resolution_error",
        F.when(F.col("resolved").isNull(), F.concat(F.lit("unknown measure "), F.col("measure")))
        .when(F.size(errors) > 0, F.get(errors, F.lit(0))["error"]),
    )
    applied = F.map_from_entries(F.transform("resolved", lambda r: F.struct(r["param"], r["value"])))
    return df.withColumn("parameters_applied", F.when(F.col("resolution_error").isNull(), applied))


def resolution_rows(resolved: DataFrame, key: str) -> DataFrame:
    """One row per selection and declared parameter."""
    return resolved.select(key, F.explode("resolved").alias("r")).select(
        key, F.col("r.param").alias("param"), F.col("r.value").alias("value"), F.col("r.error").alias("error")
    )


def check_templates(templates: DataFrame) -> DataFrame:
    """Placeholders of each measure's text that have no declared parameter, sorted."""
    names = F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), F.lit(1)))
    return templates.select(
        "measure", F.array_sort(F.array_except(names, F.col("declared"))).alias("undeclared")
    ).withColumn("ok", F.size("undeclared") == 0)


def require_templates(spark: SparkSession, catalog: Catalog) -> None:
    """Raise when a measure's text has an undeclared placeholder; run at session start."""
    for row in check_templates(catalog.template_table(spark)).where("not ok").collect():
        raise RuntimeError(f"measure {row['measure']!r} has undeclared placeholder(s): {row['undeclared']!r}")
