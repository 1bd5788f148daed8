"""Landing of raw files and checks on what was loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.plans.star import RAW_SCHEMAS

MIN_BYTES = 100


def land_csv(spark: SparkSession, root: str, schemas: dict[str, str] | None = None, pattern: str = "{name}.csv") -> dict[str, DataFrame]:
    """One DataFrame per raw table, with declared types instead of an inference pass."""
    schemas = schemas or RAW_SCHEMAS
    # FAILFAST: a line that does not fit its schema stops the load rather than becoming nulls.
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", False)
    return {name: reader.schema(ddl).csv(f"{root}/{pattern.format(name=name)}") for name, ddl in schemas.items()}


def save_raw(tables: dict[str, DataFrame], root: str) -> None:
    """Replace the landed tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/raw_{name}")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table. Row counts come from file footers where the format has them."""
    out = None
    for name, df in tables.items():
        one = df.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("n_rows"),
            F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def audit_landing(spark: SparkSession, path: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Files under ``path`` with their size and whether it is plausible; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    )
    return files.withColumn("ok", F.col("length") >= min_bytes)


def landing_tally(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
