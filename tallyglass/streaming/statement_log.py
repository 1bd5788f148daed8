"""The statement audit on an unbounded log.

The audit is row-local, so it needs no state and no watermark; each micro-batch is audited once and
appended. Restarts resume from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyglass.catalog import Catalog
from tallyglass.operators.audit import audit_sql


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def write_audit(
    log: DataFrame, catalog: Catalog, out: str, checkpoint: str, sql: str = "sql", once: bool = True
) -> StreamingQuery:
    """Append audited statements to a Parquet folder, split by verdict."""
    audited = audit_sql(log, catalog, sql)
    writer = (
        audited.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .partitionBy("passed")
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
