"""Storage of chunks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

CHUNK_SCHEMA = (
    "chunk_id string, source string, doc_type string, doc_title string, section string, "
    "chunk_index int, char_start int, char_end int, token_count int, content string"
)


# Names with a leading underscore are no data to a scan of the whole folder.
_SNAPSHOT, _MARKER, _SCHEMA = "_snapshot-", "_current-", "_schema.json"


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def read_chunks_json(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def save_chunks(chunks: DataFrame, path: str) -> str:
    """Replace the chunk table at ``path``; returns the folder of the new snapshot.

    Rows go to a folder of their own first, one sub-folder per document type: a search in one type reads one folder. Then
    an empty marker that names the snapshot is put beside it, the only step that readers can see. A write that
    fails half way leaves the table as it was; a reader that has begun keeps its snapshot until ``drop_snapshots``. Of two
    writers at the same time one is the current table afterwards, whole.
    """
    spark = chunks.sparkSession
    stamped = chunks if "created_at" in chunks.columns else chunks.withColumn("created_at", F.current_timestamp())
    name = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/{_SNAPSHOT}{name}"
    stamped.write.mode("errorifexists").partitionBy("doc_type").parquet(folder)
    fs, root = _folder(spark, path)
    out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_SCHEMA}"), False)
    out.write(bytearray(stamped.schema.json().encode()))
    out.close()
    number = max((n for n, _ in _markers(fs, root)), default=0) + 1
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"{_MARKER}{number:012d}.{name}")
    fs.create(marker, False).close()
    return folder


def _folder(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _markers(fs, root) -> list[tuple[int, str]]:
    """(number, snapshot) of every replacement so far, in order."""
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    found = [n.removeprefix(_MARKER).split(".", 1) for n in names if n.startswith(_MARKER)]
    return sorted((int(number), name) for number, name in found)


def current_snapshot(spark: SparkSession, path: str) -> str:
    """Folder of the chunk table that ``path`` stands for now."""
    markers = _markers(*_folder(spark, path))
    if not markers:
        raise FileNotFoundError(f"no chunk table at {path}")
    return f"{path.rstrip('/')}/{_SNAPSHOT}{markers[-1][1]}"


def drop_snapshots(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` snapshots and return how many went.

    To be called when neither readers of older ones nor writers are left: what a failed write left behind goes as well.
    """
    fs, root = _folder(spark, path)
    markers = _markers(fs, root)
    kept = {name for _, name in markers[-max(1, keep):]}
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    old = [n for n in names if n.startswith(_SNAPSHOT) and n.removeprefix(_SNAPSHOT) not in kept]
    marks = [n for n in names if n.startswith(_MARKER) and n.split(".", 1)[1] not in kept]
    for name in [*marks, *old]:  # markers first: none may name a folder that is gone
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, name), True)
    return len(old)


def scan_chunks(spark: SparkSession, path: str, doc_type: str | None = None, ordered: bool = True) -> DataFrame:
    """All chunks, or one type's, by source and chunk index (a range-partitioned sort).

    Types are those that were saved, also of an empty table. The snapshot is chosen here; rows are read from it later even if the table is replaced in between.
    """
    folder = current_snapshot(spark, path)
    jvm = spark.sparkContext._jvm
    file = _folder(spark, path)[0].open(jvm.org.apache.hadoop.fs.Path(f"{folder}/{_SCHEMA}"))
    schema = jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    file.close()
    df = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(folder)
    if doc_type is not None:
        df = df.where(F.col("doc_type") == doc_type)
    return df.orderBy("source", "chunk_index") if ordered else df
