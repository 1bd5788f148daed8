"""Rows dealt to weighted shards by rendezvous hashing of their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.llm.numbering import numbered


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of each key: the one with the largest weight / -ln(u), u a hash of key and shard in (0, 1).

    A shard's hashes do not depend on the others, so another shard takes rows only into itself, and a change of a
    weight moves rows only to or from that shard. Shards of weight 0 get nothing. A null key is a key of its own.
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        digits = F.conv(F.substring(F.md5(F.concat(text, F.lit(f"/{shard}"))), 1, 13), 16, 10)
        u = (digits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        scores.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    if not scores:
        raise ValueError("no shard has a weight")
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return -best["shard"]


def shard_rows(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row.

    ``shard`` follows from ``doc_id`` and the weights; ``grown_shard`` is the shard if one more of weight 1 is added.
    ``slot`` counts a shard's rows from 0 in the order of ``doc_id``, CRC and size. ``size`` is the text's UTF-8
    bytes (null: none) plus 1. Rows without ``doc_id`` share a key. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    dealt = rows.withColumn("shard", rendezvous(F.col("doc_id"), weights))
    dealt = dealt.withColumn("grown_shard", rendezvous(F.col("doc_id"), [*weights, 1.0]))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    lined = numbered(dealt, "shard", order, "slot")
    return lined.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
