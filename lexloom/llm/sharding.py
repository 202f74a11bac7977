"""Sharding by proportional stratified interleaving.  Built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import distributed_rank, text_of


def stratified_shards(docs: DataFrame, shards: int = 8, seed: str = "lexloom", source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """docs without the text, with size, text_crc32, law, shard, slot and grown_shard.

    Every source's rows are shuffled by md5(seed:id) and ranked; a row of rank r
    of n stands at (r - u) / n, where u, between 0 and 1, is the source's own
    start, drawn by md5(seed:source) so that sources of one size don't all
    stand at the same places.  All rows sorted by that place are cut into
    `shards` runs: each run has each source's share, to a row, and row counts
    differ by one at most (law `rows`; grown_shard is therefore null).

    Equal texts are no group under this law: they would have to share a shard,
    which counts that differ by one don't allow.  Where more than n / shards + 1
    of n rows are copies of one text (five of eight rows, say, in eight shards
    of one row each), no placement could do both.  Each copy is placed by its own
    id and source.  Null texts have no bytes (size 1), very long ones only their
    size counts; a null source is a source of its own and a null id shuffles as
    'null'.  Ties end by source, id, checksum, then size; rows equal in all of
    these are interchangeable.  An empty table gives an empty one.  Result
    columns of docs with the same names are replaced.

    No task sees a whole source, nor all sources of one size: both ranks are
    taken inside buckets (of the shuffle's hash, and of the place; as many as
    the square root of the row count) whose counts are summed ahead.  Only ids,
    sizes and 16-byte keys are shuffled, never texts.
    """
    if buckets is None:
        buckets = max(64, math.isqrt(docs.count()))
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    rest = [c for c in docs.columns if c not in (*made, text_col) or c in (id_col, source_col)]
    raw = F.encode(text_of(text_col), "utf-8")
    rows = docs.select(*rest, (F.octet_length(text_of(text_col)).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("_h"))
    rows = rows.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int"))
    rows = distributed_rank(rows, [source_col], "_b", [F.col("_h"), F.col(id_col), F.col("text_crc32"), F.col("size")], "_rank", "_of")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(source_col).cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("_f", (F.col("_rank") - (start + 0.5) / F.lit(2.0**32)) / F.col("_of")).withColumn("_c", F.floor(F.col("_f") * buckets).cast("int"))
    rows = distributed_rank(rows, [], "_c", [F.col("_f"), F.col(source_col), F.col(id_col), F.col("text_crc32"), F.col("size")], "_pos", "_all")
    place = F.col("_pos") - 1
    rows = rows.withColumn("_s", F.expr(f"((_pos - 1) * {shards}) div _all"))
    first = F.expr(f"(_s * _all + {shards - 1}) div {shards}")
    return rows.select(*rest, "size", "text_crc32", F.lit("rows").alias("law"), F.col("_s").cast("int").alias("shard"), (place - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
