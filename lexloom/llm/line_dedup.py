"""Line dedup: lines that many documents share stay in one of them.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import BLANKS, apart, ascii_lower, checkpoint, text_of


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    r"""All columns of docs, then n_lines, n_dropped (long) and kept_text.

    A line's key is the line with [\x20\x09-\x0D] stripped and A-Z lower-cased.
    A key of at least `min_chars` code points that at least `min_docs` different
    ids hold loses its lines in every document but the one of the largest id.

    Null or empty texts have one empty line.  Rows that repeat an id count as
    one document, and each keeps or loses lines by its own text; rows with a
    null id are counted together as no document: they add nothing to a key's
    count and lose lines only if `min_docs` real ids hold the key.  An empty
    table gives an empty one; columns of docs named like a result are replaced.

    Plan: each document's keys are exploded as two 64-bit hashes (no text),
    checkpointed, so that texts are split once for both uses, counted over
    distinct ids with map-side partial sums, and the repeated ones joined back
    (a hot key meets one row, so AQE splits it).
    Only the numbers of dropped lines travel to the texts.
    """
    docs = docs.drop(*(c for c in ("n_lines", "n_dropped", "kept_text") if c in docs.columns and c not in (id_col, text_col)))
    row = F.xxhash64(text_of(text_col))
    lines = docs.select(F.col(id_col).alias("_d"), row.alias("_t"), F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("_p", "_l"))
    keys = lines.select("_d", "_t", "_p", _key(F.col("_l")).alias("_k")).where(F.length("_k") >= min_chars)
    keys = checkpoint(keys.select("_d", "_t", "_p", F.xxhash64("_k").alias("_a"), F.xxhash64(F.lit(1), "_k").alias("_b")))
    repeated = keys.groupBy("_a", "_b").agg(F.count_distinct("_d").alias("_n"), F.max("_d").alias("_keep")).where(F.col("_n") >= min_docs)
    repeated = repeated.select(apart("_a").alias("_ra"), F.col("_b").alias("_rb"), "_keep")
    lost = keys.join(repeated, (apart("_a") == F.col("_ra")) & (F.col("_b") == F.col("_rb"))).where(~F.col("_d").eqNullSafe(F.col("_keep")))
    lost = lost.groupBy(F.col("_d").alias("_ld"), F.col("_t").alias("_lt")).agg(F.collect_list("_p").alias("_lost"))
    # The lines are made below the join, so that the lambda reads a stored array and splits nothing again.
    whole = docs.select("*", row.alias("_t"), F.split(text_of(text_col), "\n", -1).alias("_lines"))
    joined = whole.join(lost, whole[id_col].eqNullSafe(F.col("_ld")) & (F.col("_t") == F.col("_lt")), "left")
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(F.transform(F.array_except(places, "_lost"), lambda i: F.get("_lines", i)))
    done = joined.select(*docs.columns, F.size("_lines").cast("long").alias("n_lines"), F.size(F.array_distinct(F.coalesce("_lost", F.array().cast("array<int>")))).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))
    return done
