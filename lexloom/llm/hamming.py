"""Exact top-k search in Hamming space by incremental multi-index hashing."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import apart, checkpoint

BITS = 64
#: Radii up to this one are searched at once: they are so few values that a round of its own costs more.
FIRST = 2


def sign_code(vector: str) -> Column:
    """64 signs as one long, the first dimension highest; null unless there are 64 numbers."""
    bit = lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    code = F.aggregate(F.col(vector), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(bit(x)))
    return F.when(F.size(vector) == BITS, code)


def _segment(code: Column, j: int, width: int) -> Column:
    return F.shiftrightunsigned(code, j * width).bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for c in itertools.combinations(range(width), radius)]


def hamming_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and distance: the k nearest other rows of each query, ties by id.

    Codes are the vectors' signs.  Every code is indexed by each of its
    segments.  A round probes, for every open query, the segment values just r
    bits away (0 to 2 in the first, then one r a round); a code at distance d has a segment within d / segments bits, so
    after round r everything up to segments x (r + 1) - 1 is known, and a query
    is closed once its k-th neighbour lies within that.  A code is counted
    in the one round and segment that finds it first, so nothing is met twice.

    Rows without 64 numbers (null vectors among them) have no code and are
    neither found nor answered; fewer than k rows give fewer results; repeated
    rows of one id and code are one; a null id is not found.  An empty table
    gives an empty one; other columns are ignored.

    Rows of one code are merged first, with their k+1 least ids (each task
    keeps that many before the shuffle), so a group of copies is one entry.
    Probes meet the index by segment value in joins that Spark may split;
    only each query's k+1 best codes go from round to round.
    """
    width = BITS // segments
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), sign_code(vector_col).alias("code")).where("vec_id is not null and code is not null")
    least = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    codes = least.groupBy("code").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    index = codes.select("code", F.size("ids").alias("n"), F.array_min("ids").alias("least"), F.posexplode(F.array(*(_segment(F.col("code"), j, width) for j in range(segments)))).alias("seg", "value"))
    index = checkpoint(index.select("code", "n", "least", (F.col("seg") * (1 << width) + F.col("value")).alias("key")))
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), sign_code(vector_col).alias("q")).where("query_id is not null and q is not null").distinct()
    open_ = checkpoint(asked.withColumn("bound", F.lit(BITS)))
    best = None
    done: list[DataFrame] = []
    few = codes.limit(k + 2).count() <= k + 1
    if few:  # every code is within every query's reach: at most k + 1 rows to broadcast
        each = F.broadcast(codes.select("code", F.size("ids").alias("n"), F.array_min("ids").alias("least")))
        done.append(open_.join(each, F.lit(True)).select("query_id", "q", "code", "n", "least", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance")))
    for radii in [] if few else [range(FIRST + 1), *([r] for r in range(FIRST + 1, width + 1))]:
        flips = F.explode(F.expr(f"array({', '.join(f'{m}L' for r in radii for m in _flips(width, r))})"))
        parts = F.posexplode(F.array(*(_segment(F.col("q"), j, width) for j in range(segments)))).alias("s", "v")
        probes = open_.select("query_id", "q", "bound", parts).select("query_id", "q", "bound", "s", "v", flips.alias("f"))
        probes = probes.select("query_id", "q", "bound", "s", F.bit_count("f").alias("r"), (F.col("s") * (1 << width) + F.col("v").bitwiseXOR(F.col("f"))).alias("probe"))
        met = probes.join(index, apart("probe") == apart("key")).withColumn("x", F.col("q").bitwiseXOR(F.col("code")))
        # Met first here: no segment is closer than r bits, and no earlier one just as close.
        near = [F.bit_count(_segment(F.col("x"), j, width)) for j in range(segments)]
        first = F.bit_count("x") <= F.col("bound")  # nothing beyond the k-th neighbour so far can matter
        for j in range(segments):
            first = first & F.when(F.lit(j) < F.col("s"), near[j] > F.col("r")).when(F.lit(j) > F.col("s"), near[j] >= F.col("r")).otherwise(True)
        found = met.where(first).select("query_id", "q", "code", "n", "least", F.bit_count("x").alias("distance"))
        if best is not None:
            found = found.unionByName(best)
        order = Window.partitionBy("query_id", "q").orderBy("distance", "least")
        # Each code before another gives at least one nearer row, but for the query's own: k + 1 codes are enough.
        kept = found.withColumn("_d", F.row_number().over(order)).where(F.col("_d") <= k + 1)
        best = checkpoint(kept.drop("_d"))
        ahead = best.withColumn("_n", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        covered = segments * (radii[-1] + 1) - 1
        reach = ahead.where(F.col("_n") >= k + 1).groupBy("query_id", "q").agg(F.min("distance").alias("d"))
        state = checkpoint(open_.join(reach, ["query_id", "q"], "left").select("query_id", "q", F.coalesce("d", F.lit(BITS)).alias("bound"), (F.col("d").isNotNull() & (F.col("d") <= covered) | F.lit(radii[-1] == width)).alias("shut")))
        done.append(best.join(state.where("shut"), ["query_id", "q"], "left_semi"))
        open_ = state.where(~F.col("shut")).drop("shut")
        best = best.join(open_, ["query_id", "q"], "left_semi")
        if open_.isEmpty():
            break
    named = functools.reduce(DataFrame.unionByName, done).join(codes.select(F.col("code").alias("_c"), "ids"), apart("code") == apart("_c"))
    pairs = named.select("query_id", "distance", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))
