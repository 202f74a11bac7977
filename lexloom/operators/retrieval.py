"""Ranked retrieval: BM25, dense search, rank fusion and what is done to ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators.blocks import similar
from lexloom.operators.lexical_index import B, EPSILON, K1, LexicalIndex, index_of, search
from lexloom.session import cut


def _idf(df: DataFrame, totals: DataFrame, group: Sequence[str]) -> DataFrame:
    """group..., term, avgdl, idf, from document frequencies: where that is negative, EPSILON times the mean of all terms."""
    meet = lambda x, y: x.join(y, list(group)) if group else x.join(y, F.lit(True))  # one row a group, or just one
    terms = meet(df, totals).withColumn("raw", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    terms = meet(terms, terms.groupBy(*group).agg(F.avg("raw").alias("mean_idf")))
    return terms.select(*group, "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def _totals(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25_stats(docs: DataFrame, id_col: str, text_col: str, group: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, terms) of BM25 Okapi: case-sensitive white-space tokens.

    idf is log((n - df + .5) / (df + .5)); where that is negative, EPSILON times
    the mean idf of all terms.  Document frequencies come from the distinct
    terms of each row, combined map-side; all three can be stored and reused.
    """
    rows = docs.select(*group, F.col(id_col).alias("doc"), F.explode(F.array(tokens(F.coalesce(text_col, F.lit(""))))).alias("_t"))
    lengths = rows.select(*group, "doc", F.size("_t").alias("dl"))
    postings = rows.select(*group, "doc", F.explode("_t").alias("term")).groupBy(*group, "doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = rows.select(*group, F.explode(F.array_distinct("_t")).alias("term")).groupBy(*group, "term").agg(F.count(F.lit(1)).alias("df"))
    return postings, lengths, _idf(df, _totals(lengths, group), group)


def bm25_scores(stats: tuple[DataFrame, DataFrame, DataFrame], query: DataFrame, query_text: str, query_id: str, group: Sequence[str] = (), own_group: bool = False) -> DataFrame:
    """query_id, doc and score of every document that has a query term; a repeated term counts as often.

    With own_group the queries have the group columns too, and meet their own
    group's documents only.
    """
    postings, lengths, terms = stats
    on = [*(group if own_group else ()), "term"]
    asked = query.select(F.col(query_id).alias("query_id"), *(group if own_group else ()), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", *on).agg(F.count(F.lit(1)).alias("qf"))
    hits = postings.join(asked, on).join(terms, [*group, "term"]).join(lengths, [*group, "doc"])
    weight = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", *group, "doc").agg(F.sum(weight).alias("score"))


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc", text_col: str = "text", query_id: str = "query_id", query_text: str = "text", group: str | Sequence[str] = ()) -> DataFrame:
    """query_id, [group], doc, score (6 places) and rank: the k best documents of every query (and group) by BM25.

    An index of docs is written, asked and removed (see lexical_index; to ask
    again, keep one).  With a group, each group is a corpus of its own; queries
    that have the group's column (one at most) are asked of their own group only.
    """
    [group] = ([group] if isinstance(group, str) else list(group)) or [None]
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("text"), *([F.col(group).cast("string").alias("scope")] if group and group in queries.columns else []))
    with index_of(docs, asked, id_col, text_col, group) as index:
        members = index.segments.select("grp").distinct().withColumn("scope", F.col("grp")) if group else None
        found = cut(index_top_k(index, asked, k, members, everywhere="scope" not in asked.columns and group is not None))
    return found.withColumnRenamed("scope", group) if group else found.drop("scope")


def index_top_k(index: LexicalIndex, queries: DataFrame, k: int, members: DataFrame | None = None, everywhere: bool = False) -> DataFrame:
    """query_id, scope, doc, score and rank of the k best documents of every query and scope, over a stored index."""
    return top_k(search(index, queries, k, members, everywhere), k, ("query_id", "scope"))


def top_k(scores: DataFrame, k: int, by: Sequence[str] = ("query_id",), score: str = "score", tie: str = "doc") -> DataFrame:
    """rank 1..k within each group, ties by id; tasks keep k rows before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """The k nearest vectors of each query by dot product: all rows against blocks of queries, k kept of each batch."""
    rows, asked = vectors.select(F.col(id_col).alias("doc"), vector), queries.select(F.col(query_id).alias("query_id"), query_vector)
    return top_k(similar(rows, ["doc"], vector, asked, ["query_id"], query_vector, k=k, cosine=False), k).select("query_id", "doc", "score", "rank")


def fuse(lists: Sequence[DataFrame], k: int = 60, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (by..., doc, rank from 1): a doc twice in a list counts twice."""
    rows = lists[0].select(*by, "doc", "rank", F.lit(0).alias("_list"))
    for i, other in enumerate(lists[1:], 1):
        rows = rows.unionByName(other.select(*by, "doc", "rank", F.lit(i).alias("_list")))
    return rows.groupBy(*by, "doc").agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"))


def post_filter(ranked: DataFrame, keep: Column) -> DataFrame:
    """A filter after top-k: fewer than k may be left, and ranks stay."""
    return ranked.where(keep)


def pseudo_scores(ranked: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Scores n, n-1, ... for a disabled reranker: every threshold passes."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return ranked.withColumn("score", (n - F.col("rank") + 1).cast("double"))


def gate(scored: DataFrame, least: float, most: int, by: Sequence[str] = ("query_id",), tie: str = "doc") -> DataFrame:
    """Rows scored at least `least`, the `most` best of each group."""
    return top_k(scored.where(F.col("score") >= least), most, by, "score", tie)


def neighbours(seeds: DataFrame, paragraphs: DataFrame, window: int, group: str, number: str) -> DataFrame:
    """Paragraphs one before to `window` after a seed of the same judgment, once, without the seeds themselves."""
    s = seeds.select(F.col(group).alias("_g"), F.explode(F.sequence(F.col(number) - 1, F.col(number) + window)).alias("_n")).distinct()
    near = paragraphs.join(s, (F.col(group) == F.col("_g")) & (F.col(number) == F.col("_n")), "left_semi")
    own = seeds.select(F.col(group).alias("_g"), F.col(number).alias("_n"))
    return near.join(own, (F.col(group) == F.col("_g")) & (F.col(number) == F.col("_n")), "left_anti")


def operative_slot(kept: DataFrame, pool: DataFrame, least: float, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """kept, and the best operative row of the pool if kept has none and it reaches the threshold."""
    has = kept.where("is_operative").select(*by).distinct()
    best = top_k(pool.where((F.col("is_operative")) & (F.col("score") >= least)).join(has, list(by), "left_anti"), 1, by)
    cols = [c for c in kept.columns if c != "rank"]
    return kept.select(*cols).unionByName(best.select(*cols))


def bridge(citations: DataFrame, most: int = 3, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Articles cited by scored passages (by..., article, score), by their best citing score."""
    return top_k(citations.groupBy(*by, "article").agg(F.max("score").alias("score")), most, by, "score", "article")


def dedup_queries(queries: DataFrame, most: int) -> DataFrame:
    """The question and at most `most` sub-questions that differ from it and from each other, in order."""
    same = Window.partitionBy("query_id", F.lower(F.trim("text"))).orderBy("pos")
    firsts = queries.withColumn("_r", F.row_number().over(same)).where("_r = 1").drop("_r")
    return firsts.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("n") <= most + 1)
