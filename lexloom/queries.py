"""The reference operators bound to the tables of a folder, and their DuckDB SQL.

Roles: region-nation-customer-orders is the containment hierarchy, lineitem a
many-to-many bridge, documents the corpus (source is the act, benchmark the
questions), embeddings the vectors (label the concept), conversations the
judgments, labels the relevance judgments, events the rate-limited calls.
Legal operators run over inline tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import legal
from lexloom.functions.text import candidate_terms
from lexloom.functions.vectors import mean_vector, rounded
from lexloom.operators import answers, evaluation, graph, judgments, retrieval, topics, vector_index
from lexloom.operators.lexical_index import write_index
from lexloom.operators.tables import node_table
from lexloom.plans.retrieval import HybridConfig, fused_search
from lexloom.session import cut, remove_folder, shared_folder
from lexloom.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


# --- containment and scope -------------------------------------------------


def contains(spark: SparkSession, d: str) -> DataFrame:
    """Edges region -> nation -> customer -> order with ids that tell the label."""
    n = t(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"))
    c = t(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dst"))
    o = t(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    return n.unionByName(c).unionByName(o)


_EDGES = """edges AS (
    SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
    UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
_CLOSURE = f"""WITH RECURSIVE {_EDGES}, paths AS (
    SELECT src AS ancestor, dst AS descendant, 1 AS hops FROM edges
    UNION ALL SELECT p.ancestor, e.dst, p.hops + 1 FROM paths p JOIN edges e ON p.descendant = e.src WHERE p.hops < 3)"""


@query(f"{_CLOSURE} SELECT ancestor, hops, count(*) AS n FROM paths WHERE ancestor LIKE 'r%' GROUP BY ALL".replace(" WHERE p.hops < 3", ""))
def contains_closure(spark, d):
    """All descendants at any depth."""
    paths = graph.closure(contains(spark, d))
    return paths.where(F.col("ancestor").startswith("r")).groupBy("ancestor", "hops").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_CLOSURE} SELECT ancestor, hops, descendant FROM paths WHERE ancestor LIKE 'n%' AND hops BETWEEN 1 AND 2")
def contains_bounded(spark, d):
    paths = graph.closure(contains(spark, d).where(~F.col("src").startswith("r")), 2)
    return graph.within(paths, 1, 2).where(F.col("ancestor").startswith("n")).select("ancestor", "hops", "descendant")


@query("SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
def path_optional(spark, d):
    o = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", "o_orderpriority")
    return t(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@query("SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 5)")
def interprets_scope(spark, d):
    scope = t(spark, d, "part").where("p_size <= 5").select("p_partkey")
    bridge = t(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(scope, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return t(spark, d, "supplier").select("s_suppkey").join(bridge, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_anti_scope(spark, d):
    cited = t(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return t(spark, d, "customer").select("c_custkey", "c_nationkey").join(cited, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT n_regionkey, chr(10) || chr(10) || string_agg(n_name, chr(10) || chr(10) ORDER BY n_nationkey) AS text, list(n_name ORDER BY n_nationkey) AS titles FROM nation GROUP BY n_regionkey")
def group_collect_concat(spark, d):
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    rows = t(spark, d, "nation").groupBy("n_regionkey").agg(names.alias("titles"))
    return rows.select("n_regionkey", F.concat(F.lit("\n\n"), F.array_join("titles", "\n\n")).alias("text"), "titles")


@query("""WITH new AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE upper(c_name) END AS c_name, c_nationkey FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT -c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 50 = 0 AND c_custkey > 0)
    SELECT coalesce(new.c_custkey, old.c_custkey) AS c_custkey, coalesce(new.c_name, old.c_name) AS c_name, coalesce(new.c_nationkey, old.c_nationkey) AS c_nationkey
    FROM (SELECT c_custkey, c_name, c_nationkey FROM customer) old FULL JOIN new USING (c_custkey)""")
def upsert_merge(spark, d):
    old = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    changed = old.where("c_custkey % 2 = 0").withColumn("c_name", F.when(F.col("c_custkey") % 3 != 0, F.upper("c_name")))
    added = old.where("c_custkey % 50 = 0 and c_custkey > 0").withColumn("c_custkey", -F.col("c_custkey"))
    return graph.upsert_nodes(old, changed.unionByName(added), "c_custkey")


@query("""WITH b AS (SELECT o_custkey AS id, o_orderkey % 3 AS k, max(o_totalprice) AS price, CASE WHEN count(*) > 1 THEN max(o_orderpriority) END AS note FROM orders GROUP BY ALL)
    SELECT id, coalesce(max(price) FILTER (k = 2), max(price) FILTER (k = 1), max(price)) AS price, coalesce(max(note) FILTER (k = 2), max(note) FILTER (k = 1), max(note)) AS note FROM b GROUP BY id""")
def upsert_buckets(spark, d):
    """Three upserts into a bucket table, the customers of every third order in each."""
    folder = f"{shared_folder(spark)}/nodes-{uuid.uuid4().hex}"
    table = node_table(spark, folder, "id long, price double, note string", buckets=16)
    rows = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 3).alias("k"))
    rows = cut(rows.agg(F.max("o_totalprice").alias("price"), F.when(F.count(F.lit(1)) > 1, F.max("o_orderpriority")).alias("note")))
    try:
        for k in range(3):
            table.upsert(rows.where(F.col("k") == k).drop("k"), "orders", k)
        return cut(table.read())
    finally:
        remove_folder(spark, folder)


@query("""SELECT DISTINCT 'part' AS src_label, CAST(l_partkey AS VARCHAR) AS src, 'CITES' AS rel, 'supplier' AS dst_label, CAST(l_suppkey AS VARCHAR) AS dst
    FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def edge_upsert(spark, d):
    nodes = t(spark, d, "part").where("p_size < 25").select(F.lit("part").alias("label"), F.col("p_partkey").cast("string").alias("id"))
    nodes = nodes.unionByName(t(spark, d, "supplier").where("s_acctbal > 0").select(F.lit("supplier").alias("label"), F.col("s_suppkey").cast("string").alias("id")))
    new = t(spark, d, "lineitem").select(F.lit("part").alias("src_label"), F.col("l_partkey").cast("string").alias("src"), F.lit("CITES").alias("rel"), F.lit("supplier").alias("dst_label"), F.col("l_suppkey").cast("string").alias("dst"))
    return graph.upsert_edges(new.limit(0), new, nodes)


@query("""WITH n AS (SELECT 'node' AS kind, o_orderpriority AS label, CAST(o_orderkey AS VARCHAR) AS id, NULL AS other FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')),
    e AS (SELECT 'edge', a.o_orderpriority, CAST(a.o_orderkey AS VARCHAR), CAST(b.o_orderkey AS VARCHAR) FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
        WHERE a.o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND b.o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
    SELECT * FROM n UNION ALL SELECT * FROM e""")
def delete_labels(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), "o_custkey")
    a, b = o.select(F.col("id").alias("src"), F.col("label").alias("src_label"), "o_custkey"), o.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"), "o_custkey")
    nodes, edges = graph.delete_labels(o, a.join(b, "o_custkey").where("src < dst"), ["1-URGENT", "2-HIGH"])
    kept = nodes.select(F.lit("node").alias("kind"), "label", F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("other"))
    return kept.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src_label").alias("label"), F.col("src").cast("string").alias("id"), F.col("dst").cast("string").alias("other")))


# --- ranking -----------------------------------------------------------------


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item's whole text as a question."""
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_TOKENS = "list_filter(string_split_regex(coalesce({0}, ''), '\\s+'), lambda x: x <> '')"
_BM25 = f"""q AS (SELECT item_id AS query_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark),
    qt AS (SELECT query_id, term, count(*) AS qf FROM q GROUP BY ALL),
    docs AS (SELECT doc_id AS doc, source, {_TOKENS.format('text')} AS ts FROM documents)"""
_BM25_ALL = f"""{_BM25},
    post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ts) AS term FROM docs) GROUP BY ALL),
    n AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM docs),
    raw AS (SELECT term, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS r FROM post, n GROUP BY term, n_docs),
    idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
    bm AS (SELECT query_id, doc, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))) AS s
        FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN docs USING (doc), n GROUP BY ALL),
    sparse AS (SELECT query_id, doc, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc) AS rank FROM bm QUALIFY rank <= 10)"""


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", 6))


def sparse(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return retrieval.bm25_top_k(t(spark, d, "documents"), questions(spark, d), k, id_col="doc_id").select("query_id", "doc", "score", "rank")


@query(f"WITH {_BM25_ALL} SELECT query_id, doc, score, rank FROM sparse")
def bm25_topk(spark, d):
    return sparse(spark, d)


@query(f"WITH {_BM25_ALL} SELECT query_id, doc, score, rank FROM sparse")
def bm25_indexed(spark, d):
    """bm25_topk over an index dealt by term, as it would be kept: no text is read to answer."""
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    try:
        index = write_index(t(spark, d, "documents"), folder, id_col="doc_id")
        return cut(retrieval.index_top_k(index, questions(spark, d), 10)).select("query_id", "doc", "score", "rank")
    finally:
        remove_folder(spark, folder)


@query(f"""WITH {_BM25},
    post AS (SELECT source, doc, term, count(*) AS tf FROM (SELECT source, doc, unnest(ts) AS term FROM docs) GROUP BY ALL),
    n AS (SELECT source, count(*) AS n_docs, avg(len(ts)) AS avgdl FROM docs GROUP BY source),
    raw AS (SELECT source, term, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS r FROM post JOIN n USING (source) GROUP BY source, term, n_docs),
    mean AS (SELECT source, avg(r) AS m FROM raw GROUP BY source),
    idf AS (SELECT source, term, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw JOIN mean USING (source)),
    bm AS (SELECT query_id, source, doc, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))) AS s
        FROM qt JOIN post USING (term) JOIN idf USING (source, term) JOIN docs USING (source, doc) JOIN n USING (source) GROUP BY ALL)
    SELECT query_id, source, doc, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id, source ORDER BY round(s, 6) DESC, doc) AS rank FROM bm QUALIFY rank <= 3""")
def bm25_per_source(spark, d):
    found = retrieval.bm25_top_k(t(spark, d, "documents"), questions(spark, d), 3, id_col="doc_id", group="source")
    return found.select("query_id", "source", "doc", "score", "rank")


def dense(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """Vector queries: each benchmark item asks with the embedding of its own number."""
    v = t(spark, d, "embeddings").select("vec_id", "embedding")
    asked = v.join(t(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), F.col("vec_id") == F.col("query_id"))
    return retrieval.dense_top_k(v, asked.select("query_id", F.col("embedding").alias("query_vector")), k)


_DENSE = """dense AS (
    SELECT q.vec_id AS query_id, e.vec_id AS doc, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) AS rank
    FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark) QUALIFY rank <= 10)"""


@query(f"WITH {_DENSE} SELECT query_id, doc, round(score, 6) AS score, rank FROM dense")
def dense_topk(spark, d):
    return _rounded(dense(spark, d)).select("query_id", "doc", "score", "rank")


def _vector_index(spark: SparkSession, d: str, answer: Callable[[vector_index.VectorIndex, DataFrame], DataFrame]) -> DataFrame:
    """What `answer` makes of an index of all embeddings, in 64 cells, and the questions' vectors."""
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    v = t(spark, d, "embeddings").select("vec_id", "embedding")
    asked = v.join(t(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("query_vector"))
    try:
        return cut(answer(vector_index.write_vector_index(v, folder, dim=64, cells=64), asked))
    finally:
        remove_folder(spark, folder)


@query(f"WITH {_DENSE} SELECT query_id, doc, round(score, 6) AS score, rank FROM dense")
def vector_index_exact(spark, d):
    return _rounded(_vector_index(spark, d, lambda index, asked: vector_index.exact_top_k(index, asked, 10))).select("query_id", "doc", "score", "rank")


@query("SELECT count(*) > 0 AS enough FROM benchmark JOIN embeddings ON item_id = vec_id")
def vector_index_recall(spark, d):
    """Whether the cells and candidates chosen on a sample give nine in ten of all questions' true nearest, on the mean."""

    def measured(index, asked):  # noqa: ANN001, ANN202
        probes, rescore = vector_index.choose_search(index, 10)
        found = vector_index.vector_top_k(index, asked, 10, probes, rescore)
        each = vector_index.recall(found, vector_index.exact_top_k(index, asked, 10))
        return each.agg(F.avg("recall").alias("mean_recall")).select((F.col("mean_recall") >= 0.9).alias("enough"))

    return _vector_index(spark, d, measured)


@query(f"WITH {_DENSE} SELECT query_id, doc, round(score, 6) AS score, rank FROM dense JOIN documents ON doc = doc_id WHERE source IN ('src0', 'src1', 'src2')")
def dense_postfilter(spark, d):
    sources = t(spark, d, "documents").select("doc_id", "source")
    hits = _rounded(dense(spark, d)).join(sources, F.col("doc") == F.col("doc_id"))
    return retrieval.post_filter(hits, F.col("source").isin("src0", "src1", "src2")).select("query_id", "doc", "score", "rank")


@query("""SELECT label, list(m ORDER BY i) AS centroid FROM (
    SELECT label, i, round(avg(x::DOUBLE), 4) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label""")
def centroid_mean(spark, d):
    means = mean_vector(t(spark, d, "embeddings"), ["label"], "embedding")
    return means.select("label", F.transform("centroid", lambda x: rounded(x, 4)).alias("centroid"))


_CENTROIDS = """cent AS (SELECT label, list(m ORDER BY i) AS c FROM (
    SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)"""


@query(f"""WITH {_CENTROIDS}, scored AS (SELECT cent.label AS query_id, vec_id AS doc, round(list_inner_product(embedding::DOUBLE[], c), 9) AS s FROM embeddings e CROSS JOIN cent)
    SELECT query_id, doc, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc) AS rank FROM scored QUALIFY rank <= 5""")
def hyde_mean_search(spark, d):
    """The mean vector of each label's texts asks all vectors."""
    v = t(spark, d, "embeddings")
    means = mean_vector(v, ["label"], "embedding").select(F.col("label").alias("query_id"), F.col("centroid").alias("query_vector"))
    return _rounded(retrieval.dense_top_k(v, means, 5)).select("query_id", "doc", "score", "rank")


_FUSED = """fused AS (SELECT query_id, doc, sum(1.0 / (60.0 + rank)) AS s FROM (SELECT query_id, doc, rank FROM dense UNION ALL SELECT query_id, doc, rank FROM sparse) GROUP BY ALL)"""


@query(f"WITH {_DENSE}, {_BM25_ALL}, {_FUSED} SELECT query_id, doc, round(s, 9) AS score FROM fused")
def rrf_fuse(spark, d):
    return retrieval.fuse([dense(spark, d), sparse(spark, d)]).select("query_id", "doc", F.round("score", 9).alias("score"))


@query(f"""WITH {_DENSE}, {_BM25_ALL}, {_FUSED},
    pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc) AS r FROM fused QUALIFY r <= 10),
    ps AS (SELECT *, CAST(count(*) OVER (PARTITION BY query_id) - r + 1 AS DOUBLE) AS score FROM pool)
    SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM ps QUALIFY rank <= 5""")
def hybrid_retrieve(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    asked = questions(spark, d).join(vectors.select(F.col("doc").alias("_d"), F.col("embedding").alias("query_vector")), F.col("query_id") == F.col("_d"), "left").drop("_d")
    return fused_search(docs, vectors, asked, HybridConfig(top_k_final=5))


@query("""WITH seeds AS (SELECT conv_id, turn FROM conversations WHERE text LIKE '%the%')
    SELECT DISTINCT c.conv_id, c.turn FROM conversations c JOIN seeds s ON c.conv_id = s.conv_id AND c.turn BETWEEN s.turn - 1 AND s.turn + 2
    WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.conv_id = c.conv_id AND x.turn = c.turn)""")
def neighbour_expand(spark, d):
    turns = t(spark, d, "conversations").select("conv_id", "turn", "text")
    seeds = turns.where(F.contains("text", F.lit("the"))).select("conv_id", "turn")
    return retrieval.neighbours(seeds, turns.select("conv_id", "turn").distinct(), 2, "conv_id", "turn")


@query("""WITH p AS (SELECT label AS query_id, vec_id AS doc, round(embedding[1]::DOUBLE, 6) AS score, vec_id % 7 = 0 AS is_operative FROM embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS r FROM p QUALIFY r <= 3),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS r FROM p WHERE is_operative AND score >= 0.05
        AND query_id NOT IN (SELECT query_id FROM k WHERE is_operative) QUALIFY r <= 1)
    SELECT query_id, doc, score, is_operative FROM k UNION ALL SELECT query_id, doc, score, is_operative FROM best""")
def operative_slot(spark, d):
    pool = t(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("score"), (F.col("vec_id") % 7 == 0).alias("is_operative"))
    return retrieval.operative_slot(retrieval.top_k(pool, 3), pool, 0.05)


@query("""SELECT l_suppkey AS query_id, l_partkey AS article, max(l_extendedprice) AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS rank
    FROM lineitem GROUP BY l_suppkey, l_partkey QUALIFY rank <= 3""")
def bridge_articles(spark, d):
    cites = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("article"), F.col("l_extendedprice").alias("score"))
    return retrieval.bridge(cites)


@query("""WITH s AS (SELECT source AS query_id, doc_id AS doc, round(n_chars / 10000.0, 6) AS score FROM documents)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s WHERE score >= 0.3 QUALIFY rank <= 2""")
def recital_gate(spark, d):
    scored = t(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("doc"), F.round(F.col("n_chars") / 10000.0, 6).alias("score"))
    return retrieval.gate(scored, 0.3, 2)


@query("""WITH x AS (SELECT conv_id AS query_id, turn AS pos, text, row_number() OVER (PARTITION BY conv_id, lower(trim(text)) ORDER BY turn) AS r FROM conversations)
    SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM x WHERE r = 1 QUALIFY n <= 4""")
def query_dedup(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "text")
    return retrieval.dedup_queries(rows, 3).select("query_id", "pos", "n")


# --- topics --------------------------------------------------------------------


def concepts(spark: SparkSession, d: str) -> DataFrame:
    means = mean_vector(t(spark, d, "embeddings"), ["label"], "embedding", "embedding")
    return means.select(F.col("label").cast("string").alias("label"), "embedding", F.lit(True).alias("active"))


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.floor(F.col("vec_id") / 4).alias("paragraph_id"), "embedding")


_CLASSIFIED = f"""{_CENTROIDS}, cls AS (
    SELECT vec_id AS chunk, CAST(vec_id // 4 AS BIGINT) AS paragraph_id, CAST(k.label AS VARCHAR) AS label, round(list_cosine_similarity(e.embedding::DOUBLE[], k.c), 9) AS score
    FROM embeddings e, cent k WHERE round(list_cosine_similarity(e.embedding::DOUBLE[], k.c), 9) >= 0.1)"""


@query(f"WITH {_CLASSIFIED} SELECT chunk, paragraph_id, label, round(score, 6) AS score FROM cls")
def chunk_classify(spark, d):
    return _rounded(topics.classify(chunk_vectors(spark, d), concepts(spark, d), 0.1))


@query(f"""WITH {_CLASSIFIED} SELECT paragraph_id, label, round(max(score), 6) AS score, count(*) AS chunk_count,
    row_number() OVER (PARTITION BY paragraph_id ORDER BY max(score) DESC, label) AS rank FROM cls GROUP BY paragraph_id, label QUALIFY rank <= 3""")
def paragraph_topics_top3(spark, d):
    return _rounded(topics.paragraph_topics(topics.classify(chunk_vectors(spark, d), concepts(spark, d), 0.1)))


@query(f"""WITH {_CENTROIDS}, s AS (SELECT vec_id AS query_id, CAST(k.label AS VARCHAR) AS label, round(list_cosine_similarity(e.embedding::DOUBLE[], k.c), 9) AS score
    FROM embeddings e, cent k WHERE vec_id IN (SELECT item_id FROM benchmark))
    SELECT query_id, label, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM s WHERE score >= 0.05 QUALIFY rank <= 5""")
def topic_match(spark, d):
    asked = t(spark, d, "embeddings").join(t(spark, d, "benchmark").select("item_id"), F.col("vec_id") == F.col("item_id"), "left_semi")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _rounded(topics.match_topics(concepts(spark, d), asked, 0.05, 5))


@query(f"""WITH {_CENTROIDS} SELECT CAST(a.label AS VARCHAR) AS a, CAST(b.label AS VARCHAR) AS b, round(list_cosine_similarity(a.c, b.c), 6) AS score
    FROM cent a JOIN cent b ON CAST(a.label AS VARCHAR) < CAST(b.label AS VARCHAR) WHERE round(list_cosine_similarity(a.c, b.c), 9) >= 0.0""")
def pair_merge_candidates(spark, d):
    return _rounded(topics.merge_candidates(concepts(spark, d), 0.0))


@query(f"""WITH {_CENTROIDS}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT vec_id, max(round(list_cosine_similarity(e, c), 9)) AS best FROM v, cent GROUP BY vec_id)
    SELECT 'two ' || vec_id AS label FROM s WHERE best >= 0.2 UNION ALL SELECT CAST(label AS VARCHAR) FROM cent""")
def seed_validate(spark, d):
    seeds = concepts(spark, d).select("label", "embedding")
    other = t(spark, d, "embeddings").select(F.concat(F.lit("two "), F.col("vec_id").cast("string")).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return topics.validate(seeds.unionByName(other), seeds, 0.2).select("label")


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS tok, generate_subscripts(string_split_regex(text, '\s+'), 1) AS p FROM documents),
    ok AS (SELECT lower(tok) AS term, CAST(doc_id AS BIGINT) * 1000000 + p - 1 AS pos FROM w WHERE regexp_full_match(tok, '[\p{L}]+') AND length(tok) > 3)
    SELECT term, count(*) AS n, min(pos) AS first FROM ok WHERE term NOT IN ('that', 'with') GROUP BY term ORDER BY n DESC, first, term LIMIT 200""")
def term_freq(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("p", "tok"))
    rows = rows.select("tok", (F.col("doc_id") * 1000000 + F.col("p")).alias("pos"))
    return candidate_terms(rows, "tok", "pos", values(spark, "('that'), ('with')", "term"), 200)


@query()
def affinity_cluster(spark, d):
    """Every vector is offered as a term; all that are alike to a concept are clustered."""
    own = concepts(spark, d)
    terms = t(spark, d, "embeddings").select(F.format_string("term %d", "vec_id").alias("term"), F.lit("").alias("definition"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    kept = topics.enrich(terms, own, own.select("label", F.col("embedding").alias("centroid")), 0.0)
    return topics.derive(kept.select("label", "term", "embedding")).select("parent", "label", F.size("terms").alias("n_terms"))


@query()
def aske_generation(spark, d):
    from lexloom.session import ensure_checkpoints

    ensure_checkpoints(spark)
    chunks = chunk_vectors(spark, d)
    seeds = concepts(spark, d).select(F.concat(F.lit("topic "), "label").alias("label"), "embedding")
    terms = t(spark, d, "embeddings").select(F.format_string("term %d", "vec_id").alias("term"), F.lit("").alias("definition"), "embedding")
    found, _ = topics.run_cycle(spark, chunks, seeds, terms, generations=2, alpha=0.1)
    return topics.paragraph_topics(found).select("paragraph_id", "label", F.round("score", 6).alias("score"), "chunk_count", "rank")


# --- judgments and legal text -----------------------------------------------------

#: Turns of a conversation as a judgment's lines: numbered ones, continuations, the formula of the ruling, signatures.
_LINE = """CASE WHEN turn % 9 = 4 THEN concat('On those grounds, the Court hereby ', CASE WHEN conv_id % 2 = 0 THEN 'rules' ELSE 'orders' END, ':') WHEN turn % 9 = 8 THEN '[Signatures]'
    WHEN turn % 3 = 0 THEN concat(CAST(turn + 1 AS STRING), CASE WHEN turn % 2 = 0 THEN ' ' ELSE '. ' END, role, ' said so') ELSE concat('and ', role, ' went on') END"""


@query(f"""WITH t AS (SELECT conv_id AS celex, turn AS seq, {_LINE} AS txt FROM conversations),
    a AS (SELECT *, regexp_matches(txt, '(?i)hereby (rules|orders|declares)') AS anc FROM t WHERE NOT regexp_matches(txt, '(?i)^\\[?\\s*signatures?\\s*\\]?\\.?$')),
    o AS (SELECT *, bool_or(anc) OVER (PARTITION BY celex ORDER BY seq) AS op FROM a),
    s AS (SELECT *, CASE WHEN op THEN regexp_matches(txt, '^\\d+[.)]\\s+') ELSE regexp_matches(txt, '^\\d+\\s+') END AS st FROM o WHERE NOT anc),
    g AS (SELECT *, sum(st::INT) OVER (PARTITION BY celex, op ORDER BY seq) AS g FROM s)
    SELECT celex, coalesce(max(CASE WHEN st THEN CAST(regexp_extract(txt, '^(\\d+)', 1) AS INT) END), 1) AS number,
        string_agg(CASE WHEN st THEN regexp_replace(txt, '^\\d+[.)]?\\s+', '') ELSE txt END, chr(10) ORDER BY seq) AS text, op AS is_operative
    FROM g WHERE g > 0 OR op GROUP BY celex, op, g""".replace("\\\\", "\\").replace("AS STRING", "AS VARCHAR"))
def para_islands(spark, d):
    body = t(spark, d, "conversations").select(F.col("conv_id").alias("celex"), F.col("turn").alias("seq"), F.expr(_LINE).alias("text"), F.lit(0).alias("section_seq"))
    return judgments.paragraphs(body).select("celex", "number", "text", "is_operative")


_CSS = "CASE WHEN turn = 1 THEN 'coj-sum-title-1' WHEN turn % 4 = 3 THEN 'coj-normal' ELSE concat(CASE WHEN conv_id % 2 = 0 THEN 'coj-' ELSE '' END, 'title-grseq-', CAST((conv_id + turn * turn) % 10 AS STRING)) END"
_HEAD = "CASE WHEN turn = 1 AND conv_id % 3 <> 0 THEN 'Judgment' ELSE concat('Part ', CAST(turn AS STRING)) END"


@query(f"""WITH t AS (SELECT conv_id AS celex, turn AS seq, {_CSS} AS css, {_HEAD} AS txt FROM conversations),
    h AS (SELECT *, min(CASE WHEN lower(txt) = 'judgment' THEN seq END) OVER (PARTITION BY celex) AS anchor FROM t WHERE regexp_full_match(css, '(coj-)?(sum-title-1|title-grseq-[0-9])'))
    SELECT celex, seq, txt AS text, CAST(dense_rank() OVER (PARTITION BY celex ORDER BY CASE WHEN css LIKE '%sum-title-1' THEN 0 ELSE CAST(right(css, 1) AS INT) END, css) - 1 AS INT) AS depth
    FROM h WHERE anchor IS NULL OR seq >= anchor""".replace("AS STRING", "AS VARCHAR"))
def heading_dense_rank(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("celex"), F.col("turn").alias("seq"), F.expr(_CSS).alias("css"), F.expr(_HEAD).alias("text"))
    return judgments.heading_depths(rows).select("celex", "seq", "text", "depth")


_CITING = """CASE l_linenumber % 5 WHEN 0 THEN concat('Article ', {0}, ' of the Privacy Shield Decision and Article ', {1}, '(1) of the GDPR, Articles 7, 8 and ', {0}, ' of the Charter')
    WHEN 1 THEN concat('Articles ', {0}, ' to ', {1}, ' of the GDPR') WHEN 2 THEN concat('Articles ', {0}, ' and ', {1}, ' of Regulation (EU) 2016/679 and Article ', {2}, '(8) of that regulation')
    WHEN 3 THEN concat('Article ', {0}, ', ', {1}, ' and ', {2}, '(2)(a) of  the Regulation No 2016/679') ELSE concat('nothing of article ', {0}) END""".format("CAST(l_partkey % 99 AS STRING)", "CAST(l_suppkey % 99 AS STRING)", "CAST(l_orderkey % 99 AS STRING)")


@query(rf"""WITH t AS (SELECT DISTINCT {_CITING} AS txt FROM lineitem),
    p AS (SELECT txt, unnest(string_split_regex(lower(txt), '\barticles?\s+')[2:]) AS p FROM t),
    h AS (SELECT txt, trim(split_part(p, ' of ', 1)) AS listed, ltrim(replace(replace(regexp_replace(substr(p, strpos(p, ' of ') + 4), '\s+', ' ', 'g'), '(eu) ', ''), ' no ', ' ')) AS owner FROM p WHERE contains(p, ' of ')),
    own AS (SELECT txt, list_transform(string_split(replace(regexp_replace(listed, '\([^)]*\)', '', 'g'), ' and ', ','), ','), lambda x: trim(x)) AS ns FROM h
        JOIN (VALUES ('the gdpr'), ('that regulation'), ('regulation 2016/679'), ('the regulation 2016/679')) f(form) ON starts_with(owner, form)),
    n AS (SELECT txt, unnest(ns) AS n FROM own WHERE len(list_filter(ns, lambda x: NOT regexp_full_match(x, '\d+'))) = 0)
    SELECT txt AS text, coalesce(list(DISTINCT '32016R0679art_' || CAST(n AS INT) ORDER BY '32016R0679art_' || CAST(n AS INT)) FILTER (n IS NOT NULL), []) AS cited FROM t LEFT JOIN n USING (txt) GROUP BY txt""")
def citation_extract(spark, d):
    rows = t(spark, d, "lineitem").select(F.expr(_CITING).alias("text")).distinct().withColumn("celex", F.lit("32016R0679"))
    forms = spark.createDataFrame([("32016R0679", legal.surface_forms("32016R0679"))], "celex string, forms array<string>")
    joined = rows.join(F.broadcast(forms), "celex")  # one row an act of the catalogue
    return joined.select("text", F.array_sort(legal.cited_articles(F.col("text"), F.col("celex"), F.col("forms"))).alias("cited"))


_REFS = """concat('See Article ', CAST(o_orderkey % 60 AS STRING), ' and article ', CAST(o_custkey % 60 AS STRING), ', Articles ', CAST(o_custkey % 50 AS STRING), ' to ', CAST(o_orderkey % 55 AS STRING), ' and Art. ', CAST(o_custkey % 7 AS STRING), CASE WHEN o_custkey % 2 = 0 THEN ', Articles 5 and 6' ELSE '' END)"""


@query(f"""WITH t AS (SELECT DISTINCT {_REFS} AS txt FROM orders),
    p AS (SELECT txt, list_transform(list_concat(regexp_extract_all(txt, '(?i)\\bArticle\\s+(\\d+)', 1), regexp_extract_all(txt, '(?i)\\bArt\\.\\s+(\\d+)', 1)), lambda x: CAST(x AS INT)) AS ones,
        regexp_extract_all(txt, '(?i)\\bArticles\\s+(\\d+)\\s+to\\s+(\\d+)', 1) AS a, regexp_extract_all(txt, '(?i)\\bArticles\\s+(\\d+)\\s+to\\s+(\\d+)', 2) AS b FROM t)
    SELECT txt AS text, list_sort(list_distinct(list_concat(ones, flatten(list_transform(list_zip(a, b), lambda z: CAST(range(CAST(z[1] AS INT), CAST(z[2] AS INT) + 1) AS INT[])))))) AS refs FROM p""".replace("\\\\", "\\"))
def article_references(spark, d):
    return t(spark, d, "orders").select(F.expr(_REFS).alias("text")).distinct().select("text", legal.article_references(F.col("text")).alias("refs"))


_CELEX = """concat('3', CAST(1992 + o_orderkey % 31 AS STRING), CASE o_custkey % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'L' WHEN 2 THEN 'D' WHEN 3 THEN 'CJ' ELSE '' END, CASE WHEN o_custkey % 2 = 0 THEN '0' ELSE '' END, CAST(o_orderkey AS STRING))"""


@query(f"""WITH t AS (SELECT DISTINCT {_CELEX} AS c FROM orders), p AS (SELECT c, regexp_extract(c, '^(\\d)(\\d{{4}})([A-Z]+)(\\d+)$', 2) AS y, regexp_extract(c, '^(\\d)(\\d{{4}})([A-Z]+)(\\d+)$', 3) AS i, regexp_extract(c, '^(\\d)(\\d{{4}})([A-Z]+)(\\d+)$', 4) AS n FROM t)
    SELECT c AS celex, CASE i WHEN 'R' THEN 'Regulation' WHEN 'L' THEN 'Directive' WHEN 'D' THEN 'Decision' END AS instrument,
        CASE WHEN i IN ('R', 'L', 'D') THEN CASE WHEN CAST(y AS INT) < 2000 THEN [y || '/' || ltrim(n, '0'), y[3:4] || '/' || ltrim(n, '0')] ELSE [y || '/' || ltrim(n, '0')] END END AS numbers FROM p""".replace("\\\\", "\\"))
def celex_decompose(spark, d):
    rows = t(spark, d, "orders").select(F.expr(_CELEX).alias("celex")).distinct().withColumn("p", legal.celex_parts(F.col("celex")))
    return rows.select("celex", "p.instrument", "p.numbers")


_CASE = """concat(CASE WHEN o_custkey % 9 = 0 THEN '3' ELSE '6' END, CAST(1992 + o_orderkey % 31 AS STRING), CASE o_custkey % 4 WHEN 0 THEN 'CJ' WHEN 1 THEN 'TJ' WHEN 2 THEN 'CO' ELSE 'FJ' END, CAST(o_orderkey AS STRING))"""


@query(f"""WITH t AS (SELECT DISTINCT {_CASE} AS c FROM orders)
    SELECT c AS celex, CASE WHEN regexp_matches(c, '^6[0-9]{{4}}(C|T)[A-Z][0-9]{{4}}$') THEN c[6:6] || '-' || CAST(CAST(c[8:11] AS INT) AS VARCHAR) || '/' || c[4:5] ELSE c END AS case_number FROM t""")
def case_number(spark, d):
    return t(spark, d, "orders").select(F.expr(_CASE).alias("celex")).distinct().select("celex", legal.case_number(F.col("celex")).alias("case_number"))


@query("""WITH t AS (SELECT unnest(['A' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), 'A' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || 'P' || n_regionkey, 'A' || n_nationkey || 'PT' || (n_nationkey * 7), 'CH' || n_regionkey, lower(n_name)]) AS ref FROM nation),
    p AS (SELECT ref, TRY_CAST(regexp_extract(ref, '^A([0-9]+)', 1) AS INT) AS a, coalesce(TRY_CAST(regexp_extract(ref, 'PT([0-9]+)$', 1) AS INT), TRY_CAST(regexp_extract(ref, 'P([0-9]+)$', 1) AS INT)) AS n FROM t)
    SELECT ref, CASE WHEN starts_with(ref, 'CH') THEN ref END AS chapter, CASE WHEN a > 0 THEN 'art_' || a END AS article,
        CASE WHEN n IS NOT NULL AND a IS NOT NULL THEN printf('%03d', a) || '.' || printf('%03d', n) END AS paragraph FROM p""")
def ref_normalise(spark, d):
    key, region = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    two = F.concat(F.lit("A"), F.lpad(key, 2, "0"))
    refs = F.array(two, F.concat(two, F.lit("P"), region), F.concat(F.lit("A"), key, F.lit("PT"), (F.col("n_nationkey") * 7).cast("string")), F.concat(F.lit("CH"), region), F.lower("n_name"))
    rows = t(spark, d, "nation").select(F.explode(refs).alias("ref")).withColumn("p", legal.normalise_reference(F.col("ref")))
    return rows.select("ref", "p.*")


_KEYWORDS = ", ".join(f"({i}, '{k}', '{c}')" for i, (k, c) in enumerate(legal.ACT_KEYWORDS))
_ASKED = """concat(CASE WHEN o_orderkey % 2 = 0 THEN 'What does the Data Governance Act say' ELSE 'corporate' END, CASE o_orderkey % 3 WHEN 0 THEN ' of the GDPR?' WHEN 1 THEN ' governance and 2023/2854' ELSE '' END, CASE o_custkey % 4 WHEN 0 THEN ' AI Act or Data Act' WHEN 1 THEN ' 2024/1689' ELSE '' END)"""


@query(f"""WITH q AS (SELECT o_orderkey AS id, {_ASKED} AS txt FROM orders), k(o, word, celex) AS (VALUES {_KEYWORDS}),
    m AS (SELECT id, celex, min(o) AS o FROM q JOIN k ON contains(lower(txt), word) GROUP BY ALL)
    SELECT q.id, (SELECT list(celex ORDER BY o) FROM m WHERE m.id = q.id) AS acts, (SELECT celex FROM m WHERE m.id = q.id ORDER BY o LIMIT 1) AS first_act FROM q""")
def act_keywords(spark, d):
    acts = legal.acts_in(F.col("text"))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_ASKED).alias("text")).select("id", F.when(F.size(acts) > 0, acts).alias("acts"), legal.act_of(F.col("text")).alias("first_act"))


@query(f"""WITH k(o, word, celex) AS (VALUES {_KEYWORDS}),
    q AS (SELECT conv_id AS id, turn, coalesce(text, '') || CASE turn % 4 WHEN 0 THEN ' of the Data Act' WHEN 1 THEN ' GDPR' ELSE '' END AS txt FROM conversations),
    s AS (SELECT id, turn, celex, ((id * m + turn * 11) % 10) / 10.0::DOUBLE AS score FROM q, (VALUES ('32016R0679', 7), ('32022R0868', 5), ('32023R2854', 3), ('32024R1689', 2)) c(celex, m)),
    named AS (SELECT id, turn, celex, 1000 + min(o) AS o FROM q JOIN k ON contains(lower(txt), word) GROUP BY ALL),
    every AS (SELECT id, turn, celex, row_number() OVER (PARTITION BY id, turn ORDER BY score DESC, celex) AS o FROM s WHERE score >= 0.4 UNION ALL SELECT * FROM named),
    once AS (SELECT id, turn, celex, min(o) AS o FROM every GROUP BY ALL)
    SELECT q.id, q.turn, coalesce((list(celex ORDER BY o) FILTER (celex IS NOT NULL))[1:3], []) AS acts FROM q LEFT JOIN once USING (id, turn) GROUP BY q.id, q.turn""")
def act_select(spark, d):
    more = F.when(F.col("turn") % 4 == 0, " of the Data Act").when(F.col("turn") % 4 == 1, " GDPR").otherwise("")
    score = lambda m: ((F.col("conv_id") * m + F.col("turn") * 11) % 10) / F.lit(10.0)
    scores = F.array(*(F.struct(F.lit(c).alias("celex"), score(m).alias("score")) for c, m in (("32016R0679", 7), ("32022R0868", 5), ("32023R2854", 3), ("32024R1689", 2))))
    return t(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", legal.select_acts(scores, F.concat(F.coalesce("text", F.lit("")), more)).alias("acts"))


@query("""WITH n(celex, name) AS (VALUES ('32022R0868', 'Data Governance Act'), ('32023R2854', 'Data Act'), ('32024R1689', 'AI Act'), ('32016R0679', 'GDPR'), ('32000L0031', '32000L0031')),
    i AS (SELECT celex, name, c_custkey AS k, c_nationkey AS m FROM customer JOIN n ON true),
    s AS (SELECT celex || 'art_' || k AS id, name || ', Article ' || k AS shown FROM i UNION ALL SELECT celex || 'rct_' || k, name || ', Recital ' || k FROM i
        UNION ALL SELECT celex || '_' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '.' || m, name || ', Article ' || (k % 1000) || CASE WHEN m = 0 THEN '' ELSE '(' || m || ')' END FROM i
        UNION ALL SELECT '62019CJ0645_par_' || k, '62019CJ0645_par_' || k FROM i) SELECT DISTINCT id, shown FROM s""")
def id_display(spark, d):
    """Keys are made distinct, dealt by key, before ids are made of them: ids of different keys differ.

    Only paragraphs, of a few thousand, can be alike once more; a null id is one of these.
    """
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("m"))
    of_acts = lambda *parts: F.transform(F.array(*(F.lit(c) for c in (*legal.ACT_NAMES, "32000L0031"))), lambda c: F.concat(c, *parts))
    k = F.col("k").cast("string")
    whole = rows.select("k").where("k is not null").repartition("k").distinct().select(F.explode(F.concat(of_acts(F.lit("art_"), k), of_acts(F.lit("rct_"), k), F.array(F.concat(F.lit("62019CJ0645_par_"), k)))).alias("id"))
    part = rows.select((F.col("k") % 1000).alias("k"), "m").distinct().select(F.explode(of_acts(F.lit("_"), F.lpad(k, 3, "0"), F.lit("."), F.col("m"))).alias("id")).distinct()
    return whole.unionByName(part).select("id", legal.pretty_id(F.col("id")).alias("shown"))


# --- answers and evaluation ----------------------------------------------------------


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """source and its metrics: its ten longest labelled documents as the ranked list, its good ones as expected.

    The ten are the best of each task's ten; how many are expected is counted,
    and only what was found of them is met.
    """
    rows = t(spark, d, "documents").select("doc_id", "source", "n_chars").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    top = retrieval.top_k(rows, 10, ("source",), "n_chars", "doc_id").select(F.col("source").alias("_s"), F.col("rank").alias("r"), "doc_id", "quality")
    found = top.groupBy("_s").agg(F.array_sort(F.collect_list(F.struct("r", "doc_id", "quality"))).alias("_top"))
    n = rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("n_expected"))
    good = F.transform(F.filter("_top", lambda x: x["quality"] == 1), lambda x: x["doc_id"])
    met = n.join(found, F.col("source").eqNullSafe(F.col("_s"))).select("source", evaluation.ir_metrics(F.transform("_top", lambda x: x["doc_id"]), good, F.col("n_expected")).alias("m"))
    return met.select("source", "m.*")


_RANKED = """r AS (SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id)),
    lists AS (SELECT source, coalesce(list(doc_id ORDER BY r) FILTER (r <= 10), []) AS s, coalesce(list(doc_id) FILTER (quality = 1), []) AS e FROM r GROUP BY source),
    ir AS (SELECT source, CASE WHEN list_contains(e, s[1]) THEN 1.0 ELSE 0.0 END AS top1_anchor,
        CASE WHEN len(e) = 0 THEN 0.0 ELSE len(list_intersect(s, e)) / len(e)::DOUBLE END AS recall_at_k,
        coalesce(1.0 / list_min(list_filter(list_transform(s, lambda x, i: CASE WHEN list_contains(e, x) THEN i END), lambda i: i IS NOT NULL)), 0.0) AS mrr FROM lists)"""


@query(f"WITH {_RANKED} SELECT source, CAST(top1_anchor AS DOUBLE) AS top1_anchor, round(recall_at_k, 6) AS recall_at_k, round(mrr, 6) AS mrr FROM ir")
def ir_metrics(spark, d):
    return _ranked(spark, d).select("source", "top1_anchor", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {_RANKED} SELECT CASE WHEN grouping(source) = 1 THEN '(all)' ELSE source END AS source, count(*) AS n, round(avg(top1_anchor), 6) AS top1_anchor, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr
    FROM ir GROUP BY ROLLUP (source)""")
def metric_rollup(spark, d):
    return evaluation.averages(_ranked(spark, d), ["top1_anchor", "recall_at_k", "mrr"], "source")


@query("""WITH c AS (SELECT source, count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality = 0 AND n_chars > 1000) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn
        FROM documents JOIN labels USING (doc_id) GROUP BY source),
    p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM c)
    SELECT source, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM p""")
def prf1(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", "n_chars").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    good, found = F.col("quality") == 1, F.col("n_chars") > 1000
    counts = rows.groupBy("source").agg(F.count_if(good & found).alias("tp"), F.count_if(~good & found).alias("fp"), F.count_if(good & ~found).alias("fn"))
    m = counts.withColumn("m", evaluation.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return m.select("source", "tp", "fp", "fn", *(F.round(f"m.{c}", 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""SELECT answer, round(avg(v), 6) AS faithfulness, count(*) AS statements FROM (
    SELECT l_orderkey AS answer, l_linenumber AS statement, max(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) AS v FROM lineitem GROUP BY ALL) GROUP BY answer""")
def faithfulness_any(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("statement"), F.col("l_suppkey").alias("doc"), (F.col("l_quantity") > 25).cast("int").alias("verdict"), F.col("l_returnflag").alias("reason"))
    return evaluation.faithfulness(rows).select("answer", F.round("faithfulness", 6).alias("faithfulness"), "statements")


@query("""WITH s AS (SELECT conv_id AS answer, turn AS pos, 'S' || CAST(1 + turn * 7 % 5 AS VARCHAR) AS marker FROM conversations),
    f AS (SELECT answer, marker, min(pos) AS place FROM s WHERE marker IN ('S1', 'S2', 'S3', 'S4') GROUP BY ALL),
    m AS (SELECT answer, marker, 'S' || row_number() OVER (PARTITION BY answer ORDER BY place) AS new FROM f)
    SELECT s.answer, s.pos, CASE WHEN m.new IS NOT NULL THEN [m.new] WHEN EXISTS (SELECT 1 FROM m x WHERE x.answer = s.answer) THEN CAST([] AS VARCHAR[]) ELSE [s.marker] END AS markers
    FROM s LEFT JOIN m USING (answer, marker)""")
def attribution_renumber(spark, d):
    rows = t(spark, d, "conversations")
    segments = rows.select(F.col("conv_id").alias("answer"), F.col("turn").alias("pos"), F.array(F.concat(F.lit("S"), (1 + F.col("turn") * 7 % 5).cast("string"))).alias("markers"))
    sources = rows.select(F.col("conv_id").alias("answer")).distinct().select("answer", F.explode(F.array(*(F.lit(f"S{i}") for i in range(1, 5)))).alias("marker")).withColumn("id", F.col("marker"))
    return answers.renumber(segments, sources)[0]


@query("SELECT source AS answer, doc_id AS id, 'S' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS marker FROM documents")
def source_numbering(spark, d):
    rows = t(spark, d, "documents").select(F.col("source").alias("answer"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"))
    return answers.number_sources(rows, wide=True).select("answer", F.col("pos").alias("id"), "marker")


@query("""WITH p AS (SELECT p_brand AS name, p_type AS version, p_size > 45 AS active FROM part)
    SELECT name, 'active' AS problem, count(*) FILTER (active) AS n FROM p GROUP BY name HAVING count(*) FILTER (active) <> 1
    UNION ALL SELECT name, 'duplicate ' || version, count(*) FROM p GROUP BY name, version HAVING count(*) > 1""")
def prompt_active_check(spark, d):
    return answers.prompt_problems(t(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("version"), (F.col("p_size") > 45).alias("active")))


# --- events --------------------------------------------------------------------------


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW), 6) AS in_window FROM events")
def token_window(spark, d):
    rows = t(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return windows.trailing_sum(rows, ["user_id"], "ts", "value").select("event_id", F.round("in_window", 6).alias("in_window"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    rows = windows.tumbling(t(spark, d, "events").select("ts", "event_type", "value"), "ts", "1 hour", ["event_type"])
    return rows.withColumn("total", F.round("total", 6))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, g""")
def event_sessions(spark, d):
    return windows.sessions(t(spark, d, "events").select("ts", "user_id"), "ts", "30 minutes", ["user_id"])
