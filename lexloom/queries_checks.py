"""Smaller operators bound to tables, with their DuckDB SQL: topic links, updates, ids, views, counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import legal
from lexloom.operators import evaluation, graph, topics
from lexloom.plans import answering

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("""SELECT DISTINCT doc_id AS paragraph_id, label FROM (SELECT doc_id, unnest([lang, source]) AS label FROM documents)
    WHERE label IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels)""")
def topic_links(spark, d):
    tagged = t(spark, d, "documents").select(F.col("doc_id").alias("paragraph_id"), F.array("lang", "source", F.lit(None).cast("string")).alias("topics"))
    return graph.link_topics(tagged, t(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT source AS label FROM documents WHERE doc_id % 2 = 0 AND source IS NOT NULL UNION SELECT lang FROM documents WHERE lang IS NOT NULL")
def topic_upsert(spark, d):
    docs = t(spark, d, "documents")
    return graph.topic_nodes(docs.where("doc_id % 2 = 0").select(F.col("source").alias("label")), docs.select(F.col("doc_id").alias("paragraph_id"), F.col("lang").alias("label")))


@query("""SELECT c_custkey, c_name, coalesce(m, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS m FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def summary_update(spark, d):
    new = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"))
    return graph.update_by_key(t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), new, ["c_custkey"], "c_mktsegment")


@query("SELECT client_id, source, email FROM clients WHERE email IS NULL")
def null_scan(spark, d):
    return graph.missing(t(spark, d, "clients").select("client_id", "source", "email"), "email")


_ID = "concat(CASE o_custkey % 4 WHEN 0 THEN '3' WHEN 1 THEN '6' WHEN 2 THEN 'x' ELSE '' END, CAST(1990 + o_orderkey % 30 AS STRING), CASE o_custkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'cj' ELSE '_' END, CAST(o_orderkey AS STRING), '_par_', CAST(o_custkey AS STRING))"


@query(f"SELECT DISTINCT id, nullif(regexp_extract(id, '^([0-9]+[A-Za-z]+[0-9]+)', 1), '') AS celex FROM (SELECT {_ID} AS id FROM orders)".replace("AS STRING", "AS VARCHAR"))
def celex_of_ids(spark, d):
    return t(spark, d, "orders").select(F.expr(_ID).alias("id")).distinct().select("id", legal.celex_of_id(F.col("id")).alias("celex"))


_PASSAGE = "concat('of ', coalesce(source, ''), chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('id: ', lang, CAST(doc_id AS STRING), ' x', chr(10)) ELSE '' END, coalesce(text, ''))"


@query(f"""SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'meta' || doc_id END, nullif(split_part(split_part(p, chr(10) || 'id: ', 2), ' ', 1), ''), p[1:80]) AS id
    FROM (SELECT doc_id, {_PASSAGE} AS p FROM documents WHERE NOT contains(coalesce(text, ''), chr(10) || 'id:'))""".replace("AS STRING", "AS VARCHAR"))
def document_ids(spark, d):
    meta = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("meta"), F.col("doc_id").cast("string")))
    rows = t(spark, d, "documents").where(~F.contains(F.coalesce("text", F.lit("")), F.lit("\nid:")))
    return rows.select("doc_id", legal.document_id(meta, F.expr(_PASSAGE)).alias("id"))


@query("""SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN doc_id % 7 > 0 THEN concat(lang, ' | ', source, '||', doc_id, '| ') END, '|'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents WHERE doc_id % 7 > 0
    UNION ALL SELECT doc_id, [] FROM documents WHERE doc_id % 7 = 0""")
def pipe_split(spark, d):
    lang, source = (F.coalesce(c, F.lit("")) for c in ("lang", "source"))
    cell = F.when(F.col("doc_id") % 7 > 0, F.concat(lang, F.lit(" | "), source, F.lit("||"), F.col("doc_id").cast("string"), F.lit("| ")))
    return t(spark, d, "documents").select("doc_id", legal.split_pipe(cell).alias("parts"))


@query("""SELECT source AS act, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS question, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS "row"
    FROM documents WHERE source = 'src1' AND n_chars >= 900""")
def act_view(spark, d):
    rows = t(spark, d, "documents").select(F.col("source").alias("act"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("question"), "n_chars")
    return answering.view(rows, "src1", "n_chars", 900)


@query("SELECT CAST(label AS VARCHAR) AS label, list_sort(list(DISTINCT vec_id % 700)) AS chunks FROM embeddings GROUP BY ALL")
def concept_chunks(spark, d):
    return topics.chunk_index(t(spark, d, "embeddings").select(F.col("label").cast("string").alias("label"), (F.col("vec_id") % 700).alias("chunk")))


@query("SELECT DISTINCT source AS label, doc_id % 2 = 0 AND source IN (SELECT source FROM documents WHERE n_chars > 15000) AS active, doc_id % 2 AS half FROM documents")
def unused_concepts(spark, d):
    docs = t(spark, d, "documents")
    concepts = docs.select(F.col("source").alias("label"), (F.col("doc_id") % 2 == 0).alias("active"), (F.col("doc_id") % 2).alias("half")).distinct()
    return topics.deactivate_unused(concepts, docs.where("n_chars > 15000").select(F.col("source").alias("label"))).select("label", "active", "half")


@query("""WITH r AS (SELECT o_orderpriority AS expected, CASE o_custkey % 4 WHEN 0 THEN [] WHEN 1 THEN [o_orderpriority] WHEN 2 THEN [o_orderpriority, 'x'] ELSE ['x'] END AS p FROM orders),
    m AS (SELECT expected, CASE WHEN list_contains(p, expected) THEN 1.0 ELSE 0.0 END AS d, CASE WHEN p = [expected] THEN 1.0 ELSE 0.0 END AS e, CASE WHEN len(p) = 0 THEN 1.0 ELSE 0.0 END AS a FROM r)
    SELECT CASE WHEN grouping(expected) = 1 THEN '(all)' ELSE expected END AS expected, count(*) AS n, round(avg(d), 6) AS detected, round(avg(e), 6) AS exact, round(avg(a), 6) AS abstained FROM m GROUP BY ROLLUP (expected)""")
def act_accuracy(spark, d):
    p, k = F.col("o_orderpriority"), F.col("o_custkey") % 4
    none = F.array().cast("array<string>")
    predicted = F.when(k == 0, none).when(k == 1, F.array(p)).when(k == 2, F.array(p, F.lit("x"))).otherwise(F.array(F.lit("x")))
    return evaluation.act_accuracy(t(spark, d, "orders").select(p.alias("expected"), predicted.alias("predicted")))


_ANSWER = """concat('By Article ', CAST(l_partkey % 90 AS STRING), CASE l_linenumber % 6 WHEN 0 THEN ' of Directive 95/46' WHEN 1 THEN ', of the Regulation (EU) 2022/868' WHEN 2 THEN '(2) of that Directive' WHEN 3 THEN ' of that regulation'
    WHEN 4 THEN ' of Regulation No 1/2003' ELSE ' and Recital 7 of the Regulation' END, ' and articles ', CAST(l_suppkey % 90 AS STRING), ' (Recitals ', CAST(l_orderkey % 40 AS STRING), ', of the directive), see Recital ', CAST(l_partkey % 40 AS STRING))"""


@query(rf"""WITH a AS (SELECT DISTINCT {_ANSWER} AS txt FROM lineitem),
    cut AS (SELECT txt, mark, unnest(ps[2:]) AS p FROM (SELECT txt, 'art_' AS mark, string_split_regex(lower(txt), '\barticles? ') AS ps FROM a UNION ALL SELECT txt, 'rct_', string_split_regex(lower(txt), '\brecitals? ') FROM a)),
    told AS (SELECT txt, mark, CAST(regexp_extract(p, '^([0-9]+)', 1) AS INTEGER) AS n, regexp_replace(p, '^[0-9]+', '') AS rest FROM cut WHERE regexp_matches(p, '^[0-9]')),
    w AS (SELECT *, list_filter(string_split_regex(rest, '[ ,]+'), lambda x: x <> '') AS w FROM told),
    k AS (SELECT *, CASE WHEN w[2] IN ('that', 'the') THEN 3 ELSE 2 END AS k FROM w),
    own AS (SELECT txt, '32016R0679' || mark || n AS id FROM k
        WHERE NOT coalesce(left(rest, 1) IN (' ', ',') AND w[1] = 'of' AND (starts_with(w[k], 'directive') OR (w[k] = 'regulation' AND (w[k + 1] IN ('(eu)', '(ec)', 'no') OR left(w[k + 1], 1) BETWEEN '0' AND '9'))), false))
    SELECT txt AS text, coalesce(list(DISTINCT id ORDER BY id) FILTER (id IS NOT NULL), []) AS ids FROM a LEFT JOIN own USING (txt) GROUP BY txt""".replace("AS STRING", "AS VARCHAR"))
def expected_ids(spark, d):
    rows = t(spark, d, "lineitem").select(F.expr(_ANSWER).alias("text")).distinct()
    return rows.select("text", legal.expected_ids(F.col("text"), F.lit("32016R0679")).alias("ids"))
