"""Whole plans bound to tables, with their DuckDB SQL.

Sources are acts, documents articles, benchmark items questions and (as texts)
recitals; conversations are judgments, a turn a paragraph, each interpreting
one act.  Questions of even number ask for case law.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import legal
from lexloom.plans import answering
from lexloom.plans.retrieval import HybridConfig, Store, hybrid
from lexloom.session import cut

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


def _act(key: str) -> Column:
    return F.concat(F.lit("src"), (F.expr(key) % 20).cast("string"))


def store(spark: SparkSession, d: str) -> Store:
    r = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    vectors = r("embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    null = F.lit(None).cast("string")
    articles = r("documents").join(vectors, F.col("doc_id") == F.col("_v"), "left")
    articles = articles.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), F.col("source").alias("act"), "text", F.col("lang").alias("title"), null.alias("chapter_number"), null.alias("chapter_title"), "embedding")
    recitals = r("benchmark").select(F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("doc"), _act("item_id").alias("act"), "text")
    case = F.concat(F.lit("V"), F.col("conv_id").cast("string"))
    turns = r("conversations")
    passages = turns.select(F.concat(case, F.lit("_par_"), (F.col("turn") + 1).cast("string")).alias("doc"), case.alias("celex"), (F.col("turn") + 1).cast("int").alias("number"), "text", F.col("role").alias("section_heading"), null.alias("case_number"), F.lit(False).alias("is_operative"), F.lit(None).cast("array<float>").alias("embedding"))
    return Store(articles, recitals, passages, turns.select(case.alias("celex"), _act("conv_id").alias("act")).distinct())


def questions(spark: SparkSession, d: str) -> DataFrame:
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("query_vector"))
    asked = spark.read.parquet(f"{d}/benchmark.parquet").join(vectors, F.col("item_id") == F.col("_v"), "left")
    intent = F.when(F.col("item_id") % 2 == 0, "INTERPRETIVE").otherwise("DEFINITIONAL")
    return asked.select(F.col("item_id").alias("query_id"), "text", F.array(_act("item_id"), _act("item_id + 7")).alias("acts"), intent.alias("intent"), "query_vector")


_TOKENS = "list_filter(string_split_regex(coalesce({0}, ''), '\\s+'), lambda x: x <> '')"


def _bm25(name: str, docs: str, asked: str, k: int) -> str:
    """CTEs that end in `name`: query_id, doc, rank of the k best by BM25 of docs (sc, doc, ts), asked (query_id, sc, text)."""
    return f"""{name}_p AS (SELECT sc, doc, term, count(*) AS tf FROM (SELECT sc, doc, unnest(ts) AS term FROM {docs}) GROUP BY ALL),
    {name}_n AS (SELECT sc, count(*) AS n_docs, avg(len(ts)) AS avgdl FROM {docs} GROUP BY sc),
    {name}_r AS (SELECT sc, term, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS r FROM {name}_p JOIN {name}_n USING (sc) GROUP BY sc, term, n_docs),
    {name}_m AS (SELECT sc, avg(r) AS m FROM {name}_r GROUP BY sc),
    {name}_i AS (SELECT sc, term, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM {name}_r JOIN {name}_m USING (sc)),
    {name}_q AS (SELECT query_id, sc, term, count(*) AS qf FROM (SELECT query_id, sc, unnest({_TOKENS.format('text')}) AS term FROM {asked}) GROUP BY ALL),
    {name}_s AS (SELECT query_id, doc, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))), 6) AS s
        FROM {name}_q JOIN {name}_p USING (sc, term) JOIN {name}_i USING (sc, term) JOIN {docs} USING (sc, doc) JOIN {name}_n USING (sc) GROUP BY ALL),
    {name} AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc) AS rank FROM {name}_s QUALIFY rank <= {k})"""


_HYBRID = f"""q AS (SELECT item_id AS query_id, text, list_sort(list_distinct(['src' || item_id % 20, 'src' || (item_id + 7) % 20])) AS sc FROM benchmark),
    scopes AS (SELECT DISTINCT sc FROM q),
    art AS (SELECT sc, 'd' || doc_id AS doc, {_TOKENS.format('text')} AS ts FROM documents JOIN scopes ON list_contains(sc, source)),
    rec AS (SELECT sc, 'r' || item_id AS doc, {_TOKENS.format('text')} AS ts FROM benchmark JOIN scopes ON list_contains(sc, 'src' || item_id % 20)),
    pas AS (SELECT sc, 'V' || conv_id || '_par_' || (turn + 1) AS doc, {_TOKENS.format('text')} AS ts FROM conversations JOIN scopes ON list_contains(sc, 'src' || conv_id % 20)),
    inter AS (SELECT * FROM q WHERE query_id % 2 = 0),
    {_bm25('sparse', 'art', 'q', 10)}, {_bm25('recital', 'rec', 'q', 4)}, {_bm25('passage', 'pas', 'inter', 10)},
    near AS (SELECT a.vec_id AS query_id, b.vec_id AS v, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, 'd' || b.vec_id) AS r
        FROM embeddings a JOIN embeddings b ON b.vec_id IN (SELECT doc_id FROM documents) WHERE a.vec_id IN (SELECT item_id FROM benchmark) QUALIFY r <= 10),
    dense AS (SELECT query_id, 'd' || v AS doc, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM near JOIN q USING (query_id) JOIN documents ON v = doc_id AND list_contains(sc, source)),
    fused AS (SELECT query_id, doc, sum(1.0::DOUBLE / (60.0 + rank)) AS s FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse) GROUP BY ALL),
    pool AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc) AS r FROM fused QUALIFY r <= 10),
    article AS (SELECT query_id, doc, CAST(count(*) OVER (PARTITION BY query_id) - r + 1 AS DOUBLE) AS score, r AS rank FROM pool QUALIFY r <= 5),
    rpool AS (SELECT query_id, doc, CAST(count(*) OVER (PARTITION BY query_id) - rank + 1 AS DOUBLE) AS score, rank FROM recital QUALIFY rank <= 2),
    cpool AS (SELECT query_id, doc, rank FROM passage WHERE rank <= 9),
    cscored AS (SELECT query_id, doc, CAST(count(*) OVER (PARTITION BY query_id) - rank + 1 AS DOUBLE) AS score, rank FROM cpool),
    cnear AS (SELECT DISTINCT c.query_id, split_part(c.doc, '_par_', 1) || '_par_' || n AS doc FROM cscored c, LATERAL (SELECT CAST(split_part(c.doc, '_par_', 2) AS INT) + unnest([-1, 1, 2]) AS n) WHERE c.rank <= 3
        AND split_part(c.doc, '_par_', 1) || '_par_' || n IN (SELECT 'V' || conv_id || '_par_' || (turn + 1) FROM conversations)),
    cmore AS (SELECT query_id, doc FROM cnear ANTI JOIN cscored USING (query_id, doc)),
    cextra AS (SELECT query_id, doc, CAST(count(*) OVER (PARTITION BY query_id) - row_number() OVER (PARTITION BY query_id ORDER BY doc) + 1 AS DOUBLE) AS score FROM cmore),
    ckept AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM (SELECT query_id, doc, score FROM cscored UNION ALL SELECT * FROM cextra) QUALIFY rank <= 3)"""


@query(f"""WITH {_HYBRID}
    SELECT query_id, 'article' AS slot, rank, doc, score, '[' || source || ', ' || coalesce(lang, '') || ']' AS header FROM article JOIN documents ON doc = 'd' || doc_id
    UNION ALL SELECT query_id, 'recital', rank, doc, score, '[src' || item_id % 20 || ', Recital]' FROM rpool JOIN benchmark ON doc = 'r' || item_id
    UNION ALL SELECT query_id, 'case law', rank, doc, score, '[V' || conv_id || ', ' || role || ', para. ' || (turn + 1) || ']' FROM ckept JOIN conversations ON doc = 'V' || conv_id || '_par_' || (turn + 1)""")
def hybrid_full(spark, d):
    found = hybrid(store(spark, d), questions(spark, d), HybridConfig())
    return found.select("query_id", "slot", "rank", "doc", "score", F.substring_index("text", "\n", 1).alias("header"))


def ruled_store(spark: SparkSession, d: str) -> Store:
    """The store with a ruling at the end of every judgment, and a vector for each passage."""
    plain = store(spark, d)
    case = F.concat(F.lit("V"), F.col("conv_id").cast("string"))
    last = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
    turns = spark.read.parquet(f"{d}/conversations.parquet").withColumn("is_operative", last).withColumn("_n", (F.col("conv_id") * 13 + F.col("turn") * 7) % 500)
    turns = turns.join(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"), F.col("_n") == F.col("vec_id"), "left")
    number = F.when(F.col("is_operative"), 1).otherwise((F.col("turn") + 1).cast("int"))
    doc = F.concat(case, F.when(F.col("is_operative"), "_op_").otherwise("_par_"), number.cast("string"))
    passages = turns.select(doc.alias("doc"), case.alias("celex"), number.alias("number"), "text", F.col("role").alias("section_heading"), F.lit(None).cast("string").alias("case_number"), "is_operative", "embedding")
    return Store(plain.articles, plain.recitals, passages, plain.interprets)


@query(f"""WITH q AS (SELECT item_id AS query_id, text, list_sort(list_distinct(['src' || item_id % 20, 'src' || (item_id + 7) % 20])) AS sc FROM benchmark),
    inter AS (SELECT * FROM q WHERE query_id % 2 = 0),
    own AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS op FROM conversations),
    p AS (SELECT conv_id, role, text, op, 'V' || conv_id || CASE WHEN op THEN '_op_1' ELSE '_par_' || (turn + 1) END AS doc, turn + 1 AS number, (conv_id * 13 + turn * 7) % 500 AS v FROM own),
    pas AS (SELECT sc, doc, {_TOKENS.format('text')} AS ts FROM p JOIN (SELECT DISTINCT sc FROM q) ON list_contains(sc, 'src' || conv_id % 20)),
    {_bm25('passage', 'pas', 'inter', 10)},
    near AS (SELECT query_id, sc, doc, conv_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, doc) AS r
        FROM inter JOIN embeddings a ON a.vec_id = query_id, p JOIN embeddings b ON b.vec_id = v QUALIFY r <= 10),
    dense AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM near WHERE list_contains(sc, 'src' || conv_id % 20)),
    fused AS (SELECT query_id, doc, sum(1.0::DOUBLE / (60.0 + rank)) AS s FROM (SELECT * FROM dense UNION ALL SELECT query_id, doc, rank FROM passage) GROUP BY ALL),
    pool AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc) AS r FROM fused QUALIFY r <= 9),
    scored AS (SELECT query_id, doc, CAST(count(*) OVER (PARTITION BY query_id) - r + 1 AS DOUBLE) AS score, r FROM pool),
    beside AS (SELECT DISTINCT c.query_id, split_part(c.doc, '_par_', 1) || '_par_' || n AS doc FROM scored c, LATERAL (SELECT CAST(split_part(c.doc, '_par_', 2) AS INT) + unnest([-1, 1, 2]) AS n) WHERE c.r <= 3 AND contains(c.doc, '_par_')),
    more AS (SELECT query_id, doc FROM beside SEMI JOIN p USING (doc) ANTI JOIN scored USING (query_id, doc)),
    extra AS (SELECT query_id, doc, CAST(count(*) OVER (PARTITION BY query_id) - row_number() OVER (PARTITION BY query_id ORDER BY doc) + 1 AS DOUBLE) AS score FROM more),
    kept AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS r, op, conv_id FROM (SELECT query_id, doc, score FROM scored UNION ALL SELECT * FROM extra) JOIN p USING (doc) QUALIFY r <= 3),
    slot AS (SELECT query_id, 'V' || conv_id || '_op_1' AS doc, 1.0::DOUBLE AS score FROM kept WHERE r = 1 AND query_id NOT IN (SELECT query_id FROM kept WHERE op))
    SELECT query_id, doc, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INTEGER) AS rank, '[V' || conv_id || ', ' || role || ', ' || CASE WHEN op THEN 'operative ruling 1' ELSE 'para. ' || number END || ']' AS header
    FROM (SELECT query_id, doc, score FROM kept UNION ALL SELECT * FROM slot) JOIN p USING (doc)""")
def hybrid_case_law(spark, d):
    """The case-law slots where passages have vectors and judgments end in a ruling."""
    found = hybrid(ruled_store(spark, d), questions(spark, d), HybridConfig(use_recitals=False)).where("slot = 'case law'")
    return found.select("query_id", "doc", "score", "rank", F.substring_index("text", "\n", 1).alias("header"))


_KEYWORDS = ", ".join(f"({i}, '{k}', '{c}')" for i, (k, c) in enumerate(legal.ACT_KEYWORDS))


@query(f"""WITH k(o, word, celex) AS (VALUES {_KEYWORDS}),
    q AS (SELECT doc_id AS query_id, CASE doc_id % 5 WHEN 0 THEN 'What did the Court say of the Data Act and ' WHEN 1 THEN 'GDPR, AI Act, 2022/868, Data Act: ' ELSE 'Is it ' END || lang || '?' AS txt FROM documents),
    m AS (SELECT query_id, celex, min(o) AS o FROM q JOIN k ON contains(lower(txt), word) GROUP BY ALL)
    SELECT q.query_id, CASE WHEN contains(lower(txt), 'court') THEN 'INTERPRETIVE' ELSE 'DEFINITIONAL' END AS intent,
        coalesce((list(celex ORDER BY celex) FILTER (celex IS NOT NULL))[1:3], []) AS acts FROM q LEFT JOIN m USING (query_id) GROUP BY q.query_id, txt""")
def question_classify(spark, d):
    head = F.when(F.col("doc_id") % 5 == 0, "What did the Court say of the Data Act and ").when(F.col("doc_id") % 5 == 1, "GDPR, AI Act, 2022/868, Data Act: ").otherwise("Is it ")
    asked = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("query_id"), F.concat(head, "lang", F.lit("?")).alias("text"))
    acts = spark.createDataFrame([(c, n) for c, n in legal.ACT_NAMES.items()], "id string, title string")
    return answering.classify(asked, acts).select("query_id", "intent", "acts")


@query(r"""WITH w AS (SELECT conv_id, turn, text, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS ws FROM conversations),
    p AS (SELECT a.conv_id, a.turn, b.turn AS other, CASE WHEN len(a.ws) = 0 THEN 0 ELSE len(list_intersect(a.ws, b.ws)) / len(a.ws) END AS score FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn <> b.turn)
    SELECT conv_id, turn, other, round(score, 6) AS score FROM p""")
def overlap_score(spark, d):
    """Each turn's words are made once; pairs of a conversation's turns meet as word sets."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != ""))
    rows = cut(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", words.alias("w")))
    other = rows.select(F.col("conv_id").alias("_c"), F.col("turn").alias("other"), F.col("w").alias("_w"))
    pairs = rows.join(other, (F.col("conv_id") == F.col("_c")) & (F.col("turn") != F.col("other")))
    score = F.coalesce(F.try_divide(F.size(F.array_intersect("w", "_w")).cast("double"), F.size("w")), F.lit(0.0))
    return pairs.select("conv_id", "turn", "other", F.round(score, 6).alias("score"))


@query("""WITH s AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    kept AS (SELECT * FROM s WHERE rank <= 3)
    SELECT query_id, 'Question: what of ' || query_id || '?' AS answer, list('d' || doc_id ORDER BY rank) AS ids, list('S' || rank ORDER BY rank) AS markers FROM kept GROUP BY query_id
    UNION ALL SELECT 'nobody', 'No passage was found for this question.', [], []""")
def answer_synthesis(spark, d):
    from lexloom.providers import extractive_model

    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("query_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), "text", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    found = answering.passages(docs.where("rank <= 3").withColumn("slot", F.lit("article")))
    asked = docs.select("query_id").distinct().unionByName(spark.sql("SELECT 'nobody' AS query_id")).withColumn("text", F.concat(F.lit("what of "), "query_id", F.lit("?")))
    made = answering.synthesise(found, asked, extractive_model)
    return made.select("query_id", "answer", F.transform("sources", lambda s: s["id"]).alias("ids"), F.transform("sources", lambda s: s["marker"]).alias("markers"))
