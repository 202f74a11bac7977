"""The hybrid and topics retrieval plans, and the methods a caller can choose from.

Plans answer a whole table of questions at once.  Ranked lists are DataFrames
of (query_id, doc, rank); what depends on a question's acts is grouped by its
scope, the sorted list of its acts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import legal
from lexloom.operators.lexical_index import LexicalIndex, write_index, write_once
from lexloom.operators.retrieval import bm25_scores, bm25_stats, bm25_top_k, bridge, dedup_queries, dense_top_k, fuse, gate, index_top_k, operative_slot, pseudo_scores, top_k
from lexloom.operators.topics import match_topics
from lexloom.providers import Embed, Generate, Score, embed_texts, generate, score_pairs
from lexloom.session import cut, remove_folder, shared_folder


@dataclass(frozen=True)
class HybridConfig:
    """Tunables of the hybrid method."""

    top_k_dense: int = 10
    top_k_sparse: int = 10
    top_k_final: int = 5
    rrf_k: int = 60
    pool_factor: int = 2
    rerank: bool = False
    use_recitals: bool = True
    recital_threshold: float = 0.3
    max_recitals: int = 2
    use_case_law: bool = True
    max_case_law: int = 3
    case_law_threshold: float = 0.3
    neighbour_window: int = 2
    guarantee_operative: bool = True
    max_bridge: int = 3
    decompose: bool = True
    max_sub_questions: int = 4
    hyde: bool = False
    hyde_texts: int = 1


@dataclass(frozen=True)
class TopicsConfig:
    """Tunables of the topics method."""

    topic_threshold: float = 0.35
    max_topics: int = 5
    top_k: int = 3
    rerank: bool = False


@dataclass(frozen=True)
class Store:
    """What the hybrid method searches.

    articles: doc, act, text, title, chapter_number, chapter_title, embedding;
    recitals: doc, act, text; passages (of judgments): doc, celex, number,
    text, section_heading, case_number, is_operative, embedding; interprets:
    celex, act.  `cached` keeps all four for a session's further questions.
    """

    articles: DataFrame
    recitals: DataFrame
    passages: DataFrame
    interprets: DataFrame

    def cached(self) -> Store:
        return Store(*(getattr(self, f.name).cache() for f in fields(self)))

    def keyed_passages(self) -> DataFrame:
        """Passages of judgments that interpret an act, with `key`: the sorted acts that theirs does."""
        keys = self.interprets.groupBy(F.col("celex").alias("_c")).agg(F.array_join(F.array_sort(F.collect_set("act")), ",").alias("key"))
        return self.passages.join(keys, F.col("celex") == F.col("_c")).drop("_c")

    def write_indexes(self, folder: str, asked: DataFrame | None = None) -> Indexes:
        """BM25 indexes of articles and recitals by act, and of passages by the acts that their judgments interpret; for the texts asked alone, if any are given."""
        own = {"articles": (self.articles.select("doc", "act", "text"), "act"), "recitals": (self.recitals, "act"), "passages": (self.keyed_passages(), "key")}
        write = write_index if asked is None else lambda df, to, group: write_once(df, to, asked, group=group)
        return Indexes(**{n: write(df, f"{folder}/{n}", group=g) for n, (df, g) in own.items()})

    @contextmanager
    def indexed(self, asked: DataFrame | None = None) -> Iterator[Indexes]:
        """Indexes in the shared folder, for the time being."""
        spark = self.articles.sparkSession
        folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
        try:
            yield self.write_indexes(folder, asked)
        finally:
            remove_folder(spark, folder)


@dataclass(frozen=True)
class Indexes:
    """BM25 indexes of a store.  What a question searches is a set of their groups, so that all questions share them."""

    articles: LexicalIndex
    recitals: LexicalIndex
    passages: LexicalIndex

    def members(self, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(scope, grp) of acts, and of passages: of all keys that have one of the scope's acts."""
        keys = self.passages.segments.select("grp").distinct().select("grp", F.explode(F.split("grp", ",")).alias("_act"))
        return scopes.select("scope", F.col("act").alias("grp")), scopes.join(keys, F.col("act") == F.col("_act")).select("scope", "grp").distinct()


def scope_of(acts: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(acts)), ",")


def search_queries(questions: DataFrame, config: HybridConfig, embed: Embed | None = None, model: Generate | None = None) -> DataFrame:
    """query_id, pos, scope, acts, text, query_vector: each question, and its sub-questions that differ.

    Without an embedder, the question's own vector is used and sub-questions
    are searched by words alone.  With hyde, the vector is the mean of those
    of texts a model makes up as answers.
    """
    own = questions.select("query_id", "acts", scope_of(F.col("acts")).alias("scope"), F.lit(0).alias("pos"), "text", "query_vector")
    if config.decompose and "sub_questions" in questions.columns:
        more = questions.select("query_id", "acts", scope_of(F.col("acts")).alias("scope"), F.posexplode(F.slice("sub_questions", 1, config.max_sub_questions)).alias("pos", "text"))
        more = more.withColumn("pos", F.col("pos") + 1).where(F.trim("text") != "").withColumn("query_vector", F.lit(None).cast(own.schema["query_vector"].dataType))
        own = dedup_queries(own.unionByName(more), config.max_sub_questions).drop("n")
    if embed is None:
        return own
    if config.hyde and model is not None:
        prompts = own.withColumn("_made", F.array(*(generate(F.concat(F.lit(f"Answer {k} from {{acts}}: "), F.array_join("acts", ", "), F.lit("\n"), F.col("text")), model) for k in range(config.hyde_texts))))
        vectors = prompts.select("query_id", "pos", F.explode("_made").alias("_t")).withColumn("_v", embed_texts(F.col("_t"), embed))
        parts = vectors.select("query_id", "pos", F.posexplode("_v").alias("_i", "_x")).groupBy("query_id", "pos", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
        means = parts.groupBy("query_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("query_vector"))
        return own.drop("query_vector").join(means, ["query_id", "pos"], "left")
    return own.withColumn("query_vector", F.coalesce("query_vector", embed_texts(F.col("text"), embed)))


def _judged(pairs: DataFrame, config: HybridConfig, score: Score | None) -> DataFrame:
    """query_id, doc, score of (query_id, doc, rank, text, question): by the scorer, or by place if it is off."""
    if config.rerank and score is not None:
        return pairs.select("query_id", "doc", score_pairs(F.col("question"), F.col("text"), score).alias("score"))
    return pseudo_scores(pairs).select("query_id", "doc", "score")


def _with_text(ranked: DataFrame, texts: DataFrame, questions: DataFrame) -> DataFrame:
    rows = ranked.select("query_id", "doc", "rank").join(texts.select("doc", "text").dropDuplicates(["doc"]), "doc")
    return rows.join(questions.select("query_id", F.col("text").alias("question")), "query_id")


def case_law(passages: DataFrame, index: LexicalIndex, members: DataFrame, questions: DataFrame, config: HybridConfig, score: Score | None = None) -> DataFrame:
    """query_id, doc, score, is_operative, celex: the case-law branch.

    passages have a key, the index's group; members (scope, grp) says which keys
    a scope has; questions: query_id, scope, text, query_vector.  Dense and BM25
    lists are fused to three times the slots; the best that reach the threshold
    bring their neighbours in, all are judged alike, and the best fill the
    slots.  Where no ruling is among them, the best ruling of the first judgment
    gets a slot of its own if it reaches the threshold.
    """
    asked = questions.select("query_id", "scope", "text", "query_vector")
    own = passages.select("doc", "celex", "key", "text", "is_operative", "embedding").dropDuplicates(["doc"])
    allowed = asked.select("query_id", "scope").join(members.withColumnRenamed("scope", "_s"), F.col("scope") == F.col("_s")).select("query_id", F.col("grp").alias("key"))

    def inside(found: DataFrame) -> DataFrame:
        """Those whose passage is in the question's scope: a few rows a question, looked up by id."""
        return found.join(own.select("doc", "key"), "doc").join(allowed, ["query_id", "key"], "left_semi").drop("key")

    dense = inside(dense_top_k(own, asked.where("query_vector is not null"), config.top_k_dense, id_col="doc"))
    dense = dense.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    sparse = index_top_k(index, asked, config.top_k_sparse, members)
    # A few rows a question, met several times below.
    pool = cut(top_k(fuse([dense, sparse], config.rrf_k), config.max_case_law * 3))
    scored = cut(_judged(_with_text(pool, own, asked), config, score))
    seeds = top_k(scored, config.max_case_law).where(F.col("score") >= config.case_law_threshold)
    near = seeds.select("query_id", F.explode(legal.neighbour_ids(F.col("doc"), config.neighbour_window)).alias("doc")).distinct()
    near = inside(near).join(scored.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc")))
    every = cut(scored.unionByName(_judged(_with_text(near, own, asked), config, score)))
    about = own.select("doc", "celex", "is_operative")
    kept = gate(every, config.case_law_threshold, config.max_case_law).join(about, "doc").select("query_id", "doc", "score", "rank", "is_operative", "celex")
    kept = cut(kept)
    if not config.guarantee_operative:
        return kept.drop("rank")
    first = kept.where("rank = 1").select("query_id", F.col("celex").alias("_c"))
    rulings = first.join(about.where("is_operative"), F.col("_c") == F.col("celex")).select("query_id", "doc").join(kept.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    rulings = rulings.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc")))
    rulings = _judged(_with_text(rulings, own, asked), config, score).join(about, "doc").select("query_id", "doc", "score", "is_operative", "celex")
    return operative_slot(kept, rulings, config.case_law_threshold)


def citation_bridge(kept: DataFrame, passages: DataFrame, articles: DataFrame, questions: DataFrame, most: int) -> DataFrame:
    """query_id, doc, rank: articles that the kept passages cite, by the best score of a citing passage.

    `that regulation` names an act only where no other act of its instrument is among the question's acts.
    """
    acts = questions.select("query_id", F.explode("acts").alias("celex_")).distinct()
    word = legal.celex_parts(F.col("celex_"))["instrument"]
    acts = acts.withColumn("_word", word).withColumn("_one", F.count(F.lit(1)).over(Window.partitionBy("query_id", "_word")) == 1)
    forms = acts.withColumn("forms", legal.surface_forms_of(F.col("celex_"), F.col("_one")))
    cites = kept.select("query_id", "doc", "score").join(passages.select("doc", "text").dropDuplicates(["doc"]), "doc").join(forms, "query_id")
    found = cites.select("query_id", "score", F.explode(legal.cited_articles(F.col("text"), F.col("celex_"), F.col("forms"))).alias("article"))
    found = found.join(articles.select(F.col("doc").alias("_d")).distinct(), F.col("article") == F.col("_d"), "left_semi")
    return bridge(found, most).select("query_id", F.col("article").alias("doc"), "rank")


def hybrid(store: Store, questions: DataFrame, config: HybridConfig = HybridConfig(), score: Score | None = None, embed: Embed | None = None, model: Generate | None = None, indexes: Indexes | None = None) -> DataFrame:
    """query_id, slot, rank, doc, score, text: articles, recitals and case law for each question.

    questions: query_id, text, acts[], intent, query_vector, and sub_questions[]
    if any.  A question without acts gets nothing; one whose intent is
    INTERPRETIVE also gets case law, and the articles that this cites join the
    articles' fusion as a list of their own.  Articles have top_k_final slots;
    recitals must reach their threshold; neither they nor judgments compete
    with articles.  text is headed by what it is.  Without the store's indexes,
    they are written for this call, and the result is checkpointed.
    """
    if indexes is None:
        texts = questions.select("text")
        if "sub_questions" in questions.columns:
            texts = texts.unionByName(questions.select(F.explode("sub_questions").alias("text")))
        with store.indexed(texts) as made:
            return cut(hybrid(store, questions, config, score, embed, model, made))
    asked = questions.where(F.size("acts") > 0)
    searches = cut(search_queries(asked, config, embed, model))
    asked = asked.withColumn("scope", scope_of(F.col("acts")))
    scopes = asked.select("scope", F.explode("acts").alias("act")).distinct()
    acts_of, keys_of = (cut(m) for m in indexes.members(scopes))
    pool = F.col("n") * config.top_k_final * config.pool_factor
    single = searches.withColumn("query_id", F.struct("query_id", "pos"))
    inside = searches.select("query_id", F.explode("acts").alias("act")).distinct()
    dense = dense_top_k(store.articles, single.where("query_vector is not null"), config.top_k_dense, id_col="doc")
    dense = dense.select("query_id.query_id", "query_id.pos", "doc", "rank").join(store.articles.select("doc", "act"), "doc").join(inside, ["query_id", "act"], "left_semi")
    # The filter comes after the top-k, so fewer may be left; places are taken among these.
    dense = dense.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "pos").orderBy("rank")))
    sparse = index_top_k(indexes.articles, single.select("query_id", "scope", "text"), config.top_k_sparse, acts_of).select("query_id.query_id", "doc", "rank")
    lists = [dense, sparse]
    kept = None
    if config.use_case_law:
        passages = store.keyed_passages()
        kept = cut(case_law(passages, indexes.passages, keys_of, asked.where("intent = 'INTERPRETIVE'"), config, score))
        lists.insert(1, citation_bridge(kept, passages, store.articles.join(scopes.select("act").distinct(), "act", "left_semi"), asked, config.max_bridge))
    sizes = searches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    fused = fuse(lists, config.rrf_k).join(sizes, "query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= pool)
    fused = cut(fused)
    best = top_k(_judged(_with_text(fused, store.articles, asked), config, score), config.top_k_final)
    out = _slot(best, store.articles, "article", article_header())
    if config.use_recitals:
        found = index_top_k(indexes.recitals, asked.select("query_id", "scope", "text"), config.max_recitals * 2, acts_of)
        gated = gate(_judged(_with_text(found, store.recitals, asked), config, score), config.recital_threshold, config.max_recitals)
        out = out.unionByName(_slot(gated, store.recitals, "recital", recital_header(), F.regexp_replace("text", r"^\((\d+)\)\s*", "")))
    if kept is not None:
        ranked = kept.select("query_id", "doc", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")).alias("rank"))
        out = out.unionByName(_slot(ranked, store.passages, "case law", case_header()))
    return out


def _slot(ranked: DataFrame, texts: DataFrame, slot: str, header: Column, body: Column | None = None) -> DataFrame:
    rows = ranked.select("query_id", "rank", "doc", "score").join(texts.drop("embedding", "score", "rank").dropDuplicates(["doc"]), "doc")
    return rows.select("query_id", F.lit(slot).alias("slot"), "rank", "doc", "score", F.concat(header, F.lit("\n"), F.coalesce(F.col("text") if body is None else body, F.lit(""))).alias("text"))


def _act_name(act: Column) -> Column:
    return F.coalesce(*(F.when(act == c, F.lit(n)) for c, n in legal.ACT_NAMES.items()), act, F.lit(""))


def article_header() -> Column:
    """[act, Chapter number — title, article title], without the chapter if there is none."""
    chapter = F.concat(F.lit("Chapter "), F.col("chapter_number"), F.lit(" — "), F.coalesce("chapter_title", F.lit("")))
    return F.concat(F.lit("["), F.concat_ws(", ", _act_name(F.col("act")), F.when(F.coalesce("chapter_number", F.lit("")) != "", chapter), F.coalesce("title", F.lit(""))), F.lit("]"))


def recital_header() -> Column:
    """[act, Recital number], the number being the one that leads the text."""
    number = F.regexp_extract("text", r"^\((\d+)\)", 1)
    return F.concat(F.lit("["), _act_name(F.col("act")), F.lit(", Recital"), F.when(number != "", F.concat(F.lit(" "), number)).otherwise(""), F.lit("]"))


def case_header() -> Column:
    """[case, section, paragraph or ruling]."""
    number = F.col("number").cast("string")
    ruling = F.coalesce(F.concat(F.lit("operative ruling "), number), F.lit("operative part"))
    place = F.when(F.col("is_operative"), ruling).otherwise(F.coalesce(F.concat(F.lit("para. "), number), F.lit("judgment")))
    section = F.when(F.coalesce("section_heading", F.lit("")) != "", F.col("section_heading"))
    return F.concat(F.lit("["), F.concat_ws(", ", F.coalesce("case_number", "celex"), section, place), F.lit("]"))


def fused_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, config: HybridConfig = HybridConfig(), keep: Column | None = None, score: Score | None = None) -> DataFrame:
    """query_id, rank, doc, score: dense and BM25 pools fused, cut and reranked, over one corpus without acts.

    docs: doc, text; vectors: doc, embedding; queries: query_id, text,
    query_vector.  `keep` filters the dense hits after their top-k, so that leg
    may give fewer.
    """
    pool = config.top_k_final * config.pool_factor
    dense = dense_top_k(vectors, queries.where("query_vector is not null"), pool, id_col="doc")
    if keep is not None:
        dense = dense.where(keep)
    sparse = bm25_top_k(docs, queries, pool)
    fused = top_k(fuse([dense, sparse], config.rrf_k), pool)
    if config.rerank and score is not None:
        return top_k(_judged(_with_text(fused, docs, queries), config, score), config.top_k_final).select("query_id", "rank", "doc", "score")
    return top_k(pseudo_scores(fused).drop("rank"), config.top_k_final).select("query_id", "rank", "doc", "score")


def by_topics(topic_vectors: DataFrame, tagged: DataFrame, paragraphs: DataFrame, queries: DataFrame, config: TopicsConfig = TopicsConfig(), acts: DataFrame | None = None, vectors: DataFrame | None = None, score: Score | None = None) -> DataFrame:
    """query_id, rank, doc, score, source: paragraphs of a query's nearest topics, ranked by BM25 among themselves.

    topic_vectors: label, embedding; tagged: paragraph_id, label; paragraphs:
    doc, text; queries: query_id, text, query_vector.  `top_k` are given back
    even if no query term matches (score 0).  acts (query_id, act) keeps
    paragraphs whose id begins with one of a question's acts, where it has any;
    vectors (doc, embedding) add the dense hits that topics missed, with source
    vector_search; a scorer then ranks all of them.
    """
    near = match_topics(topic_vectors, queries.select("query_id", "query_vector"), config.topic_threshold, config.max_topics)
    pool = near.join(tagged, "label").select(F.col("query_id").alias("pool"), F.col("paragraph_id").alias("doc")).distinct().join(paragraphs, "doc")
    own = queries.withColumn("pool", F.col("query_id"))
    scores = bm25_scores(bm25_stats(pool, "doc", "text", ["pool"]), own, "text", "query_id", ["pool"], own_group=True)
    every = pool.select(F.col("pool").alias("query_id"), "doc").join(scores.select("query_id", "doc", "score"), ["query_id", "doc"], "left")
    ranked = top_k(_of_acts(every, acts).withColumn("score", F.coalesce("score", F.lit(0.0))), config.top_k).select("query_id", "rank", "doc", "score", F.lit("semantic_topic_filter").alias("source"))
    if vectors is None:
        return ranked
    dense = dense_top_k(vectors, queries, config.top_k * 2, id_col="doc").select("query_id", "rank", "doc", "score", F.lit("vector_search").alias("source"))
    more = ranked.unionByName(_of_acts(dense, acts).join(ranked.select("query_id", "doc"), ["query_id", "doc"], "left_anti"))
    if not (config.rerank and score is not None):
        return more
    judged = _judged(_with_text(more, paragraphs, queries), HybridConfig(rerank=True), score)
    return top_k(judged.join(more.select("query_id", "doc", "source"), ["query_id", "doc"]), config.top_k * 2).select("query_id", "rank", "doc", "score", "source")


def _of_acts(rows: DataFrame, acts: DataFrame | None) -> DataFrame:
    """Rows whose doc begins with an act of their query; queries without acts keep all."""
    if acts is None:
        return rows
    lists = acts.groupBy("query_id").agg(F.collect_set("act").alias("_acts"))
    kept = rows.join(lists, "query_id", "left").where(F.col("_acts").isNull() | F.exists("_acts", lambda a: F.startswith(F.col("doc").cast("string"), a)))
    return kept.drop("_acts")


METHODS: dict[str, tuple[Callable[..., DataFrame], type]] = {"hybrid": (hybrid, HybridConfig), "topics": (by_topics, TopicsConfig)}


def methods() -> list[str]:
    return sorted(METHODS)


def default_config(name: str) -> dict:
    return asdict(METHODS[name][1]())


def configure(name: str, **overrides: object) -> object:
    """The method's configuration with some values changed; an unknown name is an error."""
    kind = METHODS[name][1]
    unknown = set(overrides) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    return replace(kind(), **overrides)
