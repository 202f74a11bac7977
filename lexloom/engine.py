"""One object that holds a session's tables and models, and answers tables of questions."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.plans import answering
from lexloom.plans.retrieval import METHODS, Indexes, Store, by_topics, configure, default_config, hybrid, methods
from lexloom.prompts import CATALOGUE, Registry
from lexloom.providers import Embed, Generate, Score, embed_texts, extractive_model, hashed_embedder, overlap_scorer
from lexloom.session import cut, shared_folder


@dataclass(frozen=True)
class TopicTables:
    """What the topics method searches: topic_vectors (label, embedding), tagged (paragraph_id, label), paragraphs (doc, text), vectors (doc, embedding) if any."""

    topic_vectors: DataFrame
    tagged: DataFrame
    paragraphs: DataFrame
    vectors: DataFrame | None = None


@dataclass
class Engine:
    """store: what is searched, cached and indexed at first use; the models are providers, offline ones by default.

    The indexes are written to `folder`, or else to one of their own in the
    shared folder, and serve all further questions; `topics` are the tables of the topics method.
    """

    spark: SparkSession
    store: Store
    acts: DataFrame
    embed: Embed = field(default_factory=hashed_embedder)
    score: Score = overlap_scorer
    synthesis: Generate = extractive_model
    classifier: Generate = answering.keyword_classifier
    curator: Generate | None = None
    answer_filter: Generate | None = None
    attribution: answering.Attribute = answering.overlap_attribution
    prompts: Registry = CATALOGUE
    topics: TopicTables | None = None
    folder: str | None = None
    _cached: Store | None = None
    _indexes: Indexes | None = None

    def methods(self) -> dict[str, dict]:
        """Every method's name and default configuration."""
        return {m: default_config(m) for m in methods()}

    def tables(self) -> Store:
        if self._cached is None:
            self._cached = self.store.cached()
        return self._cached

    def indexes(self) -> Indexes:
        if self._indexes is None:
            self._indexes = self.tables().write_indexes(self.folder or f"{shared_folder(self.spark)}/engine-{uuid.uuid4().hex}")
        return self._indexes

    def classify(self, questions: DataFrame) -> DataFrame:
        return answering.classify(questions, self.acts, self.classifier, prompts=self.prompts)

    def retrieve(self, questions: DataFrame, method: str | Callable[..., DataFrame] = "hybrid", **overrides: object) -> DataFrame:
        """query_id, slot, rank, doc, score, text for (query_id, text); questions that name acts, intent and vector keep them."""
        rows = questions if "acts" in questions.columns else self.classify(questions)
        if callable(method):
            return method(rows)
        if method not in METHODS:
            raise ValueError(f"unknown method {method}, only {', '.join(methods())}")
        config = configure(method, **overrides)
        if method == "topics" and self.topics is None:
            raise ValueError("the topics method needs the engine's topics tables")
        if "query_vector" not in rows.columns:
            rows = rows.withColumn("query_vector", embed_texts(F.col("text"), self.embed))
        if method == "topics":
            acts = rows.select("query_id", F.explode("acts").alias("act"))
            own = self.topics
            found = by_topics(own.topic_vectors, own.tagged, own.paragraphs, rows.select("query_id", "text", "query_vector"), config, acts, own.vectors, self.score)
            return found.join(own.paragraphs.select("doc", "text"), "doc").select("query_id", F.lit("paragraph").alias("slot"), "rank", "doc", "score", "text")
        return hybrid(self.tables(), rows, config, self.score, self.embed, self.synthesis, self.indexes())

    def answer(self, questions: DataFrame, method: str | Callable[..., DataFrame] = "hybrid", **overrides: object) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(answers, segments, sources): query_id and answer; its sentences with markers; the sources they cite."""
        found = cut(self.retrieve(questions, method, **overrides))
        if self.curator is not None:
            kept, guidance = answering.curated(found, questions, self.curator, self.prompts)
        else:
            kept, guidance = answering.passages(found), None
        made = cut(answering.synthesise(kept, questions, self.synthesis, guidance, self.answer_filter, self.prompts))
        segments, sources = answering.attribute(made, self.attribution)
        return made.select("query_id", "answer"), segments, sources
