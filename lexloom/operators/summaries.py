"""Summaries of articles, chapters, sections and judgments by a model, five calls at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.answers import fenced_json
from lexloom.operators.graph import Corpus, update_by_key
from lexloom.operators.judgments import PREAMBLE
from lexloom.prompts import CATALOGUE, Registry, fill
from lexloom.providers import Generate, generate

#: Partitions, and so calls at once, that the prompts are dealt to.
CONCURRENCY = 5


def summarise_articles(corpus: Corpus, model: Generate, prompts: Registry = CATALOGUE) -> DataFrame:
    """articles with the missing summaries filled from their paragraphs; a null reply leaves one missing."""
    todo = corpus.articles_with_paragraphs().join(corpus.articles.select("id", "act_id"), "id").join(corpus.acts.select(F.col("id").alias("act_id"), F.col("title").alias("act_title")), "act_id", "left")
    prompt = F.concat(F.lit(prompts.active("article_summary_system").body + "\n\n"), fill(prompts.active("article_summary_user"), celex=F.col("act_id"), act_title=F.col("act_title"), article_title=F.col("title"), body=F.col("text")))
    made = todo.repartition(CONCURRENCY, "id").select("id", generate(prompt, model).alias("summary"))
    return update_by_key(corpus.articles, made, ["id"], "summary")


def summarise_chapters(corpus: Corpus, model: Generate, prompts: Registry = CATALOGUE) -> DataFrame:
    """chapters with the missing summaries filled from their articles' titles."""
    todo = corpus.chapters_without_summary().join(corpus.acts.select(F.col("id").alias("act_id"), F.col("title").alias("act_title")), "act_id", "left")
    prompt = F.concat(F.lit(prompts.active("chapter_summary_system").body + "\n\n"), fill(prompts.active("chapter_summary_user"), celex=F.col("act_id"), act_title=F.col("act_title"), number=F.col("number"), chapter_title=F.col("title"), article_titles=F.array_join("article_titles", "\n")))
    made = todo.repartition(CONCURRENCY, "id").select("id", generate(prompt, model).alias("summary"))
    return update_by_key(corpus.chapters, made, ["id"], "summary")


def summarise_sections(texts: DataFrame, model: Generate, prompts: Registry = CATALOGUE) -> DataFrame:
    """celex, heading, summary of (celex, heading, depth, text); the preamble's sections and empty ones are left out.

    A reply that is no JSON is the summary itself.
    """
    todo = texts.where((F.trim(F.coalesce("text", F.lit(""))) != "") & ~F.col("heading").isin(*PREAMBLE))
    prompt = F.concat(F.lit(prompts.active("case_law_entity_summary_system").body + "\n\n"), fill(prompts.active("case_law_entity_summary_user"), heading=F.col("heading"), depth=F.col("depth"), body=F.col("text")))
    made = todo.repartition(CONCURRENCY).withColumn("_reply", generate(prompt, model)).withColumn("_raw", fenced_json(F.col("_reply"), "heading string, summary string"))
    return made.select("celex", F.coalesce("_raw.heading", "heading").alias("heading"), F.coalesce("_raw.summary", "_reply").alias("summary"))


def summarise_documents(texts: DataFrame, model: Generate, char_length: int = 150, prompts: Registry = CATALOGUE) -> DataFrame:
    """celex, heading (null), summary of whole judgments, from (celex, section_seq, heading, text)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("section_seq", F.concat_ws("\n", "heading", "text").alias("t")))), lambda x: x["t"])
    whole = texts.groupBy("celex").agg(F.array_join(parts, "\n").alias("_t"))
    prompt = F.concat(F.lit(prompts.active("case_law_entire_doc_summary_system").body + "\n\n"), fill(prompts.active("case_law_entire_doc_summary_user"), char_length=F.lit(char_length), document_content=F.col("_t")))
    return whole.repartition(CONCURRENCY, "celex").select("celex", F.lit(None).cast("string").alias("heading"), generate(prompt, model).alias("summary"))
