"""From questions to attributed answers: classification, curation, synthesis, filter, attribution."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import legal
from lexloom.functions.text import sentences
from lexloom.operators.answers import backfill, curate, fenced_json, renumber
from lexloom.prompts import CATALOGUE, Registry, fill
from lexloom.providers import Generate, generate

#: What an answer without passages says.
NOTHING_FOUND = "No passage was found for this question."
RAW_CLASSIFICATION = "intent string, act_relevances array<struct<celex:string,relevance:double>>, sub_questions array<string>"
CURATION = "keep array<int>, governing array<int>"
#: Share of a sentence's words that a source must have to support it, for the offline attribution.
SUPPORT = 0.5
#: (sentences, (marker, text) of the sources) -> markers of each sentence
Attribute = Callable[[list[str], list[tuple[str, str]]], list[list[str]]]


def keyword_classifier(prompts: list[str]) -> list[str]:
    """A stand-in that scores an act 1 if the question, the prompt's last line, names it."""
    import json

    out = []
    for p in prompts:
        question = (p or "").rsplit("Question: ", 1)[-1]
        low = question.lower()
        acts = dict.fromkeys(c for k, c in legal.ACT_KEYWORDS if k in low)
        court = any(w in low for w in ("court", "judgment", "case law", "ruling", "interpret"))
        out.append(json.dumps({"intent": "INTERPRETIVE" if court else "DEFINITIONAL", "act_relevances": [{"celex": c, "relevance": 1.0} for c in acts], "sub_questions": []}))
    return out


def classify(questions: DataFrame, acts: DataFrame, model: Generate = keyword_classifier, least: float = 0.4, most: int = 3, prompts: Registry = CATALOGUE) -> DataFrame:
    """questions with intent, acts[], act_scores (a map) and sub_questions[]; acts: id, title.

    Acts scored at least `least` come first, then those the question names; a
    reply that can't be read is DEFINITIONAL and scores nothing.
    """
    listed = acts.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("id"), F.lit(": "), F.coalesce("title", F.lit(""))))), "\n").alias("_acts"))
    shown = F.when(F.col("_acts") == "", F.lit("(none)")).otherwise(F.col("_acts"))
    asked = questions.join(listed, F.lit(True))  # one row
    reply = generate(fill(prompts.active("query_classification"), acts=shown, query=F.col("text")), model)
    raw = asked.withColumn("_reply", reply).withColumn("_raw", fenced_json(F.col("_reply"), RAW_CLASSIFICATION))
    scores = F.transform(F.coalesce("_raw.act_relevances", F.array().cast("array<struct<celex:string,relevance:double>>")), lambda x: F.struct(x["celex"].alias("celex"), x["relevance"].alias("score")))
    by_act = F.map_from_entries(F.transform(F.array_distinct(F.transform(scores, lambda x: x["celex"])), lambda c: F.struct(c, F.element_at(F.filter(scores, lambda x: x["celex"] == c), -1)["score"])))
    made = raw.withColumns({"_scores": scores, "act_scores": by_act, "intent": F.coalesce("_raw.intent", F.lit("DEFINITIONAL")), "sub_questions": F.coalesce("_raw.sub_questions", F.array().cast("array<string>"))})
    return made.withColumn("acts", legal.select_acts(F.col("_scores"), F.col("text"), least, most)).select(*questions.columns, "intent", "acts", "act_scores", "sub_questions")


def passages(found: DataFrame) -> DataFrame:
    """found (query_id, slot, rank, doc, text) with pos, from 0 in the order articles, recitals, case law."""
    place = F.when(F.col("slot") == "article", 0).when(F.col("slot") == "recital", 1).otherwise(2)
    return found.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(place, "rank", "doc")) - 1)


def curated(found: DataFrame, questions: DataFrame, model: Generate, prompts: Registry = CATALOGUE) -> tuple[DataFrame, DataFrame]:
    """(passages that a curator keeps, governing ones first, with their new pos; query_id, guidance)."""
    rows = passages(found)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.concat(F.lit("["), x["pos"].cast("string"), F.lit("] "), x["text"])), "\n\n")
    asked = rows.groupBy("query_id").agg(listed.alias("_p")).join(questions.select("query_id", F.col("text").alias("_q")), "query_id")
    reply = asked.withColumn("_reply", generate(fill(prompts.active("context_curation"), passages=F.col("_p"), question=F.col("_q")), model))
    none = F.array().cast("array<int>")
    judged = reply.withColumn("_raw", fenced_json(F.col("_reply"), CURATION)).select("query_id", F.coalesce("_raw.keep", none).alias("keep"), F.coalesce("_raw.governing", none).alias("governing"))
    kept = curate(rows, judged).withColumn("pos", F.col("place") - 1).drop("place")
    headers = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("governing") == 1, F.struct("pos", legal.source_header(F.col("text"))["header"].alias("h"))))), lambda x: x["h"]), "; ")
    told = kept.groupBy("query_id").agg(headers.alias("_h"))
    guidance = F.when(F.col("_h") != "", F.concat(F.lit("These decide the question: "), F.col("_h"), F.lit("."))).otherwise("")
    return kept, told.select("query_id", guidance.alias("guidance"))


def synthesise(kept: DataFrame, questions: DataFrame, model: Generate, guidance: DataFrame | None = None, answer_filter: Generate | None = None, prompts: Registry = CATALOGUE) -> DataFrame:
    """query_id, answer, sources[] (marker, id, title, text in order): one row a question, also without passages."""
    sources = F.array_sort(F.collect_list(F.struct("pos", "doc", "text")))
    by = kept.groupBy("query_id").agg(sources.alias("_s"))
    rows = questions.select("query_id", F.col("text").alias("_q")).join(by, "query_id", "left")
    rows = rows.join(guidance, "query_id", "left") if guidance is not None else rows.withColumn("guidance", F.lit(""))
    context = F.array_join(F.transform("_s", lambda x: x["text"]), "\n\n")
    tidy = lambda c: F.trim(F.regexp_replace(c, "\r\n?", "\n"))
    asked = rows.where(F.col("_s").isNotNull())
    made = asked.withColumn("answer", tidy(generate(fill(prompts.active("answer_synthesis"), guidance=F.col("guidance"), context=context, question=F.col("_q")), model)))
    if answer_filter is not None:
        made = made.withColumn("answer", tidy(generate(fill(prompts.active("answer_filter"), question=F.col("_q"), draft_answer=F.col("answer")), answer_filter)))
    empty = rows.where(F.col("_s").isNull()).withColumn("answer", F.lit(NOTHING_FOUND))
    out = made.unionByName(empty)
    marked = F.transform(F.coalesce("_s", F.array().cast(out.schema["_s"].dataType)), lambda x, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("marker"), x["doc"].cast("string").alias("id"), legal.source_header(x["text"])["header"].alias("title"), x["text"].alias("text")))
    return out.select("query_id", "answer", marked.alias("sources"))


def overlap_attribution(texts: list[str], sources: list[tuple[str, str]]) -> list[list[str]]:
    """The sources that have at least SUPPORT of a sentence's distinct words."""
    bags = [(m, set((t or "").lower().split())) for m, t in sources]
    out = []
    for s in texts:
        own = set(s.lower().split())
        out.append([m for m, bag in bags if own and len(own & bag) >= SUPPORT * len(own)])
    return out


def model_attribution(model: Generate, prompts: Registry = CATALOGUE) -> Attribute:
    """Attribution by a model's JSON; an unreadable reply supports nothing."""
    import json

    body = prompts.active("attribution").body

    def run(texts: list[str], sources: list[tuple[str, str]]) -> list[list[str]]:
        numbered = "\n".join(f"[{i}] {t}" for i, t in enumerate(texts))
        listed = "\n\n".join(f"[{m}] {t}" for m, t in sources)
        out: list[list[str]] = [[] for _ in texts]
        try:
            for a in json.loads(model([body.replace("{sentences}", numbered).replace("{sources}", listed)])[0])["assignments"]:
                if 0 <= a["index"] < len(out):
                    out[a["index"]] = list(a["markers"])
        except (ValueError, KeyError, TypeError, IndexError):
            return [[] for _ in texts]
        return out

    return run


def attribute(answers: DataFrame, how: Attribute = overlap_attribution) -> tuple[DataFrame, DataFrame]:
    """(segments, sources) of (query_id, answer, sources[]), with cited sources alone, renumbered by first use.

    segments: answer, pos, text, markers[], a sentence each; markers that no
    source has are dropped.  sources: answer, marker, id, title, text.
    """

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sources in frames:
            yield pd.Series([[list(m) for m in how(list(t), [(s["marker"], s["text"]) for s in own])] if len(t) else [] for t, own in zip(texts, sources)], dtype=object)

    udf = F.pandas_udf(run, "array<array<string>>")
    whole = sentences(F.col("answer"))
    split = answers.select(F.col("query_id").alias("answer"), F.when(F.size(whole) > 0, whole).otherwise(F.array("answer")).alias("_t"), "sources")
    known = F.transform("sources", lambda s: s["marker"])
    rows = split.withColumn("_m", udf("_t", "sources")).select("answer", known.alias("_k"), F.posexplode(F.arrays_zip(F.col("_t").alias("text"), F.col("_m").alias("markers"))).alias("pos", "x"))
    segments = rows.select("answer", "pos", F.col("x.text").alias("text"), F.array_intersect(F.coalesce("x.markers", F.array().cast("array<string>")), "_k").alias("markers"))
    listed = answers.select(F.col("query_id").alias("answer"), F.inline("sources"))
    return renumber(segments, listed)


def backfill_attribution(rows: DataFrame, key: str, how: Attribute = overlap_attribution) -> DataFrame:
    """rows with `segments` and `cited_sources` as JSON, attributed from their packed sources and contexts.

    rows: a key, answer, sources and contexts packed with pipes.  Where these
    differ in number nothing can be told: both are null.
    """
    paired = backfill(rows)
    texts = F.transform("pairs", lambda p, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("marker"), p["id"].alias("id"), p["id"].alias("title"), p["context"].alias("text")))
    made = paired.where("pairs is not null").select(F.col(key).alias("query_id"), F.col("answer"), texts.alias("sources"))
    segments, sources = attribute(made, how)
    told = segments.groupBy("answer").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "markers"))), lambda x: F.struct(x["text"].alias("text"), x["markers"].alias("markers")))).alias("segments"))
    number = F.regexp_extract("marker", r"(\d+)", 1).cast("int")
    cited = sources.groupBy("answer").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), "marker", "id"))), lambda x: F.struct(x["marker"].alias("marker"), x["id"].alias("id")))).alias("cited_sources"))
    rename = lambda df: df.withColumnRenamed("answer", "_k")
    out = rows.join(rename(told), F.col(key) == F.col("_k"), "left").drop("_k")
    return out.join(rename(cited), F.col(key) == F.col("_k"), "left").drop("_k")


def view(rows: DataFrame, act: str | None = None, metric: str | None = None, least: float | None = None) -> DataFrame:
    """Rows of one act, and of at least some value of a metric, numbered anew from 0 in their order."""
    kept = rows if act is None else rows.where(F.col("act") == act)
    kept = kept if metric is None else kept.where(F.col(metric) >= least)
    return kept.withColumn("row", F.row_number().over(Window.partitionBy("act").orderBy("question")) - 1)


def answer_badges(segments: DataFrame) -> DataFrame:
    """answer, shown: the sentences in order, each followed by its markers in brackets."""
    one = F.trim(F.concat_ws(" ", "text", F.array_join(F.transform("markers", lambda m: F.concat(F.lit("["), m, F.lit("]"))), " ")))
    return segments.groupBy("answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("s")))), lambda x: x["s"]), " ").alias("shown"))


def question_label(number: Column, act: Column, question: Column, most: int = 80) -> Column:
    """`3. [act] question`, the question on one line and cut with an ellipsis."""
    line = F.regexp_replace(question, "\n", " ")
    short = F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)
    return F.concat(number.cast("string"), F.lit(". "), F.coalesce(F.concat(F.lit("["), act, F.lit("] ")), F.lit("")), short)


def json_list(cell: Column, schema: str = "array<struct<text:string,markers:array<string>>>") -> Column:
    """A JSON list in a cell; an empty list where there is none or it can't be read."""
    return F.coalesce(F.from_json(cell, schema), F.array().cast(schema))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
