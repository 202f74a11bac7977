"""Retrieval and claim metrics as aggregates; rollups give every act and the whole in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.vectors import cosine
from lexloom.prompts import CATALOGUE, Registry, fill
from lexloom.providers import Embed, Generate, Score, embed_texts, generate, score_pairs

OVERALL = "(all)"


def ir_metrics(sources: Column, expected: Column, n_expected: Column | None = None) -> Column:
    """struct(top1_anchor, recall_at_k, mrr) of a ranked list and the ids it should hold.

    Where those are many, `expected` may have just the ones that the list has, and n_expected their number.
    """
    n_expected = F.size(F.array_distinct(expected)) if n_expected is None else n_expected
    hits = F.array_intersect(sources, expected)
    first = F.aggregate(F.transform(sources, lambda s, i: F.when(F.array_contains(expected, s), i + 1)), F.lit(None).cast("int"), lambda a, x: F.coalesce(a, x))
    zero = F.lit(0.0)
    return F.struct(
        F.when((F.size(expected) > 0) & F.array_contains(expected, F.get(sources, F.lit(0))), F.lit(1.0)).otherwise(zero).alias("top1_anchor"),
        F.coalesce(F.try_divide(F.size(hits).cast("double"), n_expected.cast("double")), zero).alias("recall_at_k"),
        F.coalesce(F.lit(1.0) / first, zero).alias("mrr"),
    )


def averages(rows: DataFrame, metrics: Sequence[str], act: str = "act", repeat_of: Sequence[str] = ()) -> DataFrame:
    """Mean of every metric by act and over all; nulls don't count, a null act is `unknown`.

    Repeats of a question (`repeat_of`) are averaged first.
    """
    named = rows.withColumn(act, F.coalesce(F.col(act), F.lit("unknown")))
    if repeat_of:
        named = named.groupBy(act, *repeat_of).agg(*(F.avg(m).alias(m) for m in metrics))
    rolled = named.rollup(act).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in metrics), F.grouping(act).alias("_g"))
    return rolled.select(F.when(F.col("_g") == 1, F.lit(OVERALL)).otherwise(F.col(act)).alias(act), "n", *metrics)


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> Column:
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), zero)
    r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), zero)
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"))


def faithfulness(verdicts: DataFrame) -> DataFrame:
    """Share of an answer's statements that any document supports, from (answer, statement, doc, verdict, reason)."""
    support = F.array_sort(F.collect_list(F.when(F.col("verdict") == 1, F.struct("doc", "reason"))))
    every = F.array_sort(F.collect_list(F.struct("doc", "reason")))
    each = verdicts.groupBy("answer", "statement").agg(F.max("verdict").alias("verdict"), support.alias("_s"), every.alias("_r"))
    reason = F.when(F.size("_s") > 0, F.get("_s", F.lit(0))["reason"]).otherwise(F.array_join(F.transform("_r", lambda x: x["reason"]), "; "))
    return each.withColumn("reason", reason).groupBy("answer").agg(F.avg(F.col("verdict").cast("double")).alias("faithfulness"), F.count(F.lit(1)).alias("statements"))


def act_accuracy(rows: DataFrame) -> DataFrame:
    """detected, exact and abstained rates by expected act and over all, from (expected, predicted[])."""
    own = rows.withColumn("detected", F.array_contains("predicted", F.col("expected")).cast("double")).withColumn("exact", (F.col("predicted") == F.array("expected")).cast("double")).withColumn("abstained", (F.size("predicted") == 0).cast("double"))
    return averages(own, ["detected", "exact", "abstained"], "expected")


def claims(texts: DataFrame, key: str, text: str, model: Generate, prompts: Registry = CATALOGUE) -> DataFrame:
    """key, pos, claim: the claims a model finds in each text, one a line of its reply."""
    reply = generate(fill(prompts.active("claim_extraction"), text=F.col(text)), model)
    lines = F.filter(F.transform(F.split(F.coalesce("_r", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*]\s+", ""))), lambda x: x != "")
    return texts.select(key, reply.alias("_r")).select(key, F.posexplode(lines).alias("pos", "claim"))


def verify(pairs: DataFrame, score: Score, least: float = 0.5) -> DataFrame:
    """pairs (claim, passage, ...) with verdict: 1 if the scorer gives the passage at least `least` for the claim."""
    return pairs.withColumn("verdict", (score_pairs(F.col("claim"), F.col("passage"), score) >= least).cast("int"))


def answer_scores(rows: DataFrame, model: Generate, score: Score, embed: Embed | None = None, prompts: Registry = CATALOGUE) -> DataFrame:
    """answer, tp, fp, fn, precision, recall, f1, faithfulness, and the retrieval and relevancy metrics.

    rows: answer (a key), question, response, ground_truth, contexts[].  A
    claim of the response that the reference supports is a true positive, else
    a false one; one of the reference that the response lacks is a false
    negative (factual_precision and factual_recall are these shares).
    faithfulness is the share of the response's claims that any context
    supports; context_recall that of the reference's claims; context_precision
    the mean precision at the ranks of contexts that support any claim of the
    reference; answer_relevancy the likeness of question and response.
    """
    response = claims(rows, "answer", "response", model, prompts).withColumn("side", F.lit("response"))
    reference = claims(rows, "answer", "ground_truth", model, prompts).withColumn("side", F.lit("reference"))
    texts = rows.select("answer", "question", "response", "ground_truth", "contexts")
    every = response.unionByName(reference).join(texts, "answer")
    facts = verify(every.withColumn("passage", F.when(F.col("side") == "response", F.col("ground_truth")).otherwise(F.col("response"))), score)
    counts = facts.groupBy("answer").agg(
        F.count_if((F.col("side") == "response") & (F.col("verdict") == 1)).alias("tp"),
        F.count_if((F.col("side") == "response") & (F.col("verdict") == 0)).alias("fp"),
        F.count_if((F.col("side") == "reference") & (F.col("verdict") == 0)).alias("fn"),
        F.avg(F.when(F.col("side") == "reference", F.col("verdict"))).alias("factual_recall"),
    )
    found = verify(every.select("answer", "side", "pos", "claim", F.posexplode("contexts").alias("rank", "passage")), score)
    support = found.groupBy("answer", "side", "pos").agg(F.max("verdict").alias("v"))
    shares = support.groupBy("answer").agg(F.avg(F.when(F.col("side") == "response", F.col("v"))).alias("faithfulness"), F.avg(F.when(F.col("side") == "reference", F.col("v"))).alias("context_recall"))
    useful = found.where("side = 'reference'").groupBy("answer", "rank").agg(F.max("verdict").alias("v"))
    seen = Window.partitionBy("answer").orderBy("rank")
    at = useful.withColumn("p", F.sum("v").over(seen) / F.row_number().over(seen))
    precision = at.groupBy("answer").agg(F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("p")), F.sum("v")), F.lit(0.0)).alias("context_precision"))
    if embed is not None:
        like = cosine(embed_texts(F.col("question"), embed), embed_texts(F.col("response"), embed))
    else:
        like = score_pairs(F.col("question"), F.col("response"), score)
    m = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    out = texts.select("answer", like.alias("answer_relevancy")).join(counts, "answer", "left").join(shares, "answer", "left").join(precision, "answer", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "fn")}
    return out.withColumns(zero).withColumn("_m", m).select("answer", "tp", "fp", "fn", "_m.precision", "_m.recall", "_m.f1", "faithfulness", F.col("_m.precision").alias("factual_precision"), "factual_recall", "context_precision", "context_recall", "answer_relevancy")


def experiment(questions: DataFrame, run: Callable[[DataFrame], DataFrame], key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(report, failed) of a run over questions: what the run gives back by key, and the questions it left out.

    A question without a result fails alone; the others' rows stand.
    """
    done = run(questions)
    report = questions.join(done, key)
    return report, questions.join(done.select(key), key, "left_anti")


def act_classification(rows: DataFrame, acts: DataFrame, model: Generate, least: float = 0.4) -> DataFrame:
    """act_accuracy of the classifier on (query_id, text, expected): the graph's acts and a model are all it needs."""
    from lexloom.plans.answering import classify

    found = classify(rows, acts, model, least)
    return act_accuracy(found.select("expected", F.col("acts").alias("predicted")))
