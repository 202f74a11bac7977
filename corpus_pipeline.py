"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the next one's docs, with
the columns of documents; the last returns packed pieces.  An empty table goes
through every stage as an empty one; other columns of documents, whatever
their names, are carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import delete_folder, shared_folder, table
from lexloom.llm.jaccard_join import jaccard_join
from lexloom.llm.line_dedup import line_dedup
from lexloom.llm.mixing import mix_to_targets
from lexloom.llm.packing import best_fit_packing
from lexloom.llm.quality import quality_rules
from lexloom.llm.queries import public_tokenizer

#: How often documents of each likeliest domain are wanted: clean ones stay, the rest goes.
SHARES = {"clean": 1.0, "junk": 0.0, "toxic": 0.0}


def _veiled(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but id and text under names that no operator gives, and these names."""
    names = {c: c if c in ("doc_id", "text") else f"_own{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(c).alias(n) for c, n in names.items())), names


def _named(docs: DataFrame, names: dict[str, str], **new: Column) -> DataFrame:
    return docs.select(*(new.get(c, F.col(n)).alias(c) for c, n in names.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    A null or empty text is rejected (too few words), a very long one is judged
    whole; repeated rows are judged each on its own, a null id like any.
    """
    veiled, names = _veiled(docs)
    judged = quality_rules(veiled, table(spark, sf_dir, "labels"), carry=tuple(veiled.columns))
    return _named(judged.where("kept"), names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an other one keeps; n_chars follows.

    A null text becomes an empty one; rows that repeat an id are one document,
    rows of null id lose only lines that others hold.
    """
    veiled, names = _veiled(docs)
    return _named(line_dedup(veiled), names, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id.

    Every row is judged by its own text, also where rows share an id; rows of
    the least id stay together if they are alike.  Rows of null id, and those
    without words, stay.
    """
    copies = jaccard_join(docs, by_row=True).where("doc_id <> class_id").select(F.col("doc_id").alias("_copy"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(copies, (docs.doc_id == F.col("_copy")) & (F.xxhash64(docs.text) == F.col("_hash")), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says, the fraction rounded by a hash of the row.

    So expected totals are kept: of documents of rate 0.3, three in ten stay.
    Equal rows round alike; a null or empty text has the rate of its posterior.
    """
    veiled, names = _veiled(docs)
    rated = mix_to_targets(veiled, table(spark, sf_dir, "labels"), SHARES, carry=tuple(veiled.columns), relative=True)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("mixing"), "doc_id", "text"), 11) / F.lit(2.0**53)
    times = F.floor(F.col("rate") + draw).cast("int")
    taken = rated.withColumn("_times", F.explode(F.array(times))).where("_times > 0")
    return _named(taken.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times")))), names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, each row a document of its own; an empty text is one token."""
    return best_fit_packing(docs, public_tokenizer(), capacity=2048, end=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing to target weights", mixing),
    ("best-fit packing", packing),
]

#: The classifier, the likelihood ratio and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's rows are written to the shared checkpoint folder and reread.

    The folder goes when the last stage, which checkpoints what it still needs, is done, and on an error.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                delete_folder(spark, f"{base}/{k - 1}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        delete_folder(spark, base)
