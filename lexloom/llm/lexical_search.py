"""Ranked lexical search: document-at-a-time over compressed postings, segment by segment, in whole numbers.

The index (lexloom.operators.postings) is written once, as a table in the
shared folder; documents are never shuffled.  Items are read in blocks of
bounded size.  Postings of a block's terms meet by segment, where a heap of
cursors merges them and a heap of k keeps the best; the segments' best meet by
item.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import by_value, checkpoint, delete_folder, shared_folder
from lexloom.operators.postings import ALNUM, Impact, Postings, best_documents, segments, unpacked

#: Bytes of items that are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Parts per hundred of the length norm that don't and do follow a document's length; what it weighs.
FIXED, VARIABLE, NORM = 25, 75, 8
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def terms_of(text: str | None) -> list[str]:
    """Maximal runs of letters, digits and what is beyond ASCII, A-Z in lower case."""
    return _TERM.findall((text or "").translate(_UPPER))


def write_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs, written to `folder` and read back."""
    segments(docs, id_col, text_col, ALNUM, lower=True).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _blocks(items: DataFrame) -> Iterator[list]:
    held, size = [], 0
    for row in items.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        size += 64 + 8 * len(row[1] or "")
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def weight(n_docs: Column, df: Column) -> Column:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return F.floor(1000 * F.log((2 * n_docs + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def norms(lengths: np.ndarray, n_docs: int, words: int) -> np.ndarray:
    """25 + 75 n N div L of each document, in Python's integers where 64 bits might not do."""
    if len(lengths) and VARIABLE * int(lengths.max()) * n_docs >= 2**63:
        return np.array([FIXED + VARIABLE * int(n) * n_docs // words for n in lengths], np.int64)
    return FIXED + VARIABLE * lengths * n_docs // max(1, words)


def impact(w: int, n_docs: int, words: int) -> Impact:
    return lambda count, length: w * ((1_000_000_000 * count) // (1000 * count + NORM * norms(length, n_docs, words)))


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, rank, doc_id and score of each item's k best documents (see ranked_search), over an index of write_index."""
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([items.schema[item_col], T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    schema.fields[0].nullable = True
    own = index.where("term is null").select(F.col("shard").alias("home"), F.col("df").alias("n_docs"), F.col("words").alias("n_words"), F.col("postings").alias("lengths"), F.col("ids").alias("docs"))
    terms = index.where("term is not null").select("shard", "term", "df", "postings")
    totals = own.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("l")).first()
    parts = []
    for block in _blocks(items.select(item_col, text_col)):
        asked = [(row[0], Counter(terms_of(row[1]))) for row in block]
        number = {t: i for i, t in enumerate(dict.fromkeys(t for _, c in asked for t in c))}
        shared = spark.sparkContext.broadcast(([a for a, _ in asked], [[(number[t], f) for t, f in c.items()] for _, c in asked]))
        names = spark.createDataFrame([(t, i) for t, i in number.items()] or [("", -1)], "term string, number int")
        met = terms.join(F.broadcast(names), "term").drop("term")  # as many rows as the block has terms, at most
        df = met.groupBy("number").agg(F.sum("df").alias("n")).select("number", weight(F.lit(totals["n"]), F.col("n")).alias("w")).where("w > 0")
        rows = met.join(F.broadcast(df), "number").select("shard", "number", "df", "w", "postings")
        run = _merged(shared, totals["n"], totals["l"], k, schema)
        parts.append(rows.groupBy("shard").cogroup(own.select("home", "lengths", "docs").groupBy("home")).applyInArrow(run, schema))
    found = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    best = Window.partitionBy(item_col).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(item_col, "rank", "doc_id", "score")


def _merged(shared, n_docs: int, words: int, k: int, schema: T.StructType):  # noqa: ANN001, ANN202
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(terms: pa.Table, own: pa.Table) -> pa.Table:
        names, asked = shared.value
        if not len(terms) or not len(own):
            return out.empty_table()
        lengths = unpacked(np.frombuffer(own["lengths"][0].as_py(), np.uint8))
        ids = own["docs"].combine_chunks().flatten()
        cols = (terms[c].to_pylist() for c in ("number", "df", "w", "postings"))
        held = {i: Postings(data, df, lengths, impact(w, n_docs, words)) for i, df, w, data in zip(*cols)}
        item, doc, score = [], [], []
        for name, wanted in zip(names, asked):
            for s, d in best_documents([(held[i], f) for i, f in wanted if i in held], k, 0):
                item.append(name)
                doc.append(d)
                score.append(s)
        return pa.table([pa.array(item, out.field(0).type), ids.take(pa.array(doc, pa.int64())).cast(out.field(1).type), pa.array(score, pa.int64())], schema=out)

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank, doc_id and score of the k documents that score highest for each item, over 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower
    case.  N documents have a term, L is the number of all terms; a term in df
    documents weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a document
    of n terms has m = 25 + 75 n N div L and scores, over an item's terms with
    their repeats, the sum of w (1000000000 tf div (1000 tf + 8 m)), in 64 bits.
    Equal scores go by id, nulls last.  Every row is a document of its own, also
    where ids repeat; so is every item.  A null or empty text has no terms: such
    an item has no rows.  Very long texts make a segment of their own, empty
    tables no rows; other columns play no part.  The index lies in the shared
    folder and goes when the result, which is checkpointed, is there.
    """
    spark: SparkSession = docs.sparkSession
    folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    numbered = items.select(F.monotonically_increasing_id().alias("_item"), F.col(item_col), F.col(item_text).alias("_text"))
    try:
        names = checkpoint(numbered)
        found = checkpoint(search(write_index(docs, folder, id_col, text_col), names, k, "_item", "_text"))
    finally:
        delete_folder(spark, folder)
    return found.join(names.drop("_text"), "_item").select(item_col, "rank", F.col("doc_id").alias(id_col), "score")


by_value(__name__)
