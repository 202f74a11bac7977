"""BM25 over a stored inverted index whose statistics add up over groups of documents.

An index is written once, as three tables under one folder: postings (dealt by
a hash of their term, sorted by term), segments (the documents' ids and
lengths) and terms (how many documents of each group have a term).  A search
reads the postings of its own terms only, and no text.  What it searches is a
scope: a set of groups whose counts are summed, so that scopes share one index.
"""

from __future__ import annotations

import functools
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import tokens
from lexloom.operators.blocks import in_blocks, words
from lexloom.operators.postings import all_postings, best_by_cells, segments, unpacked
from lexloom.session import cut, remove_folder, shared_folder

K1, B, EPSILON, PLACES = 1.5, 0.75, 0.25, 6
#: Bytes of questions that are broadcast at once; term lists short enough to be pushed down to the files.
BLOCK_BYTES, PUSHED = 16 << 20, 500
#: Rows (of some 30 bytes) that are broadcast, once counted to be so few.
FEW = 500_000
#: Parts that the terms are dealt into, and files that a part's terms may be spread over.
BUCKETS, SPREAD = 16, 4
#: Words of the documents for each part that the terms are summed in: a part's sums take some 100 bytes for each term.
PART_WORDS = 1 << 21
#: Bytes of the terms that an index for certain texts is made for; beyond them it is made for all.
ASKED_BYTES = 64 << 20


@dataclass(frozen=True)
class LexicalIndex:
    """postings: bucket, shard, grp, term, df, postings; segments: shard, grp, ids, lengths, words; terms: grp, term, df."""

    postings: DataFrame
    segments: DataFrame
    terms: DataFrame

    def groups(self) -> DataFrame:
        """grp, n_docs, words."""
        return self.segments.groupBy("grp").agg(F.sum(F.size("ids")).alias("n_docs"), F.sum("words").alias("words"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, folder: str, id_col: str = "doc", text_col: str = "text", group: str | None = None) -> LexicalIndex:
    """Index white-space tokens in their own case, a document's group being `group` (or all one), and read it back.

    Null ids, repeated rows and null texts are documents like any; a frequent
    term's postings are spread over SPREAD files of its bucket.
    """
    raw = _write_raw(docs, f"{folder}/raw", id_col, text_col, group)
    raw.segments.write.parquet(f"{folder}/segments")
    dealt = raw.postings.repartition("bucket", F.pmod(F.xxhash64("shard"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term")
    dealt.write.partitionBy("bucket").parquet(f"{folder}/postings")
    _dealt(raw, raw.terms).groupBy("grp", "term").agg(F.sum("df").alias("df")).write.parquet(f"{folder}/terms")
    remove_folder(docs.sparkSession, f"{folder}/raw")
    return read_index(docs.sparkSession, folder)


def _write_raw(docs: DataFrame, folder: str, id_col: str, text_col: str, group: str | None, asked=None) -> LexicalIndex:  # noqa: ANN001
    """The segments as they are made, a file a task, their terms not yet summed: an index that is asked once needs no more."""
    rows = docs.withColumn("_grp", F.col(group).cast("string") if group else F.lit(""))
    segments(rows, id_col, text_col, group="_grp", asked=asked).write.parquet(folder)
    raw = docs.sparkSession.read.parquet(folder)
    terms = raw.where("term is not null")
    own = raw.where("term is null").select("shard", "grp", "ids", F.col("postings").alias("lengths"), "words")
    return LexicalIndex(terms.where("postings is not null").select(_bucket(F.col("term")).alias("bucket"), "shard", "grp", "term", "df", "postings"), own, terms.select("grp", "term", "df"))


def write_once(docs: DataFrame, folder: str, asked: DataFrame, id_col: str = "doc", text_col: str = "text", group: str | None = None) -> LexicalIndex:
    """An index that answers these texts (asked: text) alone: other terms are counted and have no postings.

    Where the texts have more than ASKED_BYTES of terms, all terms have postings.
    """
    terms = asked.select(F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term")).distinct()
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    shared = docs.sparkSession.sparkContext.broadcast(terms.toArrow()["term"].combine_chunks().cast(pa.large_string())) if size <= ASKED_BYTES else None
    return _write_raw(docs, folder, id_col, text_col, group, shared)


def read_index(spark: SparkSession, folder: str) -> LexicalIndex:
    return LexicalIndex(*(spark.read.parquet(f"{folder}/{n}") for n in ("postings", "segments", "terms")))


@contextmanager
def index_of(docs: DataFrame, asked: DataFrame, id_col: str = "doc", text_col: str = "text", group: str | None = None) -> Iterator[LexicalIndex]:
    """An index for the texts asked, in the shared folder, for the time being; results must be materialised before it goes."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    try:
        yield write_once(docs, folder, asked, id_col, text_col, group)
    finally:
        remove_folder(spark, folder)


def scope_statistics(index: LexicalIndex, members: DataFrame, pairs: int) -> DataFrame:
    """scope, n_docs, avgdl, mean_idf of members (scope, grp; so many rows): sums of their groups' counts, and the mean over all their terms.

    Terms are dealt once, by themselves alone, and summed where they meet, in parts that grow in number, not in size.
    """
    totals = members.join(index.groups().withColumnRenamed("grp", "_g"), F.col("grp").eqNullSafe(F.col("_g")))
    totals = cut(totals.groupBy("scope").agg(F.sum("n_docs").alias("n_docs"), (F.sum("words") / F.sum("n_docs")).alias("avgdl")))
    raw = _frequencies(_dealt(index, index.terms), _few(members, pairs)).join(_few(totals, pairs), "scope").groupBy("scope").agg(F.avg(_raw_idf()).alias("mean_idf"))
    return totals.join(raw, "scope", "left")


def _dealt(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """The terms by themselves, in a part for every PART_WORDS words of the index."""
    words = index.segments.agg(F.sum("words")).first()[0] or 0
    return terms.repartition(max(1, -(-words // PART_WORDS)), "term")


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def _frequencies(terms: DataFrame, members: DataFrame) -> DataFrame:
    """scope, term, df."""
    own = terms.withColumnRenamed("grp", "_g")
    return own.join(members, F.col("grp").eqNullSafe(F.col("_g"))).groupBy("scope", "term").agg(F.sum("df").alias("df"))


def _raw_idf() -> Column:
    return F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _local(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    return spark.createDataFrame(pa.table(columns))


def search(index: LexicalIndex, queries: DataFrame, k: int, members: DataFrame | None = None, everywhere: bool = False) -> DataFrame:
    """query_id, scope, doc, score (6 places): what can be among a query's k best documents of a scope, by segment.

    queries: query_id, text, and scope where members (scope, grp) are given: a
    query is asked of its own scope, or with everywhere of all of them.
    Without members the whole index is the scope ''.  A document is found if it
    has a term of the query; ties within a segment go by id, nulls last, and the caller ranks
    what the segments give.  Queries are met in blocks of BLOCK_BYTES.
    """
    spark = index.postings.sparkSession
    if members is None:
        members = index.segments.select("grp").distinct().withColumn("scope", F.lit(""))
        queries = queries.withColumn("scope", F.lit(""))
    own_scope = not everywhere
    members = cut(members.select("scope", "grp").distinct())
    pairs, parts = members.count(), []  # of scopes and their groups
    numbered = cut(scope_statistics(index, members, pairs).withColumn("_s", F.xxhash64("scope")))  # a row a scope
    kind = index.segments.schema["ids"].dataType.elementType
    schema = T.StructType([queries.schema["query_id"], T.StructField("doc", kind), T.StructField("score", T.DoubleType()), T.StructField("_s", T.LongType())])
    schema.fields[0].nullable = True
    asked = queries.select("query_id", "text", F.xxhash64("scope").alias("_s") if own_scope else F.lit(None).cast("long").alias("_s"))
    for block in in_blocks(asked, lambda r: 8 * len(r["text"] or "") + 64, BLOCK_BYTES):
        counts = [Counter(words(r["text"])) for r in block]
        number = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        sizes = np.cumsum([0, *(len(c) for c in counts)])
        flat = np.array([(number[t], f) for c in counts for t, f in c.items()], np.int32).reshape(-1, 2)
        homes = np.array([r["_s"] for r in block], np.int64) if own_scope and len(block) else None
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in block], homes, sizes, flat))
        names = F.broadcast(_local(spark, term=pa.array(list(number), pa.string()), number=pa.array(list(number.values()), pa.int32())))
        here = members.withColumn("_s", F.xxhash64("scope"))
        if own_scope:  # only scopes that the block asks of
            wanted = _local(spark, _w=pa.array(list({r["_s"] for r in block}), pa.int64()))
            here = here.join(F.broadcast(wanted), F.col("_s") == F.col("_w"), "left_semi")
        stats = _few(numbered.select("_s", "n_docs", "avgdl", "mean_idf"), pairs)
        df = _frequencies(index.terms.join(names, "term").select("grp", F.col("number").alias("term"), "df"), _few(here.select(F.col("_s").alias("scope"), "grp"), pairs))
        idf = df.join(stats, F.col("scope") == F.col("_s")).withColumn("raw", _raw_idf())
        idf = idf.select("scope", F.col("term").alias("number"), F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
        # What a group's segments need: for each term its weight in every scope that has the group, and these scopes' mean lengths.
        weights = here.select("_s", F.col("grp").alias("_g")).join(idf, F.col("_s") == F.col("scope")).groupBy("_g", "number").agg(F.collect_list(F.struct("_s", "idf")).alias("weights"))
        scopes = here.select("_s", F.col("grp").alias("_g")).join(_few(numbered.select(F.col("_s").alias("_t"), "avgdl"), pairs), F.col("_s") == F.col("_t")).groupBy("_g").agg(F.collect_list(F.struct("_s", "avgdl")).alias("scopes"))
        met = _postings_of(index.postings, names, number).withColumnRenamed("number", "_n").join(_few(weights, pairs * len(number)), F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_n") == F.col("number")))
        own = index.segments.join(_few(scopes, pairs), F.col("grp").eqNullSafe(F.col("_g"))).select(F.col("shard").alias("home"), "ids", "lengths", "scopes")
        run = _merged(shared, k, schema)
        parts.append(met.select("shard", "number", "df", "postings", "weights").groupBy("shard").cogroup(own.groupBy("home")).applyInArrow(run, schema))
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.join(_few(numbered.select(F.col("_s").alias("_t"), "scope"), pairs), F.col("_s") == F.col("_t")).select("query_id", "scope", "doc", "score")


def _postings_of(postings: DataFrame, names: DataFrame, number: dict[str, int]) -> DataFrame:
    """The rows of these terms: their buckets' files, of these (if terms are few) their own row groups."""
    parts = [r[0] for r in names.select(_bucket(F.col("term"))).distinct().collect()]  # BUCKETS at most
    rows = postings.where(F.col("bucket").isin(parts))
    if len(number) <= PUSHED:
        rows = rows.where(F.col("term").isin(list(number) or [""]))
    return rows.join(names, "term").select("shard", "grp", "number", "df", "postings")


def _merged(shared, k: int, schema: T.StructType):  # noqa: ANN001, ANN202
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(terms: pa.Table, own: pa.Table) -> pa.Table:
        if not len(terms) or not len(own):
            return out.empty_table()
        names, asked, sizes, flat = shared.value
        lengths = unpacked(np.frombuffer(own["lengths"][0].as_py(), np.uint8))
        ids = own["ids"].combine_chunks().flatten()
        df = terms["df"].to_numpy().astype(np.int64)
        docs, counts = all_postings(terms["postings"].combine_chunks().cast(pa.large_binary()), df)
        first, length = np.cumsum(df) - df, lengths[docs]
        # The questions' terms that the segment has, and their scopes' weights of them.
        place = np.full(int(flat[:, 0].max()) + 1, -1)
        place[terms["number"].to_numpy()] = np.arange(len(df))
        there = np.flatnonzero(place[flat[:, 0]] >= 0)
        question = np.searchsorted(sizes, there, "right") - 1
        term, factor = place[flat[there, 0]], flat[there, 1]
        weights = terms["weights"].combine_chunks()
        owner = np.repeat(np.arange(len(df)), weights.value_lengths().to_numpy())
        of, idf = (weights.flatten().field(c).to_numpy() for c in ("_s", "idf"))
        homes = None if asked is None else asked[question]
        parts = []
        for s in own["scopes"][0].as_py():
            weight = np.full(len(df), np.nan)
            weight[owner[of == s["_s"]]] = idf[of == s["_s"]]
            mine = ~np.isnan(weight[term]) if homes is None else ~np.isnan(weight[term]) & (homes == s["_s"])
            if mine.any():
                worth = np.repeat(weight, df) * (counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / s["avgdl"])))
                parts.append((s["_s"], *best_by_cells(docs, worth, first, df, question[mine], term[mine], factor[mine], k, len(lengths), PLACES)))
        if not parts:
            return out.empty_table()
        scope = np.concatenate([np.full(len(q), s) for s, q, _, _ in parts])
        query, doc, score = (np.concatenate([p[c] for p in parts]) for c in (1, 2, 3))
        return pa.table([pa.array([names[q] for q in query.tolist()], out.field(0).type), ids.take(pa.array(doc)).cast(out.field(1).type), pa.array(score), pa.array(scope)], schema=out)

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
