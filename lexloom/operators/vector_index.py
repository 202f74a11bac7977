"""A vector index of cells and short codes, searched approximately and scored exactly; and the exact way.

Cells and code books are fitted on a bounded sample; every vector is then put
into its nearest cell and coded, and stored by cell.  A search reads the codes
of the cells nearest to its queries, takes the best by the codes' inner
products, and scores these anew by their vectors.
"""

from __future__ import annotations

import functools
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators.blocks import _matrix, in_blocks, similar
from lexloom.operators.retrieval import dense_top_k, top_k
from lexloom.session import cut

#: Vectors that cells and code books are fitted on; parts of a vector that are coded, and codes of a part.
SAMPLE, PARTS, CODES = 20_000, 16, 64
#: Files that a cell may be spread over; rounds of k-means.
SPREAD, ROUNDS = 4, 12


def k_means(x: np.ndarray, k: int, seed: int = 13) -> np.ndarray:
    """Centres of Lloyd's rounds from seeded rows; an empty one takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        far = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)
        own = far.argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        left = far[np.arange(len(x)), own]
        for empty in np.flatnonzero(n == 0):
            centres[empty] = x[left.argmax()]
            left[left.argmax()] = -1
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """rows: cell, id, code, embedding, stored by cell; centres (cells x dim) and books (PARTS x CODES x dim / PARTS) are of fixed size."""

    rows: DataFrame
    centres: np.ndarray
    books: np.ndarray

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """(queries, PARTS, CODES): what each code of each part adds to a query's inner product."""
        parts = queries.reshape(len(queries), len(self.books), -1)
        return np.einsum("qpd,pcd->qpc", parts, self.books)


def write_vector_index(vectors: DataFrame, folder: str, dim: int, cells: int, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> VectorIndex:
    """Fit, code and store all vectors of `dim` numbers; others (null, shorter, with nulls) are left out.

    The sample is that of the `sample` least hashes of ids and vectors, whatever
    the partitions.  dim must be a multiple of PARTS.
    """
    spark = vectors.sparkSession
    whole = F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    own = vectors.where(whole).select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("float")).alias("embedding"))
    picked = own.withColumn("_h", F.xxhash64("id", "embedding")).orderBy("_h", "id").limit(sample).select("embedding").toArrow()
    x = np.array(picked["embedding"].combine_chunks().flatten(), np.float64).reshape(-1, dim)
    if not len(x):
        x = np.zeros((1, dim))
    centres = k_means(x, cells)
    near = _nearest(x, centres)
    rest = (x - centres[near]).reshape(len(x), PARTS, -1)
    books = np.zeros((PARTS, CODES, dim // PARTS))
    for p in range(PARTS):
        found = k_means(rest[:, p], CODES, seed=p)
        books[p, : len(found)] = found
    schema = T.StructType([T.StructField("cell", T.IntegerType()), *own.schema.fields[:1], T.StructField("code", T.BinaryType()), own.schema.fields[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column(1), dim)
            cell = _nearest(x, centres)
            rest = (x - centres[cell]).reshape(len(x), PARTS, -1)
            code = np.stack([_nearest(rest[:, p], books[p]) for p in range(PARTS)], 1).astype(np.uint8) if len(x) else np.zeros((0, PARTS), np.uint8)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), taken.column(0), pa.array([c.tobytes() for c in code], pa.binary()), taken.column(1)], schema.names)

    rows = own.mapInArrow(run, schema)
    rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).write.partitionBy("cell").parquet(f"{folder}/rows")
    kept = T.StructType([*schema.fields[1:], schema.fields[0]])
    text = json.dumps({"centres": centres.tolist(), "books": books.tolist(), "rows": kept.json()})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/model")
    return read_vector_index(spark, folder)


def read_vector_index(spark: SparkSession, folder: str) -> VectorIndex:
    model = json.loads(spark.read.text(f"{folder}/model").first().value)
    kind = T.StructType.fromJson(json.loads(model["rows"]))
    return VectorIndex(spark.read.schema(kind).parquet(f"{folder}/rows"), np.array(model["centres"]), np.array(model["books"]))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def vector_top_k(index: VectorIndex, queries: DataFrame, k: int, probes: int, rescore: int = 8, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """query_id, doc, score and rank of the k vectors of the largest inner products, among those of each query's `probes` cells.

    rescore times k candidates by code are scored by their vectors.  A query of
    another length finds nothing.  Queries come in blocks; a block's cells are
    the only ones read, and only their codes, but for the candidates'.
    """
    spark, dim = index.rows.sparkSession, index.centres.shape[1]
    kind = index.rows.schema["id"].dataType
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("doc", kind), T.StructField("near", T.DoubleType())])
    parts = []
    for block in in_blocks(queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("v")), lambda r: 8 * len(r["v"] or ()) + 64):
        own = [r for r in block if r["v"] is not None and len(r["v"]) == dim and all(x is not None for x in r["v"])]
        asked = np.array([r["v"] for r in own], float).reshape(len(own), dim)
        inner = asked @ index.centres.T
        cells = np.argsort(-inner, 1, kind="stable")[:, :probes]
        by_cell: dict[int, list[int]] = {}
        for q, some in enumerate(cells.tolist()):
            for c in some:
                by_cell.setdefault(c, []).append(q)
        shared = spark.sparkContext.broadcast((by_cell, inner, index.scores(asked).astype(np.float32), k * rescore))
        read = index.rows.where(F.col("cell").isin(sorted(by_cell) or [-1]))
        near = read.select("cell", "id", "code").mapInArrow(_coded(shared, schema), schema)
        best = top_k(near, k * rescore, ("q",), "near")
        names = F.broadcast(spark.createDataFrame([(q, r["query_id"], [float(x) for x in r["v"]]) for q, r in enumerate(own)], T.StructType([T.StructField("n", T.IntegerType()), T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("v", T.ArrayType(T.DoubleType()))])))
        vectors = read.select(F.col("cell").alias("c"), F.col("id").alias("i"), "embedding")
        met = best.join(vectors, (F.col("cell") == F.col("c")) & F.col("doc").eqNullSafe(F.col("i"))).join(names, F.col("q") == F.col("n"))
        score = F.aggregate(F.zip_with("embedding", "v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        parts.append(met.select("query_id", "doc", F.round(score, 9).alias("score")))
    return top_k(functools.reduce(DataFrame.unionByName, parts), k)


def _coded(shared, schema: T.StructType):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cell, inner, tables, most = shared.value
        parts = np.arange(tables.shape[1])
        for batch in batches:
            cell = batch.column(0).to_numpy()
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cell), -1)
            found = []
            for c in np.unique(cell).tolist():
                rows = np.flatnonzero(cell == c)
                for q in by_cell.get(c, ()):
                    near = inner[q, c] + tables[q][parts, code[rows]].sum(1)
                    at = np.argpartition(-near, most - 1)[:most] if len(near) > most else np.arange(len(near))
                    found.append((np.full(len(at), c), np.full(len(at), q), rows[at], near[at]))
            if found:
                c, q, at, near = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(q.astype(np.int32)), batch.column(1).take(pa.array(at)), pa.array(near.astype(float))], schema.names)

    return run


def exact_top_k(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """The same over all rows and by their vectors alone."""
    return dense_top_k(index.rows, queries, k, id_col="id")


def _own_questions(index: VectorIndex, asked: int) -> DataFrame:
    return index.rows.withColumn("_h", F.xxhash64("id", "embedding")).orderBy("_h").limit(asked).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _own_nearest(index: VectorIndex, some: DataFrame, k: int) -> DataFrame:
    """cell, doc, query_id, score, rank of each question's true nearest, not itself."""
    near = similar(index.rows, ["id", "cell"], "embedding", some, ["query_id"], "query_vector", k=k + 1, cosine=False).withColumnRenamed("id", "doc").where(~F.col("doc").eqNullSafe(F.col("query_id")))
    return top_k(near, k)


def choose_search(index: VectorIndex, k: int, least: float = 0.95, asked: int = 200) -> tuple[int, int]:
    """(probes, rescore) with which `asked` of the index's own vectors find `least` of their true nearest, on the mean.

    How many candidates the codes need grows with the index, so their number is
    doubled until enough is found; all of the cells' rows are exact, and the
    cells hold more than that.
    """
    probes = choose_probes(index, k, (1 + least) / 2, asked)
    some = cut(_own_questions(index, asked))
    truth, n, rescore = cut(_own_nearest(index, some, k).select("query_id", "doc")), index.rows.count(), 8
    while True:
        found = vector_top_k(index, some, k + 1, probes, rescore).where(~F.col("doc").eqNullSafe(F.col("query_id")))
        mean = recall(found, truth).agg(F.avg("recall")).first()[0]
        if mean is None or mean >= least or k * rescore >= n:
            return probes, rescore
        rescore *= 2


def choose_probes(index: VectorIndex, k: int, least: float = 0.95, asked: int = 200) -> int:
    """The least number of cells that hold `least` of the true nearest of `asked` of the index's own vectors, those of the least hashes."""
    some = _own_questions(index, asked)
    found = _own_nearest(index, some, k).select("query_id", "cell").collect()  # at most asked x k
    vectors = {r["query_id"]: np.array(r["query_vector"], float) for r in some.collect()}
    order = {q: np.argsort(np.argsort(-(index.centres @ v), kind="stable")) for q, v in vectors.items()}
    places = sorted(int(order[r["query_id"]][r["cell"]]) for r in found)
    return places[min(len(places) - 1, int(np.ceil(least * len(places))))] + 1 if places else 1


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id and the share of its true documents (query_id, doc) that were found."""
    hit = found.select("query_id", "doc").withColumn("_hit", F.lit(1))
    return truth.select("query_id", "doc").join(hit, ["query_id", "doc"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
