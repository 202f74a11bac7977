"""A stated set (queries, concepts, seeds) against all rows of a table, in blocks of bounded size.

The stated set is read block by block, at most BLOCK_BYTES each; a block is
broadcast and meets the table in one pass, as matrix products over Arrow
batches.  Nothing is joined, so nothing turns into a cartesian product.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the stated set that are broadcast at once, and of it that meet a batch at once.
BLOCK_BYTES, SLICE = 64 << 20, 256


def in_blocks(side: DataFrame, weigh, most: int = BLOCK_BYTES) -> Iterator[list]:  # noqa: ANN001
    """Rows of the stated set, as many as weigh `most` bytes; at least one block, maybe empty."""
    held: list = []
    size, some = 0, False
    for row in side.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        size += weigh(row)
        if size >= most:
            yield held
            held, size, some = [], 0, True
    if held or not some:
        yield held


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of that many numbers, none of them null, and their rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(ok), dim)
    whole = ~np.isnan(flat).any(1)
    return flat[whole], ok[whole]


def similar(rows: DataFrame, row_cols: Sequence[str], vector: str, side: DataFrame, side_cols: Sequence[str], side_vector: str, least: float | None = None, k: int | None = None, cosine: bool = True) -> DataFrame:
    """row_cols, side_cols and score (rounded to 9 places) of the pairs scored at least `least`.

    With k, only those that can be among an entry of side's k best are given
    back, ties included, batch by batch; the caller ranks what is left.  Null
    vectors, those of another length and, for cosines, those of no length are
    in no pair.
    """
    spark = rows.sparkSession
    weigh = lambda r: 8 * len(r[-1] or ()) + 64
    schema = T.StructType([*rows.select(*row_cols).schema.fields, *side.select(*side_cols).schema.fields, T.StructField("score", T.DoubleType())])
    n_rows, kinds = len(row_cols), [f.dataType for f in side.select(*side_cols).schema.fields]
    parts = []
    for block in in_blocks(side.select(*side_cols, side_vector), weigh):
        dims = Counter(len(r[-1]) for r in block if r[-1] is not None and all(x is not None for x in r[-1]))
        for dim in sorted(dims) or [0]:
            own = [r for r in block if r[-1] is not None and len(r[-1]) == dim and all(x is not None for x in r[-1])]
            shared = spark.sparkContext.broadcast(([tuple(r[:-1]) for r in own], np.array([r[-1] for r in own], float).reshape(len(own), dim)))
            run = _similar(shared, n_rows, kinds, dim, least, k, cosine)
            parts.append(rows.select(*row_cols, vector).mapInArrow(run, schema))
    return functools.reduce(DataFrame.unionByName, parts)


def _similar(shared, n_rows: int, kinds: list, dim: int, least: float | None, k: int | None, cosine: bool):  # noqa: ANN001, ANN202
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(t) for t in kinds]

    def unit(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return x / np.sqrt((x * x).sum(1, keepdims=True)) if cosine else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, other = shared.value
        other = unit(other)
        for batch in batches:
            mine, at = _matrix(batch.column(n_rows), dim)
            mine = unit(mine)
            for lo in range(0, len(keys), SLICE):
                score = np.round(mine @ other[lo : lo + SLICE].T, 9) + 0.0
                good = ~np.isnan(score)
                if least is not None:
                    good &= score >= least
                if k is not None and len(score) > k:
                    bound = -np.partition(np.where(good, -score, np.inf), k - 1, axis=0)[k - 1]
                    good &= score >= bound
                i, j = np.nonzero(good)
                if len(i):
                    taken = batch.take(pa.array(at[i]))
                    sides = [pa.array([keys[lo + x][c] for x in j.tolist()], t) for c, t in enumerate(arrow)]
                    yield pa.RecordBatch.from_arrays([*taken.columns[:n_rows], *sides, pa.array(score[i, j])], [str(n) for n in range(n_rows + len(arrow) + 1)])

    return run


def best_senses(terms: DataFrame, side: DataFrame, least: float, k: int | None) -> DataFrame:
    """term, definition, label, score: what can be among a label's k best terms (None: all) of at least that score.

    terms: term, definition, embedding, a row a sense (a dictionary's few for
    each term); side: label, embedding, centroid.  A term counts for a label by
    the sense most like its embedding (ties: the least definition); score is
    that likeness plus the sense's to the centroid, each to 9 places.
    """
    spark = terms.sparkSession
    packed = terms.where(F.col("embedding").isNotNull()).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("definition", "embedding"))).alias("senses"))
    schema = T.StructType([*terms.select("term", "definition").schema.fields, side.schema["label"], T.StructField("score", T.DoubleType())])
    parts = []
    for block in in_blocks(side.select("label", "embedding", "centroid"), lambda r: 8 * len(r[1] or ()) + 8 * len(r[2] or ()) + 64):
        whole = [r for r in block if all(v is not None and all(x is not None for x in v) for v in r[1:]) and len(r[1]) == len(r[2])]
        for dim in sorted({len(r[1]) for r in whole}) or [0]:
            own = [r for r in whole if len(r[1]) == dim]
            shared = spark.sparkContext.broadcast(([r[0] for r in own], *(np.array([r[c] for r in own], float).reshape(len(own), dim) for c in (1, 2))))
            parts.append(packed.mapInArrow(_senses(shared, dim, least, k, schema), schema))
    return functools.reduce(DataFrame.unionByName, parts)


def _senses(shared, dim: int, least: float, k: int | None, schema: T.StructType):  # noqa: ANN001, ANN202
    from pyspark.sql.pandas.types import to_arrow_type

    def unit(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return x / np.sqrt((x * x).sum(1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, embedding, centroid = shared.value
        embedding, centroid = unit(embedding), unit(centroid)
        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        for batch in batches:
            senses = batch.column(1)
            of = np.repeat(np.arange(len(senses)), senses.value_lengths().to_numpy(zero_copy_only=False))
            flat = senses.flatten()
            x, at = _matrix(flat.field("embedding"), dim)
            x = unit(x)
            if not len(x):
                continue
            of, definition = of[at], flat.field("definition").take(pa.array(at))
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            size = np.diff(np.append(first, len(of)))
            for lo in range(0, len(names), SLICE):
                sense, like = np.round(x @ embedding[lo : lo + SLICE].T, 9) + 0.0, np.round(x @ centroid[lo : lo + SLICE].T, 9) + 0.0
                sense[np.isnan(sense)] = -np.inf
                best = np.repeat(np.maximum.reduceat(sense, first, axis=0), size, axis=0)
                row = np.minimum.reduceat(np.where(sense == best, np.arange(len(x))[:, None], len(x)), first, axis=0)
                score = np.round(np.take_along_axis(sense, row, 0) + np.take_along_axis(like, row, 0), 9) + 0.0
                good = np.isfinite(score) & (score >= least)
                if k is not None and len(score) > k:
                    good &= score >= -np.partition(np.where(good, -score, np.inf), k - 1, axis=0)[k - 1]
                i, j = np.nonzero(good)
                if len(i):
                    picked = row[i, j]
                    cols = [batch.column(0).take(pa.array(of[picked])), definition.take(pa.array(picked)), pa.array([names[lo + c] for c in j.tolist()], kinds[2]), pa.array(score[i, j])]
                    yield pa.RecordBatch.from_arrays(cols, schema.names)

    return run


def words(text: str | None) -> list[str]:
    """White-space tokens, as functions.text.tokens gives them."""
    text = text or ""
    for c in "\t\n\x0b\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
