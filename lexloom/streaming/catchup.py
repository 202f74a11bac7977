"""Changed rows of a stream into a bucket table, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.tables import BucketTable
from lexloom.providers import Embed, embed_texts


def catch_up(changes: DataFrame, table: BucketTable, checkpoint: str, name: str, change: Callable[[DataFrame], DataFrame] | None = None, everything: bool = True) -> StreamingQuery:
    """Start a query that upserts a stream's rows, after `change`, into a table.

    The batch's number is recorded with the table's version, so a batch that is
    run again after a failure, or a lost checkpoint commit, changes nothing.
    `everything` takes all that is there and ends; else the query goes on.  name
    tells the sources of one table apart and must stay the same on restart.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table.upsert(change(batch) if change else batch, source=name, batch=number)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if everything else writer).start()


def missing_vectors(embed: Embed, text: str = "text", vector: str = "embedding") -> Callable[[DataFrame], DataFrame]:
    """A change that fills in the vectors of rows that have a text and none, and passes only these on."""

    def change(batch: DataFrame) -> DataFrame:
        rows = batch.where(F.col(vector).isNull() & (F.coalesce(F.trim(text), F.lit("")) != ""))
        return rows.withColumn(vector, embed_texts(F.col(text), embed))

    return change
