"""Reports and documents out."""

from __future__ import annotations

import logging
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.vectors import normalised


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """Header CSV; arrays are packed with a pipe, structs as JSON.

    single makes one file, for reports of a dataset's questions; larger tables
    are written as they are dealt, a file a task.
    """
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        cols.append(F.array_join(f.name, "|").alias(f.name) if kind == "array" and f.dataType.elementType.typeName() == "string" else F.to_json(f.name).alias(f.name) if kind in ("array", "map", "struct") else F.col(f.name))
    rows = df.select(*cols)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], base: str, partition: dict[str, Sequence[str]] | None = None) -> None:
    """Parquet tables, partitioned where named, so that an act's scan reads its own files."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        keys = (partition or {}).get(name)
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{base}/{name}")


def concept_report(concepts: DataFrame) -> DataFrame:
    """Active concepts by label with their sorted distinct terms."""
    return concepts.where("active").select("label", F.array_sort(F.array_distinct("terms")).alias("terms")).orderBy("label")


def dot_lines(sections: DataFrame) -> DataFrame:
    """Graphviz text of each judgment's section tree; long labels are cut."""
    label = F.when(F.length("heading") > 45, F.concat(F.substring("heading", 1, 44), F.lit("..."))).otherwise(F.col("heading"))
    node = F.format_string('  n%d [label="%s"];', F.col("seq"), F.regexp_replace(label, '"', "'"))
    edge = F.when(F.col("parent_seq").isNotNull(), F.format_string("\n  n%d -> n%d;", F.col("parent_seq"), F.col("seq"))).otherwise("")
    rows = sections.groupBy("celex").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(node, edge).alias("l")))).alias("_l"))
    return rows.select("celex", F.concat(F.lit("digraph {\n"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n"), F.lit("\n}")).alias("dot"))


def clear(tables: dict[str, DataFrame], base: str) -> None:
    """Delete all: every table is overwritten by an empty one of its schema."""
    write_tables({name: df.limit(0) for name, df in tables.items()}, base)


def create_vector_index(nodes: DataFrame, base: str, dim: int, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """id, embedding of unit length, written anew to `base` and read back: what dense search scans.

    Cosine likeness is then the dot product.  Vectors of another length than
    `dim`, or of no length, are left out.  The search stays exact, so there is
    no more to an index than that.
    """
    rows = nodes.where(F.size(column) == dim).select(F.col(id_col).alias("id"), normalised(F.col(column)).alias("embedding"))
    rows.where(~F.exists("embedding", lambda x: x.isNull())).write.mode("overwrite").parquet(base)
    return nodes.sparkSession.read.parquet(base)


def land_pages(pages: DataFrame, base: str) -> DataFrame:
    """celex, html_file, eurolex_url, document_info_url of fetched pages (celex, html, url), written as one Parquet table.

    Fetching is outside the engine: pages come from whoever fetched them.  What
    is too short to be a document is not landed.
    """
    good = pages.where(F.length("html") >= 1000)
    good.write.mode("overwrite").parquet(base)
    return good.select("celex", F.lit(base).alias("html_file"), F.col("url").alias("eurolex_url"), F.concat("url", F.lit("&info=1")).alias("document_info_url"))


def run_log(path: str, name: str = "lexloom") -> logging.Logger:
    """A logger that also writes to a file, once however often it is asked for."""
    log = logging.getLogger(name)
    if not any(isinstance(h, logging.FileHandler) and h.baseFilename == os.path.abspath(path) for h in log.handlers):
        handler = logging.FileHandler(path, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log
