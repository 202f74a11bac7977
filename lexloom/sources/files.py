"""Evaluation tables and question files."""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.schemas import require

QUESTIONS = ("act", "question", "ground_truth")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] = QUESTIONS, schema: str | None = None) -> DataFrame:
    """Header CSV with quoted cells over several lines; all strings unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return require((reader.schema(schema) if schema else reader).csv(path), columns)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {act, question, ground_truth}."""
    return require(spark.read.option("multiLine", True).schema("act string, question string, ground_truth string").json(path), QUESTIONS)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its name without the suffix as celex, and its html."""
    rows = spark.read.option("wholetext", True).text(path)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.x?html?)?$", 1).alias("celex"), F.col("value").alias("html"))


def results(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = ("question", "ground_truth", "answer")) -> list[str]:
    """Those of the CSV files that have the columns, the newest first: one pass reads all headers."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_block_start").alias("b"), "value")
    first = lines.where("b = 0").groupBy("p", "t").agg(F.first("value").alias("header")).collect()  # a row a file
    kept = [(r["t"], r["p"]) for r in first if set(columns) <= {c.strip().strip('"') for c in r["header"].split(",")}]
    given = {re.sub(r"^\w+:/*", "/", p): p for p in paths}
    return [given.get(re.sub(r"^\w+:/*", "/", p), p) for _, p in sorted(kept, reverse=True)]


def celex_list(spark: SparkSession, explicit: Sequence[str] | None, known: DataFrame, limit: int | None = None) -> DataFrame:
    """celex: the ids given, in upper case, or those known, the first `limit` by id."""
    if explicit:
        return spark.createDataFrame([(c.upper(),) for c in explicit], "celex string")
    rows = known.select("celex").distinct()
    return rows.orderBy("celex").limit(limit) if limit is not None else rows


def fetched(urls: DataFrame, fetch: Callable[[str], str], least: int = 1000) -> DataFrame:
    """celex, url, html, error of (celex, url): pages as a caller's function gives them.

    A page that fails, or is too short to be a document, has an error and no
    html; the others' rows stand.  The engine itself opens no connection.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for celex, url in zip(f["celex"], f["url"]):
                try:
                    html = fetch(url)
                    rows.append((celex, url, html, None) if html is not None and len(html) >= least else (celex, url, None, "too short"))
                except Exception as e:  # noqa: BLE001
                    rows.append((celex, url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["celex", "url", "html", "error"])

    return urls.select("celex", "url").mapInPandas(run, "celex string, url string, html string, error string")


def html_text(data: bytes) -> str:
    """The text of a page, a line a block of text."""
    from lexloom.sources.html import tree

    return "\n".join(t for t in (" ".join(s.split()) for s in tree(data.decode("utf-8", "replace")).strings(frozenset(("script", "style", "head")))) if t)


def pdf_text(data: bytes) -> str:
    """The strings that a simple PDF's page streams show, a line a text operator; encoded fonts aren't decoded."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for shown in re.finditer(rb"(\[(?:[^\]\\]|\\.)*\]|\((?:[^()\\]|\\.)*\))\s*(?:TJ|Tj|'|\")", body, re.S):
            parts = re.findall(rb"\(((?:[^()\\]|\\.)*)\)", shown[1], re.S)
            out.append(re.sub(rb"\\([()\\])", rb"\1", b"".join(parts)).decode("latin-1"))
    return "\n".join(out)


#: What reads a file of each suffix.
CONVERTERS: dict[str, Callable[[bytes], str]] = {"html": html_text, "htm": html_text, "xhtml": html_text, "pdf": pdf_text}


def convert(spark: SparkSession, path: str, converters: dict[str, Callable[[bytes], str]] = CONVERTERS) -> DataFrame:
    """path, text, error of every file below a path, by its suffix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, data in zip(f["path"], f["content"]):
                suffix = name.rsplit(".", 1)[-1].lower()
                try:
                    rows.append((name, converters[suffix](bytes(data)), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
