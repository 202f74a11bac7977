"""Schemas of the corpus tables (DDL), checked when tables are read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

NODES: dict[str, str] = {
    "Act": "id string, title string, eurolex_url string",
    "Chapter": "id string, act_id string, number string, title string, summary string",
    "Section": "id string, chapter_id string, title string",
    "Article": "id string, act_id string, chapter_id string, section_id string, title string, text string, summary string, embedding array<float>",
    "Paragraph": "id string, article_id string, text string, embedding array<float>",
    "Recital": "id string, act_id string, number string, text string, embedding array<float>",
    "Topic": "label string",
    "CaseLaw": "id string, celex string, case_number string, summary string",
    "CaseLawTopic": "id string, celex string, label string",
    "CaseLawSection": "id string, celex string, parent_id string, heading string, depth int, path string, summary string",
    "CaseLawParagraph": "id string, celex string, section_id string, number int, text string, section_heading string, is_operative boolean, embedding array<float>",
}
EDGES = "src_label string, src string, rel string, dst_label string, dst string"
CLASSIFICATION = "intent string, acts array<string>, act_scores map<string,double>, sub_questions array<string>"
ANSWER = "segments array<struct<text:string,markers:array<string>>>, sources array<struct<marker:string,id:string,title:string>>, raw_answer string"


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def empty(spark: SparkSession, label: str) -> DataFrame:
    return spark.createDataFrame([], NODES.get(label, EDGES))
