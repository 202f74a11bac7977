"""Answers: sources, attribution and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import cut


def number_sources(docs: DataFrame, by: str = "answer", pos: str = "pos", wide: bool = False) -> DataFrame:
    """S1, S2, ... in rank order, and the kind of provision each id names.

    wide: an answer may have more sources than a task should hold.  They are
    then sorted over all tasks, numbered within each, and each task's count of
    an answer is added to the numbers of those behind it.
    """
    if wide:
        own = cut(docs.repartitionByRange(by, pos).withColumn("_part", F.spark_partition_id()))
        before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = own.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col(by).alias("_by"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        docs = own.join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
        n = F.row_number().over(Window.partitionBy(by, "_part").orderBy(pos)) + F.col("_before")
    else:
        n = F.row_number().over(Window.partitionBy(by).orderBy(pos))
    kind = F.when(F.contains("id", F.lit("rct_")), "Recital").when(F.col("id").rlike(r"_(par|op)_\d+$"), "Case law").otherwise("Article")
    return docs.withColumn("marker", F.concat(F.lit("S"), n.cast("string"))).withColumn("kind", kind).drop("_part", "_by", "_of", "_before")


def renumber(segments: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, sources) with cited sources alone, renumbered by first use.

    segments: answer, pos, text, markers[]; sources: answer, marker, id.  An
    answer that cites none keeps what it has.
    """
    used = segments.select("answer", "pos", F.posexplode("markers").alias("k", "marker"))
    first = used.join(sources.select("answer", "marker"), ["answer", "marker"], "left_semi").groupBy("answer", "marker").agg(F.min(F.struct("pos", "k")).alias("at"))
    renamed = first.select("answer", "marker", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("answer").orderBy("at")).cast("string")).alias("new"))
    cited = renamed.select("answer").distinct().withColumn("_c", F.lit(True))
    kept = sources.join(renamed, ["answer", "marker"], "left").join(cited, "answer", "left").where(F.col("new").isNotNull() | F.col("_c").isNull())
    kept = kept.select("answer", F.coalesce("new", "marker").alias("marker"), *(c for c in sources.columns if c not in ("answer", "marker")))
    maps = renamed.groupBy("answer").agg(F.map_from_entries(F.collect_list(F.struct("marker", "new"))).alias("_m"))
    moved = segments.join(maps, "answer", "left")
    markers = F.when(F.col("_m").isNull(), F.col("markers")).otherwise(F.filter(F.transform("markers", lambda m: F.try_element_at(F.col("_m"), m)), lambda m: m.isNotNull()))
    return moved.select(*(markers.alias("markers") if c == "markers" else F.col(c) for c in segments.columns)), kept


def curate(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Documents a curator keeps (query_id, keep[], governing[]; positions from 0), governing ones first.

    Positions out of range are nobody's; without any kept one all stay.
    """
    rows = docs.join(judged, "query_id", "left")
    pos = F.col("pos")
    some = F.max(F.array_contains(F.coalesce("keep", F.array().cast("array<int>")), pos).cast("int")).over(Window.partitionBy("query_id")) == 1
    kept = rows.withColumn("_some", some).where(~F.col("_some") | F.array_contains("keep", pos))
    governing = F.col("_some") & F.coalesce(F.array_contains("governing", pos), F.lit(False))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("governing_"), "pos"))
    return kept.withColumn("governing_", governing.cast("int")).withColumn("place", order).drop("_some", "keep", "governing").withColumnRenamed("governing_", "governing")


def fenced_json(text: Column, schema: str) -> Column:
    """A model's JSON: fences off, and once more with stray backslashes doubled; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    fixed = F.regexp_replace(bare, r'\\(?!["\\/bfnrtu])', r"\\\\")
    sound = lambda c: F.get_json_object(c, "$").isNotNull()
    return F.when(sound(bare), F.from_json(bare, schema)).when(sound(fixed), F.from_json(fixed, schema))


def prompt_problems(prompts: DataFrame) -> DataFrame:
    """Names without exactly one active version, and versions registered twice; empty if the registry is sound."""
    active = prompts.groupBy("name").agg(F.sum(F.col("active").cast("int")).cast("long").alias("n")).where("n <> 1").select("name", F.lit("active").alias("problem"), "n")
    twice = prompts.groupBy("name", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.concat(F.lit("duplicate "), F.col("version")).alias("problem"), "n")
    return active.unionByName(twice)


def backfill(rows: DataFrame, source_ids: str = "sources", contexts: str = "contexts") -> DataFrame:
    """rows with `pairs` of source id and context; null where the packed lists differ in length."""
    from lexloom.functions.legal import split_pipe

    a, b = split_pipe(F.col(source_ids)), split_pipe(F.col(contexts))
    return rows.withColumn("pairs", F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("id"), b.alias("context"))))
