"""Licence scan: ordered signature rules behind a keyword prefilter.  Built-in functions only."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import ascii_lower, checkpoint, text_of
from lexloom.llm.license_rules import Rule, rules, stems

#: Phrase words and label of the base.
BASE: tuple[tuple[str, str], ...] = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _normal(text: Column) -> Column:
    """Words joined by, and standing between, single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), _GAP, " ")), F.lit(" "))


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _base(norm: Column, n_words: Column) -> list[Column]:
    """n_base, first_word, last_word and base_labels: where the base phrases' words stand."""
    has = {p: F.contains(norm, F.lit(f" {p} ")) for p, _ in BASE}
    count = [F.when(has[p], F.regexp_count(norm, F.lit(f"(?<= ){p}(?= )"))).otherwise(0).cast("long") for p, _ in BASE]
    first = [F.when(has[p], _spaces(F.substring_index(norm, f" {p} ", 1))) for p, _ in BASE]
    last = [F.when(has[p], n_words - len(p.split()) - _spaces(F.substring_index(norm, f" {p} ", -1))) for p, _ in BASE]
    found = F.array_compact(F.array(*(F.when(has[p], F.lit(label)) for p, label in BASE)))
    return [functools.reduce(lambda a, b: a + b, count).alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), F.array_sort(F.array_distinct(found)).alias("_base")]


def _found(found_rules: Sequence[Rule]) -> Column:
    """array<struct<rule, spans array<struct<gap, len>>>>: each rule's matches in _norm, as gaps from the last one and lengths.

    Only rules whose keyword a text contains are tried on it.
    """
    norm = F.col("_norm")
    gate = functools.reduce(lambda a, b: a | b, (F.contains(norm, F.lit(s)) for s in stems(list(found_rules))))
    table = F.array(*(F.struct(F.lit(r.order).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for r in found_rules))
    tried = F.filter(F.filter(table, lambda r: F.contains(norm, r["keyword"])), lambda r: F.rlike(norm, r["pattern"]))

    def spans(r: Column) -> Column:
        matches = F.regexp_extract_all(norm, r["pattern"], F.lit(0))
        return F.zip_with(F.slice(F.split(norm, r["pattern"], -1), 1, F.size(matches)), matches, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("len")))

    return F.when(gate, F.transform(tried, lambda r: F.struct(r["rule"].alias("rule"), spans(r).alias("spans"))))


def detections(found: DataFrame, key: str, found_rules: Sequence[Rule]) -> DataFrame:
    """key, label, confidence, s, e: every detection that none suppresses, from the column _found.

    A detection is suppressed if one of a higher priority, or an equal one
    that is longer or of an earlier rule, contains its interval.  Starts are
    running sums of a rule's gaps, so a text with very many matches is sorted,
    never compared pair by pair.
    """
    spark = found.sparkSession
    # The rules are this module's own table, the same at every size.
    table = F.broadcast(spark.createDataFrame([(r.order, r.label, r.priority, r.confidence) for r in found_rules], "rule int, label string, priority int, confidence double"))
    rows = found.where(F.size("_found") > 0).select(key, F.inline("_found")).select(key, "rule", F.posexplode("spans").alias("pos", "x")).repartition(key)
    end = F.sum(F.col("x.gap") + F.col("x.len")).over(Window.partitionBy(key, "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    spans = rows.withColumn("e", end).withColumn("s", F.col("e") - F.col("x.len")).join(table, "rule").select(key, "rule", "label", "priority", "confidence", "s", "e")
    order = Window.partitionBy(key).orderBy(F.asc("s"), F.desc("e"), F.asc("priority"), F.asc("rule")).rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in found_rules})
    for p in levels:
        spans = spans.withColumn(f"_m{p}", F.max(F.when(F.col("priority") <= p, F.col("e"))).over(order))
    reach = functools.reduce(lambda c, p: c.when(F.col("priority") == p, F.col(f"_m{p}")), levels[1:], F.when(F.col("priority") == levels[0], F.col(f"_m{levels[0]}")))
    return spans.where(F.coalesce(reach, F.lit(-1)) < F.col("e")).select(key, "label", "confidence", "s", "e")


def license_scan(docs: DataFrame, found_rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""docs without the text, with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased.
    The base columns tell where the BASE phrases stand; labels adds those of
    the detections left after suppression, and score is the highest confidence
    among these (0 without any).

    A null or empty text has no words, no labels and score 0; a very long one is
    scanned whole.  Repeated rows each get the same result, a null id its own;
    an empty table gives an empty one, and columns of docs named like results
    are replaced.

    One pass over the texts makes the base columns and the matches of each
    rule, both short, which are checkpointed; texts are never shuffled.  The
    matches are, by row, to find those that others contain, and their labels
    meet the row again.
    """
    found_rules = rules() if found_rules is None else found_rules
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rest = [c for c in docs.columns if c not in (*made, text_col) or c == id_col]
    # An exploded one-element array keeps the text from being normalised again in every expression that uses it.
    normal = docs.select(*rest, F.explode(F.array(_normal(text_of(text_col)))).alias("_norm"))
    n_words = F.when(F.col("_norm") == "  ", F.lit(0)).otherwise(_spaces(F.col("_norm")) - 1).cast("long")
    scanned = checkpoint(normal.select(*rest, n_words.alias("n_words"), *_base(F.col("_norm"), n_words), _found(found_rules).alias("_found"), F.monotonically_increasing_id().alias("_i")))
    named = F.col("label") != ""
    kept = detections(scanned, "_i", found_rules).where(named).groupBy(F.col("_i").alias("_k")).agg(F.collect_set("label").alias("_labels"), F.max("confidence").alias("_score"))
    joined = scanned.join(kept, F.col("_i") == F.col("_k"), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>"))))
    return joined.select(*rest, "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce("_score", F.lit(0.0)).alias("score"))
