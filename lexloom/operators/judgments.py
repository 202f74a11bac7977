"""Judgments as rows: heading depths, sections, numbered paragraphs, topics.

Rows of a document are (celex, seq, css, text) in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Classes of the published judgments' headings, keyword block and notes, and what opens their rulings.
HEADING = r"^(?:coj-)?(?:sum-title-1|title-grseq-\d)$"
INDEX = r"^(?:coj-)?index$"
NOTE = r"^(?:coj-)?note$"
OPERATIVE = r"(?i)hereby (?:rules|orders|declares)"
# Headings of what stands before a judgment's body.
PREAMBLE = ("Reports of Cases", "Topics", "General Information")


def heading_class(css: Column) -> Column:
    return F.try_element_at(F.filter(F.split(css, r"\s+"), lambda c: c.rlike(HEADING)), F.lit(1))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_signature(text: Column) -> Column:
    """The line that stands for the judges' signatures, whatever brackets and stops are around it."""
    return F.lower(F.trim(F.translate(text, "[].", ""))).isin("signature", "signatures")


def heading_rank(css: Column) -> Column:
    """Order of heading classes: title first, then the numbered levels."""
    return F.when(css.rlike("sum-title-1"), F.lit(0)).otherwise(F.regexp_extract(css, r"(\d)$", 1).try_cast("int"))


def anchors(rows: DataFrame) -> DataFrame:
    """rows with `anchor`: where the heading `Judgment` stands, if it does."""
    hit = heading_class(F.col("css")).isNotNull() & (F.lower(squeeze(F.col("text"))) == "judgment")
    return rows.withColumn("anchor", F.min(F.when(hit, F.col("seq"))).over(Window.partitionBy("celex")))


def heading_depths(rows: DataFrame) -> DataFrame:
    """Headings from the anchor on, with a dense depth over the classes that the document has there."""
    h = heading_class(F.col("css"))
    heads = anchors(rows).where(h.isNotNull() & (F.col("anchor").isNull() | (F.col("seq") >= F.col("anchor")))).withColumn("heading_css", h)
    order = Window.partitionBy("celex").orderBy(heading_rank(F.col("heading_css")), "heading_css")
    return heads.withColumn("depth", F.dense_rank().over(order) - 1)


def split_topics(index_text: Column) -> Column:
    """The keyword block's topics: outer parentheses off, paired quotes off, cut at dashes before a capital."""
    bare = F.regexp_replace(F.trim(index_text), r"^\(|\)$", "")
    quoted = bare.rlike("^[‛‘“„«\"']")
    bare = F.when(quoted, F.regexp_replace(F.regexp_replace(bare, "^[‛‘“„«\"']+", ""), "[’‘”»\"']+$", "")).otherwise(bare)
    parts = F.transform(F.split(bare, r"\s+[-–—]\s*(?=[A-Z‘’'\"])"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def sections(rows: DataFrame, depths: DataFrame) -> DataFrame:
    """Body rows with the section they fall in: the latest heading before them."""
    heads = depths.select("celex", F.col("seq").alias("section_seq"), F.col("text").alias("heading"), "depth")
    marked = rows.join(heads, (rows.celex == heads.celex) & (rows.seq == heads.section_seq), "left").select(rows["*"], "section_seq", "heading", "depth")
    past = Window.partitionBy("celex").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.select("celex", "seq", "text", F.col("section_seq").isNotNull().alias("is_heading"), *(F.last(c, True).over(past).alias(c) for c in ("section_seq", "heading", "depth")))
    return filled.where(~F.col("is_heading") & F.col("section_seq").isNotNull())


def section_tree(depths: DataFrame) -> DataFrame:
    """celex, seq, heading, depth, path, parent_seq of each section.

    path counts siblings at each level from 0 (a skipped level is 0); the parent is
    the nearest earlier section that is shallower.  One fold over a document's
    headings, of which there are few.
    """
    heads = F.array_sort(F.collect_list(F.struct("seq", "depth", F.col("text").alias("heading"))))
    fold = """aggregate(_h,
        named_struct('stack', cast(array() AS array<struct<n:int,seq:bigint>>), 'out', cast(array() AS array<struct<seq:bigint,heading:string,depth:int,path:string,parent_seq:bigint>>)),
        (acc, x) -> struct(
            concat(slice(transform(sequence(0, x.depth), i -> coalesce(get(acc.stack, i), named_struct('n', 0, 'seq', cast(NULL AS bigint)))), 1, x.depth),
                   array(named_struct('n', coalesce(get(acc.stack, x.depth).n, -1) + 1, 'seq', cast(x.seq AS bigint)))) AS stack,
            array_append(acc.out, named_struct('seq', cast(x.seq AS bigint), 'heading', x.heading, 'depth', x.depth,
                'path', array_join(concat(transform(slice(transform(sequence(0, x.depth), i -> coalesce(get(acc.stack, i).n, 0)), 1, x.depth), n -> cast(n AS string)),
                                          array(cast(coalesce(get(acc.stack, x.depth).n, -1) + 1 AS string))), '.'),
                'parent_seq', element_at(concat(array(cast(NULL AS bigint)), filter(transform(slice(acc.stack, 1, x.depth), s -> s.seq), s -> s IS NOT NULL)), -1))) AS out),
        acc -> acc.out)"""
    return depths.groupBy("celex").agg(heads.alias("_h")).select("celex", F.inline(F.expr(fold)))


def paragraphs(body: DataFrame) -> DataFrame:
    """celex, section_seq, number, text, is_operative of numbered paragraphs.

    Gaps and islands: a numbered row starts a paragraph and unnumbered ones
    continue it; rows before the first number are no paragraph.  After
    `hereby rules` (whose row is dropped) rulings are counted instead; the only
    ruling may lack a number.  Signatures are dropped.
    """
    part = Window.partitionBy("celex", "section_seq").orderBy("seq")
    past = part.rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.col("text").rlike(OPERATIVE)
    rows = body.where(~is_signature(F.col("text"))).withColumn("_a", anchor).withColumn("is_operative", F.coalesce(F.max(F.col("_a").cast("int")).over(past), F.lit(0)) == 1)
    rows = rows.where(~F.col("_a"))
    own = F.nullif(F.regexp_extract(F.col("text"), r"^(\d+)[.)]?\s+", 1), F.lit(""))
    starts = F.when(F.col("is_operative"), F.col("text").rlike(r"^\d+[.)]\s+")).otherwise(F.col("text").rlike(r"^\d+\s+"))
    rows = rows.withColumn("_s", starts).withColumn("number", F.when(F.col("_s"), own.try_cast("int")))
    island = Window.partitionBy("celex", "section_seq", "is_operative").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_g", F.sum(F.col("_s").cast("int")).over(island)).where((F.col("_g") > 0) | F.col("is_operative"))
    bare = F.when(F.col("_s") & F.col("is_operative"), F.regexp_replace("text", r"^\d+[.)]\s+", "")).when(F.col("_s"), F.regexp_replace("text", r"^\d+\s+", "")).otherwise(F.col("text"))
    made = rows.groupBy("celex", "section_seq", "is_operative", "_g").agg(F.max("number").alias("number"), F.transform(F.array_sort(F.collect_list(F.struct("seq", bare.alias("t")))), lambda x: x["t"]).alias("_t"))
    return made.select("celex", "section_seq", F.coalesce("number", F.lit(1)).alias("number"), F.array_join("_t", "\n").alias("text"), "is_operative")


def totals(parts: DataFrame) -> DataFrame:
    """Sections, paragraphs and rulings of each judgment."""
    return parts.groupBy("celex").agg(F.count_distinct("section_seq").alias("sections"), F.count(F.lit(1)).alias("paragraphs"), F.sum(F.col("is_operative").cast("int")).alias("operative"))


def graph_totals(sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """celex, sections, paragraphs, operative: what a judgment's graph holds."""
    parts = paragraphs.groupBy(F.col("celex").alias("_c")).agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.col("is_operative").cast("int")).alias("operative"))
    heads = sections.groupBy("celex").agg(F.count(F.lit(1)).alias("sections"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return heads.join(parts, F.col("celex") == F.col("_c"), "left").select("celex", "sections", zero("paragraphs"), zero("operative"))


def tree_metrics(depths: DataFrame, body: DataFrame) -> DataFrame:
    """celex, sections, lines, max_depth of a judgment's section tree."""
    heads = depths.groupBy("celex").agg(F.count(F.lit(1)).alias("sections"), F.max("depth").alias("max_depth"))
    own = body.groupBy(F.col("celex").alias("_c")).agg(F.count(F.lit(1)).alias("lines"))
    return heads.join(own, F.col("celex") == F.col("_c"), "left").select("celex", "sections", F.coalesce("lines", F.lit(0)).alias("lines"), "max_depth")
