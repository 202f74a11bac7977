"""Parsed legal pages to the graph's node and edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import legal
from lexloom.operators import judgments
from lexloom.operators.graph import EDGE, Corpus, link_topics
from lexloom.schemas import NODES
from lexloom.session import cut


@dataclass(frozen=True)
class Graph:
    """Node tables by label, and one table of edges."""

    nodes: dict[str, DataFrame]
    edges: DataFrame


def _edge(rows: DataFrame, src_label: Column | str, src: Column, rel: str, dst_label: Column | str, dst: Column) -> DataFrame:
    label = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(label(src_label).alias("src_label"), src.alias("src"), F.lit(rel).alias("rel"), label(dst_label).alias("dst_label"), dst.alias("dst"))


def _table(rows: DataFrame, kind: str, /, **made: Column) -> DataFrame:
    """Rows in the kind's schema, columns not made being null; of one id the first by all columns."""
    kinds = dict(x.split(" ", 1) for x in NODES[kind].split(", "))
    names = list(kinds)
    table = rows.select(*(made.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names))
    return table.groupBy("id").agg(F.min(F.struct(*(n for n in names))).alias("x")).select("x.*")


def citations(paragraphs: DataFrame) -> DataFrame:
    """src, dst, paragraph_id: an article's citations of articles of its act, from (id, article_id, text)."""
    act = F.regexp_extract("article_id", r"^(.*)art_\d+$", 1)
    refs = paragraphs.select("article_id", "id", act.alias("_act"), F.explode(legal.article_references(F.col("text"))).alias("_n"))
    return refs.select(F.col("article_id").alias("src"), F.concat("_act", F.lit("art_"), F.col("_n").cast("string")).alias("dst"), F.col("id").alias("paragraph_id"))


def act_graph(rows: DataFrame, urls: DataFrame | None = None, cases: DataFrame | None = None) -> Graph:
    """Nodes and edges of acts, from parse_pages(..., "act") and, for case law, parse_pages(..., "metadata").

    A section wins over its chapter as an article's parent.  CONTAINS follows
    the pages' structure, CITES the articles' texts (and an article's own
    paragraphs), INTERPRETS the references of judgments.  Edges that lack an
    end are left out; pages that failed to parse have no rows.
    """
    ok = cut(rows.where("error is null"))  # parsed once: every node and edge table reads it
    of = {k: ok.where(F.col("kind") == k) for k in ("Act", "Chapter", "Section", "Article", "Paragraph", "Recital")}
    section = F.col("parent").contains(".sct_")
    chapter = F.when(section, F.regexp_extract("parent", r"^(.*)\.sct_", 1)).otherwise(F.col("parent"))
    acts = of["Act"] if urls is None else of["Act"].join(urls.select(F.col("celex").alias("_c"), "eurolex_url"), F.col("celex") == F.col("_c"), "left")
    nodes = {
        "Act": _table(acts, "Act", id=F.col("id"), title=F.col("title"), **({"eurolex_url": F.col("eurolex_url")} if urls is not None else {})),
        "Chapter": _table(of["Chapter"], "Chapter", id=F.col("id"), act_id=F.col("celex"), number=F.col("number"), title=F.col("title")),
        "Section": _table(of["Section"], "Section", id=F.col("id"), chapter_id=F.col("parent"), title=F.col("title")),
        "Article": _table(of["Article"], "Article", id=F.col("id"), act_id=F.col("celex"), chapter_id=F.when(~section, chapter), section_id=F.when(section, F.col("parent")), title=F.col("title"), text=F.col("text")),
        "Paragraph": _table(of["Paragraph"], "Paragraph", id=F.col("id"), article_id=F.col("parent"), text=F.col("text")),
        "Recital": _table(of["Recital"], "Recital", id=F.col("id"), act_id=F.col("celex"), number=F.col("number"), text=F.col("text")),
    }
    parent = F.when(F.col("kind").isin("Chapter", "Recital"), "Act").when(F.col("kind") == "Section", "Chapter").when(F.col("kind") == "Paragraph", "Article").when(section, "Section").otherwise("Chapter")
    edges = _edge(ok.where("kind <> 'Act'"), parent, F.col("parent"), "CONTAINS", F.col("kind"), F.col("id"))
    edges = edges.unionByName(_edge(of["Paragraph"], "Article", F.col("parent"), "CITES", "Paragraph", F.col("id")))
    edges = edges.unionByName(_edge(citations(nodes["Paragraph"]), "Article", F.col("src"), "CITES", "Article", F.col("dst")))
    if cases is not None:
        found = cases.where("error is null").withColumn("_r", legal.normalise_reference(F.col("reference")))
        nodes["CaseLaw"] = _table(found, "CaseLaw", id=F.col("case_celex"))
        paragraph, article, own = F.col("_r.paragraph"), F.col("_r.article"), F.col("celex")
        label = F.when(paragraph.isNotNull(), "Paragraph").when(article.isNotNull(), "Article").when(F.col("_r.chapter").isNotNull(), "Chapter")
        target = F.coalesce(F.concat(own, F.lit("_"), paragraph), F.concat(own, article), F.concat(own, F.col("_r.chapter")))
        edges = edges.unionByName(_edge(found, "CaseLaw", F.col("case_celex"), "INTERPRETS", label, target))
    return Graph(nodes, sound(nodes, edges))


def sound(nodes: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist, once."""
    ends = None
    for label, df in nodes.items():
        one = df.select(F.lit(label).alias("_l"), F.col("id").alias("_i"))
        ends = one if ends is None else ends.unionByName(one)
    for side in ("src", "dst"):
        edges = edges.join(ends, (F.col(f"{side}_label") == F.col("_l")) & (F.col(side) == F.col("_i")), "left_semi")
    return edges.select(*EDGE).distinct()


def preamble(rows: DataFrame) -> DataFrame:
    """celex, seq, heading, depth, body[]: the three sections before a judgment's first heading.

    What stands before the keyword block is `Reports of Cases`, the block's
    topics are `Topics`, and what follows up to the heading `Judgment` is
    `General Information`; without a block all of it is reports.  seq is -3, -2
    and -1.  Judgments without that heading have no preamble.
    """
    marked = judgments.anchors(rows)
    head = marked.where(F.col("anchor").isNotNull() & (F.col("seq") < F.col("anchor")))
    block = F.exists(F.split("css", r"\s+"), lambda c: c.rlike(judgments.INDEX))
    first = F.min(F.when(block, F.col("seq"))).over(Window.partitionBy("celex"))
    head = head.withColumn("_at", first)
    texts = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("seq", "text")))), lambda x: x["text"])
    topics = F.max(F.when(F.col("seq") == F.col("_at"), F.col("text")))
    found = head.groupBy("celex").agg(texts(F.coalesce(F.col("seq") < F.col("_at"), F.lit(True))).alias("_a"), topics.alias("_b"), texts(F.col("seq") > F.col("_at")).alias("_c"))
    bodies = (F.col("_a"), F.coalesce(judgments.split_topics(F.col("_b")), F.array().cast("array<string>")), F.col("_c"))
    parts = F.array(*(F.struct(F.lit(k - 3).alias("seq"), F.lit(h).alias("heading"), F.lit(0).alias("depth"), b.alias("body")) for k, (h, b) in enumerate(zip(judgments.PREAMBLE, bodies))))
    return found.select("celex", F.inline(parts))


def judgment_graph(rows: DataFrame, summaries: DataFrame | None = None) -> Graph:
    """Nodes and edges of judgments, from parse_pages(..., "judgment").

    summaries: celex, heading, summary; the one without a heading is the
    judgment's.  Sections' ids hold their path, so they stay when a heading
    changes; the preamble's sections have no paragraphs, and its topics become
    nodes of their own instead of a section.
    """
    ok = rows.where("error is null")
    before = preamble(ok)
    depths = judgments.heading_depths(ok)
    heads = before.select("celex", "seq", F.col("heading").alias("text"), "depth").unionByName(depths.select("celex", F.col("seq").cast("int").alias("seq"), "text", "depth"))
    tree = judgments.section_tree(heads)
    section_id = lambda path: F.concat("celex", F.lit("_sec_"), path)
    told = summaries if summaries is not None else rows.sparkSession.createDataFrame([], "celex string, heading string, summary string")
    by = told.where("heading is not null").groupBy("celex", "heading").agg(F.min("summary").alias("_sum"))
    sections = tree.where("heading <> 'Topics'").join(by, ["celex", "heading"], "left").withColumn("id", section_id(F.col("path")))
    whole = told.where("heading is null").groupBy("celex").agg(F.min("summary").alias("_doc"))
    cases = ok.select("celex").distinct().join(whole, "celex", "left")
    topics = before.where("heading = 'Topics'").select("celex", F.explode("body").alias("label")).where("label <> ''").distinct()
    topics = topics.withColumn("id", F.concat(F.lit("case_law_topic:"), "celex", F.lit(":"), "label"))
    body = judgments.paragraphs(judgments.sections(ok, depths))
    home = sections.select("celex", F.col("seq").alias("section_seq"), F.col("id").alias("section_id"), "heading")
    parts = body.join(home, ["celex", "section_seq"])
    parts = parts.withColumn("id", F.concat("celex", F.when(F.col("is_operative"), "_op_").otherwise("_par_"), F.col("number").cast("string")))
    nodes = {
        "CaseLaw": _table(cases, "CaseLaw", id=F.col("celex"), celex=F.col("celex"), case_number=legal.case_number(F.col("celex")), summary=F.coalesce("_doc", F.lit(""))),
        "CaseLawTopic": _table(topics, "CaseLawTopic", id=F.col("id"), celex=F.col("celex"), label=F.col("label")),
        "CaseLawSection": _table(sections, "CaseLawSection", id=F.col("id"), celex=F.col("celex"), heading=F.col("heading"), depth=F.col("depth"), path=F.col("path"), summary=F.coalesce("_sum", F.lit(""))),
        "CaseLawParagraph": _table(parts, "CaseLawParagraph", id=F.col("id"), celex=F.col("celex"), section_id=F.col("section_id"), number=F.col("number"), text=F.col("text"), section_heading=F.col("heading"), is_operative=F.col("is_operative")),
    }
    up = sections.select(F.col("celex").alias("_c"), F.col("seq").alias("_s"), F.col("id").alias("_up"))
    placed = sections.join(up, (F.col("celex") == F.col("_c")) & (F.col("parent_seq") == F.col("_s")), "left")
    edges = _edge(topics, "CaseLaw", F.col("celex"), "HAS_TOPIC", "CaseLawTopic", F.col("id"))
    edges = edges.unionByName(_edge(placed.where("_up is null"), "CaseLaw", F.col("celex"), "HAS_SECTION", "CaseLawSection", F.col("id")))
    edges = edges.unionByName(_edge(placed.where("_up is not null"), "CaseLawSection", F.col("_up"), "CONTAINS", "CaseLawSection", F.col("id")))
    edges = edges.unionByName(_edge(parts, "CaseLawSection", F.col("section_id"), "HAS_PARAGRAPH", "CaseLawParagraph", F.col("id")))
    return Graph(nodes, sound(nodes, edges))


def corpus(acts: Graph, cases: Graph, topics: DataFrame | None = None) -> Corpus:
    """The tables that the graph queries read; topics: paragraph_id, topics[]."""
    spark = acts.edges.sparkSession
    given = topics if topics is not None else spark.createDataFrame([], "paragraph_id string, topics array<string>")
    n, c = acts.nodes, cases.nodes
    return Corpus(
        acts=n["Act"], chapters=n["Chapter"], sections=n["Section"], articles=n["Article"], paragraphs=n["Paragraph"], recitals=n["Recital"],
        topics=link_topics(given, n["Paragraph"]), interprets=acts.edges.where("rel = 'INTERPRETS'").select("src", "dst"),
        case_sections=c["CaseLawSection"], case_paragraphs=c["CaseLawParagraph"],
    )


def section_texts(rows: DataFrame, depths: DataFrame) -> DataFrame:
    """celex, section_seq, heading, depth, text: the whole text of each section, its lines joined by one newline."""
    own = judgments.sections(rows, depths)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return own.groupBy("celex", "section_seq").agg(F.max("heading").alias("heading"), F.max("depth").alias("depth"), F.array_join(lines, "\n").alias("text"))
