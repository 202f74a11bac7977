"""The property graph as tables: containment, scope queries, upserts and deletes."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

EDGE = ("src_label", "src", "rel", "dst_label", "dst")


def closure(edges: DataFrame, depth: int | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """ancestor, descendant and hops of all paths of 1 to `depth` edges, or without a depth of all pairs that any path joins.

    With a depth: unrolled joins, a row a path, each hop planned (and broadcast
    or shuffled) on its own.  Without: the fixpoint, a row a pair with its least
    hops.  A round joins the longest paths so far to all, which doubles their
    length, and is checkpointed; it ends when none got longer, on cycles too (a
    node on one is its own descendant).  Null ends and repeated edges add nothing.
    """
    step = edges.select(F.col(src).alias("ancestor"), F.col(dst).alias("descendant"), F.lit(1).alias("hops"))
    if depth is None:
        known, reach = cut(step.where("ancestor is not null and descendant is not null").distinct()), 1
        while True:
            longest = known.where(F.col("hops") == reach).select("ancestor", F.col("descendant").alias("_m"))
            if longest.isEmpty():
                return known
            rest = known.select(F.col("ancestor").alias("_n"), "descendant", (F.col("hops") + reach).alias("hops"))
            longer = longest.join(rest, F.col("_m") == F.col("_n")).select("ancestor", "descendant", "hops")
            known, reach = cut(known.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("hops").alias("hops"))), 2 * reach
    one = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"))
    out = step
    for k in range(2, depth + 1):
        step = step.join(one, step.descendant == F.col("_s")).select("ancestor", F.col("_d").alias("descendant"), F.lit(k).alias("hops"))
        out = out.unionByName(step)
    return out


def within(paths: DataFrame, low: int, high: int) -> DataFrame:
    """Bounded paths: low to high hops."""
    return paths.where(F.col("hops").between(low, high))


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Merge new properties into nodes: a given value wins, a null one keeps what was there.

    Of several new rows of one key each property's largest value is taken.
    """
    extra = [c for c in new.columns if c not in old.columns]
    a, b = old.alias("a"), new.groupBy(key).agg(*(F.max(c).alias(c) for c in new.columns if c != key)).alias("b")
    cols = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}").alias(c) for c in old.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*cols, *(F.col(f"b.{c}").alias(c) for c in extra))


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist (nodes: label, id), added once."""
    ends = nodes.select("label", "id").distinct()
    good = new.select(*EDGE)
    for side in ("src", "dst"):
        end = ends.select(F.col("label").alias("_l"), F.col("id").alias("_i"))
        good = good.join(end, (F.col(f"{side}_label") == F.col("_l")) & (F.col(side) == F.col("_i")), "left_semi")
    return old.select(*EDGE).unionByName(good).distinct()


def update_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Set one column where the key matches, to the largest value given; rows of other keys are not added."""
    values = new.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max(column).alias("_v"))
    on = functools.reduce(lambda x, y: x & y, (F.col(k) == F.col(f"_{k}") for k in keys))
    return old.join(values, on, "left").select(*(F.coalesce("_v", c).alias(c) if c == column else F.col(c) for c in old.columns))


def delete_labels(nodes: DataFrame, edges: DataFrame, labels: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the labels go, with every edge that touches one."""
    gone = list(labels)
    return nodes.where(~F.col("label").isin(gone)), edges.where(~(F.col("src_label").isin(gone) | F.col("dst_label").isin(gone)))


def link_topics(topics: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """paragraph_id, label rows of (paragraph_id, topics[]), for paragraphs that exist, once."""
    rows = topics.select("paragraph_id", F.explode("topics").alias("label")).where("label is not null")
    return rows.join(paragraphs.select(F.col("id").alias("_p")), F.col("paragraph_id") == F.col("_p"), "left_semi").distinct()


def topic_nodes(old: DataFrame, links: DataFrame) -> DataFrame:
    """Topic nodes (label), each label once, with those that links (paragraph_id, label) add."""
    return old.select("label").unionByName(links.select("label")).where("label is not null").distinct()


def exists(nodes: DataFrame, label: str, node_id: str) -> bool:
    return not nodes.where((F.col("label") == label) & (F.col("id") == node_id)).isEmpty()


def missing(nodes: DataFrame, column: str = "embedding") -> DataFrame:
    """What an incremental run still has to fill."""
    return nodes.where(F.col(column).isNull())


def number_of(c: Column) -> Column:
    """Numeric reading of a string; null where it has none."""
    return c.try_cast("int")


def article_number(c: Column) -> Column:
    return number_of(F.try_element_at(F.split(c, "art_"), F.lit(-1)))


def _among(rows: DataFrame, column: str, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose column is one of some ids, or of a table's."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(F.col("id").alias("_id")), F.col(column) == F.col("_id"), "left_semi")
    return rows.where(F.col(column).isin(*ids))


@dataclass(frozen=True)
class Corpus:
    """Node tables and the edges between them; each method is one of the corpus's graph queries."""

    acts: DataFrame
    chapters: DataFrame
    sections: DataFrame
    articles: DataFrame
    paragraphs: DataFrame
    recitals: DataFrame
    topics: DataFrame  # paragraph_id, label
    interprets: DataFrame  # src (case), dst (provision)
    case_sections: DataFrame
    case_paragraphs: DataFrame

    def _scoped(self, df: DataFrame, acts: Sequence[str] | None) -> DataFrame:
        """An empty act list is no filter: the predicate isn't planned at all."""
        return df.where(F.col("act_id").isin(*acts)) if acts else df

    def _paragraphs(self) -> DataFrame:
        a = self.articles.select(F.col("id").alias("article_id"), "act_id", "chapter_id", "section_id", F.col("title").alias("article_title"))
        return self.paragraphs.select(F.col("id").alias("paragraph_id"), F.col("article_id").alias("_a"), F.col("text").alias("text")).join(a, F.col("_a") == F.col("article_id")).drop("_a")

    def all_paragraphs(self) -> DataFrame:
        return self._paragraphs().orderBy("act_id", "article_id", "paragraph_id")

    def unique_topics(self) -> DataFrame:
        return self.topics.agg(F.array_sort(F.collect_set("label")).alias("topics"))

    def paragraphs_by_topic(self, labels: Sequence[str], acts: Sequence[str] | None = None) -> DataFrame:
        hit = self.topics.where(F.col("label").isin(*labels)).select(F.col("paragraph_id").alias("_p"), "label")
        rows = self._scoped(self._paragraphs(), acts).join(hit, F.col("paragraph_id") == F.col("_p"))
        return rows.groupBy("paragraph_id", "article_id", "act_id", "text").agg(F.array_sort(F.collect_set("label")).alias("topics"))

    def recitals_by_act(self, acts: Sequence[str] | None = None) -> DataFrame:
        return self._scoped(self.recitals, acts).orderBy("act_id", number_of(F.col("number")).asc_nulls_last())

    def all_acts(self) -> DataFrame:
        return self.acts.select("id", "title").orderBy("id")

    def chapters_by_acts(self, acts: Sequence[str] | None = None) -> DataFrame:
        return self._scoped(self.chapters, acts).select("act_id", "id", "number", "title").orderBy("act_id", "number")

    def chapter_paragraphs(self, chapters: Sequence[str] | DataFrame) -> DataFrame:
        """Paragraphs one or two hops below the chapters (ids, or a table of id): directly, or in their sections."""
        direct = self._paragraphs().where(F.col("section_id").isNull())
        by = self.sections.select(F.col("id").alias("_s"), F.col("chapter_id").alias("_c"))
        nested = self._paragraphs().join(by, F.col("section_id") == F.col("_s")).withColumn("chapter_id", F.col("_c")).drop("_s", "_c")
        return _among(direct.unionByName(nested), "chapter_id", chapters).orderBy(article_number(F.col("article_id")).asc_nulls_last(), "paragraph_id")

    def chapters_without_summary(self) -> DataFrame:
        rows = self.articles.join(self.sections.select(F.col("id").alias("_s"), F.col("chapter_id").alias("_c")), F.col("section_id") == F.col("_s"), "left")
        rows = rows.select(F.coalesce("_c", "chapter_id").alias("_ch"), "id", F.col("title").alias("_t"))
        open_ = self.chapters.where("summary is null")
        return open_.join(rows.withColumnRenamed("id", "_id"), open_.id == F.col("_ch")).groupBy("act_id", open_.id.alias("id"), "number", "title").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_id", "_t")))), lambda x: x["_t"]).alias("article_titles"))

    def articles_with_paragraphs(self) -> DataFrame:
        """Articles without a summary, and their paragraphs' texts, each led by an empty line."""
        rows = self.articles.where("summary is null").select("id", "title").join(self.paragraphs.select("article_id", F.col("id").alias("_p"), F.col("text").alias("_t")), F.col("id") == F.col("article_id"))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"])
        return rows.groupBy("id", "title").agg(F.concat(F.lit("\n\n"), F.array_join(texts, "\n\n")).alias("text"))

    def article_titles(self, acts: Sequence[str] | None = None) -> DataFrame:
        return self._scoped(self.articles, acts).select("act_id", "id", "title").orderBy("act_id", "id")

    def paragraphs_by_articles(self, articles: Sequence[str] | DataFrame) -> DataFrame:
        return _among(self._paragraphs(), "article_id", articles).orderBy("article_id", "paragraph_id")

    def articles_by_acts(self, acts: Sequence[str] | None = None) -> DataFrame:
        """Articles with their chapter, if they have one."""
        c = self.chapters.select(F.col("id").alias("_c"), F.col("number").alias("chapter_number"), F.col("title").alias("chapter_title"))
        return self._scoped(self.articles, acts).join(c, F.col("chapter_id") == F.col("_c"), "left").select("act_id", "id", "title", "text", "chapter_number", "chapter_title").orderBy("id")

    def general_provisions(self, acts: Sequence[str] | None, most: int) -> DataFrame:
        keep = article_number(F.col("article_id")) <= most
        return self._scoped(self._paragraphs(), acts).where(keep).orderBy("act_id", article_number(F.col("article_id")), "paragraph_id")

    def definitions(self, acts: Sequence[str] | None = None) -> DataFrame:
        return self._scoped(self._paragraphs(), acts).where("article_title = 'Definitions'").orderBy("act_id", "paragraph_id")

    def _provisions(self) -> DataFrame:
        """Every provision a judgment may interpret, with its act."""
        p = self._paragraphs().select(F.col("paragraph_id").alias("id"), "act_id")
        return self.chapters.select("id", "act_id").unionByName(self.articles.select("id", "act_id")).unionByName(p)

    def case_law(self, acts: Sequence[str] | None = None) -> DataFrame:
        """Judgments that interpret any provision of the acts, once each."""
        return self.interprets.join(self._scoped(self._provisions(), acts), F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("celex")).distinct().orderBy("celex")

    def case_law_paragraphs(self, acts: Sequence[str] | None = None) -> DataFrame:
        scope = self.case_law(acts)
        return self.case_paragraphs.join(scope, "celex", "left_semi").dropDuplicates(["id"]).orderBy("celex", F.col("number").asc_nulls_last())
