"""Tokens, sentences and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of statutes that name no topic.
LEGAL_STOPWORDS = frozenset((
    "article", "paragraph", "section", "chapter", "regulation", "directive", "pursuant", "thereof", "herein", "whereas", "shall", "referred",
    "subparagraph", "annex", "recital", "provision", "point", "imposed", "processed", "implementing", "apply", "establish", "allow", "designate",
    "provided", "used", "approved", "issued", "empowered", "laid", "specified", "notified", "registered", "certain", "relevant", "available",
    "sufficiently", "proper", "balanced", "capable", "effective", "week", "month", "year", "period", "later", "delay", "urgent", "while", "periodic",
    "receipt", "forum", "journal", "code", "activity", "document", "order", "rule", "level", "format", "amount", "process", "subject", "right",
    "relation", "standard", "regard", "purpose", "information", "country", "union", "market", "cost", "price", "staff", "power",
))
#: Marks that end a sentence, and what the next one may begin with: a capital, a bracket or a quote.
ENDS, BEGINS = ".;", "\\p{Lu}(\"'“‘"
SENTENCE_END = rf"(?<=[{ENDS}])\s+(?=[{BEGINS}])"


def tokens(text: Column) -> Column:
    """White-space tokens in their own case."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda x: F.trim(x)), lambda s: s != "")


def chunks(paragraphs: DataFrame, id_col: str, text_col: str, skip_first: bool = True) -> DataFrame:
    """paragraph_id, chunk_index and lower-case text of each sentence; the first one of several is skipped."""
    own = F.col("_s")
    kept = F.when(F.lit(skip_first) & (F.size(own) > 1), F.slice(own, 2, F.size(own))).otherwise(own)
    rows = paragraphs.select(F.col(id_col).alias("paragraph_id"), F.explode(F.array(sentences(F.col(text_col)))).alias("_s"))
    return rows.select("paragraph_id", F.posexplode(kept).alias("chunk_index", "text")).withColumn("text", F.lower("text"))


# Tags of nouns.
NOUNS = frozenset(("NN", "NNS", "NNP", "NNPS"))


def candidate_terms(token_rows: DataFrame, token: str, pos: str, known: DataFrame | None = None, most: int = 200, tag: str | None = None) -> DataFrame:
    """term, n: alphabetic tokens of over three letters that no stopword list or known term has, by count, then first place.

    With a column of part-of-speech tags, nouns only.
    """
    low = F.lower(token)
    if tag is not None:
        token_rows = token_rows.where(F.col(tag).isin(*sorted(NOUNS)))
    rows = token_rows.where(F.col(token).rlike(r"^\p{L}+$") & (F.length(token) > 3) & ~low.isin(*sorted(LEGAL_STOPWORDS)))
    terms = rows.groupBy(low.alias("term")).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    if known is not None:
        terms = terms.join(known.select("term"), "term", "left_anti")
    return terms.orderBy(F.desc("n"), "first", "term").limit(most)
