"""Sentence ends learnt from a corpus: which words with a full stop are abbreviations, and what begins sentences.

After Kiss and Strunk's unsupervised method: likelihood ratios over counts of
words with and without a full stop.  All counting is by aggregates; of the
texts, only the places after abbreviations are joined to anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

#: From which score a word is an abbreviation, and from which ratio it begins sentences.
ABBREVIATION, STARTER = 0.3, 30.0
#: White space, what may stand about a word, what ends a sentence, and what the next one may begin with.
SPACE, OPEN, CLOSE = r"[ \t\n\x0B\f\r]+", r"^[\"'“‘(\[]+", r"[\"'”’)\]]+\z"
ENDS, BEGINS = r"[.;!?][\"'”’)\]]*", r"(?:[\"'“‘(\[]*\p{Lu}|[\"“‘(])"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda t: t != "")


def _zipped(tokens: Column) -> Column:
    """Array of (token, next): every token and the one behind it, the last one's null."""
    return F.arrays_zip(tokens.alias("token"), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))).alias("next"))


def _bare(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(token), OPEN, ""), CLOSE, "")


def _kind(bare: Column) -> Column:
    """The word without its last full stop."""
    return F.when(F.endswith(bare, F.lit(".")), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)


def _log(k: Column, n: Column, x: Column) -> Column:
    """Log likelihood of k in n at a rate of x."""
    part = lambda m, y: F.when(m == 0, 0.0).otherwise(m * F.ln(y))
    return part(k, x) + part(n - k, 1 - x)


@dataclass(frozen=True)
class Boundaries:
    """words: word, n, n_dot, score, abbreviation; starters: word, n, n_after, ratio, starter."""

    words: DataFrame
    starters: DataFrame


def learn(texts: DataFrame, text: str) -> Boundaries:
    """Counts and scores of the words of a corpus; null texts have none.

    A word is a token in lower case without quotes and brackets about it, of
    which at least one character is a letter.  Numbers of tokens, two, come to
    the driver.
    """
    pairs = texts.select(F.explode(F.array(_tokens(F.col(text)))).alias("_t")).select(F.inline(_zipped(F.col("_t"))))
    # Tokens are counted as they stand, with what follows where that matters; only different ones are looked into.
    once = cut(pairs.groupBy("token", F.when(F.contains("token", F.lit(".")), F.col("next")).alias("next")).agg(F.count(F.lit(1)).alias("m")))
    bare = once.select(_bare(F.col("token")).alias("b"), "next", "m")
    rows = bare.select(_kind(F.col("b")).alias("word"), F.endswith("b", F.lit(".")).cast("long").alias("dot"), "next", "m")
    counted = cut(rows.where(F.rlike("word", F.lit(r"\p{L}"))).groupBy("word").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("dot")).alias("n_dot")))
    total = counted.agg(F.sum("n").alias("n"), F.sum("n_dot").alias("d")).first()
    n, d = total.n or 0, total.d or 0
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    size = F.length("word") - inner
    k, c = F.col("n_dot").cast("double"), F.col("n").cast("double")
    ratio = -2 * (_log(k, c, F.lit(d / (n + 1))) - _log(k, c, F.lit(0.99)))
    score = F.when(F.col("n_dot") == 0, 0.0).otherwise(F.round(ratio * F.exp(-size) * (inner + 1) * F.pow(size, -(c - k)), 6))
    words = cut(counted.withColumn("score", score).withColumn("abbreviation", F.col("score") >= ABBREVIATION))
    # Words after full stops that surely end a sentence; counted by pair before they meet anything.
    begun = rows.where((F.col("dot") == 1) & F.col("next").isNotNull()).groupBy("word", _kind(_bare(F.col("next"))).alias("next")).agg(F.sum("m").alias("m"))
    begun = begun.join(words.where("abbreviation").select("word"), "word", "left_anti").groupBy(F.col("next").alias("word")).agg(F.sum("m").alias("n_after"))
    begun = cut(begun.join(words.select("word", "n"), "word"))
    ends = begun.agg(F.sum("n_after")).first()[0] or 0
    a, c = F.col("n_after").cast("double"), F.col("n").cast("double")
    first, rest, all_ = F.lit(float(ends)), F.lit(float(max(n - ends, 1))), F.lit(float(max(n, 1)))
    two = _log(a, first, a / first) + _log(c - a, rest, (c - a) / rest)
    one = _log(a, first, c / all_) + _log(c - a, rest, c / all_)
    found = begun.withColumn("ratio", F.when(a / first > c / all_, F.round(2 * (two - one), 6)).otherwise(0.0))
    return Boundaries(words, cut(found.withColumn("starter", F.col("ratio") >= STARTER)))


def sentences(texts: DataFrame, key: str, text: str, learnt: Boundaries) -> DataFrame:
    """texts with sentences[]: their tokens, joined by one space, between the ends that were learnt.

    A sentence ends at a token with . ; ! or ? at its end, before one that
    begins with a capital or opens a quote or bracket; after an abbreviation
    only where the next word begins sentences.  key is unique; a null text has
    no sentence.
    """
    own = texts.select(F.col(key).alias("_k"), F.explode(F.array(_tokens(F.col(text)))).alias("_t"))
    dotted = own.select("_k", F.posexplode(_zipped(F.col("_t"))).alias("_i", "_x")).select("_k", "_i", "_x.token", "_x.next").where(F.rlike("token", F.lit(r"\.[\"'”’)\]]*\z")))
    places = dotted.select("_k", "_i", _kind(_bare(F.col("token"))).alias("word"), _kind(_bare(F.col("next"))).alias("next"))
    places = places.join(learnt.words.where("abbreviation").select("word"), "word", "left_semi")
    places = places.join(learnt.starters.where("starter").select(F.col("word").alias("next")), "next", "left_anti")
    held = places.groupBy("_k").agg(F.collect_list("_i").alias("_held"))
    joined = texts.join(held, F.col(key) == F.col("_k"), "left").withColumn("_t", _tokens(F.col(text)))
    # No token has white space in it: a newline marks one that is held, a tab an end.
    told = F.transform("_t", lambda x, i: F.when(F.array_contains("_held", i), F.concat(x, F.lit("\n"))).otherwise(x))
    whole = F.array_join(F.when(F.col("_held").isNull(), F.col("_t")).otherwise(told), " ")
    marked = F.replace(F.regexp_replace(whole, f"({ENDS}) (?={BEGINS})", "$1\t"), F.lit("\n"), F.lit(""))
    return joined.withColumn("sentences", F.filter(F.split(marked, "\t"), lambda s: s != "")).drop("_k", "_t", "_held")
