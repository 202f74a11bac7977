"""Quality rules: plain counts of each text, and a hashed n-gram likelihood ratio against trusted texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import by_value
from lexloom.llm.hashing import U, chunks, covered, mix, spans, windows, words

#: Bytes of an n-gram, and hash buckets of the two multinomials.
GRAM, BUCKETS = 4, 1 << 16
#: Labelled rows of either class that are used; the rest of the corpus statistics cover every document.
MAX_LABELLED = 20_000
SYMBOLS = b"#*$%&|<>"
_ODD = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every byte n-gram that lies within one text."""
    n = max(0, len(data) - GRAM + 1)
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h += data[k : k + n] * np.uint32(_ODD[k])
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(16))) & np.uint32(BUCKETS - 1)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    whole = np.arange(n) + GRAM <= offsets[rows + 1]
    return h[whole], rows[whole]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, trusted) to the counts of each bucket in all texts and in trusted ones."""
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, data, offsets in chunks(batch.column(0)):
            h, rows = grams(data, offsets)
            raw += np.bincount(h, minlength=BUCKETS)
            good += np.bincount(h[trusted[i:j][rows]], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(good[used])], ["bucket", "n_raw", "n_good"])


def features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a chunk."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    starts, ends, rows = words(data, offsets)
    out = {"n_words": np.bincount(rows, minlength=n)}
    begins = np.ones(256, bool)
    begins[0x80:0xC0] = False
    begins[[0x20, 9, 10, 11, 12, 13]] = False
    out["word_chars"] = np.bincount(row[begins[data]], minlength=n)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = np.bincount(row[symbol[data]], minlength=n)
    lines = []
    for r in range(n):
        own = [x for x in data[offsets[r] : offsets[r + 1]].tobytes().split(b"\n") if x.strip()]
        lines.append(len(own) - len(set(own)))
    out["n_dup_lines"] = np.array(lines, np.int64)
    keys, first = windows(spans(data, starts, ends), rows, 3)
    keys = keys ^ mix(rows[first].astype(U) + U(1))
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    out["n_repeat_words"] = np.bincount(rows[covered(first[twice], 3, len(rows))], minlength=n)
    return out


def _judge(llr, text_at: int):
    """Adds the base counts and the mean log-likelihood ratio of each text to the batch's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = llr.value
        for batch in batches:
            parts: list[dict[str, np.ndarray]] = []
            for i, j, data, offsets in chunks(batch.column(text_at)):
                part = features(data, offsets)
                h, rows = grams(data, offsets)
                total, n = np.bincount(rows, table[h], j - i), np.bincount(rows, minlength=j - i)
                parts.append(part | {"score": total / np.maximum(n, 1)})
            cols = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for c in COUNTS]
            score = pa.array(np.concatenate([p["score"] for p in parts]) if parts else [], pa.float64())
            kept = [k for k in range(batch.num_columns) if k != text_at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *cols, score], [*(batch.schema.names[k] for k in kept), *COUNTS, "score"])

    return run


def _sample(labels: DataFrame, most: int) -> DataFrame:
    rows = labels.select(F.col("doc_id").alias("_l"), F.col("quality").cast("int").alias("_q")).where("_l is not null and _q in (0, 1)").groupBy("_l").agg(F.min("_q").alias("_q"))
    order = [F.xxhash64("_l"), F.col("_l")]
    return rows.where("_q = 1").orderBy(*order).limit(most).unionByName(rows.where("_q = 0").orderBy(*order).limit(most))


def quality_rules(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), max_labelled: int = MAX_LABELLED) -> DataFrame:
    r"""The `carry` columns of docs, the base counts, base_failed, kept and score.

    Words are [^\x20\x09-\x0D]+.  base_failed: fewer than 50 words, or over half
    of the words in 3-word windows that the text repeats.  score: the mean, over
    a text's byte 4-grams, of log p_trusted / p_raw, both multinomials over
    hashed buckets with add-one smoothing; trusted texts are half of those
    labelled of quality 1, and raw ones all of docs.  A document is kept if it
    passed the base and its score reaches the threshold that best tells the two
    classes of the other labelled texts apart (balanced accuracy; the middle of
    the best interval), or if no such text of either class is there to set one.
    Which half a label is of tells a hash of its id.

    A null text is empty: no words, base_failed; a very long one is judged whole.
    Texts of one score tie, and stay or go together.  Repeated rows are judged each
    on its own, as is a null id (never labelled); an id labelled twice counts as
    its lower quality.  An empty table gives an empty one; columns of docs named
    like results are replaced.

    Every pass streams texts through Arrow in chunks of a few MB.  What meets
    on the driver is one number a bucket and class, and a histogram of labelled
    scores; the label sample is at most 2 x `max_labelled` rows, so it may be
    broadcast.  No text is shuffled.
    """
    spark = docs.sparkSession
    half = F.pmod(F.xxhash64(F.lit("half"), "_l"), F.lit(2))
    sample = F.broadcast(_sample(labels, max_labelled).withColumn("_trusted", (F.col("_q") == 1) & (half == 0)))
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("text"))
    known = texts.join(sample, F.col("_d") == F.col("_l"), "left")
    counts = known.select("text", F.coalesce("_trusted", F.lit(False)).alias("trusted")).mapInArrow(_count, "bucket int, n_raw long, n_good long")
    rows = counts.groupBy("bucket").agg(F.sum("n_raw").alias("r"), F.sum("n_good").alias("g")).collect()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, g in rows:
        raw[b], good[b] = r, g
    llr = np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    shared = spark.sparkContext.broadcast(llr if good.any() else np.zeros(BUCKETS))

    def judged(df: DataFrame, carried: list[str]) -> DataFrame:
        df = df.select(*carried, F.col("text").alias("_text"))
        schema = T.StructType([*df.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("score", T.DoubleType())])
        done = df.mapInArrow(_judge(shared, len(carried)), schema)
        return done.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))

    step = 0.005
    marked = texts.join(sample, F.col("_d") == F.col("_l")).where(~F.col("_trusted")).select("_q", "text")
    bins = judged(marked, ["_q"]).where("not base_failed").groupBy(F.floor(F.col("score") / step).alias("b"), "_q").agg(F.count(F.lit(1)).alias("n")).collect()
    bound = threshold([(r["b"], r["_q"], r["n"]) for r in bins]) * step
    made = {*COUNTS, "score", "base_failed", "kept"}
    done = judged(docs, [c for c in carry if c not in made])
    return done.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(float(bound))))


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """The score bin from which to keep, from (bin, class, count) of labelled texts."""
    totals = [sum(n for _, q, n in bins if q == c) for c in (0, 1)]
    if not all(totals):
        return -1e9
    at = sorted({b for b, _, _ in bins})
    best: list[float] = []
    most = -1.0
    below = [0, 0]
    for k, b in enumerate(at):
        right = below[0] / totals[0] + 1 - below[1] / totals[1]
        edge = b if k == 0 else (at[k - 1] + 1 + b) / 2
        if right > most + 1e-12:
            best, most = [edge], right
        elif right > most - 1e-12:
            best.append(edge)
        for x, q, n in bins:
            if x == b:
                below[q] += n
    return best[len(best) // 2]


by_value(__name__)
