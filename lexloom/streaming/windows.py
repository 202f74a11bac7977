"""Event windows: the trailing token limiter, and tumbling, sliding and session windows for batch or stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MINUTE = 60_000_000


def event_time(ts: Column) -> Column:
    """Wall-clock times as instants, which watermarks need."""
    return ts.cast("timestamp")


def trailing_sum(events: DataFrame, keys: list[str], ts: str, amount: str, micros: int = MINUTE, out: str = "in_window") -> DataFrame:
    """What the last `micros` before and at each event sum to; an event just that old counts no more.

    Events are dealt by key and span of time, each also to the span after its
    own, where it is only looked back at: a task holds two spans of a key, not
    all that a busy key ever did.
    """
    rows = events.withColumn("_us", F.unix_micros(event_time(F.col(ts))))
    own = F.floor(F.col("_us") / micros)
    dealt = rows.withColumn("_own", own).withColumn("_span", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    span = Window.partitionBy(*keys, "_span").orderBy("_us").rangeBetween(-(micros - 1), 0)
    return dealt.withColumn(out, F.sum(amount).over(span)).where("_span = _own").drop("_us", "_own", "_span")


class Limiter(StatefulProcessor):
    """At most `limit` tokens in any `micros`: each request waits until enough of the window has run out.

    State is what was granted and still counts, a (time, tokens) pair a
    request.  A request gets `granted_us`, the earliest time at which it fits,
    given those before it; one larger than the limit is granted alone, when the
    window is empty.
    """

    def __init__(self, limit: float, micros: int, pause: int) -> None:
        self.limit, self.micros, self.pause = limit, micros, pause

    def init(self, handle) -> None:  # noqa: ANN001
        self.state = handle.getValueState("granted", "at array<bigint>, tokens array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        kept = list(zip(*self.state.get())) if self.state.exists() else []
        requests = pd.concat(list(rows)).sort_values(["asked_us", "request"])
        out = []
        for request, asked, tokens in zip(requests["request"], requests["asked_us"], requests["tokens"]):
            now = max(int(asked), kept[-1][0] if kept else int(asked))
            kept = [(t, n) for t, n in kept if now - t < self.micros]
            while kept and sum(n for _, n in kept) + tokens > self.limit:
                now = kept[0][0] + self.micros + self.pause
                kept = [(t, n) for t, n in kept if now - t < self.micros]
            kept.append((now, float(tokens)))
            out.append((str(key[0]), request, int(asked), now))
        self.state.update(([int(t) for t, _ in kept], [n for _, n in kept]))
        yield pd.DataFrame(out, columns=["key", "request", "asked_us", "granted_us"])

    def close(self) -> None:
        pass


def limited(stream: DataFrame, key: str, request: str, ts: str, tokens: str, limit: float, micros: int = MINUTE, pause: int = 100_000) -> DataFrame:
    """key, request, asked_us, granted_us of every request of a stream: the stateful token limiter."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(request).cast("string").alias("request"), F.unix_micros(event_time(F.col(ts))).alias("asked_us"), F.col(tokens).cast("double").alias("tokens"))
    return rows.groupBy("key").transformWithStateInPandas(Limiter(limit, micros, pause), "key string, request string, asked_us long, granted_us long", "append", "none")


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums of `value` by window; with `late`, state older than that is dropped in a stream."""
    rows = events.withColumn("_t", event_time(F.col(ts)))
    rows = rows.withWatermark("_t", late) if late else rows
    window = F.window("_t", size, slide) if slide else F.window("_t", size)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = events.withColumn("_t", event_time(F.col(ts)))
    rows = rows.withWatermark("_t", late) if late else rows
    out = rows.groupBy(F.session_window("_t", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def deduplicated(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    return stream.withColumn("_t", event_time(F.col(ts))).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
