"""The retrieval methods end to end, and event windows as streams."""

from pyspark.sql import functions as F

from lexloom.plans.retrieval import TopicsConfig, by_topics, configure, methods
from lexloom.streaming.windows import deduplicated, trailing_sum, tumbling


def test_topics_method(spark):
    vectors = spark.createDataFrame([("data", [1.0, 0.0]), ("law", [0.0, 1.0])], "label string, embedding array<double>")
    tagged = spark.createDataFrame([("p1", "data"), ("p2", "data"), ("p3", "law")], "paragraph_id string, label string")
    texts = spark.createDataFrame([("p1", "some words"), ("p2", "data here"), ("p3", "data too")], "doc string, text string")
    asked = spark.createDataFrame([(7, "data", [1.0, 0.1])], "query_id int, text string, query_vector array<double>")
    got = [(r["rank"], r.doc) for r in by_topics(vectors, tagged, texts, asked, TopicsConfig(topic_threshold=0.5)).orderBy("rank").collect()]
    assert {d for _, d in got} == {"p1", "p2"}
    assert methods() == ["hybrid", "topics"] and configure("topics", top_k=1).top_k == 1


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:10', 'a', 1.0D), (1, timestamp_ntz'2024-01-01 00:00:10', 'a', 1.0D), (2, timestamp_ntz'2024-01-01 00:59:00', 'a', 2.0D), (3, timestamp_ntz'2024-01-01 09:00:00', 'b', 4.0D) AS t(event_id, ts, kind, value)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    made = tumbling(stream, "ts", "1 hour", ["kind"], late="10 minutes")
    q = made.writeStream.outputMode("append").format("memory").queryName("made").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in tumbling(rows, "ts", "1 hour", ["kind"]).where("kind = 'a'").collect()}
    assert {tuple(r) for r in spark.table("made").collect()} == batch
    once = deduplicated(stream, "event_id", "ts", "10 minutes").writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "d")).start()
    once.processAllAvailable()
    once.stop()
    assert spark.table("once").count() == 3


def test_trailing_window_is_strict(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00', 5.0D), (2, timestamp_ntz'2024-01-01 00:00:59', 1.0D), (3, timestamp_ntz'2024-01-01 00:01:00', 2.0D) AS t(event_id, ts, value)").withColumn("k", F.lit(1))
    assert {r.event_id: r.in_window for r in trailing_sum(rows, ["k"], "ts", "value").collect()} == {1: 5.0, 2: 6.0, 3: 3.0}
