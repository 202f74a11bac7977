"""Tables by bucket, catching up from a stream, the closure's fixpoint and the stored BM25 index."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import graph, lexical_index, retrieval
from lexloom.operators.tables import edge_table, node_table
from lexloom.streaming.catchup import catch_up, missing_vectors


def files(base):
    return {str(p.relative_to(base)): p.stat().st_mtime_ns for p in base.rglob("*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_rewrite_their_buckets_only(spark, tmp_path):
    table = node_table(spark, str(tmp_path), "id string, a string, b int", buckets=8)
    make = lambda x: spark.createDataFrame(x, "id string, a string, b int")
    assert table.read().collect() == [] and table.record()["version"] == 0
    want = {}
    table.upsert(make([(f"n{i}", f"a{i}", None) for i in range(60)] + [(None, "null", 1)]))
    want |= {f"n{i}": (f"a{i}", None) for i in range(60)} | {None: ("null", 1)}
    before = files(tmp_path)
    table.upsert(make([("n3", None, 7), ("n3", "z", None), ("new", "x", 1)]))
    want |= {"n3": ("z", 7), "new": ("x", 1)}
    after = files(tmp_path)
    assert all(after[f] == t for f, t in before.items()) and len(after) > len(before)
    touched = {b for b, v in table.record()["buckets"].items() if v == 2}
    assert len(touched) <= 2
    table.delete(make([("n5", None, None), ("nobody", None, None)]))
    want.pop("n5")
    assert rows(table.read()) == sorted(((k, *v) for k, v in want.items()), key=str)
    assert table.read(1).count() == 61 and {r.id: r.b for r in table.read(2).collect()}["n3"] == 7
    with pytest.raises(ValueError):
        table.read(9)
    table.vacuum()
    assert rows(table.read()) == sorted(((k, *v) for k, v in want.items()), key=str) and table._records() == [3]


def test_edges_and_a_writer_that_comes_late(spark, tmp_path):
    table = edge_table(spark, str(tmp_path), buckets=4)
    edge = lambda *x: spark.createDataFrame([("A", s, "CITES", "B", d) for s, d in x], ", ".join(f"{c} string" for c in graph.EDGE))
    table.upsert(edge(("1", "2"), ("1", "2"), ("1", "3")))
    table.upsert(edge(("1", "2"), ("4", "5")))
    assert rows(table.read().select("src", "dst")) == [("1", "2"), ("1", "3"), ("4", "5")]
    spark.createDataFrame([("{}",)], "value string").write.text(f"{tmp_path}/versions/3")
    spark.createDataFrame([('{"version": 2, "buckets": {}, "batches": {}}',)], "value string").coalesce(1).write.mode("overwrite").text(f"{tmp_path}/versions/3")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        table.upsert(edge(("8", "9")))


def test_stream_catches_up_once_a_batch(spark, tmp_path):
    """Batches are run again after a crash between the table's record and the stream's checkpoint; the tables are equal."""
    source, kind = tmp_path / "in", "id string, text string, embedding array<double>"
    for k in range(4):
        spark.createDataFrame([(f"n{i}", f"text {i} of {k}", None) for i in range(k, 12, 2)], kind).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    table = node_table(spark, str(tmp_path / "t"), kind, buckets=4)
    fill, seen = missing_vectors(embed), []

    class Crash(Exception):
        pass

    real = type(table).upsert

    def failing(self, new, source=None, batch=None):
        done = real(self, new, source, batch)
        seen.append((batch, done))
        if len(seen) in (2, 4):
            raise Crash
        return done

    type(table).upsert = failing
    try:
        for _ in range(5):
            query = catch_up(stream, table, str(tmp_path / "check"), "nodes", fill)
            try:
                query.awaitTermination(120)
                break
            except Exception as e:  # noqa: BLE001
                assert "Crash" in str(e)
    finally:
        type(table).upsert = real
    assert [b for b, _ in seen] == [0, 1, 1, 2, 2, 3] and [d for _, d in seen] == [True, True, False, True, False, True]
    plain = node_table(spark, str(tmp_path / "u"), kind, buckets=4)
    for part in sorted(source.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns):
        plain.upsert(fill(spark.read.schema(kind).parquet(str(part))))
    assert rows(table.read()) == rows(plain.read()) and table.read().count() == 12
    catch_up(stream, table, str(tmp_path / "check"), "nodes", fill).awaitTermination(120)
    assert table.record()["version"] == 4


def test_closure_ends_by_itself(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("x", "y"), (None, "x")]
    got = {(r.ancestor, r.descendant): r.hops for r in graph.closure(spark.createDataFrame(edges, "src string, dst string")).collect()}
    want = {(f"c{i}", f"c{j}"): j - i for i in range(61) for j in range(i + 1, 61)}
    ring = "xyz"
    want |= {(a, b): (ring.index(b) - ring.index(a)) % 3 or 3 for a in ring for b in ring} | {("z", "w"): 1, ("y", "w"): 2, ("x", "w"): 3}
    assert got == want
    assert graph.closure(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_stored_index_equals_all_scores_over_scopes(spark, tmp_path):
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(40)] + ["É"]
    text = lambda: " ".join(rng.choices(voc, [1 / (i + 1) for i in range(41)], k=rng.randint(0, 25)))
    docs = spark.createDataFrame([(i, f"g{i % 5}", text()) for i in range(150)] + [(900, "g0", None), (901, None, "w1 w2"), (902, "g4", "")], "doc long, grp string, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(rng.choices(voc, k=4)), ("s1", "s2", "s3")[i % 3]) for i in range(15)] + [(90, None, "s1"), (91, "nothing", "s2")], "query_id long, text string, scope string")
    members = spark.createDataFrame([("s1", "g0"), ("s1", "g1"), ("s2", "g1"), ("s2", "g2"), ("s2", "g4"), ("s2", "g1"), ("s3", "g3"), ("s3", "none")], "scope string, grp string")
    index = lexical_index.write_index(docs, str(tmp_path / "i"), group="grp")
    got = retrieval.index_top_k(lexical_index.read_index(spark, str(tmp_path / "i")), asked, 5, members)
    copies = docs.join(members.distinct(), "grp").select("scope", "doc", "text")
    scores = retrieval.bm25_scores(retrieval.bm25_stats(copies, "doc", "text", ["scope"]), asked, "text", "query_id", ["scope"], True)
    want = retrieval.top_k(scores.withColumn("score", F.round("score", 6)), 5, ("query_id", "scope"))
    key = lambda df: sorted((r.query_id, r.scope, r["rank"], r.doc, round(r.score, 5)) for r in df.collect())
    assert key(got) == key(want) and key(got)
    # Few terms: only their buckets' files are read.
    plan = lexical_index._postings_of(index.postings, spark.createDataFrame([("w1", 0)], "term string, number int"), {"w1": 0})
    scan = [x for x in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x and "bucket" in x][0]
    assert "PartitionFilters: [isnotnull(bucket" in scan and "EqualTo(term,w1)" in scan


def test_many_questions_stay_small(spark, tmp_path):
    """20,000 questions in several blocks: what a task holds is a segment and packed term lists."""
    import resource

    rng = random.Random(1)
    words = [f"t{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=30))) for i in range(200)], "doc long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=8))) for i in range(20000)], "query_id long, text string")
    found = retrieval.bm25_top_k(docs, asked, 3)
    assert found.select("query_id").distinct().count() > 19000
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 2 << 20  # KB: no worker came near 2 GB


def test_vector_index(spark, tmp_path):
    import numpy as np

    from lexloom.operators import vector_index as vi

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 32))
    x = centres[rng.integers(0, 20, 1500)] + 0.25 * rng.standard_normal((1500, 32))
    kind = "vec_id long, embedding array<double>"
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, [1.0]), (9002, [None] * 32), (9003, [float("nan")] * 32)]
    index = vi.write_vector_index(spark.createDataFrame(rows + odd, kind).repartition(4), str(tmp_path / "v"), 32, 20)
    again = vi.read_vector_index(spark, str(tmp_path / "v"))
    assert again.rows.count() == 1500 and np.allclose(again.centres, index.centres)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1500, 30)] + [(7777, [1.0])], "query_id long, query_vector array<double>")
    truth = vi.exact_top_k(index, asked, 10)
    dots = np.round(x @ x[30], 9)
    assert [r.doc for r in truth.where("query_id = 30").orderBy("rank").collect()] == sorted(range(1500), key=lambda i: (-dots[i], i))[:10]
    probes = vi.choose_probes(index, 10)
    found = vi.vector_top_k(index, asked, 10, probes)
    assert vi.recall(found, truth).agg(F.avg("recall")).first()[0] >= 0.9 and probes <= 8
    every = vi.vector_top_k(index, asked, 10, 20, rescore=200)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc) for r in df.collect())
    assert key(every) == key(truth)
    plan = vi.vector_top_k(index, asked.limit(1), 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    empty = vi.write_vector_index(spark.createDataFrame([], kind), str(tmp_path / "e"), 32, 4)
    assert vi.vector_top_k(empty, asked, 3, 2).collect() == []


def test_candidates_grow_with_the_index(spark, tmp_path):
    """With eight times k candidates by code, vectors without clusters find fewer than nine in ten of their nearest."""
    import numpy as np

    from lexloom.operators import vector_index as vi

    x = np.random.default_rng(3).standard_normal((12000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    index = vi.write_vector_index(rows, f"{tmp_path}/v", dim=64, cells=16)
    asked = rows.where("vec_id % 120 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    truth = vi.exact_top_k(index, asked, 10)
    mean = lambda p, r: vi.recall(vi.vector_top_k(index, asked, 10, p, r), truth).agg(F.avg("recall")).first()[0]
    probes, rescore = vi.choose_search(index, 10, asked=100)
    assert mean(vi.choose_probes(index, 10), 8) < 0.9 <= mean(probes, rescore) and rescore > 8


def test_an_index_asked_once_has_postings_of_its_terms_alone(spark):
    """The other terms are counted, for the mean weight; all of them are in an index where the texts have too many."""
    docs = spark.createDataFrame([(i, f"g{i % 2}", f"a w{i} w{i} b" if i else None) for i in range(9)], "doc long, grp string, text string")
    asked = spark.createDataFrame([("a w3 nowhere",), (None,)], "text string")
    counted = {("g0", "a"): 4, ("g0", "b"): 4, ("g1", "a"): 4, ("g1", "b"): 4} | {(f"g{i % 2}", f"w{i}"): 1 for i in range(1, 9)}
    with lexical_index.index_of(docs, asked, group="grp") as index:
        assert {r.term for r in index.postings.collect()} == {"a", "w3"}
        assert {(r.grp, r.term): r.n for r in index.terms.groupBy("grp", "term").agg(F.sum("df").alias("n")).collect()} == counted


def test_best_by_cells_equals_every_sum(monkeypatch):
    """Postings of several terms are decoded at once, and summed in small parts or in one."""
    import numpy as np
    import pyarrow as pa

    from lexloom.operators import postings

    rng = random.Random(8)
    voc = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(voc, [1 / (i + 1) for i in range(30)], k=rng.randint(0, 12))) for _ in range(700)]
    lengths, terms, df, data = postings.segment_postings(pa.array(texts, pa.large_string()), postings.NO_BLANK, False)
    docs, counts = postings.all_postings(data.slice(2), df[2:])
    found = [(t, d, c) for t, n, e in zip(terms.to_pylist()[2:], df[2:], np.cumsum(df[2:])) for d, c in zip(docs[e - n : e].tolist(), counts[e - n : e].tolist())]
    assert found == [(t, d, x.split().count(t)) for t in terms.to_pylist()[2:] for d, x in enumerate(texts) if t in x.split()]
    docs, counts = postings.all_postings(data, df)
    worth = counts * np.repeat([(-1) ** i * (1 + i / 8) for i in range(len(df))], df)  # some lists take away
    asked = [(q, t, rng.randint(1, 3)) for q in (0, 2, 3, 7) for t in sorted(rng.sample(range(len(df)), 5))]
    sums = {}
    first = np.cumsum(df) - df
    for q, t, f in asked:
        for p in range(first[t], first[t] + df[t]):
            sums[q, docs[p]] = sums.get((q, docs[p]), 0) + f * worth[p]
    want = [(q, d, s) for q in (0, 2, 3, 7) for s, d in sorted(((s, d) for (x, d), s in sums.items() if x == q), key=lambda y: (-y[0], y[1]))[:6]]
    for cells in (1, 1 << 19):
        monkeypatch.setattr(postings, "CELLS", cells)
        got = postings.best_by_cells(docs, worth, first, df, *(np.array(c) for c in zip(*asked)), 6, len(texts), 6)
        assert list(zip(*(x.tolist() for x in got))) == want


def test_postings_are_packed_in_pieces(monkeypatch):
    """What is made of a segment stays within twelve times its text, and the pieces change nothing."""
    import tracemalloc

    import pyarrow as pa

    from lexloom.operators import postings

    rng = random.Random(9)
    texts = pa.array([" ".join(f"w{int(rng.paretovariate(0.4)) % 50_000}" for _ in range(400)) for _ in range(1_500)], pa.large_string())
    tracemalloc.start()
    found = postings.segment_postings(texts, postings.NO_BLANK, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * texts.nbytes
    asked = found[1].slice(3, 500)
    some = postings.segment_postings(texts, postings.NO_BLANK, False, asked)
    assert some[1].slice(0, 500).equals(asked) and some[3].equals(found[3].slice(3, 500))
    monkeypatch.setattr(postings, "PIECE", 7)
    again = postings.segment_postings(texts, postings.NO_BLANK, False)
    assert all((a == b).all() for a, b in zip(found[::2], again[::2])) and found[1].equals(again[1]) and found[3].equals(again[3])


def test_a_store_asked_once_has_postings_of_the_questions_alone(spark):
    from lexloom.plans.retrieval import Store

    own = spark.createDataFrame([("x1", "a1", "one two"), ("x2", "a2", "two three")], "doc string, act string, text string")
    passages = spark.createDataFrame([("V1_par_1", "V1", "four five")], "doc string, celex string, text string")
    store = Store(own, own, passages, spark.createDataFrame([("V1", "a1")], "celex string, act string"))
    with store.indexed(spark.createDataFrame([("two four",)], "text string")) as made:
        assert [{r.term for r in i.postings.collect()} for i in (made.articles, made.recitals, made.passages)] == [{"two"}, {"two"}, {"four"}]
        assert {(r.grp, r.term) for r in made.articles.terms.collect()} == {("a1", "one"), ("a1", "two"), ("a2", "two"), ("a2", "three")}


def test_terms_are_summed_in_parts_that_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(lexical_index, "PART_WORDS", 10)
    docs = spark.createDataFrame([(i, "a b c d e") for i in range(21)], "doc long, text string")
    with lexical_index.index_of(docs, docs.select("text")) as index:
        assert lexical_index._dealt(index, index.terms).rdd.getNumPartitions() == 11
        found = lexical_index.search(index, spark.createDataFrame([(1, "a")], "query_id int, text string"), 2).collect()
        assert {r.doc for r in found} >= {0, 1} and len({r.score for r in found}) == 1
