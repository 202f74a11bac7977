"""Operators on small inline tables, traps of their semantics included."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import legal
from lexloom.functions.text import chunks
from lexloom.functions.vectors import cosine
from lexloom.operators import answers, evaluation, graph, judgments, retrieval, sinks, topics
from lexloom.plans.retrieval import configure, default_config, methods
from lexloom.providers import embed_missing, hashed_embedder, overlap_scorer, score_pairs
from lexloom.schemas import NODES, require
from lexloom.sources.files import read_csv
from lexloom.sources.html import parse_pages


def one(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("ref,want", [("A01", (None, "art_1", None)), ("A02P1", (None, "art_2", "002.001")), ("A04PT11", (None, "art_4", "004.011")), ("CH8", ("CH8", None, None)), ("X", (None, None, None))])
def test_reference(spark, ref, want):
    assert tuple(one(spark, legal.normalise_reference(F.col("r")), r=ref)) == want


def test_celex(spark):
    assert tuple(one(spark, legal.celex_parts(F.col("c")), c="31995L0046")) == ("Directive", ["1995/46", "95/46"])
    assert one(spark, legal.celex_parts(F.col("c")), c="62019CJ0645") is None
    assert one(spark, legal.case_number(F.col("c")), c="62019CJ0645") == "C-645/19"
    assert one(spark, legal.neighbour_ids(F.col("c"), 2), c="62018CJ0311_par_199") == [f"62018CJ0311_par_{n}" for n in (198, 200, 201)]
    assert one(spark, legal.neighbour_ids(F.col("c"), 2), c="62018CJ0311_op_1") == []


def test_expected_ids(spark):
    text = "Article 5 and Recital 7; Article 4, of Regulation (EU) 2016/679 is another act. Articles 12 and 13."
    assert one(spark, legal.expected_ids(F.col("t"), F.lit("X")), t=text) == ["Xart_12", "Xart_5", "Xrct_7"]


def test_keyword_trap(spark):
    assert one(spark, legal.acts_in(F.col("t")), t="corporate governance") == ["32022R0868"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "y", "s")], "id string, title string, summary string")
    new = spark.createDataFrame([("b", None, "t"), ("c", "z", None)], "id string, title string, summary string")
    once = graph.upsert_nodes(old, new)
    assert {tuple(r) for r in once.collect()} == {("a", "x", None), ("b", "y", "t"), ("c", "z", None)}
    assert {tuple(r) for r in graph.upsert_nodes(once, new).collect()} == {tuple(r) for r in once.collect()}


def corpus(spark):
    mk = lambda rows, label: spark.createDataFrame(rows, NODES[label])
    return graph.Corpus(
        acts=mk([("X", "Act", None)], "Act"),
        chapters=mk([("Xcpt_I", "X", "I", "General", None), ("Xcpt_II", "X", "II", "Empty", None)], "Chapter"),
        sections=mk([("Xcpt_I.sct_1", "Xcpt_I", "S")], "Section"),
        articles=mk([("Xart_2", "X", "Xcpt_I", None, "Definitions", "t", None, None), ("Xart_10", "X", None, "Xcpt_I.sct_1", None, "t", None, None)], "Article"),
        paragraphs=mk([("X_002.001", "Xart_2", "p1", None), ("X_002.002", "Xart_2", "p2", None), ("X_010.0", "Xart_10", "p3", None)], "Paragraph"),
        recitals=mk([("Xrct_10", "X", "10", "r", None), ("Xrct_9", "X", "9", "r", None), ("Xrct_x", "X", "x", "r", None)], "Recital"),
        topics=spark.createDataFrame([("X_002.001", "data"), ("X_010.0", "data"), ("X_010.0", "law")], "paragraph_id string, label string"),
        interprets=spark.createDataFrame([("C1", "X_010.0"), ("C1", "Xart_2"), ("C2", "Y")], "src string, dst string"),
        case_sections=mk([], "CaseLawSection"),
        case_paragraphs=mk([("C1_par_2", "C1", "s", 2, "b", "h", False, None), ("C1_par_1", "C1", "s", 1, "a", "h", False, None), ("C1_op", "C1", "s", None, "o", "h", True, None)], "CaseLawParagraph"),
    )


def test_corpus_queries(spark):
    c = corpus(spark)
    ids = lambda df, k: [r[k] for r in df.collect()]
    assert ids(c.all_paragraphs(), "paragraph_id") == ["X_010.0", "X_002.001", "X_002.002"]  # ids sort as strings
    assert ids(c.recitals_by_act(["X"]), "number") == ["9", "10", "x"]
    assert ids(c.chapter_paragraphs(["Xcpt_I"]), "paragraph_id") == ["X_002.001", "X_002.002", "X_010.0"]
    assert [(r.id, r.article_titles) for r in c.chapters_without_summary().collect()] == [("Xcpt_I", ["Definitions"])]
    assert {r.id: r.text for r in c.articles_with_paragraphs().collect()} == {"Xart_2": "\n\np1\n\np2", "Xart_10": "\n\np3"}
    assert ids(c.articles_by_acts(["X"]), "chapter_number") == [None, "I"]
    assert ids(c.general_provisions(["X"], 5), "paragraph_id") == ["X_002.001", "X_002.002"]
    assert ids(c.definitions(), "paragraph_id") == ["X_002.001", "X_002.002"]
    assert ids(c.case_law(["X"]), "celex") == ["C1"] and ids(c.case_law(["Z"]), "celex") == []
    assert ids(c.case_law_paragraphs(["X"]), "number") == [1, 2, None]
    assert c.unique_topics().first()["topics"] == ["data", "law"]
    assert {r.paragraph_id: r.topics for r in c.paragraphs_by_topic(["data", "law"], []).collect()}["X_010.0"] == ["data", "law"]
    assert ids(c.paragraphs_by_articles(["Xart_10"]), "text") == ["p3"] and c.chapters_by_acts(["X"]).count() == 2 and c.article_titles().count() == 2


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3)], "query_id int, doc string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, doc string, rank int")
    got = {r.doc: r.score for r in retrieval.fuse([a, b]).collect()}
    assert got == pytest.approx({"x": 1 / 61 + 1 / 63, "y": 1 / 62 + 1 / 61})


def test_bm25_is_case_sensitive_and_counts_repeats(spark):
    docs = spark.createDataFrame([(1, "data act data"), (2, "Data law"), (3, "other words here"), (4, None)], "id int, text string")
    stats = retrieval.bm25_stats(docs, "id", "text")
    q = spark.createDataFrame([(1, "data"), (2, "data data")], "query_id int, text string")
    got = {(r.query_id, r.doc): r.score for r in retrieval.bm25_scores(stats, q, "text", "query_id").collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[2, 1] == pytest.approx(2 * got[1, 1])


def test_operative_slot(spark):
    pool = spark.createDataFrame([(1, "a", 0.9, False), (1, "o", 0.5, True), (2, "p", 0.9, True), (3, "b", 0.9, False), (3, "c", 0.1, True)], "query_id int, doc string, score double, is_operative boolean")
    got = {(r.query_id, r.doc) for r in retrieval.operative_slot(retrieval.top_k(pool, 1), pool, 0.3).collect()}
    assert got == {(1, "a"), (1, "o"), (2, "p"), (3, "b")}


def test_judgment(spark):
    html = "<html><body><p class='coj-index'>(A — B)</p><p class='coj-sum-title-1'>Judgment</p><p class='coj-title-grseq-2'>Context</p><table><tr><td>1</td><td><p>First</p></td></tr></table><p>more</p><p class='coj-note'>* note</p><p class='coj-title-grseq-2'>Costs</p><table><tr><td>2</td><td>Second</td></tr></table><p>On those grounds, the Court hereby rules:</p><p>Article 5 stays.</p><p>[Signatures]</p></body></html>"
    rows = parse_pages(spark.createDataFrame([("C", html), ("D", None)], "celex string, html string"), "judgment").drop("error")
    depths = judgments.heading_depths(rows)
    assert [(r.text, r.depth) for r in depths.orderBy("seq").collect()] == [("Judgment", 0), ("Context", 1), ("Costs", 1)]
    got = {(r.number, r.text, r.is_operative) for r in judgments.paragraphs(judgments.sections(rows, depths)).collect()}
    assert got == {(1, "First\nmore", False), (2, "Second", False), (1, "Article 5 stays.", True)}
    tree = {r.heading: (r.path, r.parent_seq) for r in judgments.section_tree(depths).collect()}
    assert tree["Judgment"][0] == "0" and tree["Context"][0] == "0.0" and tree["Costs"][0] == "0.1"
    assert "->" in sinks.dot_lines(judgments.section_tree(depths)).first()["dot"]


def test_topic_split(spark):
    split = lambda t: one(spark, judgments.split_topics(F.col("t")), t=t)
    assert split("(‛Data — Privacy — Data — articles 7 and 8’)") == ["Data", "Privacy — Data — articles 7 and 8"] or split("(‛Data — Privacy — Data’)") == ["Data", "Privacy"]
    assert split("(Reference – Concept of ‘consent’)") == ["Reference", "Concept of ‘consent’"]


def test_act_parser(spark):
    html = "<div class='eli-main-title'><p>Title</p></div><div id='cpt_I'><div id='cpt_I.tit_1'><p>General</p></div><div id='art_1'><div id='art_1.tit_1'><p>Subject</p></div><div id='001.001'><p class='oj-normal'>One</p></div></div><div id='art_2'><p class='oj-normal'>pre</p><p class='oj-normal'>(1)</p><p class='oj-normal'>data</p></div></div><div id='rct_3'><p class='oj-normal'>Whereas</p></div>"
    rows = parse_pages(spark.createDataFrame([("X", html)], "celex string, html string"), "act").collect()
    got = {(r.kind, r.id, r.parent) for r in rows}
    assert {("Act", "X", None), ("Chapter", "Xcpt_I", "X"), ("Article", "Xart_1", "Xcpt_I"), ("Paragraph", "X_001.001", "Xart_1"), ("Paragraph", "X_002.1", "Xart_2"), ("Recital", "Xrct_3", "X")} <= got


def test_chunks_skip_the_first_sentence(spark):
    rows = spark.createDataFrame([("p", "One. Two; Three."), ("q", "Only")], "id string, text string")
    assert {tuple(r) for r in chunks(rows, "id", "text").collect()} == {("p", 0, "two;"), ("p", 1, "three."), ("q", 0, "only")}


def test_topics(spark):
    chunk = spark.createDataFrame([(0, "p", [1.0, 0.0]), (1, "p", [0.0, 1.0]), (2, "q", [0.0, -1.0])], "chunk int, paragraph_id string, embedding array<double>")
    concept = spark.createDataFrame([("a b", [1.0, 0.0], True), ("c d", [0.0, 1.0], True), ("off", [1.0, 0.0], False), ("e f", [-1.0, 0.0], True)], "label string, embedding array<double>, active boolean")
    found = topics.classify(chunk, concept, 0.5)
    assert {(r.chunk, r.label) for r in found.collect()} == {(0, "a b"), (1, "c d")}
    assert {r.label: r.active for r in topics.deactivate_unused(concept, found).collect()} == {"a b": True, "c d": True, "off": False, "e f": False}


def test_merge(spark):
    rows = spark.createDataFrame([("ab", [1.0, 0.0], ["x"], 0, 0), ("longer", [1.0, 0.01], ["x", "y"], 0, 1), ("far", [0.0, 1.0], ["y"], 1, 2)], "label string, embedding array<double>, terms array<string>, generation int, pos long")
    assert [r.label for r in topics.merge_and_dedup(rows).collect()] == ["longer"]


def test_evaluation(spark):
    row = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["a"], [])], "s array<string>, e array<string>").select(evaluation.ir_metrics(F.col("s"), F.col("e")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in row] == [(0.0, 0.5, 0.5), (0.0, 0.0, 0.0)]
    acc = {r.expected: r.detected for r in evaluation.act_accuracy(spark.createDataFrame([("A", ["A", "B"]), ("B", [])], "expected string, predicted array<string>")).collect()}
    assert acc == {"A": 1.0, "B": 0.0, "(all)": 0.5}


def test_answers(spark):
    docs = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "query_id int, pos int, doc string")
    judged = spark.createDataFrame([(1, [1, 9], [1]), (2, [], [])], "query_id int, keep array<int>, governing array<int>")
    assert {(r.query_id, r.doc) for r in answers.curate(docs, judged).collect()} == {(1, "b"), (2, "c")}
    assert one(spark, answers.fenced_json(F.col("t"), "a int"), t='```json\n{"a": 3}\n```')["a"] == 3
    assert one(spark, answers.fenced_json(F.col("t"), "a string"), t='{"a": "x\\d"}')["a"] == "x\\d"
    assert one(spark, legal.split_pipe(F.col("t")), t=" a | |b") == ["a", "b"]
    rows = spark.createDataFrame([("a|b", "x"), ("a", "x")], "sources string, contexts string")
    assert [r.pairs is None for r in answers.backfill(rows).collect()] == [True, False]


def test_providers(spark):
    embed = hashed_embedder(8)
    nodes = spark.createDataFrame([("a", "x y", None), ("b", "z", [0.0])], "id string, text string, embedding array<float>")
    got = {r.id: r.embedding for r in embed_missing(nodes, embed).collect()}
    assert len(got["a"]) == 8 and got["b"] == [0.0]
    pair = spark.createDataFrame([("a b", "b c")], "q string, t string").select(score_pairs(F.col("q"), F.col("t"), overlap_scorer).alias("s"))
    assert pair.first()["s"] == 0.5
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_files_and_methods(spark, tmp_path):
    df = spark.createDataFrame([("A", 'q "x"\nline', "g", ["1", "2"])], "act string, question string, ground_truth string, sources array<string>")
    sinks.write_csv(df, str(tmp_path / "r"))
    back = read_csv(spark, str(tmp_path / "r")).first()
    assert back.question == 'q "x"\nline' and back.sources == "1|2"
    with pytest.raises(ValueError):
        require(df, ["nope"])
    assert methods() and default_config("hybrid")["top_k_final"] == 5
    with pytest.raises(ValueError):
        configure("hybrid", nope=1)


def test_aske_generation_offers_every_vector(spark, tmp_path, monkeypatch):
    from lexloom import queries

    rows = [(i, i % 3, [float(i % 3 == k) + 0.01 * (i % 7) for k in range(3)]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    offered, cycle = [], topics.run_cycle
    monkeypatch.setattr(topics, "run_cycle", lambda s, chunks, seeds, terms, **more: offered.extend(r.term for r in terms.collect()) or cycle(s, chunks, seeds, terms, **more))
    assert queries.QUERIES["aske_generation"](spark, str(tmp_path)).count() > 0
    assert sorted(offered) == sorted(f"term {i}" for i in range(40))


def brute_sections(heads):
    """{seq: (path, parent)}: each path follows from the one before, and the parent is the last shallower heading."""
    out, path = {}, ()
    for k, (seq, depth) in enumerate(heads):
        path = (*path[:depth], path[depth] + 1) if depth < len(path) else path + (0,) * (depth + 1 - len(path))
        before = [s for s, d in heads[:k] if d < depth]
        out[seq] = (".".join(str(n) for n in path), before[-1] if before else None)
    return out


def test_section_tree_against_brute_force(spark):
    rng = random.Random(8)
    docs = {f"d{k}": [(s, rng.randrange(4)) for s in range(rng.randint(1, 25))] for k in range(40)}
    rows = [(c, s, d, f"h{s}") for c, heads in docs.items() for s, d in heads]
    got = {(r.celex, r.seq): (r.path, r.parent_seq) for r in judgments.section_tree(spark.createDataFrame(rows, "celex string, seq int, depth int, text string")).collect()}
    assert got == {(c, s): v for c, heads in docs.items() for s, v in brute_sections(heads).items()}


CITES = {
    "Article 1 of the Privacy Shield Decision and Article 45(1) of the GDPR": ["45"],
    "Articles 7, 8 and 47 of the Charter, Article 5 of Directive 95/46": [],
    "Articles 44 to 50 of the GDPR": [],
    "Articles 56 and 60 of Regulation (EU) 2016/679 and Article 61(8) of that regulation": ["56", "60", "61"],
    "ARTICLE 5(1)(a) and (b) of the GDPR; Article 6 of Regulation No 2016/679": ["6"],
    "Article 9 of  the\nRegulation (EU) No 2016/679, read with article 9(2) of the gdpr": ["9"],
    "the article of the GDPR, Articles of Regulation 2016/679, Article 3 of GDPR": [],
    "": [],
}


def test_citations(spark):
    rows = [(t, "32016R0679", legal.surface_forms("32016R0679")) for t in CITES]
    df = spark.createDataFrame(rows, "text string, celex string, forms array<string>")
    got = {r.text: r.c for r in df.select("text", legal.cited_articles(F.col("text"), F.col("celex"), F.col("forms")).alias("c")).collect()}
    assert got == {t: [f"32016R0679art_{n}" for n in ns] for t, ns in CITES.items()}
    assert "that regulation" not in legal.surface_forms("32016R0679", False) and legal.surface_forms("62019CJ0645") == []
    assert "directive 95/46" in legal.surface_forms("31995L0046")


def test_upsert_takes_the_largest_of_several(spark):
    old = spark.createDataFrame([("a", "x")], "id string, title string")
    new = spark.createDataFrame([("a", "y"), ("a", "z"), ("b", None), ("b", "w")], "id string, title string")
    assert {tuple(r) for r in graph.upsert_nodes(old, new).collect()} == {("a", "z"), ("b", "w")}
    assert {tuple(r) for r in graph.update_by_key(old, new, ["id"], "title").collect()} == {("a", "z")}


def test_graph_helpers(spark):
    paragraphs = spark.createDataFrame([("p1",), ("p2",)], "id string")
    topics = spark.createDataFrame([("p1", ["a", "b", None]), ("p3", ["a"])], "paragraph_id string, topics array<string>")
    assert {tuple(r) for r in graph.link_topics(topics, paragraphs).collect()} == {("p1", "a"), ("p1", "b")}
    nodes = spark.createDataFrame([("Act", "X", None), ("Act", "Y", [1.0])], "label string, id string, embedding array<float>")
    assert graph.exists(nodes, "Act", "X") and not graph.exists(nodes, "Act", "Z") and [r.id for r in graph.missing(nodes).collect()] == ["X"]


def test_blockwise_products(spark, monkeypatch):
    from lexloom.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 700)
    monkeypatch.setattr(blocks, "SLICE", 2)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(5).round(1).tolist()) for i in range(60)] + [(100, None), (101, [1.0]), (102, [0.0] * 5), (103, [None] * 5)]
    side = [(f"q{i}", rng.standard_normal(5).round(1).tolist()) for i in range(9)] + [("none", None), ("short", [2.0])]
    a, b = spark.createDataFrame(rows, "doc int, v array<double>"), spark.createDataFrame(side, "q string, w array<double>")
    good = lambda v, n: v is not None and len(v) == n and None not in v
    want = {}
    for i, v in rows:
        for q, w in side:
            if w is not None and good(v, len(w)) and np.linalg.norm(v) and np.linalg.norm(w):
                want[i, q] = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
    got = {(r.doc, r.q): r.score for r in blocks.similar(a, ["doc"], "v", b, ["q"], "w", 0.2).collect()}
    assert got == pytest.approx({k: x for k, x in want.items() if x >= 0.2}, abs=1e-8)
    top = retrieval.dense_top_k(a, b, 3, "doc", "v", "q", "w").collect()
    for q, w in side[:9]:
        dots = sorted(((-round(float(np.dot(v, w)), 9), i) for i, v in rows if good(v, 5)))[:3]
        assert sorted((r["rank"], r.doc) for r in top if r.query_id == q) == [(k, i) for k, (_, i) in enumerate(dots, 1)]


def test_bm25_top_k_equals_all_scores(spark, monkeypatch):
    from lexloom.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 400)
    rng = random.Random(3)
    word = lambda: rng.choice("a b c d e f g h A B \u00e9 rare".split())
    docs = spark.createDataFrame([(i, f"s{i % 2}", " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(90, "s0", None), (91, "s1", "a\ta\n b")], "doc int, source string, text string")
    asked = spark.createDataFrame([(i, f"s{i % 2}", " ".join(word() for _ in range(5))) for i in range(12)] + [(50, "s0", ""), (51, "s1", None)], "query_id int, source string, text string")
    for group, own in (((), False), (("source",), False), (("source",), True)):
        q = asked if own else asked.drop("source")
        scores = retrieval.bm25_scores(retrieval.bm25_stats(docs, "doc", "text", group), q, "text", "query_id", group, own)
        want = retrieval.top_k(scores.withColumn("score", F.round("score", 6)), 4, ("query_id", *group))
        got = retrieval.bm25_top_k(docs, q, 4, group=group)
        key = lambda df: sorted((r.query_id, *(r[c] for c in group), r["rank"], r.doc, round(r.score, 5)) for r in df.collect())
        assert key(got) == key(want) and key(got)


def test_classify_ties_and_validate(spark):
    seeds = spark.createDataFrame([("data law", [1.0, 0.0])], "label string, embedding array<double>")
    rows = spark.createDataFrame([("data law", [1.0, 0.0]), ("oneword", [1.0, 0.0]), ("two words", [0.9, 0.1]), ("far off", [0.0, 1.0])], "label string, embedding array<double>")
    assert {r.label for r in topics.validate(rows, seeds).collect()} == {"data law", "two words"}


def test_sinks_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.write_tables({"t": df}, str(tmp_path / "g"), {"t": ["k"]})
    assert spark.read.parquet(str(tmp_path / "g/t")).count() == 1
    sinks.clear({"t": df}, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h/t")).count() == 0
    pages = spark.createDataFrame([("X", "x" * 1200, "u"), ("Y", "short", "v")], "celex string, html string, url string")
    assert [r.celex for r in sinks.land_pages(pages, str(tmp_path / "l")).collect()] == ["X"]
    log = sinks.run_log(str(tmp_path / "run.log"), "lexloom-test")
    sinks.run_log(str(tmp_path / "run.log"), "lexloom-test").info("once")
    assert (tmp_path / "run.log").read_text().count("once") == 1 and len(log.handlers) == 1
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().v == "a"
    report = spark.createDataFrame([("b", ["y", "x", "x"], True), ("a", ["z"], True), ("c", ["q"], False)], "label string, terms array<string>, active boolean")
    assert [(r.label, r.terms) for r in sinks.concept_report(report).collect()] == [("a", ["z"]), ("b", ["x", "y"])]


def test_files(spark, tmp_path):
    from lexloom.sources import files

    (tmp_path / "q.json").write_text('[{"act": "A", "question": "Q", "ground_truth": "G"}]')
    assert files.read_questions(spark, str(tmp_path / "q.json")).first().question == "Q"
    (tmp_path / "32016R0679.html").write_text("<p>x</p>")
    assert tuple(files.read_pages(spark, str(tmp_path / "32016R0679.html")).first()) == ("32016R0679", "<p>x</p>")
    for k, name in enumerate(("old", "new", "other")):
        (tmp_path / f"{name}.csv").write_text("question,ground_truth,answer\na,b,c\n" if name != "other" else "x\n1\n")
        os.utime(tmp_path / f"{name}.csv", (1000 + k, 1000 + k))
    paths = [str(tmp_path / f"{n}.csv") for n in ("old", "new", "other")]
    assert files.results(spark, paths) == [paths[1], paths[0]]
    known = spark.createDataFrame([("B",), ("A",), ("A",)], "celex string")
    assert [r.celex for r in files.celex_list(spark, ["x1"], known).collect()] == ["X1"]
    assert [r.celex for r in files.celex_list(spark, None, known, 1).collect()] == ["A"]


def test_metadata_parser(spark):
    html = "<div id='PPLinked_Contents'><dl><dt>x</dt><dd><ul><li class='defaultUnderlined'>A02P1 Interpreted by <a data-celex='62019CJ0645'>c</a></li><li class='defaultUnderlined'>A03 Amended by <a data-celex='Z'>z</a></li></ul></dd></dl></div>"
    rows = parse_pages(spark.createDataFrame([("X", html)], "celex string, html string"), "metadata").collect()
    assert [(r.case_celex, r.reference) for r in rows] == [("62019CJ0645", "A02P1")]


def test_parser_survives_deep_pages(spark):
    deep = "<div>" * 20_000 + "<p>x</p>"
    assert parse_pages(spark.createDataFrame([("X", deep)], "celex string, html string"), "judgment").first().text == "x"


def test_celex_of_zeros_alone(spark):
    """Numbers lose all leading zeros, as celex_decompose's SQL has it."""
    assert tuple(one(spark, legal.celex_parts(F.col("c")), c="31992L00")) == ("Directive", ["1992/", "92/"])
    assert "directive 1992/" in legal.surface_forms("31992L00")


def test_means_below_zero_keep_their_sign(spark):
    from lexloom.functions.vectors import rounded

    got = [one(spark, rounded(F.col("x"), 4), x=x) for x in (-0.00003, 0.00003, -0.00005, 0.12345, -1.0)]
    assert [repr(x) for x in got] == ["-0.0", "0.0", "-0.0001", "0.1235", "-1.0"]


def test_page_titles_as_written(spark):
    pages = [("a", "<html>\n<head><title>R&D &amp;&amp</title></head><body><p>x &lt; y</p>"), ("b", "<p>none"), ("c", "<title>one</title><svg><title>two</title></svg>")]
    rows = parse_pages(spark.createDataFrame(pages, "celex string, html string"), "page").collect()
    assert {r.celex: r.written for r in rows} == {"a": "R&D &amp;&amp", "b": "", "c": "one"}
    assert {r.celex: r.title for r in rows} == {"a": "R&D &&", "b": "", "c": "one"}


def test_ids_are_made_of_distinct_keys(spark, tmp_path):
    from lexloom.queries import id_display

    keys = [(1, 3), (1, 3), (1001, 3), (7, 0), (None, 2), (8, None)]
    spark.createDataFrame(keys, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    found = id_display(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # what is made of a key isn't counted again
    ids = [r.id for r in found.collect()]
    whole = [k for k in (1, 1001, 7, 8)]
    assert len(ids) == len(set(ids)) == 11 * len(whole) + 5 * 2 + 1 and None in ids
    assert {r.shown for r in found.collect()} >= {"GDPR, Article 1(3)", "AI Act, Article 7", "62019CJ0645_par_8"}


def test_rounding_of_rounded_scores(spark):
    """To 6 and then 4 places: what DuckDB makes of it, as in abbreviations_learnt."""
    from lexloom.functions.vectors import rounded

    assert one(spark, rounded(F.col("x"), 4), x=-0.00015) == -0.0001
