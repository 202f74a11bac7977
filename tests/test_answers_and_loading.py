"""Loading, the whole hybrid plan, answers, prompts, summaries, metrics and the token limiter."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.functions import legal
from lexloom.operators import evaluation, loading, summaries
from lexloom.plans import answering
from lexloom.plans.retrieval import HybridConfig, Store, TopicsConfig, by_topics, citation_bridge, hybrid, search_queries
from lexloom.prompts import CATALOGUE, Prompt, Registry, fill
from lexloom.providers import extractive_model, hashed_embedder, overlap_scorer
from lexloom.seeds import SEEDS, seed_concepts, topic_vectors
from lexloom.sources.html import parse_pages
from lexloom.streaming.windows import limited

ACT = "<div class='eli-main-title'><p>Act</p></div><div id='cpt_I'><div id='cpt_I.tit_1'><p>General</p></div><div id='cpt_I.sct_1'><div id='art_1'><div id='art_1.tit_1'><p>Subject</p></div><div id='001.001'><p class='oj-normal'>See Article 2 and Article 99</p></div></div></div><div id='art_2'><div id='002.001'><p class='oj-normal'>Two</p></div></div></div><div id='rct_3'><p class='oj-normal'>(3) Whereas</p></div>"
META = "<ul><li class='defaultUnderlined'>A01P1 Interpreted by <a data-celex='C1'>c</a></li><li class='defaultUnderlined'>A02 Interpreted by <a data-celex='C2'>c</a></li><li class='defaultUnderlined'>A77 Interpreted by <a data-celex='C3'>c</a></li></ul>"


def test_act_graph(spark):
    pages = lambda html: spark.createDataFrame([("X", html)], "celex string, html string")
    urls = spark.createDataFrame([("X", "http://x")], "celex string, eurolex_url string")
    g = loading.act_graph(parse_pages(pages(ACT), "act"), urls, parse_pages(pages(META), "metadata"))
    edges = {(r.src, r.rel, r.dst) for r in g.edges.collect()}
    assert edges == {
        ("X", "CONTAINS", "Xcpt_I"), ("Xcpt_I", "CONTAINS", "Xart_2"), ("X", "CONTAINS", "Xrct_3"), ("Xart_1", "CONTAINS", "X_001.001"), ("Xart_2", "CONTAINS", "X_002.001"),
        ("Xcpt_I", "CONTAINS", "Xcpt_I.sct_1"), ("Xcpt_I.sct_1", "CONTAINS", "Xart_1"), ("Xart_1", "CITES", "X_001.001"), ("Xart_2", "CITES", "X_002.001"), ("Xart_1", "CITES", "Xart_2"),
        ("C1", "INTERPRETS", "X_001.001"), ("C2", "INTERPRETS", "Xart_2"),
    }
    assert g.nodes["Act"].first().eurolex_url == "http://x"
    assert {r.id: (r.chapter_id, r.section_id) for r in g.nodes["Article"].collect()} == {"Xart_1": (None, "Xcpt_I.sct_1"), "Xart_2": ("Xcpt_I", None)}
    empty = parse_pages(spark.createDataFrame([("C1", None)], "celex string, html string"), "judgment")
    c = loading.corpus(g, loading.judgment_graph(empty), spark.createDataFrame([("X_001.001", ["t"])], "paragraph_id string, topics array<string>"))
    assert [r.celex for r in c.case_law(["X"]).collect()] == ["C1", "C2"] and c.unique_topics().first().topics == ["t"]


def test_judgment_without_anchor_has_no_preamble(spark):
    rows = spark.createDataFrame([("C", 0, "coj-title-grseq-2", "Facts", None), ("C", 1, "", "1 One", None)], "celex string, seq int, css string, text string, error string")
    assert loading.preamble(rows).count() == 0
    nodes = loading.judgment_graph(rows, spark.createDataFrame([("C", "Facts", "sum"), ("C", None, "all")], "celex string, heading string, summary string")).nodes
    assert [(r.id, r.heading, r.summary) for r in nodes["CaseLawSection"].collect()] == [("C_sec_0", "Facts", "sum")]
    assert nodes["CaseLaw"].first().summary == "all" and nodes["CaseLawParagraph"].first().id == "C_par_1"
    depths = spark.createDataFrame([("C", 0, "Facts", 0)], "celex string, seq int, text string, depth int")
    assert loading.section_texts(rows, depths).first().text == "1 One"


@pytest.fixture(scope="module")
def store(spark):
    vec = lambda *x: [float(v) for v in x]
    gdpr, dga = "32016R0679", "32022R0868"
    articles = [(f"{gdpr}art_{k}", gdpr, f"consent word{k} data", f"Title {k}", "I", "General", vec(k, 1)) for k in range(1, 8)] + [(f"{dga}art_1", dga, "sharing of data", "Scope", None, None, vec(9, 9)), ("Zart_1", "Z", "consent consent", "T", None, None, vec(99, 99))]
    recitals = [(f"{gdpr}rct_{k}", gdpr, f"({k}) consent recital w{k}") for k in range(1, 6)]
    case = "62019CJ0645"
    passages = [(f"{case}_par_{k}", case, k, f"para {k} " + ("consent court" if k in (3, 9) else "other text") + (" under Article 6 of the GDPR" if k == 9 else ""), "The question", "C-645/19", False, vec(k, 0)) for k in range(1, 13)]
    passages += [(f"{case}_op_1", case, 1, "consent must be read so", "Costs", "C-645/19", True, vec(1, 1)), ("Y_par_1", "Y", 1, "consent court consent", None, None, False, vec(50, 50))]
    return Store(
        spark.createDataFrame(articles, "doc string, act string, text string, title string, chapter_number string, chapter_title string, embedding array<double>"),
        spark.createDataFrame(recitals, "doc string, act string, text string"),
        spark.createDataFrame(passages, "doc string, celex string, number int, text string, section_heading string, case_number string, is_operative boolean, embedding array<double>"),
        spark.createDataFrame([(case, gdpr), ("Y", "Z")], "celex string, act string"),
    )


def asked(spark, *rows):
    return spark.createDataFrame(rows, "query_id int, text string, acts array<string>, intent string, query_vector array<double>, sub_questions array<string>")


def test_hybrid(spark, store):
    gdpr = "32016R0679"
    q = asked(spark, (1, "consent court word2", [gdpr], "INTERPRETIVE", [1.0, 0.0], ["word5 data", "CONSENT court word2 "]), (2, "data", [gdpr, "32022R0868"], "DEFINITIONAL", None, []), (3, "data", [], "INTERPRETIVE", [1.0, 0.0], []))
    got = hybrid(store, q, HybridConfig(top_k_final=4, max_recitals=2), None).collect()
    by = lambda query, slot: [r.doc for r in sorted(got, key=lambda r: r["rank"]) if (r.query_id, r.slot) == (query, slot)]
    assert {r.query_id for r in got} == {1, 2}
    assert len(by(1, "article")) == 4 and all(d.startswith(gdpr) for d in by(1, "article"))  # Z's article is out of scope
    assert f"{gdpr}art_6" in by(1, "article")  # only the bridge brings it in so high
    assert len(by(1, "recital")) == 2 and not by(2, "case law")
    cases = by(1, "case law")
    assert "62019CJ0645_op_1" in cases and not any(d.startswith("Y") for d in cases)
    heads = {r.doc: r.text.split("\n")[0] for r in got}
    assert heads[f"{gdpr}art_6"] == "[GDPR, Chapter I — General, Title 6]"
    recital = by(1, "recital")[0]
    assert heads[recital] == f"[GDPR, Recital {recital[-1]}]" and next(r.text for r in got if r.doc == recital).split("\n")[1].startswith("consent")
    assert heads["62019CJ0645_op_1"] == "[C-645/19, Costs, operative ruling 1]"


def test_hybrid_reranked(spark, store):
    q = asked(spark, (1, "consent court", ["32016R0679"], "INTERPRETIVE", [1.0, 0.0], []))
    got = hybrid(store.cached(), q, HybridConfig(rerank=True, recital_threshold=0.6, case_law_threshold=0.9), overlap_scorer).collect()
    assert {(r.doc, r.score) for r in got if r.slot == "case law"} == {("62019CJ0645_par_3", 1.0), ("62019CJ0645_par_9", 1.0)}  # the ruling scores 0.5
    assert not [r for r in got if r.slot == "recital"]  # 0.5 each
    off = hybrid(store, q, HybridConfig(use_recitals=False, use_case_law=False)).collect()
    assert {r.slot for r in off} == {"article"}


def test_bridge_anaphora(spark, store):
    kept = spark.createDataFrame([(1, "p", 0.7), (1, "q", 0.9)], "query_id int, doc string, score double")
    passages = spark.createDataFrame([("p", "Article 6 of that regulation and Article 7 of the GDPR"), ("q", "Article 1 of Regulation (EU) 2022/868")], "doc string, text string")
    both = asked(spark, (1, "", ["32016R0679", "32022R0868"], "", None, []))
    one = asked(spark, (1, "", ["32016R0679"], "", None, []))
    ids = lambda q: [r.doc for r in citation_bridge(kept, passages, store.articles, q, 3).orderBy("rank").collect()]
    assert ids(both) == ["32022R0868art_1", "32016R0679art_7"]  # two regulations: `that regulation` names neither
    assert ids(one) == ["32016R0679art_6", "32016R0679art_7"]


def test_search_queries(spark):
    q = asked(spark, (1, "One", ["B", "A"], "", None, [" one", "two", "", "Two ", "three"]))
    rows = search_queries(q, HybridConfig(), hashed_embedder(4)).orderBy("pos").collect()
    assert [r.text for r in rows] == ["One", "two"] and {r.scope for r in rows} == {"A,B"} and all(len(r.query_vector) == 4 for r in rows)
    made = search_queries(q, HybridConfig(hyde=True, hyde_texts=2, decompose=False), hashed_embedder(4), extractive_model).first()
    assert made.query_vector == pytest.approx(hashed_embedder(4)(["One"])[0], abs=1e-6)


def test_topics_with_dense_leg(spark):
    vectors = spark.createDataFrame([("data", [1.0, 0.0])], "label string, embedding array<double>")
    tagged = spark.createDataFrame([("Ap1", "data"), ("Bp2", "data")], "paragraph_id string, label string")
    texts = spark.createDataFrame([("Ap1", "data words"), ("Bp2", "data here"), ("Ap3", "none")], "doc string, text string")
    dense = spark.createDataFrame([("Ap1", [1.0, 0.0]), ("Ap3", [0.9, 0.0]), ("Bp2", [0.8, 0.0])], "doc string, embedding array<double>")
    q = spark.createDataFrame([(7, "data", [1.0, 0.1])], "query_id int, text string, query_vector array<double>")
    acts = spark.createDataFrame([(7, "A")], "query_id int, act string")
    got = {(r.doc, r.source) for r in by_topics(vectors, tagged, texts, q, TopicsConfig(topic_threshold=0.5), acts, dense).collect()}
    assert got == {("Ap1", "semantic_topic_filter"), ("Ap3", "vector_search")}
    ranked = by_topics(vectors, tagged, texts, q, TopicsConfig(topic_threshold=0.5, rerank=True), None, dense, overlap_scorer).orderBy("rank").collect()
    assert [r.score for r in ranked] == [1.0, 1.0, 0.0]


def test_classifier(spark):
    q = spark.createDataFrame([(1, "How do courts interpret the GDPR?"), (2, "nothing here")], "query_id int, text string")
    acts = spark.createDataFrame([("32016R0679", "GDPR")], "id string, title string")
    got = {r.query_id: (r.intent, r.acts, r.act_scores) for r in answering.classify(q, acts).collect()}
    assert got == {1: ("INTERPRETIVE", ["32016R0679"], {"32016R0679": 1.0}), 2: ("DEFINITIONAL", [], {})}
    seen = answering.classify(q, acts, lambda prompts: ["no json"] * len(prompts)).where("query_id = 1").first()
    assert (seen.intent, seen.acts, seen.sub_questions) == ("DEFINITIONAL", ["32016R0679"], [])
    accuracy = evaluation.act_classification(q.withColumn("expected", F.lit("32016R0679")), acts, answering.keyword_classifier).where("expected = '(all)'").first()
    assert (accuracy.detected, accuracy.abstained) == (0.5, 0.5)


def test_answers_end_to_end(spark):
    found = spark.createDataFrame([(1, "recital", 1, "r", "[GDPR, Recital 3]\nwhereas"), (1, "article", 2, "b", "[GDPR, B]\nthe second rule holds"), (1, "article", 1, "a", "[GDPR, A]\nconsent is free")], "query_id int, slot string, rank int, doc string, text string")
    q = spark.createDataFrame([(1, "what?"), (2, "else?")], "query_id int, text string")
    placed = answering.passages(found)
    assert [r.doc for r in placed.orderBy("pos").collect()] == ["a", "b", "r"]
    keep = lambda prompts: ['{"keep": [1, 0, 9], "governing": [1]}'] * len(prompts)
    kept, told = answering.curated(found, q, keep)
    assert [r.doc for r in kept.orderBy("pos").collect()] == ["b", "a"] and "[GDPR, B]" not in told.first().guidance and "GDPR, B" in told.first().guidance
    say = lambda prompts: ["Consent is free.\r\nNobody knows why. The second rule holds always."] * len(prompts)
    made = answering.synthesise(kept, q, say, told)
    rows = {r.query_id: r for r in made.collect()}
    assert rows[2].answer == answering.NOTHING_FOUND and rows[2].sources == [] and "\r" not in rows[1].answer
    assert [(s.marker, s.id, s.title) for s in rows[1].sources] == [("S1", "b", "GDPR, B"), ("S2", "a", "GDPR, A")]
    segments, sources = answering.attribute(made)
    assert [(r.answer, r.text, r.markers) for r in segments.orderBy("answer", "pos").collect()] == [(1, "Consent is free.", ["S1"]), (1, "Nobody knows why.", []), (1, "The second rule holds always.", ["S2"]), (2, answering.NOTHING_FOUND, [])]
    assert {(r.answer, r.marker, r.id) for r in sources.collect()} == {(1, "S1", "a"), (1, "S2", "b")}
    shown = answering.answer_badges(segments).where("answer = 1").first().shown
    assert shown == "Consent is free. [S1] Nobody knows why. The second rule holds always. [S2]"
    cut = answering.synthesise(kept, q, say, answer_filter=lambda prompts: ["short"] * len(prompts)).where("query_id = 1").first()
    assert cut.answer == "short"


def test_model_attribution():
    reply = lambda r: answering.model_attribution(lambda prompts: [r])(["a", "b"], [("S1", "x")])
    assert reply(json.dumps({"assignments": [{"index": 1, "markers": ["S1"]}, {"index": 7, "markers": ["S1"]}]})) == [[], ["S1"]]
    assert reply("nonsense") == [[], []]


def test_display(spark):
    row = spark.createDataFrame([(3, "GDPR", "x" * 90), (4, None, "a\nb")], "n int, act string, q string")
    got = [r.l for r in row.select(answering.question_label(F.col("n"), F.col("act"), F.col("q")).alias("l")).collect()]
    assert got == ["3. [GDPR] " + "x" * 80 + "…", "4. a b"]
    cells = spark.createDataFrame([('[{"text": "t", "markers": ["S1"]}]',), (None,), ("{broken",)], "c string")
    assert [len(r.j) for r in cells.select(answering.json_list(F.col("c")).alias("j")).collect()] == [1, 0, 0]


def test_prompts(spark):
    r = Registry()
    r.add(Prompt("a", "v1", "x"), Prompt("a", "v2", "y {q}", active=True), Prompt("b", "v1", "z"))
    assert r.active("a").version == "v2" and r.get("a", "v1").body == "x" and r.names() == ["a", "b"] and len(r.versions("a")) == 2
    for bad in (lambda: r.add(Prompt("a", "v1", "")), lambda: r.active("b"), lambda: r.active("none"), lambda: r.get("a", "v9"), r.active_versions):
        with pytest.raises(ValueError):
            bad()
    assert CATALOGUE.active_versions()["answer_synthesis"] == "v2" and len(CATALOGUE.names()) >= 15
    from lexloom.operators.answers import prompt_problems

    assert prompt_problems(CATALOGUE.table(spark)).count() == 0
    assert spark.range(1).select(fill(r.active("a"), q=F.lit("$1 {q}")).alias("p")).first().p == "y $1 {q}"


def test_seeds(spark):
    assert len(SEEDS) == len(set(SEEDS)) == 96
    seeds = seed_concepts(spark, hashed_embedder(8), SEEDS[:3])
    assert [(r.label, r.terms, r.active) for r in seeds.collect()] == [(s, [s], True) for s in SEEDS[:3]]
    vectors = topic_vectors(spark.createDataFrame([("a",), ("a",), (None,)], "label string"), hashed_embedder(8))
    assert vectors.count() == 1 and len(vectors.first().embedding) == 8


def test_summaries(spark):
    from test_operators import corpus

    c = corpus(spark)
    say = lambda prompts: [p.splitlines()[-1].upper() for p in prompts]
    assert {r.id: r.summary for r in summaries.summarise_articles(c, say).collect()} == {"Xart_2": "P2", "Xart_10": "P3"}
    assert {r.id: r.summary for r in summaries.summarise_chapters(c, say).collect()} == {"Xcpt_I": "DEFINITIONS", "Xcpt_II": None}
    texts = spark.createDataFrame([("C", 0, "Topics", 0, "t"), ("C", 1, "Facts", 0, "one\ntwo"), ("C", 2, "Empty", 1, " ")], "celex string, section_seq int, heading string, depth int, text string")
    assert [tuple(r) for r in summaries.summarise_sections(texts, say).collect()] == [("C", "Facts", "TWO")]
    told = lambda prompts: ['```json\n{"heading": "F", "summary": "s"}\n```'] * len(prompts)
    assert [tuple(r) for r in summaries.summarise_sections(texts, told).collect()] == [("C", "F", "s")]
    whole = summaries.summarise_documents(texts, lambda prompts: [str(p.count("\n")) for p in prompts]).first()
    assert (whole.celex, whole.heading) == ("C", None)


def test_answer_scores(spark):
    rows = spark.createDataFrame([(1, "q a", "a b\n- c d", "a b\nx y", ["zz", "a b c", "x y"]), (2, "q", "", "", [])], "answer int, question string, response string, ground_truth string, contexts array<string>")
    lines = lambda prompts: [p.split("\n\n", 1)[1] for p in prompts]
    got = {r.answer: r for r in evaluation.answer_scores(rows, lines, overlap_scorer).collect()}
    one = got[1]  # `c d` is half in no reference; overlap of half is support
    assert (one.tp, one.fp, one.fn) == (1, 1, 1) and one.precision == one.recall == one.f1 == 0.5
    assert one.faithfulness == 1.0 and one.context_recall == 1.0 and one.factual_recall == 0.5
    assert one.context_precision == pytest.approx((1 / 2 + 2 / 3) / 2) and one.answer_relevancy == 0.5
    assert (got[2].tp, got[2].f1, got[2].faithfulness) == (0, 0.0, None)
    report, failed = evaluation.experiment(rows, lambda df: df.where("answer = 1").select("answer", F.lit(1).alias("score")), "answer")
    assert report.first().score == 1 and [r.answer for r in failed.collect()] == [2]


def brute_limiter(requests, limit, window, pause):
    granted, kept, now = [], [], None
    for t, n in requests:
        now = t if now is None else max(t, now)
        kept = [(a, m) for a, m in kept if now - a < window]
        while kept and sum(m for _, m in kept) + n > limit:
            now = kept[0][0] + window + pause
            kept = [(a, m) for a, m in kept if now - a < window]
        kept.append((now, n))
        granted.append(now)
    return granted


def test_limiter_stream(spark, tmp_path):
    rows = [(f"r{k:02}", "u" if k % 3 else "v", k * 7, float(1 + k % 5)) for k in range(30)] + [("r90", "u", 300, 50.0), ("r91", "u", 301, 1.0)]
    df = spark.createDataFrame(rows, "request string, user string, s int, tokens double").withColumn("ts", F.timestamp_seconds("s"))
    df.where("s < 100").write.parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (None, "s >= 100"):  # the state outlives a restart
            if part:
                df.where(part).write.mode("append").parquet(str(tmp_path / "in"))
            stream = limited(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user", "request", "ts", "tokens", 10, 60_000_000, 100_000)
            q = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
            q.processAllAvailable()
            q.stop()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {r.request: r.granted_us for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for user in ("u", "v"):
        own = [(r, s * 1_000_000, n) for r, u, s, n in rows if u == user]
        want = brute_limiter([(t, n) for _, t, n in own], 10, 60_000_000, 100_000)
        assert [got[r] for r, _, _ in own] == want


def test_source_headers(spark):
    row = spark.createDataFrame([("[GDPR, Article 5]\nbody",), ("no header",)], "t string").select(legal.source_header(F.col("t")).alias("h"), legal.document_id(F.lit(None).cast("string"), F.col("t")).alias("i")).collect()
    assert (row[0].h.header, row[0].h.act, row[0].h.title) == ("GDPR, Article 5", "GDPR", "Article 5") and row[1].h.header is None and row[1].i == "no header"


def test_engine(spark, store):
    from lexloom.engine import Engine

    acts = spark.createDataFrame([("32016R0679", "GDPR")], "id string, title string")
    nothing = Store(store.articles.withColumn("embedding", F.lit(None).cast("array<double>")), store.recitals, store.passages.withColumn("embedding", F.lit(None).cast("array<double>")), store.interprets)
    e = Engine(spark, nothing, acts, synthesis=lambda prompts: ["consent word2 data"] * len(prompts))
    q = spark.createDataFrame([(1, "what does the gdpr say of consent word2"), (2, "nothing named")], "query_id int, text string")
    answers, segments, sources = e.answer(q, top_k_final=2)
    assert {r.query_id: r.answer for r in answers.collect()} == {1: "consent word2 data", 2: answering.NOTHING_FOUND}
    assert "32016R0679art_2" in {r.id for r in sources.collect()} and segments.count() == 2
    assert set(e.methods()) == {"hybrid", "topics"}
    with pytest.raises(ValueError):
        e.retrieve(q, "nope")


def test_fetch_and_convert(spark, tmp_path):
    from lexloom.sources import files

    def fetch(url):
        if url == "bad":
            raise OSError("404")
        return "x" * (2000 if url == "good" else 5)

    urls = spark.createDataFrame([("A", "good"), ("B", "bad"), ("C", "short")], "celex string, url string")
    got = {r.celex: (r.html is not None, r.error) for r in files.fetched(urls, fetch).collect()}
    assert got == {"A": (True, None), "B": (False, "OSError: 404"), "C": (False, "too short")}
    import zlib

    (tmp_path / "a.html").write_text("<html><head><title>t</title></head><body><p>One  two</p><script>x</script><p>three</p></body></html>")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <<>> stream\n" + zlib.compress(b"BT (Hello \\(x\\)) Tj [(W) -20 (orld)] TJ ET") + b"\nendstream endobj")
    (tmp_path / "c.odd").write_text("?")
    rows = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in files.convert(spark, str(tmp_path)).collect()}
    assert rows["a.html"][0] == "One two\nthree" and rows["b.pdf"][0] == "Hello (x)\nWorld" and rows["c.odd"] == (None, "KeyError: 'odd'")


def test_vector_index_and_terms(spark, tmp_path):
    from lexloom.functions.text import candidate_terms
    from lexloom.operators import judgments, sinks, topics

    nodes = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", None)], "id string, embedding array<double>")
    assert [(r.id, r.embedding) for r in sinks.create_vector_index(nodes, str(tmp_path / "i"), 2).collect()] == [("a", [0.6, 0.8])]
    tokens = spark.createDataFrame([("Consent", "NN", 0), ("freely", "RB", 1), ("consent", "NNP", 2), ("article", "NN", 3)], "tok string, tag string, pos int")
    assert [(r.term, r.n) for r in candidate_terms(tokens, "tok", "pos", tag="tag").collect()] == [("consent", 2)]
    classified = spark.createDataFrame([(2, "l"), (1, "l"), (2, "m")], "chunk int, label string")
    assert {r.label: r.chunks for r in topics.chunk_index(classified).collect()} == {"l": [1, 2], "m": [2]}
    depths = spark.createDataFrame([("C", 0, 0), ("C", 3, 2)], "celex string, seq int, depth int")
    body = spark.createDataFrame([("C", 1), ("C", 2)], "celex string, seq int")
    assert tuple(judgments.tree_metrics(depths, body).first()) == ("C", 2, 2, 2)


def test_trailing_sum_against_brute_force(spark):
    import random

    from lexloom.streaming.windows import trailing_sum

    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.randrange(0, 400_000_000), float(rng.randrange(9))) for k in range(400)] + [(900, "a", 60_000_000, 1.0), (901, "a", 120_000_000, 1.0), (902, "a", 120_000_000, 2.0)]
    df = spark.createDataFrame(rows, "id int, k string, us long, v double").withColumn("ts", F.timestamp_micros("us"))
    got = {r.id: r.in_window for r in trailing_sum(df, ["k"], "ts", "v").collect()}
    assert got == {i: sum(x for _, k2, u2, x in rows if k2 == k and u - 60_000_000 < u2 <= u) for i, k, u, _ in rows}


def test_backfill_and_view(spark):
    rows = spark.createDataFrame([(1, "Consent is free. It rains.", "a|b", "the law|consent is always free"), (2, "x", "a|b", "one")], "k int, answer string, sources string, contexts string")
    got = {r.k: r for r in answering.backfill_attribution(rows, "k").collect()}
    assert json.loads(got[1].segments) == [{"text": "Consent is free.", "markers": ["S1"]}, {"text": "It rains.", "markers": []}]
    assert json.loads(got[1].cited_sources) == [{"marker": "S1", "id": "b"}] and got[2].segments is None and got[2].cited_sources is None
    report = spark.createDataFrame([("A", "q2", 0.5), ("A", "q1", 0.9), ("B", "q", 1.0)], "act string, question string, f1 double")
    assert [(r.question, r.row) for r in answering.view(report, "A").orderBy("row").collect()] == [("q1", 0), ("q2", 1)]
    assert [r.question for r in answering.view(report, "A", "f1", 0.6).collect()] == ["q1"]
    from lexloom.operators.graph import topic_nodes

    assert {r.label for r in topic_nodes(spark.createDataFrame([("a",)], "label string"), spark.createDataFrame([("p", "a"), ("p", "b"), ("q", None)], "paragraph_id string, label string")).collect()} == {"a", "b"}


def test_acts_in_parts(spark):
    """Parts of an act, cut between its elements, give the rows of the whole page."""
    head = '<div class="eli-main-title"><p>Act</p></div>'
    title = '<div id="cpt_I.tit_1"><p>Chapter I</p></div>'
    articles = [f'<div id="art_{k}"><p class="oj-normal">Article {k}</p><div id="00{k}.1"><p class="oj-normal">One {k}.</p></div></div>' for k in (1, 2)]
    recital = '<div id="rct_1"><p>Whereas.</p></div>'
    whole = [("X", None, f'<html><body>{head}{recital}<div id="cpt_I">{title}{"".join(articles)}</div></body></html>')]
    parts = [("X", "", head), ("X", "", recital), ("X", "", f'<div id="cpt_I">{title}</div>'), *(("X", "cpt_I", a) for a in articles)]
    rows = lambda x: sorted(map(str, parse_pages(spark.createDataFrame(x, "celex string, within string, html string"), "act", within="within").collect()))
    assert rows(parts) == rows(whole) and len(rows(whole)) == 7
