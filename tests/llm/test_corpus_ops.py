"""Sharding, packing, extraction, joins, search, mixing and the pipeline."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import mixing
from lexloom.llm.common import components, table, union_find
from lexloom.llm.hamming import hamming_top_k
from lexloom.llm import html_extract as extraction
from lexloom.llm.html_extract import above, article, hash_text, html_extract, parse, sketch, style_tree
from lexloom.llm.jaccard_join import banding, jaccard_join, shared
from lexloom.llm.packing import best_fit_packing, encoder, reduce_and_fit
from lexloom.llm.queries import public_tokenizer
from lexloom.llm.sharding import stratified_shards


def test_sharding(spark):
    rows = [(i, None if i % 11 == 0 else f"t{i % 7}é", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(203)] + [(None, "x", None, 1), (7, "dup", "s1", 1), (7, "dup", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    for buckets in (None, 3):
        out = stratified_shards(docs, buckets=buckets).collect()
        assert len(out) == len(rows)
        by = defaultdict(list)
        for r in out:
            by[r.shard].append(r.slot)
        assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        hot = Counter(r.shard for r in out if r.source == "hot")
        assert max(hot.values()) - min(hot.values()) <= 2
    text = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 7}
    for r in out:
        if r.doc_id in text:
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert stratified_shards(docs.limit(0)).count() == 0
    assert stratified_shards(docs.limit(1)).count() == 1


def brute_shards(rows, shards=8, seed="lexloom"):
    """{(doc_id, crc, source): [(shard, slot)]} of (doc_id, text, source)."""
    rank = lambda x: (x is not None, x)
    md5 = lambda x: hashlib.md5(f"{seed}:{'null' if x is None else x}".encode()).hexdigest()
    by = defaultdict(list)
    for d, t, s in rows:
        raw = (t or "").encode()
        by[s].append((md5(d), rank(d), zlib.crc32(raw), len(raw) + 1))
    placed = []
    for s, own in by.items():
        u = (int(md5(s)[:8], 16) + 0.5) / 2.0**32
        placed += [((r - u) / len(own), rank(s), d, crc, n) for r, (_, d, crc, n) in enumerate(sorted(own), 1)]
    out = defaultdict(list)
    for pos, (_, s, d, crc, n) in enumerate(sorted(placed)):
        shard = pos * shards // len(placed)
        out[d[1], crc, s[1]].append((shard, pos - (shard * len(placed) + shards - 1) // shards))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("sources", [1, 5, 400])
def test_sharding_order(spark, sources):
    rng = random.Random(sources)
    rows = [(i, None if i % 9 == 0 else "t" * rng.randrange(4), None if i % 13 == 0 else f"s{i % sources}") for i in range(400)] + [(None, "x", None), (7, "again", "s1"), (7, "again", "s1"), (900, "long " * 200_000, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for buckets in (1, 16):
        got = defaultdict(list)
        for r in stratified_shards(docs, buckets=buckets).collect():
            got[r.doc_id, r.text_crc32, r.source].append((r.shard, r.slot))
        assert {k: sorted(v) for k, v in got.items()} == brute_shards(rows)


def test_sharding_many_small_sources(spark, monkeypatch):
    """One row a source: no bucket of either rank holds many rows."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("source"))
    seen = []
    from lexloom.llm import sharding

    ranked = sharding.distributed_rank
    monkeypatch.setattr(sharding, "distributed_rank", lambda df, group, bucket, *rest: seen.append(df.groupBy(*group, bucket).count().agg(F.max("count")).first()[0]) or ranked(df, group, bucket, *rest))
    assert stratified_shards(docs).groupBy("shard").count().where("count = 2500").count() == 8
    assert max(seen) < 300


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=40))))
def test_plan_keeps_items(case):
    capacity, items = case
    got = Counter()
    bins = 0
    for count, parts in reduce_and_fit(Counter(items), capacity):
        assert sum(n * m for n, m in parts) <= capacity and count > 0
        bins += count
        for n, m in parts:
            got[n] += count * m
    assert +got == Counter(items)
    assert bins <= max(1, -(-2 * sum(items) // capacity)) if items else bins == 0


def test_plan_is_optimal_where_dominance_decides():
    assert sum(c for c, _ in reduce_and_fit({6: 1000, 4: 1000, 10: 3}, 10)) == 1003
    assert sum(c for c, _ in reduce_and_fit({7: 2, 5: 2, 3: 2, 2: 1}, 10)) == 4


def test_tokenizers_agree():
    model = public_tokenizer()
    fast, slow = encoder(model), encoder({"json": model["json"], "key": "slow"})
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(1, 0x250), 32, 10, 39, 115])) for _ in range(rng.randrange(60)))
        assert list(fast(text)) == list(slow(text))
    other = "".join(chr(rng.choice([rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x1F9FF), 32, 10, 97])) for _ in range(4000))
    plain = "".join(chr(rng.choice([rng.randrange(1, 0x250), 32, 32, 10, 101, 116, 97])) for _ in range(60_000))
    for text in ("<|endoftext|>", "한글 🤣", "a <|endoftext|> b", other, plain, "word " * 20_000, "a" * 3000, "Привет, мир! " * 300, "日本語のテキスト" * 300, plain[:500] + "語"):
        assert list(fast(text)) == list(slow(text))


def test_packing(spark):
    model = public_tokenizer()
    rows = [(i, "word é " * (i * 3)) for i in range(30)] + [(50, None), (51, ""), (3, "again"), (None, "no id"), (60, "x y " * 3000)]
    out = best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string"), model, capacity=64).collect()
    encode = encoder(model)
    want = Counter()
    for d, text in rows:
        ids = [*encode(text or ""), 0]
        head = len(ids) % 64 or 64
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(seqs) <= 1.1 * sum(r.length for r in out) / 64 + 1
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


PAGE = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>Home</a></nav><div class='cookie-notice'>ok?</div><header>Site</header><article><h1>Head &amp; line</h1><p><b>One\n two.<br><p>{0}<aside>side</aside></p></article><div id='comments'><article>first!</article></div><form>x</form><footer>&copy;</footer></body></html>"


def test_html_extract(spark):
    plain = "<body><div class='lead'>Same on all.</div><div class='txt'><p>{0} is new.</p></div></body>"
    rows = [(i, f"https://a.example/{i}", PAGE.format(f"Body {i}")) for i in range(3)] + [(10 + i, f"http://b.example/{i}", plain.format(i)) for i in range(12)]
    rows += [(90, None, None), (91, "", ""), (92, "x", "<p>no end"), (93, "http://c.example", "a < b &amp"), (90, None, None)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    out = {r.page_id: (r.text, r.n_chars) for r in html_extract(pages).collect()}
    for i in range(3):
        assert out[i][0] == f"Head & line\nOne two.\nBody {i}"
    assert {out[10 + i][0] for i in range(12)} == {f"{i} is new." for i in range(12)}
    assert out[90] == ("", 0) and out[91] == ("", 0) and out[92][0] == "no end" and out[93][0] == "a < b &"
    assert html_extract(pages).count() == len(rows) and html_extract(pages.limit(0)).count() == 0
    assert html_extract(pages, carry=("url", "text", "page_id")).columns == ["url", "page_id", "text", "n_chars"]
    nodes, texts = style_tree(pages.select(F.lit(1).cast("long").alias("host"), "html").limit(0))
    assert nodes.count() == 0 and texts.count() == 0


def opaque_pages(n):
    """Pages whose menu, teaser and footer have names that say nothing; a notice stands among paragraphs like any."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(word() for _ in range(12))}</p>" for _ in range(rng.randint(2, 6)))
        out.append(f"<body><div class='x1'><ul><li>Home</li><li>News</li><li>Shop</li></ul></div><div class='x2'>{body}<p>Write to us today.</p></div><div class='x3'><div>Imprint</div><div>All prices in euro</div></div></body>")
    return out


@pytest.mark.parametrize("n", [3, 12])
def test_style_tree_decides(spark, monkeypatch, n):
    pages = spark.createDataFrame([(i, "http://o.example/x", h) for i, h in enumerate(opaque_pages(n))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract(pages).collect()}
    for i, h in enumerate(opaque_pages(n)):
        blocks, _ = parse(h, {})
        assert got[i].split("\n") == [b.text for b in blocks if " " in b.text and b.text not in ("Write to us today.", "All prices in euro")]
    # Without the tree's verdicts, every text stays.
    bare = spark.createDataFrame([], "site long, path long, feature long, state int")
    monkeypatch.setattr(extraction, "verdicts", lambda *args: bare)
    assert all("Home\nNews\nShop" in r.text and "Imprint" in r.text for r in html_extract(pages).collect())


def test_prior_yields_to_the_tree(spark):
    """A branch named like a notice stays if layout and texts vary as an article's do; one that is always alike goes."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    part = lambda k: "".join(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>"]).format(" ".join(word() for _ in range(9))) for _ in range(k))
    rows = [(i, "http://n.example/", f"<div class='notice'>{part(rng.randint(3, 9))}</div><div class='ad'>{word()} {word()}</div>") for i in range(40)]
    got = html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        blocks, _ = parse(rows[r.page_id][2], {})
        assert r.text == "\n".join(b.text for b in blocks[:-1])


def page_rows(sf="sf0.01"):
    import pyarrow.parquet as pq

    return pq.read_table(f"/root/testdata/{sf}/pages.parquet").to_pylist()


def test_tree_decides_on_the_given_pages(spark):
    """Every page of sf0.01 has an advert that the tree takes away; without the tree all of these would stay."""
    rows = page_rows()
    pages = spark.createDataFrame([(r["page_id"], r["url"], r["html"]) for r in rows], "page_id long, url string, html string")
    host = F.xxhash64(F.regexp_extract("url", "//([^/]+)", 1)).alias("host")
    states = Counter(r.state for r in extraction.verdicts(pages.select(host, "html")).collect())
    assert states[extraction.OUT] == 84 and states[extraction.SOLID] == 126
    got = {r.page_id: r.text for r in html_extract(pages).collect()}
    bare = {r["page_id"]: "\n".join(b.text for b in article(parse(r["html"], {})[0], set(), set())) for r in rows}
    want = {r["page_id"]: "\n".join(b.text for b in parse(re.search("<article>.*</article>", r["html"], re.S)[0], {})[0]) for r in rows}
    assert got == want and all(got[i] != bare[i] for i in got)


def test_tree_needs_no_names(spark):
    """The same with the advert's class and the article element renamed to what says nothing."""
    rows = page_rows()
    opaque = lambda h: h.replace('class="ad"', 'class="x7"').replace("<article>", "<div id='q'>").replace("</article>", "</div>")
    pages = spark.createDataFrame([(r["page_id"], r["url"], opaque(r["html"])) for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract(pages).collect()}
    want = {r["page_id"]: "\n".join(b.text for b in parse(re.search("<article>.*</article>", r["html"], re.S)[0], {})[0]) for r in rows}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_small_hosts_are_judged_by_template(spark):
    rows = [(i, f"http://h{i}.example/x", h) for i, h in enumerate(opaque_pages(9))] + [(50, "http://alone.example", "<div class='ad'>One of a kind</div><p>text</p>")]
    got = {r.page_id: r.text for r in html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Home" not in got[i] and "Imprint" not in got[i] and got[i] for i in range(9))
    assert got[50] == "One of a kind\ntext"  # nothing is known of it


def test_verdicts_meet_pages_by_host_too(spark, monkeypatch):
    monkeypatch.setattr(extraction, "PAGES", 7)
    rows = [(r["page_id"], r["url"], r["html"], "clash", 1) for r in page_rows()] + [(900, None, None, "", 2), (901, "http://z.example", "<p>only", "", 3)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, path int")
    few, many = (sorted((r.page_id, r.text, r.n_chars) for r in html_extract(pages, broadcast=n).collect()) for n in (extraction.BROADCAST_VERDICTS, 3))
    assert few == many and len(few) == len(rows)


def test_nodes_of_equal_importance_are_judged_alike(spark):
    rng = random.Random(3)
    part = lambda: "".join(f"<p>{rng.random()} {rng.random()}</p>" for _ in range(rng.randint(1, 9)))
    rows = []
    for i in range(30):
        same = part()
        rows.append((i, "http://t.example", f"<div class='a1'>{same}</div><div class='a2'>{same}</div><div class='b1'>Buy</div><div class='b2'>Buy</div>"))
    for r in html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        lines = r.text.split("\n")
        assert "Buy" not in r.text and lines[: len(lines) // 2] == lines[len(lines) // 2 :]


def test_sketches_share_what_sets_share():
    words = [f"w{i}" for i in range(400)]
    near = len(set(sketch(set(words))) & set(sketch(set(words[:360] + ["x", "y"]))))
    assert 10 <= near <= 16 and len(sketch(set(words))) == 16 and sketch(set()) == []
    assert set(sketch(set(words))).isdisjoint(sketch({f"v{i}" for i in range(400)}))


def test_every_word_counts(spark):
    """Two branches of the same size: in one all words but the sketched are alike on all pages, in the other only those."""
    words = [f"w{i}" for i in range(400)]
    kept = {h for h in sketch(set(words))}
    head = [w for w in words if hash_text(w) in kept]
    rest = [w for w in words if w not in head]
    assert len(head) == len(extraction.hashed(set(head))) == 16 and len(set(extraction.hashed(set(words)))) == 400
    pages = spark.createDataFrame([(1, f"<div class='a'><p>{' '.join(rest[:100])} {' '.join(w + str(i) for w in head)}</p></div>") for i in range(5)], "host long, html string")
    leaf = parse("<div class='a'><p>x</p></div>", {})[0][0].leaf
    content = lambda whole: {r.path: r.content for r in style_tree(pages, whole=whole)[0].collect()}[leaf]
    # 100 words are on all pages and say nothing; 16 of each page are its own.
    assert abs(content(True) - 80 / 180) < 1e-9 and abs(content(False) - 80 / 180) > 0.05


def test_tree_parts_are_smaller_than_their_pages(spark):
    """A word that many pages of a task have travels once, with their places; a hash of each page's words took 8 bytes for each."""
    rows = [(1, r["html"]) for r in page_rows() for r in (r, r | {"html": r["html"].replace("</p>", " more</p>")}) if r["html"]]
    parts = extraction.tree_parts(spark.createDataFrame(rows, "host long, html string").coalesce(1), whole=True).toArrow()
    words = sum(len({w for b in parse(h, {})[0] for w in b.text.split()}) for _, h in rows)
    assert parts.nbytes < 5 * words and parts.nbytes < 0.5 * sum(len(h) for _, h in rows)
    row, kind, feature, entry, copy, n = extraction.unpack(parts)
    got = Counter((parts["path"][int(row[e])].as_py(), int(kind[e]), int(feature[e]), int(c), int(m)) for e, c, m in zip(entry, copy, n))
    want = set()
    for _, h in rows:
        _, c, nodes = extraction.tree_rows(h, {})
        for p, (_, texts, layout, up, words) in nodes.items():
            want |= {(p, 0, f, c, m) for f, m in texts.items()} | {(p, 1, layout, c, 1)} | {(p, 2, a, 0, 1) for a in up} | {(p, 3, f, c, 1) for f in extraction.hashed(words)}
    assert set(got) == want and max(got.values()) == 1


def test_trees_are_the_same_however_they_are_dealt(spark, monkeypatch):
    """Copies that meet only after tasks have given their parts count once, also where a site is counted in many parts."""
    pages = opaque_pages(9) + [PAGE.format(f"Body {i} of {i % 3}") for i in range(9)] + ["", "<p>a b a</p><p>a b a</p>"]
    rows = [(1, h) for h in pages + pages[:7]] + [(2, h) for h in pages[:5]] + [(3 + i % 5, h) for i, h in enumerate(pages[3:11])]
    trees = []
    for held, part, tasks in ((extraction.HELD, extraction.PART, 1), (1, 300, 3)):
        monkeypatch.setattr(extraction, "HELD", held)
        monkeypatch.setattr(extraction, "PART", part)
        nodes, texts = style_tree(spark.createDataFrame(rows, "host long, html string").repartition(tasks), whole=True)
        near = lambda rows: sorted(tuple(tuple(sorted(v)) if isinstance(v, list) else round(v, 9) for v in r) for r in rows.collect())
        trees.append((near(nodes), near(texts)))
    assert trees[0] == trees[1] and len(trees[0][0]) > 20 and trees[0][1]


def test_style_tree_against_brute_force(spark):
    pages = opaque_pages(7) + [PAGE.format(f"Body {i}") for i in range(5)] + ["<div>a<div>b <i>c</i> <a href='/t'>d</a></div></div>", ""]
    pages += pages[:2]
    parsed, seen = [], set()
    for h in pages:
        blocks, children = parse(h, {})
        key = tuple(sorted({hash_text(b.text) for b in blocks if b.prior >= 1} or {hash_text(b.text) for b in blocks}))
        if key not in seen:
            seen.add(key)
            parsed.append((blocks, children))
    entropy = lambda ns, m: -sum(n / sum(ns) * np.log(n / sum(ns)) for n in ns) / np.log(max(m, 2))
    leaves, layouts, below, words = defaultdict(Counter), defaultdict(list), defaultdict(set), defaultdict(Counter)
    for k, (blocks, children) in enumerate(parsed):
        inline, nodes, own = defaultdict(list), set(), defaultdict(set)
        for b in blocks:
            leaves[b.leaf][hash_text(b.text), k] += 1
            own[b.leaf] |= {*b.text.split(), *("a " + x for x in b.links)}
            inline[b.leaf] += [*b.inline, "/"]
            below[b.leaf].add(b.leaf)
            nodes |= {b.leaf, *(n.path for n in above(b.node))}
            for n in above(b.node):
                below[n.path].add(b.leaf)
        for p in nodes:
            layouts[p].append((tuple(children.get(p, ())), tuple(inline.get(p, ()))))
        for p, ws in own.items():
            words[p].update(sketch(ws))
    want, text_want = {}, {}
    for p, seen_layouts in layouts.items():
        scores = []
        for leaf in below[p]:
            m, by = len(layouts[leaf]), defaultdict(list)
            scores += [1 - k / m * np.log(k) / np.log(max(m, 2)) for k in words[leaf].values()]
            for (f, _), n in leaves[leaf].items():
                by[f].append(n)
            for f, ns in by.items():
                if len(ns) > 1:
                    text_want[leaf, f] = 1 - len(ns) / m * entropy(ns, m)
        layout = entropy(list(Counter(seen_layouts).values()), len(seen_layouts))
        want[p] = (1 - extraction.GAMMA) * layout + extraction.GAMMA * np.mean(scores)
    nodes, texts = style_tree(spark.createDataFrame([(1, h) for h in pages], "host long, html string"))
    got = {r.path: r.measured for r in nodes.collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    text_got = {(r.path, r.feature): r.importance for r in texts.collect()}
    assert set(text_got) == set(text_want) and all(abs(text_got[k] - text_want[k]) < 1e-9 for k in text_want)


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<div>a" * 30_000, "<b>" * 20_000 + "x" + "</i>" * 20_000, "<p><b>" * 20_000 + "x", "<p><table><tr><td>" + "<div>" * 30_000 + "</p>" * 3_000 + "x", "<ul><li>" * 20_000 + "x", '<p title="' + "x<p" * 20_000])
def test_parser_is_linear(page):
    began, small = time.time(), len(parse(page[: len(page) // 50], {})[0])
    blocks, _ = parse(page, {})
    extraction.tree_rows(page, {})
    assert blocks and small >= 0 and time.time() - began < 5
    assert article(blocks, set(), set()) == blocks


def brute_join(texts, width=5, similarity=0.8):
    sets = {}
    for d, t in texts.items():
        w = (t or "").split()
        sets[d] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = sorted(texts)
    find, join = union_find(len(ids))
    links = Counter()
    for i, a in enumerate(ids):
        for j in range(i):
            x, y = sets[a], sets[ids[j]]
            if x and y and len(x & y) >= similarity * len(x | y):
                links[a] += 1
                links[ids[j]] += 1
                join(i, j)
    return {d: (ids[find(i)], links[d]) for i, d in enumerate(ids)}


def test_jaccard_join(spark):
    rng = random.Random(2)
    texts = {}
    for g in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(150)]
        for k in range(12):
            texts[g * 100 + k] = " ".join(words)
            if k % 3:
                words[rng.randrange(150)] = f"n{g}x{k}"
    texts |= {5000: None, 5001: "", 5002: "a b", 5003: "a b", 5004: "a c", 5005: " ".join(f"v{i}" for i in range(9000))}
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()] + [(None, "a b", 2)], "doc_id long, text string, class_id int")
    out = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs).collect()}
    assert out.pop(None) == (None, 0)
    assert out == brute_join(texts)
    assert jaccard_join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block,columns", [(7, 4096), (512, 16)])
def test_jaccard_blocks(spark, monkeypatch, block, columns):
    import lexloom.llm.jaccard_join as j

    monkeypatch.setattr(j, "BLOCK", block)
    monkeypatch.setattr(j, "COLUMNS", columns)
    base = [f"w{i}" for i in range(120)]
    texts = {k: " ".join([*base[:k], f"z{k}", *base[k:]]) for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs).collect()} == brute_join(texts)


def test_jaccard_repeated_ids(spark):
    base, other = [f"w{i}" for i in range(90)], [f"v{i}" for i in range(90)]
    near = lambda w, k: " ".join([*w[:k], "new", *w[k + 1 :]])
    rows = [(1, " ".join(base)), (1, " ".join(other)), (2, near(base, 0)), (3, near(other, 0)), (4, " ".join(base)), (4, " ".join(base)), (5, "alone with no other like it"), (6, near(other, 89)), (6, None)]
    out = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # Every other row whose set is alike is a link; rows 1, 1 tie the two families together.
    want = [(1, 1, 3), (1, 1, 2), (2, 1, 3), (3, 1, 2), (4, 1, 3), (4, 1, 3), (5, 5, 0), (6, 1, 2), (6, 6, 0)]
    assert out == Counter(want)


def test_jaccard_recall(spark):
    docs = spark.createDataFrame(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect(), "doc_id long, text string")
    want = brute_join({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs).collect()}
    assert sum(n for _, n in got.values()) >= 0.99 * sum(n for _, n in want.values()) > 0
    assert all(got[d][1] <= want[d][1] for d in want)
    assert sum(got[d][0] == want[d][0] for d in want) >= 0.99 * len(want)


def test_shared_sizes():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 120)).astype("<u8") for _ in range(30)]
    left, right = np.arange(20), np.arange(10, 30)
    for near in (np.ones((20, 20), bool), np.eye(20, dtype=bool)):
        got = shared(sets, left, right, near)
        assert all(got[a, b] == len(np.intersect1d(sets[a], sets[10 + b])) for a, b in zip(*np.nonzero(near)))


def test_banding():
    for recall in (0.9, 0.999):
        bands, rows = banding(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall > 1 - (1 - 0.8**rows) ** (bands - 1)
        assert bands * rows <= 100
    assert banding(0.8, 0.999) == (18, 5) and banding(0.5, 0.9)[1] < banding(0.9, 0.9)[1]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, 200)]
    find, join = union_find(300)
    for a, b in edges:
        join(a, b)
    out = components(spark.range(300).withColumnRenamed("id", "doc_id"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.doc_id: r.label for r in out} == {i: find(i) for i in range(300)}


def test_hamming(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64)).astype(float)
    x[50:90] = x[10]
    x[90:120] = x[20] * np.where(rng.random((30, 64)) < 0.03, -1, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0]), (None, x[0].tolist()), (3, x[3].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hamming_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.vec_id))
    bits = x > 0
    for q in range(0, 300, 50):
        d = (bits != bits[q]).sum(1)
        assert got[q] == sorted((int(d[i]), i) for i in range(300) if i != q)[:10]
    assert 500 not in got and len(got) == 6
    assert hamming_top_k(vectors.limit(0), vectors).count() == 0
    assert hamming_top_k(vectors.limit(4), vectors.where("vec_id = 0"), k=10).count() == 3


def test_clashing_columns_and_ties(spark):
    """Columns named like results or helpers change nothing; equal texts and codes tie by id."""
    model = public_tokenizer()
    docs = spark.createDataFrame([(i, "same text " * (1 + i % 2)) for i in range(20)], "doc_id long, text string")
    extra = {n: F.lit("x") for n in ("piece", "start", "length", "sequence_id", "offset", "_rank", "_b", "ids_crc32")}
    rows = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert rows(best_fit_packing(docs.withColumns(extra), model, 16)) == rows(best_fit_packing(docs, model, 16))
    vectors = spark.createDataFrame([(i, [1.0] * 64) for i in range(30)], "vec_id long, embedding array<double>").withColumns({n: F.lit("x") for n in ("code", "query_id", "rank", "distance", "ids", "n", "least")})
    got = [(r["rank"], r.vec_id, r.distance) for r in hamming_top_k(vectors, vectors.where("vec_id = 5"), k=4).orderBy("rank").collect()]
    assert got == [(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 3, 0)]
    links = jaccard_join(docs.withColumns({n: F.lit("x") for n in ("e", "rep", "class_id", "n_links", "f1", "bands")})).collect()
    assert {r.n_links for r in links} == {9} and {r.class_id for r in links} == {0, 1}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        words = ["".join(rng.choice(["an", "er", "th", "on"]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
        if kind == 1:
            words = [w + "$$$" for w in words]
        if kind == 2:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["nastyword", "vileword"])
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mixing(spark, labelled):
    docs, labels = labelled
    out = mixing.mix_to_targets(docs, labels).collect()
    right = 0
    for r in out:
        p = [r.p_clean, r.p_junk, r.p_toxic]
        assert abs(sum(p) - 1) < 1e-9 and min(p) >= 0 and r.rate >= 0 and r.n_tokens == 60
        right += r.doc_id % 2 == 0 and int(np.argmax(p)) == r.doc_id % 3  # held out
    assert right >= 297
    totals = [sum(r.rate * r.n_tokens * r[f"p_{n}"] for r in out) for n in mixing.DOMAINS]
    assert np.allclose(totals, [mixing.TARGETS[n] * 60 * 600 for n in mixing.DOMAINS], rtol=1e-4)
    x = np.ones(600)
    p, n = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in out]), np.full(600, 60.0)
    whole = p.T @ n
    goal = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * n.sum()
    y, t = x, lambda v: p.T @ (v * n)
    for k in range(1, mixing.STEPS):
        moved = np.maximum(0, y - p @ ((t(y) - goal) / whole))
        x, y = moved, moved + (k - 1) / (k + 2) * (moved - x)
        if (abs(t(x) - goal) <= 1e-6 * whole).all():
            break
    assert np.allclose(x, [r.rate for r in out], atol=1e-6)
    assert all(r.gap < 1e-5 for r in out)


def test_mixing_features(spark):
    """Buckets of the features against a plain reading of the text, and posteriors against the model."""
    texts = ["Word word, WORD!! other*** x", None, "", " | ".join(f"a{k}" for k in range(70)), "long " * 50_000, "Über straße\u2028x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = lambda names: {r.f for r in spark.createDataFrame([(x,) for x in names], "x string").select(mixing._bucket(F.col("x")).alias("f")).collect()}
    rows = {r.doc_id: r for r in mixing._features(docs, ["doc_id"]).collect()}
    want = {}
    for i, t in enumerate(texts):
        t = t or ""
        words, gaps = re.split(mixing._NO_WORD, t.lower()), re.split(mixing._LETTERS, t)
        n = sum(w != "" for w in words)
        size = lambda x: math.floor(2 * math.log2(x + 1))
        names = {*words, *(f"\x01{g}" for g in gaps), f"\x02{size(n)}", f"\x03{size((n + 1) / (len(set(words)) + 1))}"}
        assert rows[i].n_tokens == n
        assert len(rows[i]["_f"]) == len(set(rows[i]["_f"])) and set(rows[i]["_f"]) == hashed(names), t[:40]
        want[i] = hashed(names)
    kept = sorted(set.union(*want.values()))[::2]
    rng = np.random.default_rng(0)
    model = mixing.Model([0.5, 0.0, -0.5], kept, rng.normal(size=(len(kept), 3)).tolist())
    for r in mixing.posteriors(docs, model, ["doc_id"]).collect():
        s = np.array(model.intercepts) + sum(np.array(w) for b, w in zip(kept, model.weights) if b in want[r.doc_id])
        p = np.exp(s - s.max())
        p = np.floor(p / p.sum() * mixing.GRAIN + 1e-9) / mixing.GRAIN
        assert np.allclose([r.p_junk, r.p_toxic], p[1:], atol=1e-9) and abs(r.p_clean - (1 - p[1] - p[2])) < 1e-9


def test_mixing_held_out_accuracy(spark):
    """Fitted on half of the labels of sf0.1, judged on the other half."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    known = mixing.labelled_domains(labels)
    model = mixing.fit(docs, known.where("label_id % 2 = 0"))
    rows = mixing.posteriors(docs, model, ["doc_id"]).join(known.where("label_id % 2 = 1"), F.col("doc_id") == F.col("label_id")).collect()
    hits = Counter((r.domain, int(np.argmax([r.p_clean, r.p_junk, r.p_toxic]))) for r in rows)
    n = Counter(r.domain for r in rows)
    assert hits[0, 0] >= 0.98 * n[0] and hits[1, 1] >= 0.95 * n[1] and hits[2, 2] >= 0.8 * n[2], hits


def test_mixing_reports(spark):
    scored = spark.createDataFrame([(10, 1.0, 0.0, 0.0), (10, 0.5, 0.5, 0.0)], "n_tokens long, p_clean double, p_junk double, p_toxic double")
    with pytest.warns(UserWarning, match="not converged"):
        assert not mixing.fit_rates(scored, {"clean": 0.2, "junk": 0.8}, steps=3).converged
    done = mixing.fit_rates(scored, {"clean": 0.5, "junk": 0.5})
    assert done.converged and done.gap < 1e-5


@pytest.mark.parametrize("n_junk", [0, 2])
def test_mixing_few_labels_of_a_domain(spark, n_junk):
    rng = random.Random(n_junk)
    bad = [f"bad{k}" for k in range(10)]
    plain = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(n)]
    kinds = [0] * 900 + [2] * 110 + [1] * n_junk
    texts = [" ".join(plain(60) + ([w for w in bad if rng.random() < 0.31] or bad[:1] if k == 2 else [])) for k in kinds]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kinds)], "doc_id long, quality int, toxic int")
    model = mixing.fit(docs, labels)
    words = {r.f for r in spark.createDataFrame([(w,) for w in bad], "x string").select(mixing._bucket(F.col("x")).alias("f")).collect()}
    assert words <= set(model.buckets)
    out = mixing.mix_to_targets(docs, labels, {"clean": 1.0, "junk": 0.02, "toxic": 0.02}, relative=True).collect()
    wrong = [r.doc_id for r in out if kinds[r.doc_id] != 1 and (r.rate < 0.5) != (kinds[r.doc_id] == 2)]
    assert len(wrong) <= 5


def test_mixing_samples_present_labels(spark, labelled):
    docs, labels = labelled
    gone = spark.range(10_000, 13_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    assert mixing.fit(docs, labels.unionByName(gone.select(*labels.columns)), max_labelled=60) == mixing.fit(docs, labels, max_labelled=60)


def test_mixing_odd_rows(spark, labelled):
    docs, labels = labelled
    odd = docs.limit(20).unionByName(spark.createDataFrame([(None, "x y"), (700, None), (701, ""), (1, "again")], docs.schema)).withColumn("rate", F.lit("z"))
    assert mixing.mix_to_targets(odd, labels).count() == 24
    assert mixing.mix_to_targets(docs.limit(0), labels).count() == 0
    assert {round(r.rate, 6) for r in mixing.mix_to_targets(odd, labels.limit(0), {"clean": 1.0}).collect()} == {1.0}


def test_pipeline(spark, labelled, tmp_path):
    import corpus_pipeline as p

    docs, labels = labelled
    copies = docs.where("doc_id % 3 = 0 and doc_id < 30").withColumn("doc_id", F.col("doc_id") + 10_000)
    full = docs.unionByName(copies).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).select("doc_id", "text", "lang", "source", "n_chars")
    full.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = p.run(spark, str(tmp_path)).collect()
    clean = {i for i in range(600) if i % 3 == 0}
    assert {r.doc_id for r in out} == clean
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, full, str(tmp_path)).columns == full.columns, name
        assert stage(spark, full.limit(0), str(tmp_path)).count() == 0, name


@pytest.fixture(scope="module")
def odd_table(spark, labelled, tmp_path_factory):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and columns named like results."""
    docs, labels = labelled
    folder = tmp_path_factory.mktemp("odd")
    labels.write.parquet(str(folder / "labels.parquet"))
    text = docs.where("doc_id = 0").first().text
    other = docs.where("doc_id = 3").first().text
    odd = [(None, text), (None, None), (900, None), (901, ""), (902, " \n\n "), (903, (other + "\n") * 3000), (0, text), (0, other + " more"), (904, text), (904, "quite another text that nothing else is like in this table of documents " * 2)]
    full = docs.where("doc_id < 120").unionByName(spark.createDataFrame(odd, docs.schema))
    names = ("kept", "score", "n_lines", "kept_text", "class_id", "rate", "n_tokens", "p_clean")
    return full.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), **{n: F.lit("own") for n in names}}), str(folder)


def test_pipeline_odd_rows(spark, odd_table):
    import corpus_pipeline as p

    full, folder = odd_table
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, full, folder)
        assert out.columns == full.columns and out.where("kept <> 'own' or rate <> 'own' or class_id <> 'own'").count() == 0, name
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    every = texts(full)
    kept = texts(p.quality(spark, full, folder))
    assert not kept - every and not any(t is None or len(t.split()) < 50 for _, t in kept)
    assert sum(texts(p.lines(spark, full, folder)).values()) == sum(every.values())
    left = texts(p.near_copies(spark, full, folder))
    assert not left - every
    gone = every - left  # copies of either text of document 0 under other ids, but no row that only shares an id with one
    assert sorted(d for d, _ in gone.elements()) == [3, 903, 904]
    packed = p.packing(spark, full, folder).collect()
    assert len({(r.doc_id, r.piece) for r in packed}) > 0 and sum(r.piece == 0 for r in packed) == sum(every.values())


def test_pipeline_rounding_keeps_totals(spark, monkeypatch):
    import corpus_pipeline as p

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rate = F.when(F.col("doc_id") % 4 == 0, 0.02).when(F.col("doc_id") % 4 == 1, 0.3).when(F.col("doc_id") % 4 == 2, 1.0).otherwise(2.6)
    monkeypatch.setattr(p, "table", lambda *args: None)
    monkeypatch.setattr(p, "mix_to_targets", lambda docs, *args, **more: docs.withColumn("rate", rate))
    got = {r.k: r["count"] for r in p.mixing(spark, docs, "").groupBy((F.col("doc_id") % 4).alias("k")).count().collect()}
    assert got[2] == 5000 and abs(got[0] - 100) < 50 and abs(got[1] - 1500) < 150 and abs(got[3] - 13_000) < 200
    assert p.mixing(spark, docs, "").select("doc_id").exceptAll(p.mixing(spark, docs, "").select("doc_id")).count() == 0
