"""Line dedup, licence scan, substring dedup and quality rules against brute force, with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from re import _constants, _parser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import substring_dedup as substrings
from lexloom.llm.hashing import raw
from lexloom.llm.license_rules import rules, stems
from lexloom.llm.license_scan import BASE, license_scan
from lexloom.llm.line_dedup import line_dedup
from lexloom.llm.quality import quality_rules, threshold
from lexloom.llm.substring_dedup import substring_dedup

BLANK = " \t\n\x0b\x0c\r"


def odd_docs(spark, clash=""):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(20)) for _ in range(4)]
    rows = [(i, "\n".join(rng.choice(shared).swapcase() if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))), "x") for i in range(40)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "\n\n", "x"), (103, shared[0] * 200, "x"), (5, rows[5][1], "x"), (None, shared[0], "x"), (104, " \u0085  \x1c " + shared[1], None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {clash or 'extra'} string")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_line_dedup(spark):
    docs = odd_docs(spark, "n_lines")
    out = line_dedup(docs)
    assert Counter(out.columns) == Counter(["doc_id", "text", "n_lines", "n_dropped", "kept_text"])
    holders = defaultdict(set)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    key = lambda x: lower(x.strip(BLANK))
    for d, text in rows:
        for x in text.split("\n"):
            if len(key(x)) >= 20 and d is not None:
                holders[key(x)].add(d)
    want = Counter()
    for d, text in rows:
        kept = [x for x in text.split("\n") if not (len(holders[key(x)]) >= 3 and max(holders[key(x)]) != d)]
        want[d, len(text.split("\n")), len(text.split("\n")) - len(kept), "\n".join(kept)] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()) == want
    assert line_dedup(docs.limit(0)).count() == 0


def licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    norm = f" {' '.join(words)} "
    found = [(m.start(), m.end(), r.priority, r.order, r.label, r.confidence) for r in rules() for m in re.finditer(r.pattern, norm)]
    beats = lambda b, a: b is not a and b[0] <= a[0] and b[1] >= a[1] and (b[2] < a[2] or b[2] == a[2] and (b[:2] != a[:2] or b[3] < a[3]))
    kept = [a for a in found if not any(beats(b, a) for b in found) and a[4]]
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {k[4] for k in kept})), max((k[5] for k in kept), default=0.0))


def test_license_scan(spark):
    assert len({r.pattern for r in rules()}) == len(rules()) >= 300
    texts = ["cc by cc by 4.0 CC-BY-NC 4.0", "under the GNU General Public License, version 3.", "SPDX-License-Identifier: MIT License; Apache License, Version 2.0", None, "", "MIT LICENSE mit license " * 50, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "licensed under the Creative Commons Attribution ShareAlike 4.0 licence. All rights reserved", "mit der apache", "This is not licensed under the MIT License.", "driver's license", "SPDX-License-Identifier: Apache-2.0 OR MIT", "https://creativecommons.org/licenses/by-sa/4.0/ and https://opensource.org/licenses/MIT", "KELVİN m\u0130t licen\u017fe G\u004eU GENERAL PUBLIC LICENSE", "all rights reserved " * 3000]
    docs = spark.createDataFrame([(i, x, "c") for i, x in enumerate(texts)] + [(None, texts[0], "c"), (1, texts[1], None)], "doc_id long, text string, labels string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in license_scan(docs).collect()}
    assert got == {**{i: licences(x) for i, x in enumerate(texts)}, None: licences(texts[0])}
    assert license_scan(docs).count() == len(texts) + 2
    assert license_scan(docs.limit(0)).count() == 0


def matching(rng, items):
    """A text that a parsed regex matches; optional and alternative parts are drawn."""
    out = ""
    for op, arg in items:
        if op is _constants.LITERAL:
            out += chr(arg)
        elif op is _constants.IN:
            kind, value = rng.choice(arg)
            out += "q" if kind is _constants.NEGATE else chr(value if kind is _constants.LITERAL else rng.randint(*value))
        elif op is _constants.NOT_LITERAL:
            out += "q"
        elif op is _constants.BRANCH:
            out += matching(rng, rng.choice(arg[1]))
        elif op is _constants.SUBPATTERN:
            out += matching(rng, arg[3])
        elif op is _constants.MAX_REPEAT:
            out += "".join(matching(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
        else:
            assert op is _constants.ASSERT
    return out


def test_license_rules_differ():
    """Each rule finds something that no other rule of its label and kind finds."""
    rng, every = random.Random(6), rules()
    for r in every:
        like = [o for o in every if o is not r and o.label == r.label and o.priority == r.priority]
        texts = [f" {matching(rng, _parser.parse(r.pattern))} " for _ in range(60)]
        assert any(not any(re.search(o.pattern, x) for o in like) for x in texts), r.pattern


def test_license_gate():
    rng = random.Random(5)
    gates = stems(rules())
    for r in rules():
        assert any(s in r.keyword for s in gates)
        tree = _parser.parse(r.pattern)
        for _ in range(100):
            text = f" {matching(rng, tree)} "
            assert re.search(r.pattern, text), (r.pattern, text)
            assert r.keyword in text, (r.keyword, text)


def test_license_scan_gate(spark):
    texts = ["MIT/X11 License", "ASL 2.0", "unless required by applicable law or agreed to in writing", "except in compliance: you may not use this file except in compliance with the licence", "Neither the name of the X may be used to endorse or promote products", "the above copyright notice and this permission notice shall be included in all copies", "this notice may not be removed or altered from any source distribution", "unauthorized copying of this file, via any medium, is strictly prohibited", "either version 2 of the License, or (at your option) any later version"]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: licences(x)[5:] for i, x in enumerate(texts)}
    assert all(label for label, _ in got.values())


def brute_substrings(rows, width):
    rank = lambda d: float("inf") if d is None else d
    rows = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in rows:
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            first[s] = min(first.get(s, rank(d)), rank(d))
    want = Counter()
    for d, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < rank(d):
                gone[k : k + width] = [True] * width
        want[d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    return want


@pytest.mark.parametrize("width,buckets,lot", [(13, None, None), (3, 5, None), (13, 3, 40), (3, 2, 25)])
def test_substring_dedup(spark, monkeypatch, width, buckets, lot):
    if lot:  # many lots, few remembered windows
        monkeypatch.setattr(substrings, "LOT", lot)
        monkeypatch.setattr(substrings, "REMEMBERED", 30)
    docs = odd_docs(spark, "kept_text")
    more = [(None, docs.where("doc_id = 103").first().text), (None, "only here " * 9), (None, "only here " * 9), (7000, "only here " * 9)]
    docs = docs.unionByName(spark.createDataFrame([(d, t, "x") for d, t in more], docs.schema))
    want = brute_substrings([(r.doc_id, r.text) for r in docs.collect()], width)
    out = substring_dedup(docs, width, buckets)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == want
    sums = Counter((r.doc_id, r.kept_sha256) for r in substring_dedup(docs, width, buckets, digest=True).collect())
    assert sums == sum((Counter({(d, hashlib.sha256(k.encode()).hexdigest()): n}) for (d, _, _, k), n in want.items()), Counter())
    assert substring_dedup(docs.limit(0)).count() == 0


def test_substring_dedup_hot_window(spark, monkeypatch):
    """A passage that every document has is one entry a task in its bucket."""
    monkeypatch.setattr(substrings, "LOT", 500)
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(k, f"own {k} {passage} tail {k}") for k in range(2000, 0, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, 13, 4).collect()) == brute_substrings(rows, 13)
    packed = docs.selectExpr("doc_id k", "false n", "text").sortWithinPartitions("k").mapInArrow(substrings._scan(13, 4), "bucket int, kind int, hashes binary, docs binary")
    one = substrings.hashes(*raw(pa.array([passage])), 13)[0]
    entries = [int((substrings._unpack(r.hashes, r.docs)[0] == one[0] & substrings._WIDE).sum()) for r in packed.where("kind = 0").collect()]
    assert sum(entries) <= 4


def test_window_membership():
    one, two = np.array([5, 5, 7, 9], "<u8"), np.array([1, 2, 3, 4], "<u8")
    assert substrings.member(one, two, np.array([5, 5, 9], "<u8"), np.array([2, 3, 4], "<u8")).tolist() == [False, True, False, True]


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = [False] * len(w)
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            hit[k : k + 3] = [True] * 3
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(hit))


def test_quality_rules(spark):
    docs = odd_docs(spark, "score")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules(docs, labels)
    want = Counter()
    for r in docs.collect():
        b = base(r.text)
        want[r.doc_id, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]] += 1
    rows = out.collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules(docs.limit(0), labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality_rules(docs, labels.limit(0)).collect())


def test_quality_separates(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re"]) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word() + ("$$$" if i % 3 == 0 else "") for _ in range(80))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = {r.doc_id for r in quality_rules(docs, labels).where("kept").collect()}
    assert kept == {i for i in range(300) if i % 3}


def test_quality_scores_against_brute_force(spark):
    """Scores from plainly counted 4-grams, and the verdicts that follow from them."""
    import math

    from lexloom.llm import quality

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "rain", "sun", "ab", "x"]) + ("#" * rng.randint(0, 2) if i % 4 == 0 else "") + str(rng.randrange(40)) for _ in range(70))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    half = {r._l: r.h for r in labels.select(F.col("doc_id").alias("_l"), F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)).alias("h")).collect()}

    def grams(text):
        data = text.encode()
        return quality.grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()

    raw_counts, good = Counter(), Counter()
    for i, text in rows:
        raw_counts.update(grams(text))
        if i in half and i % 4 and half[i] == 0:
            good.update(grams(text))
    llr = lambda b: math.log((good[b] + 1) / (good.total() + quality.BUCKETS)) - math.log((raw_counts[b] + 1) / (raw_counts.total() + quality.BUCKETS))
    score = {i: sum(map(llr, grams(text))) / len(grams(text)) for i, text in rows}
    out = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert all(abs(out[i].score - score[i]) < 1e-9 for i in score)
    failed = {i: base(text)[0] < 50 or 100 * base(text)[4] > 50 * base(text)[0] for i, text in rows}
    bins = Counter((math.floor(score[i] / 0.005), int(i % 4 != 0)) for i in half if not failed[i] and not (i % 4 and half[i] == 0))
    bound = threshold([(b, q, n) for (b, q), n in bins.items()]) * 0.005
    assert all(out[i].kept == (not failed[i] and score[i] >= bound) for i in score)
    assert len({len(grams(t)) for _, t in rows}) > 1 and {True, False} == {r.kept for r in out.values()}


def test_threshold():
    assert threshold([]) < -1e8 and threshold([(3, 1, 5)]) < -1e8
    assert -10 < threshold([(-10, 0, 5), (2, 1, 9)]) <= 2
