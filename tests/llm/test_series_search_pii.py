"""Change points, ranked search and personal data against plain versions of themselves."""

import datetime as dt
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import pii, tagger
from lexloom.llm.change_points import best_cuts, change_points
from lexloom.llm.lexical_search import norms, ranked_search, terms_of

# ---- change points ----


def plain_cuts(values, least, penalty):
    """(ends, best cost): every segmentation by recursion over all starts, ties as the contract has them."""

    def cost(i, j):
        n, s, q = j - i, sum(values[i:j]), sum(v * v for v in values[i:j])
        return n * math.floor(1000 * math.log(1 + (n * q - s * s) // (n * n)))

    n = len(values)
    best = {0: (0, 0, [])}
    for j in range(1, n + 1):
        found = [(best[i][0] + cost(i, j) + (penalty if i else 0), best[i][1] + 1, i) for i in best if i < j and (j - i >= least or (n < least and i == 0 and j == n))]
        if found:
            c, k, i = min(found)
            best[j] = (c, k, [*best[i][2], j])
    return best[n][2], best[n][0]


@pytest.mark.parametrize("seed", range(40))
def test_cuts_equal_a_plain_program(seed):
    r = random.Random(seed)
    values = [v for _ in range(r.randint(1, 5)) for v in [r.choice((0, 5, r.randint(0, 900)))] for v in [v + r.randint(0, 1 + r.choice((0, 3, v))) for _ in range(r.randint(1, 40))]]
    least, penalty = r.choice((1, 3, 14)), r.choice((0, 500, 40000))
    ends, _, cost, best = best_cuts(np.array(values), least, penalty)
    assert (ends, best) == plain_cuts(values, least, penalty)
    assert best == cost.sum() + penalty * (len(ends) - 1)


def test_cuts_take_fewest_segments_then_earliest_starts():
    assert best_cuts(np.zeros(60, np.int64), 14, 0)[0] == [60]  # any cut costs the same
    ends = best_cuts(np.array([0] * 20 + [9] * 20), 14, 100)[0]
    assert ends == [20, 40]
    assert best_cuts(np.array([7] * 13), 14, 40000)[0] == [13]


def test_cuts_of_sums_beyond_64_bits_are_exact():
    values = [3_000_000_000 + 1000 * (i % 7) for i in range(40)] + [5_000_000_000 + i for i in range(40)]
    ends, spread, _, best = best_cuts(np.array(values), 14, 40000)
    assert (ends, best) == plain_cuts(values, 14, 40000)
    last = values[ends[-2] :]
    assert spread[-1] == 1 + (len(last) * sum(v * v for v in last) - sum(last) ** 2) // len(last) ** 2


def test_change_points_odd_rows(spark):
    at = lambda d: dt.datetime(2024, 1, 1, 23, 59) + dt.timedelta(days=d)
    rows = [(1, 5, at(0)), (1, 5, at(0)), (1, None, at(1)), (1, 2, None), (1, -3, at(3)), (None, 4, at(2)), (None, 4, at(2)), (2, None, at(1))]
    rows = spark.createDataFrame([(*r, "x", 1) for r in rows], "vendor_id long, quantity int, shipped_at timestamp_ntz, segment_no string, _day int")
    got = {r["vendor_id"]: r for r in change_points(rows).collect()}
    assert set(got) == {1, None}
    assert (got[1]["first_day"], got[1]["n_days"], got[1]["total"], got[1]["n_segments"]) == (19723, 4, 7, 1)
    assert got[1]["spread"] == 1 + (4 * (100 + 9) - 49) // 16
    assert (got[None]["total"], got[None]["spread"], got[None]["cost"]) == (8, 1, 0)
    assert change_points(rows.limit(0)).collect() == []


def test_a_long_series_is_cut_in_blocks(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.poisson(m, 700) for m in (5, 90, 5)])
    ends = best_cuts(values, 14, 40000)[0]
    assert any(abs(e - 700) < 15 for e in ends) and ends[-1] == 2100


# ---- ranked search ----


def plain_ranks(docs, items, k):
    tokens = [(i, re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for i, t in docs]
    n_docs, words = sum(bool(t) for _, t in tokens), sum(len(t) for _, t in tokens)
    df = Counter(t for _, ts in tokens for t in set(ts))
    out = []
    for item, text in items:
        asked = Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
        scored = []
        for i, ts in tokens:
            own, m = Counter(ts), 25 + (75 * len(ts) * n_docs) // max(1, words)
            s = sum(f * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * own[t]) // (1000 * own[t] + 8 * m)) for t, f in asked.items() if own[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_all_scores(spark, seed):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(80)] + ["É", "ß9", "X"]
    weights = [1 / (i + 1) for i in range(len(voc))]
    docs = [(i, r.choice((" ", "-", "\n")).join(r.choices(voc, weights, k=r.randint(0, 40)))) for i in range(400)]
    docs += [(i, docs[i][1]) for i in range(5)] + [(500, None), (501, ""), (502, "--"), (None, "w1 w70 w71"), (503, "w3 " * 30000)]
    items = [(j, " ".join(r.choices(voc, k=r.randint(1, 12)))) for j in range(30)] + [(90, None), (91, "nowhere"), (92, "W3 w3 É"), (92, "w70")]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, term string, score int").repartition(5)
    got = ranked_search(d, spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranks(docs, items, 7)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(x) for x in ranked_search(docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // 1800))]
    assert ranked_search(docs.limit(0), items).collect() == [] and ranked_search(docs, items.limit(0)).collect() == []
    assert terms_of("A-b É_1") == ["a", "b", "É", "1"]
    assert norms(np.array([2**40]), 2**40, 2**41).tolist() == [25 + 75 * 2**39]


# ---- personal data ----

_FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_rules(text):
    out = []
    for o, (kind, form) in enumerate(_FORMS.items()):
        for m in re.finditer(form, text):
            v = m.group()
            digits = [int(c) for c in v if c.isascii() and c.isdigit()]
            doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), o, m.end()))
    return sorted(out)


ODD = [
    "a@b.c.d@e.f x@y @z.w a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3", "4532-0151-1283-0366 4532 0151 1283 0366 45320151128303664 2390409500648960 0-0-0-0-0-0-0-0-0-0-0-0",
    "+1 (377) 555-0271+49.30.1234567 ++1 2 +1(2 +12345678 +123456789-", "٤٥٣ é@ß.de é.a@x-.-y", "x" * 5000 + "@" + "y" * 5000 + ".z", "1 " * 3000 + "." * 100 + "9" * 5000, "%@-.-+1-2-3-4-5-6-7-8-9", "",
]


def test_rules_equal_their_expressions():
    r = random.Random(5)
    some = ["".join(r.choices("1234567890.-@+ ()ab", k=r.randint(0, 60))) for _ in range(3000)]
    for text in ODD + some:
        assert pii.rule_spans(text) == plain_rules(text), text


def passages(n, seed):
    """Prose with one span each, or with none, as labelled passages."""
    r = random.Random(seed)
    words = lambda k: " ".join("".join(r.choices("abdehinorst", k=r.randint(2, 9))) for _ in range(k))
    card = lambda: next(c for c in iter(lambda: str(r.randint(10**15, 10**16 - 1)), None) if pii.luhn(c))
    out = []
    for i in range(n):
        kind = i % 5
        value = (f"{words(1)}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com", ".".join(str(r.randint(1, 255)) for _ in range(4)), card(), f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", f"{r.randint(1, 99)}")[kind]
        left = words(r.randint(0, 14)) + " "
        out.append((left + value + " " + words(r.randint(0, 14)), [] if kind == 4 else [(len(left), kind, len(left) + len(value))]))
    return out


@pytest.fixture(scope="module")
def model():
    return pii.fit(passages(500, 1))


def test_tagger_on_held_out_passages(model):
    x, y = pii.examples(passages(200, 2), seed=77)
    path = tagger.viterbi(model.parameters, tagger.emissions(model.parameters, x))
    assert (path == y).mean() > 0.97
    some = y > 0
    assert (path[some] == y[some]).mean() > 0.85  # half of them respelt or cut by an edge


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 20, (3, 7)).astype(np.uint8), rng.integers(0, 3, (3, 7))
    p = {k: v.astype(np.float64) for k, v in tagger.train(x, y, 3, hidden=4, epochs=1).items()}
    _, g = tagger._gradients(p, x, y)
    for name in p:
        at = tuple(int(rng.integers(0, s)) for s in p[name].shape) if name != "wx" else (0, int(x[0, 3]), 2)
        loss = []
        for step in (1e-3, -1e-3):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            loss.append(tagger._gradients(q, x, y)[0])
        assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(float(g[name][at]), abs=2e-3), name


def added(model, text):
    base = pii.rule_spans(text)
    return [(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans(model, [text], [base])[0]]


def test_tagger_adds_what_rules_dont_spell(model):
    assert ("phone", "(377) 555-0271") in added(model, "please call (377) 555-0271 in the morning")
    assert ("card", "4532/0151/1283/0366") in added(model, "the card 4532/0151/1283/0366 is lost")
    assert ("ip", "97[.]51[.]17[.]173") in added(model, "the host 97[.]51[.]17[.]173 is down")
    for clean in ("born on 2024-01-05 at 10:33, see chapter 1.2.3 and Regulation (EU) 2016/679, OJ L 119", "key = \"908038b7daaf91e730d2f64001c52934d43d9336\"", "in 1999 and 2001 [12] (34)", "4 8 15 16 23 42 108"):
        assert added(model, clean) == []


def test_windows_are_reconciled_over_the_whole_text(model):
    one = "please call (377) 555-0271 in the morning "
    for shift in range(0, 96, 7):
        text = "abc de " * (shift // 7) + "x" * (shift % 7) + " " + one * 4 + "so it ends " * 30 + one
        got = added(model, text)
        assert [v for _, v in got].count("(377) 555-0271") >= 3 and len(got) <= 5
    base = [(0, pii.PHONE, 5)]
    found = [(10, 3, 24, 9.0, True), (8, 3, 24, 5.0, False), (2, 3, 20, 50.0, False)]
    text = "+1 22 x " + "(377) 555-0271".rjust(16) + " "
    assert pii.reconcile(text, found, base, 1.0) == [(10, 3, 24)]  # the longer one meets a rule's span
    text = "seeing x: (377) 555-0271, so"
    assert pii.reconcile(text, [(10, 3, 18, 3.0, True), (15, 3, 24, 4.0, True)], [], 1.0) == [(10, 3, 24)]


def test_windows_without_a_trigger_are_the_only_ones_left_out():
    text = "a" * 500 + "7" + "b" * 500
    starts = pii.window_starts(tagger.classes(tagger.code_points(text)))
    assert starts.tolist() == [432, 480] and all(s <= 500 < s + pii.WIDTH for s in starts)


def test_scan_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "x.1@y.zz"), (3, "é +1 (377) 555-0271"), (3, "é +1 (377) 555-0271"), (4, "plain words " * 40000 + "1.2.3.4")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    got = [tuple(x) for x in pii.pii_scan(docs, labelled=passages(40, 3)).collect()]
    none = hashlib.sha256(b"").hexdigest()
    assert (1, 0, 0, 0, 0, none, "", 0) in got and (2, 0, 0, 0, 0, none, "", 0) in got
    assert [g for g in got if g[0] is None][0][1] == 1
    assert [g[5:7] for g in got if g[0] == 3] == [(hashlib.sha256(b"phone:2:19").hexdigest(), "phone:2:19")] * 2
    assert [g[6] for g in got if g[0] == 4] == [f"ip:{12 * 40000}:{12 * 40000 + 7}"]
    assert pii.pii_scan(docs.limit(0)).collect() == []
    assert pii.fit([("nothing here", [])]) is None


def test_labels_are_the_least_of_all_documents(spark):
    texts = [f"so ann.{i}@mail.example.com wrote {i} times" for i in range(300)] * 2
    few = pii.labelled_by_rules(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7), most=20)
    again = pii.labelled_by_rules(spark.createDataFrame([(t,) for t in reversed(texts)], "text string").repartition(3), most=20)
    assert few == again and sum(bool(s) for _, s in few) >= 20 and len(few) <= 40
