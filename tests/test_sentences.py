"""Sentence ends learnt from a corpus."""

import math
from collections import Counter

import pytest

from lexloom.operators.sentences import learn, sentences


def corpus():
    bodies = ["The court", "It", "However the parties", "They"]
    out = []
    for k in range(120):
        a, b = bodies[k % 4], bodies[(k + 1) % 4]
        out.append(f"{a} ruled on art. {k} and para. {k % 9} of the act. {b} said the act and its parts met, cf. Case{k % 11} and Dr. Smith again on parts. {a} agreed with Smith.")
    return out


def test_abbreviations_don_t_end_sentences(spark):
    texts = spark.createDataFrame(list(enumerate(corpus())), "id int, text string").repartition(3)
    learnt = learn(texts, "text")
    short = {r.word for r in learnt.words.where("abbreviation").collect()}
    assert {"art", "para", "cf", "dr"} <= short and not short & {"act", "parts", "the", "smith"}
    begins = {r.word for r in learnt.starters.where("starter").collect()}
    assert {"it", "they", "however"} <= begins and "smith" not in begins
    new = spark.createDataFrame([(1, "See art. Seven of it. They met Dr. Smith!  'Why?' (Because.) Done; Next etc. ok"), (2, None), (3, ""), (4, "He wrote to the art. They left."), (5, "word " * 30000 + "End. Next")], "id int, text string")
    got = {r.id: r.sentences for r in sentences(new, "id", "text", learnt).collect()}
    assert got[1] == ["See art. Seven of it.", "They met Dr. Smith!", "'Why?'", "(Because.)", "Done;", "Next etc. ok"]
    assert got[2] == got[3] == [] and got[4] == ["He wrote to the art.", "They left."]
    assert len(got[5]) == 2 and got[5][1] == "Next"


def test_scores_equal_counting_one_by_one(spark):
    rows = corpus()
    n, dots = Counter(), Counter()
    for text in rows:
        for token in text.lower().split():
            word = token[:-1] if token.endswith(".") else token
            if any(c.isalpha() for c in word):
                n[word] += 1
                dots[word] += token.endswith(".")
    p = sum(dots.values()) / (sum(n.values()) + 1)
    want = {}
    for w, c in n.items():
        k = dots[w]
        like = lambda x: k * math.log(x) + (c - k) * math.log(1 - x)  # noqa: B023, E731
        want[w] = -2 * (like(p) - like(0.99)) * math.exp(-len(w)) * len(w) ** -(c - k) if k else 0.0
    got = {r.word: r.score for r in learn(spark.createDataFrame([(t,) for t in rows], "t string"), "t").words.collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([(1, None)], "id int, text string")
    learnt = learn(none, "text")
    assert learnt.words.collect() == learnt.starters.collect() == []
    assert sentences(none, "id", "text", learnt).first().sentences == []


def test_only_the_very_end_of_a_token_counts(spark):
    """A line terminator that is no white space (U+0085, U+2028) is part of its token."""
    texts = spark.createDataFrame([(1, "It ended.\u0085 They met. \u2028They left.")], "id int, text string")
    got = sentences(texts, "id", "text", learn(texts, "text")).first().sentences
    assert got == ["It ended.\u0085 They met. \u2028They left."]
