"""Merging concepts in rounds against the same in order, one after the other."""

import random

import numpy as np
import pytest

from lexloom.operators import topics


def one_by_one(rows, least=0.9):
    """labels that stay, of (label, embedding, terms, generation, pos)."""
    rows = sorted(rows, key=lambda r: r[4])
    x = np.array([r[1] for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    gone = set()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)) if i not in gone else ():
            if j not in gone and round(float(unit[i] @ unit[j]), 9) >= least:
                if len(rows[j][0]) > len(rows[i][0]):
                    gone.add(i)
                    break
                gone.add(j)
    kept, labels, sets = [], set(), []
    for r in sorted((r for i, r in enumerate(rows) if i not in gone), key=lambda r: (r[3], r[4])):
        terms = frozenset(r[2])
        if r[0] not in labels and not any(terms <= s for s in sets):
            labels.add(r[0])
            sets.append(terms)
            kept.append(r[4])
    return kept


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 60, 0.25), (2, 400, 0.2), (3, 150, 0.45)])
def test_rounds_equal_one_by_one(spark, seed, n, spread):
    rng, r = np.random.default_rng(seed), random.Random(seed)
    centres = rng.standard_normal((max(2, n // 8), 6))
    rows = [("l" * r.randint(1, 9) + str(r.randint(0, n)), (centres[r.randrange(len(centres))] + spread * rng.standard_normal(6)).tolist(), r.sample("abcdef", r.randint(0 if i == n // 2 else 1, 4)), r.randint(0, 2), 10 * i) for i in range(n)]
    kind = "label string, embedding array<double>, terms array<string>, generation int, pos long"
    got = topics.merge_and_dedup(spark.createDataFrame(rows, kind).repartition(3))
    assert got.columns == ["label", "embedding", "terms", "generation", "pos"]
    assert sorted(x.pos for x in got.collect()) == sorted(one_by_one(rows))


def test_merging_nothing(spark):
    kind = "label string, embedding array<double>, terms array<string>, generation int, pos long"
    assert topics.merge_and_dedup(spark.createDataFrame([], kind)).collect() == []
    one = [("a", [1.0, 0.0], [], 0, 1), ("b", None, ["x"], 0, 2), ("c", [0.0, 1.0], [], 1, 3)]
    assert sorted(x.label for x in topics.merge_and_dedup(spark.createDataFrame(one, kind)).collect()) == ["a", "b"]


def test_best_senses_equal_all_pairs(spark):
    from lexloom.operators import blocks

    rng = np.random.default_rng(8)
    terms = [(f"t{i}", f"d{s}", rng.standard_normal(5).tolist()) for i in range(40) for s in range(1 + i % 3)] + [("none", "d", None), ("short", "d", [1.0]), ("t1", "a", None)]
    side = [(f"l{k}", rng.standard_normal(5).tolist(), rng.standard_normal(5).tolist()) for k in range(7)] + [("bad", None, [1.0] * 5)]
    kind = "term string, definition string, embedding array<double>"
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {}
    for label, e, c in side[:7]:
        best = {}
        for t, d, v in terms:
            if v is not None and len(v) == 5:
                best[t] = min(best.get(t, (9, "")), (-round(float(unit(v) @ unit(e)), 9), d, round(float(unit(v) @ unit(c)), 9)))
        scored = sorted((-round(lk - s, 9), t, d) for t, (s, d, lk) in best.items())
        want |= {(label, t): (d, -s) for s, t, d in scored[:4] if -s >= 0.1}
    found = blocks.best_senses(spark.createDataFrame(terms, kind).repartition(3), spark.createDataFrame(side, "label string, embedding array<double>, centroid array<double>"), 0.1, 4)
    got = {}
    for label in {r.label for r in found.collect()}:
        for r in sorted(found.where(found.label == label).collect(), key=lambda r: (-r.score, r.term))[:4]:
            got[label, r.term] = (r.definition, r.score)
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_surface_forms_as_a_column(spark):
    from pyspark.sql import functions as F

    from lexloom.functions import legal

    acts = [*legal.ACT_NAMES, "31995L0046", "32016R0679", "62018CJ0311", "none", "32001D0002"]
    rows = [(c, one) for c in acts for one in (True, False)]
    got = spark.createDataFrame(rows, "c string, one boolean").select("c", "one", legal.surface_forms_of(F.col("c"), F.col("one")).alias("f")).collect()
    for r in got:
        assert sorted(r.f) == sorted(legal.surface_forms(r.c, r.one)), r
