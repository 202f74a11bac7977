"""Mixing to target weights: soft domains from a labelled table, rates by projected-gradient least squares.

Built-in functions only.  What meets on the driver is the bounded labelled
sample, as numbers of features, and one number a domain and step.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checkpoint, text_of

#: Domains of the labelled table, from its quality and toxic columns.
DOMAINS = ("clean", "junk", "toxic")
#: Labelled rows of each domain that the classifier is fitted on.
MAX_LABELLED = 5_000
#: Hash buckets of the features; those count that some domain has this many standard deviations more often than all.
BUCKETS, LEAST_DEVIATION = 1 << 16, 2.5
#: Weight of the squared weights in the classifier's loss, and its gradient steps.
RIDGE, ROUNDS = 0.1, 200
#: Posteriors are whole multiples of one over this; what is less goes to the first domain.
GRAIN = 1000
TARGETS: Mapping[str, float] = {"clean": 0.96, "junk": 0.02, "toxic": 0.02}
#: Steps after which an unfinished fit of the rates is reported.
STEPS = 300
_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Positive classes of single bytes alone: Java tests these by one lookup a character, others by trying range after range.
_LETTERS = r"[0-9A-Za-z]+"


class Model(NamedTuple):
    """Intercepts, the features' buckets and their weights, a row each, one column a domain."""

    intercepts: list[float]
    buckets: list[int]
    weights: list[list[float]]


def labelled_domains(labels: DataFrame) -> DataFrame:
    """label_id and domain (number in DOMAINS): junk is quality 0, toxic is toxic 1 of quality 1."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return known.select("label_id", F.when(F.col("q") == 0, 1).when(F.col("t") == 1, 2).otherwise(0).alias("domain"))


def _bucket(feature: Column) -> Column:
    return F.pmod(F.xxhash64(feature), F.lit(BUCKETS)).cast("int")


def _features(docs: DataFrame, carry: list[str], known: Column | None = None) -> DataFrame:
    """carry, n_tokens and _f, the distinct buckets of each text's features (those at which `known` is positive).

    Features are its lower-case words, what stands between ASCII letters and
    digits (marks, gaps, other letters), and the orders of magnitude of its
    length and of how often it repeats its words; n_tokens are its words.
    """
    text = text_of("text")
    words, gaps = F.split(F.lower(text), _NO_WORD, -1), F.split(text, _LETTERS, -1)
    parts = docs.select(*carry, F.inline(F.array(F.struct(F.transform(words, _bucket).alias("_w"), F.transform(gaps, lambda m: _bucket(F.concat(F.lit("\x01"), m))).alias("_m")))))
    # Before the first word and after the last one the split has an empty string each if a gap stands there.
    empty = _bucket(F.lit(""))
    edge = lambda c: (c == empty).cast("int")
    n = F.size("_w")
    count = n - edge(F.get("_w", F.lit(0))) - F.when(n > 1, edge(F.get("_w", n - 1))).otherwise(0)
    hashed = parts.select(*carry, count.alias("_n"), "_m", F.inline(F.array(F.struct(F.array_distinct("_w").alias("_w")))))
    scale = lambda x: F.floor(2 * F.log2(x + 1)).cast("string")
    more = (F.concat(F.lit("\x02"), scale(F.col("_n").cast("double"))), F.concat(F.lit("\x03"), scale((F.col("_n") + 1) / (F.size("_w") + 1))))
    every = F.concat("_w", "_m", F.array(*(_bucket(x) for x in more)))
    if known is not None:
        every = F.filter(every, lambda f: F.get(known, f) > 0)
    return hashed.select(*carry, F.col("_n").cast("long").alias("n_tokens"), F.array_distinct(every).alias("_f"))


def logistic(rows: np.ndarray, columns: np.ndarray, domain: np.ndarray, width: int, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and weights of a multinomial logistic regression on sparse binary features, by AdaGrad."""
    n = len(domain)
    want = np.eye(domains)[domain]
    weights, intercepts = np.zeros((width, domains)), np.log(np.maximum(want.mean(0), 1e-9))
    past, past_i = np.full((width, domains), 1e-8), np.full(domains, 1e-8)
    for _ in range(ROUNDS):
        scores = np.stack([np.bincount(rows, weights[columns, k], n) for k in range(domains)], 1) + intercepts
        p = np.exp(scores - scores.max(1, keepdims=True))
        off = p / p.sum(1, keepdims=True) - want
        slope = np.stack([np.bincount(columns, off[rows, k], width) for k in range(domains)], 1) + RIDGE * weights
        slope_i = off.sum(0)
        past, past_i = past + slope**2, past_i + slope_i**2
        weights, intercepts = weights - 0.5 * slope / np.sqrt(past), intercepts - 0.5 * slope_i / np.sqrt(past_i)
    return intercepts, weights


def fit(docs: DataFrame, labels: DataFrame, domains: int = len(DOMAINS), max_labelled: int = MAX_LABELLED) -> Model:
    """A multinomial logistic regression on hashed features.

    Fitted on at most `max_labelled` labelled texts of each domain, the first
    by a hash of their id among those that docs still has; intercepts are set
    for the shares of all labels.  Features whose domain shares could be
    chance are left out (LEAST_DEVIATION): the rare words of a corpus, taken
    together, would drown what tells domains apart.
    """
    known = labelled_domains(labels) if "domain" not in labels.columns else labels
    known = checkpoint(known.join(docs.select(F.col("doc_id").alias("_d")), F.col("label_id") == F.col("_d"), "left_semi"))
    totals = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = [totals.get(k, 0) / max(1, sum(totals.values())) for k in range(domains)]
    priors = [math.log(s) if s else -1e9 for s in share]
    if sum(s > 0 for s in share) < 2:
        return Model(priors, [], [])
    order = [F.xxhash64("label_id"), F.col("label_id")]
    parts = [known.where(F.col("domain") == k).orderBy(*order).limit(max_labelled) for k in range(domains)]
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.unionByName(p)
    # At most domains x max_labelled rows of two numbers.
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    seen = checkpoint(_features(joined, ["domain"]).select("domain", "_f"))
    size = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = sum(size.values())
    counts = seen.select("domain", F.explode("_f").alias("f")).groupBy("f").agg(*(F.sum(F.when(F.col("domain") == k, 1).otherwise(0)).alias(f"c{k}") for k in range(domains)))
    total = sum((F.col(f"c{k}") for k in range(1, domains)), F.col("c0"))
    deviations = [(F.col(f"c{k}") - total * (size.get(k, 0) / every)) / F.sqrt(total * (size.get(k, 0) / every) + 1) for k in range(domains)]
    kept = sorted(r["f"] for r in counts.where(F.greatest(*deviations) >= LEAST_DEVIATION).select("f").collect())
    if not kept:
        return Model(priors, [], [])
    places = _places(kept)
    rows = seen.select("domain", F.array_join(F.transform(F.filter("_f", lambda f: F.get(places, f) > 0), lambda f: (F.get(places, f) - 1).cast("string")), " ").alias("f")).collect()
    columns = [np.array(r["f"].split(), np.int64) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
    intercepts, weights = logistic(owner, np.concatenate(columns), np.array([r["domain"] for r in rows]), len(kept), domains)
    drawn = [math.log(size.get(k, 0) / every) if size.get(k) else 0.0 for k in range(domains)]
    return Model([float(b) + p - d if size.get(k) else -1e9 for k, (b, p, d) in enumerate(zip(intercepts, priors, drawn))], kept, weights.tolist())


def _literal(values: list, kind: str) -> Column:
    """An array that Spark folds into one constant, instead of an expression an element."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _places(buckets: list[int]) -> Column:
    """For each bucket its place among the kept ones from 1, or 0."""
    at = [0] * BUCKETS
    for k, b in enumerate(buckets, 1):
        at[b] = k
    return _literal(at, "int")


def posteriors(docs: DataFrame, model: Model, carry: list[str], names: tuple[str, ...] = DOMAINS) -> DataFrame:
    """carry, n_tokens and p_<domain> of every document: one pass, nothing shuffled."""
    if model.buckets:
        places = _places(model.buckets)
        rows = _features(docs, carry, places)
        tables = [_literal([0.0, *(w[k] for w in model.weights)], "double") for k in range(len(names))]
        total = lambda b, table: F.aggregate("_f", F.lit(float(b)), lambda acc, f: acc + F.get(table, F.get(places, f)))
        scores = [total(b, table) for b, table in zip(model.intercepts, tables)]
    else:
        rows = _features(docs, carry).select(*carry, "n_tokens")
        scores = [F.lit(float(b)) for b in model.intercepts]
    rows = rows.select(*carry, "n_tokens", F.inline(F.array(F.struct(*(s.alias(f"_s{k}") for k, s in enumerate(scores))))))
    top = F.greatest(*(F.col(f"_s{k}") for k in range(len(names))))
    rows = rows.select(*carry, "n_tokens", *(F.exp(F.col(f"_s{k}") - top).alias(f"_e{k}") for k in range(len(names))))
    whole = sum((F.col(f"_e{k}") for k in range(1, len(names))), F.col("_e0"))
    grains = [F.floor(F.col(f"_e{k}") / whole * GRAIN).cast("int") for k in range(1, len(names))]
    rows = rows.select(*carry, "n_tokens", *(g.alias(f"_g{k}") for k, g in enumerate(grains, 1)))
    first = F.lit(GRAIN) - sum((F.col(f"_g{k}") for k in range(2, len(names))), F.col("_g1"))
    # One exploded struct, so that what later filters or folds over the posteriors doesn't compute them again.
    parts = F.struct("n_tokens", *((g / F.lit(float(GRAIN))).alias(f"p_{n}") for n, g in zip(names, [first, *(F.col(f"_g{k}") for k in range(1, len(names)))])))
    return rows.select(*carry, F.inline(F.array(parts)))


def _rate(history: list[list[float]], names: tuple[str, ...]) -> Column:
    """The rate after all steps (push, residuals), from 1, as one expression: see fit_rates."""
    if not history:
        return F.lit(1.0)
    p = [F.col(f"p_{n}") for n in names]
    move = lambda s: sum((p[k] * F.get(s, F.lit(k + 1)) for k in range(1, len(p))), p[0] * F.get(s, F.lit(1)))

    def step(at: Column, s: Column) -> Column:
        x = F.greatest(F.lit(0.0), at["y"] - move(s))
        return F.struct(x.alias("x"), (x + F.get(s, F.lit(0)) * (x - at["x"])).alias("y"))

    return F.aggregate(_literal(history, "array<double>"), F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")), step, lambda at: at["x"])


class Fit(NamedTuple):
    """The steps (push and residuals), the domain token totals reached, their targets, and whether the fit ended by itself."""

    history: list[list[float]]
    totals: list[float]
    targets: list[float]
    converged: bool

    @property
    def gap(self) -> float:
        """The largest distance of a total from its target, as a share of all tokens wanted."""
        return max((abs(t - g) for t, g in zip(self.totals, self.targets)), default=0.0) / max(sum(self.targets), 1e-9)


def fit_rates(scored: DataFrame, targets: Mapping[str, float], names: tuple[str, ...] = DOMAINS, budget: float | None = None, steps: int = STEPS, tolerance: float = 1e-6) -> Fit:
    """Rates of the documents, as steps.

    Minimises, over nonnegative document rates x, the sum over domains k of
    (T_k(x) - t_k)^2 / W_k, with T_k(x) = sum_d x_d n_tokens_d p_dk, W_k = T_k(1)
    and t_k = targets[k] x budget (all tokens unless given), by projected
    gradient from x = 1 in the metric of document lengths, with Nesterov's push:
    a step is x_d <- max(0, y_d - eta sum_k p_dk (T_k(y) - t_k) / W_k), and y
    the new x pushed on along its last move.  As sum_k p_dk = 1, the scaled
    Hessian's norm is at most 1, and eta = 1 is safe; T(y) follows from T(x).

    A rate depends on the posteriors alone, and these are multiples of 1 /
    GRAIN: documents of equal ones are summed once to a checkpointed table of
    cells, whose size is bounded whatever the corpus's, and a step is an
    aggregate of the cells.  The fit ends at its targets, or where a step moves
    no total by more than a tenth of `tolerance` of all tokens wanted (then no
    nonnegative rates do better); if neither comes within `steps`, it warns.
    """
    cells = checkpoint(scored.groupBy(*(f"p_{n}" for n in names)).agg(F.sum("n_tokens").cast("double").alias("n_tokens")))
    totals = lambda rate: [float(x) for x in cells.agg(*(F.coalesce(F.sum(rate * F.col("n_tokens") * F.col(f"p_{n}")), F.lit(0.0)) for n in names)).first()]
    now = whole = totals(F.lit(1.0))
    every = sum(whole) if budget is None else float(budget)
    goal = [targets.get(n, 0.0) * every for n in names]
    history: list[list[float]] = []
    pushed, last, converged = whole, whole, False
    for t in range(1, steps + 2):
        converged = all(abs(x - g) <= tolerance * max(w, 1e-9) for x, g, w in zip(now, goal, whole)) or t > 1 and max(abs(x - y) for x, y in zip(now, last)) <= tolerance / 10 * sum(goal)
        if converged or t > steps:
            break
        push = (t - 1) / (t + 2)
        history.append([push, *((y - g) / w if w > 0 else 0.0 for y, g, w in zip(pushed, goal, whole))])
        last, now = now, totals(_rate(history, names))
        pushed = [x + push * (x - y) for x, y in zip(now, last)]
    done = Fit(history, now, goal, converged)
    if not converged:
        warnings.warn(f"rates not converged after {len(history)} steps: {done.gap:.2e} of the tokens wanted are off target", stacklevel=2)
    return done


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, carry: tuple[str, ...] = ("doc_id",), relative: bool = False) -> DataFrame:
    """The `carry` columns, n_tokens, p_clean, p_junk, p_toxic (posteriors), rate (>= 0) and gap.

    The rate is how often a document is to be taken for the expected token
    totals of the domains to stand in the `targets` shares of all tokens.  With
    `relative`, targets are multiples: the totals wanted are those of a corpus
    that takes each document as often as the target of its likeliest domain
    says, so that what is uncertain of clean documents asks for none of them to
    go.  gap, the same on all rows, tells how far the fit stayed from its
    targets, as a share of the tokens wanted.

    A null or empty text has no tokens (its rate follows from its posterior all
    the same); very long texts are read whole; a null id is never labelled;
    repeated rows are mixed each on its own; texts of equal features tie, with
    equal rates; an id labelled twice counts as its worse label.  Without
    labels of two domains the posteriors are the priors.  An empty table gives
    an empty one; columns of docs named like results are replaced.

    One pass over the texts makes a checkpointed table of numbers, which is
    summed to the cells that the fit works on.  If texts are carried, a second
    pass gives each row its rate, so that no text is checkpointed or joined.
    """
    made = ("n_tokens", "rate", "gap", *(f"p_{n}" for n in DOMAINS))
    model = fit(docs, labels)
    carried = [c for c in carry if c not in made]
    scored = checkpoint(posteriors(docs, model, [] if "text" in carried else carried))
    goal, budget = dict(targets), None
    if relative:
        p = [F.col(f"p_{n}") for n in DOMAINS]
        times = F.coalesce(*(F.when(c >= F.greatest(*p), F.lit(float(targets.get(n, 1.0)))) for c, n in zip(p, DOMAINS)))
        own = scored.agg(*(F.coalesce(F.sum(times * F.col("n_tokens") * c), F.lit(0.0)).alias(n) for c, n in zip(p, DOMAINS))).first()
        goal, budget = own.asDict(), 1.0
    done = fit_rates(scored, goal, budget=budget)
    rows = posteriors(docs, model, carried) if "text" in carried else scored
    return rows.withColumns({"rate": _rate(done.history, DOMAINS), "gap": F.lit(done.gap)})
