"""Mixing documents to target domain weights by soft membership; DataFrame functions only.

A multinomial naive Bayes classifier over hashed words, trained on the labelled table, gives every document a posterior
over the domains. Rates r_i >= ``least`` are then fitted so that the expected domain totals sum_i r_i n_i p_ik meet the
targets, by projected-gradient least squares: residuals are weighted by the inverse of G = sum_i n_i p_i p_i^T, and
the gradient is taken in the metric of the token counts, for which the step 1 is safe. The state of the
iteration is one K-vector per step, so a document's rate is an expression of its own posterior; each step is one
aggregation of K sums over the scored table, which is the only thing that is stored.

The classifier's sample is bounded by ``train_rows`` labelled documents (smallest hash of the id first); the tables that
reach the driver are ``buckets`` x K counts, K x K sums and K-vectors.

Defined cases: null or wordless texts have the prior as posterior, no tokens and the rate they start with; null ids pass
through; rows whose label is null, and labels without a document, are not trained on; a domain without tokens
cannot be met and keeps its shortfall (the other domains are still fitted); without any labelled document there is one
domain, "all"; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, free_name, stored, text_bytes

BUCKETS = 8192
TRAIN_ROWS = 20_000
#: Words that a text counts for at most when likelihoods are summed: keeps memberships soft.
WEIGHT_WORDS = 32


def _words(text: Column) -> Column:
    spaced = F.translate(text_bytes(text), WHITE, " " * len(WHITE))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _bucket(word: Column, buckets: int) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(buckets - 1)).cast("int")


def _total(words: Column, values: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.get(values, w))


@dataclass
class Classifier:
    """Log prior and, per bucket, log likelihood of each domain."""

    domains: list[str]
    prior: list[float]
    table: list[list[float]]

    @property
    def buckets(self) -> int:
        return len(self.table[0]) if self.table else BUCKETS

    def posteriors(self, words: Column, n: Column) -> list[Column]:
        """Posterior of each domain; ``words`` are hashed words (ints), ``n`` their number."""
        if len(self.domains) == 1:
            return [F.lit(1.0)]
        share = F.lit(float(WEIGHT_WORDS)) / F.greatest(n, F.lit(WEIGHT_WORDS)).cast("double")
        score = []
        for prior, row in zip(self.prior, self.table):
            # one string literal that is folded once, not thousands of literals
            values = F.split(F.lit(",".join(map(repr, row))), ",").cast("array<double>")
            score.append(F.lit(prior) + share * _total(words, values))
        return score


def train(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, train_rows: int = TRAIN_ROWS) -> Classifier:
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(label).cast("string").alias("domain")).distinct()
    sample = known.orderBy(F.xxhash64("id"), "id", "domain").limit(train_rows)
    rows = docs.select(F.col(id).alias("id"), _words(F.col(text)).alias("words")).join(F.broadcast(sample), "id")
    counts = rows.select("domain", F.explode("words").alias("w")).groupBy("domain", _bucket(F.col("w"), buckets).alias("b")).count().collect()
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(sizes)
    if len(domains) < 2:
        return Classifier(domains or ["all"], [0.0], [])
    table = np.full((len(domains), buckets), 0.5)
    for r in counts:
        table[domains.index(r["domain"]), r["b"]] += r["count"]
    table = np.log(table / table.sum(axis=1, keepdims=True))
    table -= table.mean(axis=0)
    total = sum(sizes.values())
    return Classifier(domains, [math.log(sizes[d] / total) for d in domains], table.round(6).tolist())


def scored(docs: DataFrame, model: Classifier, text: str, tokens: str, posterior: list[str]) -> DataFrame:
    """``docs`` with the number of tokens and a posterior column for each domain."""
    words, raw = free_name([*docs.columns, tokens, *posterior], "words"), [free_name([*docs.columns, tokens, *posterior], f"raw{i}") for i in range(len(posterior))]
    out = docs.withColumn(words, F.transform(_words(F.col(text)), lambda w: _bucket(w, model.buckets)))
    out = out.withColumn(tokens, F.size(words).cast("long"))
    if len(posterior) == 1:
        return out.withColumn(posterior[0], F.lit(1.0)).drop(words)
    out = out.withColumns(dict(zip(raw, model.posteriors(F.col(words), F.col(tokens))))).drop(words)
    top = F.greatest(*raw)
    out = out.withColumns({p: F.exp(F.col(r) - top) for p, r in zip(posterior, raw)}).drop(*raw)
    whole = sum((F.col(p) for p in posterior[1:]), F.col(posterior[0]))
    return out.select(*[c for c in out.columns if c not in posterior], *[(F.col(p) / whole).alias(p) for p in posterior])


def _rate(posterior: list[str], steps: list[np.ndarray], start: Column, least: float) -> Column:
    rate = start
    for step in steps:
        move = sum((F.col(p) * float(d) for p, d in zip(posterior[1:], step[1:])), F.col(posterior[0]) * float(step[0]))
        rate = F.greatest(F.lit(float(least)), rate - move)
    return rate


def fit(table: DataFrame, tokens: str, posterior: list[str], weights: list[float], least: float = 0.0, total: float | None = None, iterations: int = 24, tolerance: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps of the projected gradient, the totals that they reach, and the targets.

    ``total`` is the number of tokens wanted; without one it is the corpus's own, or, if rates have a lower bound, the
    smallest with which no domain has to give up tokens.
    """
    k = len(posterior)
    n = F.col(tokens).cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = table.agg(*[F.sum(n * F.col(p)).alias(f"s{i}") for i, p in enumerate(posterior)], *[F.sum(n * F.col(posterior[i]) * F.col(posterior[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    have = np.array([first[f"s{i}"] or 0.0 for i in range(k)])
    gram = np.zeros((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = first[f"g{i}_{j}"] or 0.0
    share = np.array(weights, float) / sum(weights)
    if total is None:
        total = have.sum() if not least else max((h * least / s for h, s in zip(have, share) if s > 0), default=0.0)
    goal, inverse = share * total, np.linalg.pinv(gram, rcond=1e-9)
    steps: list[np.ndarray] = []
    reach = have * max(1.0, least)
    for _ in range(iterations):
        if np.abs(reach - goal).sum() <= tolerance * max(total, 1.0):
            break
        steps.append(inverse @ (reach - goal))
        rate = _rate(posterior, steps, F.lit(max(1.0, least)), least)
        row = table.agg(*[F.sum(rate * n * F.col(p)).alias(f"s{i}") for i, p in enumerate(posterior)]).first()
        reach = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
    return steps, reach, goal


def mix(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    weights: dict[str, float] | None = None,
    id: str = "doc_id",
    text: str = "text",
    least: float = 0.0,
    carry: bool = False,
) -> tuple[DataFrame, dict]:
    """Documents with n_tokens, a posterior ``p_<domain>`` each, ``rate`` and ``copies`` (the rate, rounded up with
    the probability of its fraction by a hash of the id), and a report. ``carry`` keeps the columns of ``docs``.

    ``weights``: target share of expected tokens by domain; a domain without one has its share in the corpus's labels.
    """
    model = train(docs, labels, label, id, text)
    names = [free_name(docs.columns, f"p_{d}") for d in model.domains]
    tokens, rate, copies = (free_name(docs.columns, x) for x in ("n_tokens", "rate", "copies"))
    table = scored(docs, model, text, tokens, names)
    table = stored(table if carry else table.select(id, tokens, *names), "mixing")
    shares = [max(0.0, (weights or {}).get(d, math.exp(p))) for d, p in zip(model.domains, model.prior)]
    if not sum(shares):
        shares = [1.0] * len(shares)
    steps, reach, goal = fit(table, tokens, names, shares, least)
    uniform = F.pmod(F.xxhash64(F.col(id), F.lit("copies")), F.lit(1 << 20)).cast("double") / float(1 << 20)
    out = table.withColumn(rate, _rate(names, steps, F.lit(max(1.0, least)), least)).withColumn(copies, F.floor(F.col(rate) + uniform).cast("int"))
    return out, {"domains": model.domains, "goal": goal.tolist(), "reached": reach.tolist(), "steps": len(steps), "columns": (tokens, names, rate, copies)}
