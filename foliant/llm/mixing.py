"""Mixing sources to target weights with soft membership.

1. A labelled table (doc_id, domain) trains a classifier of domains: multinomial naive Bayes over the
   shares of tell-tale characters.  It gives every document posteriors over the domains, softened by
   counting each document as ``strength`` characters.
2. Nonnegative document rates are fitted by projected gradient so that the expected tokens of each
   domain, sum of rate * tokens * posterior, meet the target weights.  Each step is one aggregation
   that brings one number a domain to the driver; the rates are an expression of the posteriors and
   of the steps so far, so that no state is kept between the jobs.

The least squares weigh a domain's miss by one over its tokens at rate 1 and a document's rate by its
tokens; then steps of length 1 cannot overshoot.  Targets are scaled to ``total`` tokens; by default
to the least total at which no domain needs rates below 1, so that nothing is thrown away.

Null and empty texts have no tokens, posteriors equal to the prior and keep a rate like any other.
Repeated rows count each time.  A null doc_id has a rate too.  Targets of domains that no labelled
document has are left out and the others scaled up; without any labelled document, or any target,
every rate is 1.  Texts of any length are counted whole.  An empty table gives an empty result.  Columns named like the results are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import WORD, documents, table, text_of

#: Characters whose shares tell domains apart; all others are counted together.
TELLING = "aehikowyzqjxéèêàçùäöüßñóíáú"


def _features(docs: DataFrame, telling: str) -> DataFrame:
    """``row`` (the columns of ``docs``), ``n_tokens`` and ``counts``, an array of the numbers of each
    telling character and of all others."""
    text = text_of().cast("string")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(row.alias("row"), F.size(words).cast("long").alias("n_tokens"), F.length(text).alias("n"), F.regexp_replace(text, f"[^{telling}]+", "").alias("told"))
    counts = [F.length("told") - F.length(F.replace(F.col("told"), F.lit(c))) for c in telling]
    return base.select("row", "n_tokens", F.array(*counts, F.col("n") - F.length("told")).alias("counts"))


@dataclass
class Domains:
    """The classifier: for each domain the log of its prior and of the share of each character."""

    names: list[str]
    prior: list[float]
    logs: list[list[float]]
    strength: float

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``posterior array<double>`` in the order of the domains instead of ``counts``."""
        if not self.names:
            return rows.withColumn("posterior", F.array().cast("array<double>")).drop("counts")
        c = [F.col("counts")[k] for k in range(len(self.logs[0]))]
        size = reduce(lambda a, b: a + b, c).cast("double")
        weight = F.lit(float(self.strength)) / F.greatest(size, F.lit(float(self.strength)))
        scores = [F.lit(p) + weight * reduce(lambda a, b: a + b, (x * F.lit(v) for x, v in zip(c, logs))) for p, logs in zip(self.prior, self.logs)]
        scored = rows.select(*[x for x in rows.columns if x != "counts"], F.array(*scores).alias("scores"))
        odds = scored.withColumn("odds", F.transform("scores", lambda x: F.exp(x - F.array_max("scores")))).drop("scores")
        return odds.withColumn("posterior", F.transform("odds", lambda x: x / F.aggregate("odds", F.lit(0.0), lambda a, y: a + y))).drop("odds")


def train_domains(features: DataFrame, known: DataFrame, strength: float) -> Domains:
    """``features``: ``doc_id, counts``; ``known``: ``doc_id, domain``."""
    rows = features.join(known, "doc_id").select("domain", "doc_id", F.posexplode("counts").alias("at", "n")).groupBy("domain", "at").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).orderBy("domain", "at").collect()
    names = sorted({r["domain"] for r in rows})
    seen = {d: [r["n"] + 1 for r in rows if r["domain"] == d] for d in names}
    docs = {r["domain"]: r["docs"] for r in rows}
    return Domains(names, [math.log(docs[d] / sum(docs.values())) for d in names], [[math.log(n / sum(seen[d])) for n in seen[d]] for d in names], strength)


def _rate(posterior: list[Column], steps: list[list[float]]) -> Column:
    """The rate after the steps: start at 1, add each step weighed by the posteriors, stay above 0."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate + reduce(lambda a, b: a + b, (p * F.lit(float(s)) for p, s in zip(posterior, step))))
    return rate


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, most_steps: int = 40, close: float = 1e-4) -> list[list[float]]:
    """The steps of projected gradient over rows of ``n_tokens, posterior``."""
    p = [F.col("posterior")[k] for k in range(len(domains))]

    def tokens(steps: list[list[float]]) -> list[float]:
        rate = _rate([F.col(f"p{k}") for k in range(len(domains))], steps)
        sums = [F.sum(rate * F.col("n_tokens") * F.col(f"p{k}")).alias(f"t{k}") for k in range(len(domains))]
        got = rows.select("n_tokens", *[x.alias(f"p{k}") for k, x in enumerate(p)]).agg(*sums).first()
        return [got[f"t{k}"] or 0.0 for k in range(len(domains))]

    if not domains:
        return []
    weights = [max(0.0, targets.get(d, 0.0)) for d in domains]
    if not sum(weights):
        return []
    weights = [w / sum(weights) for w in weights]
    at_one = tokens([])
    if not sum(at_one):
        return []
    if total is None:
        total = max(n / w for n, w in zip(at_one, weights) if w)
    want = [w * total for w in weights]
    steps: list[list[float]] = []
    have = at_one
    while len(steps) < most_steps and max(abs(a - b) for a, b in zip(have, want)) > close * total:
        steps.append([(b - a) / max(n, 1.0) for a, b, n in zip(have, want, at_one)])
        have = tokens(steps)
    return steps


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, strength: float = 60.0, telling: str = TELLING, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (by default all) with ``n_tokens``, ``posterior``, ``domain`` (the
    likeliest) and ``rate``.  Rows are written with their counts once; what follows reads these.

    ``labelled`` holds ``doc_id, domain``; the smallest domain counts where a doc_id has several."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "posterior", "domain", "rate")]
    known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counted = table(_features(docs, telling).select("row.doc_id", F.struct(*[F.col(f"row.`{c}`") for c in keep]).alias("row"), "n_tokens", "counts"), "features")
    domains = train_domains(counted.select("doc_id", "counts"), known, strength)
    steps = fit_rates(table(domains.apply(counted.select("n_tokens", "counts")), "posteriors"), domains.names, targets, total)
    rows = domains.apply(counted.select("row", "n_tokens", "counts"))
    rate = _rate([F.col("posterior")[k] for k in range(len(domains.names))], steps)
    best = F.lit(None).cast("string")
    if domains.names:
        best = F.get(F.array(*[F.lit(d) for d in domains.names]), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    return rows.select("row.*", "n_tokens", "posterior", best.alias("domain"), rate.alias("rate"))


def copies(rate: Column, key: Column) -> Column:
    """How often a document is taken: the whole part of its rate, and once more for the share of keys
    that the rest is."""
    point = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + point).cast("int")


#: Target weights of the registered query and of the pipeline.
TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table: documents of ``labels`` with their language as the domain."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    return documents(spark, sf_dir).select("doc_id", F.col("lang").alias("domain")).join(labels, "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir), language_labels(spark, sf_dir), TARGETS, keep=["doc_id"])
    return out.select("doc_id", "n_tokens", "domain", F.array_max("posterior").alias("membership"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
