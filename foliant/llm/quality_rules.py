"""Quality rules: decision lists learned by sequential covering, emitted as Spark conditionals.

Statistics of every text are DataFrame expressions.  For the labelled rows each growing step is one
aggregation: counts by (statistic, bin, label) of the rows not yet covered; the driver sums these
few numbers up into the counts of every threshold condition and takes the best.  A rule is a
conjunction of such conditions, grown on two thirds of the rows and pruned on the rest; rules that
are not precise enough end the list.  All labelled rows are used.

Null and empty texts have zero statistics and fail the base rules; long ones are counted to their end.  Repeated rows are judged alike.
Without labelled rows of both classes the list is empty and keeps everything that passes the base.
An empty table gives an empty result.  The added columns replace columns of ``docs`` with their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import SPACES, WORD, documents, table, text_of

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The statistics that rules may use, from the counted columns.
RATIOS = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(word_chars, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "bar_share": "n_bars / greatest(n_words, 1)",
}


#: Classes of characters that are counted; the others are taken out of a text once.
SYMBOLS = "#*$%&|<>"
CAPITALS = "A-ZÀ-ÖØ-Þ"


def _count(text: Column, keep: str) -> Column:
    """Number of the characters that are in the class ``keep``."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


COUNTED = [*BASE, "n_lines", "n_distinct", "n_capitals", "n_bangs", "n_bars"]


def text_statistics(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the counted columns.

    Words of repeated windows are found by hashing each window of three words, sorting (hash, place)
    and keeping the places whose hash stands beside an equal one; texts without a repeated window
    skip that."""
    text = F.col("text")
    others = [c for c in docs.columns if c not in COUNTED]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), text_of().cast("string").alias("text"))
    cut = base.select(
        "row",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("lines"),
        F.regexp_replace(text, f"[^!{SYMBOLS}{CAPITALS}]+", "").alias("told"),
    )
    size = F.size("words")
    ends = F.when(size >= 3, size - 2).otherwise(0)
    windows = F.when(ends > 0, F.transform(F.sequence(F.lit(0), ends - 1), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    counts = [F.length(F.array_join("words", "")).cast("long").alias("word_chars"), _count(F.col("told"), SYMBOLS).alias("n_symbols"), _count(F.col("told"), CAPITALS).alias("n_capitals")]
    counts += [_count(F.col("told"), c).alias(n) for c, n in (("!", "n_bangs"), ("|", "n_bars"))]
    held = cut.select("row", "words", "lines", *counts, F.coalesce(windows, F.array().cast("array<long>")).alias("windows"))
    held = held.select("*", (F.size("windows") > F.size(F.array_distinct("windows"))).alias("again"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))
    sort = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    held = held.select("*", F.when(F.col("again"), sort).alias("sorted"))
    near = F.filter("sorted", lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"]))
    places = F.array_distinct(F.flatten(F.transform(near, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return held.select(
        "row.*",
        size.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), F.size(places)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_distinct",
        "n_capitals",
        "n_bangs",
        "n_bars",
    )


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass
class Rule:
    """A conjunction of (statistic, above, threshold)."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def sql(self, names: dict[str, str] = RATIOS) -> str:
        """Over the counted columns; with ``names`` empty, over columns named like the statistics."""
        return " and ".join(f"{names.get(n, n)} {'>' if up else '<='} {t!r}D" for n, up, t in self.conditions) or "true"


@dataclass
class DecisionList:
    rules: list[Rule]

    def verdict(self) -> Column:
        """True to keep: an ordered conditional, the first rule that holds decides."""
        out = None
        for r in self.rules:
            out = F.when(F.expr(r.sql()), F.lit(False)) if out is None else out.when(F.expr(r.sql()), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], list[int]]:
    """Rows of label 1 and 0 by statistic and bin (how many thresholds lie below the value)."""
    below = {n: f"size(filter(array({', '.join(f'{t!r}D' for t in c)}), t -> {n} > t))" for n, c in cuts.items()}
    binned = [F.struct(F.lit(n).alias("name"), F.expr(e).alias("bin")) for n, e in below.items()]
    got = rows.select("label", F.explode(F.array(*binned)).alias("x")).groupBy("x.name", "x.bin").agg(F.expr("count_if(label = 1)").alias("good"), F.expr("count_if(label = 0)").alias("bad")).collect()
    return {(r["name"], r["bin"]): [r["good"], r["bad"]] for r in got}


def learn(labelled: DataFrame, most_rules: int = 12, most_conditions: int = 3, bins: int = 24, precise: float = 0.97, least: int = 4) -> DecisionList:
    """``labelled``: ``doc_id, label`` (1 good, 0 bad) and the counted columns.  Rules cover bad rows;
    each must be ``precise`` on the growing rows and cover ``least`` of them."""
    kept = labelled.select("label", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *[F.expr(e).cast("double").alias(n) for n, e in RATIOS.items()])
    rows = table(kept.where("label in (0, 1)"), "labelled")
    grow, prune = rows.where(~F.col("prune")), rows.where("prune")
    q = [k / bins for k in range(1, bins)]
    asked = [f"percentile_approx({n}, array({', '.join(map(str, q))}), 1000) filter (where label = {y}) as {n}{y}" for n in RATIOS for y in (0, 1)]
    asked += [f"max({n}) filter (where label = 1) as top_{n}" for n in RATIOS] + [f"min({n}) filter (where label = 1) as low_{n}" for n in RATIOS]
    first = rows.selectExpr(*asked).first()
    if any(first[f"{n}{y}"] is None for n in RATIOS for y in (0, 1)):
        return DecisionList([])
    cuts = {n: sorted({float(t) for y in (0, 1) for t in first[f"{n}{y}"]} | {float(first[f"top_{n}"]), float(first[f"low_{n}"]) - 1e-9}) for n in RATIOS}

    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = " and ".join(f"not ({r.sql({})})" for r in rules) or "true"
        rule = Rule()
        while len(rule.conditions) < most_conditions:
            by = _counts(grow.where(left).where(rule.sql({})), cuts)
            good, bad = (sum(v[k] for (n, _), v in by.items() if n == next(iter(cuts))) for k in (0, 1))
            if bad < least or good == 0:
                break
            prior = bad / (bad + good)
            best = (prior, None)
            for n, c in cuts.items():
                g = b = 0
                for k, t in enumerate(c):
                    x = by.get((n, k), [0, 0])
                    g, b = g + x[0], b + x[1]
                    for up, gg, bb in ((False, g, b), (True, good - g, bad - b)):
                        if bb >= least:
                            worth = (bb + 4 * prior) / (bb + gg + 4)  # m-estimate of the precision
                            if worth > best[0]:
                                best = (worth, (n, up, t))
            if best[1] is None:
                break
            rule.conditions.append(best[1])
        if not rule.conditions:
            break
        # Pruning: the beginning of the conjunction that is worth most on the other rows.
        starts = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        seen = {}
        for name, part in (("grow", grow), ("prune", prune)):
            got = part.where(left).selectExpr(*[f"count_if(label = {y} and {r.sql({})}) as c{k}_{y}" for k, r in enumerate(starts) for y in (0, 1)]).first()
            seen[name] = [(got[f"c{k}_1"], got[f"c{k}_0"]) for k in range(len(starts))]
        fit = []
        for k, ((g, b), (pg, pb)) in enumerate(zip(seen["grow"], seen["prune"])):
            if b >= least and (b + pb) / (g + b + pg + pb) >= precise:
                fit.append(((pb - pg) / max(1, pb + pg), -k))
        if not fit:
            break
        rules.append(starts[-max(fit)[1]])
    return DecisionList(rules)


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of ``docs`` with the counted columns, ``base_failed`` and ``kept``.  Rows are written
    with their statistics once, so that learning and judging read them instead of counting again."""
    stats = table(text_statistics(docs.select(*[c for c in docs.columns if c not in ("base_failed", "kept")])), "statistics")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    rules = learn(stats.select("doc_id", *COUNTED).join(known, "doc_id"))
    failed = F.expr(BASE_FAILED)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & rules.verdict())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *BASE, "base_failed", "kept")
