"""Personal data and secrets: fixed patterns, and weak supervision for what they do not cover.

Base spans come from one pattern a kind (email, ip, card, phone) and a check of each match.  Further
candidates are runs of 12 letters and digits or more, and what stands behind a word that names a
credential, of four characters or more.  Labelers vote on each: patterns (hexadecimal, access-key
shapes, plain words), a gazetteer (the word before it names a credential), context (an assignment or
quote stands before it, or a path or number sign) and make-up (how often letters and digits alternate).
Names, addresses and other personal data of no such form are not looked for.  The
reliability of each labeler is estimated by expectation-maximisation over the counts of the vote
patterns, and the posteriors train a logistic classifier of spans on their own coarse features; spans
that it accepts are of the kind ``secret``.  Candidates that overlap a base span are left out.

Everything on the way is DataFrame expressions; the driver sees the counts of at most 3^4 vote
patterns and of the combinations of five coarse features.

Null and empty texts have no spans; long ones are searched to their end.  Repeated rows are treated alike, as are rows with a null doc_id.
Without candidates nothing is added.  An empty table gives an empty result.  Other columns of ``docs``
are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import documents, hex_sha, table, text_of

#: The contract's patterns, written so that a search is linear in the text: a match can only begin
#: where its run of characters does (or where the last match ended), and no run is given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{12,}+"
#: Words that name a credential.
GAZETTEER = ["password", "passwd", "passphrase", "pwd", "pin", "token", "secret", "key", "apikey", "credential", "auth", "bearer", "session", "cookie"]
#: What is assigned to such a word, of any alphabet, or stands behind it and has a digit.
NAMED = rf"(?i)\b(?:{'|'.join(GAZETTEER)})(?:[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?|\s(?:is\s)?[\"']?(?=[^\s\"',;0-9]*+[0-9]))([^\s\"',;]{{4,}}+)"
LABELERS = ["pattern", "gazetteer", "context", "make_up"]
SPAN = "struct<start:int,end:int,text:string,before:string,after:string>"


BLOCK = 256  # values of a running fold that are copied together


def running(values: Column, fold) -> Column:
    """The running fold (an associative one: a sum, a maximum) of an array of numbers.  As an array that
    grows by one is copied, it is made in blocks, and what stands before a block is added to all of it."""

    def prefix(x: Column, first: Column) -> Column:
        kind = "struct<last:long,all:array<long>>"
        zero = F.struct(first.alias("last"), F.array().alias("all")).cast(kind)
        step = lambda s, v: F.struct(fold(s["last"], v).alias("last"), F.array_append(s["all"], fold(s["last"], v)).alias("all")).cast(kind)
        return F.aggregate(x, zero, step, lambda s: s["all"])

    values, none = values.cast("array<long>"), F.lit(None).cast("long")
    fold_, fold = fold, lambda a, b: F.when(a.isNull(), b).otherwise(fold_(a, b))
    blocks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(BLOCK)), lambda at: prefix(F.slice(values, at, F.lit(BLOCK)), none))
    before = F.concat(F.array(none), prefix(F.transform(blocks, lambda b: F.element_at(b, -1)), none))
    whole = F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(before) - 1), lambda b, t: F.transform(b, lambda x: fold(t, x))))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<long>"))


def _found(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """For each pattern a column ``array<SPAN>`` of its leftmost non-overlapping matches: the texts
    between the matches give the places, by a running sum of their lengths."""
    out = docs.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in patterns.items()])
    out = out.select("*", *[F.when(F.size(f"_m_{k}") > 0, F.split("text", p, -1)).alias(f"_p_{k}") for k, p in patterns.items()])
    upto = lambda k: F.sequence(F.lit(0), F.size(f"_m_{k}") - 1)
    gap = lambda k: lambda i: F.length(F.get(F.col(f"_p_{k}"), i)) + F.coalesce(F.length(F.get(F.col(f"_m_{k}"), i - 1)), F.lit(0))
    # Written out one after the other, as what a lambda reads should not be computed within it.
    out = out.select("*", *[F.when(F.size(f"_m_{k}") > 0, F.transform(upto(k), gap(k))).alias(f"_g_{k}") for k in patterns])
    out = out.select("*", *[F.when(F.size(f"_m_{k}") > 0, running(F.col(f"_g_{k}"), lambda a, b: a + b)).alias(f"_s_{k}") for k in patterns])

    def span(k: str):
        m, p = F.col(f"_m_{k}"), F.col(f"_p_{k}")

        def one(i: Column) -> Column:
            start = F.get(F.col(f"_s_{k}"), i)
            return F.struct(start.alias("start"), (start + F.length(F.get(m, i))).alias("end"), F.get(m, i).alias("text"), F.right(F.get(p, i), F.lit(24)).alias("before"), F.left(F.get(p, i + 1), F.lit(1)).alias("after"))

        return one

    none = F.array().cast(f"array<{SPAN}>")
    out = out.select("*", *[F.when(F.size(f"_m_{k}") > 0, F.transform(upto(k), span(k)).cast(f"array<{SPAN}>")).otherwise(none).alias(k) for k in patterns])
    return out.drop(*[f"_{x}_{k}" for k in patterns for x in "mpgs"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value)
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


CHECKS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s["text"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)),
    "card": lambda s: F.length(_digits(s["text"])).between(16, 19) & _luhn(_digits(s["text"])),
    "phone": lambda s: F.length(_digits(s["text"])).between(8, 15),
}


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, an ``array<SPAN>`` for each base kind, and ``candidates``."""
    inner = docs.select("doc_id", text_of().cast("string").alias("text"))
    found = _found(inner, PATTERNS | {"candidate": CANDIDATE, "named": NAMED}).drop("text")
    kept = found.select("doc_id", *[F.filter(k, CHECKS[k]).alias(k) for k in PATTERNS], "candidate", F.transform("named", _value).alias("named"))
    for k, others in (("candidate", [*PATTERNS]), ("named", [*PATTERNS, "candidate"])):
        kept = _apart(kept, k, others)
    return kept.select("doc_id", *PATTERNS, F.array_sort(F.concat("candidate", "named")).alias("candidates"))


def _value(s: Column) -> Column:
    """The span of what a match of NAMED gives to its word: the end of the match."""
    value = F.regexp_extract(s["text"], NAMED, 1)
    name = F.left(s["text"], F.length(s["text"]) - F.length(value))
    return F.struct((s["end"] - F.length(value)).alias("start"), s["end"].alias("end"), value.alias("text"), F.right(F.concat(s["before"], name), F.lit(24)).alias("before"), s["after"].alias("after"))


def _apart(df: DataFrame, spans: str, others: list[str]) -> DataFrame:
    """``df`` without those spans of the column ``spans`` that overlap one of the ``others``.  All are put in
    the order of their starts; a span overlaps one that starts before it if the greatest end so far
    lies behind its start, and one that starts after it if the next start lies before its end."""
    mark = lambda c, own: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s.alias("span")))
    both = F.when((F.size(spans) > 0) & (F.size(F.concat(*others)) > 0), F.array_sort(F.concat(mark(F.concat(*others), 0), mark(spans, 1))))
    df = df.withColumn("_all", both)
    far = F.transform("_all", lambda x: F.when(x["own"] == 0, x["span"]["end"]).otherwise(-1))
    near = F.transform(F.reverse("_all"), lambda x: F.when(x["own"] == 0, -x["start"]).otherwise(-(1 << 40)))
    most = lambda a, b: F.greatest(a, b)
    df = df.withColumns({"_far": far, "_near": near})
    there = F.col("_all").isNotNull()
    df = df.withColumns({"_end": F.when(there, running(F.col("_far"), most)), "_next": F.when(there, F.reverse(running(F.col("_near"), most)))})
    # Zipped and not looked up by place, so that no fold is made anew for every span.
    ends = F.zip_with("_all", "_end", lambda x, e: F.when((x["own"] == 1) & (e <= x["start"]), x["span"]))
    kept = F.array_compact(F.zip_with(ends, "_next", lambda s, n: F.when(-n >= s["end"], s)))
    return df.withColumn(spans, F.when(there, kept).otherwise(F.col(spans))).drop("_all", "_far", "_near", "_end", "_next")


def _changes(x: Column) -> Column:
    """How often letters and digits alternate."""
    return F.length(F.regexp_replace(F.regexp_replace(x, "[0-9]+", "#"), "[A-Za-z]+", "a")) - 1


def _votes(c: Column) -> list[Column]:
    """1: private, -1: not, 0: no vote; in the order of LABELERS."""
    word = F.lower(F.regexp_extract(c["before"], r"([A-Za-z]+)(?:\sis\s|[^A-Za-z]{0,4})[\"']?$", 1))
    named = reduce(lambda a, b: a | b, [F.endswith(word, F.lit(g)) for g in GAZETTEER])
    shape = F.when(c["text"].rlike("^(?:[0-9a-f]{16,}|[A-Z]{4}[0-9A-Z]{8,})$"), 1).when(c["text"].rlike("^(?:[0-9]+|[A-Za-z]?[a-z]+)$"), -1).otherwise(0)
    before = F.right(F.rtrim(c["before"]), F.lit(1))
    context = F.when(before.isin("=", ":", '"', "'"), 1).when(before.isin("/", "#", "-", "."), -1).otherwise(0)
    changes = _changes(c["text"])
    return [shape, F.when(named, 1).otherwise(0), context, F.when(changes >= 4, 1).when(changes <= 1, -1).otherwise(0)]


def _features(c: Column) -> list[Column]:
    """Coarse features of the span itself and its neighbours, each a small whole number."""
    n = F.length(c["text"])
    digits, capitals = F.length(_digits(c["text"])), F.length(F.regexp_replace(c["text"], "[^A-Z]", ""))
    before = F.right(c["before"], F.lit(1))
    return [
        F.greatest(F.lit(-1), F.least(F.lit(5), F.floor((n - 12) / 6))).cast("int"),
        F.least(F.lit(4), F.floor(5 * digits / n)).cast("int"),
        F.least(F.lit(2), F.floor(3 * capitals / n)).cast("int"),
        F.least(F.lit(4), F.floor(_changes(c["text"]) / 2)).cast("int"),
        F.when(before.rlike("[=:]"), 1).when(before.rlike("[\"']"), 2).when(before.rlike(r"\s"), 3).when(before == "", 4).otherwise(0),
    ]


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[float, list[tuple[dict[int, float], dict[int, float]]]]:
    """Expectation-maximisation with independent labelers: the share of private spans, and for each
    labeler the chances of its votes on private and on other spans."""
    n, wide = sum(counts.values()), len(next(iter(counts)))
    prior = 0.5
    tables = [({1: 0.6, 0: 0.3, -1: 0.1}, {1: 0.1, 0: 0.4, -1: 0.5}) for _ in range(wide)]
    for _ in range(rounds):
        post = {v: posterior(v, prior, tables) for v in counts}
        prior = min(0.98, max(0.02, sum(c * post[v] for v, c in counts.items()) / n))
        new = []
        for k in range(wide):
            pair = []
            for y in (1, 0):
                mass = {vote: 0.5 + sum(c * (post[v] if y else 1 - post[v]) for v, c in counts.items() if v[k] == vote) for vote in (1, 0, -1)}
                pair.append({vote: m / sum(mass.values()) for vote, m in mass.items()})
            new.append((pair[0], pair[1]))
        tables = new
    return prior, tables


def posterior(votes: tuple[int, ...], prior: float, tables) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(t[0][v] / t[1][v]) for v, t in zip(votes, tables))
    return 1 / (1 + math.exp(-odds))


def fit_spans(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[float, list[dict[int, float]]]:
    """Logistic regression on one-hot features: (features, sum of posteriors, count) of each combination."""
    wide = len(rows[0][0])
    bias, weights = 0.0, [dict.fromkeys({f[k] for f, _, _ in rows}, 0.0) for k in range(wide)]
    total = sum(n for _, _, n in rows)
    for _ in range(rounds):
        grad_b, grad = 0.0, [dict.fromkeys(w, 0.0) for w in weights]
        for f, s, n in rows:
            z = bias + sum(w[v] for w, v in zip(weights, f))
            d = (n / (1 + math.exp(-z)) - s) / total
            grad_b += d
            for g, v in zip(grad, f):
                g[v] += d
        bias -= rate * grad_b
        for w, g in zip(weights, grad):
            for v in w:
                w[v] -= rate * (g[v] + decay * w[v])
    return bias, weights


def _logit(c: Column, bias: float, weights: list[dict[int, float]]) -> Column:
    out = F.lit(bias)
    for f, w in zip(_features(c), weights):
        case = None
        for v, x in sorted(w.items()):
            case = F.when(f == v, F.lit(x)) if case is None else case.when(f == v, F.lit(x))
        out = out + (case.otherwise(F.lit(0.0)) if case is not None else F.lit(0.0))
    return out


def private_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, an ``array<SPAN>`` for each base kind, and ``secret`` for the added spans."""
    spans = table(base_spans(docs), "spans")
    one = spans.select(F.explode("candidates").alias("c"))
    votes = one.select(F.array(*_votes(F.col("c"))).alias("v"), F.array(*_features(F.col("c"))).alias("f"))
    seen = votes.groupBy("v", "f").count().collect()  # at most 81 x 2,625 combinations
    if not seen:
        return spans.select("doc_id", *PATTERNS, F.filter("candidates", lambda c: F.lit(False)).alias("secret"))
    counts: dict[tuple[int, ...], int] = {}
    for r in seen:
        counts[tuple(r["v"])] = counts.get(tuple(r["v"]), 0) + r["count"]
    prior, tables = reliabilities(counts)
    by: dict[tuple[int, ...], list[float]] = {}
    for r in seen:
        x = by.setdefault(tuple(r["f"]), [0.0, 0.0])
        x[0] += r["count"] * posterior(tuple(r["v"]), prior, tables)
        x[1] += r["count"]
    bias, weights = fit_spans([(f, s, n) for f, (s, n) in sorted(by.items())])
    return spans.select("doc_id", *PATTERNS, F.filter("candidates", lambda c: _logit(c, bias, weights) >= 0).alias("secret"))


def _names(kinds: list[str]) -> Column:
    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = private_spans(documents(spark, sf_dir))
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in [*PATTERNS, "secret"]], hex_sha(_names(list(PATTERNS))).alias("base_sha256"), _names([*PATTERNS, "secret"]).alias("spans"), reduce(lambda a, b: a + b, [F.size(k) for k in [*PATTERNS, "secret"]]).cast("long").alias("n_spans"))
