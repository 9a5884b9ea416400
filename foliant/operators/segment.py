"""Tokens of spaced and unspaced scripts: one tokenizer for an index and for the queries that meet it.

``Words`` cuts at what is no letter or digit.  ``Segmenter`` also cuts runs of a script that has no spaces, into the
words of a lexicon with the greatest product of frequencies (Viterbi over the lattice of the run's
substrings).  The lexicon is learned from a corpus by counting, or given as a table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.expr import TOKEN
from foliant.functions.store import table

#: Scripts written without spaces, as character ranges that Java and Python read alike.
UNSPACED = "㐀-䶿一-鿿豈-﫿぀-ヿ฀-๿຀-໿က-႟ក-៿"
LONGEST = 4  # code points of a learned word


def ngram_counts(rows: DataFrame, text: str = "text", script: str = UNSPACED, longest: int = LONGEST) -> DataFrame:
    """``word, n``: every substring of up to ``longest`` code points of the script's runs, counted on the
    map side first.  A look-ahead finds the substrings that begin at each place."""
    grams = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?=([{script}]{{{k}}}))"), F.lit(1)) for k in range(1, longest + 1)])
    return rows.select(F.explode(grams).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def learn_lexicon(rows: DataFrame, text: str = "text", script: str = UNSPACED, longest: int = LONGEST, least: int = 2, cohesion: float = 2.0, most: int = 500_000) -> DataFrame:
    """``word, n``: single code points, and longer substrings that occur ``least`` times or more and whose parts, wherever they
    are split, stand together exp(``cohesion``) times as often as by chance.  Of more than ``most`` the most frequent are the lexicon (ties to the
    smaller word), so that it can be held by every task whatever the corpus."""
    counts = table(ngram_counts(rows, text, script, longest).where((F.length("word") == 1) | (F.col("n") >= least)), "ngrams")
    total = counts.where(F.length("word") == 1).agg(F.sum("n")).first()[0] or 1
    long = counts.where(F.length("word") > 1)
    parts = long.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")).select("word", "n", F.substr("word", F.lit(1), F.col("k")).alias("left"), F.substr("word", F.col("k") + 1).alias("right"))
    part = lambda side: counts.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    met = parts.join(part("left"), "left").join(part("right"), "right")
    tight = met.groupBy("word", "n").agg(F.min(F.log(F.col("n") * F.lit(float(total)) / (F.col("n_left") * F.col("n_right").cast("double")))).alias("c")).where(F.round("c", 9) >= cohesion)
    return counts.where(F.length("word") == 1).unionByName(tight.select("word", "n")).orderBy(F.desc("n"), "word").limit(most)


def viterbi(run: str, cost: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The words of the cheapest path; of equal ones the path whose first word, then second, is longer.
    A single code point is always a word."""
    best, step = [0.0] * (len(run) + 1), [0] * len(run)
    for i in range(len(run) - 1, -1, -1):
        least = math.inf
        for k in range(min(longest, len(run) - i), 0, -1):
            c = cost.get(run[i : i + k], unknown if k == 1 else None)
            if c is not None and c + best[i + k] < least - 1e-9:
                least, step[i] = c + best[i + k], k
        best[i] = least
    out, at = [], 0
    while at < len(run):
        out.append(run[at : at + step[at]])
        at += step[at]
    return out


@dataclass(frozen=True)
class Words:
    """Runs of letters and digits of ``least`` code points or more; case and repeats are kept."""

    least: int = 2

    def add(self, rows: DataFrame, text: str = "text", name: str = "tokens") -> DataFrame:
        """``rows`` with the array column ``name``."""
        return rows.withColumn(name, F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) >= self.least))


def _pieces(text: str, script: str) -> Column:
    """Runs of the script, and what else is letters and digits."""
    return F.regexp_extract_all(text, F.lit(rf"[{script}]+|(?:(?![{script}])[\p{{L}}\p{{N}}_])+"), F.lit(0))


@dataclass(frozen=True)
class Segmenter(Words):
    """Words of spaced scripts, and those of the lexicon in runs of an unspaced one.  ``words`` has the frequencies; it is of
    bounded size (``learn_lexicon``) and sent to the tasks once."""

    words: dict[str, int] = field(default_factory=dict, repr=False)
    script: str = UNSPACED

    @staticmethod
    def read(lexicon: DataFrame, least: int = 2, script: str = UNSPACED, most: int = 500_000) -> Segmenter:
        """From a table ``word, n`` of at most ``most`` rows; a larger one is refused, not cut."""
        got = lexicon.limit(most + 1).toArrow()
        if got.num_rows > most:
            raise ValueError(f"a lexicon of more than {most} words can't be held by every task")
        return Segmenter(least, dict(zip(got["word"].to_pylist(), got["n"].to_pylist())), script)

    def costs(self) -> tuple[dict[str, float], int, float]:
        """Negative log-probabilities, the longest word, and the cost of an unknown code point."""
        total = math.log(max(1, sum(self.words.values())))
        return {w: total - math.log(n) for w, n in self.words.items() if n > 0}, max(map(len, self.words), default=1), total

    def add(self, rows: DataFrame, text: str = "text", name: str = "tokens") -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast(self.costs())  # a lexicon is of bounded size
        least, script = self.least, self.script

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, known = re.compile(f"[{script}]"), {}
            cost, longest, unknown = held.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    if len(known) > 100_000:
                        known.clear()
                    tokens = []
                    for pieces in b.column("pieces").to_pylist():
                        words = []
                        for x in pieces or []:
                            if not own.match(x):
                                words.append(x)
                                continue
                            if x not in known:
                                known[x] = viterbi(x, cost, longest, unknown)
                            words += known[x]
                        tokens.append(None if pieces is None else [w for w in words if len(w) >= least])
                    yield pa.record_batch({"row": b.column("row"), "tokens": pa.array(tokens, pa.list_(pa.string()))})

        packed = rows.select(F.struct("*").alias("row"), _pieces(text, script).alias("pieces"))
        out = packed.mapInArrow(work, f"row {packed.schema['row'].dataType.simpleString()}, tokens array<string>")
        return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns if c != name], F.col("tokens").alias(name))


def segment_by_table(rows: DataFrame, lexicon: DataFrame, text: str = "text", name: str = "tokens", least: int = 2, script: str = UNSPACED, longest: int = LONGEST) -> DataFrame:
    """``rows`` with the array column ``name`` that a ``Segmenter`` of the same words gives, for a lexicon (``word, n``, distinct words of up to
    ``longest`` code points, read twice) of any size: it is joined to the substrings of the texts' runs, so that each distinct text gets the words that it holds,
    and one number, the sum of ``n``, goes to the driver."""
    total = math.log(max(1, lexicon.agg(F.sum("n")).first()[0] or 0))
    runs = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct()
    runs = runs.select("_text", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(f"[{script}]+"), F.lit(0)))).alias("_run"))
    places = runs.select("_text", "_run", F.explode(F.sequence(F.lit(1), F.length("_run"))).alias("_at"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("_run") - F.col("_at") + 1))
    parts = places.select("_text", F.explode(F.transform(sizes, lambda k: F.substr("_run", F.col("_at"), k))).alias("word")).distinct()
    held = parts.join(lexicon.where("n > 0").select("word", "n"), "word").groupBy("_text").agg(F.collect_list(F.struct("word", "n")).alias("_words"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = re.compile(f"[{script}]")
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                tokens = []
                for pieces, words in zip(b.column("pieces").to_pylist(), b.column("words").to_pylist()):
                    cost = {w["word"]: total - math.log(w["n"]) for w in words or []}
                    cut = [w for x in pieces or [] for w in (viterbi(x, cost, longest, total) if own.match(x) else [x])]
                    tokens.append(None if pieces is None else [w for w in cut if len(w) >= least])
                yield pa.record_batch({"row": b.column("row"), "tokens": pa.array(tokens, pa.list_(pa.string()))})

    met = rows.select(F.struct("*").alias("row"), F.col(text).alias("_text")).join(held, "_text", "left")
    packed = met.select("row", _pieces("_text", script).alias("pieces"), F.col("_words").alias("words"))
    out = packed.mapInArrow(work, f"row {packed.schema['row'].dataType.simpleString()}, tokens array<string>")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns if c != name], F.col("tokens").alias(name))


WORDS = Words()
