"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are counted in Arrow batches, bytes and words at a time in numpy.
Trees are grown on binned columns of a bounded labelled sample and flattened into arrays, which
batches of statistics then traverse together, one level of all trees at a time.

Null and empty texts have zero statistics and are scored like any other row.  Repeated rows are
scored alike; a null doc_id is scored and not held out.  With labels of one class only the score is
that class's share (0.5 without labels).  Batches are cut by bytes; a longer text is counted whole, its words in
pieces.  Columns other than ``doc_id`` and ``text`` are not used, so that no name clashes.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import by_size, documents, text_of
from foliant.llm.labelled import remainder, sample
from foliant.llm.near_dup import word_hashes

STATISTICS = [
    "log_words", "mean_word", "long_words", "upper", "digit", "bang", "symbol", "bar", "stop", "other_punctuation", "beyond_ascii",
    "newline", "distinct_words", "repeats", "top_word", "duplicate_lines", "short_lines", "peak_bang", "peak_symbol", "peak_upper",
]
_KINDS = 12
_KIND = np.zeros(256, np.uint8)  # 0: any other byte
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "#*$%&<>=", "|", ".,;:?", "\"'()[]{}-_/\\+@~^`", " \t\r\x0b\f", "\n"), 1):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128:192], _KIND[192:] = 10, 11  # inner and first bytes beyond ASCII
_PEAK = 256  # bytes of the windows whose highest shares are taken
_SPACE = re.compile(r"[ \t-\r]")


def _pieces(text: str, most: int = 1 << 20) -> list[str]:
    """A long text cut at white space, as its words need many times their size in memory."""
    out, at = [], 0
    while len(text) - at > most:
        cut = next((m.start() for m in _SPACE.finditer(text, at + most)), len(text))
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes``, long texts in pieces."""
    found = [word_hashes(p) for p in ([x] for x in _pieces(texts[0]))] if len(texts) == 1 else [word_hashes(texts)]
    return np.concatenate([w for w, _ in found]), sum(n for _, n in found)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS for each text.  Bytes are counted in windows, a kind at a time, so that two
    bytes a byte of text are held."""
    n = len(texts)
    parts = [x.encode() for x in texts]
    size = np.fromiter(map(len, parts), np.int64, n)
    kind = _KIND[np.frombuffer(b"".join(parts), np.uint8)]
    # Windows of the texts that are not empty, by the place of their first byte.
    n_win = -(-size // _PEAK)
    first = np.cumsum(n_win) - n_win
    text = np.repeat(np.arange(n), n_win)
    start = (np.cumsum(size) - size)[text] + (np.arange(len(text)) - first[text]) * _PEAK
    in_win = np.stack([np.add.reduceat(kind == k, start, dtype=np.int64) for k in range(_KINDS)], 1) if len(start) else np.zeros((0, _KINDS), np.int64)
    count, peaks = np.zeros((n, _KINDS)), [np.zeros(n) for _ in range(3)]
    if some := np.flatnonzero(size).tolist():
        count[some] = np.add.reduceat(in_win, first[some])
        length = in_win.sum(1) + 32.0
        for peak, k in zip(peaks, (3, 4, 1)):
            peak[some] = np.maximum.reduceat(in_win[:, k] / length, first[some])

    words, n_words = _words(texts)
    ends = np.cumsum(n_words)
    distinct, repeats, top = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, (a, b) in enumerate(zip((ends - n_words).tolist(), ends.tolist())):
        if b > a:
            w = words[a:b]
            repeats[k] = (w[1:] == w[:-1]).sum()
            s = np.sort(w)
            runs = np.diff(np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True]))))
            distinct[k], top[k] = len(runs), runs.max()
    lines, copies, short = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, x in enumerate(texts):
        own_lines = [y for y in x.split("\n") if y and not y.isspace()]
        lines[k], copies[k] = len(own_lines), len(own_lines) - len(set(own_lines))
        short[k] = sum(len(y) < 30 for y in own_lines)
    chars = np.maximum(1.0, size - count[:, 10])
    w, ln = np.maximum(1.0, n_words), np.maximum(1.0, lines)
    solid = chars - count[:, 8] - count[:, 9]
    columns = [
        np.log1p(n_words), solid / w, (size > 0) * np.maximum(0, solid / w - 8), count[:, 1] / chars, count[:, 2] / chars, count[:, 3] / chars, count[:, 4] / chars,
        count[:, 5] / chars, count[:, 6] / w, count[:, 7] / chars, count[:, 11] / chars, count[:, 9] / w, distinct / np.sqrt(w), repeats / w, top / w, copies / ln, short / ln, *peaks,
    ]
    return np.stack(columns, 1)


@dataclass
class Trees:
    """All trees in arrays: a node with column -1 is a leaf that points to itself."""

    column: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, np.maximum(self.column[at], 0)] <= self.cut[at], self.below[at], self.above[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 2.0, least: float = 3.0) -> Trees:
    """Newton boosting of the logistic loss.  Columns are binned at quantiles once; the histograms
    of gradient and curvature of all nodes of a level are made in one pass a column."""
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    column, cut, below, above, value, roots = [], [], [], [], [], []
    if not len(y) or not 0 < share < 1:
        trees = 0
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])] if trees else []
    binned = np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)], 1) if trees else x
    z = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        roots.append(len(column))
        level, node = [len(column)], np.full(len(y), len(column))
        for store, v in ((column, -1), (cut, 0.0), (below, len(column)), (above, len(column)), (value, 0.0)):
            store.append(v)
        for d in range(depth + 1):
            place = {k: i for i, k in enumerate(level)}
            at = np.array([place.get(k, -1) for k in range(roots[-1], len(column))])[node - roots[-1]]
            live = at >= 0
            G, H = (np.bincount(at[live], v[live], len(level)) for v in (g, h))
            for i, k in enumerate(level):
                value[k] = -rate * G[i] / (H[i] + l2)
            if d == depth:
                break
            best = np.full(len(level), 1e-6)
            choice = [(-1, 0)] * len(level)
            for c in range(x.shape[1]):
                m = len(cuts[c]) + 1
                slot = at[live] * m + binned[live, c]
                gl, hl = (np.cumsum(np.bincount(slot, v[live], len(level) * m).reshape(-1, m), 1)[:, :-1] for v in (g, h))
                if not gl.shape[1]:
                    continue
                gr, hr = G[:, None] - gl, H[:, None] - hl
                gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2), -1) - (G**2 / (H + l2))[:, None]
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(len(level)), top] > best):
                    best[i], choice[i] = gain[i, top[i]], (c, int(top[i]))
            after = []
            for i, k in enumerate(level):
                c, b = choice[i]
                if c >= 0:
                    column[k], cut[k], below[k], above[k] = c, float(cuts[c][b]), len(column), len(column) + 1
                    for new in (len(column), len(column) + 1):
                        for store, v in ((column, -1), (cut, 0.0), (below, new), (above, new), (value, 0.0)):
                            store.append(v)
                        after.append(new)
                    own = node == k
                    node[own] = np.where(binned[own, c] <= b, below[k], above[k])
            level = after
            if not level:
                break
        z = z + np.array(value)[node]
    return Trees(np.array(column, int), np.array(cut), np.array(below, int), np.array(above, int), np.array(value), np.array(roots, int), depth if trees else 0, base)


def document_statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns in ``keep`` and ``stats array<double>`` of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            s = statistics(b.column("text").to_pylist())
            yield pa.record_batch({c: b.column(c) for c in ("doc_id", *keep)} | {"stats": pa.array(list(s), pa.list_(pa.float64()))})

    inner = docs.select(F.col("doc_id").cast("long"), text_of().cast("string").alias("text"), *keep)
    kinds = "".join(f"{c} {inner.schema[c].dataType.simpleString()}, " for c in keep)
    return inner.mapInArrow(work, f"doc_id long, {kinds}stats array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 5000) -> Trees:
    """Fit on the statistics of at most ``rows`` labelled documents of either class."""
    got = document_statistics(sample(docs, labels, label, rows), ("label",)).select("label", "stats").toPandas()
    x = np.array(got["stats"].tolist()).reshape(-1, len(STATISTICS))
    return fit(x, got["label"].to_numpy(float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, score`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(trees)  # at most 2^(depth + 1) nodes a tree

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(held.value.score(statistics(b.column("text").to_pylist())))})

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = train(docs, labels.where(remainder(4) != 2))
    out = score(docs, trees)
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
