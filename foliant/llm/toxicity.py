"""Toxicity: bags of subword embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of its character n-grams (hashed into buckets, with
word-boundary marks), so that an unseen misspelling shares most of it.  A window of words is scored
by the mean of its distinct words' vectors through the softmax, a text by its most toxic window; embeddings and
softmax are trained together in numpy, on whole windows in the first epochs and on each document's
highest window after that.

As the model is linear after the mean, scoring needs one number for each n-gram bucket: tasks get
that table (a fixed ``BUCKETS`` floats) and whole texts, and look every distinct word up once.

Null and empty texts are scored by the bias alone; long ones window by window, to their end.
Repeated rows are scored alike; a null doc_id is scored and not held out.  With labels of one class
only, or none, every score is that class's share (0 without labels).  An empty table gives an empty
result.  Other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Memo, by_size, documents, text_of
from foliant.llm.labelled import remainder, sample

BUCKETS, DIM, SIZES = 1 << 17, 8, (3, 4, 5, 6)
WINDOW, SMOOTH = 32, 4.0
#: Words keep digits and signs, so that "h4te" and "a$$" share n-grams with what they stand for.
_WORD = re.compile(r"""[^\s.,;:!?"'()\[\]{}<>/\\|]+""")


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of the words."""
    data = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    own = np.repeat(np.arange(len(words)), size)
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(data))
    code = (data + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    out_w, out_b = [], []
    h = np.zeros(len(data), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint64(0xBF58476D1CE4E5B9) + code[n - 1 :]
        if n in SIZES:
            ok = at[: len(h)] + n <= end[: len(h)]
            x = h[ok] ^ (h[ok] >> np.uint64(32))
            out_b.append(((x * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)) >> np.uint64(40)).astype(np.int64) % BUCKETS)
            out_w.append(own[: len(h)][ok])
    return np.concatenate(out_w or [np.zeros(0, np.int64)]), np.concatenate(out_b or [np.zeros(0, np.int64)])


def _word_grams(words: list[str], held: np.ndarray, step: int = 20_000) -> tuple[np.ndarray, ...]:
    """One over the number of n-grams of each word; (word, bucket) of every n-gram, by word; how many
    texts reach each bucket, a text counted once for each of its words there."""
    n, reach, out_w, out_g = np.zeros(len(words), np.float32), np.zeros(BUCKETS), [], []
    for at in range(0, len(words), step):
        own, gram = ngrams(words[at : at + step])
        order = np.argsort(own, kind="stable")
        own, gram = own[order], gram[order]
        n[at : at + step] = np.bincount(own, minlength=len(words[at : at + step]))
        reach += np.bincount(gram, held[at + own], BUCKETS)
        out_w.append((at + own).astype(np.int32))
        out_g.append(gram.astype(np.int32))
    return 1 / np.maximum(1, n), np.concatenate(out_w), np.concatenate(out_g), reach


@dataclass
class Model:
    gram: np.ndarray  # log-odds of each n-gram bucket
    bias: float


def fit(texts: list[str], labels: list[int], epochs: int = 100, whole_epochs: int = 25, rate: float = 0.1, decay: float = 1e-5, least: int = 4, lean: float = 1.5, seed: int = 7) -> Model:
    """Embeddings and softmax by Adam over all windows, then over the top window of each text.
    Buckets that fewer than ``least`` texts reach stay zero, as unseen ones do; the toxic class
    weighs ``lean`` times the other.  The empty text is an example of class 0, at a tenth of the weight
    of all."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    texts, y = [*texts, ""], np.append(y, 0)
    index: dict[str, int] = {}
    tokens, sizes = [], []
    for x in texts:
        w = [index.setdefault(t, len(index)) for t in _WORD.findall(x.lower())]
        tokens.append(np.array(w, np.int64))
        sizes.append(len(w))
    token = np.concatenate(tokens).astype(np.int32)
    n_win = np.maximum(1, -(-np.array(sizes) // WINDOW))
    win_doc = np.repeat(np.arange(len(texts)), n_win)
    win_first = np.cumsum(n_win) - n_win
    token_win = np.concatenate([win_first[d] + np.arange(n) // WINDOW for d, n in enumerate(sizes)]).astype(np.int32)
    pair = np.unique(token_win.astype(np.int64) << 32 | token)
    token_win, token = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
    scale = 1.0 / (np.bincount(token_win, minlength=len(win_doc)) + SMOOTH)
    held = np.bincount(np.concatenate([np.unique(t) for t in tokens]), minlength=len(index))
    per_word, gram_word, gram, reach = _word_grams(list(index), held)
    common = reach >= least
    keep = common[gram]
    gram_word, gram = gram_word[keep], gram[keep]
    first_gram = np.flatnonzero(np.diff(gram_word, prepend=-1))
    some = gram_word[first_gram]  # words with n-grams that are used
    n_grams = np.diff(first_gram, append=len(gram))

    rng = np.random.default_rng(seed)
    params = [(rng.normal(0, 0.05, (BUCKETS, DIM)) * common[:, None]).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    balance = np.array([0.5 / (y == 0).mean(), lean * 0.5 / (y == 1).mean()])[y] / len(y)
    balance[-1] = 0.1

    for epoch in range(epochs):
        # Of two classes the softmax needs the difference of the logits only.
        per_gram = params[0] @ (params[1][:, 1] - params[1][:, 0])
        word = np.zeros(len(index), np.float32)
        if len(gram):
            word[some] = np.add.reduceat(per_gram[gram], first_gram) * per_word[some]
        z = np.bincount(token_win, word[token], len(win_doc)) * scale + (params[2][1] - params[2][0])
        if epoch < whole_epochs:
            use, weight = np.arange(len(win_doc)), 1.0 / n_win[win_doc]
        else:
            use = np.lexsort((z, win_doc))[np.cumsum(n_win) - 1]
            weight = np.ones(len(use))
        d = (1 / (1 + np.exp(-z[use])) - y[win_doc[use]]) * weight * balance[win_doc[use]]
        per_win = np.zeros(len(win_doc), np.float32)
        per_win[use] = d * scale[use]
        word = np.bincount(token, per_win[token_win], len(index)) * per_word
        grad = np.bincount(gram, np.repeat(word[some].astype(np.float32), n_grams), BUCKETS).astype(np.float32)
        both = np.stack([-grad, grad], 1)
        steps = [both @ params[1].T + decay * params[0], params[0].T @ both + decay * params[1], np.array([-d.sum(), d.sum()], np.float32)]
        for k, g in enumerate(steps):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] - rate * (first[k] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (epoch + 1))) + 1e-8)
    per_gram = params[0] @ params[1]
    return Model((per_gram[:, 1] - per_gram[:, 0]).astype(np.float32), float(params[2][1] - params[2][0]))


class _Words(Memo):
    """Word -> place of its log-odds in ``value``; new words get a place at once, a value later."""

    def __init__(self, model: Model, most: int = 1_000_000):
        super().__init__(most)
        self.model, self.new = model, []
        self.value = np.zeros(0, np.float32)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = out = len(self)
        return out

    def settle(self) -> None:
        if self.new:
            own, gram = ngrams(self.new)
            n = np.maximum(1, np.bincount(own, minlength=len(self.new)))
            more = np.bincount(own, self.model.gram[gram], len(self.new)) / n
            self.value = np.concatenate([self.value, more.astype(np.float32)])
            self.new = []

    def room(self, more: int) -> None:
        if len(self) + more > self.most:
            self.clear()
            self.value = self.value[:0]


def score_batch(texts: list[str], words: _Words) -> np.ndarray:
    """Probability of each whole text."""
    words.room(0)
    found = [np.fromiter(map(words.__getitem__, _WORD.findall(x.lower())), np.int64) for x in texts]
    words.settle()
    size = np.fromiter(map(len, found), np.int64, len(found))
    n_win = np.maximum(1, -(-size // WINDOW))
    first = np.cumsum(n_win) - n_win
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    total = int(n_win.sum())
    pair = np.unique((np.repeat(first, size) + place // WINDOW) << 32 | np.concatenate(found)) if len(place) else np.zeros(0, np.int64)
    win = pair >> 32
    mean = np.bincount(win, words.value[pair & 0xFFFFFFFF], total) / (np.bincount(win, minlength=total) + SMOOTH)
    top = np.maximum.reduceat(mean, first) if total else mean
    return 1 / (1 + np.exp(-(top + words.model.bias)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 2000) -> Model:
    """Fit on the whole texts of at most ``rows`` labelled documents of either class."""
    got = sample(docs, labels, label, rows).toPandas()
    return fit(got["text"].tolist(), got["label"].tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # BUCKETS floats, whatever the data

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(held.value)
        for b in by_size(batches):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(score_batch(b.column("text").to_pylist(), words), pa.float64())})

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(remainder(5) != 0))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
