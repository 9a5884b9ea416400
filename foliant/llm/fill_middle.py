"""Fill-in-middle transformation: texts cut in three at drawn places and put in another order.

Texts are cut into chunks where a rolling hash of their last ``WIDTH`` bytes asks for it, so that passages
which many documents share give the same chunks wherever they stand.  What is known of a chunk (its code
points, whether it holds one of the signs, its first and last two bytes) is kept by its content, and a
chunk that was met before is looked up and compared byte by byte.  The counts of a text's chunks, added up, give its length and the
chunk that a cut falls in; only that chunk's bytes are counted again.

Draws come from the hex sha256 of ``seed:doc_id``: h1 and h2 give the cuts, h3 whether the text stays
plain, h4 the order.  ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>``
middle.  Texts that hold a sign stay plain, so that a form's signs are its only ones and it can be undone.

Null and empty texts are plain and empty.  A null doc_id draws as an empty one.  Repeated rows come out
alike; texts of any length are taken whole, in batches bounded by bytes.  An empty table gives an empty result.
Columns other than ``doc_id`` and ``text`` are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Memo, documents, hex_sha, text_of

SIGNS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
WIDTH = 16  # bytes that decide where a chunk ends
SHIFT = 10  # chunks have 2^SHIFT bytes on average
LONGEST = 1 << 13  # bytes after which a chunk ends anyway
BATCH_BYTES = 4 << 20

_rng = np.random.default_rng(20250117)
_GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(texts: list[bytes]) -> list[np.ndarray]:
    """The ends of the chunks of each text, its length included.  The hash of a place is the sum of the
    table's values of the last WIDTH bytes, each shifted by its distance; it is built by doubling, for
    all texts together.  No chunk ends within the first WIDTH bytes, where the text before would count."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, span = _GEAR[data], 1
    while span < WIDTH:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    cuts = np.flatnonzero(h >> np.uint32(32 - SHIFT) == 0) + 1
    last = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    first = np.searchsorted(cuts, last, "left")
    out = []
    for at, end, i, j in zip([0, *last[:-1].tolist()], last.tolist(), [0, *first[:-1].tolist()], first.tolist()):
        ends = cuts[i:j] - at
        ends = np.append(ends[ends > WIDTH], end - at) if end > at else np.zeros(0, np.int64)
        gaps = ends - np.append(0, ends[:-1]) if len(ends) else ends
        if len(gaps) and gaps.max() > LONGEST:
            more = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[gaps > LONGEST], gaps[gaps > LONGEST])]
            ends = np.sort(np.concatenate((ends, *more)))
        out.append(ends)
    return out


#: Bytes that continue a code point.
_INNER = bytes(range(0x80, 0xC0))


def _signed(x: bytes) -> bool:
    return b"<" in x and any(s in x for s in SIGNS.values())


class Chunks(Memo):
    """Content of a chunk -> its summary; as a dict compares whole keys, a hash never stands for a chunk
    that it isn't.  Holds ``most`` entries and 8 times as many kilobytes at most."""

    def __missing__(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        out = len(chunk.translate(None, _INNER)), _signed(chunk), chunk[:2], chunk[-2:]
        self[chunk] = out
        return out


def summary(text: bytes, ends: list[int], memo: Chunks) -> tuple[np.ndarray, bool]:
    """Code points up to the end of each chunk, and whether the text holds a sign, also across chunks."""
    counts, signed, at, tail = [], False, 0, b""
    for end in ends:
        n, inside, head, last = memo[text[at:end]]
        counts.append(n)
        seam = tail + head
        signed = signed or inside or _signed(seam)
        tail = (tail + last)[-2:] if end - at < 2 else last
        at = end
    return np.cumsum(counts), signed


def place(text: bytes, ends: list[int], counts: np.ndarray, k: int) -> int:
    """The byte at which code point ``k`` begins; the length of the text where it is past the last."""
    i = int(np.searchsorted(counts, k, "right"))
    if i == len(counts):
        return len(text)
    first = ends[i - 1] if i else 0
    begins = np.flatnonzero((np.frombuffer(text, np.uint8, ends[i] - first, first) & 0xC0) != 0x80)
    return first + int(begins[k - (int(counts[i - 1]) if i else 0)])


def draws(key: str) -> tuple[int, int, int, int]:
    h = hashlib.sha256(key.encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform(text: bytes, ends: list[int], key: str, memo: Chunks, plain: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, those of prefix and middle, and the output of one text."""
    counts, signed = summary(text, ends, memo)
    n = int(counts[-1]) if len(counts) else 0
    h1, h2, h3, h4 = draws(key)
    if not n or signed or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y = place(text, ends, counts, a), place(text, ends, counts, b)
    prefix, middle, suffix = SIGNS["prefix"] + text[:x], SIGNS["middle"] + text[x:y], SIGNS["suffix"] + text[y:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, most: int = 20_000) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row; ``plain`` of a hundred texts
    stay as they are, ``spm`` of a hundred of the others have the suffix first.  A worker keeps ``most``
    chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Chunks(most)

        def out(ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
            rows = []
            for d, x, ends in zip(ids, texts, chunk_ends(texts)):
                memo.room(len(ends))
                rows.append(transform(x, ends.tolist(), f"{seed}:{'' if d is None else d}", memo, plain, spm))
            n, form, a, b, output = zip(*rows)
            return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "form": pa.array(form), "prefix_chars": pa.array(a, pa.int64()), "middle_chars": pa.array(b, pa.int64()), "output": pa.array(output, pa.binary()).cast(pa.string())})

        for whole in batches:
            ids, texts, size = [], [], 0
            for d, x in zip(whole.column("doc_id").to_pylist(), whole.column("text")):
                ids.append(d)
                texts.append(x.as_buffer().to_pybytes())
                size += len(texts[-1])
                if size > BATCH_BYTES:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield out(ids, texts)

    inner = docs.select(F.col("doc_id").cast("long"), text_of().cast("string").alias("text"))
    return inner.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made of: what stands between its three signs, in the old order."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hex_sha(F.col("output")).alias("output_sha256"), hex_sha(restored()).alias("restored_sha256"))


OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), read AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM read
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || t[b+1:] || '<M>' || t[a+1:b] ELSE '<S>' || t[b+1:] || '<P>' || t[1:a] || '<M>' || t[a+1:b] END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
