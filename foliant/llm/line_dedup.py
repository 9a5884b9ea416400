"""Exact line deduplication through sharded minimal perfect hashes.

The key of a line is the line stripped of ASCII white space with A-Z lower-cased; keys of at least
``least`` code points that two documents hold lose all their lines except in the smallest doc_id.

1. Documents are dealt into blocks of about ``block_docs`` rows or ``block_bytes`` bytes, whichever
   makes more; a block holds each of its distinct line hashes (128 bits) once, so that a line found
   everywhere is one row a block.
2. Hashes held by two documents or more go to shards of about ``shard_lines`` rows of the blocks, so
   that there are more shards, not larger ones, where there are more lines.  Each shard is one row: a
   minimal perfect hash over its line hashes and, at its slots, arrays of fingerprints, counts of the
   rows that hold the line, and owners.
3. The blocks' hashes probe the arrays of their shard; what is found returns to the block, whose
   documents drop the lines that another document owns.  Text is shuffled once, lines never.

A shard that very many blocks ask, as a line found everywhere makes them, is copied, and its blocks are
dealt to the copies.  A block that repeated rows have filled is cut into parts, which all get what was found for it.

A null or empty text is one empty line.  Rows with a null doc_id keep all lines and make no line a
copy; they go round the blocks.  Rows that repeat a doc_id count as one document.  A text of any length is one row of one
block.  An empty table gives an empty result.  Columns of the input named ``n_lines`` or ``n_dropped``
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import SPACES, documents, hex_sha, table

_STRIP = SPACES.encode()
_GAMMA = 2.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(a: np.ndarray, b: np.ndarray, level: int, slots: int) -> np.ndarray:
    step = np.uint64(2 * level + 1)
    return (_mix(a * step + b * np.uint64(0x9E3779B97F4A7C15) + step) % np.uint64(slots)).astype(np.int64)


def build_hash(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Minimal perfect hash over distinct 128-bit keys (two uint64 arrays): levels of bits.  At each
    level the keys alone in their slot set its bit, the others go on.  A key's index is the number
    of bits set before its own."""
    levels = []
    while len(a):
        slots = max(64, int(_GAMMA * len(a)))
        at = _place(a, b, len(levels), slots)
        alone = np.bincount(at, minlength=slots)[at] == 1
        bits = np.zeros(slots, bool)
        bits[at[alone]] = True
        levels.append(bits)
        a, b = a[~alone], b[~alone]
    return levels


def index_of(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of each key; some index or -1 for keys that are not in the hash."""
    out = np.full(len(a), -1, np.int64)
    left, before = np.arange(len(a)), 0
    for level, bits in enumerate(levels):
        at = _place(a[left], b[left], level, len(bits))
        hit = bits[at]
        out[left[hit]] = before + (np.cumsum(bits) - 1)[at[hit]]
        left, before = left[~hit], before + int(bits.sum())
    return out


def _keys(text: str | None, least: int) -> list[bytes | None]:
    """For each line the digest of its key, or None where the key is too short."""
    import xxhash

    out: list[bytes | None] = []
    for line in (text or "").encode().lower().split(b"\n"):
        key = line.strip(_STRIP)
        n = len(key)
        if n >= least and not key.isascii():
            n = len(key.decode())
        out.append(xxhash.xxh3_128_digest(key) if n >= least else None)
    return out


def _hashes(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, ids, held = [], [], []
            for block, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("block", "doc_id", "text"))):
                own = {k for k in _keys(text, least) if k}
                held += own
                blocks += [block] * len(own)
                ids += [doc_id] * len(own)
            pair = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
            yield pa.record_batch({"block": pa.array(blocks, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "a": pa.array(pair[:, 0]), "b": pa.array(pair[:, 1])})

    return work


def _as_keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(t.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))


def _build(t: pa.Table) -> pa.Table:
    a, b = _as_keys(t)
    levels = build_hash(a, b)
    at = index_of(levels, a, b)
    fingerprint, count, owner = np.empty((len(a), 2), np.uint64), np.empty(len(a), np.int64), np.empty(len(a), np.int64)
    fingerprint[at, 0], fingerprint[at, 1] = a, b
    count[at], owner[at] = t.column("n_docs").to_numpy(), t.column("owner").to_numpy()
    return pa.table(
        {
            "shard": t.column("shard").slice(0, 1),
            "slots": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
            "bits": pa.array([np.packbits(np.concatenate(levels)).tobytes()], pa.binary()),
            "fingerprints": pa.array([fingerprint.tobytes()], pa.binary()),
            "counts": pa.array([count.tobytes()], pa.binary()),
            "owners": pa.array([owner.tobytes()], pa.binary()),
        }
    )


def _probe(probes: pa.Table, shard: pa.Table) -> pa.Table:
    hits = pa.table({"block": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "owner": pa.array([], pa.int64()), "n_docs": pa.array([], pa.int64())})
    if not probes.num_rows or not shard.num_rows:
        return hits
    s = shard.to_pylist()[0]
    ends = np.cumsum(s["slots"])
    levels = np.split(np.unpackbits(np.frombuffer(s["bits"], np.uint8))[: ends[-1]].astype(bool), ends[:-1])
    fingerprint = np.frombuffer(s["fingerprints"], np.uint64).reshape(-1, 2)
    count, owner = np.frombuffer(s["counts"], np.int64), np.frombuffer(s["owners"], np.int64)
    a, b = _as_keys(probes)
    at = index_of(levels, a, b)
    found = np.flatnonzero((at >= 0) & (fingerprint[at, 0] == a) & (fingerprint[at, 1] == b))
    t, at = probes.take(found), at[found]
    return pa.table({"block": t.column("block"), "a": t.column("a"), "b": t.column("b"), "owner": owner[at], "n_docs": count[at]})


def _drop(least: int, n_columns: int, at_id: int, at_text: int):
    def work(docs: pa.Table, hits: pa.Table) -> pa.Table:
        digests = np.stack([hits.column(c).to_numpy() for c in ("a", "b")], 1).tobytes() if hits.num_rows else b""
        owner = {digests[16 * k : 16 * k + 16]: x for k, x in enumerate(hits.column("owner").to_pylist())}
        texts, n_lines, n_dropped = [], [], []
        for doc_id, text in zip(docs.column(f"c{at_id}").to_pylist(), docs.column(f"c{at_text}").to_pylist()):
            keys = _keys(text, least)
            stay = [k is None or doc_id is None or owner.get(k, doc_id) == doc_id for k in keys]
            gone = stay.count(False)
            texts.append("\n".join(x for x, s in zip((text or "").split("\n"), stay) if s) if gone else text)
            n_lines.append(len(keys))
            n_dropped.append(gone)
        out = {f"c{k}": docs.column(f"c{k}") for k in range(n_columns)}
        out |= {f"c{at_text}": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
        return pa.table(out)

    return work


def line_shards(docs: DataFrame, least: int, block_docs: int, block_bytes: int, shard_lines: int) -> tuple[DataFrame, DataFrame, Column]:
    """The blocks' distinct line hashes, the shards of lines that two documents hold, and the block of
    a document.  Rows of ``docs`` have a doc_id."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n_blocks = max(1, -(-n // block_docs), -(-(size or 0) // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block")
    lines = docs.select(block, F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_hashes(least), "block long, doc_id long, a long, b long")
    held = table(lines.groupBy("block", "a", "b").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n_docs")), "lines")
    n_shards = max(1, -(-held.count() // shard_lines))
    held = held.withColumn("shard", F.pmod("a", F.lit(n_shards)))
    shared = held.groupBy("shard", "a", "b").agg(F.min("owner").alias("owner"), F.max("last").alias("last"), F.sum("n_docs").alias("n_docs")).where("owner < last")
    shards = shared.groupBy("shard").applyInArrow(_build, "shard long, slots array<long>, bits binary, fingerprints binary, counts binary, owners binary")
    return held, table(shards, "line-shards"), block


def _beside(df: DataFrame, numbers: DataFrame, key: str, name: str, most: int = 100_000) -> DataFrame:
    """``df`` with the column ``name`` of ``numbers`` (key, name), 1 where they lack its key; they are sent to ``df`` if counted to be few."""
    few = numbers.count() <= most
    return df.join(F.broadcast(numbers) if few else numbers, key, "left").withColumn(name, F.coalesce(name, F.lit(1).cast("long")))


def dedup_lines(docs: DataFrame, least: int = 10, block_docs: int = 1000, block_bytes: int = 8 << 20, shard_lines: int = 1 << 17) -> DataFrame:
    """``docs`` with the copies of shared lines taken out of ``text``, and ``n_lines``, ``n_dropped``."""
    every = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")])
    docs = every.where("doc_id is not null")
    held, shards, block = line_shards(docs, least, block_docs, block_bytes, shard_lines)
    copies = held.groupBy("shard").agg(F.ceil(F.count("*") / (4 * shard_lines)).cast("long").alias("copies")).where("copies > 1")
    probes, shards = (x.withColumn("copies", F.lit(1)) if copies.isEmpty() else _beside(x, copies, "shard", "copies") for x in (held, shards))
    probes = probes.withColumn("copy", F.pmod(F.xxhash64("block"), F.col("copies").cast("long")))
    shards = shards.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)))
    hits = probes.groupBy("shard", "copy").cogroup(shards.groupBy("shard", "copy")).applyInArrow(_probe, "block long, a long, b long, owner long, n_docs long")

    size = F.greatest(F.count("*") / (4 * block_docs), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) / (4 * block_bytes))
    parts = docs.groupBy(block).agg(F.ceil(size).cast("long").alias("parts"), F.count("*").alias("n")).where("parts > 1 and n > 1").select("block", "parts")
    full = not parts.isEmpty()
    if full:
        docs = table(docs, "documents")  # read twice in the same order, so that a row keeps its part
    names = docs.columns
    fields = [f.dataType.simpleString() for f in docs.schema]
    inner = docs.select(block, *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.monotonically_increasing_id().alias("part"))
    if full:
        inner = _beside(inner, parts, "block", "parts").withColumn("part", F.pmod("part", "parts")).drop("parts")
        hits = _beside(hits, parts, "block", "parts").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    else:
        inner, hits = inner.withColumn("part", F.lit(0).cast("long")), hits.withColumn("part", F.lit(0).cast("long"))
    schema = ", ".join([*(f"c{k} {t}" for k, t in enumerate(fields)), "n_lines long, n_dropped long"])
    out = inner.groupBy("block", "part").cogroup(hits.groupBy("block", "part")).applyInArrow(_drop(least, len(names), names.index("doc_id"), names.index("text")), schema)
    out = out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "n_lines", "n_dropped")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    return out.unionByName(every.where("doc_id is null").withColumns({"n_lines": n_lines, "n_dropped": F.lit(0).cast("long")}))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", hex_sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


#: The same in DuckDB.
OP5_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM l
), s AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key)
GROUP BY doc_id
"""
