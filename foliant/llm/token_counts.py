"""Token counts through a digest cache.

The cache is a Parquet table ``(digest, tokenizer, n_tokens)``.  ``digest`` is the SHA-256 of the
text; for tokenizers that drop white space, runs of ASCII white space are made one space and the ends
trimmed first (their own normaliser does the same, so equal digests have equal counts).  ``tokenizer``
is the SHA-256 of the tokenizer file.  Documents are joined to the cache on both; each distinct digest
that misses is encoded once and appended.

Whether a tokenizer drops white space, folds case and cuts words as assumed here is read from its
file; texts for any other one are handed to the library whole.

Nulls count as empty texts (0 tokens).  Repeated rows give repeated rows.  Long texts are counted
whole.  An empty table gives an empty result.  Other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from foliant.llm.common import Memo, documents, exists, scratch, table, text_of

CACHE = StructType([StructField("digest", BinaryType()), StructField("tokenizer", StringType()), StructField("n_tokens", LongType())])

_ODD = re.compile("[\x1c-\x1f]")  # str.split() cuts here, the tokenizer does not
_STOP = re.compile(r"([a-z])([.,])(?=[ \n]|$)")
#: What a tokenizer file says if it drops white space, lower-cases and ends words at white space.
SPACELESS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPACELESS_CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_memo: dict[str, Memo] = {}
_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def drops_space(path: str) -> bool:
    """Whether the tokenizer of this file may be given chunks between white space instead of texts."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    same = (told.get("normalizer") or {}).get("normalizers") == SPACELESS and ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [None])[0] == SPACELESS_CUT
    return same and not told.get("post_processor") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in told.get("added_tokens", []))


def _chunks(text: str) -> list[str]:
    """The text cut at white space, which ends every token of a white-space-dropping vocabulary.
    Unless a special string may be there, ASCII letters are lower-cased as the vocabulary does, and
    a word's last comma or full stop, a token of its own, is cut off."""
    if "<|" not in text:
        text = _STOP.sub(r"\1 \2", text.encode().lower().decode())
    return re.split(r"[ \t-\r]+", text) if _ODD.search(text) else text.split()


def count_batch(texts: list[str], path: str, spaceless: bool, most: int = 1_200_000) -> list[int]:
    """Tokens of each text.  A worker encodes each distinct chunk once while its memo holds it."""
    if not spaceless:
        return [len(x) for x in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    memo = _memo.setdefault(path, Memo(most))
    cut = [_chunks(x) for x in texts]
    new: set[str] = set()
    for x in cut:
        new.update(x)
    memo.room(len(new))
    miss = [x for x in new if x not in memo]
    encode = _tokenizer(path).encode_batch_fast
    for k in range(0, len(miss), 50_000):
        part = miss[k : k + 50_000]
        memo.update(zip(part, map(len, encode(part, add_special_tokens=False))))
    return [sum(map(memo.__getitem__, x)) for x in cut]


def digest(col, spaceless: bool) -> F.Column:
    return F.unhex(F.sha2(F.btrim(F.regexp_replace(col, r"[ \t-\r]+", " ")) if spaceless else col, 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    held = spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)
    return held.where(F.col("tokenizer") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048, rows: int = 1000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``; ``cache_path`` gains the misses.
    ``tokenizer_path`` must be there on every executor."""
    add_counts(docs, tokenizer_path, cache_path, rows)
    return cached_counts(docs, tokenizer_path, cache_path, limit)


def _version(tokenizer_path: str) -> str:
    with open(tokenizer_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def cached_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """The counts of the rows whose texts the cache holds.  The join is of rows of a few bytes with one
    row a digest, so that Spark can split the copies of one text among tasks."""
    counts = table(read_cache(docs.sparkSession, cache_path, _version(tokenizer_path)).dropDuplicates(["digest"]), "token-counts")
    text, spaceless = text_of(), drops_space(tokenizer_path)
    sizes = docs.select("doc_id", digest(text, spaceless).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return sizes.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def add_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, rows: int = 1000) -> None:
    """Append the counts of the texts that the cache lacks."""
    spark, version, spaceless = docs.sparkSession, _version(tokenizer_path), drops_space(tokenizer_path)
    keyed = docs.select(text_of().alias("text")).select("text", digest(F.col("text"), spaceless).alias("digest"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                n = count_batch(b.column("text").to_pylist(), tokenizer_path, spaceless)
                yield pa.record_batch({"digest": b.column("digest"), "n_tokens": pa.array(n, pa.int64())})

    distinct = keyed.dropDuplicates(["digest"])
    missing = distinct.join(read_cache(spark, cache_path, version), "digest", "left_anti")
    found = missing.mapInArrow(encode, "digest binary, n_tokens long")
    found.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)

def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh cache for each call, so that every distinct text is encoded in it.  The documents come
    in two parts, as a corpus grows: texts of the second that the first had are found in the cache."""
    import public_tokenizers

    docs, path, cache = documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "token-cache")
    for part in (0, 1):
        add_counts(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part), path, cache)
    return cached_counts(docs, path, cache)
