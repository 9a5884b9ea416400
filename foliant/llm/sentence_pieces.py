"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Each text is escaped (a space becomes the meta symbol, one is put in front), cut where no piece of
the vocabulary can reach across, and every distinct chunk is merged once per worker by a
score-ordered agenda of adjacent symbol pairs.  Short chunks share one agenda held in arrays, from
which each takes its best pair in every round; long ones and those with characters outside the
vocabulary have a heap each.  In every Arrow batch the chunks met for the first time are checked
against the library; if they differ, the batch takes the library's ids.

Null and empty texts give the end id alone; texts of any length are encoded whole.  Repeated rows give repeated rows; other columns of
``docs`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Memo, documents, text_of

META = "▁"
NONE = 1 << 40
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
IDS = ", ids array<int>"
_held: dict[str, MergeVocabulary] = {}


class Chunks(Memo):
    """Chunk -> list of its ids; the list of a chunk not met before is empty until it is merged."""

    def __init__(self, most: int):
        super().__init__(most)
        self.missed: list[str] = []

    def __missing__(self, chunk: str) -> list[int]:
        if chunk:  # nothing stands between two cuts
            self.missed.append(chunk)
        self[chunk] = out = []
        return out

    def new(self) -> list[str]:
        out, self.missed = self.missed, []
        return out


class MergeVocabulary:
    """The pieces of one model with their merge order."""

    def __init__(self, path: str, most: int = 450_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, norm = pb.ModelProto.SentencePiece, model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a BPE model with the identity normaliser, a leading meta symbol and all spaces kept is needed")
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.scores = {p.piece: -p.score for p in model.pieces if p.type == kind.NORMAL}
        self.bytes = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = self.lib.eos_id()
        # Chunks end before a meta symbol and around newlines, as far as no piece reaches across.
        self.apart = not any(META in p.lstrip(META) or "\n" in p for p in self.ids)
        self.cut = re.compile(f"{META}*[^{META}\n]+|{META}+|\n" if self.apart else "(?s).+")
        self.memo = Chunks(most)
        self.names = [str(k) for k in range(len(model.pieces))]
        self.known = np.zeros(0x110000, np.int32)  # code point -> id, 0 where it is no piece
        for p, k in self.ids.items():
            if len(p) == 1:
                self.known[ord(p)] = k
        # Every way to make a piece of two: (left id << 20 | right id) -> piece.
        pairs = [(self.ids[p[:i]] << 20 | self.ids[p[i:]], k) for p, k in self.ids.items() for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids]
        self.pairs, self.made = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
        self.order = np.full(len(model.pieces) + 1, NONE, np.int64)  # merge order of each piece
        self.order[[self.ids[p] for p in sorted(self.ids, key=self.scores.get)]] = np.arange(len(self.ids))

    def merge(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk: best-scored adjacent pair first, leftmost among equals."""
        if chunk in self.ids and len(chunk) == 1:
            return (self.ids[chunk],)
        symbols: list[str | None] = list(chunk)
        n, scores, agenda = len(symbols), self.scores, []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((scores[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != len(pair):
                continue  # one side has been merged meanwhile
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (more := pair + symbols[k]) in scores:
                    heapq.heappush(agenda, (scores[more], i, more))
            if (h := before[i]) >= 0 and (more := symbols[h] + pair) in scores:
                heapq.heappush(agenda, (scores[more], h, more))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if (k := self.ids.get(s)) is not None:
                    out.append(k)
                else:
                    out.extend(self.bytes[b] for b in s.encode())
        return tuple(out)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or the number past all pieces."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], len(self.order) - 1)

    def merge_all(self, chunks: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of many chunks."""
        out = {}
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        sym = self.known[codes].astype(np.int64)
        own = np.repeat(np.arange(len(chunks)), size)
        alone = size > 64
        alone[own[sym == 0]] = True
        for k in np.flatnonzero(alone):
            out[chunks[k]] = self.merge(chunks[k])
        sym, own = sym[~alone[own]], own[~alone[own]]
        made = np.full(len(sym), len(self.order) - 1)
        at = np.flatnonzero(own[:-1] == own[1:])
        made[at] = self._pair(sym[at], sym[at + 1])
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.diff(own, prepend=-1))
            rank = self.order[made]
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(first, append=len(sym)))
            over = best == NONE
            if over.any():
                ended.append((own[over], sym[over]))
                sym, own, made, rank, best = (x[~over] for x in (sym, own, made, rank, best))
            at = np.flatnonzero(rank == best)
            at = at[np.diff(own[at], prepend=-1) != 0]  # the leftmost of each chunk
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, own, made = sym[keep], own[keep], made[keep]
            at -= np.arange(len(at))
            made[at] = len(self.order) - 1
            right = at[(at + 1 < len(sym)) & (own[np.minimum(at + 1, len(own) - 1)] == own[at])]
            made[right] = self._pair(sym[right], sym[right + 1])
            left = at[(at > 0) & (own[at - 1] == own[at])] - 1
            made[left] = self._pair(sym[left], sym[left + 1])
        if ended:
            own, sym = (np.concatenate(x) for x in zip(*ended))
            deal = np.argsort(own, kind="stable")
            own, ids = own[deal], sym[deal].tolist()
            first = np.flatnonzero(np.diff(own, prepend=-1))
            for k, a, b in zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(ids)]):
                out[chunks[k]] = tuple(ids[a:b])
        return out

    def agree(self, chunks: list[str]) -> bool:
        """One library call over the chunks, set one after another with newlines between; the first
        newline is there so that the library's own meta symbol stands alone."""
        if not chunks:
            return True
        want = [*self.merge(META), *self.merge("\n")]
        parts = [""]
        for c in chunks:
            parts.append(c)
            want += [*self.memo[c], *self.merge("\n")]
        return self.lib.encode("\n".join(parts).replace(META, " ") + "\n", num_threads=1) == want

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.apart or text[0] == " " or "  " in text or META in text or "\0" in text:
            return self.cut.findall(META + text.replace(" ", META))
        return (META + text.replace(" ", "\0" + META).replace("\n", "\0\n\0")).split("\0")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], bool]:
        """Ids of each text with the end id, and whether the library agreed on every new chunk."""
        memo = self.memo
        memo.room(0)
        found = [list(map(memo.__getitem__, self.chunks(x))) for x in texts]
        miss = memo.new()
        if miss:
            for x, ids in self.merge_all(miss).items():
                memo[x] += ids
        if not all(self.agree(miss[k : k + 100_000]) for k in range(0, len(miss), 100_000)):
            memo.clear()
            return self.lib.encode(texts, add_eos=True, num_threads=1), False
        out = [list(chain.from_iterable(x)) for x in found]
        for ids in out:
            ids.append(self.end)
        return out, True


def vocabulary(path: str) -> MergeVocabulary:
    if path not in _held:
        _held[path] = MergeVocabulary(path)
    return _held[path]


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def round_trip(docs: DataFrame, model_path: str, with_ids: bool = False, rows: int = 1000) -> DataFrame:
    """Per document the number and digest of its ids, and the digest of their decoding; on demand the
    ids themselves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                ids, agrees = v.encode(b.column("text").to_pylist())
                decoded = v.lib.decode(ids, num_threads=1)
                out = {
                    "doc_id": b.column("doc_id"),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": [_sha(" ".join(map(v.names.__getitem__, x))) for x in ids],
                    "decoded_sha256": [_sha(x) for x in decoded],
                    "agrees": pa.array([agrees] * len(ids), pa.bool_()),
                }
                yield pa.record_batch(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("string").alias("text")).mapInArrow(work, SCHEMA + IDS * with_ids)


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
