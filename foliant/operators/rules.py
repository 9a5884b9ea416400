"""Deterministic stand-ins for annotation models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.expr import ranked, strip
from foliant.functions.store import table
from foliant.operators.index import HELD, PACKED, PART, PARTS, Bm25Stats, bm25_stats, build_postings, by_parts, counted_tokens, ids_are_unique, mixed, packed, slices, term_marks, term_stats, together, top_terms, unpacked, with_terms
from foliant.operators.segment import WORDS, Words


def tfidf_keywords(postings: DataFrame, stats: Bm25Stats, k: int = 5) -> DataFrame:
    """``chunk_id, term, rank, weight``: the ``k`` terms of each chunk with the highest tf * idf, where
    idf is ln(n / df); ties by term."""
    weighed = with_terms(postings, table(term_stats(postings), "terms"), stats.n).withColumn("weight", F.col("tf") * F.log(F.lit(stats.n) / F.col("df")))
    return ranked(weighed, ["chunk_id"], "weight", "term", k).select("chunk_id", "term", "rank", "weight")


def chunk_keywords(chunks: DataFrame, k: int = 5, tokenizer: Words = WORDS) -> DataFrame:
    """``tfidf_keywords`` of chunks, whose terms are counted where they lie; only terms that few chunks hold are moved."""
    if not ids_are_unique(chunks):
        postings = build_postings(chunks, tokenizer=tokenizer, unique=False)
        return tfidf_keywords(postings, bm25_stats(chunks, postings), k)
    counted = counted_tokens(tokenizer.add(chunks.select("chunk_id", "text"), "text", "_t"))
    n = chunks.count()
    facts = table(counted.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    return top_terms(counted, facts.withColumn("each", F.log(F.lit(n) / F.col("df"))), k)


#: Words of a phrase stand in one run between other signs than letters, digits and spaces.
BREAK = r"[^\p{L}\p{N}_ ]+"


def _runs(text: str = "text") -> Column:
    """The words of each run that has two or more, lower-cased."""
    words = F.transform(F.split(F.lower(text), BREAK, -1), lambda s: F.filter(F.split(s, " +", -1), lambda w: w != ""))
    return F.filter(words, lambda w: F.size(w) > 1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that have ``runs``, in slices of about ``PART`` words."""
    for whole in batches:
        lists = whole.column("runs")
        inner = pc.list_value_length(lists.flatten()).to_numpy()
        ends = np.append(0, np.cumsum(inner))[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).astype(np.int64)]
        for at, upto in slices(np.diff(ends), PART):
            b = whole.slice(at, upto - at)
            yield b.filter(pc.greater(pc.list_value_length(b.column("runs")), 0))


MARK = 40  # bits by which phrases are told apart before their words are compared
MOST_BITS = 1 << 28  # of the marks of repeated phrases that tasks hold


def _marks(word: np.ndarray, run: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every size of a phrase where those of the size begin, and their marks, of the words' marks and runs."""
    so_far = word
    for k in range(2, min(longest, len(word)) + 1):
        n = len(word) - k + 1
        so_far = so_far[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + word[k - 1 :]
        place = np.flatnonzero(run[:n] == run[k - 1 :])
        yield k, place, mixed(so_far[place]) >> np.uint64(64 - MARK)


def _summed(marks: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct marks in order, and how often each is there, up to ``most``, of marks that are each followed by a number of 8 bits."""
    both = np.concatenate(marks)
    both.sort()
    mark = both >> np.uint64(8)
    first = np.flatnonzero(np.diff(mark, prepend=~mark[:1]))
    return mark[first], np.minimum(np.add.reduceat(both & np.uint64(255), first), np.uint64(most))


def repeated_marks(chunks: DataFrame, longest: int, least: int, n_bits: int) -> bytes:
    """Bits by the first bits of phrases' marks, set wherever a phrase occurs ``least`` times or more; some others are set too.  Tasks give out the sorted
    marks of their phrases as compressed differences, some 2 to 3 bytes a phrase, and how often each is there; of these only the ``n_bits`` go to the driver."""
    most, rest, seg = min(least, 255), MARK - PARTS.bit_length() + 1, n_bits // PARTS

    def pack(mark: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = (mark >> np.uint64(rest)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(PARTS + 1))
        low = (mark & np.uint64((1 << rest) - 1)).astype(np.uint32)
        full = np.flatnonzero(np.diff(cuts))
        held = []
        for p in full:
            own = low[cuts[p] : cuts[p + 1]]
            planes = np.diff(own, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
            held.append(pa.compress(planes.tobytes() + n[cuts[p] : cuts[p + 1]].astype(np.uint8).tobytes(), "zstd", asbytes=True))
        return pa.record_batch({"p": pa.array(full, pa.int32()), "n": pa.array(np.diff(cuts)[full], pa.int32()), "marks": pa.array(held, pa.binary())})

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, size = [], 0
        for b in _cut(batches):
            lists = b.column("runs").flatten()
            words = lists.flatten().dictionary_encode()
            run = np.repeat(np.arange(len(lists)), pc.list_value_length(lists))
            for _, _, mark in _marks(term_marks(words.dictionary)[words.indices.to_numpy()], run, longest):
                mark, n = np.unique(mark, return_counts=True)
                marks.append(mark << np.uint64(8) | np.minimum(n, most).astype(np.uint64))
                size += len(mark)
            if size > 4 * HELD:
                yield pack(*_summed(marks, most))
                marks, size = [], 0
        if size:
            yield pack(*_summed(marks, most))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows lie in the order of parts."""

        def bits(p: int, marks: list[np.ndarray]) -> pa.RecordBatch:
            mark, n = _summed(marks, most)
            own = np.zeros(seg, np.uint8)
            own[(mark[n >= most] >> np.uint64(rest - seg.bit_length() + 1)).astype(np.int64)] = 1
            return pa.record_batch({"p": pa.array([p], pa.int32()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

        at, marks = None, []
        for b in batches:
            for p, n, held in zip(b.column("p").to_pylist(), b.column("n").to_pylist(), b.column("marks")):
                if p != at and marks:
                    yield bits(at, marks)
                    marks = []
                at, raw = p, np.frombuffer(pa.decompress(held.as_buffer(), 5 * n, "zstd", asbytes=True), np.uint8)
                mark = np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).reshape(-1), dtype=np.uint64)
                marks.append(mark << np.uint64(8) | raw[4 * n :])
        if marks:
            yield bits(at, marks)

    given = chunks.select(_runs().alias("runs")).mapInArrow(give, "p int, n int, marks binary")
    got = by_parts(given).mapInArrow(join, "p int, bits binary").toArrow()  # of bounded size
    out = np.zeros((PARTS, seg // 8), np.uint8)
    for p, held in zip(got["p"].to_pylist(), got["bits"]):
        out[p] = np.frombuffer(held.as_buffer(), np.uint8)
    return out.tobytes()


def phrase_counter(longest: int = 3, repeated=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches ``chunk_id, runs``, ``chunk_id, terms`` of ``counted_phrases``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            lists = b.column("runs")
            run = np.repeat(np.arange(len(lists.flatten())), pc.list_value_length(lists.flatten()))
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists))[run]
            flat = lists.flatten().flatten()
            words = flat.dictionary_encode()
            code, n_words = words.indices.to_numpy().astype(np.int64), len(words.dictionary) + 1
            found = []
            for k, place, mark in _marks(term_marks(words.dictionary)[code], run, longest):
                if repeated is not None:
                    bits = np.frombuffer(repeated.value, np.uint8)
                    at = mark >> np.uint64(MARK + 1 - (8 * len(bits)).bit_length())
                    place = place[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
                same = code[place]
                for i in range(1, k):
                    same = np.unique(same * n_words + code[place + i], return_inverse=True)[1].astype(np.int64)
                _, first, times = np.unique(row[place] * (len(place) + 1) + same, return_index=True, return_counts=True)
                first = place[first]
                found.append((row[first], pc.binary_join_element_wise(*[flat.take(pa.array(first + i)) for i in range(k)], " "), times))
            of = np.concatenate([r for r, _, _ in found]) if found else np.zeros(0, np.int64)
            order = np.argsort(of, kind="stable")
            phrases = pa.concat_arrays([p for _, p, _ in found] or [pa.array([], pa.string())]).take(pa.array(order))
            times = pa.array(np.concatenate([t for _, _, t in found])[order] if found else [], pa.int64())
            cuts = np.searchsorted(of[order], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.record_batch({"chunk_id": b.column("chunk_id"), "terms": pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([phrases, times], ["term", "tf"]))})

    return work


def counted_phrases(chunks: DataFrame, longest: int = 3, repeated=None) -> DataFrame:
    """``chunk_id, terms array<struct<term, tf>>``: every run of 2 to ``longest`` words of each row, lower-cased, with its number there, counted where the row lies.
    With ``repeated``, a broadcast of ``repeated_marks``, those that occur too seldom are left out (but for some)."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", _runs().alias("runs")).mapInArrow(phrase_counter(longest, repeated), f"chunk_id {kind}, terms array<struct<term:string,tf:bigint>>")


def _numbers(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Of rows ``term, tf``, in packed parts, how often each term stands in all of them, and in how many."""
    for rows in together(tables):
        got = rows.group_by("term").aggregate([("tf", "sum"), ("tf", "count")])
        yield packed(got.select(["term", "tf_sum", "tf_count"]).rename_columns(["term", "f", "df"]))


def phrase_candidates(chunks: DataFrame, longest: int = 3, unique: bool | None = None, repeated=None, numbers: bool = False) -> DataFrame:
    """``chunk_id, phrase, size, tf``: every run of 2 to ``longest`` words, lower-cased, with its number in the chunk.  Only where a chunk_id stands
    more than once are counts moved.  ``repeated`` as in ``counted_phrases``.  With ``numbers``, the numbers of the phrases over many rows instead, packed for ``phrase_weights`` by the
    worker that counts them; chunk_ids must be unique."""
    if numbers:
        counter = phrase_counter(longest, repeated)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _numbers(pa.Table.from_struct_array(b.column("terms").flatten()) for b in counter(batches))

        return chunks.select("chunk_id", _runs().alias("runs")).mapInArrow(work, PACKED)
    rows = counted_phrases(chunks, longest, repeated).select("chunk_id", F.explode("terms").alias("_e")).select("chunk_id", F.col("_e.term").alias("phrase"), F.col("_e.tf").alias("tf"))
    if not (ids_are_unique(chunks) if unique is None else unique):
        rows = rows.groupBy("chunk_id", "phrase").agg(F.sum("tf").alias("tf"))
    return rows.select("chunk_id", "phrase", F.size(F.split("phrase", " ")).alias("size"), "tf")


def phrase_weights(candidates: DataFrame, least: int = 2) -> DataFrame:
    """``phrase, size, f, df, c_value`` of the phrases that occur ``least`` times or more.  The C-value is log2(size + 1) times how often the
    phrase stands by itself: its number, less the mean number of the longer phrases that hold it.  ``candidates`` are those of ``phrase_candidates``, or their numbers."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _numbers(pa.Table.from_batches([b]) for b in batches)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (rows,) in unpacked(batches, kind):
            got = rows.group_by("term").aggregate([("f", "sum"), ("df", "sum")])
            got = got.filter(pc.greater_equal(got["f_sum"], least)).select(["term", "f_sum", "df_sum"]).rename_columns(["phrase", "f", "df"])
            yield from got.to_batches()

    kind = pa.schema([("term", pa.string()), ("f", pa.int64()), ("df", pa.int64())])
    given = candidates if "held" in candidates.columns else candidates.select(F.col("phrase").alias("term"), "tf").mapInArrow(give, PACKED)
    counted = by_parts(given).mapInArrow(join, "phrase string, f long, df long")
    counted = table(counted.select("phrase", F.size(F.split("phrase", " ")).alias("size"), "f", "df"), "phrases")
    words = F.split("phrase", " ")
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))))
    held = counted.where("size > 2").select(F.explode(parts).alias("phrase"), F.col("f").alias("fl")).groupBy("phrase").agg((F.sum("fl") / F.count("*")).alias("nested"))
    # No phrase holds one of the greatest size.
    top = counted.agg(F.max("size")).first()[0] or 2
    met = counted.where(F.col("size") < top).join(held, "phrase", "left").unionByName(counted.where(F.col("size") >= top).withColumn("nested", F.lit(None).cast("double")))
    return met.withColumn("c_value", F.log2(F.col("size") + 1) * (F.col("f") - F.coalesce("nested", F.lit(0.0)))).drop("nested")


def phrase_labels(chunks: DataFrame, k: int = 5, longest: int = 3, least: int = 2) -> DataFrame:
    """``chunk_id, phrase, rank, weight``: up to ``k`` labels of several words for each chunk, the phrases of the greatest
    tf * (C-value / number) * ln(chunks / chunks with it); those of no weight are none.  Ties by phrase.  Phrases are counted where
    the chunks lie, and most of those that occur less than ``least`` times never leave them; one that many chunks hold is sent to them.  Null texts have no labels."""
    got = chunks.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("size")).first()
    n, unique = got["n"], ids_are_unique(chunks)
    n_bits = min(MOST_BITS, max(8 * PARTS, 1 << int(got["size"] or 0).bit_length()))
    repeated = chunks.sparkSession.sparkContext.broadcast(repeated_marks(chunks, longest, least, n_bits)) if 1 < least < 256 else None
    if unique:
        found = phrase_candidates(chunks, longest, unique, repeated, numbers=True)
        counted, counter = chunks.select("chunk_id", _runs().alias("runs")), phrase_counter(longest, repeated)
    else:
        found = table(phrase_candidates(chunks, longest, unique, repeated), "phrase-candidates")
        counted, counter = found.groupBy("chunk_id").agg(F.collect_list(F.struct(F.col("phrase").alias("term"), "tf")).alias("terms")), None
    weights = phrase_weights(found, least)
    # Those of no weight stay out of a chunk's best, whatever their number in it.
    each = F.when(F.col("c_value") > 0, F.col("c_value") / F.col("f") * F.log(F.lit(n) / F.col("df")))
    facts = table(weights.select(F.col("phrase").alias("term"), "df", each.alias("each")).where("each > 0"), "phrase-weights")
    return top_terms(counted, facts, k, floor=True, counter=counter).withColumnRenamed("term", "phrase")


def running_heads(pages: DataFrame, edge: int = 2, share: float = 0.3, least: int = 3) -> DataFrame:
    """``doc_name, place, line, n``: headers (``place`` 1, 2, ... from the top) and footers (-1, -2, ... from the end): lines that stand, digits folded
    to #, at the same place of ``share`` of a document's pages, on ``least`` pages or more.  ``pages``: doc_name, page_ord, text."""
    lines = _edge_lines(pages, edge)
    count = pages.groupBy("doc_name").agg(F.count("*").alias("pages"))
    often = lines.groupBy("doc_name", "place", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    same = often["doc_name"].eqNullSafe(count["doc_name"])
    return often.join(count, same).where(F.col("n") >= share * F.col("pages")).select(often["doc_name"], "place", "line", "n")


def _folded(line: Column) -> Column:
    return F.regexp_replace(strip(line), "[0-9]+", "#")


def _shown(text: Column) -> Column:
    """The lines of a page that are not blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: strip(x) != "")


def _edge_lines(pages: DataFrame, edge: int) -> DataFrame:
    shown = _shown(F.col("text"))
    places = F.array(*[F.struct(F.lit(p).alias("place"), _folded(F.try_element_at("_l", F.lit(p))).alias("line")) for k in range(1, edge + 1) for p in (k, -k)])
    rows = pages.select("doc_name", shown.alias("_l")).where("size(_l) > 0")
    return rows.select("doc_name", F.explode(places).alias("x")).select("doc_name", "x.place", "x.line").where("line is not null")


def drop_running_heads(pages: DataFrame, edge: int = 2, share: float = 0.3, least: int = 3) -> DataFrame:
    """Pages without their running headers and footers; from the outside in, a line goes only if all outside of it went.
    Pages without any keep their text as it is.  Null texts stay null."""
    heads = running_heads(pages, edge, share, least)
    by_doc = heads.groupBy("doc_name").agg(F.collect_set(F.struct("place", "line")).alias("_heads")).withColumnRenamed("doc_name", "_d")  # at most 2 * edge / share lines a document
    met = pages.join(by_doc, F.col("doc_name").eqNullSafe(F.col("_d")), "left").drop("_d")
    shown = _shown(F.col("text"))
    met = met.withColumn("_l", F.when(F.col("_heads").isNotNull(), shown))

    def gone(sign: int) -> Column:
        out = F.lit(0)
        for k in range(edge, 0, -1):
            hit = F.array_contains("_heads", F.struct(F.lit(sign * k).alias("place"), _folded(F.try_element_at("_l", F.lit(sign * k))).alias("line")))
            out = F.when(F.coalesce(hit, F.lit(False)), 1 + out).otherwise(0)
        return out

    met = met.withColumns({"_top": gone(1), "_end": gone(-1)})
    left = F.slice("_l", F.col("_top") + 1, F.greatest(F.lit(0), F.size("_l") - F.col("_top") - F.col("_end")))
    text = F.when(F.coalesce(F.col("_top") + F.col("_end") > 0, F.lit(False)), F.array_join(left, "\n")).otherwise(F.col("text"))
    return met.withColumn("text", text).select(*pages.columns)


def is_meaningful_rule(text: Column | str = "text", least_chars: int = 20, least_words: int = 4, letters: float = 0.5) -> Column:
    """False for null or blank texts, fragments, and texts that are mostly not letters (page headers,
    figure numbers, rules of signs)."""
    t = strip(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    n = F.length(t)
    words = F.size(F.regexp_extract_all(t, F.lit(r"[\p{L}]+"), F.lit(0)))
    share = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(n, F.lit(1))
    return (n >= least_chars) & (words >= least_words) & (share >= letters)
