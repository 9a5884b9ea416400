"""Index tables: chunks, postings, phrases, questions, and their checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliant.functions.constants import EPSILON
from foliant.functions.expr import SPACE, ranked, strip
from foliant.functions.store import table
from foliant.operators.segment import WORDS, Words


RANGES = 256  # of the order by which chunks without an id are numbered


def select_indexable(chunks: DataFrame, order: str | None = None) -> DataFrame:
    """Meaningful chunks (by default) with text, stripped, with defaults for what is missing.  An id is
    made of the number of accepted chunks before, in the order of ``order``; chunks with ids need no
    ordering, and only those without are numbered in one place."""
    have = set(chunks.columns)
    col = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), default) if c in have else default
    empty = F.array().cast("array<string>")
    out = chunks.withColumn("text", strip(F.coalesce("text", F.lit("")))).where(col("is_meaningful", "boolean", F.lit(True)) & (F.col("text") != ""))
    out = out.withColumns(
        {
            "doc_name": col("doc_name", "string", F.lit("unknown_doc")),
            "page_number": col("page_number", "int", F.lit(-1)),
            "keyword_summaries": col("keyword_summaries", "array<string>", empty),
            "generated_questions": col("generated_questions", "array<string>", empty),
            "chunk_id": F.col("chunk_id").cast("string") if "chunk_id" in have else F.lit(None).cast("string"),
        }
    )
    if order is None:
        return out.where("chunk_id is not null") if "chunk_id" in have else out
    # Numbers by ranges of ``order``: cuts from a bounded sample, counts of the ranges (as many as cuts)
    # on the driver, row numbers within a range; no task sees all rows, and no two plans must agree.
    sample = sorted(r[0] for r in out.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order), order).limit(16 * RANGES).collect())
    cuts = sorted(set(sample[:: max(1, len(sample) // RANGES)]))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    dealt = out.withColumn("_p", F.when(F.col(order).isNull(), -1).otherwise(at))
    before, n = [], 0
    for p, c in sorted(tuple(r) for r in dealt.groupBy("_p").count().collect()):
        before.append((p, n))
        n += c
    start = F.create_map(*[F.lit(x) for pair in before for x in pair])[F.col("_p")] if before else F.lit(0)
    numbered = dealt.withColumn("_n", start + F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    return numbered.withColumn("chunk_id", F.coalesce("chunk_id", F.concat(F.lit("auto_id_"), F.col("_n").cast("string")))).drop("_p", "_n")


PART = 1 << 18  # tokens that are counted together, but for a chunk that has more


def _token_pairs(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray, np.ndarray]:
    """Distinct (row, token) pairs of an array column in the order of rows, the tokens as places in the distinct ones, and how often each pair is there."""
    flat = tokens.flatten().dictionary_encode(null_encoding="encode")
    known, n = flat.dictionary, max(1, len(flat.dictionary))
    keys = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens)) * n + flat.indices.to_numpy()
    pairs, times = np.unique(keys, return_counts=True)
    return pairs // n, pairs % n, known, times


def _count_tokens(tokens: pa.ListArray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Distinct (row, token) pairs of an array column in the order of rows, and how often each is there."""
    row, place, known, times = _token_pairs(tokens)
    return row, known.take(pa.array(place)), times


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` tokens together."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, upto
        at = upto


def counted_tokens(rows: DataFrame) -> DataFrame:
    """``chunk_id, dl, terms array<struct<term, tf>>`` of rows ``chunk_id, _t`` (an array of tokens), counted where they lie: rows without tokens are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pc.greater(pc.list_value_length(whole.column("_t")), 0))
            sizes = pc.list_value_length(whole.column("_t")).to_numpy(zero_copy_only=False)
            for at, upto in slices(sizes, PART):
                b = whole.slice(at, upto - at)
                row, terms, times = _count_tokens(b.column("_t"))
                ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([terms, pa.array(times, pa.int64())], ["term", "tf"]))
                yield pa.record_batch({"chunk_id": b.column("chunk_id"), "dl": pa.array(sizes[at:upto], pa.int64()), "terms": held})

    kind = rows.schema["chunk_id"].dataType.simpleString()
    return rows.select("chunk_id", "_t").mapInArrow(work, f"chunk_id {kind}, dl long, terms array<struct<term:string,tf:bigint>>")


def search_counts(chunks: DataFrame, asked: DataFrame, tokenizer: Words = WORDS, unique: bool | None = None, most: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """What a search for the terms of ``asked`` (term) needs of the chunks, from one reading of their texts: ``chunk_id, dl, terms`` (array<struct<term, tf>>) with the asked
    terms of each chunk that has some, and ``term, df, tf`` of all terms, in parts that are to be added up.  Both are read from one table, where the chunks of a task
    put their counts of all terms together.  Repeated chunk_ids (looked up, unless ``unique`` says that there are none) and more than ``most`` asked terms go by ``build_postings``."""
    unique = ids_are_unique(chunks) if unique is None else unique
    names = asked.select("term").distinct().limit(most + 1).toArrow()["term"].combine_chunks()  # of bounded size
    if not unique or len(names) > most:
        p = build_postings(chunks, tokenizer=tokenizer, unique=unique)
        held = table(p.join(table(asked.select("term").distinct(), "asked-terms"), "term", "left_semi").select(p.columns), "postings")
        return by_chunk(held), term_stats(p, counts=True)
    sent = chunks.sparkSession.sparkContext.broadcast(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pc.greater(pc.list_value_length(whole.column("_t")), 0))
            sizes = pc.list_value_length(whole.column("_t")).to_numpy(zero_copy_only=False)
            for at, upto in slices(sizes, PART):
                b = whole.slice(at, upto - at)
                row, place, known, times = _token_pairs(b.column("_t"))
                df, tf = np.bincount(place, minlength=len(known)), np.bincount(place, times, len(known)).astype(np.int64)
                ends = np.append(np.arange(0, len(known), 256), len(known))  # short rows, of which a reader holds thousands
                yield _counted(pa.nulls(len(ends) - 1, b.column("chunk_id").type), [None] * (len(ends) - 1), ends, known, tf, df)
                keep = pc.is_in(known, value_set=sent.value).to_numpy(zero_copy_only=False)[place]
                row, place, times = row[keep], place[keep], times[keep]
                rows = np.unique(row)
                ends = np.append(np.searchsorted(row, rows), len(row))
                yield _counted(b.column("chunk_id").take(pa.array(rows)), sizes[at:upto][rows], ends, known.take(pa.array(place)), times, np.ones(len(row), np.int64))

    rows = tokenizer.add(chunks.select("chunk_id", "text"), "text", "_t")
    kind = rows.schema["chunk_id"].dataType.simpleString()
    both = table(rows.select("chunk_id", "_t").mapInArrow(work, f"chunk_id {kind}, dl long, terms array<struct<term:string,tf:bigint,df:bigint>>"), "counts")
    parts = both.where("dl is null").select(F.explode("terms").alias("_e")).select("_e.term", "_e.df", "_e.tf")
    return both.where("dl is not null"), parts


def _counted(ids: pa.Array, dl, ends, terms: pa.Array, tf: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([terms, pa.array(tf, pa.int64()), pa.array(df, pa.int64())], ["term", "tf", "df"]))
    return pa.record_batch({"chunk_id": ids, "dl": pa.array(dl, pa.int64()), "terms": held})


def by_chunk(postings: DataFrame) -> DataFrame:
    """``chunk_id, terms array<struct<term, tf, dl>>`` of postings, a row a chunk_id."""
    return postings.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf", "dl")).alias("terms"))


def by_term(counted: DataFrame, *also: str) -> DataFrame:
    """Postings ``chunk_id, term, tf, dl`` of rows ``chunk_id, terms``, with ``dl`` beside or within the terms, and the columns ``also`` of the rows."""
    own = F.col("dl") if "dl" in counted.columns else F.col("_e.dl")
    return counted.select("*", F.explode("terms").alias("_e")).select(*also, "chunk_id", "_e.term", "_e.tf", own.alias("dl"))


def ids_are_unique(chunks: DataFrame) -> bool:
    return chunks.groupBy("chunk_id").count().where("count > 1").isEmpty()


def build_postings(chunks: DataFrame, tokens: Column | None = None, tokenizer: Words = WORDS, unique: bool | None = None) -> DataFrame:
    """``chunk_id, term, tf, dl``: term counts of every chunk beside the chunk's length, counted where the
    chunk lies, without a shuffle.  Only where a chunk_id stands more than once (looked up, unless ``unique`` says it) are counts put together.
    A search must be given the same ``tokenizer``; ``tokens`` is an array column that is there already."""
    rows = tokenizer.add(chunks.select("chunk_id", "text"), "text", "_t") if tokens is None else chunks.select("chunk_id", tokens.alias("_t"))
    unique = ids_are_unique(chunks) if unique is None else unique
    out = counted_tokens(rows).select("chunk_id", "dl", F.explode("terms").alias("_e")).select("chunk_id", "_e.term", "_e.tf", "dl")
    return out if unique else out.groupBy("chunk_id", "term", "dl").agg(F.sum("tf").alias("tf")).select("chunk_id", "term", "tf", "dl")


@dataclass
class Bm25Stats:
    """Number of chunks, mean length (chunks without tokens count) and the floor of negative idf."""

    n: int
    avgdl: float
    floor: float

    def idf(self, df: Column) -> Column:
        raw = F.log(F.lit(self.n) - df + 0.5) - F.log(df + 0.5)
        return F.when(raw < 0, F.lit(self.floor)).otherwise(raw)


def term_stats(postings: DataFrame, counts: bool = False) -> DataFrame:
    """``term, df``, and with ``counts`` ``tf``, how often the term stands in all chunks."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), *([F.sum("tf").alias("tf")] if counts else []))


def with_terms(postings: DataFrame, terms: DataFrame, n: int, share: float = 1e-3) -> DataFrame:
    """Postings joined to ``terms`` (term, df and more, read more than once).  Terms that more than ``share``
    of the ``n`` chunks hold are split among tasks by chunk; every other one has few rows."""
    often = F.col("df") > F.lit(max(1.0, share * n))
    salts = 64
    hot = terms.where(often).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = postings.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int"))
    return postings.join(terms.where(~often), "term").unionByName(spread.join(hot, ["term", "_salt"]).drop("_salt"))


def term_marks(terms: pa.StringArray) -> np.ndarray:
    """64 bits of each term: a polynomial of its bytes."""
    out = np.zeros(len(terms), np.uint64)
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64) if len(terms) else np.zeros(1, np.int64)
    sizes = np.diff(ends)
    for at, upto in slices(sizes, PART):
        own, begin = sizes[at:upto], ends[at:upto] - ends[at]
        if own.any():
            letters = np.frombuffer(terms.buffers()[2], np.uint8)[ends[at] : ends[upto]].astype(np.uint64) + np.uint64(1)
            power = np.cumprod(np.full(own.max(), 0x9E3779B97F4A7C15, np.uint64))
            out[at:upto][own > 0] = np.add.reduceat(letters * power[np.arange(len(letters)) - np.repeat(begin, own)], begin[own > 0])
    return out


def mixed(marks: np.ndarray) -> np.ndarray:
    """Marks of which every bit depends on all."""
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        marks = (marks ^ (marks >> np.uint64(shift))) * np.uint64(times)
    return marks ^ (marks >> np.uint64(32))


PARTS = 1024  # of terms, by the first bits of their marks
HELD = 1 << 19  # entries that a task puts together before it gives them out
PACKED = "p int, kind int, held binary"


def packed(rows: pa.Table, kind: int = 0) -> pa.RecordBatch:
    """``p, kind, held``: the rows of each part of their ``term``, in the order of terms, as compressed Arrow: half of what rows of their own take in a shuffle."""
    rows = rows.combine_chunks()
    part = (mixed(term_marks(_whole(rows["term"]))) >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int16)
    order = pc.sort_indices(rows["term"]).to_numpy()
    order = order[np.argsort(part[order], kind="stable")]
    cuts = np.searchsorted(part[order], np.arange(PARTS + 1))
    full, rows, held = np.flatnonzero(np.diff(cuts)), rows.take(pa.array(order)).combine_chunks(), []
    for p in full:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.slice(cuts[p], cuts[p + 1] - cuts[p]))
        held.append(sink.getvalue().to_pybytes())
    return pa.record_batch([pa.array(full, pa.int32()), pa.array(np.full(len(full), kind), pa.int32()), pa.array(held, pa.binary())], ["p", "kind", "held"])


def unpacked(batches: Iterator[pa.RecordBatch], *kinds: pa.Schema) -> Iterator[list[pa.Table]]:
    """For each part, the rows of each kind together.  Rows ``p, kind, held`` come in the order of parts."""
    at, got = None, [[] for _ in kinds]
    whole = lambda: [pa.Table.from_batches(x, schema).combine_chunks() for x, schema in zip(got, kinds)]
    for b in batches:
        for p, kind, held in zip(b.column("p").to_pylist(), b.column("kind").to_pylist(), b.column("held")):
            if p != at and any(got):
                yield whole()
                got = [[] for _ in kinds]
            at = p
            got[kind] += pa.ipc.open_stream(held.as_buffer())
    if any(got):
        yield whole()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    got = column.combine_chunks()
    return pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got


def by_parts(rows: DataFrame) -> DataFrame:
    """Rows of ``packed`` in the order of their parts, each in one place."""
    return rows.repartition("p").sortWithinPartitions("p")


def top_terms(counted: DataFrame, facts: DataFrame, k: int, most: int = 200_000, floor: bool = False, counter: Callable | None = None) -> DataFrame:
    """``chunk_id, term, rank, weight``: the ``k`` terms of each chunk with the greatest tf * each (ties by term), of ``counted`` (chunk_id, terms
    array<struct<term, tf>>, a row a chunk) and ``facts`` (term, df, each; read twice).  The ``most`` terms that most chunks hold go to the chunks, and of these only what can be among a chunk's
    best leaves its task; the rest, each in few chunks, meet their facts by term, in packed parts.  With ``floor``, weights that round to 0 are none.
    With a ``counter``, ``counted`` are batches (chunk_id and more) of which it makes such rows, in the worker that goes on with them."""
    order = [F.desc("df"), F.asc("term")]
    often = facts.orderBy(*order).limit(most).select("term", "df", "each").toArrow()  # of bounded size
    held = facts.sparkSession.sparkContext.broadcast((often["term"].combine_chunks(), often["each"].to_numpy()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        names, values = held.value
        each = np.append(values, np.nan)
        for whole in batches:
            sizes = pc.list_value_length(whole.column("terms")).to_numpy(zero_copy_only=False)
            for at, upto in slices(sizes, PART):
                b = whole.slice(at, upto - at)
                entries = b.column("terms").flatten()
                terms, tf = entries.field("term"), entries.field("tf").to_numpy()
                place = pc.fill_null(pc.index_in(terms, value_set=names), len(values)).to_numpy()
                row, weight = np.repeat(np.arange(b.num_rows), sizes[at:upto]), tf * each[place]
                first = np.lexsort((-weight, row))  # unknown weights come last
                rank = np.arange(len(row)) - np.searchsorted(row, row)[first]
                least = np.full(b.num_rows, -np.inf)
                last = first[(rank == k - 1) & ~np.isnan(weight[first])]
                least[row[last]] = weight[last]
                keep = np.flatnonzero(np.isnan(weight) | (weight >= least[row] - 1e-6))
                known = place[keep] < len(values)
                yield pa.table({"chunk_id": b.column("chunk_id").take(pa.array(row[keep])), "term": terms.take(pa.array(keep)), "tf": pa.array(tf[keep]), "each": pa.array(each[place[keep]], pa.float64(), mask=~known)})

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in together(cut(batches if counter is None else counter(batches))):
            yield packed(rows, 1)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in together(pa.Table.from_batches([b]) for b in batches):
            yield packed(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, rows in unpacked(batches, known, asked):
            if not len(rows):
                continue
            place = pc.fill_null(pc.index_in(_whole(rows["term"]), value_set=_whole(few["term"])), len(few)).to_numpy()
            each = np.where(np.isnan(rows["each"].to_numpy()), np.append(few["each"].to_numpy(), np.nan)[place], rows["each"].to_numpy())
            weight = rows["tf"].to_numpy() * each
            keep = pa.array(np.flatnonzero(~np.isnan(weight)))
            yield from rows.select(["chunk_id", "term"]).append_column("weight", pa.array(weight)).take(keep).to_batches()

    kind = counted.schema["chunk_id"].dataType.simpleString()
    known = pa.schema([("term", pa.string()), ("each", pa.float64())])
    asked = pa.schema([("chunk_id", to_arrow_type(counted.schema["chunk_id"].dataType)), ("term", pa.string()), ("tf", pa.int64()), ("each", pa.float64())])
    both = facts.select("term", "each").mapInArrow(tell, PACKED).unionByName((counted if counter else counted.select("chunk_id", "terms")).mapInArrow(give, PACKED))
    met = by_parts(both).mapInArrow(meet, f"chunk_id {kind}, term string, weight double")
    met = met.where("round(weight, 9) > 0") if floor else met
    return ranked(met, ["chunk_id"], "weight", "term", k).select("chunk_id", "term", "rank", "weight")


def together(tables: Iterator[pa.Table], most: int | None = None) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows (``HELD``) out of smaller ones."""
    held, size, most = [], 0, most or HELD
    for t in tables:
        held.append(t)
        size += len(t)
        if size >= most:
            yield pa.concat_tables(held)
            held, size = [], 0
    if size:
        yield pa.concat_tables(held)


def bm25_stats(chunks: DataFrame, postings: DataFrame, epsilon: float = EPSILON) -> Bm25Stats:
    """Three numbers over the whole corpus, in one pass over the postings, or over their ``term_stats`` with counts, whole or in parts; nothing else comes to the
    driver."""
    n = chunks.count()
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = postings.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")) if "df" in postings.columns else term_stats(postings, counts=True)
    got = terms.agg(F.avg(raw).alias("mean"), F.sum("tf").alias("total")).first()
    return Bm25Stats(n, (got["total"] or 0) / n if n else 0.0, epsilon * (got["mean"] or 0.0))


def phrase_dictionary(chunks: DataFrame) -> DataFrame:
    """``phrase``: distinct stripped phrases that are not blank."""
    return chunks.select(F.explode("keyword_summaries").alias("p")).select(strip("p").alias("phrase")).where("phrase <> ''").distinct()


def phrase_index(phrases: DataFrame) -> DataFrame:
    """Postings of phrases, whose tokens are cut at white space: ``chunk_id`` is the phrase."""
    tokens = F.filter(F.split("text", f"{SPACE}+"), lambda t: t != "")
    return build_postings(phrases.select(F.col("phrase").alias("chunk_id"), F.col("phrase").alias("text")), tokens, unique=True).withColumnRenamed("chunk_id", "phrase")


def question_index(chunks: DataFrame) -> DataFrame:
    """``chunk_id, pos, question``: every question that is not blank, stripped, repeats kept."""
    rows = chunks.select("chunk_id", F.posexplode("generated_questions").alias("pos", "q"))
    return rows.select("chunk_id", "pos", strip("q").alias("question")).where("question <> ''")


def check_index(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, question_vectors: DataFrame) -> DataFrame:
    """``check_name, n, severity, example``: how many rows offend each rule, and the least chunk_id among them; 0 everywhere is a
    sound index.  Only the keys of the four tables are read; they are counted together by (chunk_id, pos), then by
    chunk_id, so that no table is read or shuffled twice.  A null key belongs to nothing."""
    kinds = ["c", "v", "q", "w"]

    def keys(df: DataFrame, kind: str) -> DataFrame:
        pos = F.col("pos").cast("long") if kind in "qw" else F.lit(None).cast("long")
        return df.select(F.col("chunk_id").cast("string").alias("chunk_id"), pos.alias("pos"), *[F.lit(int(k == kind)).alias(k) for k in kinds])

    rows = keys(chunks, "c").unionByName(keys(vectors, "v")).unionByName(keys(questions, "q")).unionByName(keys(question_vectors, "w"))
    by_pos = rows.groupBy("chunk_id", "pos").agg(*[F.sum(k).alias(k) for k in kinds])
    alone = lambda a, b: F.sum(F.when(F.col("pos").isNull() | F.col("chunk_id").isNull() | (F.col(b) == 0), F.col(a)).otherwise(0))
    by_chunk = by_pos.groupBy("chunk_id").agg(alone("q", "w").alias("q_alone"), alone("w", "q").alias("w_alone"), *[F.sum(k).alias(k) for k in kinds])
    named, no_chunk = F.col("chunk_id").isNotNull(), F.col("chunk_id").isNull() | (F.col("c") == 0)
    rules = [
        ("chunk_without_id", "warning", F.when(~named, F.col("c"))),
        ("duplicate_chunk_id", "warning", F.when(named & (F.col("c") > 1), 1)),
        ("chunk_without_vector", "error", F.when(named & (F.col("v") == 0), F.col("c"))),
        ("vector_without_chunk", "error", F.when(no_chunk, F.col("v"))),
        ("question_without_vector", "error", F.col("q_alone")),
        ("vector_without_question", "error", F.col("w_alone")),
        ("question_without_chunk", "warning", F.when(no_chunk, F.col("q"))),
    ]
    found = by_chunk.agg(*[F.struct(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n"), F.min(F.when(n > 0, F.col("chunk_id"))).alias("example")).alias(name) for name, _, n in rules])
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("check_name"), F.col(name)["n"].alias("n"), F.lit(severity).alias("severity"), F.col(name)["example"].alias("example")) for name, severity, _ in rules]))
    return found.select(one.alias("r")).select("r.*")


def write_chunk_table(chunks: DataFrame, name: str, buckets: int = 200) -> DataFrame:
    """The chunks as a catalog table bucketed and sorted by chunk_id, read back: a ``lookup`` in it moves the rows that ask and no text."""
    chunks.repartition(buckets, "chunk_id").write.mode("overwrite").bucketBy(buckets, "chunk_id").sortBy("chunk_id").saveAsTable(name)
    return chunks.sparkSession.table(name)


def lookup(rows: DataFrame, chunks: DataFrame, order: str) -> DataFrame:
    """Rows joined to their chunk's columns; of repeated ids the last in ``order`` counts.  Chunks that
    nobody asks for go before anything is compared; in a table of ``write_chunk_table`` that happens where
    they lie."""
    others = [c for c in chunks.columns if c not in ("chunk_id", order)]
    wanted = rows.select("chunk_id").distinct()
    last = chunks.join(wanted, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max_by(F.struct(*others), order).alias("_m"))
    return rows.join(last, "chunk_id").select(*rows.columns, *[F.col(f"_m.{c}").alias(c) for c in others if c not in rows.columns])
