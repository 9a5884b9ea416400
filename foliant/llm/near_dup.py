"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components.

A document's set holds its distinct ``width``-word shingles (A-Z lower-cased, words cut at ASCII
white space); with fewer words the whole sequence is one shingle; without words it is empty and
linked with nothing.  Two permutations of the 32-bit universe make all coordinates: the first
shuffles the shingle, the second, circularly shifted by k, gives coordinate k.

1. One pass over the texts: set size, set digest, band keys, low bytes of the signature.
2. Documents with equal sets become one representative, numbered apart from doc_ids; the sets of one
   doc_id are linked.
3. Star round: in every bucket each representative is compared with the bucket's smallest.
4. Families: where a bucket still holds several components, those with members whose signatures agree
   by ``threshold`` less ``slack`` come together; only links that join something new are given out.
5. Closing round: the members of a family meet in blocks of bounded size, which hold their full sets
   and link every pair across components that is similar enough.  Members of one large component do
   not meet each other again, nor, in a family of more than one block, sets too different in size.

All links are confirmed on the full sets, recomputed from whole texts.

Rows with null text have empty sets.  Repeated doc_ids are one document in the components, whatever
their texts; each row comes back.  A null doc_id has a null component and is kept.  Empty tables give empty results.
A text of any length is taken whole, a very long one alone.  Ties go to the smaller id.  Columns of ``docs`` other
than ``doc_id`` and ``text`` are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import documents, table, text_of

ROWS = 5  # coordinates of a band
MISS = 1e-7  # chance that no band shows a pair at the threshold
BLOCK = 256  # representatives of one bucket or family in one block
SALT = 256  # partners of one representative that are verified together

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256).astype(np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 3
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> np.ndarray:
    """The first powers of the base, at least ``n``: the same ones whatever a worker has met before."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(max(n, 1024), _BASE % 2**64, np.uint64))
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, in order, and the number of words of each text."""
    parts = [x.encode().lower() for x in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    size = end - start
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in parts), np.int64, len(parts)))
    n_words = np.diff(np.searchsorted(start, ends), prepend=0)
    if not len(start):
        return np.zeros(0, np.uint64), n_words
    inside = np.flatnonzero(~space)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, size)
    value = _BYTE[data[inside]] * _power(int(size.max()))[place]
    return _mix(np.add.reduceat(value, first) + size.astype(np.uint64)), n_words


def shingle_sets(texts: list[str], width: int, most: int = 1 << 20) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.  Texts are taken together up to ``most``
    characters (one longer text alone), as their words need many times their size in memory."""
    out, at, size = [], 0, 0
    for k, x in enumerate(texts):
        if k > at and size + len(x) > most:
            out += _shingle_sets(texts[at:k], width)
            at, size = k, 0
        size += len(x)
    return out + _shingle_sets(texts[at:], width)


def _shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    words, n_words = word_hashes(texts)
    ends = np.cumsum(n_words)
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        whole += words[k : k + len(whole)] * _U(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1)
    whole = _mix(whole)
    out = []
    for end, n in zip(ends.tolist(), n_words.tolist()):
        if n >= width:
            s = np.sort(whole[end - n : end - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            short = sum(int(h) * (0x9E3779B97F4A7C15 * (2 * k + 1) | 1) for k, h in enumerate(words[end - n : end])) + n
            out.append(_mix(np.array([short % 2**64], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least pi(sigma(x) + k) over the set, sums modulo 2^32."""
    out = np.zeros((len(sets), coordinates), np.uint32)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    live = np.flatnonzero(size)
    ends = np.cumsum(size[live])
    groups = np.split(live, np.searchsorted(ends, np.arange(65_536, ends[-1] if len(ends) else 0, 65_536)))
    for g in groups:
        if not len(g):
            continue
        sigma = (np.concatenate([sets[k] for k in g]) * _U(0xD6E8FEB86659FD93) >> _U(32)).astype(np.uint32)
        first = np.concatenate(([0], np.cumsum(size[g])[:-1]))
        v, w = np.empty_like(sigma), np.empty_like(sigma)
        for k in range(coordinates):
            np.add(sigma, np.uint32(k), out=v)
            np.multiply(v, np.uint32(0x85EBCA6B), out=v)
            np.right_shift(v, np.uint32(15), out=w)
            np.bitwise_xor(v, w, out=v)
            np.multiply(v, np.uint32(0xC2B2AE35), out=v)
            out[g, k] = np.minimum.reduceat(v, first)
    return out


def _sketch(width: int, bands: int, rows: int, step: int = 1000):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                sets = shingle_sets(b.column("text").to_pylist(), width)
                sig = signatures(sets, bands * rows)
                keys = np.zeros((len(sets), bands), np.uint64)
                for k in range(bands):
                    key = np.full(len(sets), k + 1, np.uint64)
                    for r in range(rows):
                        key = _mix(key * _U(0x9E3779B97F4A7C15) + sig[:, k * rows + r])
                    keys[:, k] = key
                low = (sig >> np.uint32(7)).astype(np.uint8)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                digest = np.array([[s.sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(s + _U(1))) if len(s) else 0] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.record_batch(
                    {
                        "doc_id": b.column("doc_id"),
                        "text_key": b.column("text_key"),
                        "n_shingles": pa.array(n),
                        "set_a": pa.array(digest[:, 0]),
                        "set_b": pa.array(digest[:, 1]),
                        "bands": pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                        "low": pa.array([x.tobytes() for x in low], pa.binary()),
                    }
                )

    return work


def sketches(docs: DataFrame, width: int, bands: int, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_a, set_b, bands, low`` of every row."""
    inner = docs.select(F.col("doc_id").cast("long"), text_of().cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    return inner.mapInArrow(_sketch(width, bands, rows), "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, low binary")


def _verify(width: int, percent: int):
    import zstandard

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (a, salt, b), the centre's own row, with b null, first."""
        unzip, centre, own = zstandard.ZstdDecompressor(), None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                sets = shingle_sets([unzip.decompress(z).decode() for z in part.column("z").to_pylist()], width)
                links = []
                for x, y, s in zip(a, b, sets):
                    if y is None:
                        centre, own = x, s
                    elif centre == x:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(s) - both):
                            links.append((x, y))
                yield pa.record_batch({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return groups


def _zip_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.record_batch({"of": b.column("of"), "text_key": b.column("text_key"), "z": pa.array([z.compress(x.encode()) for x in b.column("text").to_pylist()], pa.binary())})


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked.  A centre with many partners is split
    into salted groups, each with the centre's text; a task holds one centre's set at a time."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("long").alias("salts"))
    centres = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("id"))
    partners = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b", F.col("b").alias("id"))
    rows = centres.unionByName(partners).join(texts, "id").select("a", "salt", "b", "z")
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_verify(width, percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every node of the edges (a, b), by large and
    small stars in turn until every node is a centre, with larger neighbours only, or hangs on one."""
    edges = table(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    while True:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.max("y").alias("top"))
        if not least.agg(F.expr("count_if(m < x and m <> top)")).first()[0]:
            break
        # A row of edges gives one row here and one at most below, so the table does not grow.
        large = table(both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.least("x", "m").alias("u")), "edges")
        small = large.join(large.groupBy("v").agg(F.min("u").alias("m")), "v")
        edges = table(small.select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).distinct(), "edges")
    roots = edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join what no earlier pair has joined."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = []
    for x, y in pairs:
        a, b = root(x), root(y)
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _by_group(keys: list[str], pairs):
    """A mapInArrow function for rows sorted by ``keys``: for every group, which may span batches, the
    forest of what ``pairs`` gives for its table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            if found := [x for g in groups for x in _forest(pairs(g))]:
                yield pa.record_batch({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = np.stack([t[c].to_numpy() for c in keys], 1)
            first = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1))
            yield from out([t.slice(s, e - s) for s, e in zip(first[:-1], first[1:])])
            held = t.slice(first[-1]).combine_chunks()
        if held is not None:
            yield from out([held])

    return work


def _alike(floor: float, percent: int):
    """Pairs of components of a bucket's block pair with members that agree in their signatures."""

    def pairs(g: pa.Table) -> Iterator[tuple[int, int]]:
        i, j, own = g["i"].to_numpy(), g["j"].to_numpy(), g["own"].to_numpy()
        n, comp = g["n"].to_numpy(), g["component"].to_numpy()
        low = np.frombuffer(b"".join(g["low"].to_pylist()), np.uint8).reshape(len(n), -1)
        left = np.flatnonzero(own == i[0])
        right = left if i[0] == j[0] else np.flatnonzero(own == j[0])
        for at in range(0, len(left), 64):
            x = left[at : at + 64]
            ok = (comp[x][:, None] != comp[right][None, :]) & (100 * np.minimum(n[x][:, None], n[right][None, :]) >= percent * np.maximum(n[x][:, None], n[right][None, :]))
            if ok.any():
                p, q = np.nonzero(ok)
                near = np.concatenate([(low[x[p[k : k + 4096]]] == low[right[q[k : k + 4096]]]).mean(1) >= floor for k in range(0, len(p), 4096)])
                yield from {(int(c), int(d)) for c, d in zip(comp[x[p[near]]], comp[right[q[near]]])}

    return pairs


def common_counts(sets: list[np.ndarray], wide: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = often[column] > 1
    column, row = (np.cumsum(often > 1) - 1)[column[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        s = slice(*np.searchsorted(column, [at, at + wide]))
        m = np.zeros((len(sets), wide), np.float32)
        m[row[s], column[s] - at] = 1
        out += m @ m.T
    return out


def _close(width: int, percent: int):
    """Pairs of components in a family's block pair with members that are linked."""
    def pairs(g: pa.Table) -> Iterator[tuple[int, int]]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        comp = g["component"].to_numpy()
        if len(np.unique(comp)) > 1:
            sets = shingle_sets([unzip.decompress(z).decode() for z in g["z"].to_pylist()], width)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            both = common_counts(sets)
            p, q = np.nonzero((comp[:, None] < comp[None, :]) & (100 * both >= percent * (n[:, None] + n[None, :] - both)))
            yield from set(zip(comp[p].tolist(), comp[q].tolist()))

    return pairs


MEETING = ["family", "xc", "xw", "xk", "yc", "yw", "yk"]


def _meetings(members: DataFrame, percent: int) -> DataFrame:
    """The columns MEETING and the members (``rep, component``) that meet there.  Families of more than
    BLOCK members are cut into windows of set sizes; sets that are similar enough stand in one window
    or in neighbouring ones.  In a window a component of BLOCK members or more has slots (component, k)
    of its own, the others share slots (-1, k); slots of near windows meet, but not those of one
    component."""
    whole = members.groupBy("family").agg(F.count("*").alias("n_f"))
    window = F.when(F.col("n_f") > BLOCK, F.floor(F.log(F.col("n").cast("double")) / (math.log(100.0 / min(percent, 99)) + 1e-9))).otherwise(0).cast("long")
    placed = members.join(whole, "family").select("family", "component", "rep", window.alias("w"))
    sizes = placed.groupBy("family", "w", "component").agg(F.count("*").alias("n_c"))
    pooled = sizes.where(F.col("n_c") < BLOCK).groupBy("family", "w").agg(F.sum("n_c").alias("n_p"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / BLOCK).cast("long") - 1))
    slots = sizes.where(F.col("n_c") >= BLOCK).select("family", "w", F.col("component").alias("c"), upto("n_c").alias("k")).unionByName(pooled.select("family", "w", F.lit(-1).cast("long").alias("c"), upto("n_p").alias("k")))
    x, y = (slots.select("family", *[F.col(n).alias(f"{s}{n}") for n in "cwk"]) for s in "xy")
    met = x.join(y, "family").where("abs(xw - yw) <= 1 and struct(xc, xw, xk) <= struct(yc, yw, yk) and (xc <> yc or xc = -1)")
    big = F.col("n_c") >= BLOCK
    place = placed.join(sizes, ["family", "w", "component"]).join(pooled, ["family", "w"], "left").select(
        "family", "w", "component", "rep", F.when(big, F.col("component")).otherwise(-1).alias("c"), F.pmod(F.xxhash64("rep"), F.ceil(F.when(big, F.col("n_c")).otherwise(F.col("n_p")) / BLOCK).cast("long")).alias("k")
    )
    slot = lambda s: F.struct(*[F.col(f"{s}{n}").alias(n) for n in "cwk"])
    at = met.select("*", F.explode(F.array_distinct(F.array(slot("x"), slot("y")))).alias("s")).select(*MEETING, "s.c", "s.w", "s.k")
    return place.join(at, ["family", "c", "w", "k"]).select(*MEETING, "rep", "component")


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that leave a pair at the threshold unseen with a chance of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (min(percent, 99) / 100) ** rows))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int | None = None, rows: int = ROWS, slack: float = 0.15) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; documents are linked
    where 100 * intersection >= percent * union.  By default there are as many ``bands`` as MISS asks."""
    bands = bands_for(percent, rows) if bands is None else bands
    sketch = table(sketches(docs, width, bands, rows), "sketches")
    sets = ["n_shingles", "set_a", "set_b"]
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy(*sets).agg(F.min(F.struct("doc_id", "text_key", "bands", "low")).alias("r"))
    reps = table(reps.select(*sets, F.monotonically_increasing_id().alias("rep"), "r.doc_id", "r.text_key", "r.bands", "r.low"), "reps")

    # The sets of a repeated doc_id: each is linked with the first of them.
    several = full.groupBy("doc_id").agg(F.min(F.struct(*sets)).alias("x"), F.max(F.struct(*sets)).alias("y")).where("x <> y")
    own = full.join(several, "doc_id").select(*sets, *[F.col(f"x.{c}").alias(f"x_{c}") for c in sets]).distinct()
    own = own.join(reps.select(*sets, F.col("rep").alias("b")), sets).join(reps.select(*[F.col(c).alias(f"x_{c}") for c in sets], F.col("rep").alias("a")), [f"x_{c}" for c in sets])

    rows_ = reps.select(F.col("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = rows_.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("size")).where("size > 1")
    shared = table(rows_.join(buckets, "key").select("key", "rep", "n", "c", "size"), "buckets")

    involved = reps.join(shared.select("rep").distinct(), "rep").select("rep", F.col("doc_id").alias("of"), "text_key")
    source = docs.select(F.col("doc_id").cast("long").alias("of"), text_of().cast("string").alias("text")).withColumn("text_key", F.xxhash64("text")).mapInArrow(_zip_texts, "of long, text_key long, z binary")
    texts = table(source.join(involved, ["of", "text_key"]).select(F.col("rep").alias("id"), "z").dropDuplicates(["id"]), "texts")

    fits = F.expr(f"100 * least(n, c.n) >= {percent} * greatest(n, c.n)")
    stars = table(shared.where("rep <> c.rep").where(fits).select(F.col("c.rep").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = table(verified(stars, texts, width, percent).unionByName(own.where("a <> b").select("a", "b")), "links")
    found = components(links)

    placed = shared.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = table(placed.select("key", "rep", "n", "size", "component"), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    block = placed.join(mixed, "key").join(reps.select("rep", "low"), "rep").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    met = block.select("key", "rep", "n", "component", "low", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "n", "component", "low", "own")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    alike = met.mapInArrow(_by_group(["key", "i", "j"], _alike(percent / 100 - slack, percent)), "a long, b long")
    families = components(alike).select(F.col("id").alias("component"), F.col("component").alias("family"))
    members = reps.select("rep", F.col("n_shingles").alias("n")).join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(families, "component")
    meet = _meetings(table(members.select("family", "component", "rep", "n"), "members"), percent).join(texts.withColumnRenamed("id", "rep"), "rep")
    meet = meet.select(*MEETING, "component", "z").repartition(*MEETING).sortWithinPartitions(*MEETING)
    more = table(meet.mapInArrow(_by_group(MEETING, _close(width, percent)), "a long, b long"), "links")
    joined = components(more)
    found = found.join(joined.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    single = joined.select("id", "component").join(found.select("id"), "id", "left_anti")
    found = found.unionByName(single)

    named = found.join(reps.select(F.col("rep").alias("id"), "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = found.join(named, "component").select(F.col("id").alias("rep"), "least")
    rep_of = reps.select(*sets, "rep", F.col("doc_id").alias("of")).join(named, "rep", "left").select(*sets, F.coalesce("least", "of").alias("component"))
    out = sketch.select("doc_id", *sets).join(rep_of, sets, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)
