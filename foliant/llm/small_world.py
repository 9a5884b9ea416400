"""Near-duplicate vectors by hierarchical navigable small-world graphs, one a shard.

Vectors of one label and length that are equal become one node.  The nodes of a label are dealt by hash to shards of
about ``shard_rows``; each shard has its graph, built in batches: every layer holds a share of the one
below, a batch searches the layer built so far, also sees itself, and links each vector to neighbours of different
directions (one that is nearer to a neighbour already taken than to the vector is passed over).

Then every shard is queried with every shard of its label, in both directions: the upper layers give the entry, the lowest one is
searched by beams, for many vectors at once.  A beam that is full of links is widened for its vector.  A
sample of the vectors is compared with the whole shard; while the beams have missed more of what this
audit finds than allowed, all are widened, at last to the whole shard.  What is found is verified by the cosine of the
original vectors in double precision.

A task holds two shards.  It gives out how many links each vector has and, for each component of these
links, one node beside each of the others; so a family of any size sends no more than its nodes.

Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing.
Repeated rows are vectors of their own that link with each other; rows of one vec_id are one in the
components.  A row with a null vec_id has no component, is kept, and counts as a link of others nowhere.
Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table
from foliant.llm.near_dup import components
from foliant.llm.permutation_index import matrix

DEGREE = 12  # neighbours of a vector in the upper layers; twice as many in the lowest
LAYER = 16  # a layer has one in so many of the vectors below
BUILD = 48  # beam while building
EXPAND = 4  # vectors of a beam whose neighbours are looked at together
LANES = 256  # vectors searched together
AUDIT = 64  # vectors of a shard that are compared with all of another
NEAREST = 1  # of these the audit asks for so many nearest as well as for the links
ROUNDING = 1e-4  # single-precision cosines within this of the threshold are looked at again


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each row, best first."""
    if score.shape[1] > k:
        part = np.argpartition(-score, k - 1, axis=1)[:, :k]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(-score, axis=1, kind="stable")


@dataclass
class Layer:
    """A graph of the first ``n`` vectors of a shard: ``near`` holds neighbours, -1 where there are fewer."""

    x: np.ndarray
    near: np.ndarray
    n: int

    def beams(self, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest that a search from ``entry`` (places, a row a query) finds, with cosines; best first, -1 where fewer are reached."""
        lanes = np.arange(len(q))
        seen = np.zeros((len(q), self.n + 1), bool)
        seen[:, self.n] = True
        ids = np.full((len(q), ef), -1)
        score = np.full((len(q), ef), -np.inf, np.float32)
        done = np.ones((len(q), ef), bool)
        new = entry
        while len(lanes):
            # -1 stands at the last place of ``seen``; what occurs twice in a row is looked at once.
            new = np.sort(new, 1)
            fresh = ~seen[lanes[:, None], new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[lanes[:, None], new] = True
            seen[:, self.n] = True
            s = np.where(fresh, np.einsum("qd,qmd->qm", q[lanes], self.x[new]), -np.inf).astype(np.float32)
            both_ids = np.concatenate((ids[lanes], np.where(fresh, new, -1)), 1)
            both = np.concatenate((score[lanes], s), 1)
            marks = np.concatenate((done[lanes], ~fresh), 1)
            best = _top(both, ef)
            ids[lanes], score[lanes] = np.take_along_axis(both_ids, best, 1), np.take_along_axis(both, best, 1)
            done[lanes] = np.take_along_axis(marks, best, 1)
            lanes = lanes[~done[lanes].all(1)]
            if not len(lanes):
                break
            # The best that were not expanded yet stand first.
            at = np.argsort(done[lanes], 1, kind="stable")[:, :EXPAND]
            live = ~np.take_along_axis(done[lanes], at, 1)
            done[lanes[:, None], at] = True
            new = np.where(live[:, :, None], self.near[np.take_along_axis(ids[lanes], at, 1)], -1).reshape(len(lanes), -1)
            new = new if (new >= 0).any() else new[:, :1]
        return ids, score


def _diverse(x: np.ndarray, ids: np.ndarray, score: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) up to ``degree``: first those nearer to the row's
    vector than to any taken before, then the best of the rest."""
    vectors = x[ids]
    among = np.matmul(vectors, vectors.transpose(0, 2, 1))
    real = np.isfinite(score) & (ids >= 0)
    taken = np.zeros(ids.shape, bool)
    count = np.zeros(len(ids), np.int64)
    for c in range(ids.shape[1]):
        near = np.where(taken, among[:, c], -np.inf).max(1, initial=-np.inf)
        taken[:, c] = real[:, c] & (count < degree) & (near <= score[:, c])
        count += taken[:, c]
    order = np.argsort(np.where(taken, 0, np.where(real, 1, 2)), 1, kind="stable")[:, :degree]
    out = np.where(np.take_along_axis(real, order, 1), np.take_along_axis(ids, order, 1), -1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


def _back(layer: Layer, own: np.ndarray, chosen: np.ndarray, degree: int) -> None:
    """Links from what new vectors have chosen back to them; a full list is chosen anew."""
    to = chosen[chosen >= 0]
    by = np.repeat(own, (chosen >= 0).sum(1))
    order = np.argsort(to, kind="stable")
    to, by = to[order], by[order]
    heads, first, n = np.unique(to, return_index=True, return_counts=True)
    for wide in (2, 8, 32, int(n.max(initial=0))):  # lists of like length together
        pick = np.flatnonzero((n <= wide) & (n > 0))
        if not len(pick):
            continue
        for k in range(0, len(pick), 1024):
            p = pick[k : k + 1024]
            cols = np.arange(min(wide, int(n[p].max())))
            more = np.where(cols < n[p][:, None], by[np.minimum(first[p][:, None] + cols, len(by) - 1)], -1)
            ids = np.concatenate((layer.near[heads[p]], more), 1)
            score = np.where(ids >= 0, np.einsum("qd,qmd->qm", layer.x[heads[p]], layer.x[ids]), -np.inf)
            best = _top(score, min(4 * degree, ids.shape[1]))
            layer.near[heads[p]] = _diverse(layer.x, np.take_along_axis(ids, best, 1), np.take_along_axis(score, best, 1), degree)
        n = np.where(n <= wide, 0, n)


def build(x: np.ndarray) -> list[Layer]:
    """The layers of a shard's graph, the highest first; a layer holds the first vectors of ``x``, whose order is random."""
    sizes = [len(x)]
    while sizes[-1] > LANES:
        sizes.append(-(-sizes[-1] // LAYER))
    layers: list[Layer] = []
    for n in reversed(sizes):
        degree = 2 * DEGREE if n == len(x) else DEGREE
        layer = Layer(x, np.full((n + 1, degree), -1), 0)
        while layer.n < n:
            # The first batch has what the layer above holds, so that its entries are there.
            own = np.arange(layer.n, min(n, max(64, layers[-1].n if layers else 0, min(2 * layer.n, layer.n + LANES))))
            among = (x[own] @ x[own].T).astype(np.float32)
            np.fill_diagonal(among, -np.inf)
            ids, score = np.tile(own, (len(own), 1)), among
            if layer.n:
                found, s = layer.beams(x[own], _entries(layers, x[own]) if layers else np.zeros((len(own), 1), np.int64), BUILD)
                ids, score = np.concatenate((found, ids), 1), np.concatenate((s, score), 1)
            best = _top(score, min(BUILD, ids.shape[1]))
            chosen = _diverse(x, np.take_along_axis(ids, best, 1), np.take_along_axis(score, best, 1), DEGREE)
            layer.near[own, :DEGREE] = chosen
            layer.n = int(own[-1]) + 1
            _back(layer, own, chosen, degree)
        layers.append(layer)
    return layers


def _entries(layers: list[Layer], q: np.ndarray) -> np.ndarray:
    at = np.zeros((len(q), 1), np.int64)
    for layer in layers:
        at = layer.beams(q, at, 4)[0]
    return at


def _exact(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return np.concatenate([(q[rows[k : k + 65_536]] * x[cols[k : k + 65_536]]).sum(1) for k in range(0, len(rows), 65_536)] or [np.zeros(0)])


def links(layers: list[Layer], x: np.ndarray, q: np.ndarray, threshold: float, ef: int, recall: float, own: bool) -> np.ndarray:
    """For every query (a row of unit vectors ``q``) which vectors ``x`` of the graph it links with; in
    the shard's own graph a vector begins at itself.  A matrix of two shards of bounded size."""
    n, single, wide = len(x), q.astype(np.float32), layers[-1].x
    out = np.zeros((len(q), n), bool)
    low = np.float32(threshold - ROUNDING)
    audit = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    truth = single[audit] @ wide.T
    if own:
        truth[np.arange(len(audit)), audit] = -np.inf
    near = np.sort(truth, 1)[:, -min(NEAREST, n)]
    asked = truth >= np.minimum(low, near)[:, None]
    todo, first = np.arange(len(q)), ef
    while len(todo):
        if (4 if ef == first else 8) * ef >= n:  # a beam of the whole shard
            for k in range(0, len(todo), LANES):
                t = todo[k : k + LANES]
                out[t] |= single[t] @ wide.T >= low
            break
        full, reached = [], np.zeros(asked.shape, bool)
        for k in range(0, len(todo), LANES):
            t = todo[k : k + LANES]
            ids, score = layers[-1].beams(single[t], t[:, None] if own else _entries(layers[:-1], single[t]), ef)
            hit = (score >= low) & (ids >= 0)
            out[np.repeat(t, hit.sum(1)), ids[hit]] = True
            full.append(t[hit[:, -1]])
            met, place = np.isin(t, audit), np.searchsorted(audit, t)
            for i in np.flatnonzero(met):
                reached[place[i], ids[i][ids[i] >= 0]] = True
        # The audit counts what was asked of the vectors whose beams are not widened anyway.
        full = np.concatenate(full)
        counted = np.isin(audit, todo) & ~np.isin(audit, full)
        missed = (asked & ~reached)[counted].sum()
        todo = todo if missed > (1 - recall) * max(1, asked[counted].sum()) else full
        ef *= 4
    rows, cols = np.nonzero(out)
    out[rows, cols] = _exact(q, x, rows, cols) >= threshold
    if own:
        np.fill_diagonal(out, False)
    return out


def _weighed(m: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The copies of what each row links with."""
    return np.concatenate([m[k : k + 256] @ copies for k in range(0, len(m), 256)])


def _joined(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each component of the links ``m`` between ``a`` and ``b``: one of its nodes beside each of the others."""
    out, left, right = [], m.any(1), np.ones(m.shape[1], bool)
    for k in np.flatnonzero(left).tolist():
        if not left[k]:
            continue
        rows = np.array([k])
        left[k] = False
        reached = []
        while len(rows):
            cols = np.flatnonzero(m[rows].any(0) & right)
            right[cols] = False
            rows = np.flatnonzero(m[:, cols].any(1) & left) if len(cols) else cols
            left[rows] = False
            reached += [b[cols], a[rows]]
        nodes = np.setdiff1d(np.concatenate(reached), a[k])
        out.append((np.full(len(nodes), a[k]), nodes))
    return out


KEY = ["label", "width"]
NODE = "node long, copies long, v array<double>"


def _unit(v: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither vanish nor overflow.
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _graphs(shard: pa.Table) -> pa.Table:
    """A shard with its graph: the vectors by layer and their neighbours' places."""
    shard = shard.sort_by([("place", "ascending"), ("node", "ascending")])
    layers = build(_unit(matrix(shard["v"])).astype(np.float32))
    near = [[layer.near[k].astype(np.int32) for layer in layers if k < layer.n] for k in range(shard.num_rows)]
    order = pa.array(np.arange(shard.num_rows), pa.int64())
    return shard.drop_columns(["place"]).append_column("place", order).append_column("near", pa.array(near, pa.list_(pa.list_(pa.int32()))))


def _read(shard: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Layer]]:
    """Nodes, copies, unit vectors and layers of a shard as ``_graphs`` gave it."""
    shard = shard.sort_by("place")
    unit = _unit(matrix(shard["v"]))
    single, near = unit.astype(np.float32), shard["near"].to_pylist()
    layers = []
    for k in range(1, len(near[0]) + 1):  # from the lowest, which every vector has last
        rows = [r[-k] for r in near if len(r) >= k]
        layers.append(Layer(single, np.array([*rows, [-1] * len(rows[0])]), len(rows)))
    return shard["node"].to_numpy(), shard["copies"].to_numpy(), unit, layers[::-1]


def _meet(threshold: float, ef: int, recall: float):
    def work(both: pa.Table) -> pa.Table:
        one, other = both["i"][0].as_py(), both["j"][0].as_py()
        here, there = (both.filter(pa.compute.equal(both["own"], k)) for k in (one, other))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # counts of a, or links (a, b)
        if here.num_rows and there.num_rows:
            a, copies_a, x, g = _read(here)
            if one == other:
                b, m = a, links(g, x, x, threshold, ef, recall, True)
                m |= m.T
                counts = [(a, _weighed(m, copies_a))]
            else:
                b, copies_b, y, h = _read(there)
                m = links(h, y, x, threshold, ef, recall, False) | links(g, x, y, threshold, ef, recall, False).T
                counts = [(a, _weighed(m, copies_b)), (b, _weighed(m.T, copies_a))]
            found = [(n[c > 0], np.zeros((c > 0).sum(), np.int64), c[c > 0]) for n, c in counts]
            if one == other:
                np.fill_diagonal(m, True)
            found += [(x, y, np.zeros(len(x), np.int64)) for x, y in _joined(m, a, b)]
        first, second, n = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"a": pa.array(first, pa.int64()), "b": pa.array(second, pa.int64(), mask=n > 0), "n": pa.array(n, pa.int64())})

    return work


def near_vectors(vectors: DataFrame, threshold: float = 0.93, shard_rows: int = 8192, ef: int = 64, recall: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id, label, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("v"))
    fine = "vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    # Negative zeros are zeros; equal vectors are known by two hashes and their width.
    v = F.transform("v", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("v", F.when(F.expr(fine), v)).select("vec_id", "label", "v", F.size("v").alias("width"))
    nodes = rows.where("v is not null").groupBy(*KEY, "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    of = table(rows.where("v is not null").join(nodes, [*KEY, "v"]).select("vec_id", "node"), "members")

    shards = nodes.join(nodes.groupBy(*KEY).agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards")), KEY)
    dealt = shards.select(*KEY, "shards", F.pmod(F.xxhash64("v"), "shards").alias("own"), F.xxhash64("v", F.lit(1)).alias("place"), "node", "copies", "v")
    kind = f"label string, width int, shards long, own long, {NODE}, place long, near array<array<int>>"
    graphs = table(dealt.groupBy(*KEY, "own").applyInArrow(_graphs, kind), "graphs")
    met = graphs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("other"))
    met = met.select(*KEY, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "v", "place", "near")
    found = table(met.groupBy(*KEY, "i", "j").applyInArrow(_meet(threshold, ef, recall), "a long, b long, n long"), "links")

    # Rows of one vec_id are one: their nodes are linked with the first of them.
    several = of.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last")
    same = of.join(several, "vec_id").where("node <> a").select("a", F.col("node").alias("b"))
    joined = components(found.where("b is not null").select("a", "b").unionByName(same))
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    whole = nodes.select("node", "least", "copies").join(joined.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")).join(degree, "node", "left")
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = whole.join(least, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = of.join(facts, "node").select("vec_id", "n_links", "component_id")
    # Rows that take no part have the component of their vec_id's other rows, where there are any.
    rest = rows.where("v is null").select("vec_id").join(linked.groupBy("vec_id").agg(F.min("component_id").alias("component_id")), "vec_id", "left")
    out = linked.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op11_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least AS component_id, vec_id = least AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
