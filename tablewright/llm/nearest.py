"""Approximate nearest neighbours by stable projections: incremental neighbours in a low-dimensional kd-tree, verified until a chi-square test stops."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import discard, materialise, small_batches

#: Projected dimensions (even, for the closed form of the test), and the chance of any of the k neighbours being seen, at least, at which a query stops.
PROJECTED, SURE = 16, 0.95
#: Rows of a leaf of the upper tree, leaves at most, rows that the tree is fitted to, rows of a leaf inside a block.
LEAF_ROWS, LEAVES, FIT_ROWS, SMALL_LEAF = 4096, 4096, 20_000, 128
#: Queries that one task takes to a block at most; a block's rows are sent once for each, a sixteenth of what the queries are.
QUERY_ROWS = 16 * LEAF_ROWS
#: Rows that are verified at a time, at most, and how far a product of unit vectors in single precision may be off.
VERIFIED, SINGLE = 1024, 1e-5


def chi_square_cdf(x: np.ndarray) -> np.ndarray:
    """Of PROJECTED degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for k in range(1, PROJECTED // 2):
        term = term * half / k
        total = total + term
    return np.where(np.isfinite(half), 1 - np.exp(-np.minimum(half, 700)) * total, 1.0)


def stop_at(sure: float) -> float:
    """The squared projected distance, in squared true distances, that a row keeps to with this chance."""
    low, high = 0.0, 1e3
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid) < sure else (low, mid)
    return high


STOP = stop_at(SURE)


def matrix(vectors, dims: int) -> np.ndarray:
    """Rows in double precision, shorter vectors filled with zeros."""
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


@dataclass
class Tree:
    """Splits of projected space by medians; leaf k of a tree of depth t has box lo[k]..hi[k]."""

    axis: np.ndarray
    cut: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def leaf(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        rows = np.arange(len(p))
        for _ in range((len(self.axis) + 1).bit_length() - 1):
            at = 2 * at + 1 + (p[rows, self.axis[at]] > self.cut[at])
        return at - len(self.axis)

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of one projected query to each box."""
        d = np.maximum(np.maximum(self.lo - q, q - self.hi), 0)
        return (d * d).sum(1)


def build_tree(p: np.ndarray, depth: int, tight: bool) -> tuple[Tree, np.ndarray]:
    """A kd-tree over rows p, and each row's leaf. `tight`: boxes are those of the rows, else they fill space."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    axis, cut = np.zeros(inner, np.int64), np.zeros(inner)
    lo, hi = np.full((2 * leaves - 1, PROJECTED), -np.inf), np.full((2 * leaves - 1, PROJECTED), np.inf)
    rows: dict[int, np.ndarray] = {0: np.arange(len(p))}
    for node in range(inner):
        own = rows.pop(node)
        a = int(np.argmax(p[own].max(0) - p[own].min(0))) if len(own) else 0
        c = float(np.median(p[own, a])) if len(own) else 0.0
        axis[node], cut[node] = a, c
        right = p[own, a] > c
        for child, part in ((2 * node + 1, own[~right]), (2 * node + 2, own[right])):
            rows[child] = part
            lo[child], hi[child] = lo[node], hi[node]
        hi[2 * node + 1, a] = min(hi[2 * node + 1, a], c)
        lo[2 * node + 2, a] = max(lo[2 * node + 2, a], c)
    tree, leaf = Tree(axis, cut, lo[inner:], hi[inner:]), np.zeros(len(p), np.int64)
    for node, own in rows.items():
        leaf[own] = node - inner
        if tight:
            tree.lo[node - inner] = p[own].min(0) if len(own) else np.inf
            tree.hi[node - inner] = p[own].max(0) if len(own) else np.inf
    return tree, leaf


@dataclass
class Space:
    """Makes the largest inner product the least distance: a component more brings every vector to the length `norm`."""

    dims: int
    norm: float
    directions: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(1)))
        return x @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def project_queries(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.norm / np.sqrt((q * q).sum(1)))[:, None]) @ self.directions[:-1]

    def distance(self, product: np.ndarray, length: float) -> np.ndarray:
        return np.maximum(1e-12 * self.norm**2, 2 * self.norm**2 - 2 * (self.norm / length) * product)


@dataclass
class Block:
    """Rows that are searched together, in the order of the leaves of a kd-tree over their projections."""

    space: Space
    ids: np.ndarray
    x: np.ndarray

    def __post_init__(self) -> None:
        p = self.space.project(self.x)
        self.tree, leaf = build_tree(p, max(0, math.ceil(math.log2(max(1, len(p) / SMALL_LEAF)))), tight=True)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.x, self.p = self.ids[order], self.x[order], p[order]
        self.ends = np.searchsorted(leaf[order], np.arange(len(self.tree.lo) + 1))
        self.rows, self.square, self.known = np.arange(len(p)), (self.p * self.p).sum(1), set(self.ids.tolist())
        self.unit, self.held = (self.x / self.space.norm).astype(np.float32), np.empty((VERIFIED, self.x.shape[1]), np.float32)

    def by_distance(self, pq: np.ndarray, within=lambda: np.inf):
        """Rows in ascending order of their projected distance from pq, with it, some at a time, as far as `within()` goes.
        A row waits until no leaf that is still closed can hold a nearer one; leaves open only as the caller asks for more."""
        gap = self.tree.gaps(pq)
        by, own, twice = np.argsort(gap, kind="stable"), float(pq @ pq), 2 * pq
        by = by[gap[by] < within()]
        rows, far, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 2 if within() == np.inf else max(2, len(by))
        while at < len(by) and gap[by[at]] < within():
            spans = [slice(self.ends[b], self.ends[b + 1]) for b in by[at : at + step]]
            new = np.concatenate([self.rows[o] for o in spans])
            d = np.concatenate([self.square[o] - self.p[o] @ twice for o in spans])
            d = np.maximum(d + own, 0)
            wanted = d < within()
            rows, far = np.concatenate((rows, new[wanted])), np.concatenate((far, d[wanted]))
            at, step = at + step, step * 4
            ready = far <= (gap[by[at]] if at < len(by) else np.inf)
            now, far_now = rows[ready], far[ready]
            nearest_first = np.argsort(far_now)
            yield now[nearest_first], far_now[nearest_first]
            rows, far = rows[~ready], far[~ready]
        nearest_first = np.argsort(far)  # what waited for leaves that stay closed
        yield rows[nearest_first], far[nearest_first]

    def search(self, k: int, qid: int, q: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Those of the best k rows for one query but its own that lie within `bound`, a true distance within which k rows
        elsewhere are; their scores; and how many rows were verified.

        Projected neighbours are verified one after the other, nearest first, until the next one's projected distance is
        so large that a row within the k-th best true distance would be projected nearer with a chance of SURE. Rows are
        first compared in single precision; those that may be among the best get their exact score."""
        norm, length = self.space.norm, float(np.sqrt(q @ q))
        scale = norm * length
        least = 1 - bound / (2 * norm**2)  # the product at that distance, in units of scale
        unit = (q / length).astype(np.float32)
        limit, best, found, verified, step = [bound], np.zeros(0), [], 0, 2 * k
        for rows, far in self.by_distance(self.space.project_queries(q[None])[0], lambda: STOP * limit[0]):
            at = 0
            while at < len(rows) and far[at] < STOP * limit[0]:
                upto = min(at + step, int(np.searchsorted(far, STOP * limit[0])))
                own = rows[at:upto]
                product = np.take(self.unit, own, axis=0, out=self.held[: len(own)], mode="clip") @ unit
                if qid in self.known:
                    product[self.ids[own] == qid] = -np.inf
                near = (product >= least - SINGLE) & (product > -np.inf)
                if near.any():
                    found.append(own[near])
                    best = np.sort(np.concatenate((best, product[near])))[-k:]
                    if len(best) == k:
                        least = max(least, float(best[0]) - SINGLE)
                        limit[0] = min(limit[0], float(self.space.distance(least * scale, length)))
                verified, at, step = verified + len(own), upto, min(2 * step, VERIFIED)
        near = np.concatenate(found) if found else np.zeros(0, np.int64)
        exact = (self.x[near] * q).sum(1)  # summed row by row: equal rows give equal scores
        first = np.lexsort((self.ids[near], -exact))[:k]
        return self.ids[near[first]], exact[first], verified


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 17) -> DataFrame:
    """For each vector whose id is divisible by `every` its k nearest others by inner product: query_id, rank, vec_id, score.

    The upper kd-tree is fitted to at most FIT_ROWS rows and deals every row to a leaf; a leaf with many rows, as one of
    equal vectors, is dealt on to several blocks. A query takes the leaves in order of their distance from it in projected
    space: first the nearest alone, then in each round twice as many as in the one before, as long as the chi-square test,
    at the distance of the k-th best found so far, doesn't exclude the next one. In a block its own tree hands out rows in
    ascending projected distance, each verified, until the same test excludes the next row. Leaves that queries have tried are not tried again; rounds are the logarithm of the number of leaves
    at most. Scores are the inner products of the original vectors in double precision; ties go to the smaller id.

    Vectors that are null, empty, zero, or hold a null or a non-finite component take no part, nor do null ids. Vectors
    of different length compare as if filled with zeros. Of repeated ids every row is a candidate, a query's own id none.
    With fewer than k candidates all are returned; an empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(vectors)
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    v = F.col(f"`{vector_col}`").cast(f"array<{kind}>")
    square = F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    clean = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), square.alias("sq")).filter(
        F.col("id").isNotNull() & F.col("sq").isNotNull() & (F.col("sq") > 0) & (F.col("sq") < F.lit(float("inf"))) & ~F.isnan("sq")
    )
    n, most, dims = clean.agg(F.count(F.lit(1)), F.max("sq"), F.max(F.size("v"))).first()
    result = "query_id long, vec_id long, score double"
    if not n:
        return spark.sql("SELECT 0L AS query_id, 1 AS rank, 0L AS vec_id, CAST(0 AS DOUBLE) AS score WHERE false")
    space = Space(dims, math.sqrt(most), np.random.RandomState(seed).randn(dims + 1, PROJECTED))
    depth = min(int(math.log2(LEAVES)), max(0, math.ceil(math.log2(n / LEAF_ROWS))))
    sample = clean.filter(F.pmod(F.xxhash64("id", F.lit("tree")), F.lit(1 << 30)) < F.lit(int(min(1.0, FIT_ROWS / n) * (1 << 30))))
    rows = sample.select("id", "v").limit(2 * FIT_ROWS).toPandas().sort_values("id", kind="stable")
    tree, _ = build_tree(space.project(matrix(rows.v.tolist(), dims)) if len(rows) else np.zeros((0, PROJECTED)), depth, tight=False)

    def deal(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "v": pdf.v, "leaf": tree.leaf(space.project(matrix(pdf.v.tolist(), dims)))})

    points = materialise(clean.select("id", "v").mapInPandas(deal, f"id long, v array<{kind}>, leaf long"), "ann-points")
    blocks = points.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(2.0 * LEAF_ROWS)).alias("salts"))
    blocks = materialise(blocks, "ann-leaves")
    points = points.join(F.broadcast(blocks), "leaf")  # a row for each leaf, LEAVES at most
    points = points.withColumn("salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.col("salts")))
    asked = points.filter(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("v").alias("qv"))

    def dealt(queries: DataFrame) -> DataFrame:
        """Queries (qid, qv, bound, leaf, salt) against the rows of their blocks: in a task a block's rows come first, then its queries."""
        key = ["leaf", "salt", "share"]
        shares = queries.groupBy("leaf", "salt").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(QUERY_ROWS))).alias("shares"))
        shares = materialise(shares, "ann-shares")
        rows = points.join(shares, ["leaf", "salt"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        asking = queries.join(shares, ["leaf", "salt"]).withColumn("share", F.pmod(F.xxhash64("qid", F.lit("share")), F.col("shares")))
        rows = rows.select(*key, F.lit(False).alias("asks"), "id", "v", F.lit(0.0).alias("bound"))
        asking = asking.select(*key, F.lit(True).alias("asks"), F.col("qid").alias("id"), F.col("qv").alias("v"), "bound")
        return rows.unionByName(asking).repartition(*key).sortWithinPartitions(*key, "asks").mapInPandas(look, result)

    def look(batches):
        own, held, block = None, [], None
        for pdf in batches:
            vectors = matrix(pdf.v.tolist(), dims)
            ids, asks, bound = pdf.id.to_numpy(), pdf.asks.to_numpy(bool), pdf.bound.to_numpy()
            got = []
            keys = list(zip(pdf.leaf, pdf.salt, pdf.share, strict=True))
            starts = [n for n in range(len(keys)) if not n or keys[n] != keys[n - 1]]
            for a, z in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[a] != own:
                    own, held, block = keys[a], [], None
                first_asking = a + int((~asks[a:z]).sum())
                if first_asking > a:
                    held.append((ids[a:first_asking], vectors[a:first_asking]))
                for n in range(first_asking, z):
                    if block is None and not held:
                        break  # a part of the leaf that no row was dealt to
                    if block is None:
                        block = Block(space, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                        held = []
                    near, score, _ = block.search(k, ids[n], vectors[n], bound[n])
                    got.append((np.repeat(ids[n], len(near)), near, score))
            if got:
                yield pd.DataFrame({c: np.concatenate(g) for c, g in zip(("query_id", "vec_id", "score"), zip(*got, strict=True), strict=True)})

    def top(found: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    best, first, step = None, 0, 1
    while first < len(tree.lo):

        def route(batches, first=first, step=step):
            for pdf in batches:
                q = matrix(pdf.qv.tolist(), dims)
                length, pq = np.sqrt((q * q).sum(1)), space.project_queries(q) if len(q) else q
                bound = np.array([np.inf if np.isnan(s) else float(space.distance(s, a)) for s, a in zip(pdf.least.to_numpy(float), length, strict=True)])
                to = []
                for p, b in zip(pq, bound, strict=True):
                    gap = tree.gaps(p)
                    near = np.argsort(gap, kind="stable")[first : first + step]
                    to.append(near[gap[near] < STOP * b])
                yield pd.DataFrame({"qid": pdf.qid, "qv": pdf.qv, "bound": bound, "leaves": to})

        if best is None:
            queries = asked.withColumn("least", F.lit(None).cast("double"))
        else:
            worst = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
            queries = asked.join(worst, asked.qid == worst.query_id, "left").select("qid", "qv", F.when(F.col("n") >= k, F.col("least")).alias("least"))
        routed = queries.mapInPandas(route, f"qid long, qv array<{kind}>, bound double, leaves array<long>")
        routed = routed.select("qid", "qv", "bound", F.explode("leaves").alias("leaf")).join(F.broadcast(blocks), "leaf")
        routed = routed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        routed = materialise(routed.drop("salts"), "ann-routed")
        if routed.isEmpty():
            break
        found = dealt(routed)
        found = materialise(top(found if best is None else found.unionByName(best.drop("rank"))), "ann-best")
        discard(routed, *[best] if best is not None else [])
        best, first, step = found, first + step, 2 * step
    return best if best is not None else top(spark.createDataFrame([], result))
