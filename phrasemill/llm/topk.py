"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are cut to integers. The top of the index is a set of centres, far apart, from a bounded sample; each vector goes
to the nearest, and a cell with more rows than a block holds is cut into shells, by distance from the centre. Queries are
grouped in the same way, so a group's members lie together. A first round searches every query's own block, which gives it
a kth score; a second takes a query to the blocks that can still reach that score, by the least of three bounds:
    |q| times the block's largest norm, times the cosine of the least angle between q and the block's cone,
    <q, centre> + |q| * outer radius,
    (|q|^2 + largest norm^2 - least distance of q from the shell^2) / 2.
In a task both the block and the group's queries are covered by trees: a node has a centre, the radius that covers what is
below it, the angle that does, and the largest norm. Pairs of nodes are walked together, best bound first, and left once
    min(<q, x> + |q| r_x + |x| r_q + r_q r_x,  largest norms times the cosine between the cones)
is below the worst kth score of the query group. Bounds never exclude a row that could rank, so results are exact.

How much is pruned depends on the data: on vectors in clusters most pairs are never multiplied (a test holds that), on
random directions in many dimensions no bound can exclude anything, and the work is that of all pairs.

Defined results: vectors that are null, of another than the usual length, or hold null or non-finite components, and rows
without an id, take no part; rows that repeat an id count once, with their smallest vector; an empty table gives an empty
table; ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.llm.common import drop_written, prepare, written

SCALE, CENTRES, FIT_ROWS, BLOCK, QUERY_BLOCK, LEAF, QUERY_LEAF, FAN, BLOCKS = 64.0, 256, 4096, 8192, 4096, 64, 8, 8, 100_000


def integers(df: DataFrame, id_col: str, vec_col: str, scale: float = SCALE) -> DataFrame:
    """(vec_id, v): whole vectors as floor(scale * x)."""
    x = F.col("x")
    ok = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    ok = ok.where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return ok.groupBy("vec_id").agg(F.min(F.transform(x, lambda c: F.floor(c * scale).cast("long"))).alias("v"))


class Tree:
    """A cover tree in arrays: each node's centre row, covering radius and angle, largest norm, and children or rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.leaf = x, leaf
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.unit = x / np.maximum(self.norm, 1e-300)[:, None]
        self.angle: list[float] = []
        self.most: list[float] = []
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.kids: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        if len(x):
            self._add(np.arange(len(x)), 0)

    def _add(self, rows: np.ndarray, centre: int) -> int:
        d = self._distance(rows, centre)
        me = len(self.centre)
        r = float(d.max())
        self.centre.append(centre), self.radius.append(r), self.kids.append([]), self.rows.append(rows)
        self.angle.append(float(np.arccos(np.clip((self.unit[rows] @ self.unit[centre]).min(), -1, 1)))), self.most.append(float(self.norm[rows].max()))
        if len(rows) <= self.leaf or r == 0:
            return me
        # children: the centre itself, then the farthest row not covered at half the radius, and so on
        picks, near, at = [centre], np.zeros(len(rows), dtype=np.int64), d
        while len(picks) < FAN or at.max() > r:
            far = int(at.argmax())
            if at[far] <= r / 2 and len(picks) > 1:
                break
            picks.append(int(rows[far]))
            new = self._distance(rows, picks[-1])
            near, at = np.where(new < at, len(picks) - 1, near), np.minimum(new, at)
        few = [np.zeros(0, dtype=rows.dtype)]
        for k, c in enumerate(picks):
            own = rows[near == k]
            if 2 * len(own) > self.leaf:
                self.kids[me].append(self._add(own, c))
            else:
                few.append(own)
        rest = np.concatenate(few)  # outliers share leaves
        for lo in range(0, len(rest), self.leaf):
            own = rest[lo : lo + self.leaf]
            self.kids[me].append(self._add(own, int(own[0])))
        return me

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        d = self.x[rows] - self.x[centre]
        return np.sqrt((d * d).sum(axis=1))


class Best:
    """The k best (score, id) of each query."""

    def __init__(self, ids: np.ndarray, kth: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # heap of (score, -id)
        self.seed = kth  # from an earlier round: what is below can't rank
        self.kth = kth.copy()
        self.visited = 0  # pairs that were multiplied

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        heap = self.found[q]
        for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
            if i == self.ids[q]:
                continue
            item = (s, -i)
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        if len(heap) == self.k:
            self.kth[q] = max(self.seed[q], heap[0][0])


def dual_search(queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """The best k of each query among x, by walking pairs of nodes of both trees."""
    best = Best(query_ids, kth, k)
    if not len(queries) or not len(x):
        return best
    qt, xt = Tree(queries, QUERY_LEAF), Tree(x)
    worst = [float("-inf")] * len(qt.centre)

    def bound(a: int, b: int) -> float:
        cq, cx = qt.centre[a], xt.centre[b]
        rq, rx = qt.radius[a], xt.radius[b]
        slack = 1e-6 * (1 + qt.most[a] * xt.most[b])
        ball = float(queries[cq] @ x[cx]) + qt.norm[cq] * rx + xt.norm[cx] * rq + rq * rx
        apart = math.acos(min(1.0, max(-1.0, float(qt.unit[cq] @ xt.unit[cx])))) - qt.angle[a] - xt.angle[b]
        cone = qt.most[a] * xt.most[b] * max(0.0, math.cos(max(0.0, apart)))
        return min(ball, cone) + slack

    def tighten(a: int) -> float:
        worst[a] = float(best.kth[qt.rows[a]].min())
        return worst[a]

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        b, a, c = heapq.heappop(heap)
        if -b < tighten(a):
            continue
        ka, kc = qt.kids[a], xt.kids[c]
        if not ka and not kc:
            rows, cols = qt.rows[a], xt.rows[c]
            s = queries[rows] @ x[cols].T
            best.visited += s.size
            hit = s >= best.kth[rows][:, None]
            for j in np.flatnonzero(hit.any(axis=1)):
                m = hit[j]
                best.offer(int(rows[j]), s[j][m], ids[cols[m]])
            continue
        for i in ka or [a]:
            w = tighten(i)
            for j in kc or [c]:
                u = bound(i, j)
                if u >= w:
                    heapq.heappush(heap, (-u, i, j))
    return best


def _far_apart(x: np.ndarray, most: int) -> np.ndarray:
    picks = [0]
    d = ((x - x[0]) ** 2).sum(axis=1)
    while len(picks) < most and d.max() > 0:
        picks.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[picks[-1]]) ** 2).sum(axis=1))
    return x[picks]


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, dim))


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE, centres: int = CENTRES, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products with other rows. is_query is over vec_id."""
    spark = df.sparkSession
    prepare(spark)
    out = "query_id long, rank int, vec_id long, score long"
    whole = written(integers(df, id_col, vec_col, scale), "vectors")
    size = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], out)
    dim = size["d"]
    rows = whole.where(F.size("v") == dim)
    n = rows.count()
    block = max(block, -(-n // BLOCKS))  # what the driver knows of blocks is bounded; a block then grows with the table
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()  # bounded
    tops = _far_apart(np.array([r["v"] for r in sample], dtype=np.float64), max(1, min(centres, -(-2 * n // block))))
    tops_sq = (tops * tops).sum(axis=1)
    tops_unit = tops / np.maximum(np.sqrt(tops_sq), 1e-300)[:, None]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x = _matrix(p["v"], dim)
            d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ tops.T + tops_sq, 0)
            cell = d.argmin(axis=1)
            norm = np.sqrt((x * x).sum(axis=1))
            angle = np.arccos(np.clip((x / np.maximum(norm, 1e-300)[:, None] * tops_unit[cell]).sum(axis=1), -1, 1))
            yield p.assign(cell=cell.astype(np.int32), far=np.sqrt(d[np.arange(len(x)), cell]), norm=norm, angle=angle)

    placed = written(rows.mapInPandas(place, "vec_id long, v array<long>, cell int, far double, norm double, angle double"), "cells")
    drop_written(whole)

    def shells(df: DataFrame, most: int) -> DataFrame:
        """(cell, cuts): distances that part each cell into shells of about `most` rows; a row per cell."""
        share = most / 2  # percentiles are approximate
        counts = df.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", [k / 1000 for k in range(1, 1000)], 10_000).alias("q"))
        parts = F.least(F.ceil(F.col("n") / share), F.lit(1000)).cast("int")
        at = F.when(parts > 1, F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.element_at("q", F.greatest(F.lit(1), (k * 1000 / parts).cast("int"))))).otherwise(F.array().cast("array<double>"))
        return counts.select("cell", F.array_distinct(at).alias("cuts"))

    def numbered(df: DataFrame, cuts: DataFrame, name: str, most: int) -> DataFrame:
        """df with the number of each row's shell; rows of one distance that fill more than a block are parted by the id."""
        shell = F.size(F.filter("cuts", lambda c: c < F.col("far")))
        got = df.join(F.broadcast(cuts), "cell").withColumn("shell", shell).drop("cuts")  # at most `centres` rows
        many = got.groupBy("cell", "shell").agg(F.ceil(F.count("*") / (2 * most)).cast("int").alias("k")).where("k > 1")
        k = F.coalesce("k", F.lit(1))
        return got.join(F.broadcast(many), ["cell", "shell"], "left").withColumn(name, F.col("shell") + F.pmod(F.xxhash64("vec_id"), k).cast("int") * 1024).drop("shell", "k")

    data = written(numbered(placed, shells(placed, block), "part", block), "blocks")
    known = data.groupBy("cell", "part").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.max("norm").alias("most"), F.max("angle").alias("angle")).collect()  # a row per block, about BLOCKS at most
    b_cell, b_part = (np.array([r[c] for r in known], dtype=np.int32) for c in ("cell", "part"))
    b_lo, b_hi, b_most, b_angle = (np.array([r[c] for r in known]) for c in ("lo", "hi", "most", "angle"))
    asking = data.where(is_query)
    queries = written(numbered(asking, shells(asking, query_block), "own", query_block).withColumn("batch", F.col("cell").cast("long") * 2**32 + F.col("own")).drop("own"), "queries")
    drop_written(placed)
    keys = ["cell", "part", "batch"]
    blocks = data.select("cell", "part", "vec_id", "v")

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        b = dual_search(_matrix(q["v"], dim), q["vec_id"].to_numpy(), q["kth"].to_numpy(), _matrix(x["v"], dim), x["vec_id"].to_numpy(), k)
        got = [(i, -v, int(s)) for i, heap in zip(b.ids.tolist(), b.found, strict=True) for s, v in heap]
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype("int64")

    def round_(asked: DataFrame, name: str) -> DataFrame:
        """Search asked queries: a task has a block and a group of queries; only blocks that a group asks are sent to it."""
        asked = written(asked.select(*keys, "vec_id", "v", "kth"), "asked")
        pairs = asked.select(*[F.col(c).alias(c) for c in keys]).distinct()
        found = written(asked.groupBy(*keys).cogroup(blocks.join(pairs, ["cell", "part"]).groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long"), name)
        drop_written(asked)
        return found

    first = round_(queries.withColumn("kth", F.lit(float("-inf"))), "search-own")
    kth = first.groupBy("query_id").agg(F.min("score").cast("double").alias("s"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("s")).otherwise(float("-inf")).alias("kth"))

    def ask(parts_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts_:
            x = _matrix(p["v"], dim)
            norm = np.sqrt((x * x).sum(axis=1))[:, None]
            dot = x @ tops.T
            far = np.sqrt(np.maximum(norm * norm - 2 * dot + tops_sq, 0))[:, b_cell]
            angle = np.arccos(np.clip(x / np.maximum(norm, 1e-300) @ tops_unit.T, -1, 1))[:, b_cell]
            cone = norm * b_most * np.maximum(0, np.cos(np.maximum(0, angle - b_angle)))
            gap = np.maximum(0, np.maximum(far - b_hi, b_lo - far))
            reach = np.minimum(np.minimum(cone, dot[:, b_cell] + norm * b_hi), (norm * norm + b_most * b_most - gap * gap) / 2) + 1e-3 + 1e-6 * norm * b_most
            go = (reach >= p["kth"].to_numpy()[:, None]) & ~((p["cell"].to_numpy()[:, None] == b_cell) & (p["part"].to_numpy()[:, None] == b_part))
            i, c = np.nonzero(go)
            yield pd.DataFrame({"vec_id": p["vec_id"].to_numpy()[i], "v": p["v"].to_numpy()[i], "cell": b_cell[c], "part": b_part[c], "batch": p["batch"].to_numpy()[i], "kth": p["kth"].to_numpy()[i]})

    asked = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "v", "cell", "part", "batch", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    second = round_(asked.mapInPandas(ask, "vec_id long, v array<long>, cell int, part int, batch long, kth double"), "search-others")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(second).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
