"""Exact top-k inner products through a distributed M-tree.

One more component makes inner products metric: with a third square ``M`` - |x| squared added to a stored vector and 0
to a query, their distance grows as their product falls. The stored vectors hang under routing objects (a bounded
sample); every subtree has a covering radius, pages inside it have their own routing object and radius, and every
vector keeps its distance to it. A query first searches the subtree nearest to it, best page first; the k-th distance
found prunes all other subtrees, pages and, by the stored parent distances, single vectors, before any product is
computed. A pruned part can't hold a better or equal result, so the answer is exact; products are whole numbers.

Large subtrees are split, and so are the queries that visit one, so no group grows with the table.

Defined cases: vectors that are NULL, hold NULL or a non-finite component, or have a NULL id take no part; shorter
vectors count as filled with zeros; rows that share an id are no candidates for its query, and the smallest of
their vectors is the query; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustframe.session import cut_lineage, load_table

#: Routing objects below the root, vectors of a subtree and of a page, queries that search a subtree together.
ROUTES, SUBTREE, PAGE, QUERIES = 64, 4096, 64, 2048
#: Slack of the bounds, against rounding of square roots.
SLACK = 1e-6
RESULT = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """``vector`` as whole numbers floor(scale * x); rows that can't take part are left out."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(vector).isNotNull()).where(fine).withColumn(vector, whole.cast("array<bigint>"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of all rows; in floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Subtree:
    """The pages of one subtree: routing objects chosen farthest first, stored parent distances and radii."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, top: int):
        self.ids, self.rows, self.top = ids, rows, top
        self.norms = (rows * rows).sum(axis=1)
        self.extra = np.sqrt(np.maximum(top - self.norms, 0).astype(np.float64))
        pages = max(1, -(-len(rows) // PAGE))
        picked, gap = [0], self.between(0)
        parents = np.zeros(len(rows), np.int64)
        for _ in range(pages - 1):
            far = int(gap.argmax())
            if gap[far] <= 0:
                break
            own = self.between(far)
            closer = own < gap
            parents[closer], gap = len(picked), np.minimum(own, gap)
            picked.append(far)
        order = np.lexsort((gap, parents))
        self.pages = [p[i : i + PAGE] for p in np.split(order, np.flatnonzero(np.diff(parents[order])) + 1) for i in range(0, len(p), PAGE)]
        self.routes = np.array([picked[parents[p[0]]] for p in self.pages])
        self.parent_distance = gap
        self.radius = np.array([gap[p].max() for p in self.pages])
        self.page_sizes = np.array([len(p) for p in self.pages])
        self.most = float(np.abs(rows).max(initial=0)) * rows.shape[1]
        self.floats = rows.astype(np.float64)

    def products_with(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whole-number products of some stored vectors with one; in floating point where that is exact."""
        if self.most * float(np.abs(row).max(initial=0)) < 2**52:
            return (self.floats[at] @ row.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ row

    def between(self, at: int) -> np.ndarray:
        """Distances of all stored vectors to one of them."""
        dot = products(self.rows, self.rows[at : at + 1])[:, 0]
        squared = self.norms + self.norms[at] - 2 * dot + (self.extra - self.extra[at]) ** 2
        return np.sqrt(np.maximum(squared, 0.0))

    def search(self, query_id: int, norm: int, to_routes: np.ndarray, row: np.ndarray, bound: float, k: int) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) within ``bound``; blocks of pages in order of their lower bound."""
        best: list[tuple[int, int]] = []
        lower = to_routes - self.radius
        base = norm + self.top
        order = np.argsort(lower, kind="stable")
        begin, step = 0, 1
        while begin < len(order):
            limit = bound * (1 + SLACK) + SLACK
            pages = order[begin : begin + step]
            pages = pages[lower[pages] <= limit]
            if not len(pages):
                break
            # a page alone first, then twice as many at a time: the bound is tight soon, and blocks are cheaper than pages
            begin, step = begin + step, 2 * step
            held = np.concatenate([self.pages[p] for p in pages.tolist()])
            ahead = np.repeat(to_routes[pages], self.page_sizes[pages])
            near = held[np.abs(ahead - self.parent_distance[held]) <= limit]
            if not len(near):
                continue
            scores = self.products_with(near, row)
            if len(best) == k:
                good = scores >= best[0][0]
                scores, near = scores[good], near[good]
            for score, vec in zip(scores.tolist(), self.ids[near].tolist(), strict=True):
                if vec != query_id:
                    entry = (score, -vec)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            if len(best) == k:
                bound = min(bound, float(np.sqrt(max(base - 2 * best[0][0], 0))))
        return best


def search_group(stored: pd.DataFrame, queries: pd.DataFrame, width: int, top: int, k: int) -> pd.DataFrame:
    """Results of some queries (query_id, vec, bound) in one subtree (vec_id, vec)."""
    out = []
    if len(stored) and len(queries):
        stored = stored.sort_values("vec_id")
        tree = Subtree(stored["vec_id"].to_numpy(np.int64), matrix(stored["vec"], width), top)
        rows = matrix(queries["vec"], width)
        norms = (rows * rows).sum(axis=1)
        dots = products(rows, tree.rows[tree.routes])
        to_routes = np.sqrt(np.maximum(norms[:, None] + top - 2 * dots, 0).astype(np.float64))
        for i, (qid, bound) in enumerate(zip(queries["query_id"].tolist(), queries["bound"].tolist(), strict=True)):
            out += [(qid, -vec, score) for score, vec in tree.search(qid, int(norms[i]), to_routes[i], rows[i], bound, k)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype=np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors(vec_id, vec), queries(query_id, vec) -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    vectors = vectors.where(F.col("vec_id").isNotNull())
    facts = vectors.agg(F.max(F.size("vec")).alias("width"), F.max(F.aggregate("vec", F.lit(0).cast("bigint"), lambda s, x: s + x * x)).alias("top"), F.count(F.lit(1)).alias("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts["n"]:
        return empty
    # a query may be longer than all stored vectors
    width = max(facts["width"], queries.agg(F.max(F.size("vec"))).first()[0] or 0)
    top = int(facts["top"])
    # ROUTES routing objects: the rows of smallest hash
    routes = [r["vec"] for r in vectors.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(ROUTES).collect()]
    centres = matrix(pd.Series(sorted(set(map(tuple, routes)))), width)
    shared = spark.sparkContext.broadcast(centres)

    def nearest(batches):
        points = shared.value
        norms = (points * points).sum(axis=1)
        extra = np.sqrt(np.maximum(top - norms, 0).astype(np.float64))
        for pdf in batches:
            rows = matrix(pdf["vec"], width)
            own = (rows * rows).sum(axis=1)
            squared = own[:, None] + norms - 2 * products(rows, points) + (np.sqrt(np.maximum(top - own, 0).astype(np.float64))[:, None] - extra) ** 2
            at = squared.argmin(axis=1)
            yield pdf.assign(route=at.astype(np.int32), gap=np.sqrt(np.maximum(squared[np.arange(len(rows)), at], 0)))

    placed = vectors.select("vec_id", "vec").mapInPandas(nearest, "vec_id long, vec array<bigint>, route int, gap double")
    # vectors of one route in parts of about SUBTREE: rings by distance would be tighter, a hash needs no sort
    sizes = placed.groupBy("route").agg(F.ceil(F.count(F.lit(1)) / SUBTREE).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(sizes), "route")  # ROUTES rows
    stored = cut_lineage(placed.withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), F.col("parts")).cast("int")).drop("parts"))
    subtrees = stored.groupBy("route", "part").agg(F.max("gap").alias("radius"))
    by_route = subtrees.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("part", "radius"))).alias("parts"))
    # the routing table has one entry per subtree of SUBTREE vectors
    table = {r["route"]: [(p["part"], p["radius"]) for p in r["parts"]] for r in by_route.collect()}
    entries = [(route, part, radius) for route in sorted(table) for part, radius in table[route]]
    nodes = spark.sparkContext.broadcast((np.array([e[0] for e in entries]), np.array([e[1] for e in entries]), np.array([e[2] for e in entries])))

    def visits(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of queries to subtrees, and each query's own subtree."""
        points = shared.value
        rows = matrix(pdf["vec"], width)
        own = (rows * rows).sum(axis=1)[:, None]
        far = np.sqrt(np.maximum(own + top - 2 * products(rows, points), 0).astype(np.float64))[:, nodes.value[0]]
        return far - nodes.value[2], far.argmin(axis=1)

    def first(batches):
        route, part, _ = nodes.value
        for pdf in batches:
            _, home = visits(pdf)
            yield pdf[["query_id", "vec"]].assign(bound=np.inf, route=route[home].astype(np.int32), part=part[home].astype(np.int32))

    def others(batches):
        route, part, _ = nodes.value
        for pdf in batches:
            lower, home = visits(pdf)
            bound = pdf["bound"].to_numpy()
            open_ = lower <= (bound * (1 + SLACK) + SLACK)[:, None]
            open_[np.arange(len(pdf)), home] = False
            who, where = np.nonzero(open_)
            for at in range(0, len(who), 20_000):
                i, j = who[at : at + 20_000], where[at : at + 20_000]
                yield pdf[["query_id", "vec", "bound"]].iloc[i].assign(route=route[j].astype(np.int32), part=part[j].astype(np.int32))

    schema = "query_id long, vec array<bigint>, bound double, route int, part int"

    def search(visiting: DataFrame) -> DataFrame:
        """Queries meet the vectors of the subtrees that they visit, in groups of QUERIES."""
        groups = visiting.groupBy("route", "part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("groups"))
        asked = visiting.join(F.broadcast(groups), ["route", "part"]).withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).drop("groups")
        held = stored.join(F.broadcast(groups), ["route", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        keys = ["route", "part", "turn"]

        def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return search_group(left, right, width, top, k)

        return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(one, RESULT)

    asked = queries.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min("vec").alias("vec"))
    asked = cut_lineage(asked)
    near = cut_lineage(search(asked.mapInPandas(first, schema)))
    # the k-th score so far bounds the distance of every other result
    kth = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    norm = F.aggregate("vec", F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    bounded = asked.join(kth, "query_id", "left").select("query_id", "vec", F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0), norm + F.lit(top) - 2 * F.col("least")).cast("double"))).otherwise(F.lit(float("inf"))).alias("bound"))
    rest = search(cut_lineage(bounded.mapInPandas(others, schema)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best products of every vector whose id is divisible by 50 with all others."""
    vectors = quantised(load_table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", F.col("embedding").alias("vec"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "vec"))


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as vec from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""
