"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Every shard of a bounded number of vectors becomes one row that holds its graph as flat neighbour
arrays; blocks of queries meet every shard, and the shards' results are merged by exact distance.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import cut, mix

#: Vectors in a shard and queries in a block, on average.
SHARD_ROWS, BLOCK_ROWS = 4096, 512
#: Links of a node (twice as many on the ground level), and candidates held while building and searching.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 12, 48, 100

INDEX_SCHEMA = "dim int, shard int, ids binary, runs binary, vectors binary, entry int, levels binary, links binary"


class Graph:
    """Nodes are distinct vectors; ``links[level]`` is a flat array of ``width(level)`` neighbours a node, -1 where free."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int):
        self.x, self.levels, self.links, self.entry = vectors, levels, links, entry

    @staticmethod
    def width(level: int) -> int:
        return LINKS * (1 if level else 2)

    def near(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = self.x[nodes] - q
        return np.einsum("ij,ij->i", d, d)

    def search(self, q: np.ndarray, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` best found on a level from the (distance, node) pairs of start, nearest first."""
        links, seen = self.links[level], np.zeros(len(self.x), bool)
        seen[[n for _, n in start]] = True
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, n) for d, n in start]
        heapq.heapify(best)
        while todo:
            d, n = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            near = links[n]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for dist, m in zip(self.near(q, near).tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-dist, m))
                elif dist < -best[0][0]:
                    heapq.heapreplace(best, (-dist, m))
                else:
                    continue
                heapq.heappush(todo, (dist, m))
        return sorted((-d, n) for d, n in best)

    def descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self.near(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), to, -1):
            at = self.search(q, at, 1, level)[:1]
        return at

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Up to ``most`` of (distance, node) pairs, nearest first: those nearer to the centre than to any chosen one, then the nearest others."""
        if len(found) <= most:
            return [n for _, n in found]
        nodes = np.array([n for _, n in found])
        v = self.x[nodes]
        sq = np.einsum("ij,ij->i", v, v)
        apart = sq[:, None] - 2 * v @ v.T + sq
        closest = np.full(len(nodes), np.inf)
        chosen, rest = [], []
        for i, (d, _) in enumerate(found):
            if d < closest[i]:
                chosen.append(i)
                np.minimum(closest, apart[i], out=closest)
                if len(chosen) == most:
                    break
            else:
                rest.append(i)
        return nodes[chosen + rest[: most - len(chosen)]].tolist()

    def connect(self, a: int, b: int, level: int) -> None:
        """Adds b to the links of a; a full list keeps a spread choice."""
        own = self.links[level][a]
        free = np.flatnonzero(own < 0)
        if len(free):
            own[free[0]] = b
            return
        nodes = np.append(own, b)
        dist = self.near(self.x[a], nodes)
        order = np.argsort(dist, kind="stable")
        own[:] = self.spread([(float(dist[i]), int(nodes[i])) for i in order], len(own))

    def insert(self, node: int) -> None:
        q, level, top = self.x[node], int(self.levels[node]), int(self.levels[self.entry])
        at = self.descend(q, level)
        for lv in range(min(level, top), -1, -1):
            at = self.search(q, at, BUILD_WIDTH, lv)
            for n in self.spread(at, LINKS):
                self.connect(node, n, lv)
                self.connect(n, node, lv)
        if level > top:
            self.entry = node


def build(vectors: np.ndarray) -> Graph:
    """The graph of distinct vectors; levels come from a hash of the place, so a rebuilt shard is the same."""
    u = (mix(np.arange(1, len(vectors) + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53
    levels = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(np.int32), 8)
    links = [np.full((len(vectors), Graph.width(lv)), -1, np.int32) for lv in range(int(levels.max()) + 1)]
    g = Graph(vectors, levels, links, 0)
    for node in range(1, len(vectors)):
        g.insert(node)
    return g


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    x = np.array(pdf["vec"].tolist(), dtype=np.float64)
    distinct, of = np.unique(x, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    ids, runs = pdf["vec_id"].to_numpy(np.int64)[order], np.searchsorted(of.ravel()[order], np.arange(len(distinct) + 1))
    scattered = np.random.default_rng(5).permutation(len(distinct))  # sorted vectors would make a poor order of insertion
    g = build(distinct[scattered])
    starts = [ids[runs[n] : runs[n + 1]] for n in scattered]
    links = b"".join(a.tobytes() for a in g.links)
    lens = np.cumsum([0, *map(len, starts)])
    return pd.DataFrame([[int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), np.concatenate(starts).tobytes(), lens.astype(np.int64).tobytes(), g.x.tobytes(), g.entry, g.levels.tobytes(), links]], columns=["dim", "shard", "ids", "runs", "vectors", "entry", "levels", "links"])


def _graph(row) -> tuple[Graph, np.ndarray, np.ndarray]:
    levels, x = np.frombuffer(row.levels, np.int32), np.frombuffer(row.vectors, np.float64).reshape(-1, row.dim)
    links, flat, at = [], np.frombuffer(row.links, np.int32), 0
    for lv in range(int(levels.max()) + 1):
        size = len(x) * Graph.width(lv)
        links.append(flat[at : at + size].reshape(len(x), -1))
        at += size
    return Graph(x, levels, links, row.entry), np.frombuffer(row.ids, np.int64), np.frombuffer(row.runs, np.int64)


def with_ties(g: Graph, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
    """The k + 1 nearest nodes found and all that are as near as the last; the search widens until it sees beyond the tie."""
    start = g.descend(q, 0)
    while True:
        found = g.search(q, start, width, 0)
        if len(found) <= k or found[-1][0] > found[k][0] or len(found) < width:
            break
        width *= 2
    return [f for f in found if f[0] <= found[min(k, len(found) - 1)][0]]


def _finder(k: int, width: int):
    def find(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                g, ids, runs = _graph(row)
                out = []
                queries = np.frombuffer(row.q_vectors, np.float64).reshape(-1, row.dim)
                for qid, q in zip(row.q_ids, queries, strict=True):
                    left = []
                    for d, n in with_ties(g, q, k, max(width, k + 1)):
                        own = ids[runs[n] : runs[n + 1]]
                        left += [(qid, int(v), d**0.5) for v in own[own != qid][:k]]  # ids of a node ascend, and all are equally near
                    out += sorted(left, key=lambda r: (r[2], r[1]))[:k]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return find


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard of (vec_id, embedding): ids and vectors with the flat neighbour arrays of its graph.

    Vectors that are null, zero, or hold null or non-finite components are left out; vectors of
    different lengths never share a shard. Equal vectors of a shard are one node with many ids, so
    a vector that very many rows share costs no links.
    """
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.size("embedding").alias("dim"))
    sizes = cut(good.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")))
    tasks = sizes.agg(F.sum("shards")).first()[0] or 1  # a graph takes long to build and little to send: one task each
    dealt = good.withColumn("deal", F.xxhash64(F.lit(3), F.monotonically_increasing_id())).join(sizes, "dim")
    dealt = dealt.select("vec_id", "vec", "dim", F.pmod("deal", F.col("shards").cast("long")).cast("int").alias("shard"))
    return dealt.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(_index, INDEX_SCHEMA)


def search(graphs: DataFrame, queries: DataFrame, k: int = 10, width: int = SEARCH_WIDTH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, embedding) over all shards.

    Unusable queries get no rows, and neither does an empty table. Rows with the query's own vec_id are not its
    candidates; repeated rows of a vec_id count once. Ties go to the smaller vec_id, also where very many rows tie: a
    shard's search goes on until it is past them. Other columns are ignored, whatever they are called. score is the Euclidean distance of
    the original vectors in double precision.
    """
    asked = queries.where(usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.size("embedding").alias("dim"))
    n = max(1, -(-asked.count() // block_rows))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        return pd.DataFrame([[int(pdf["dim"].iloc[0]), pdf["vec_id"].tolist(), np.array(pdf["vec"].tolist(), np.float64).tobytes()]], columns=["dim", "q_ids", "q_vectors"])

    blocks = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block")).applyInPandas(pack, "dim int, q_ids array<bigint>, q_vectors binary")
    shards = graphs.groupBy("dim").agg(F.count("*").cast("int").alias("shards"))
    # every block goes to every shard of its length: shard numbers run from 0
    sent = blocks.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    pairs = sent.join(graphs, ["dim", "shard"])
    found = pairs.mapInPandas(_finder(k, width), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k nearest of the rows that is_query names among all rows; the graphs are built once and checkpointed."""
    return search(cut(index(vectors)), vectors.where(is_query), k)
