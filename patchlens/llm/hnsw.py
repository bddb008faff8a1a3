"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node, so many copies of a vector cannot crowd the graph; a node keeps
the smallest ids of its copies, as many as a search can return. A graph is stored as flat
arrays: the vectors, and for each level the nodes on it with a fixed number of neighbours.
Every shard is searched for every query, and the results of the shards are merged.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, neither as query nor as candidate; vectors of different length have graphs of their
own and never meet; ties go to the smaller id; rows without an id take no part; rows that
repeat an id and vector count once; a query with fewer candidates gets all of them; empty
tables give no rows; columns other than id and vector are dropped.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlens.session import materialize

SHARD = 4_096  # vectors of a shard, on average
LINKS = 16  # neighbours kept on the upper levels, twice as many on the lowest
BUILD_WIDTH = 64  # candidates looked at while building
SEARCH_WIDTH = 64
QUERY_BLOCK = 512


class Graph:
    """neighbours[level] is an array (nodes of the level, links) of node numbers, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.vectors = vectors
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.levels = levels  # of each node
        self.entry = -1
        tops = int(levels.max(initial=-1)) + 1
        self.row = [np.full(len(vectors), -1, dtype=np.int32) for _ in range(tops)]  # node -> row of the level
        self.neighbours = []
        for level in range(tops):
            on = np.flatnonzero(levels >= level)
            self.row[level][on] = np.arange(len(on))
            self.neighbours.append(np.full((len(on), 2 * LINKS if level == 0 else LINKS), -1, dtype=np.int32))

    def links(self, level: int, node: int) -> np.ndarray:
        found = self.neighbours[level][self.row[level][node]]
        return found[: int((found >= 0).sum())]

    def put(self, level: int, node: int, linked):
        row = self.neighbours[level][self.row[level][node]]
        row[:] = -1
        row[: len(linked)] = linked

    def distances(self, q: np.ndarray, nodes) -> np.ndarray:
        d = self.vectors[nodes] - q
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, q: np.ndarray, level: int, starts: list[tuple[float, int]], width: int) -> list[tuple[float, int]]:
        """Up to `width` nodes of a level near q, nearest first: best-first search from `starts`."""
        seen = np.zeros(len(self.vectors), dtype=bool)
        seen[[n for _, n in starts]] = True
        ahead, found = list(starts), [(-d, -n) for d, n in starts]
        heapq.heapify(ahead)
        heapq.heapify(found)
        neighbours, row = self.neighbours[level], self.row[level]
        while ahead:
            d, node = heapq.heappop(ahead)
            if len(found) >= width and d > -found[0][0]:
                break
            near = neighbours[row[node]]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            ds = self.distances(q, near)
            if len(found) >= width:
                keep = ds < -found[0][0]
                near, ds = near[keep], ds[keep]
            for e, n in zip(ds.tolist(), near.tolist()):
                if len(found) < width:
                    heapq.heappush(found, (-e, -n))
                elif e < -found[0][0]:
                    heapq.heapreplace(found, (-e, -n))
                else:
                    continue
                heapq.heappush(ahead, (e, n))
        return sorted((-d, -n) for d, n in found)

    def diverse(self, candidates: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: one that is closer to a chosen one than to the node itself comes last."""
        if len(candidates) <= most:
            return [n for _, n in candidates]
        nodes = np.array([n for _, n in candidates])
        own = np.array([d for d, _ in candidates])
        v = self.vectors[nodes]
        norms = self.norms[nodes]
        between = norms[:, None] + norms[None, :] - 2 * (v @ v.T)
        closest = np.full(len(nodes), np.inf)
        chosen, left = [], []
        for i in range(len(nodes)):
            if closest[i] > own[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.minimum(closest, between[i], out=closest)
            else:
                left.append(i)
        chosen += left[: most - len(chosen)]
        return nodes[chosen].tolist()

    def add(self, node: int):
        q, level = self.vectors[node], int(self.levels[node])
        if self.entry < 0:
            self.entry = node
            return
        top = int(self.levels[self.entry])
        at = [(float(self.distances(q, [self.entry])[0]), self.entry)]
        for above in range(top, level, -1):
            at = self.nearest(q, above, at, 1)
        for on in range(min(level, top), -1, -1):
            at = self.nearest(q, on, at, BUILD_WIDTH)
            most = 2 * LINKS if on == 0 else LINKS
            chosen = self.diverse(at, LINKS)
            self.put(on, node, chosen)
            for other in chosen:
                linked = self.links(on, other)
                if len(linked) < most:
                    self.neighbours[on][self.row[on][other], len(linked)] = node
                else:
                    pool = np.append(linked, node)
                    ds = self.distances(self.vectors[other], pool)
                    order = np.argsort(ds, kind="stable")
                    self.put(on, other, self.diverse(list(zip(ds[order].tolist(), pool[order].tolist())), most))
        if level > top:
            self.entry = node

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [(float(self.distances(q, [self.entry])[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self.nearest(q, level, at, 1)
        return self.nearest(q, 0, at, width)


def build(vectors: np.ndarray) -> Graph:
    """The graph of a shard; levels come from a hash of the position, so a retried task builds the same one."""
    rng = np.random.default_rng(len(vectors))
    levels = np.minimum((-np.log(rng.random(len(vectors))) / math.log(LINKS)).astype(np.int32), 6)
    graph = Graph(vectors, levels)
    for node in range(len(vectors)):
        graph.add(node)
    return graph


# --- on Spark -----------------------------------------------------------------------------


def usable(rows: DataFrame, own: str, vector: str) -> DataFrame:
    """(own, v array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(own).cast("bigint").alias("own"), v.alias("v")).where(F.col("own").isNotNull() & F.col("v").isNotNull() & fine)


def index(rows: DataFrame, k: int, own: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per shard: (shard, dimension, ids, counts, vectors, levels, entry, neighbours), all flat arrays.

    ids holds up to k + 1 of the smallest ids of each node, counts how many.
    """
    vectors = usable(rows, own, vector)
    shards = max(1, -(-vectors.count() // SHARD))
    # Distinct vectors; the smallest ids of each are kept by a top-k before the shuffle.
    ranked = vectors.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("own"))).where(F.col("nth") <= k + 1)
    nodes = ranked.groupBy("v").agg(F.sort_array(F.collect_list("own")).alias("ids"))
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).withColumn("dimension", F.size("v"))

    def make(key: tuple, table: pa.Table) -> pa.Table:
        from patchlens.llm import hnsw

        table = table.take(pa.array(np.argsort([x[0] for x in table.column("ids").to_pylist()], kind="stable")))
        ids = table.column("ids").combine_chunks()
        dimension = key[1].as_py()
        vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dimension)
        graph = hnsw.build(vectors)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "dimension": pa.array([dimension], pa.int32()),
            "ids": pa.array([ids.flatten().to_numpy()], pa.list_(pa.int64())),
            "counts": pa.array([np.diff(ids.offsets.to_numpy())], pa.list_(pa.int32())),
            "vectors": pa.array([vectors.ravel()], pa.list_(pa.float64())), "levels": pa.array([graph.levels], pa.list_(pa.int32())),
            "entry": pa.array([graph.entry], pa.int32()), "neighbours": pa.array([np.concatenate([x.ravel() for x in graph.neighbours])], pa.list_(pa.int32())),
        })

    return placed.groupBy("shard", "dimension").applyInArrow(
        make,
        "shard int, dimension int, ids array<bigint>, counts array<int>, vectors array<double>, levels array<int>, entry int, neighbours array<int>",
    )


def load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray]:
    """(graph, ids, where the ids of each node start) from the flat arrays of a shard."""
    vectors = np.array(row["vectors"], dtype=np.float64).reshape(-1, row["dimension"])
    graph = Graph(vectors, np.array(row["levels"], dtype=np.int32))
    flat, at = np.array(row["neighbours"], dtype=np.int32), 0
    for level, rows in enumerate(graph.neighbours):
        graph.neighbours[level] = flat[at : at + rows.size].reshape(rows.shape)
        at += rows.size
    graph.entry = row["entry"]
    return graph, np.array(row["ids"], dtype=np.int64), np.concatenate([[0], np.cumsum(row["counts"])])


def search(shards: DataFrame, queries: DataFrame, k: int, own: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that the graphs find, for queries whose ids are left out of their own results.

    Queries travel in blocks to every shard; a task holds one shard and one block at a time.
    """
    asked = usable(queries, own, vector).distinct().withColumn("dimension", F.size("v"))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("own"), F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))))
    packed = blocks.groupBy("block", "dimension").agg(F.collect_list(F.struct("own", "v")).alias("queries"))
    places = shards.select("shard", "dimension")
    units = packed.join(places, "dimension").join(shards, ["shard", "dimension"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from patchlens.llm import hnsw

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() if c in ("dimension", "entry", "queries") else batch.column(c)[i].values.to_numpy() for c in batch.schema.names if c not in ("shard", "block")}
                graph, ids, starts = hnsw.load(row)
                out: tuple[list, list, list] = ([], [], [])
                for query in row["queries"]:
                    q = np.array(query["v"])
                    found = []
                    for d, node in graph.search(q, max(hnsw.SEARCH_WIDTH, 4 * k)):
                        if len(found) >= k and d > found[k - 1][0]:
                            break
                        found += [(d, x) for x in ids[starts[node] : starts[node + 1]].tolist() if x != query["own"]]
                        found.sort()
                    for d, x in found[:k]:
                        out[0].append(query["own"])
                        out[1].append(x)
                        out[2].append(math.sqrt(d))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = units.mapInArrow(find, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int, own: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return search(materialize(index(rows, k, own, vector), "graphs"), queries, k, own, vector)
