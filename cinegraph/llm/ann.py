"""Approximate nearest neighbours by a robust-pruned directed graph in each shard, searched by beams.

The largest inner product is the smallest distance once every vector has one more component, sqrt(M^2 - |x|^2) with M
the shard's largest norm, and a query has 0 there. Graphs are built and searched in that space, in single precision and
scaled to norms of 1 at most; scores are taken from the vectors as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.llm.common import one_thread, written

#: Vectors that a shard is laid out for, edges of a node and, until it is pruned, at most; relaxation of the pruning.
SHARD_ROWS, DEGREE, ROOM, ALPHA = 8192, 28, 44, 1.2
#: Beam widths while building and searching; beam entries that one round expands; nodes and queries taken together.
BUILD_BEAM, SEARCH_BEAM, EXPAND, BATCH, QUERIES = 56, 160, 4, 256, 512
#: Blocks of queries that one task asks of its shard: a shard goes to as many tasks as it takes.
BLOCKS = 64


def beam(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the nearest width nodes that greedy search finds for each row of q; -1 where none."""
    n, k = len(q), len(x)
    ids, dist = np.full((n, width), -1), np.full((n, width), np.inf, np.float32)
    ids[:, 0], dist[:, 0] = entry, ((q - x[entry]) ** 2).sum(1)
    done, seen = np.zeros((n, width), bool), np.zeros((n, k), bool)
    seen[:, entry] = True
    while True:
        free = ~done & (ids >= 0)
        row, col = np.nonzero(free & (np.cumsum(free, 1) <= EXPAND))
        if not len(row):
            return ids, dist
        done[row, col] = True
        near = edges[ids[row, col]]
        key = np.repeat(row, near.shape[1]) * k + near.ravel()
        key = np.unique(key[near.ravel() >= 0])
        r, c = np.divmod(key, k)
        new = ~seen[r, c]
        r, c = r[new], c[new]
        seen[r, c] = True
        count = np.bincount(r, minlength=n)
        place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        more = np.full((n, count.max(initial=0)), -1), np.full((n, count.max(initial=0)), np.inf, np.float32)
        more[0][r, place], more[1][r, place] = c, ((x[c] - q[r]) ** 2).sum(1)
        ids, dist = np.concatenate((ids, more[0]), 1), np.concatenate((dist, more[1]), 1)
        done = np.concatenate((done, np.zeros(more[0].shape, bool)), 1)
        best = np.argsort(dist, 1, kind="stable")[:, :width]
        ids, dist, done = (np.take_along_axis(a, best, 1) for a in (ids, dist, done))


def pruned(x: np.ndarray, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
    """At most DEGREE of each node's candidates: the nearest, then always the nearest that none taken is closer to by ALPHA."""
    v = x[near]
    dist = ((v - x[nodes][:, None]) ** 2).sum(2)
    dist[(near < 0) | (near == nodes[:, None])] = np.inf
    order = np.argsort(dist, 1, kind="stable")
    near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    norm = (v * v).sum(2)
    between = norm[:, :, None] + norm[:, None] - 2 * v @ v.transpose(0, 2, 1)
    alive, rows = np.isfinite(dist), np.arange(len(nodes))
    alive[:, 1:] &= near[:, 1:] != near[:, :-1]
    out = np.full((len(nodes), ROOM), -1)
    for i in range(DEGREE):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        out[some, i] = near[rows, pick][some]
        alive &= ALPHA * ALPHA * between[rows, pick] > dist
        alive[rows, pick] = False
    return out


def build(x: np.ndarray, seed: int = 9) -> tuple[np.ndarray, int]:
    """(edges, entry) of a graph over the rows of x: nodes come in a seeded order, search the graph so far and link."""
    n = len(x)
    edges = np.full((n, ROOM), -1)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    at = 1
    while at < n:
        nodes = order[at : at + min(BATCH, max(1, at // 2))]
        found = beam(x, edges, entry, x[nodes], BUILD_BEAM)[0]
        edges[nodes] = pruned(x, nodes, found)
        to, source = edges[nodes].ravel(), np.repeat(nodes, ROOM)
        to, source = to[to >= 0], source[to >= 0]
        turn = np.argsort(to, kind="stable")
        to, source = to[turn], source[turn]
        heads, start, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(start, count)
        wide = np.full((len(heads), ROOM + int(count.max(initial=0))), -1)
        wide[:, :ROOM] = edges[heads]
        wide[np.repeat(np.arange(len(heads)), count), ROOM + place] = source
        wide = np.take_along_axis(wide, np.argsort(wide < 0, 1, kind="stable"), 1)
        full = (wide >= 0).sum(1) > ROOM
        edges[heads[~full]] = wide[~full, :ROOM]
        for i in range(0, int(full.sum()), BATCH):
            some = np.flatnonzero(full)[i : i + BATCH]
            edges[heads[some]] = pruned(x, heads[some], wide[some])
        at += len(nodes)
    return edges, entry


INDEX = "dim int, shard int, n_nodes int, entry int, n_rows long, ids binary, owner binary, vectors binary, graph binary, edges binary"


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by one number, so that the longest has norm 1, without overflow on the way."""
    v = v / max(np.abs(v).max(initial=0), np.finfo(float).tiny)
    return v / np.sqrt((v * v).sum(1).max(initial=0))


def _index(kind: str):
    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        pdf = pdf.sort_values("id", kind="stable")
        nodes, owner = np.unique(np.stack(pdf["v"].to_numpy()).astype(kind), axis=0, return_inverse=True)
        unit = scaled(nodes.astype(float))
        x = np.concatenate((unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))[:, None]), 1).astype(np.float32)
        edges, entry = build(x)
        row = (int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), len(nodes), entry, len(pdf), pdf["id"].to_numpy("<i8").tobytes(), owner.ravel().astype("<i4").tobytes(), nodes.tobytes(), x.astype("<f4").tobytes(), edges.astype("<i4").tobytes())
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    return index


def kind_of(vectors: DataFrame) -> str:
    """Single precision for vectors that came so, else double."""
    return "<f4" if vectors.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"


def index(vectors: DataFrame, shards: int) -> DataFrame:
    """(id, v, dim) to one row a shard with its graph, written; equal vectors share a node. Every row is in one shard."""
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("dim", "shard").applyInPandas(_index(kind_of(vectors)), INDEX))


def _search(k: int, width: int, kind: str):
    """Rows of shards, each before the blocks of queries that are asked of it, to what is found in it for each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        at = None
        for b in batches:
            for r in range(b.num_rows):
                dim, shard, q = (b.column(c)[r].as_py() for c in ("dim", "shard", "q"))
                if q is None:
                    nodes, entry, ids, owner, vectors, graph, edges = (b.column(c)[r].as_py() for c in ("n_nodes", "entry", "ids", "owner", "vectors", "graph", "edges"))
                    v, x = np.frombuffer(vectors, kind).reshape(nodes, dim), np.frombuffer(graph, "<f4").reshape(nodes, dim + 1)
                    e = np.frombuffer(edges, "<i4").reshape(nodes, ROOM).astype(np.int64)
                    id_, own = np.frombuffer(ids, "<i8"), np.frombuffer(owner, "<i4")
                    turn = np.argsort(own, kind="stable")
                    cuts = np.searchsorted(own[turn], np.arange(nodes + 1))
                    at = (dim, shard)
                    continue
                # Queries of a length that no candidate of this shard has.
                if at != (dim, shard):
                    continue
                q_id, q_rows, q = np.array(b.column("q_ids")[r].as_py(), np.int64), b.column("q_rows")[r].as_py(), np.frombuffer(q, kind).reshape(-1, dim).astype(float)
                unit = np.concatenate([scaled(one[None]) for one in q])
                found = beam(x, e, entry, np.concatenate((unit, np.zeros((len(q), 1))), 1).astype(np.float32), width)[0]
                score = (v[found].astype(float) * q[:, None]).sum(2)
                score[found < 0] = -np.inf
                out = []
                for i in range(len(q)):
                    mine: list[tuple[float, int]] = []
                    for j in np.argsort(-score[i], kind="stable").tolist():
                        if found[i, j] < 0 or (len(mine) >= k and score[i, j] < mine[k - 1][0]):
                            break
                        # The rows of a node are in order of id; k and one more of them are all that can count.
                        rows = turn[cuts[found[i, j]] : min(cuts[found[i, j] + 1], cuts[found[i, j]] + k + 1)]
                        mine += [(float(score[i, j]), v) for v in id_[rows].tolist() if v != q_id[i]]
                    mine.sort(key=lambda s: (-s[0], s[1]))
                    out.append([{"score": s, "vec_id": v} for s, v in mine[:k]])
                yield pa.RecordBatch.from_arrays([pa.array(q_id), pa.array(q_rows, pa.int64()), pa.array(out, pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))], ["query_id", "query_row", "found"])

    return search


def _blocks(kind: str):
    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(pdf["v"].to_numpy()).astype(kind)
        return pd.DataFrame([(int(pdf["dim"].iloc[0]), int(pdf["block"].iloc[0]), pdf["id"].tolist(), pdf["row"].tolist(), q.tobytes())], columns=["dim", "block", "q_ids", "q_rows", "q"])

    return blocks


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, dim) of the rows that take part: no null id, vector or component, all finite, not all zero; rows that are
    equal in both are one. Single precision stays, all else is double."""
    single = vectors.schema[vector].dataType.elementType.simpleString() == "float"
    v = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>" if single else "array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda c: c != 0)).distinct().withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", width: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products that beam search finds for each query.

    Candidates are all usable rows of as many components, but the query's own id; ties go to the smaller id. Scores are
    exact, in double precision on the vectors as given. Rows with a null id or vector, null or non-finite components or
    zeros only take no part; rows of equal id and vector are one, of an equal id or an equal vector candidates, and
    queries, each; no usable row gives no rows. Products must not overflow a double. Queries go to every shard in blocks
    of bounded size, and every shard answers with k rows a query. A task gets its shard once, first, and then up to
    BLOCKS blocks one after the other, so it holds no more than a shard and a block. Other columns are not read.
    """
    v = usable(vectors, key, vector)
    kind = kind_of(v)
    shards = max(1, -(-v.count() // shard_rows))
    graphs = index(v, shards)
    q = usable(queries, key, vector).withColumn("row", F.xxhash64("id", "v"))
    groups = max(1, -(-q.count() // QUERIES))
    blocks = written(q.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups))).groupBy("dim", "block").applyInPandas(_blocks(kind), "dim int, block long, q_ids array<long>, q_rows array<long>, q binary"))
    copies = -(-groups // BLOCKS)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = blocks.withColumn("copy", (F.col("block") % copies).cast("int")).drop("block").withColumn("shard", each(shards))
    tasks = graphs.withColumn("copy", each(copies)).unionByName(asked, allowMissingColumns=True)
    place = ("dim", "shard", "copy")
    tasks = tasks.repartition(shards * copies, *place).sortWithinPartitions(*place, F.col("q").isNotNull())
    found = tasks.select("dim", "shard", "n_nodes", "entry", "ids", "owner", "vectors", "graph", "edges", "q_ids", "q_rows", "q").mapInArrow(_search(k, width, kind), "query_id long, query_row long, found array<struct<score:double,vec_id:long>>")
    rows = found.select("query_id", "query_row", F.inline("found"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
