"""Vectors as codes of a codebook for each of their parts, fitted by exact Lloyd rounds in whole numbers.

Between rounds a part's distances change by no more than the codebook's entries move. Each block of vectors keeps, for each
entry, a heap of the parts assigned to it, keyed by how far the second nearest entry is behind plus the entry's drift so
far. A round pops the parts whose key the drift has reached, and rescans these exactly; all others are where they were.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.llm.common import forget, one_thread, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components count as this at most, for sums that fit 64 bits: 16,384 before they are scaled.
LIMIT = 1 << 24
#: Bytes of a block's components: what a worker holds at once besides a batch that it reads.
BLOCK = 4 << 20
#: Rows whose distances to all entries are computed at once.
CHUNK = 4096
#: By how much bounds give way to rounding, as a share of them; far more than doubles lose.
SLACK = 1e-9


def whole(vectors: np.ndarray) -> np.ndarray:
    """Components as whole numbers, rounded down."""
    return np.clip(np.floor(SCALE * np.asarray(vectors, np.float64)), -LIMIT, LIMIT).astype(np.int32)


@dataclass
class Codebooks:
    """entries[part, entry, component], and for each entry how far it and the fastest other one have moved in all."""

    entries: np.ndarray
    drift: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.drift = np.zeros(self.entries.shape[:2])

    def move(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """Each entry goes to the mean of its parts, rounded down; one without parts stays."""
        used = counts > 0
        new = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], self.entries)
        moved = np.sqrt(((new - self.entries) ** 2).sum(2).astype(np.float64)) * (1 + SLACK)
        for part, far in enumerate(moved):
            first = int(far.argmax())
            others = np.full(len(far), far[first])
            others[first] = np.delete(far, first).max(initial=0)
            self.drift[part] += far + others
        self.entries = new

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest_two(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its nearest entry (ties: the lower), the squared distance to it, and that of the nearest other.

    Doubles hold the squares exactly while these have at most 53 bits; beyond, whole numbers do.
    """
    best, near, other = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    exact = entries.shape[1] * (2 * most) ** 2 < 2**52
    c = entries.astype(np.float64)
    step = CHUNK if exact else max(1, CHUNK // max(1, entries.shape[1]))
    for a in range(0, len(x), step):
        if exact:
            y = x[a : a + step].astype(np.float64)
            d = ((y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)).astype(np.int64)
        else:
            d = np.stack([((x[a : a + step].astype(np.int64) - e) ** 2).sum(1) for e in entries], 1)
        rows, i = np.arange(len(d)), d.argmin(1)
        best[a : a + step], near[a : a + step] = i, d[rows, i]
        if d.shape[1] > 1:
            d[rows, i] = np.iinfo(np.int64).max
            other[a : a + step] = d.min(1)
    return best, near, other


class Block:
    """Vectors of one block (x[row, part, component]), their entries, heaps and sums."""

    def __init__(self, x: np.ndarray, codes=None, keys=None, items=None, sums=None) -> None:
        self.x, self.codes, self.keys, self.items, self.sums = x, codes, keys, items, sums

    @classmethod
    def read(cls, row: dict, books: Codebooks) -> Block:
        parts, k, w = books.entries.shape
        x = np.frombuffer(row["x"], np.int32).reshape(-1, parts, w)
        if row["codes"] is None:
            return cls(x)
        shape = (parts, len(x))
        kinds = (("codes", np.uint8, shape), ("keys", np.float64, shape), ("items", np.uint32, shape), ("sums", np.int64, (parts, k, w + 1)))
        return cls(x, *(np.frombuffer(row[n], t).reshape(s).copy() for n, t, s in kinds))

    def fitted(self, books: Codebooks) -> Block:
        """Every part at its nearest entry: those that may have moved are rescanned."""
        parts, k, w = books.entries.shape
        n = len(self.x)
        if first := self.codes is None:
            self.codes, self.keys, self.items = np.zeros((parts, n), np.uint8), np.zeros((parts, n)), np.zeros((parts, n), np.uint32)
            self.sums = np.zeros((parts, k, w + 1), np.int64)
        for p in range(parts):
            entries, drift = books.entries[p], books.drift[p]
            heaps, due = ([[] for _ in range(k)], np.arange(n)) if first else self.due(p, drift)
            if not len(due):
                continue
            x, old = self.x[due, p], self.codes[p, due]
            best, near, other = nearest_two(x, entries)
            u, other = np.sqrt(near.astype(np.float64)), np.sqrt(other.astype(np.float64))
            keys = (other - u) - SLACK * (1 + other + u) + drift[best]
            self.codes[p, due] = best
            ones = np.concatenate((x.astype(np.int64), np.ones((len(x), 1), np.int64)), 1)
            if not first:
                np.subtract.at(self.sums[p], old, ones)
            np.add.at(self.sums[p], best, ones)
            for a, key, item in zip(best.tolist(), keys.tolist(), due.tolist(), strict=True):
                heapq.heappush(heaps[a], (key, item))
            flat = [pair for h in heaps for pair in h]
            self.keys[p], self.items[p] = [key for key, _ in flat], [item for _, item in flat]
        return self

    def due(self, p: int, drift: np.ndarray) -> tuple[list[list], np.ndarray]:
        """The heaps of a part position, and the rows popped off them; no heap is unpacked unless one has such a row."""
        ends = np.cumsum(np.bincount(self.codes[p], minlength=len(drift)))
        starts = np.concatenate(([0], ends[:-1]))
        reached = drift + SLACK * (1 + drift)
        full = starts < ends
        if not (self.keys[p][starts[full]] <= reached[full]).any():
            return [], np.zeros(0, np.int64)
        pairs = list(zip(self.keys[p].tolist(), self.items[p].tolist(), strict=True))
        heaps, popped = [pairs[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], []
        for heap, to in zip(heaps, reached.tolist(), strict=True):
            while heap and heap[0][0] <= to:
                popped.append(heapq.heappop(heap)[1])
        return heaps, np.array(popped, np.int64)

    def errors(self, books: Codebooks) -> np.ndarray:
        out = np.zeros(len(self.x), np.int64)
        for p, entries in enumerate(books.entries):
            out += ((self.x[:, p] - entries[self.codes[p]]) ** 2).sum(1)
        return out


def _blocks(width: int, schema: pa.Schema):
    """Batches of (k, l, v) to rows of a block each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, most = batch.num_rows, max(1, BLOCK // (4 * width))
            v = batch.column("v")
            x = whole(v.flatten().to_numpy(zero_copy_only=False).reshape(n, width))
            rows = pa.StructArray.from_arrays([batch.column("k"), batch.column("l")], ["k", "l"])
            for a in range(0, n, most):
                part = rows.slice(a, most)
                listed = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
                yield pa.RecordBatch.from_arrays([listed.cast(schema.field("rows").type), pa.array([x[a : a + most].tobytes()], pa.binary()), *[pa.nulls(1, pa.binary())] * 4], schema=schema)

    return run


def _round(books: Codebooks, schema: pa.Schema):
    """Blocks to the same blocks, fitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("x", "codes", "keys", "items", "sums")}
                b = Block.read(row, books).fitted(books)
                new = [pa.array([c], pa.binary()) for c in (row["x"], *(y.tobytes() for y in (b.codes, b.keys, b.items, b.sums)))]
                yield pa.RecordBatch.from_arrays([batch.column("rows").slice(i, 1), *new], schema=schema)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's blocks, added up: (at, value) where not 0."""
    total = None
    for batch in batches:
        for x in batch.column("sums"):
            one = np.frombuffer(x.as_py(), np.int64)
            total = one.copy() if total is None else total + one
    if total is not None:
        at = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "value"])


def _codes(books: Codebooks, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block.read({n: batch.column(n)[i].as_py() for n in ("x", "codes", "keys", "items", "sums")}, books)
                rows = batch.column("rows")[i].values
                codes = pa.array([c.tobytes() for c in b.codes.T.copy()], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.field("k"), rows.field("l"), codes, pa.array(b.errors(books), pa.int64())], schema=schema)

    return run


def usable(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(k, l, v): key, label and vector of the rows whose vector is there and has finite components only."""
    v = vectors.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("l"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % PARTS == 0) & F.coalesce(fine, F.lit(False)))


def encode(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(k, l, code, error) of each usable vector, its code with a byte for each part, and the codebooks.

    The codebooks start from the vectors of the smallest keys, nulls last and ties by components. Vectors of another length than the very first, and
    of one that does not divide by the number of parts, go like unusable ones; components are held within LIMIT. Null keys and
    labels are kept, repeated rows are coded each for itself, an empty table gives no rows. The blocks are written once a round,
    with their state, and never shuffled; the driver gets the first vectors and one sum for each component of each entry.
    """
    spark = vectors.sparkSession
    v = usable(vectors, key, label, vector)
    order = [F.col("k").asc_nulls_last(), F.col("v")]
    first = v.orderBy(*order).select(F.size("v").alias("n")).first()
    width = first["n"] if first else PARTS
    v = v.where(F.size("v") == width)
    start = np.array([r["v"] for r in v.orderBy(*order).select("v").limit(ENTRIES).collect()]).reshape(-1, width)
    books = Codebooks(whole(start).astype(np.int64).reshape(-1, PARTS, width // PARTS).transpose(1, 0, 2).copy())
    kinds = {f.name: f.dataType for f in v.schema}
    pair = T.StructType([T.StructField(n, kinds[n]) for n in "kl"])
    schema = T.StructType([T.StructField("rows", T.ArrayType(pair))] + [T.StructField(n, T.BinaryType()) for n in ("x", "codes", "keys", "items", "sums")])
    out = T.StructType([*pair.fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    if not len(start):
        return spark.createDataFrame([], out), books
    arrow = _arrow(schema)
    state = v.mapInArrow(_blocks(width, arrow), schema)
    shape = (PARTS, len(start), width // PARTS + 1)
    for n in range(rounds + 1):
        before, state = state, written(state.mapInArrow(_round(books, arrow), schema))
        if n:
            forget(spark, before)
        if n < rounds:
            sums = np.zeros(shape, np.int64)
            for r in state.select("sums").mapInArrow(_totals, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).collect():
                sums.flat[r["at"]] = r["value"]
            books.move(sums[..., :-1], sums[..., -1])
    coded = written(state.mapInArrow(_codes(books, _arrow(out)), out))
    forget(spark, state)
    return coded, books


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code as text, error, label_error (the error of all vectors of the label; nulls are one) and the codebooks' hash."""
    coded, books = encode(vectors)
    totals = coded.groupBy(F.col("l").alias("_l")).agg(F.sum("error").alias("label_error"))
    both = coded.join(totals, F.col("l").eqNullSafe(F.col("_l")))
    return both.select(F.col("k").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
