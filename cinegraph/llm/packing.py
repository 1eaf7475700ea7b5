"""Best-fit packing of token pieces: patterns of few lengths, fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.llm.common import written
from cinegraph.llm.tokens import VOCABULARY, encoder

LENGTH, END = 2048, 0
#: Patterns of three that each smallest length may start, steps of the fit.
TRIPLES, STEPS = 12, 400


def patterns(lengths: np.ndarray, length: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence: all pairs, and an even choice of triples."""
    have = np.zeros(length + 1, bool)
    have[lengths] = True
    small = lengths[lengths <= length // 2]
    pairs = small[have[length - small]]
    out = [np.stack([pairs, length - pairs, np.zeros_like(pairs)], 1)]
    for a in lengths[lengths <= length // 3]:
        b = lengths[(lengths >= a) & (lengths <= (length - a) // 2)]
        b = b[have[length - a - b]]
        b = b[np.unique(np.linspace(0, len(b) - 1, min(TRIPLES, len(b))).astype(int))] if len(b) else b
        out.append(np.stack([np.full_like(b, a), b, length - a - b], 1))
    if have[length]:
        out.append(np.array([[length, 0, 0]]))
    return np.concatenate(out)


def fitted(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """x >= 0 with the least sum of squares of A x - histogram, by accelerated projected gradients; A counts lengths."""

    def ahead(x: np.ndarray) -> np.ndarray:
        out = np.bincount(rows.ravel(), np.repeat(x, 3), len(histogram))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[rows].sum(1)

    v = np.ones(len(rows))
    for _ in range(30):
        v = back(ahead(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, y - back(ahead(y) - histogram) / (1.01 * top))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / s * (new - x), s
    return x


def best_fit(left: np.ndarray, length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of sequences for what is left: longest first, each into the fullest sequence that takes it."""
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    spaces: list[int] = []

    def put(space: int, count: int, lengths: tuple[int, ...]) -> None:
        if not groups[space]:
            insort(spaces, space)
        groups[space].append((count, lengths))

    for size in range(length, 0, -1):
        count = int(left[size])
        while count:
            at = bisect_left(spaces, size)
            if at == len(spaces):
                each = length // size
                for n, k in ((count // each, each), (1, count % each)):
                    if n and k:
                        put(length - k * size, n, (size,) * k)
                break
            space = spaces[at]
            n, lengths = groups[space].pop()
            if not groups[space]:
                del spaces[at]
            used = min(n, count)
            if used < n:
                put(space, n - used, lengths)
            put(space - size, used, (*lengths, size))
            count -= used
    return [g for gs in groups.values() for g in gs]


def repeated(rows: np.ndarray, histogram: np.ndarray, length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of sequences: the fitted repeats of each pattern, rounded, as far as pieces last, and the rest."""
    left, out = histogram.copy(), []
    x = fitted(rows, left.astype(float)) if len(rows) else np.zeros(0)
    for i in np.argsort(-x, kind="stable"):
        want = int(np.rint(x[i]))
        if not want:
            break
        each = [int(s) for s in rows[i] if s]
        n = min(want, *(left[s] // each.count(s) for s in each))
        if n > 0:
            out.append((int(n), tuple(each)))
            for s in each:
                left[s] -= n
    return out + best_fit(left, length)


def plan(histogram: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Where the pieces of each length go, from the number of pieces of each.

    Fits patterns of up to three lengths, and of up to two, and takes what needs fewer sequences.
    Arrays (size, first, sequence, offset), sorted by size and first: the pieces of a size with ranks from first on go to
    sequences from sequence on, at offset; and the number of sequences. As long as the lengths allow, not the input's size.
    """
    histogram = histogram.astype(np.int64)
    sizes = np.flatnonzero(histogram)
    rows = patterns(sizes, length) if len(sizes) else np.zeros((0, 3), int)
    sequences = min((repeated(r, histogram, length) for r in (rows, rows[rows[:, 2] == 0])), key=lambda s: sum(n for n, _ in s))
    used, slots, at = defaultdict(int), [], 0
    for n, lengths in sequences:
        offset = 0
        for s in lengths:
            slots.append((s, used[s], at, offset))
            used[s] += n
            offset += s
        at += n
    s = np.array(sorted(slots), np.int64).reshape(-1, 4)
    return s[:, 0], s[:, 1], s[:, 2], s[:, 3], at


def _pieces(vocabulary: str, length: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rank = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        encode, end = encoder(vocabulary).encode, np.array([END], "<u4").tobytes()
        for b in batches:
            rows = []
            for row, text in enumerate(b.column(0)):
                ids = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    piece = ids[at : at + 4 * length]
                    size = len(piece) // 4
                    rows.append((row, k, at // 4, size, zlib.crc32(piece), rank[size]))
                    rank[size] += 1
            row, *rest = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 6
            arrays = [b.column(1).take(pa.array(row)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:]), pa.array(np.full(len(row), part, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "piece", "start", "length", "ids_crc32", "_rank", "_part"])

    return pieces


def _placed(table: tuple[np.ndarray, ...]):
    size, first, sequence, offset = table
    keys = (size << 44) + first

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(5).to_numpy()
            at = np.searchsorted(keys, (b.column(3).to_numpy() << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed


def pack(docs: DataFrame, text: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, sequence_id, offset) for each piece; doc holds the document's other columns.

    A document is its ids and the end id; only longer ones are cut, every length ids. Pieces are written once with their
    rank among those of their length and task. The driver sees one count a length, plans, and sends back places for
    ranges of ranks: its size depends on length alone. Null and empty texts are one end id; equal rows are packed each;
    an empty table gives none. docs may have columns of any names.
    """
    others = [c for c in docs.columns if c != text]
    doc = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(None).cast("int").alias("none"))
    d = docs.select(F.col(f"`{text}`").alias("_text"), doc.alias("doc"))
    kind = d.schema["doc"].dataType.simpleString()
    pieces = written(d.mapInArrow(_pieces(vocabulary, length), f"doc {kind}, piece int, start long, length long, ids_crc32 long, _rank long, _part int"), dealt=True)
    counts = pieces.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.withColumn("_before", before).drop("n")
    histogram = np.zeros(length + 1, np.int64)
    for size, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[size] = n
    *table, _ = plan(histogram, length)
    ranked = pieces.join(base, ["length", "_part"]).select("doc", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    return ranked.mapInArrow(_placed(tuple(table)), f"doc {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
