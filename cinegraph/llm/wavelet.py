"""Token ids in wavelet matrices, one succinct compressed file for each shard.

A shard's file is one Parquet row with the matrix in its own binary form, so Spark's committers and any store that
Spark reads keep it whole. The matrix has a bit-plane for each bit of an id; each plane keeps the number of ones before
every block, and its blocks are deflated one by one, so a look-up opens one block a plane.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegraph.llm.common import shared_dir
from cinegraph.llm.tokens import VOCABULARY, encoder

MAGIC = b"CGWM0001"
#: Bits in a block of a plane.
BLOCK = 1 << 17
END = 1
#: Bytes of text that a shard is laid out for, and ids after which one is closed whatever the layout.
SHARD_BYTES, SHARD_IDS = 16 << 20, 1 << 24


class WaveletMatrix:
    """access(i), rank(c, i), count(c), select(c, k), occurrences(c) and ids() over a sequence of ids below 2^levels."""

    def __init__(self, n: int, levels: int, zeros: list[int], ones: list[np.ndarray], blocks: list[list[bytes]]) -> None:
        self.n, self.levels, self.zeros, self.ones, self.blocks = n, levels, zeros, ones, blocks
        self._open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def of(cls, ids: np.ndarray, levels: int | None = None) -> WaveletMatrix:
        n = len(ids)
        levels = levels or max(1, int(ids.max()).bit_length() if n else 1)
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, ones, blocks = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = now & now.dtype.type(1 << level) != 0
            packed = np.packbits(bit)
            blocks.append([zlib.compress(packed[i : i + BLOCK // 8].tobytes(), 1) for i in range(0, len(packed), BLOCK // 8)])
            per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
            ones.append(np.concatenate(([0], np.cumsum(per))))
            zeros.append(n - int(ones[-1][-1]))
            now = np.concatenate((np.compress(~bit, now), np.compress(bit, now)))
        return cls(n, levels, zeros, ones, blocks)

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<QI", self.n, self.levels)]
        for z, o, b in zip(self.zeros, self.ones, self.blocks, strict=True):
            out += [struct.pack("<QI", z, len(b)), o.astype("<i8").tobytes(), np.array([len(x) for x in b], "<u4").tobytes(), *b]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, levels = struct.unpack_from("<QI", data, 8)
        at, zeros, ones, blocks = 20, [], [], []
        for _ in range(levels):
            z, k = struct.unpack_from("<QI", data, at)
            at += 12
            ones.append(np.frombuffer(data, "<i8", k + 1, at))
            at += 8 * (k + 1)
            sizes = np.frombuffer(data, "<u4", k, at).tolist()
            at += 4 * k
            here = []
            for size in sizes:
                here.append(data[at : at + size])
                at += size
            zeros.append(z)
            blocks.append(here)
        return cls(n, levels, zeros, ones, blocks)

    def _bits(self, level: int, block: int) -> np.ndarray:
        if (level, block) not in self._open:
            if len(self._open) > 4 * self.levels:
                self._open.clear()
            self._open[level, block] = np.unpackbits(np.frombuffer(zlib.decompress(self.blocks[level][block]), np.uint8))
        return self._open[level, block]

    def _rank1(self, level: int, i: int) -> int:
        block, rest = divmod(i, BLOCK)
        return int(self.ones[level][block]) + (int(self._bits(level, block)[:rest].sum(dtype=np.int64)) if rest else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        c = 0
        for level in range(self.levels):
            bit = int(self._bits(level, i // BLOCK)[i % BLOCK])
            c = c << 1 | bit
            before = self._rank1(level, i)
            i = self.zeros[level] + before if bit else i - before
        return c

    def _range(self, c: int, i: int) -> tuple[int, int]:
        """Where the c's among the first i ids lie after the last plane."""
        lo, hi = 0, i
        if c >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if c >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, c: int, i: int) -> int:
        lo, hi = self._range(c, i)
        return hi - lo

    def count(self, c: int) -> int:
        return self.rank(c, self.n)

    def _find(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a plane."""
        before = self.ones[level] if bit else np.minimum(np.arange(len(self.ones[level])) * BLOCK, self.n) - self.ones[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        here = self._bits(level, block)[: min(BLOCK, self.n - block * BLOCK)]
        return block * BLOCK + int(np.flatnonzero(here == bit)[k - int(before[block])])

    def select(self, c: int, k: int) -> int:
        """The place of the k-th (from 0) c."""
        lo, hi = self._range(c, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = c >> (self.levels - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, c: int) -> list[int]:
        return [self.select(c, k) for k in range(self.count(c))]

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(np.frombuffer(b"".join(map(zlib.decompress, self.blocks[level])), np.uint8), count=self.n).view(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~bit)] = now[: self.zeros[level]]
            out[np.flatnonzero(bit)] = now[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            now = out
        return now


FILE = "part int, shard int, n_docs long, n_ids long, doc_ids binary, sizes binary, matrix binary"


def _shards(vocabulary: str):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encode, end = encoder(vocabulary).encode, np.array([END], "<u4").tobytes()
        ids, docs, held = [], [], 0

        def closed() -> pa.RecordBatch:
            sizes = np.array([len(x) // 4 for x in ids], "<i8")
            every = np.frombuffer(b"".join(ids), "<u4")
            matrix = WaveletMatrix.of(every).to_bytes()
            known = np.array([x is not None for x in docs], np.uint8).tobytes()
            keys = np.array([x or 0 for x in docs], "<i8").tobytes() + known
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(every)], pa.int64()), *(pa.array([x], pa.binary()) for x in (zlib.compress(keys, 1), zlib.compress(sizes.tobytes(), 1), matrix))],
                ["part", "shard", "n_docs", "n_ids", "doc_ids", "sizes", "matrix"],
            )

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                x = encode(text.as_py()) + end
                if held and held + len(x) // 4 > SHARD_IDS:
                    yield closed()
                    shard, held = shard + 1, 0
                    ids.clear()
                    docs.clear()
                ids.append(x)
                docs.append(doc.as_py())
                held += len(x) // 4
        if ids:
            yield closed()

    return shards


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, shard_bytes: int = SHARD_BYTES) -> None:
    """The ids of every text, each followed by the end id, in ascending order of the key (nulls first), as shard files.

    Null and empty texts have the end id only. Texts are dealt by ranges of the key, as many as their bytes ask for;
    a shard that a worker has too much of is closed and another begun. Rows of equal keys stay beside each other. An
    empty table writes no shard. Only the key and the text are read, whatever other columns there are.
    """
    d = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    total = d.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 8)).first()[0] or 0
    d = d.repartitionByRange(max(1, -(-total // shard_bytes)), F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first())
    d.mapInArrow(_shards(vocabulary), FILE).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, shard, n, keys, sizes, matrix in zip(*(b.column(c).to_pylist() for c in ("part", "shard", "n_docs", "doc_ids", "sizes", "matrix")), strict=True):
            raw = zlib.decompress(keys)
            docs = [int(x) if known else None for x, known in zip(np.frombuffer(raw, "<i8", n), raw[8 * n :], strict=True)]
            size = np.frombuffer(zlib.decompress(sizes), "<i8")
            ids = WaveletMatrix.from_bytes(matrix).ids().astype("<u4").tobytes()
            ends = np.cumsum(size)
            view = memoryview(ids)
            crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - size), pa.array(size), pa.array(crc, pa.int64())],
                ["part", "shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shard files alone."""
    files = spark.read.schema(FILE).parquet(path)
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("part", "shard", "n_ids").withColumn("before", before).drop("n_ids")
    docs = files.select("part", "shard", "n_docs", "doc_ids", "sizes", "matrix").mapInArrow(_read, "part int, shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes docs to a new folder in the shared place and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    write_shards(docs, path, **options)
    return read_shards(spark, path)
