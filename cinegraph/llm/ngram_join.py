"""N-gram Jaccard self-join by partition of the universe, with exact verification.

A document is the set of its 64-bit shingle hashes. Two sets of at most hi shingles whose similarity is 0.8 or more
differ in at most H = 2 hi / 9 places (floor). The hash range is cut into m equal segments. By the pigeonhole principle
 - with m > H segments some segment is the same in both: its subset's hash is a signature (allocation "exact");
 - with 2 m > H some segment is the same or differs by one shingle: subsets and subsets less one shingle are
   signatures (allocation "deletion").
Each size band takes the allocation and the m of least expected cost. Empty subsets are no signatures, so a set is safe
under "exact" if fewer than m - H of its segments are empty, under "deletion" if each has two shingles at least. A
link is lost only if both sets are unsafe; unsafe sets therefore also emit their prefix of n - ceil(0.8 n) + 1 smallest
hashes, of which linked sets share one.

A sketch holds the parity of a set in each of M cells of the hash range's low bits, M a power of two of about three a
shingle. Sets that differ in d places differ in at most d cells, so sketches refute pairs without a doubt, and nearly all
chance candidates, before a text is moved; what they let pass is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.llm.common import forget, written
from cinegraph.llm.components import components

WORDS = 5
#: Similarity as a fraction of whole numbers.
TOP, BOTTOM = 4, 5
#: A band's largest size is this times the band's before.
GROWTH = 1.5
#: Cost of a chance candidate against that of a signature.
CHANCE = 2.0
#: Cells of the largest sketch; longer sets have this one too, and are refuted less often.
CELLS = 1 << 15
#: Bytes of sketches in a block, and most nodes: two blocks of a hub's nodes are what a worker compares at once.
BLOCK, BLOCK_NODES = 1 << 23, 1 << 13
#: Parts that a hub's nodes are dealt to before they are in blocks.
SALTS = 16
#: Bits an id in the sieve of ids, and most bits of one: of more ids the sieve lets more others pass.
SIEVE, SIEVE_BITS = 16, 1 << 30
#: Words whose hashes a worker keeps.
KEPT = 250_000

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; bytes.lower() and split() know ASCII only, as wanted."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    ends = np.cumsum([len(w) for w in words]).tolist()
    w = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, ends[-1] if ends else 0)
    s = w[: max(0, len(w) - 4)] * FACTORS[0]
    for k in range(1, WORDS):
        s += w[k : len(s) + k] * FACTORS[k]
    s = mixed(s)
    start = 0
    for end in ends:
        n = end - start
        if n >= WORDS:
            x = np.sort(s[start : end - 4])
            new = np.empty(len(x), bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            yield x if new.all() else x[new]
        else:
            yield mixed(np.array([(w[start:end] * FACTORS[:n]).sum() + np.uint64(n)], np.uint64)) if n else w[:0]
        start = end


def shingles(text: str | None) -> np.ndarray:
    return next(shingle_sets([text]))


def key_of(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


@lru_cache(None)
def bands(largest: int) -> tuple[list[int], list[tuple[str, int, int]]]:
    """Largest sizes of the bands, and of each (allocation, m, H); those up to 4 hold equal sets only."""
    tops, plans = [4], [("none", 0, 0)]
    while tops[-1] < largest:
        hi = max(tops[-1] + 4, int(tops[-1] * GROWTH))
        lo, H = tops[-1] + 1, 2 * hi // 9
        n = math.sqrt(0.8 * lo * hi)
        m = H // 2 + 1
        best = (m + n + CHANCE * m * math.exp(-0.7 * n / m), "deletion", m)
        for slack in range(1, H + 9):
            m = H + slack
            empty = m * math.exp(-0.8 * lo / m)
            unsafe = min(1.0, math.exp(-((slack - empty) ** 2) / (2 * empty + 1e-9))) if slack > empty else 1.0
            best = min(best, (m + unsafe * n + CHANCE * m * math.exp(-0.7 * n / m), "exact", m))
        tops.append(hi)
        plans.append((best[1], best[2], H))
    return tops, plans


def schemes(s: np.ndarray) -> Iterator[tuple[int, str, int, int, np.ndarray, np.ndarray]]:
    """(band, allocation, m, H, segments that are not empty, where they start) for each scheme of a sorted set: that of
    its own band, and those of larger partners."""
    n, high = len(s), s >> np.uint64(32)
    tops, plans = bands(1 << (2 * n + 16).bit_length())
    for band in range(int(np.searchsorted(tops, n)), len(tops)):
        if band and TOP * (tops[band - 1] + 1) > BOTTOM * n:
            break
        kind, m, H = plans[band]
        if kind != "none":
            segment = (high * np.uint64(m)) >> np.uint64(32)
            new = np.empty(n, bool)
            new[0] = True
            np.not_equal(segment[1:], segment[:-1], out=new[1:])
            starts = np.flatnonzero(new)
            yield band, kind, m, H, segment[starts], starts


def signatures(s: np.ndarray) -> np.ndarray:
    """The signatures of a sorted set, with their band in the last five bits."""
    n = len(s)
    if not n:
        return s
    v, out = mixed(s ^ FACTORS[1]), []
    for band, kind, m, H, segment, starts in schemes(s):
        sums = np.add.reduceat(v, starts)
        salt = mixed(segment * FACTORS[2] + FACTORS[3:4] * np.uint64(band + 1))
        empty, here = m - len(starts), [mixed(sums ^ salt)]
        if kind == "exact":
            safe = empty < m - H
        else:
            counts = np.diff(np.append(starts, n))
            safe = empty == 0 and counts.min() >= 2
            lone = np.repeat(counts > 1, counts)
            here.append(mixed((np.repeat(sums, counts) - v)[lone] ^ np.repeat(salt, counts)[lone]))
        if not safe:
            here.append(mixed(s[: n - (TOP * n + BOTTOM - 1) // BOTTOM + 1] + FACTORS[4:] * np.uint64(band + 1)))
        out += [x & ~np.uint64(31) | np.uint64(band & 31) for x in here]
    return np.concatenate(out) if out else s[:0]


def sketch(s: np.ndarray) -> bytes:
    """The parities of a set's cells; the first half xor the second is the sketch of half as many cells."""
    cells = min(CELLS, max(64, 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches, one a row of 64-bit words, as those of width words."""
    while x.shape[1] > width:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def alike(a: bytes, b: bytes, n: int) -> bool:
    """Whether sketches of two sets of n elements in all differ in no more cells than linked sets do."""
    x, y = (np.frombuffer(k, np.uint64)[None] for k in (a, b))
    width = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum()) <= n // 9


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and BOTTOM * both >= TOP * (len(a) + len(b) - both)


SETS = "_id long, n long, key binary, node long, sketch binary"


def _pieces(texts: pa.Array, rows: int = 500) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), rows):
        yield from shingle_sets(texts.slice(at, rows).to_pylist())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for s in _pieces(b.column(1)):
            k = key_of(s)
            rows.append((len(s), k, node_of(k), sketch(s)))
        n, k, node, sketches = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k, pa.binary()), pa.array(node, pa.int64()), pa.array(sketches, pa.binary())], ["_id", "n", "key", "node", "sketch"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, node) of each different set of the partition, in pieces of bounded size."""
    seen: set[int] = set()
    sigs, nodes, size = [], [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), [len(x) for x in sigs]))], ["sig", "node"])

    for b in batches:
        for s in _pieces(b.column(0)):
            node = node_of(key_of(s))
            if node in seen or not len(s):
                continue
            seen.add(node)
            sigs.append(signatures(s))
            nodes.append(node)
            size += len(sigs[-1])
            if size > 200_000:
                yield piece()
                sigs, nodes, size = [], [], 0
    if size:
        yield piece()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        da, db, n = (batch.column(c).to_pylist() for c in ("s_a", "s_b", "n"))
        yield batch.filter(pa.array([alike(x, y, k) for x, y, k in zip(da, db, n, strict=True)], pa.bool_())).select(["a", "b"])


def _pairs(batch: pa.RecordBatch, rows: int = 200) -> Iterator[tuple]:
    """(a, set of a, b, set of b) of each row; sets of a, the hub, are kept from row to row. Few texts at a time are held."""
    kept: dict[int, np.ndarray] = {}
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        sets = shingle_sets(part.column("b_text").to_pylist())
        for a, node, b, t in zip(*(part.column(n).to_pylist() for n in ("a", "a_node", "b")), sets, strict=True):
            if node not in kept:
                if len(kept) >= 32:
                    kept.clear()
                kept[node] = shingles(part.column("a_text")[part.column("a_node").index(node).as_py()].as_py())
            yield a, kept[node], b, t


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, a_node, a_text, b, b_node, b_text to those (a, b) whose sets are similar."""
    for batch in batches:
        rows = [(a, b) for a, s, b, t in _pairs(batch) if similar(s, t)]
        a, b = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives that sizes and sketches do not refute, written."""
    of = {x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"}
    sized = pairs.join(of["a"], "a").join(of["b"], "b").where(f"{TOP} * greatest(n_a, n_b) <= {BOTTOM} * least(n_a, n_b)")
    return written(sized.select("a", "b", "s_a", "s_b", (F.col("n_a") + F.col("n_b")).alias("n")).mapInArrow(_alike, "a long, b long").distinct(), narrow=True)


def sieve(ids: DataFrame) -> tuple[DataFrame, int]:
    """(bitmaps, number of bits) that every id of ids (_id) has a bit in, and one other id in sixteen or fewer.

    Bits grow with the ids up to SIEVE_BITS, as the bitmaps are broadcast: 128 MB at most. Of more ids they let more
    others pass, a share of 1 - exp(-ids / bits) (a tenth at 113 million, six tenths at a billion), and never lose one.
    """
    n = ids.count()
    bits = min(SIEVE_BITS, 1 << max(15, (SIEVE * n - 1).bit_length() if n else 0))
    at = F.pmod(F.xxhash64("_id"), F.lit(bits))
    return ids.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")), bits


def _passes(key: Column, bits: int) -> Column:
    at = F.bitmap_bit_position(F.pmod(F.xxhash64(key), F.lit(bits)))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0


def _sieved(d: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of d whose _id is one of ids, and few others."""
    bitmaps, bits = sieve(ids)
    bucket = F.bitmap_bucket_number(F.pmod(F.xxhash64("_id"), F.lit(bits)))
    return d.join(F.broadcast(bitmaps), (bucket == F.col("_bucket")) & _passes(F.col("_id"), bits), "left_semi")


def _links(pairs: DataFrame, d: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives whose whole texts are linked, written."""
    spark = d.sparkSession
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), narrow=True)
    texts = _sieved(d, nodes).join(nodes, "_id", "left_semi").join(classes.select(F.col("rep").alias("_id"), "node"), "_id").dropDuplicates(["_id", "node"])
    texts = written(texts.select("_id", "node", "text"), narrow=True)
    t = {x: texts.select(F.col("_id").alias(x), F.col("node").alias(f"{x}_node"), F.col("text").alias(f"{x}_text")) for x in "ab"}
    out = written(pairs.join(t["b"], "b").join(t["a"], "a").select("a", "a_node", "a_text", "b", "b_node", "b_text").mapInArrow(_verified, "a long, b long").distinct(), narrow=True)
    forget(spark, texts)
    forget(spark, nodes)
    return out


def passing(x: dict[str, np.ndarray], y: dict[str, np.ndarray], share: float = 1.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in x, places in y) of the pairs that sizes and sketches do not refute, and whose components differ; with a
    smaller share, of those whose sketches differ in no more than this share of the cells that they may differ in."""
    for wx in np.unique(x["width"]):
        xs = np.flatnonzero(x["width"] == wx)
        for wy in np.unique(y["width"]):
            if max(wx, wy) > 2 * min(wx, wy):
                continue
            ys = np.flatnonzero(y["width"] == wy)
            xs, ys = xs[np.argsort(x["n"][xs], kind="stable")], ys[np.argsort(y["n"][ys], kind="stable")]
            width = min(wx, wy)
            sx, sy = (folded(np.stack([np.frombuffer(k["sketch"][i], np.uint64) for i in at]), width) for k, at in ((x, xs), (y, ys)))
            nx, ny = x["n"][xs], y["n"][ys]
            rows = max(1, (1 << 21) // (len(ys) * int(width)))
            for at in range(0, len(xs), rows):
                n = nx[at : at + rows, None]
                lo, hi = np.searchsorted(ny, -(-TOP * int(n[0, 0]) // BOTTOM)), np.searchsorted(ny, BOTTOM * int(n[-1, 0]) // TOP, "right")
                if lo == hi:
                    continue
                far = np.bitwise_count(sx[at : at + rows, None] ^ sy[None, lo:hi]).sum(2, dtype=np.int64)
                m = ny[None, lo:hi]
                good = (far <= ((n + m) // 9) * share) & (TOP * np.maximum(n, m) <= BOTTOM * np.minimum(n, m)) & (x["c"][xs[at : at + rows], None] != y["c"][ys[lo:hi]][None])
                i, j = np.nonzero(good)
                if len(i):
                    yield xs[at + i], ys[lo + j]


def forest(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs that pass, as many as join the components that they would join: surer ones first."""
    _, label = np.unique(np.concatenate((x["c"], y["c"])), return_inverse=True)
    lx, ly = label[: len(x["c"])], label[len(x["c"]) :]
    for share in (0.7, 1.0):
        for i, j in passing(x, y, share):
            apart = lx[i] != ly[j]
            i, j = i[apart], j[apart]
            cuts = np.flatnonzero(np.diff(i, prepend=-1)) if len(i) else ()
            for lo, hi in zip(cuts, [*cuts[1:], len(i)]):
                a, bs = i[lo], j[lo:hi]
                others, first = np.unique(ly[bs], return_index=True)
                new = others != lx[a]
                if new.any():
                    yield np.full(int(new.sum()), a), bs[first[new]]
                    for k in (lx, ly):
                        k[np.isin(k, others)] = lx[a]


def _compared(whole: bool):
    """Rows (a, kind, i, j, u, b, n, c, sketch), those of a, kind, i and j together, to pairs (a, b)."""

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n, c, b, u = (rows.column(k).to_numpy() for k in ("n", "c", "b", "u"))
        sketches = np.empty(len(b), object)
        sketches[:] = rows.column("sketch").to_pylist()
        width = np.array([len(k) // 8 for k in sketches])
        of = lambda at: {"n": n[at], "c": c[at], "b": b[at], "sketch": sketches[at], "width": width[at]}
        one, i, j = rows.column("kind")[0].as_py() == 0, rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        x, y = of(u == i if one else u >= 0), of(u == j if one else u < 0)
        if not len(x["b"]) or not len(y["b"]):
            return
        for p, q in (passing if whole else forest)(x, y):
            s, t = x["b"][p], y["b"][q]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, t)), pa.array(np.maximum(s, t))], ["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("a", "kind", "i", "j")], 1) if batch.num_rows else np.zeros((0, 4), np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else []
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(keys[lo])
                if held and key != last:
                    yield from pairs_of(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    return compared


def _between(star: DataFrame, known: DataFrame, whole: bool) -> DataFrame:
    """Pairs (a, b) of nodes of one hub and of different components that sizes and sketches do not refute, written.

    The nodes that are in the hub's own component are compared to the others, and the others to each other; both are
    dealt to blocks, so the sketches of a pair of blocks are all that a task holds, and nothing leaves it but pairs that
    pass: with whole all of them, else as many as join the components.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS))
    salted = lambda t: t.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    hubs = star.select("a").distinct().join(known.select(F.col("rep").alias("a"), F.col("c").alias("c_a")).distinct(), "a")
    m = star.join(known.select(F.col("rep").alias("b"), "n", "c", "sketch"), "b").withColumn("s", salt).join(salted(hubs), ["a", "s"]).withColumn("open", F.col("c") != F.col("c_a"))
    size = F.greatest(F.octet_length("sketch") + 64, F.lit(BLOCK // BLOCK_NODES))
    blocks = lambda rows: F.ceil(F.coalesce(F.sum(F.when(rows, size)), F.lit(0)) / BLOCK).cast("int")
    counts = m.groupBy("a").agg(blocks(F.col("open")).alias("us"), blocks(~F.col("open")).alias("vs"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("us > 0 and lo <> hi").select("a", "us", "vs")
    m = m.join(salted(counts), ["a", "s"]).withColumn("u", F.when(F.col("open"), F.pmod(F.xxhash64("b"), F.col("us"))).otherwise(-1 - F.pmod(F.xxhash64("b"), F.greatest("vs", F.lit(1)))).cast("int"))
    tasks = F.expr("""if(open, concat(transform(sequence(0, us - 1), k -> struct(0 as kind, least(u, k) as i, greatest(u, k) as j)),
      if(vs > 0, transform(sequence(0, vs - 1), k -> struct(1 as kind, u as i, k as j)), array())),
      transform(sequence(0, us - 1), k -> struct(1 as kind, k as i, -1 - u as j)))""")
    m = m.select("a", F.explode(tasks).alias("t"), "u", "b", "n", "c", "sketch").select("a", "t.kind", "t.i", "t.j", "u", "b", "n", "c", "sketch")
    key = ("a", "kind", "i", "j")
    return written(m.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compared(whole), "a long, b long").where("a <> b").distinct(), narrow=True)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, representative, component_id) for each row of docs; similarity 0.8 or more of 5-word shingles.

    representative: the smallest id among equal sets; component_id: the smallest id that links reach. Null, empty and
    blank texts have no shingles and are alone, as are rows with a null id, whose component is null. Rows with equal
    ids and equal texts are one document, shown as often as it is there; other columns are not read.

    1. Equal sets become one node (a shuffle of one short row a document).
    2. Signatures are shuffled once, each different set's once a partition. A signature's nodes pair with its hub, the
       one whose signatures most others have: as many pairs as rows, never all pairs of a group. Pairs are refuted
       by size and sketch or verified on whole texts; links give components.
    3. A link between x and y of different components that no hub showed: they share a signature, and both are nodes of
       its hub. _between compares the sketches of a hub's nodes, across components only, block by block. First only pairs
       that suffice to join the components that seem joined are verified; then whatever still passes, if anything does.
       What is compared grows with the square of the nodes of a hub that it is not linked to, some tens of nanoseconds a
       pair, and so does, a node for each block of its hub, what is shuffled; what is written and verified does not.

    A signature's rows are brought together by a window, which spills. A text has one row of a signature and dozens of
    signatures, so none holds more than a small share of the rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("text"))
    rows = written(d.mapInArrow(_sets, SETS))
    classes = written(rows.where("n > 0 and _id is not null").groupBy("key").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("node").alias("node"), F.first("sketch").alias("sketch")), narrow=True)

    within = Window.partitionBy("sig")
    sig = d.where("_id is not null").select("text").mapInArrow(_signatures, "sig long, node long")
    shared = written(sig.withColumns({"lo": F.min("node").over(within), "hi": F.max("node").over(within), "size": F.count("*").over(within)}).where("lo <> hi").select("sig", "node", "size"))
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight")).join(classes.select("node", "rep"), "node")
    hub = F.max(F.struct("weight", "rep")).over(within)["rep"]
    ranked = shared.join(weight, "node").select(F.col("rep").alias("b"), hub.alias("a"))
    star = written(ranked.where("a <> b").groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), narrow=True)
    forget(spark, shared)

    def joined(known: DataFrame, pairs: DataFrame) -> DataFrame:
        """known with the components that the links among pairs join, written."""
        links = _links(pairs, d, classes)
        c = {x: known.select(F.col("rep").alias(x), F.col("c").alias(f"c_{x}")).distinct() for x in "ab"}
        first = components(links.join(c["a"], "a").join(c["b"], "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))).select(F.col("node").alias("c"), F.col("component").alias("first"))
        out = written(known.join(first, "c", "left").select("rep", "n", F.coalesce("first", "c").alias("c"), "sketch"), narrow=True)
        forget(spark, links)
        return out

    tried = _possible(star, classes)
    known = joined(classes.select("rep", "n", F.col("rep").alias("c"), "sketch"), tried)
    forget(spark, tried)
    for whole in (False, True):
        more = _between(star, known, whole)
        if more.isEmpty():
            break
        before, known = known, joined(known, more)
        forget(spark, before)
    forget(spark, star)
    final = classes.select("key", "rep").join(known.select("rep", F.col("c").alias("component")).distinct(), "rep")
    return rows.join(final, "key", "left").select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("rep", "_id")).alias("representative"), F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id")).alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that link to one of a smaller id; rows with a null id stay.

    Only documents that the sieve of those that go lets pass are shuffled.
    """
    found = near_duplicates(docs, key, text)
    gone = written(found.where(F.col(key) > F.col("component_id")).select(F.col(key).alias("_id")).distinct(), narrow=True)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{key}`").cast("long").alias("_key"))
    bitmaps, bits = sieve(gone)
    bucket = F.bitmap_bucket_number(F.pmod(F.xxhash64("_key"), F.lit(bits)))
    row = row.join(F.broadcast(bitmaps), bucket == F.col("_bucket"), "left").withColumn("_may", F.coalesce(_passes(F.col("_key"), bits), F.lit(False)))
    stays = row.where("_may").join(gone, F.col("_key") == F.col("_id"), "left_anti").select("_row")
    return row.where("not _may").select("_row").union(stays).select("_row.*")
