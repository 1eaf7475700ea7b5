"""Scores of whole documents by a gated recurrent language model with a class-factored output.

Counts of all training tokens are made on the cluster and give the base score, the classes, the output's first biases
and the chances of rare words. The recurrent part starts from a fit to windows of a small sample on the driver. Then every training
document is learned from once, whole, by truncated back-propagation in numpy on the executors: each partition trains its
own copy on its documents of a round, and the copies are averaged by tokens between the rounds. It scores every document
on the executors with its state carried from window to window.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import one_thread, written

#: Folds, and the one that is held out.
FOLDS, HELD = 5, 1
#: Most frequent tokens that every worker knows, and the bytes of the longest of them; others are joined to their counts.
HEAD, LONGEST = 1 << 17, 256
#: Of these, the tokens that the recurrent model tells apart, and the classes that they are dealt to: so many at least,
#: and this power of the training tokens and the root of the short list where that is more.
SHORT, CLASSES, GROWTH = 2000, 45, 0.42
#: Rounds that the training documents are dealt to, lanes, tokens held at once and rate of a worker that trains.
ROUNDS, TRAIN_LANES, TRAIN_WINDOW, TRAIN_TOKENS, TRAIN_RATE = 3, 512, 20, 400_000, 0.012
#: Parts that a model is cut into to be averaged.
PIECES = 64
#: Documents of the sample that the first fit on the driver takes, and tokens of the window that each gives.
SAMPLE_DOCS, SAMPLE_TOKENS = 600, 250
HIDDEN, WINDOW, LANES, EPOCHS, RATE = 24, 20, 32, 3, 0.01
#: Documents that a worker scores side by side, and steps between two looks at the output layer.
SCORE_LANES, SCORE_WINDOW = 512, 32
#: Documents and bytes of text that a worker holds the tokens of at once; a longer text is held by itself.
HELD_DOCS, HELD_BYTES = 12_000, 48 << 20
#: The end of a document, as a token: no word is empty.
END = b""


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS)) == HELD, F.lit(False))


def tokens_of(text: str | bytes | None) -> list[bytes]:
    """Of a text, or of its bytes in UTF-8."""
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()
    words.append(END)
    return words


class Places(dict):
    """Each token's place in a list, and for any other token the list's length."""

    def __init__(self, tokens: list[bytes]) -> None:
        super().__init__(zip(tokens, range(len(tokens))))
        self.none = len(tokens)

    def __missing__(self, token: bytes) -> int:
        return self.none

    def of(self, words: list[bytes], kind: type) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), kind, len(words))


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """The bounds of even stretches of a column, within HELD_DOCS and HELD_BYTES but for one text."""
    if not len(texts):
        return []
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    ends = np.cumsum(np.maximum(sizes, HELD_BYTES // HELD_DOCS))
    parts = -(-int(ends[-1]) // HELD_BYTES)
    cuts = np.searchsorted(ends, ends[-1] / parts * np.arange(1, parts))
    bounds = np.unique([0, *cuts, len(texts)]).tolist()
    return list(zip(bounds, bounds[1:]))


def token_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """tokens_of() of a whole column: where each text's tokens begin and the last one's end, and all tokens, as binary.

    A blank after a text's last word gives one more word, which is empty: the end. A blank text is one empty word as it is.
    """
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    text = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(text, "", " "))
    lists = pc.ascii_split_whitespace(text)
    return np.asarray(lists.offsets), lists.values.cast(pa.binary())


def places(tokens: pa.Array, known: pa.Array) -> np.ndarray:
    """Each token's place among the known ones, and for any other their number."""
    return np.asarray(pc.fill_null(pc.index_in(tokens, value_set=known), len(known)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in slices(b.column(0)):
            found = token_lists(b.column(0).slice(lo, hi - lo))[1].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["token", "n"])


#: Above this a logit counts as this, so that its power is finite; none comes near it.
TOP_LOGIT = 80


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(np.minimum(x, TOP_LOGIT, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def powers(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each element, in place, and the sum of each row."""
    np.exp(np.minimum(a, TOP_LOGIT, out=a), out=a)
    return a, np.maximum(a @ np.ones(a.shape[1], a.dtype), 1e-37)


class Adam:
    """Gradients are arrays, or (rows, their gradients): other rows stay, so a step costs what its tokens do."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p, self.t = p, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def update(self, grads: dict, size: int, rate: float) -> None:
        self.t += 1
        step = rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            g /= size / 4
            np.clip(g, -1, 1, out=g)
            m, v = self.m[k][rows], self.v[k][rows]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            if not isinstance(rows, slice):
                self.m[k][rows], self.v[k][rows] = m, v
            self.p[k][rows] -= step * m / (np.sqrt(v) + 1e-8)


@dataclass
class Model:
    """Tokens 0..k-1 are the short list by count; k is any other token, k + 1 the start of a document."""

    token_class: np.ndarray
    starts: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: np.ndarray, others: float, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 5) -> Model:
        """Classes are stretches of the short list; the last one is that of all other tokens."""
        k = len(counts)
        bounds = np.unique(np.linspace(0, k, min(classes, k) + 1).astype(int)) if k else np.zeros(1, int)
        token_class = np.append(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), len(bounds) - 1).astype(np.int64)
        rng = np.random.default_rng(seed)
        mass = np.maximum(np.append(counts, others), 0.5)
        by_class = np.bincount(token_class, mass)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        p = {"E": small(k + 2, 3 * hidden), "U": small(hidden, 2 * hidden), "Un": small(hidden, hidden), "C": small(hidden, len(by_class)), "W": small(k, hidden)}
        p["E"][:, :hidden] -= 1
        p["bC"] = np.log(by_class / by_class.sum()).astype(np.float32)
        p["bW"] = np.log(mass[:k] / by_class[token_class[:k]]).astype(np.float32)
        return cls(token_class, bounds, p)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        p, n = self.p, h.shape[1]
        e = p["E"][x]
        g = h @ p["U"]
        g += e[:, : 2 * n]
        g = sigmoid(g)
        z, r = g[:, :n], g[:, n:]
        rh = r * h
        c = rh @ p["Un"]
        c += e[:, 2 * n :]
        np.tanh(c, out=c)
        return h + z * (c - h), z, r, rh, c

    def output(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural log-probabilities of tokens y after states h; with grads, adds to them and returns d loss / d h too.

        Rows are put in order of class, so a class is a slice of them.
        """
        p = self.p
        cls = self.token_class[y]
        order = np.argsort(cls.astype(np.uint8 if len(p["bC"]) < 256 else np.int64), kind="stable")
        h, y, cls, rows = h[order], y[order], cls[order], np.arange(len(y))
        cuts = np.searchsorted(cls, np.arange(len(p["bC"]) + 1))
        a = h @ p["C"]
        a += p["bC"]
        out = a[rows, cls]
        a, total = powers(a)
        out -= np.log(total)
        if grads is not None:
            a /= total[:, None]
            a[rows, cls] -= 1
            grads["C"] += h.T @ a
            grads["bC"] += a.sum(0)
            dh = a @ p["C"].T
        for k in range(len(self.starts) - 1):
            at, lo, hi = slice(cuts[k], cuts[k + 1]), self.starts[k], self.starts[k + 1]
            if at.start == at.stop or hi - lo < 2:
                continue
            hk, own = h[at], (rows[: at.stop - at.start], y[at] - lo)
            b = hk @ p["W"][lo:hi].T
            b += p["bW"][lo:hi]
            out[at] += b[own]
            b, total = powers(b)
            out[at] -= np.log(total)
            if grads is not None:
                b /= total[:, None]
                b[own] -= 1
                grads["W"][lo:hi] += b.T @ hk
                grads["bW"][lo:hi] += b.sum(0)
                dh[at] += b @ p["W"][lo:hi]
        back = np.empty_like(out)
        back[order] = out
        if grads is None:
            return back
        dh_back = np.empty_like(dh)
        dh_back[order] = dh
        return back, dh_back

    def window(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, h: np.ndarray, grads: dict) -> np.ndarray:
        """Adds one window's gradients to grads and returns the state after it; a y below 0 is no token."""
        p, n, kept = self.p, h.shape[1], []
        for xi, f in zip(x, first, strict=True):
            h0 = h * ~f[:, None]
            h, z, r, rh, c = self.step(xi, h0)
            kept.append((h0, z, r, rh, c, h))
        states, flat = np.concatenate([k[5] for k in kept]), y.ravel()
        use = flat >= 0
        if use.all():
            dhs = self.output(states, flat, grads)[1]
        else:
            dhs = np.zeros_like(states)
            dhs[use] = self.output(states[use], flat[use], grads)[1]
        dhs, dh, de = dhs.reshape(len(kept), -1, n), np.zeros_like(h), np.empty((*x.shape, 3 * n), h.dtype)
        un, u = np.ascontiguousarray(p["Un"].T), np.ascontiguousarray(p["U"].T)
        for t in range(len(kept) - 1, -1, -1):
            h0, z, r, _, c, _ = kept[t]
            dh = dh + dhs[t]
            dz, dr, dc = de[t, :, :n], de[t, :, n : 2 * n], de[t, :, 2 * n :]
            dhz = dh * z
            dc[:] = dhz * (1 - c * c)
            dz[:] = dhz * (c - h0) * (1 - z)
            drh = dc @ un
            np.multiply(drh, r, out=dhz)
            dr[:] = dhz * h0 * (1 - r)
            dh = (dh * (1 - z) + dhz + de[t, :, : 2 * n] @ u) * ~first[t][:, None]
        flat, de = x.ravel(), de.reshape(-1, 3 * n)
        grads["U"] += np.concatenate([k[0] for k in kept]).T @ de[:, : 2 * n]
        grads["Un"] += np.concatenate([k[3] for k in kept]).T @ de[:, 2 * n :]
        order = np.argsort(flat, kind="stable")
        at = np.flatnonzero(np.diff(flat[order], prepend=-1))
        grads["E"] = flat[order][at], np.add.reduceat(de[order], at)
        return h

    def fit(self, docs: list[np.ndarray], lanes: int = LANES, window: int = WINDOW, epochs: int = EPOCHS, rate: float = RATE, seed: int = 6) -> None:
        """Truncated back-propagation with Adam: errors go back through one window, the state goes on to the next."""
        if not docs:
            return
        rng, adam = np.random.default_rng(seed), Adam(self.p)
        for epoch in range(epochs):
            self.learn([docs[i] for i in rng.permutation(len(docs))], adam, lanes, window, lambda done, epoch=epoch: rate * (1 - 0.8 * (epoch + done) / epochs))

    def learn(self, docs: list[np.ndarray], adam: Adam, lanes: int, window: int, rate) -> None:
        """One pass over docs, every token of them; they are cut into lanes of one length, the last one filled up with no tokens."""
        y = np.concatenate(docs)
        first = np.zeros(len(y), bool)
        first[np.cumsum([0] + [len(d) for d in docs[:-1]])] = True
        x = np.where(first, len(self.p["E"]) - 1, np.concatenate(([0], y[:-1])))
        width = -(-len(y) // lanes)
        rows = -(-len(y) // width)
        x, y, first = (np.concatenate((a, np.full(rows * width - len(a), fill, a.dtype))).reshape(rows, width).T for a, fill in ((x, 0), (y, -1), (first, False)))
        h = np.zeros((rows, self.p["Un"].shape[0]), np.float32)
        for at in range(0, width, window):
            part = slice(at, at + window)
            grads = {k: np.zeros_like(w) for k, w in self.p.items() if k != "E"}
            h = self.window(x[part], y[part], first[part], h, grads)
            adam.update(grads, max(1, int((y[part] >= 0).sum())), rate(at / width))

    def log10(self, docs: list[np.ndarray], lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
        """The whole log-probability of each document; lanes take one document after the other."""
        total = np.zeros(len(docs))
        if not docs:
            return total
        heap = [(0, i) for i in range(min(lanes, len(docs)))]
        own: list[list[int]] = [[] for _ in heap]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            length, lane = heapq.heappop(heap)
            own[lane].append(i)
            heapq.heappush(heap, (length + len(docs[i]), lane))
        own.sort(key=lambda ds: -sum(len(docs[i]) for i in ds))
        order = [i for ds in own for i in ds]
        sizes = np.array([len(docs[i]) for i in order])
        flat, which = np.concatenate([docs[i] for i in order]), np.repeat(np.array(order, np.int32), sizes)
        first = np.zeros(len(flat), bool)
        first[np.cumsum(sizes) - sizes] = True
        lengths = np.array([sum(len(docs[i]) for i in ds) for ds in own])
        lane_at = np.cumsum(lengths) - lengths
        h = np.zeros((len(own), self.p["Un"].shape[0]), np.float32)
        start, last = len(self.p["E"]) - 1, np.zeros(len(own), np.int32)
        for at in range(0, int(lengths[0]), window):
            active = int((lengths > at).sum())
            place = np.arange(at, at + window)[:, None]
            there = place < lengths[:active]
            place = np.where(there, place + lane_at[:active], 0)
            block, docs_at, begin = np.where(there, flat[place], 0), np.where(there, which[place], -1), first[place] & there
            states = np.empty((window, active, h.shape[1]), np.float32)
            h = h[:active]
            last = last[:active]
            for i in range(window):
                h = self.step(np.where(begin[i], start, last), h * ~begin[i][:, None])[0]
                states[i], last = h, block[i]
            use = docs_at >= 0
            total += np.bincount(docs_at[use], self.output(states[use], block[use]), len(docs))
        return total / math.log(10)


@dataclass
class Known:
    """What every worker gets: bounded by HEAD and HIDDEN, whatever the corpus."""

    tokens: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    model: Model

    def __post_init__(self) -> None:
        k = len(self.model.p["bW"])
        other = self.total - int(self.counts[:k].sum())
        self.short = k
        self.base = np.log10((self.counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        self.rare_bottom = other + 0.5 * (self.distinct - k + 1)
        self.rare = np.log10((self.counts + 0.5) / self.rare_bottom)
        self.rare[:k] = 0


def _scores(held):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_thread()
        known: Known = held.value
        head = pa.array(known.tokens, pa.binary())
        none = len(head)
        base, rare = np.append(known.base, 0.0), np.append(known.rare, 0.0)
        part, row = TaskContext.get().partitionId() << 40, 0
        for whole in batches:
            for lo, hi in slices(whole.column(0)):
                b = whole.slice(lo, hi - lo)
                ends, tokens = token_lists(b.column(0))
                ids = places(tokens, head)
                # Of the tokens beyond the head, each document's different ones and how often it has them.
                at = np.flatnonzero(ids == none)
                rest = tokens.take(pa.array(at)).dictionary_encode()
                del tokens
                own = (np.searchsorted(ends, at, "right") - 1) * max(1, len(rest.dictionary)) + np.asarray(rest.indices)
                own, times = np.unique(own, return_counts=True)
                doc, code = np.divmod(own, max(1, len(rest.dictionary)))
                tail = pa.StructArray.from_arrays([rest.dictionary.take(pa.array(code)), pa.array(times.astype(np.int64))], ["token", "n"])
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(b) + 1)).astype(np.int32)), tail)
                n = np.diff(ends).astype(np.int64)
                known_here = n - np.bincount(np.searchsorted(ends, at, "right") - 1, minlength=len(b))
                docs = [ids[x:y] for x, y in zip(ends[:-1], ends[1:])]
                base_sum, rare_sum = (np.array([float(logs[d].sum()) for d in docs]) for logs in (base, rare))
                score = known.model.log10([np.minimum(d, known.short) for d in docs]) + rare_sum
                arrays = [b.column(1), b.column(2), pa.array(part + row + np.arange(len(b))), pa.array(n), pa.array(known_here), pa.array(base_sum), pa.array(score), tail]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "held_out", "row", "n_tokens", "head", "base", "score", "tail"])
                row += len(b)

    return scores


def _windows(held):
    """A window of each text, whose place a hash names: long texts are taken as often as short ones."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Places(held.value)
        for b in batches:
            out = []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                words = tokens_of(text.as_py())
                at = h % max(1, len(words) - SAMPLE_TOKENS + 1)
                out.append(index.of(words[at : at + SAMPLE_TOKENS], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["h", "ids"])

    return windows


def _learned(held, rate: float):
    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_thread()
        tokens, kept = held.value
        short = pa.array(tokens, pa.binary())
        model = Model(kept.token_class, kept.starts, {k: x.copy() for k, x in kept.p.items()})
        adam, seen, docs, size = Adam(model.p), 0, [], 0
        for b in batches:
            for lo, hi in slices(b.column(0)):
                ends, words = token_lists(b.column(0).slice(lo, hi - lo))
                ids = places(words, short)
                for x, y in zip(ends[:-1], ends[1:]):
                    docs.append(ids[x:y].astype(np.int64))
                    size += int(y - x)
                    if size >= TRAIN_TOKENS:
                        model.learn(docs, adam, TRAIN_LANES, TRAIN_WINDOW, lambda _: rate)
                        seen, docs, size = seen + size, [], 0
        if docs:
            model.learn(docs, adam, min(TRAIN_LANES, max(4, size // (64 * TRAIN_WINDOW))), TRAIN_WINDOW, lambda _: rate)
            seen += size
        if seen:
            cut = np.array_split(np.concatenate([x.ravel() for x in model.p.values()]), PIECES)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([part] * PIECES, pa.int32()), pa.array([seen] * PIECES, pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())], ["piece", "part", "seen", "x"])

    return learned


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for b in batches:
        for piece, seen, x in zip(*(b.column(c).to_pylist() for c in ("piece", "seen", "x")), strict=True):
            acc = sums.setdefault(piece, [0, 0.0])
            acc[0] += seen
            acc[1] = acc[1] + seen * np.frombuffer(x, np.float32).astype(float)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([a[0] for a in sums.values()], pa.int64()), pa.array([(a[1] / a[0]).astype(np.float32).tobytes() for a in sums.values()], pa.binary())], ["piece", "seen", "x"])


def learn_all(docs: DataFrame, model: Model, tokens: list[bytes]) -> int:
    """Every row of docs (key, text, held_out) that trains goes through the model once, in one of the rounds; gives the tokens learned from."""
    sc, learned = docs.sparkSession.sparkContext, 0
    which = F.pmod(F.xxhash64("key", "text", F.lit(11)), F.lit(ROUNDS))
    for i in range(ROUNDS):
        held = sc.broadcast((tokens, model))
        now = docs.where(~F.col("held_out") & (which == i)).select("text")
        copies = now.mapInArrow(_learned(held, TRAIN_RATE * (1 - i / ROUNDS)), "piece int, part int, seen long, x binary")
        mean = copies.repartition("piece").sortWithinPartitions("piece", "part").mapInArrow(_averaged, "piece int, seen long, x binary")
        rows = sorted(mean.collect(), key=lambda r: r["piece"])
        held.unpersist()
        if rows:
            learned += rows[0]["seen"]
            flat, at = np.concatenate([np.frombuffer(r["x"], np.float32) for r in rows]), 0
            for k, x in model.p.items():
                model.p[k] = flat[at : at + x.size].reshape(x.shape).copy()
                at += x.size
    return learned


def train(docs: DataFrame, counts: DataFrame) -> Known:
    """docs (key, text, held_out) and the counts of all training tokens to what the workers need."""
    # Counts of counts, at most 2048, say from which count on a token is in the head, so no more than HEAD rows come back.
    bins = counts.groupBy(F.floor(F.log2("n") * 32).alias("bin")).agg(F.count("*").alias("tokens"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    total, distinct = (sum(r[c] for r in bins) for c in ("n", "tokens"))
    least, room = math.inf, HEAD
    for r in sorted(bins, key=lambda r: -r["bin"]):
        room -= r["tokens"]
        if room < 0:
            break
        least = r["least"]
    head = sorted(counts.where((F.col("n") >= least) & (F.octet_length("token") <= LONGEST)).collect(), key=lambda r: (-r["n"], bytes(r["token"]))) if least < math.inf else []
    tokens, n = [bytes(r["token"]) for r in head], np.array([r["n"] for r in head], np.int64)
    k = min(max(SHORT, int(total**GROWTH)), len(tokens))
    model = Model.of(n[:k].astype(float), float(total - n[:k].sum()), classes=max(CLASSES, math.isqrt(k)))
    # One end a training document: so many there are, or few where ends are not in the head, and a share of the hashes
    # leaves about twice the sample.
    ends = next((int(c) for t, c in zip(tokens, n) if t == END), 0)
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, ends))
    h = F.xxhash64("key", F.lit(7))
    few = docs.where(~F.col("held_out") & (F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40))))
    held = docs.sparkSession.sparkContext.broadcast(tokens[:k])
    sample = few.select(h.alias("h"), "text").mapInArrow(_windows(held), "h long, ids binary").orderBy("h", "ids").limit(SAMPLE_DOCS).collect()
    held.unpersist()
    texts = [np.frombuffer(r["ids"], "<i4").astype(np.int64) for r in sample]
    model.fit(texts)
    learn_all(docs, model, tokens[:k])
    return Known(tokens, n, int(total), int(distinct), model)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    held_out: the checksum of the key as text falls in the held fold; null keys train. base_score: smoothed unigram
    log10-probability, from counts of all training tokens. score: the recurrent model's, of the whole text. Tokens
    beyond the head are joined to their counts by token, once a document. Null and empty texts are one end; equal rows
    are scored each; with no training rows all tokens are as likely; an empty table gives none. Other columns are
    not read.
    """
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), is_held_out(F.col(f"`{key}`")).alias("held_out"))
    counts = written(d.where(~F.col("held_out")).select("text").mapInArrow(_counts, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")))
    known = train(d, counts)
    held = docs.sparkSession.sparkContext.broadcast(known)
    kind = d.schema["key"].dataType.simpleString()
    rows = written(d.select("text", "key", "held_out").mapInArrow(_scores(held), f"key {kind}, held_out boolean, row long, n_tokens long, head long, base double, score double, tail array<struct<token:binary,n:long>>"))
    tail = rows.select("row", F.inline("tail")).join(counts.withColumnRenamed("n", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    bottom = known.total + 0.5 * (known.distinct + 1)
    extra = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / bottom)).alias("base_more"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / known.rare_bottom)).alias("score_more"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("tail").join(extra, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("head") + zero("more")).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"), (F.col("base") + zero("base_more")).alias("base_score"), (F.col("score") + zero("score_more")).alias("score")
    )
