"""Conversations repaired by the cheapest edits that make their roles alternate: optional system, then user and assistant.

A conversation is a path through a graph of (row, state): arcs keep, rerole or delete the row, or insert a turn before it.
Costs from the start and to the end tell which arcs lie on a cheapest path (the tight ones); along these, the least letter
is taken at each step. Rows come in blocks, so that a conversation of any length is spread over tasks: a block is first
reduced to the costs between its ends, then solved between the costs that its neighbours leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.llm.common import forget, written

#: What the edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. Kinds of rows: other, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: Faults, by number: none, truncated, and those that must be deleted.
NONE, CUT, DUPLICATE, BLANK = range(4)
#: What may follow a state: the state after each kind of row. An inserted or reroled turn is that of NEXT.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FAR = 1 << 40
#: A block has at most 2 to this many rows.
BITS = 16
BLANKS = " \t\n\x0b\x0c\r"


def arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """The edits of a row for each state before it, (edit, cost, state after), in order of their letters: D, K, then R.

    An edit is D, K, or U or A for a row reroled to user or assistant. code is 4 * fault + kind.
    """
    fault, kind = divmod(code, 4)
    out: list[list[tuple[str, int, int]]] = []
    for state in range(4):
        own = [("D", DELETE, state)]
        if fault <= CUT:
            extra = TRUNCATED * (fault == CUT)
            if kind in FOLLOWS[state]:
                own.append(("K", extra, kind))
            if kind != NEXT[state]:
                own.append(("UA"[NEXT[state] - USER], REROLE + extra, NEXT[state]))
        out.append(own)
    return out


ARCS = [arcs(code) for code in range(16)]


def inserted(costs: list[int]) -> list[int]:
    """Costs from the start to each state, with turns inserted; more than two in a row lead nowhere new."""
    for _ in range(2):
        costs = [min([costs[q]] + [costs[p] + INSERT for p in range(4) if NEXT[p] == q]) for q in range(4)]
    return costs


def forward(costs: list[int], code: int) -> list[int]:
    costs, out = inserted(costs), [FAR] * 4
    for q, own in enumerate(ARCS[code]):
        for _, cost, to in own:
            out[to] = min(out[to], costs[q] + cost)
    return out


def to_end(costs: list[int]) -> list[int]:
    """Costs from each state to the end, with turns inserted first."""
    for _ in range(2):
        costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in range(4)]
    return costs


def backward(costs: list[int], code: int) -> list[int]:
    return to_end([min(cost + costs[to] for _, cost, to in own) for own in ARCS[code]])


END = to_end([0 if q in ACCEPTED else FAR for q in range(4)])


def between(codes: bytes) -> list[int]:
    """The costs from each state before a block to each state after it, row by row."""
    out = []
    for start in range(4):
        costs = [0 if q == start else FAR for q in range(4)]
        for code in codes:
            costs = forward(costs, code)
        out += costs
    return out


def solved(codes: bytes, left: list[int], right: list[int], last: bool) -> list[tuple[int, int, list[str]]]:
    """(state before, state after, edits of each row) for each state in which a cheapest path can enter a block.

    left has the costs from the start to the block, right those from behind it to the end. Inserted turns are u or a
    before the row they precede; after the last row of all they follow it.
    """
    ahead = [right]
    for code in reversed(codes):
        ahead.append(backward(ahead[-1], code))
    ahead.reverse()
    behind = [inserted(left)]
    for code in codes:
        behind.append(inserted(forward(behind[-1], code)))
    total = min(a + b for a, b in zip(left, ahead[0], strict=True))
    out = []
    for enter in (q for q in range(4) if left[q] + ahead[0][q] == total):
        state, edits = enter, []
        for i, code in enumerate(codes):
            letters = ""
            while True:
                # The letters D, I, K, R in order; an edit leads to one state only, so the frontier is one state.
                steps = [(e, cost, to, i + 1) for e, cost, to in ARCS[code][state]]
                steps.insert(1, ("ua"[NEXT[state] - USER], INSERT, NEXT[state], i))
                e, state, at = next((e, to, at) for e, cost, to, at in steps if behind[i][state] + cost + ahead[at][to] == total)
                letters += e
                if at > i:
                    break
            edits.append(letters)
        while last and state not in ACCEPTED:
            edits[-1] += "ua"[NEXT[state] - USER]
            state = NEXT[state]
        out.append((enter, state, edits))
    return out


def _reduced(schema: pa.Schema):
    """Blocks (c, at, codes) with the costs between their ends and the adjacent kinds of rows that may not be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [bytes(x) for x in batch.column("codes").to_pylist()]
            ends = [[x[0] % 4, x[-1] % 4] for x in codes]
            bad = [sum(illegal(a % 4, b % 4) for a, b in zip(x, x[1:], strict=False)) for x in codes]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("at"), pa.array(codes, pa.binary()), pa.array(map(between, codes), pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(bad, pa.int64())], schema=schema)

    return run


def illegal(a: int, b: int) -> bool:
    """Whether a row of kind b may not follow one of kind a: only system, user; user, assistant; assistant, user may."""
    return (a, b) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _bordered(schema: pa.Schema):
    """For each conversation's blocks, in order: the costs before and behind each; the cost and illegal pairs of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, blocks in enumerate(batch.column("blocks").to_pylist()):
                lefts, right = [[0 if q == START else FAR for q in range(4)]], END
                for b in blocks[:-1]:
                    lefts.append([min(lefts[-1][p] + b["costs"][4 * p + q] for p in range(4)) for q in range(4)])
                own = []
                for b, left in zip(reversed(blocks), reversed(lefts), strict=True):
                    own.append({"at": b["at"], "left": left, "right": right, "last": b is blocks[-1]})
                    right = [min(b["costs"][4 * p + q] + right[q] for q in range(4)) for p in range(4)]
                    right = to_end(right)
                bad = sum(b["illegal"] for b in blocks) + sum(illegal(a["ends"][1], b["ends"][0]) for a, b in zip(blocks, blocks[1:], strict=False))
                rows += [x | {"cost": right[START], "illegal": bad} for x in own]
                which += [i] * len(own)
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in schema if f.name != "c"]
            yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(which, pa.int64())), *columns], schema=schema)

    return run


def _solved(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(n).to_pylist() for n in ("at", "codes", "left", "right", "last")}
            which, rows = [], []
            for i in range(batch.num_rows):
                for enter, leave, edits in solved(get["codes"][i], get["left"][i], get["right"][i], get["last"][i]):
                    which.append(i)
                    rows.append({"at": get["at"][i], "enter": enter, "leave": leave, "edits": edits})
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in schema if f.name != "c"]
            yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(which, pa.int64())), *columns], schema=schema)

    return run


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation's blocks, in order: in which state its path enters each."""
    for batch in batches:
        ats, enters = [], []
        for ways in batch.column("ways").to_pylist():
            at, state = None, START
            for w in ways:
                if w["at"] != at and w["enter"] == state:
                    at, state = w["at"], w["leave"]
                    ats.append(at)
                    enters.append(w["enter"])
        yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(enters, pa.int32())], ["at", "enter"])


def _hashed(schema: pa.Schema):
    """Sorted edits and texts (c, t, r, h; edits before the texts of a key) to (c, audit, hash) as each conversation ends.

    Only one conversation's letters and its hash are held: a hash takes its texts one after the other, whoever has them.
    """
    letters = str.maketrans("uaUA", "IIRR")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, lines, key, due = (), [], None, 0, None, ""
        for batch in batches:
            done = []
            cs, ts, rs, hs, es, texts = (batch.column(n).to_pylist() for n in ("c", "t", "r", "h", "e", "text"))
            for c, t, r, h, e, text in zip(cs, ts, rs, hs, es, texts, strict=True):
                if conv != (c,):
                    if conv:
                        done.append((conv[0], "".join(audit), sha.hexdigest()))
                    conv, audit, sha, lines, key, due = (c,), [], hashlib.sha256(), 0, None, ""
                if key != (t, r, h):
                    key, due = (t, r, h), ""
                if e is not None:
                    audit.append(e.translate(letters))
                    due += e.replace("D", "")
                    continue
                for x in due:
                    line = {"u": "user:", "a": "assistant:", "U": "user:" + text, "A": "assistant:" + text}.get(x, f"{r}:{text}")
                    sha.update((("\n" if lines else "") + line).encode())
                    lines += 1
                due = ""
            if done:
                yield _rows(done, schema)
        if conv:
            yield _rows([(conv[0], "".join(audit), sha.hexdigest())], schema)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _mapped(df: DataFrame, make, schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    return df.mapInArrow(make(to_arrow_schema(schema)), schema)


def _schema(c: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("c", c), *T.StructType.fromDDL(rest).fields])


def keyed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, t, r, h, text): the rows' own columns, null roles and texts as one space, and a hash of the text."""
    r, x = (F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(" ")) for n in (role, text))
    return rows.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("t"), r.alias("r"), x.alias("text")).select("c", "t", "r", F.unhex(F.sha2("text", 256)).alias("h"), "text")


def faults(rows: DataFrame) -> DataFrame:
    """(c, t, r, h, at, fault, kind) of keyed rows, written: at numbers them in order within each conversation, in one row after the other.

    Rows are ordered by turn, nulls first, then role and hash of the text. They are dealt by ranges of all this, so a long
    conversation has many tasks, and so have many equal rows, which a number of their own tells apart.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    first = F.substring("r", 1, 1)
    kind = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)
    fault = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), CUT).otherwise(NONE)
    light = rows.select("c", "t", "r", "h", fault.alias("fault"), kind.alias("kind"), F.xxhash64(F.monotonically_increasing_id()).alias("_n"))
    order = ["c", "t", "r", "h", "_n"]
    ranged = light.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_n")
    numbered = written(ranged.withColumn("at", F.monotonically_increasing_id()))
    again = numbered.groupBy("c", "r", "h").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    seen = numbered.join(again, "at", "left")
    out = written(seen.select("c", "t", "r", "h", "at", F.when((F.col("fault") != BLANK) & F.col("_first").isNull(), DUPLICATE).otherwise(F.col("fault")).alias("fault"), "kind"))
    forget(spark, numbered)
    return out


def edits(faulty: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of faults(): (at, e) of each row, and (c, cost, illegal) of each conversation.

    A block is of one conversation and at most 2 to the power of bits rows; a conversation's blocks, not its rows, meet in one task.
    """
    kind = faulty.schema["c"].dataType
    code = (4 * F.col("fault") + F.col("kind")).alias("code")
    blocks = faulty.groupBy("c", F.shiftright("at", bits).alias("b")).agg(F.array_sort(F.collect_list(F.struct("at", code))).alias("x"))
    blocks = blocks.select("c", F.col("x")[0]["at"].alias("at"), F.transform("x", lambda s: s["code"]).alias("codes"))
    reduced = written(_mapped(blocks, _reduced, _schema(kind, "at long, codes binary, costs array<long>, ends array<long>, illegal long")), narrow=True)
    whole = reduced.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("at", "costs", "ends", "illegal"))).alias("blocks"))
    borders = written(_mapped(whole, _bordered, _schema(kind, "at long, left array<long>, right array<long>, last boolean, cost long, illegal long")), narrow=True)
    ways = written(_mapped(reduced.select("c", "at", "codes").join(borders.drop("c"), "at"), _solved, _schema(kind, "at long, enter int, leave int, edits array<string>")), narrow=True)
    entered = ways.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("at", "enter", "leave"))).alias("ways")).mapInArrow(_entered, "at long, enter int")
    own = ways.join(entered, ["at", "enter"], "left_semi").select("at", F.posexplode("edits").alias("i", "e")).select((F.col("at") + F.col("i")).alias("at"), "e")
    return own, borders.where("last").select("c", "cost", "illegal")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = BITS) -> DataFrame:
    """A row for each conversation of rows: c, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Null conversations are one; null turns come first, null roles and texts are one space, and rows of one turn are in
    order of role and the text's hash. Equal rows are duplicates of the first. No row is dropped before it is judged, and an
    empty table gives none. A conversation's rows are spread over tasks but for its hash and audit, a value each: there one task
    takes its rows in turn, holding one batch and the audit.
    """
    kept = keyed(rows, conv, turn, role, text)
    kind = kept.schema["c"].dataType
    faulty = faults(kept)
    own, costs = edits(faulty, bits)
    count = lambda f: F.count_if(F.col("fault") == f)
    counts = faulty.groupBy("c").agg(F.coalesce(F.max("t") - F.min("t") + 1 - F.countDistinct("t"), F.lit(0)).cast("long").alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(CUT).alias("truncated"))
    edited = faulty.join(own, "at").select("c", "t", "r", "h", "at", "e", F.lit(None).cast("string").alias("text"))
    texts = kept.select("c", "t", "r", "h", F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("e"), "text")
    order = ["c", "t", "r", "h", F.col("at").asc_nulls_last()]
    streamed = edited.union(texts).repartition("c").sortWithinPartitions(*order)
    hashes = _mapped(streamed, _hashed, _schema(kind, "audit string, repaired_sha256 string"))
    out = counts
    for part in (costs, hashes):
        one = part.withColumnRenamed("c", "_c")
        out = out.join(one, F.col("c").eqNullSafe(F.col("_c"))).drop("_c")
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fault by the hash of conv_id and turn: a row dropped, emptied, without ends of sentences, twice, or of role user."""
    at = F.concat(*(x for n in ("conv_id", "turn") for x in (F.coalesce(F.col(n).cast("string"), F.lit(" ")), F.lit(":"))))
    key = F.crc32(F.left(at, F.length(at) - 1)) % 20
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("role", "text"))
    text = F.when(key == 1, "").when(key == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(key == 0, F.array().cast("array<int>")).when(key == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(key == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def digest(conversations: DataFrame) -> DataFrame:
    """repair() of damaged() conversations, with a row for those of which no row is left."""
    done = repair(damaged(conversations.select("conv_id", "turn", "role", "text")))
    ids = conversations.select("conv_id").distinct()
    out = ids.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in zero), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
