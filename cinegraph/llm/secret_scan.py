"""Secret scans: patterns, and a battery of randomness tests with length-aware false-discovery control.

DataFrame and SQL functions only; nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, each with the group whose length counts and its least length. A least length that
#: stands in a pattern of one greedy class leaves the same matches as one that is asked for afterwards.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))

#: A pattern that every text with a span of the kind holds; it spares most texts the search for places.
HINT = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "random": r"[A-Za-z0-9+/_-]{16}"}

#: What the battery looks at: whole runs of letters, digits and the marks of base64, of 16 and more.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
LEAST = 16

#: The alphabets that an encoding is inferred from, narrowest first: name, pattern, symbols in order.
ENCODINGS = (
    ("hex", r"[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    ("base32", r"[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"[0-9a-z]+|[0-9A-Z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"[A-Za-z0-9+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)

#: Lower ends of the length bands within which false discoveries are controlled.
BANDS = (16, 24, 32, 48, 64)

#: What is written by hand or counted up, by the alphabet that it fits: a neighbour is of another class (lower, upper,
#: digit, mark) at most this often, two symbols are equal at least this often, and the lag-one serial correlation of the
#: symbols' places is at least this.
WRITTEN = {"hex": (0.05, 0.09, -0.1), "base32": (0.04, 0.06, -0.1), "base36": (0.06, 0.06, -0.1), "base64": (0.3, 0.06, -0.1)}

#: A p-value is counted by its whole tenths of a decimal digit, up to this many.
STEPS = 400

#: Items of an array that one aggregate() goes over; code points of a piece of text that places are looked up in.
BLOCK, PIECE = 256, 4096

SPAN = "array<struct<start:int,end:int,kind:string>>"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it, lambdas in it included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, first: Column, step, at: str, out: str) -> Column:
    """What step((at, out), item) puts out over all items, as one array, in about linear time.

    aggregate() copies what it has put out at each step, so it runs over blocks of BLOCK items: once for their at alone, to
    know where each block begins, and once more from there.
    """

    def over(items: Column) -> Column:
        n = F.size(items)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))
        begin = lambda blocks: F.aggregate(blocks, F.array(first[at]), lambda acc, b: F.concat(acc, F.array(F.aggregate(b, F.element_at(acc, -1), lambda a, x: step(F.struct(a.alias(at), first[out].alias(out)), x)[at]))))
        whole = lambda blocks: F.zip_with(blocks, F.slice(begin(blocks), F.lit(1), F.size(blocks)), lambda b, a: F.aggregate(b, F.struct(a.alias(at), first[out].alias(out)), step, lambda acc: acc[out]))
        return F.when(n > BLOCK, let(blocks, lambda blocks: F.flatten(whole(blocks)))).when(n > 0, F.aggregate(items, first, step, lambda acc: acc[out])).otherwise(first[out])

    return let(items, over)


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int, tokens: bool = False) -> Column:
    """Array of (start, end, kind), in code points, of the leftmost non-overlapping matches whose group is long enough;
    with tokens, also tok, the match.

    split() by the same pattern gives the gaps, so running sums of lengths give the places.
    """
    shape = SPAN.replace("kind:string", "kind:string,tok:string") if tokens else SPAN
    length = (lambda m: F.length(F.regexp_extract(m, pattern, group))) if group else F.length
    steps = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), length(m).alias("part"), *([m.alias("tok")] if tokens else [])))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start, end = acc["at"] + s["gap"], acc["at"] + s["gap"] + s["len"]
        more = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), *([s["tok"].alias("tok")] if tokens else []))))
        return F.struct(end.alias("at"), F.when(s["part"] >= least, more).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(HINT[kind]), running(steps, first, step, "at", "out")).otherwise(F.array().cast(shape))


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind as listed."""
    order = F.create_map(*(x for i, (kind, *_) in enumerate(BASE) for x in (F.lit(kind), F.lit(i))))
    found = F.concat(*(spans_of(text, *b) for b in BASE))
    return F.transform(F.array_sort(F.transform(found, lambda s: F.struct(s["start"], F.element_at(order, s["kind"]).alias("k"), s["end"], s["kind"]))), lambda s: F.struct(s["start"], s["end"], s["kind"]))


def _upper(z: str) -> str:
    """The normal distribution's upper tail (Lin's approximation), as SQL."""
    a = f"(0.5D * exp(-0.717D * abs({z}) - 0.416D * {z} * {z}))"
    return f"greatest(1e-45D, if({z} >= 0, {a}, 1D - {a}))"


def battery(found: str) -> Column:
    """The spans in the array column found with what the tests say of each one's string; a chain of SQL lambdas.

    For the places s_1..s_n of the string's symbols in the inferred alphabet of k symbols:
    chi-squared for uniform counts, standardised; Wald and Wolfowitz's runs above and below the middle, standardised;
    the lag-one serial correlation times sqrt(n). p_random: the smallest of their tails, times three: small where the
    string is no random one of its alphabet.
    p_text: a bound to the chance that what is written in the same alphabet (WRITTEN) looks so mixed, from the same three
    tests: Chernoff's bounds to as many runs of classes, to as few equal pairs, on which chi-squared rests, and to so low a
    serial correlation, joined as Fisher does. Short strings cannot get a small one.
    """
    fits = " ".join(f"when c.tok rlike '^({p})$' then '{name}'" for name, p, _ in ENCODINGS)
    letters = " ".join(f"when '{name}' then '{a}'" for name, _, a in ENCODINGS)
    written = [f"case c.encoding {' '.join(f"when '{name}' then {w[i]}D" for name, w in WRITTEN.items())} end" for i in range(3)]
    layers = [
        {"n": "length(c.tok)", "encoding": f"case {fits} end"},
        {"norm": "translate(if(c.encoding in ('hex', 'base36'), lower(c.tok), c.tok), '-_', '+/')", "a": f"case c.encoding {letters} end", "change": written[0], "equal": written[1], "least_serial": written[2]},
        {"s": "transform(filter(split(c.norm, ''), x -> x <> ''), x -> locate(x, c.a) - 1)", "k": "length(c.a)", "cls": "split(translate(c.tok, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-', concat(repeat('a', 26), repeat('A', 26), repeat('0', 10), repeat('+', 4))), '')"},
        {
            "cc": "aggregate(sequence(1, c.k), 0D, (acc, j) -> acc + pow(c.n - length(replace(c.norm, substr(c.a, j, 1), '')), 2))",
            "mean": "aggregate(c.s, 0D, (acc, x) -> acc + x) / c.n",
            "n1": "size(filter(c.s, x -> 2 * x >= c.k))",
            "runs": "1 + size(filter(c.s, (x, i) -> i > 0 and (2 * x >= c.k) <> (2 * get(c.s, i - 1) >= c.k)))",
            "turns": "size(filter(c.cls, (x, i) -> i > 0 and x <> get(c.cls, i - 1) and x <> ''))",
        },
        {
            "var": "aggregate(c.s, 0D, (acc, x) -> acc + (x - c.mean) * (x - c.mean))",
            "cov": "aggregate(transform(c.s, (x, i) -> if(i = 0, 0D, (x - c.mean) * (get(c.s, i - 1) - c.mean))), 0D, (acc, x) -> acc + x)",
            "mu": "2D * c.n1 * (c.n - c.n1) / c.n + 1",
            "chi": "(c.cc * c.k / c.n - c.n - (c.k - 1)) / sqrt(2D * (c.k - 1))",
            "rate": "c.turns / (c.n - 1D)",
            "pairs": "(c.cc - c.n) / 2",
            "want": "c.equal * c.n * (c.n - 1) / 2",
        },
        {
            "runs_z": "if(c.mu > 2, (c.runs - c.mu) / sqrt((c.mu - 1) * (c.mu - 2) / (c.n - 1)), 0D)",
            "serial_z": "if(c.var > 0, c.cov / c.var * sqrt(c.n), 0D)",
            "e_turns": "if(c.rate > c.change, (c.n - 1) * (c.rate * ln(c.rate / c.change) + if(c.rate < 1, (1 - c.rate) * ln((1 - c.rate) / (1 - c.change)), 0D)), 0D)",
            "e_pairs": "if(c.pairs < c.want, c.want - c.pairs + if(c.pairs > 0, c.pairs * ln(c.pairs / c.want), 0D), 0D)",
            "e_serial": "if(c.var > 0, c.n * pow(greatest(0D, c.least_serial - c.cov / c.var), 2) / 2, 0D)",
        },
        {"e": "c.e_turns + c.e_pairs + c.e_serial"},
        {
            "p_random": f"least(1D, 3 * least({_upper('c.chi')}, 2 * {_upper('abs(c.runs_z)')}, 2 * {_upper('abs(c.serial_z)')}))",
            "step": f"cast(least({STEPS - 1}, floor(10 * greatest(0D, (c.e - ln(1 + c.e + c.e * c.e / 2)) / ln(10)))) as int)",
            "band": "case " + " ".join(f"when c.n >= {b} then {b}" for b in sorted(BANDS, reverse=True)) + " end",
        },
    ]
    keep, out = ["start", "end", "tok"], found
    for layer in layers:
        out = f"transform({out}, c -> named_struct({', '.join(f"'{x}', c.{x}" for x in keep)}, {', '.join(f"'{x}', {e}" for x, e in layer.items())}))"
        keep += layer
    return F.expr(out)


def thresholds(tested: DataFrame, rate: float) -> dict[int, int]:
    """For each length band the least step at which Benjamini and Hochberg's rule holds the false-discovery rate.

    One aggregation to at most bands times steps counts, whatever the input's size.
    """
    counts = tested.select(F.explode("_tested").alias("t")).groupBy("t.band", "t.step").count().collect()
    out = {}
    for band in BANDS:
        by = {r["step"]: r["count"] for r in counts if r["band"] == band}
        total, above = sum(by.values()), 0
        for step in range(STEPS - 1, -1, -1):
            above += by.get(step, 0)
            if above and total * 10 ** (-step / 10) <= rate * above:
                out[band] = step
    return out


def scan(docs: DataFrame, text: str = "text", rate: float = 0.01, least_random: float = 0.001) -> DataFrame:
    """_row (the document's own columns), base and spans (arrays of start, end, kind) for each row of docs.

    base: the patterns' spans. spans: these and, of kind random, the candidate runs outside of them that the battery
    takes for secrets: their p_text holds the false-discovery rate among all candidates of like length in docs, and
    p_random is at least least_random. Places are code points, ends exclusive. Null and empty texts have no span;
    repeated rows are scanned each, and an empty table gives no rows. docs may have columns of any names.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    tested = row.withColumn("_found", spans_of(F.col("_text"), "random", CANDIDATE, 0, LEAST, tokens=True)).withColumn("_tested", battery("_found"))
    bound = thresholds(tested, rate)
    tested = tested.withColumn("base", base_spans(F.col("_text")))
    base = F.col("base")

    def secret(t: Column) -> Column:
        ok = F.lit(False)
        for band, step in bound.items():
            ok = ok | ((t["band"] == band) & (t["step"] >= step))
        return ok & (t["p_random"] >= least_random) & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))

    extra = F.transform(F.filter("_tested", secret), lambda t: F.struct(t["start"], t["end"], F.lit("random").alias("kind")))
    order = F.create_map(*(x for i, kind in enumerate((*(b[0] for b in BASE), "random")) for x in (F.lit(kind), F.lit(i))))
    every = F.array_sort(F.transform(F.concat("base", extra), lambda s: F.struct(s["start"], F.element_at(order, s["kind"]).alias("k"), s["end"], s["kind"])))
    return tested.select("_row", "base", F.transform(every, lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch that spans cover, overlapping ones as one, replaced by a mark.

    The text is cut into pieces of PIECE code points once, so that no place is looked up from the text's beginning.
    """
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    def kept(pieces: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
            at = (start % PIECE + 1).cast("int")
            rest = F.concat(F.substring(F.get(pieces, a), at, F.lit(PIECE)), F.array_join(F.slice(pieces, a + 2, F.greatest(F.lit(0), b - a - 1)), ""), F.coalesce(F.substring(F.get(pieces, b), F.lit(1), (end % PIECE).cast("int")), F.lit("")))
            return F.when(a == b, F.coalesce(F.substring(F.get(pieces, a), at, (end - start).cast("int")), F.lit(""))).otherwise(F.coalesce(rest, F.lit("")))

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.transform(running(spans, first, step, "at", "out"), lambda g: part(g["start"], g["end"])), F.array(part(last, F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), kept), mark))


def digest(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to the counts, digest and list of the spans of each."""
    found = scan(docs)
    counts = (F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind, *_ in BASE)
    return found.select("_row.doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", size: str | None = None) -> DataFrame:
    """docs with secrets replaced in the text column, and, if named, the column of the text's length set anew."""
    found = scan(docs, text).withColumn("_new", redacted(F.col(f"_row.`{text}`"), F.col("spans")))
    values = {text: F.col("_new")} | ({size: F.length("_new").cast(docs.schema[size].dataType)} if size else {})
    return found.select(*((values[c] if c in values else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
