"""Document fingerprints: sketches of word shingles that keep every hash below a fixed share of the hash range."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.llm.common import words_of

WIDTH = 5
#: Hashes are HEX digits of MD5, compared as text. Those that are less than BELOW stay: an eighth of all.
HEX, BELOW = 12, "2"
#: And the least LEAST of a text whose eighth is fewer; a text of fewer shingles is kept whole.
LEAST = 64
#: More than any hash.
ALL = "g"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return words_of(F.translate(text, CAPITALS, SMALL))


def sketch(of: str) -> Column:
    """The sketch of a column of words: its hashes in ascending order, each once; none without words.

    The words must be a column of their own, as each shingle refers to them. Only texts of few shingles sort all.
    """
    w, n = F.col(of), F.size(of)
    each = F.transform(F.slice(w, F.lit(1), F.greatest(n - (WIDTH - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + k) for k in range(1, WIDTH))))
    shingles = F.when((n > 0) & (n < WIDTH), F.array(F.array_join(w, " "))).otherwise(each)
    hashes = F.transform(shingles, lambda s: F.substring(F.md5(s), 1, HEX))
    # Bound by transform(): each is computed once for a row, however often it is referred to.
    few = lambda h: F.slice(F.array_sort(F.array_distinct(h)), 1, LEAST)
    low = lambda h: F.array_distinct(F.filter(h, lambda x: x < BELOW))
    pair = F.transform(F.array(hashes), lambda h: F.struct(h.alias("h"), low(h).alias("low")))
    return F.transform(pair, lambda p: F.when(F.size(p["low"]) >= LEAST, F.array_sort(p["low"])).otherwise(few(p["h"])))[0]


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    both = F.array_sort(F.array_union(known(a, b)["a"], known(a, b)["b"]))
    low = F.filter(both, lambda x: x < BELOW)
    return F.when(F.size(low) >= LEAST, low).otherwise(F.slice(both, 1, LEAST))


def bound(s: Column) -> Column:
    """Up to where a sketch has every hash of its text."""
    return F.when(F.size(s) < LEAST, F.lit(ALL)).otherwise(F.greatest(F.element_at(s, -1), F.lit(BELOW)))


def known(a: Column, b: Column) -> Column:
    """A struct of the hashes of a and of b as far as both sketches have all of theirs."""
    return F.transform(F.array(F.least(bound(a), bound(b))), lambda t: F.struct(F.filter(a, lambda x: x <= t).alias("a"), F.filter(b, lambda x: x <= t).alias("b")))[0]


def _share(a: Column, b: Column, whole) -> Column:
    """The share of common hashes in a whole of the known ones; without any, 1 if both texts have none, else 0."""
    counts = F.transform(F.array(known(a, b)), lambda k: F.struct(F.size(F.array_intersect(k["a"], k["b"])).alias("n"), whole(k).alias("of")))
    none = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0)
    return F.transform(counts, lambda c: F.when(c["of"] > 0, c["n"] / c["of"]).otherwise(none))[0]


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two texts' shingles."""
    return _share(a, b, lambda k: F.size(F.array_union(k["a"], k["b"])))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has, whatever their sizes."""
    return _share(a, b, lambda k: F.size(k["a"]))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """_row (the document's own columns, whatever their names) and its _sketch. Null and blank texts have empty ones."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), words(F.col(f"`{text}`")).alias("_w"))
    return row.select("_row", sketch("_w").alias("_sketch"))


def last_of_ranges(keys: DataFrame, ranges: int) -> list[str]:
    """The last key (a struct k) of each range of the sorted keys, in order and as JSON: at most ranges of them."""
    parts = keys.repartitionByRange(ranges, "k").groupBy(F.spark_partition_id()).agg(F.max("k").alias("k"))
    return [r["j"] for r in parts.orderBy("k").select(F.to_json("k", {"ignoreNullFields": "false"}).alias("j")).collect()]


def with_previous(df: DataFrame, key: Column, columns: list[str], ranges: int | None = None) -> DataFrame:
    """df with the columns _before_c, for c in columns, of the row before in the order of key, a struct; before the first is the last.

    Rows are dealt by ranges of keys, and each range's last row to the next range, too: one shuffle, and no task has more
    than a range. Ranges are several to a shuffle partition, so the driver sees that many keys. Rows of equal
    keys stay in one range; which of them is before the other is open, so their columns should be equal, too.
    """
    spark = df.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", key.alias("_k"))
    kind = keyed.schema["_k"].dataType
    ends = last_of_ranges(keyed.select(F.col("_k").alias("k")), ranges)
    if not ends:
        return df.select("*", *(F.col(c).alias(f"_before_{c}") for c in columns))
    n, bounds = len(ends), F.from_json(F.lit(json.dumps([json.loads(e) for e in ends])), f"array<{kind.simpleString()}>")
    # The first range whose last key is not less than the row's, by halving.
    halved = F.aggregate(
        F.sequence(F.lit(1), F.lit(n.bit_length())),
        F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi")),
        lambda s, _: F.transform(F.array(F.floor((s["lo"] + s["hi"]) / 2).cast("int")), lambda mid: F.when(F.get(bounds, mid) < F.col("_k"), F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi"))))[0],
    )
    ranged = keyed.withColumn("_range", halved["lo"])
    own, on = F.struct(F.col("_range").alias("range"), F.lit(True).alias("own")), F.struct(((F.col("_range") + 1) % n).alias("range"), F.lit(False).alias("own"))
    dealt = ranged.select("*", F.explode(F.when(F.get(bounds, F.col("_range")) == F.col("_k"), F.array(own, on)).otherwise(F.array(own))).alias("_to"))
    order = Window.partitionBy("_to.range").orderBy("_to.own", "_k")
    return dealt.select(*df.columns, "_to", *(F.lag(c).over(order).alias(f"_before_{c}") for c in columns)).where("_to.own").drop("_to")


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_row, n_chars, edited (the text whose last half the next document's beginning has replaced), the sketches _sketch and
    _edited, and near_edited, near_next, contained_next: what the sketches say of edited text and next document.

    The next document is that of the next smaller key, the last one's the largest; null keys come after all others, and
    documents of one key in the order of a hash of their texts. Null texts are empty. Repeated rows come out each for
    itself, and follow one another; an empty table gives none. Texts are taken whole: sketches are linear in them.
    """
    empty = F.lit("")
    base, of = fingerprints(docs, text), lambda row: F.coalesce(F.col(row)[text], empty)
    # Ascending with nulls first is descending from behind: the row before is the next document.
    near = with_previous(base, F.struct(F.col("_row")[key].alias("id"), F.xxhash64(of("_row")).alias("h")), ["_row", "_sketch"])
    n = F.length(of("_row"))
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(of("_row"), n - half), F.left(of("_before__row"), half))
    out = near.select("_row", n.cast("long").alias("n_chars"), edited.alias("edited"), "_sketch", F.col("_before__sketch").alias("_next"))
    out = out.withColumn("_w", words(F.col("edited"))).select("_row", "n_chars", "edited", "_sketch", sketch("_w").alias("_edited"), "_next")
    s = F.col("_sketch")
    return out.select("_row", "n_chars", "edited", "_sketch", "_edited", likeness(s, F.col("_edited")).alias("near_edited"), likeness(s, F.col("_next")).alias("near_next"), containment(s, F.col("_next")).alias("contained_next"))


def joined(s: Column) -> Column:
    """A sketch as one string."""
    return F.array_join(s, ",")


def digest(docs: DataFrame) -> DataFrame:
    """compare_edits() of doc_id and text with texts as hashes and sketches as strings."""
    out = compare_edits(docs.select("doc_id", "text"))
    return out.select("_row.doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), joined(F.col("_sketch")).alias("fingerprint"), joined(F.col("_edited")).alias("edited_fingerprint"), "near_edited", "near_next", "contained_next")
