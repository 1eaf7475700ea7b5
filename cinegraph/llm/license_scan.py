"""License scans: phrases, and diagonal voting of word k-grams against templates.

DataFrame and SQL functions only; nothing runs in Python on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegraph.llm.license_texts import TEMPLATES

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Words in a gram; the share of a template's words that a span must have, in order; the words of templates so short that
#: a span must have all of them; different grams that a span of any other must have; how far diagonals lie that merge.
K, COVER, SHORT, GRAMS, REACH = 3, 0.6, 16, 6, 4

#: Most grams of all templates that stand in the plan as literals and are broadcast.
LITERALS = 20_000

#: Everything but ASCII letters, digits and what lies outside ASCII separates words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), GAP), "")


def row_key(key: Column, text: Column) -> Column:
    """The same 16 bytes for rows of equal key and text only; null keys are equal to each other and to nothing else."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.md5(key.cast("string")), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))))


def places(words: str, phrases: Mapping[str, str]) -> Column:
    """Array of (at, label) of the places where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        first, *rest = phrase.split()
        same = " and ".join([f"get({words}, i + {j}) = '{w}'" for j, w in enumerate(rest, 1)] or ["true"])
        found.append(f"if(array_contains({words}, '{first}'), transform(filter(transform({words}, (w, i) -> if(w = '{first}' and {same}, i, null)), i -> i is not null), i -> named_struct('at', i, 'label', '{label}')), array())")
    return F.expr(f"concat({', '.join(found)})")


def template_grams(spark: SparkSession, templates: Mapping[str, str], k: int) -> DataFrame:
    """(gram, w, template, t_at, t_words) for each k-gram of each template; as many rows as the templates have words."""
    rows = []
    for label, text in templates.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(CAPITALS, SMALL)))
        rows += [(words[i : i + k], label, i, len(words)) for i in range(len(words) - k + 1)]
    grams = spark.createDataFrame(rows, "w array<string>, template string, t_at int, t_words int")
    return grams.select(F.xxhash64(*(F.col("w")[i] for i in range(k))).alias("gram"), "w", "template", "t_at", "t_words")


def votes(docs: DataFrame, templates: Mapping[str, str], k: int) -> DataFrame:
    """(_id, template, t_words, t_at, at, diagonal) for each place where a template's gram stands in a document: rolling
    hashes are joined, and of those that are equal the words are compared.

    Hashes of up to LITERALS grams stand in the plan as a set, so that only places that join leave their array; with more
    templates all places do. The grams are broadcast if they are that few, else left to a shuffle.
    """
    words = ", ".join(f"get(_w, i + {j})" for j in range(k))
    last = f"greatest(size(_w) - {k - 1}, 0)"
    known = template_grams(docs.sparkSession, templates, k)
    hashes = sorted({r.gram for r in known.select("gram").distinct().limit(LITERALS + 1).collect()})
    few = len(hashes) <= LITERALS
    place = f"named_struct('at', i, 'gram', xxhash64({words}), 'w', array({words}))"
    if few:
        # Without templates, or with none of k words, no place is looked for.
        place = f"if({f'xxhash64({words}) in ({", ".join(f"{h}L" for h in hashes)})' if hashes else 'i < 0'}, {place}, null)"
    grams = docs.select("_id", F.expr(f"explode(filter(transform(slice(_w, 1, {last}), (w, i) -> {place}), p -> p is not null))").alias("g"))
    same = (F.col("g.gram") == F.col("gram")) & (F.col("g.w") == F.col("w"))
    return grams.join(F.broadcast(known) if few else known, same).select("_id", "template", "t_words", "t_at", F.col("g.at").alias("at"), (F.col("g.at") - F.col("t_at")).alias("diagonal")).distinct()


def spans(found: DataFrame, k: int, cover: float, reach: int, short: int, grams: int) -> DataFrame:
    """(_id, template, start, end, share) of the verified spans: votes by diagonal, neighbours merged, alignment checked.

    Diagonals of one document and template that lie within reach of the one before are one alignment: a few words were put
    in or left out. An alignment whose diagonals spread over more than a template's length is looked at in overlapping
    stretches of that length. Along an alignment, votes count in the document's order as long as they also go forward in
    the template; share is that of the template's words that these cover. A span has cover of them and grams different
    grams at least, or, of a template of at most short words, all, and is no more than twice as long as the template. Of
    spans that start side by side, as those of like templates do, the ones that cover most words stay,
    and of these those of the largest share.
    """
    line = Window.partitionBy("_id", "template").orderBy("diagonal")
    cut = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= reach, 0).otherwise(1)
    d = found.groupBy("_id", "template", "t_words", "diagonal").agg(F.collect_list(F.struct("at", "t_at")).alias("v")).withColumn("cut", cut)
    d = d.withColumn("run", F.sum("cut").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("_id", "template", "run")
    half = F.greatest(F.lit(1), F.floor(F.col("t_words") / 2)).cast("int")
    d = d.withColumns({"first": F.min("diagonal").over(run), "wide": F.max("diagonal").over(run) - F.min("diagonal").over(run) > F.col("t_words")})
    at = ((F.col("diagonal") - F.col("first")) / half).cast("int")
    d = d.withColumn("part", F.explode(F.when(F.col("wide"), F.array(at - 1, at)).otherwise(F.array(F.lit(0)))))
    d = d.groupBy("_id", "template", "t_words", "run", "part").agg(F.array_sort(F.flatten(F.collect_list("v"))).alias("v"))
    step = f"""aggregate(v, named_struct('t', -{k}, 'words', 0, 'grams', 0, 'start', -1, 'end', -1),
      (a, x) -> if(x.t_at > a.t, named_struct('t', x.t_at, 'words', a.words + least({k}, x.t_at - a.t), 'grams', a.grams + 1,
        'start', if(a.start < 0, x.at, a.start), 'end', x.at + {k}), a))"""
    d = d.withColumn("a", F.expr(step)).withColumn("share", F.col("a.words") / F.col("t_words"))
    good = F.when(F.col("t_words") <= short, F.col("share") >= 1).otherwise((F.col("share") >= cover) & (F.col("a.grams") >= grams))
    d = d.where(good & (F.col("a.end") - F.col("a.start") <= 2 * F.col("t_words"))).select("_id", "template", F.col("a.start").alias("start"), F.col("a.end").alias("end"), "share", F.col("a.words").alias("words")).distinct()
    beside = Window.partitionBy("_id").orderBy("start").rangeBetween(-2 * reach, 2 * reach)
    return d.withColumn("most", F.max(F.struct("words", "share")).over(beside)).where("words = most.words and share = most.share").drop("words", "most")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, k: int = K, cover: float = COVER, reach: int = REACH, short: int = SHORT, grams: int = GRAMS) -> DataFrame:
    """doc_id, n_words, places (array of at, label), found (array of template, start, end, share) for each row of docs.

    places are those of the phrases; found are the verified template spans, in words from 0. Only votes are shuffled,
    and only documents with a vote come back, by key and text. Null and empty texts have no words and find nothing; rows
    that share a key, or have none, are scanned each; an empty table gives none. docs may
    have columns of any names; only the key and the text are read.
    """
    own, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    d = docs.select(own.alias("_key"), row_key(own, body).alias("_id"), words_of(body).alias("_w"))
    per = spans(votes(d, templates, k), k, cover, reach, short, grams).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("template", "start", "end", "share"))).alias("found"))
    base = d.select("_id", "_key", F.size("_w").cast("long").alias("n_words"), places("_w", phrases).alias("places"))
    return base.join(per, "_id", "left").select(F.col("_key").alias(key), "n_words", "places", F.coalesce("found", F.array().cast("array<struct<template:string,start:int,end:int,share:double>>")).alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    at = F.transform("places", lambda p: p["at"])
    base = F.transform("places", lambda p: p["label"])
    more = F.transform("found", lambda p: p["template"])
    score = F.greatest(F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("found", lambda p: p["share"])), F.lit(0.0)))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.least(F.lit(1.0), score).alias("score"),
    )
