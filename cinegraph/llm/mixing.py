"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the seeded hash that name a slice of a source: 4096 slices.
SLICE_DIGITS = 3


def water_fill(sources: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Targets are in proportion to the weights, which repeat over the sources in the order of their code points, null
    last; none is above max_epochs times its source's size, and the excess goes to the others by weight until none is.
    One row for each source, so the windows over all of them stay small. With r = cap / weight in rising order, the
    sources before the first k with (total - caps before k) / (weights from k) <= r are full; the rest share the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_fill = Window.orderBy("_r", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("_weight", weight).withColumn("_cap", max_epochs * F.col("source_size")).withColumn("_r", F.col("_cap") / F.col("_weight"))
    s = s.withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_level"))).over(everything)["_level"])
    return s.select("source", "source_size", F.coalesce(F.least("_cap", F.col("_level") * F.col("_weight")), F.col("_cap")).alias("target"))


def mix(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: Sequence[float] = (5.0, 2.0, 1.0), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """_row (the document's own columns), size, source_size, target and taken, for each row of docs.

    A source's documents are repeated floor(target / source_size) times; of the words that are still missing, each
    document in a seeded order gives all of its own until the last one gives a part, so the source's taken words are
    its target, rounded. Nobody gives more than max_epochs times its size. The order is that of a hash, then key and
    size; its first three digits cut a source into slices that are laid end to end, so no task holds a whole source.
    Null sources are one source; rows without words take 0, and so do sources without any; equal rows count each;
    a null key is as good as any; an empty table gives no rows. docs may have columns of any names.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("_key"), size.cast("long").alias("size"))
    row = row.withColumn("_h", F.md5(F.concat_ws(":", F.col("_key").cast("string"), F.lit(str(seed))))).withColumn("_slice", F.substring("_h", 1, SLICE_DIGITS))
    slices = row.groupBy("source", "_slice").agg(F.sum("size").alias("_slice_size"))
    plan = water_fill(slices.groupBy("source").agg(F.sum("_slice_size").alias("source_size")), weights, max_epochs)
    plan = plan.withColumn("_want", F.round("target").cast("long")).withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("_want div source_size")).otherwise(F.lit(0)))
    plan = plan.withColumn("_rest", F.col("_want") - F.col("_whole") * F.col("source_size")).drop("_want").withColumnRenamed("source", "_s")
    ahead = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_start", F.coalesce(F.sum("_slice_size").over(ahead), F.lit(0)))
    slices = slices.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select("_s", F.col("_slice").alias("_c"), "source_size", "target", "_whole", "_rest", "_start")
    row = row.join(slices, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_c")))
    within = Window.partitionBy("source", "_slice").orderBy("_h", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_start") - F.coalesce(F.sum("size").over(within), F.lit(0))
    row = row.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return row.select("_row", "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_part")).cast("long").alias("taken"))
