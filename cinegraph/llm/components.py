"""Connected components of links that need not fit anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, component): the smallest node reachable; only nodes that have a link.

    Every round takes the least label among a node's neighbours and then that label's own label, so paths halve; each
    round's labels are written to the shared folder, and the driver sees one count. No link gives no rows.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("u", "v"), narrow=True)
    spark = links.sparkSession
    label = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("component"), F.lit(True).alias("moved")), narrow=True)
    while not label.where("moved").isEmpty():
        near = both.join(label.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        nxt = written(step.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("component"), (F.least("mid", F.coalesce("far", "mid")) < F.col("old")).alias("moved")), narrow=True)
        forget(spark, label)
        label = nxt
    forget(spark, both)
    return label.select("node", "component")
