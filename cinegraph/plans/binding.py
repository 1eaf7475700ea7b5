"""The driver's tables in the roles of titles, ratings, principals, names and crew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Data:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def titles(self) -> DataFrame:
        p = self.table("part")
        return p.select(F.col("p_partkey").alias("tconst"), F.col("p_type").alias("titleType"), F.col("p_name").alias("primaryTitle"), F.col("p_brand").alias("originalTitle"), F.col("p_size").alias("runtimeMinutes"), F.translate("p_name", " ", ",").alias("genres"))

    def ratings(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_partkey").alias("tconst")).agg(F.avg("l_quantity").alias("averageRating"), F.count("*").cast("int").alias("numVotes"))

    def principals(self, where: str = "l_returnflag = 'R'") -> DataFrame:
        return self.table("lineitem").where(where).select(F.col("l_orderkey").alias("tconst"), F.col("l_partkey").alias("nconst"), F.col("l_linenumber").alias("ordering"), F.col("l_returnflag").alias("category"))

    def names(self) -> DataFrame:
        """Parts as people, known for as many titles as they have line items."""
        known = self.table("lineitem").groupBy(F.col("l_partkey").alias("nconst")).agg(F.count("*").cast("int").alias("_n"))
        p = self.table("part").select(F.col("p_partkey").alias("nconst"), F.col("p_name").alias("primaryName"), F.col("p_size").alias("birthYear"))
        return p.join(known, "nconst", "left").withColumn("knownForTitles", F.array_join(F.array_repeat(F.lit("t"), F.coalesce("_n", F.lit(0))), ",")).drop("_n")

    def crew(self) -> DataFrame:
        """Suppliers as principals of orders."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("tconst"), F.col("l_suppkey").alias("nconst"), F.lit(1).alias("ordering"), F.col("l_returnflag").alias("category")).distinct()

    def crew_names(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("nconst"), F.col("s_name").alias("primaryName"))

    def labels(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("tconst"), F.concat("o_orderpriority", F.lit("#"), F.col("o_orderkey").cast("string")).alias("label"))
