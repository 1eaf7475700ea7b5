"""What several operators share: inputs, words, tables cut off from their lineage."""

from __future__ import annotations

import ctypes
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a Java pattern.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The array of the words of a text; none for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


@lru_cache(None)
def one_thread() -> None:
    """Has this worker's linear algebra use one thread: a worker is one of its executor's cores, and threads that wait
    for small products cost more than they save. Does nothing where numpy brings no OpenBLAS."""
    with open("/proc/self/maps") as maps:
        loaded = {line.split()[-1] for line in maps if "openblas" in line}
    for path in loaded:
        for name in ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_"):
            limit = getattr(ctypes.CDLL(path), name, None)
            if limit is not None:
                limit(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is set, one below the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def written(df: DataFrame, narrow: bool = False, dealt: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from the loss of executors.

    narrow is for tables of short rows after a shuffle: an eighth as many files as there are shuffle partitions. dealt
    is for short rows that long work comes before: that keeps its tasks, and the rows are dealt to as few files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    files = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    df = df.coalesce(files) if narrow else df.repartition(files) if dealt else df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that written() made and that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
