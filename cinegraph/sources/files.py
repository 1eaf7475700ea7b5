"""Files and folders as Spark's file systems have them, and tables kept in the folder that a cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def at(spark: SparkSession, path: str):
    """The file system of a path, as Spark sees it, and the path in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, in order; nothing if there is none."""
    fs, p = at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = at(spark, path)
    fs.delete(p, True)


def put(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Writes a small file; False if it is there already and must not be replaced. Of several who create it, one does."""
    fs, p = at(spark, path)
    try:
        out = fs.create(p, replace)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return True


def get(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, p = at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def new_folder(spark: SparkSession) -> str:
    """The name of a folder below the one that the cluster names in spark.checkpoint.dir."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{place.rstrip('/')}/graph-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder, and read again."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of tables that kept() made and that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/graph-" in folder:
            delete(df.sparkSession, folder)
