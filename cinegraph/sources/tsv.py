"""Gzipped tab-separated dumps: reading, cleaning and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.functions.text import first_ids, first_whole_ids, straight_quotes
from cinegraph.schemas import TABLES

NULL = "\\N"


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def read_tsv(spark: SparkSession, path: str, table: str, parts: int | None = None) -> DataFrame:
    """A dump with a header row, by line and tab: empty cells stay empty strings and only \\N is null.

    Every line that is the header goes. Flags are 0 or 1. A cell that does not fit its type is an error. A gzipped file is one task, so parts deals it out.
    """
    schema = schema_of(table)
    lines = spark.read.text(path)
    lines = lines.repartition(parts) if parts else lines
    header = "\t".join(f.name for f in schema)
    cells = lines.where(F.col("value") != header).select(F.split("value", "\t", -1).alias("c"))
    return cells.select(*(F.when(F.get("c", F.lit(i)) != NULL, F.get("c", F.lit(i))).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)))


def first_line(spark: SparkSession, path: str) -> str | None:
    """The header of a dump: one task reads one line of its first file."""
    row = spark.read.text(path).first()
    return row[0] if row else None


def last_line(spark: SparkSession, path: str) -> str | None:
    """The last line of a dump, of the last file by name that has one. Each file gives its last line; the driver gets one."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    row = lines.agg(F.max_by("value", F.struct("file", "start", "at")).alias("value")).first()
    return row[0]


def read_quoted(spark: SparkSession, path: str, table: str, malformed: str = "DROPMALFORMED") -> DataFrame:
    """A dump in quoted form by Spark's CSV reader; rows that do not fit are dropped. Flags are read as text first."""
    schema = schema_of(table)
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.dataType == T.BooleanType() else f.dataType) for f in schema])
    df = spark.read.csv(path, sep="\t", header=True, schema=raw, nullValue=NULL, quote='"', escape='"', mode=malformed)
    return df.select(*(F.col(f.name).cast(f.dataType) for f in schema))


def write_tsv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    flags = [F.col(f.name).cast("int").alias(f.name) if f.dataType == T.BooleanType() else F.col(f.name) for f in df.schema]
    df.select(*flags).write.csv(path, sep="\t", header=True, nullValue=NULL, emptyValue="", quote="\u0000", compression=compression)


def read_keys(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The keys of a file of one key a line, distinct, as a table of one column; blank lines are none."""
    return spark.read.text(path).select(F.trim("value").alias(column)).where(F.col(column) != "").distinct()


def retain(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose value in the keys' column is a key."""
    (column,) = keys.columns
    return df.join(keys, column, "left_semi").select(*df.columns)


def clean(tables: dict[str, DataFrame], with_tv_episodes: bool = False, minimal: bool = False, crew_ids: int = 5) -> dict[str, DataFrame]:
    """Quotes straightened, titles filtered (minimal: movies only), then only rows whose parents are there.

    Order matters: people go last, against the cleaned principals, so who is in title_crew only goes too.
    """
    t = {name: df.select(*(straight_quotes(F.col(f.name)).alias(f.name) if f.dataType == T.StringType() else F.col(f.name) for f in df.schema)) for name, df in tables.items()}
    titles = t["title_basics"]
    if minimal:
        titles = titles.where("titleType = 'movie'")
    elif not with_tv_episodes:
        titles = titles.where("titleType is null or titleType <> 'tvEpisode'")
    key = titles.select("tconst").distinct()
    people = t["name_basics"].select("nconst").distinct()
    principals = t["title_principals"].join(people, "nconst", "left_semi").join(key, "tconst", "left_semi").select(*t["title_principals"].columns)
    crew = t["title_crew"].join(key, "tconst", "left_semi").select("tconst", *(first_whole_ids(F.col(c), crew_ids).alias(c) for c in ("directors", "writers")))
    return {
        "title_basics": titles,
        "title_principals": principals,
        "title_ratings": t["title_ratings"].join(key, "tconst", "left_semi").select(*t["title_ratings"].columns),
        "title_crew": crew,
        "name_basics": t["name_basics"].join(principals.select("nconst").distinct(), "nconst", "left_semi").select(*t["name_basics"].columns),
    }


def cut_crew(crew: DataFrame, last_id: str, most: int = 5) -> DataFrame:
    """Crew lists cut by characters, as long as most ids like the last known one are."""
    return crew.select("tconst", *(first_ids(F.col(c), len(last_id), most).alias(c) for c in ("directors", "writers")))
