"""Explicit schemas of the base tables, and checks of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns and types of the base tables.
TABLES = {
    "name_basics": "nconst string, primaryName string, birthYear int, deathYear int, primaryProfession string, knownForTitles string",
    "title_basics": "tconst string, titleType string, primaryTitle string, originalTitle string, isAdult boolean, startYear int, endYear int, runtimeMinutes int, genres string",
    "title_ratings": "tconst string, averageRating double, numVotes int",
    "title_principals": "tconst string, ordering int, nconst string, category string, job string, characters string",
    "title_crew": "tconst string, directors string, writers string",
}
#: Primary keys, and (child columns, parent table, parent column).
KEYS = {"name_basics": ["nconst"], "title_basics": ["tconst"], "title_ratings": ["tconst"], "title_principals": ["tconst", "ordering", "nconst"], "title_crew": ["tconst"]}
PARENTS = {
    "title_ratings": [("tconst", "title_basics", "tconst")],
    "title_principals": [("tconst", "title_basics", "tconst"), ("nconst", "name_basics", "nconst")],
    "title_crew": [("tconst", "title_basics", "tconst")],
}
#: Rows that one task sorts or holds, about, whatever the size of the table.
ROWS = 500_000
LOAD_STATE = "dataset_key string, source_url string, local_file string, sha256 string, downloaded_at timestamp, imported_at timestamp"


def parts_of(rows: int) -> int:
    """Into how many parts a table of so many rows goes, for a task to have ROWS at most on average."""
    return 1 + rows // ROWS


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The key values that more than one row has, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def has_twins(df: DataFrame, keys: list[str]) -> bool:
    """Whether two rows share a key. Hashes alone are shuffled; only keys whose hash comes twice are compared themselves.

    df is read several times, so it should be a table.
    """
    marked = df.select(*keys, F.xxhash64(*keys).alias("_hash"))
    twice = duplicate_keys(marked.select("_hash").repartition(parts_of(df.count()), "_hash"), ["_hash"]).select("_hash")
    if twice.isEmpty():
        return False
    return not duplicate_keys(marked.join(twice.hint("shuffle_hash"), "_hash", "left_semi"), keys).isEmpty()


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is set but not in the parent; a null key refers to nothing and is no orphan."""
    p = parent.select(F.col(parent_key).alias("_parent"))
    return child.where(F.col(child_key).isNotNull()).join(p, F.col(child_key) == F.col("_parent"), "left_anti")
