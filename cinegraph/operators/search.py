"""Titles by name or id, their cast and crew, and both together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.functions.text import items, like_pattern, literals, trigrams
from cinegraph.sources.files import kept
from cinegraph.sources.layout import Copy, View

#: Fields of a movie record and the columns they come from.
MOVIE = {"movieId": "tconst", "titleType": "titleType", "primaryTitle": "primaryTitle", "originalTitle": "originalTitle", "ratedAdult": "isAdult", "yearReleased": "startYear", "yearEnded": "endYear", "runtimeInMinutes": "runtimeMinutes", "genres": "genres"}


#: A trigram that many titles have is in as many buckets.
SPREAD = 8
#: The titles of each trigram of their names, spread by a hash of the title.
POSTINGS = Copy(["gram", "_spread"], ["gram", "tconst"], ["tconst", f"cast(pmod(xxhash64(tconst), {SPREAD}) as int) as _spread"], each=("gram", f"array_distinct(concat({trigrams('primaryTitle')}, {trigrams('originalTitle')}))"))


def movie_fields(titles: DataFrame) -> list[Column]:
    return [F.col(column).alias(field) for field, column in MOVIE.items() if column in titles.columns]


def find_by_title(titles: DataFrame, primary: str, original: str, kind: str = "movie") -> DataFrame:
    """The movie whose primary or original title matches its pattern in any case; of several, the one of smallest id."""
    p, o = like_pattern(primary), like_pattern(original)
    hit = titles.where((F.col("primaryTitle").ilike(p) | F.col("originalTitle").ilike(o)) & (F.col("titleType") == kind))
    return hit.select(*movie_fields(titles)).orderBy("movieId").limit(1)


def grams_of(spark: SparkSession, pattern: str) -> list[str]:
    """What every text has that a pattern matches in any case: the trigrams of its plain runs, in small letters."""
    low = spark.sql("select lower(:p)", args={"p": pattern}).first()[0]
    return sorted({run[i : i + 3] for run in literals(low) for i in range(len(run) - 2)})


def candidates(titles: View, primary: str, original: str, most: int = 1000) -> DataFrame:
    """The titles of a laid-out table that may match a pattern of find_by_title(): all that have its trigrams, by the copy postings.

    Of the postings only the buckets of the trigrams are read. Up to most titles are looked up in their buckets, more are joined; a pattern
    without three plain characters in a row says nothing, and all titles may match.
    """
    spark = titles.layout.spark
    wanted = [grams_of(spark, x) for x in dict.fromkeys((like_pattern(primary), like_pattern(original)))]
    if not all(wanted):
        return titles.read()
    found = None
    for grams in wanted:
        rows = titles.lookup([(g, s) for g in grams for s in range(SPREAD)], "postings")
        one = rows.groupBy("tconst").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(grams)).select("tconst")
        found = one if found is None else found.union(one)
    return titles.among(kept(found), most=most)


def find_by_postings(titles: View, primary: str, original: str, kind: str = "movie", most: int = 1000) -> DataFrame:
    """find_by_title() over a laid-out table: only candidates() are read."""
    return find_by_title(candidates(titles, primary, original, most), primary, original, kind)


def find_by_id(titles: DataFrame, title_id) -> DataFrame:
    return titles.where(F.col("tconst") == F.lit(title_id)).select(*movie_fields(titles))


def cast_and_crew(principals: DataFrame, names: DataFrame, compat: bool = False) -> DataFrame:
    """(tconst, role, people) for the principals given: people in order of their listing, nulls left out.

    compat splits the joined names at commas, so a name with a comma becomes two; a group without any name has null.
    """
    p = principals.select("tconst", "ordering", "nconst", "category").join(names.select("nconst", "primaryName"), "nconst")
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("primaryName").isNotNull(), F.struct("ordering", "nconst", "primaryName")))), lambda x: x["primaryName"])
    out = p.groupBy("tconst", F.col("category").alias("role")).agg(listed.alias("people"))
    if compat:
        out = out.withColumn("people", F.when(F.size("people") > 0, items(F.array_join("people", ","), True)))
    return out


def movie_detail(titles: DataFrame, principals: DataFrame, names: DataFrame, title: str, kind: str = "movie") -> DataFrame:
    """One row: movie (null if no title matches) and castAndCrew, an array of (role, people) in order of role."""
    movie = find_by_title(titles, title, title, kind)
    one = movie.sparkSession.range(1).select(F.lit(1).alias("_one"))
    found = movie.select(F.lit(1).alias("_one"), F.col("movieId").alias("_id"), F.struct(*movie.columns).alias("movie"))
    asked = F.broadcast(movie.select(F.col("movieId").alias("tconst")))
    crew = cast_and_crew(principals.join(asked, "tconst", "left_semi"), names)
    grouped = crew.groupBy(F.col("tconst").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("role", "people"))).alias("castAndCrew"))
    empty = F.array().cast("array<struct<role:string,people:array<string>>>")
    return one.join(found, "_one", "left").join(grouped, "_id", "left").select("movie", F.coalesce("castAndCrew", empty).alias("castAndCrew"))


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON object; null fields stay."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
