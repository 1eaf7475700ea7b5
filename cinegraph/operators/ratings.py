"""Best-rated titles of a genre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.functions.text import genre_prefix
from cinegraph.operators.search import movie_fields

LIMIT, VOTES = 250, 25_000


def top_rated(titles: DataFrame, ratings: DataFrame, genre: str, limit: int = LIMIT, votes: int = VOTES, kind: str = "movie") -> DataFrame:
    """(movie struct, averageRating, numOfVotes): the limit best of the titles whose genre list begins with the genre.

    More than votes votes; ties by id; unrated titles are left out. A negative limit is an error.
    """
    t = titles.where((F.col("titleType") == kind) & F.col("genres").ilike(genre_prefix(genre))).select(F.struct(*movie_fields(titles)).alias("movie"), F.col("tconst"))
    r = ratings.where((F.col("numVotes") > votes) & F.col("averageRating").isNotNull()).select("tconst", "averageRating", F.col("numVotes").alias("numOfVotes"))
    return t.join(r, "tconst").orderBy(F.desc("averageRating"), "tconst").limit(limit).select("movie", "averageRating", "numOfVotes")
