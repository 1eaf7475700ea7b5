import json

import pytest
from pyspark.sql import functions as F

from cinegraph.functions import text
from cinegraph.operators import ratings, search
from cinegraph.sources.layout import Layout, Table

COLUMNS = "tconst string, titleType string, primaryTitle string, originalTitle string, isAdult boolean, startYear int, endYear int, runtimeMinutes int, genres string"


@pytest.fixture(scope="module")
def titles(spark):
    names = ["100%", "100x", "a_b", "axb", "a\\b", "Ünder", None]
    rows = [(f"t{i}", "movie", n, n, False, 2000, None, 90, g) for i, (n, g) in enumerate(zip(names, ["Drama", "Drama,Romance", "Action,Drama", None, "", "drama,X", "Drama"], strict=True))]
    return spark.createDataFrame([*rows, ("s0", "short", "100%", "100%", None, None, None, None, "Drama")], COLUMNS)


@pytest.mark.parametrize(("pattern", "ids"), [("100\\%", ["t0"]), ("100%", ["t0"]), ("a\\_b", ["t2"]), ("A_B", ["t2"]), ("a\\\\b", ["t4"]), ("\\a\\xb", ["t3"]), ("üNDER", ["t5"]), ("nothing", [])])
def test_titles_match_patterns(titles, pattern, ids):
    assert [r.movieId for r in search.find_by_title(titles, pattern, pattern).collect()] == ids


@pytest.mark.parametrize(("most", "parts"), [(1000, 8), (1, 2)])
def test_postings_find_what_a_scan_finds(spark, titles, tmp_path, most, parts):
    """Names of all alphabets and lengths, patterns with and without trigrams; candidates looked up or joined."""
    more = [(f"m{i:03d}", "movie", n, o, False, 2000, None, 90, "Drama") for i, (n, o) in enumerate([("The Red House", "La maison rouge"), ("Red", None), ("re", "rE"), ("Žižkov İstanbul", "ΟΔΟΣ Α"), ("日本語の題", "x"), ("100% red_hot", "hot"), ("redred", "deredd")] * 3)]
    rows = titles.unionByName(spark.createDataFrame(more, COLUMNS))
    table = Table(Layout(spark, f"{tmp_path}/t", rows.schema, ["tconst"], ["tconst"], {"postings": search.POSTINGS}, parts))
    table.upsert(rows)
    for p in ("%red%", "RED", "the%house", "%maison%", "re", "%", "žižkov%", "%istanbul", "οδοσ%", "%本語の%", "100\\% red\\_hot", "%red_red%", "r_d", "nothing at all", "100x"):
        want = search.find_by_title(table.read(), p, p).collect()
        assert search.find_by_postings(table.view(), p, p, most=most).collect() == want, p
    assert search.find_by_postings(table.view(), "%house", "%rouge%").first().movieId == "m000"
    table.upsert(spark.createDataFrame([("m000", "movie", "Blue", "Bleu", False, 2000, None, 90, "Drama")], COLUMNS))
    assert search.find_by_postings(table.view(), "%house", "%rouge%").first().movieId == "m007" and search.find_by_postings(table.view(), "blue", "-").first().movieId == "m000"


def test_postings_read_candidates_only(spark, tmp_path):
    rows = spark.range(4000).selectExpr("format_string('t%05d', id) tconst", "'movie' titleType", "format_string('word%d %s', id, if(id % 2000 = 7, 'zebra', 'horse')) primaryTitle", "'' originalTitle")
    table = Table(Layout(spark, f"{tmp_path}/t", rows.schema, ["tconst"], ["tconst"], {"postings": search.POSTINGS}, 16))
    table.upsert(rows)
    found = search.find_by_postings(table.view(), "%zebra", "%zebra")
    assert found.first().movieId == "t00007" and len(found.inputFiles()) == 2


def test_plain_runs_of_a_pattern():
    assert [text.literals(p) for p in ("", "%", "abc", "a%b_c", "a\\%b\\\\%c")] == [[], [], ["abc"], ["a", "b", "c"], ["a%b\\", "c"]]


def test_a_pattern_must_not_end_in_an_escape():
    with pytest.raises(ValueError):
        text.like_pattern("abc\\")


def test_find_by_id(titles):
    assert [r.primaryTitle for r in search.find_by_id(titles, "s0").collect()] == ["100%"] and search.find_by_id(titles, "zz").isEmpty()


def test_top_rated(spark, titles):
    r = spark.createDataFrame([("t0", 8.0, 25001), ("t1", 8.0, 30000), ("t2", 9.9, 99999), ("t5", 9.0, 26000), ("t6", None, 50000), ("s0", 9.0, 99999), ("t3", 9.0, 25000)], "tconst string, averageRating double, numVotes int")
    got = [(x.movie.movieId, x.averageRating) for x in ratings.top_rated(titles, r, " dra ma ").collect()]
    assert got == [("t5", 9.0), ("t0", 8.0), ("t1", 8.0)]
    assert len(ratings.top_rated(titles, r, "drama", limit=1).collect()) == 1 and ratings.top_rated(titles, r, "drama", limit=0).isEmpty()
    with pytest.raises(Exception, match="NEGATIVE|negative"):
        ratings.top_rated(titles, r, "drama", limit=-1).collect()


@pytest.fixture(scope="module")
def cast(spark):
    p = spark.createDataFrame([("t0", 2, "n1", "actor"), ("t0", 1, "n2", "actor"), ("t0", 3, "n2", "actor"), ("t0", 4, "n3", "director"), ("t0", 5, "n4", None)], "tconst string, ordering int, nconst string, category string")
    n = spark.createDataFrame([("n1", "A,B"), ("n2", "Cy"), ("n3", None), ("n4", "Di")], "nconst string, primaryName string")
    return p, n


def test_cast_keeps_names_whole_unless_asked(cast):
    got = {r.role: r.people for r in search.cast_and_crew(*cast).collect()}
    assert got == {"actor": ["Cy", "A,B", "Cy"], "director": [], None: ["Di"]}
    split = {r.role: r.people for r in search.cast_and_crew(*cast, compat=True).collect()}
    assert split == {"actor": ["Cy", "A", "B", "Cy"], "director": None, None: ["Di"]}


def test_detail_with_and_without_a_match(titles, cast):
    row = search.movie_detail(titles, *cast, "100\\%").collect()
    assert len(row) == 1 and row[0].movie.movieId == "t0" and [c.role for c in row[0].castAndCrew] == [None, "actor", "director"]
    none = search.movie_detail(titles, *cast, "nothing").collect()
    assert len(none) == 1 and none[0].movie is None and none[0].castAndCrew == []
    alone = search.movie_detail(titles, *cast, "axb").collect()[0]
    assert alone.movie.movieId == "t3" and alone.castAndCrew == []


def test_json_keeps_nulls(titles, cast):
    got = json.loads(search.as_json(search.movie_detail(titles, *cast, "100\\%")).first().json)
    assert got["movie"]["yearEnded"] is None and got["movie"]["ratedAdult"] is False


def test_string_functions(spark):
    one = spark.createDataFrame([("a,b,,", 'x"y', " a\tb\n", "nm1234567,nm12345678,nm1")], "l string, q string, w string, ids string")
    r = one.select(text.items(F.col("l")).alias("all"), text.items(F.col("l"), True).alias("jvm"), text.comma_count(F.col("l")).alias("n"), text.straight_quotes(F.col("q")).alias("q"), text.no_space(F.col("w")).alias("w"), text.first_ids(F.col("ids"), 9, 2).alias("cut"), text.first_whole_ids(F.col("ids"), 2).alias("whole"), text.path_segment(F.lit("a%20b+c")).alias("seg")).first()
    assert (r.all, r.jvm, r.n, r.q, r.w) == (["a", "b", "", ""], ["a", "b"], 3, "x'y", "ab")
    assert (r.cut, r.whole, r.seg) == ("nm1234567,nm1234567", "nm1234567,nm12345678", "a b+c")
