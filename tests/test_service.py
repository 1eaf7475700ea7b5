"""The service over a store against the same questions put to whole tables."""

import gzip

import pytest
from test_load import HEADERS, dump

from cinegraph.operators import graph, ratings, search
from cinegraph.service import Service
from cinegraph.sources.load import Store

NAMES = [f"n{i}\t{name}\t19{50 + i}\t\\N\tactor\t{','.join(['t1'] * (i + 1))}" for i, name in enumerate(["Source", "Ann", "Bob", "Cy", "Di", "Bob", "Eve"])]
TITLES = [f"t{i}\tmovie\t{name}\t{name} orig\t0\t2000\t\\N\t90\tDrama,War" for i, name in enumerate(["The First", "Second One", "Third", "Fourth", "Fifth"])]
PRINCIPALS = [(0, 1, 0, "actor"), (0, 2, 1, "actress"), (1, 1, 1, "actor"), (1, 2, 5, "director"), (2, 1, 5, "actor"), (2, 2, 3, "actor"), (4, 1, 4, "actor"), (4, 2, 6, "writer")]


def principals(rows):
    return [f"t{t}\t{o}\tn{n}\t{c}\t\\N\t\\N" for t, o, n, c in rows]


@pytest.fixture()
def service(spark, tmp_path):
    for name, rows in {"name.basics": NAMES, "title.basics": TITLES, "title.ratings": [f"t{i}\t{5 + i}.5\t30000" for i in range(5)], "title.crew": ["t1\tn5\t\\N"], "title.principals": principals(PRINCIPALS)}.items():
        dump(tmp_path, name, rows)
    store = Store(spark, f"{tmp_path}/store", 4)
    store.load_all(str(tmp_path))
    s = Service(store, ("n0", "Source"))
    assert s.refresh() and not s.refresh()
    return s


def test_searches(service):
    store = service.store
    titles, people, cast, scores = (store.read(t) for t in ("title_basics", "name_basics", "title_principals", "title_ratings"))
    for pattern in ("%first%", "third", "% one", "%o%", "none"):
        assert service.by_title(pattern).collect() == search.find_by_title(titles, pattern, pattern).collect()
        assert service.detail(pattern).collect() == search.movie_detail(titles, cast, people, pattern).collect()
    assert service.by_title("none", "fifth orig").first().movieId == "t4"
    assert service.by_id("t2").collect() == search.find_by_id(titles, "t2").collect() and service.by_id("zz").isEmpty()
    assert sorted(map(str, service.cast("t1").collect())) == sorted(map(str, search.cast_and_crew(cast.where("tconst = 't1'"), people).collect()))
    assert service.top_rated("dra ma", 2).collect() == ratings.top_rated(titles, scores, "drama", 2).collect()
    assert [service.id_of(n) for n in ("Bob", "Ann", "nobody")] == ["n5", "n1", None]


def numbers(service):
    return [service.number(n) for n in ("Source", "Ann", "Bob", "Cy", "Di", "Eve", "nobody")]


def searched(service, name):
    store = service.store
    titles = store.read("title_basics").selectExpr("tconst", "primaryTitle as label")
    return graph.separation_paths(service.spark, store.read("title_principals"), store.read("name_basics"), titles, name, "n0", "Source", 5)


def test_degrees_are_kept_up(service, tmp_path):
    """Of a load only what it added is looked at, and everybody's distance is right after it."""
    assert numbers(service) == [0, 1, 2, 3, -1, -1, -1]
    assert [service.paths(n) for n in ("Source", "Di", "nobody")] == [{"number": 0, "paths": []}] + [{"number": -1, "paths": None}] * 2
    for name in ("Ann", "Cy"):
        assert service.paths(name, 5) == searched(service, name)
    with gzip.open(tmp_path / "title.principals.tsv.gz", "wt") as f:
        f.write("\n".join([HEADERS["title.principals"], *principals([(3, 1, 3, "actor"), (3, 2, 4, "actor"), (0, 3, 5, "actor")])]) + "\n")
    assert service.store.load("title_principals", f"{tmp_path}/title.principals.tsv.gz")
    assert list(service.store.view("title_principals").since(service.store.view("title_principals", 5).version).select("nconst").distinct().orderBy("nconst").toPandas().nconst) == ["n3", "n4", "n5"]
    assert service.refresh()
    assert numbers(service) == [0, 1, 1, 2, 3, 4, -1]
    assert service.paths("Di", 5) == searched(service, "Di")
