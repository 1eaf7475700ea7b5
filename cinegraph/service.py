"""The questions that users ask, answered from a store by look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.operators import graph, ratings, search
from cinegraph.sources.files import kept
from cinegraph.sources.layout import Layout, Table
from cinegraph.sources.load import Store

#: The person whose distances are asked for, and how their name is shown.
SOURCE = ("nm0000102", "Kevin Bacon")


class Service:
    """Searches, casts, best titles and degrees of separation from one known person, over one store.

    The distances are a table beside those of the store, laid out by person; refresh() brings them up to the store's version.
    """

    def __init__(self, store: Store, source: tuple[str, str] = SOURCE, max_depth: int = graph.MAX_DEPTH) -> None:
        self.store, self.spark, self.max_depth = store, store.spark, max_depth
        self.source_id, self.source_name = source
        layout = store.layouts["title_principals"]
        self.known = Table(Layout(self.spark, f"{store.root}/_known/{self.source_id}", T.StructType.fromDDL("node string, distance int"), ["node"], ["node"], buckets=layout.buckets))

    def by_title(self, primary: str, original: str | None = None, kind: str = "movie") -> DataFrame:
        """The movie whose primary or original title matches, as find_by_title() has it."""
        return search.find_by_postings(self.store.view("title_basics"), primary, primary if original is None else original, kind)

    def by_id(self, title_id: str) -> DataFrame:
        return search.find_by_id(self.store.lookup("title_basics", [title_id]), title_id)

    def cast(self, title_id: str, compat: bool = False) -> DataFrame:
        """(tconst, role, people) of a title."""
        principals = self.store.lookup("title_principals", [title_id])
        return search.cast_and_crew(principals, self.store.view("name_basics").among(principals.select("nconst")), compat)

    def detail(self, title: str, kind: str = "movie") -> DataFrame:
        """One row: the movie and its cast and crew, as movie_detail() has them."""
        found = search.candidates(self.store.view("title_basics"), title, title)
        row = search.find_by_title(found, title, title, kind).first()
        principals = self.store.lookup("title_principals", [row["movieId"]] if row else [])
        return search.movie_detail(found, principals, self.store.view("name_basics").among(principals.select("nconst")), title, kind)

    def top_rated(self, genre: str, limit: int = ratings.LIMIT, votes: int = ratings.VOTES) -> DataFrame:
        return ratings.top_rated(self.store.read("title_basics"), self.store.read("title_ratings"), genre, limit, votes)

    def id_of(self, name: str) -> str | None:
        """The person of a name who is known for most."""
        row = graph.resolve_name(self.store.lookup("name_basics", [name], "by_name"), name).first()
        return row["nconst"] if row else None

    def refresh(self) -> bool:
        """Brings the distances up to the store's version; False if they are. Only what was added since is looked at."""
        number, seen = self.store.log.latest()[0], self.known.log.latest()[1].get("batch", -1)
        if seen >= number:
            return False
        now = self.store.view("title_principals", number) if number else self.store.view("title_principals")
        if seen < 0 or seen not in self.store.log.numbers():
            changed = graph.source_distances(now.read(), self.source_id, self.max_depth)
        else:
            before = self.store.view("title_principals", seen)
            added = kept(now.since(before.version).select("tconst", "nconst"))
            changed = graph.refreshed_distances(self.known.read(), graph.looked_up(now), added, self.max_depth)
        return self.known.upsert(kept(changed), number)

    def number(self, name: str) -> int:
        """Degrees between the person of a name and the known one, by two look-ups; -1 if there are none."""
        person = self.id_of(name)
        row = self.known.lookup([(person,)]).first() if person is not None else None
        return -1 if row is None else row["distance"]

    def paths(self, name: str, max_paths: int | None = None) -> dict:
        """separation_paths() of a name, without a search: what lies on a path is told by its distance."""
        limit, person = graph.clamp_paths(max_paths), self.id_of(name)
        row = self.known.lookup([(person,)]).first() if person is not None else None
        if row is None:
            return {"number": -1, "paths": None}
        if row["distance"] == 0:
            return {"number": 0, "paths": []}
        principals, titles = self.store.view("title_principals"), self.store.view("title_basics")
        named = lambda members: titles.among(members.select("tconst")).select("tconst", F.col("primaryTitle").alias("label"))
        if row["distance"] == 1:
            members = kept(graph.membership(principals.lookup([(person,), (self.source_id,)], "by_person")))
            labels = graph.shared_titles(members, named(members), person, self.source_id, limit).collect()
            return {"number": 1, "paths": [[{"actorName": self.source_name, "movieTitle": r["label"]}] for r in labels]}
        paths = kept(graph.paths_by_distance(self.known.read(), person, graph.looked_up(principals), limit))
        people = paths.select(F.explode("path").alias("nconst")).distinct()
        members = kept(graph.membership(principals.among(people, "by_person")))
        labelled = graph.label_paths(paths, members, self.store.view("name_basics").among(people), named(members)).orderBy("path").collect()
        return {"number": row["distance"], "paths": [[s.asDict() for s in r["steps"]] for r in labelled]}
