"""Degrees of separation: people are neighbours if they are principals of one title, whatever their part in it.

Searches run level by level over a membership table (tconst, nconst). Levels are written to the shared folder, so
a plan never grows with the depth and a lost executor costs no more than its tasks. Frontiers stay DataFrames.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cinegraph.functions.text import comma_count
from cinegraph.sources.files import delete, forget, kept, new_folder
from cinegraph.sources.layout import Table, View

#: What stands for people and titles without a name.
UNKNOWN, UNKNOWN_TITLE = "Unknown", "Unknown Movie"
MAX_DEPTH = 6
#: Given a frontier (node), the pairs (parent, node) of its members and their neighbours, which must be mutual. An attribute
#: reach, if it has one, gives (node) without parents; an attribute extend carries paths on to given neighbours.
Neighbours = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SearchConfig:
    max_depth: int = MAX_DEPTH


def clamp_paths(wanted: int | None, default: int = 3, most: int = 10) -> int:
    return max(1, min(most, default if wanted is None else wanted))


def clamped(wanted: Column, default: int = 3, most: int = 10) -> Column:
    """clamp_paths() of a column."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(wanted, F.lit(default))))


def membership(principals: DataFrame) -> DataFrame:
    return principals.select("tconst", "nconst").where("tconst is not null and nconst is not null").distinct()


def bucketed(df: DataFrame, by: str) -> tuple[DataFrame, Callable[[], None]]:
    """df in the shared folder in as many buckets by a column as there are shuffle partitions, so that joins on it do not shuffle
    it, and what deletes it again."""
    spark, name, path = df.sparkSession, f"graph_{uuid.uuid4().hex}", new_folder(df.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, by).sortBy(by).format("parquet").option("path", path).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"drop table {name}")
        delete(spark, path)

    return spark.table(name), drop


def laid_out(principals: DataFrame) -> Neighbours:
    """Neighbours by a membership kept twice, in buckets by person and by title: what a search shuffles is its frontier.

    An attribute forget deletes both, once nothing is to be computed from them any more.
    """
    by_person, one = bucketed(principals.select("tconst", "nconst").where("tconst is not null and nconst is not null").repartition("nconst").distinct(), "nconst")
    by_title, two = bucketed(by_person.repartition("tconst"), "tconst")
    neighbours = neighbours_of(by_person, by_title)
    neighbours.forget = lambda: (one(), two())
    return neighbours


def top(paths: DataFrame, by: str, limit: int) -> DataFrame:
    """The limit smallest paths of each value of a column."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("path"))
    return paths.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def neighbours_of(members: DataFrame, by_title: DataFrame | None = None) -> Neighbours:
    """Neighbours by a membership; by_title: the same one, for joins on titles."""
    return _neighbours(lambda people: members, lambda titles: members if by_title is None else by_title)


def looked_up(principals: View) -> Neighbours:
    """Neighbours by a laid-out table with a copy by_person: of small frontiers only the buckets of their people and titles are read."""
    rows = lambda df: df.where("tconst is not null and nconst is not null").select("tconst", "nconst").distinct()
    return _neighbours(lambda people: rows(principals.among(people, "by_person")), lambda titles: rows(principals.among(titles)))


def _neighbours(of_people: Callable[[DataFrame], DataFrame], of_titles: Callable[[DataFrame], DataFrame]) -> Neighbours:
    """Neighbours by two equi-joins; titles are made distinct between them.

    of_people and of_titles give memberships that have all rows of some people or titles, and maybe others. Besides the pairs, which are as many
    as the squares of titles, reach gives nodes only, and extend carries paths from people to titles and on to people: both
    are as many rows as titles have people.
    """
    person = lambda nodes: nodes.select(F.col("node").alias("nconst"))

    def neighbours(frontier: DataFrame) -> DataFrame:
        on = of_people(person(frontier)).join(person(frontier), "nconst").select(F.col("nconst").alias("parent"), "tconst").distinct()
        near = on.join(of_titles(on.select("tconst")), "tconst").select("parent", F.col("nconst").alias("node"))
        return near.where("parent <> node").distinct()

    def titles(nodes: DataFrame) -> DataFrame:
        return of_people(person(nodes)).join(person(nodes), "nconst", "left_semi").select("tconst").distinct()

    def reach(frontier: DataFrame) -> DataFrame:
        on = titles(frontier)
        return of_titles(on).join(on, "tconst", "left_semi").select(F.col("nconst").alias("node")).distinct()

    def extend(paths: DataFrame, to: DataFrame, limit: int) -> DataFrame:
        by = top(of_people(person(paths)).join(paths.withColumnRenamed("node", "nconst"), "nconst").select("tconst", "path"), "tconst", limit)
        nodes = of_people(person(to)).join(person(to), "nconst", "left_semi")
        return nodes.join(by, "tconst").select(F.col("nconst").alias("node"), "path").distinct()

    def nearer(of: DataFrame, known: DataFrame, max_depth: int) -> DataFrame:
        """(node, distance) of people of some titles who get nearer by these than they are known to be."""
        here = kept(of_titles(of).join(of, "tconst", "left_semi").withColumnRenamed("nconst", "node").join(known, "node", "left"))
        best = here.groupBy("tconst").agg((F.min("distance") + 1).alias("by"))
        found = here.join(best, "tconst").where((F.col("by") <= max_depth) & (F.col("distance").isNull() | (F.col("by") < F.col("distance"))))
        return found.groupBy("node").agg(F.min("by").alias("distance"))

    neighbours.reach, neighbours.extend, neighbours.titles, neighbours.nearer = reach, extend, titles, nearer
    return neighbours


def reached(neighbours: Neighbours, frontier: DataFrame) -> DataFrame:
    """(node) of the neighbours of a frontier, and maybe of itself: no pairs, where the neighbours can do without."""
    reach = getattr(neighbours, "reach", None)
    return reach(frontier) if reach else neighbours(frontier).select("node").distinct()


def extended(neighbours: Neighbours, paths: DataFrame, to: DataFrame, limit: int) -> DataFrame:
    """(node, path): of paths (node, path), the limit smallest to each neighbour among to (node), and that at their end."""
    extend = getattr(neighbours, "extend", None)
    if extend:
        longer = extend(paths, to, limit)
    else:
        pairs = neighbours(paths.select("node").distinct()).join(to.select("node"), "node", "left_semi").select("node", F.col("parent").alias("_p"))
        longer = pairs.join(paths.withColumnRenamed("node", "_p"), "_p").select("node", "path").distinct()
    return top(longer.select("node", F.concat("path", F.array("node")).alias("path")), "node", limit)


def costars(members: DataFrame, people: DataFrame) -> DataFrame:
    """(nconst) of everybody who shares a title with any of people (nconst) and is none of them."""
    titles = members.join(people, "nconst", "left_semi").select("tconst").distinct()
    return members.join(titles, "tconst", "left_semi").select("nconst").distinct().join(people, "nconst", "left_anti")


def distances(source: DataFrame, neighbours: Neighbours, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(node, distance) of every node within max_depth of the source nodes (node)."""
    levels = [kept(source.select("node", F.lit(0).alias("distance")).distinct())]
    while len(levels) <= max_depth:
        seen = Observation()
        new = unseen(neighbours, levels).select("node", F.lit(len(levels)).alias("distance"))
        new = kept(new.observe(seen, F.count(F.lit(1)).alias("size")))
        if not seen.get["size"]:
            forget(new)
            break
        levels.append(new)
    return union(levels)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def unseen(neighbours: Neighbours, levels: list[DataFrame]) -> DataFrame:
    """The neighbours of the last level that no level has. As neighbours are mutual, only the last two can have them."""
    return reached(neighbours, levels[-1].select("node")).join(union(levels[-2:]).select("node"), "node", "left_anti")


@dataclass
class Side:
    """What a search has seen from one end: the nodes (node) of each level, and how many the last one has."""

    levels: list[DataFrame]
    size: int = 1

    @property
    def depth(self) -> int:
        return len(self.levels) - 1


def root(spark: SparkSession, node) -> DataFrame:
    return spark.createDataFrame([(node,)], "node string" if isinstance(node, str) else "node long")


def side(spark: SparkSession, node) -> Side:
    return Side([root(spark, node)])


def meet(a: Side, b: Side, neighbours: Neighbours, max_depth: int = MAX_DEPTH) -> int | None:
    """Edges between two ends, or None beyond max_depth. The sides grow until their last levels meet, and stay for later searches.

    Both grow by whole levels, the smaller first, so the first meeting is at the shortest distance, and of last levels: one end is
    farther from the other than that one's levels go, until it is met.
    """
    met = _met(a, b)
    while met is None and a.depth + b.depth < max_depth and a.size and b.size:
        one, other = (a, b) if a.size <= b.size else (b, a)
        # How many are new and whether they meet the other side is seen while they are written; a task that runs twice
        # may count twice, which only matters to which side grows next.
        seen = Observation()
        last = other.levels[-1].select("node", F.lit(1).alias("_other"))
        new = unseen(neighbours, one.levels).join(last, "node", "left")
        new = kept(new.observe(seen, F.count(F.lit(1)).alias("size"), F.count("_other").alias("met"))).select("node")
        one.levels.append(new)
        one.size = seen.get["size"]
        met = a.depth + b.depth if seen.get["met"] else None
    return met


def _met(a: Side, b: Side) -> int | None:
    """The distance of two sides of which one may have been grown before, as far as their levels tell."""
    if a.depth + b.depth == 0:
        return None
    x, y = (union([t.select("node", F.lit(d).alias(k)) for d, t in enumerate(s.levels)]) for s, k in ((a, "x"), (b, "y")))
    return x.join(y, "node").agg(F.min(F.col("x") + F.col("y"))).first()[0]


def search(spark: SparkSession, source, target, neighbours: Neighbours, max_depth: int = MAX_DEPTH) -> tuple[int, Side, Side, DataFrame] | None:
    """(distance, side of the source, side of the target, nodes where they meet), or None beyond max_depth."""
    a, b = side(spark, source), side(spark, target)
    if source == target:
        return 0, a, b, a.levels[0]
    total = meet(a, b, neighbours, max_depth)
    return None if total is None else (total, a, b, a.levels[-1].join(b.levels[-1], "node", "left_semi"))


def distance(spark: SparkSession, source, target, neighbours: Neighbours, max_depth: int = MAX_DEPTH) -> int:
    """Edges between two nodes; -1 if none of up to max_depth lead there or a node is unknown (None)."""
    return distances_to(spark, source, [target], neighbours, max_depth)[0]


def distances_to(spark: SparkSession, source, targets: list, neighbours: Neighbours, max_depth: int = MAX_DEPTH) -> list[int]:
    """distance() of each target. What was seen from the source stays for the next target, so it is grown once for all."""
    out, a = [], None if source is None else side(spark, source)
    for target in targets:
        if source is None or target is None:
            out.append(-1)
            continue
        if source == target:
            out.append(0)
            continue
        b = side(spark, target)
        found = meet(a, b, neighbours, max_depth)
        out.append(-1 if found is None or found > max_depth else found)
        for level in b.levels[1:]:
            forget(level)
    for level in a.levels[1:] if a else []:
        forget(level)
    return out


def shortest_paths(spark: SparkSession, source, target, neighbours: Neighbours, max_depth: int = MAX_DEPTH, limit: int = 10) -> DataFrame:
    """(path): the limit lexicographically smallest shortest paths, as arrays of nodes from source to target."""
    found = search(spark, source, target, neighbours, max_depth)
    kind = "string" if isinstance(source, str) else "bigint"
    return spark.createDataFrame([], f"path array<{kind}>") if found is None else found_paths(*found, neighbours, limit)


def found_paths(total: int, a: Side, b: Side, meeting: DataFrame, neighbours: Neighbours, limit: int) -> DataFrame:
    """shortest_paths() of what search() has found.

    From where the sides meet, each level is cut to what leads there; then paths are grown from the source along what is
    left, the limit smallest of each node. Paths to one node have one length and go on alike, so smaller beginnings suffice.
    """
    if total == 0:
        return a.levels[0].select(F.array("node").alias("path"))
    left = {}
    for one, s in (("a", a), ("b", b)):
        alive = left[one, s.depth] = kept(meeting)
        for depth in range(s.depth - 1, 0, -1):
            alive = left[one, depth] = kept(s.levels[depth].join(reached(neighbours, alive), "node", "left_semi"))
    steps = [left["a", d] for d in range(1, a.depth + 1)] + [left["b", d] for d in range(b.depth - 1, 0, -1)] + [b.levels[0]] * (b.depth > 0)
    paths = a.levels[0].select("node", F.array("node").alias("path"))
    for to in steps:
        paths = extended(neighbours, paths, to, limit)
    return paths.select("path").orderBy("path").limit(limit)


def label_paths(paths: DataFrame, members: DataFrame, names: DataFrame, titles: DataFrame) -> DataFrame:
    """(path, steps) with steps an array of (actorName, movieTitle): each person but the last, and one shared title.

    Of several shared titles the smallest label is shown; unknown people and titles have a default.
    """
    pair = paths.select("path", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("pos", "x")).withColumn("y", F.element_at("path", F.col("pos") + 2))
    edge = pair.select("x", "y").distinct()
    x, y = (members.select("tconst", F.col("nconst").alias(k)) for k in "xy")
    shared = edge.join(x, "x").join(y, ["y", "tconst"]).join(titles.select("tconst", "label"), "tconst").groupBy("x", "y").agg(F.min("label").alias("label"))
    who = names.select(F.col("nconst").alias("x"), "primaryName").dropDuplicates(["x"])
    steps = pair.join(shared, ["x", "y"], "left").join(who, "x", "left")
    step = F.struct("pos", F.coalesce("primaryName", F.lit(UNKNOWN)).alias("actorName"), F.coalesce("label", F.lit(UNKNOWN_TITLE)).alias("movieTitle"))
    listed = F.transform(F.array_sort(F.collect_list(step)), lambda s: F.struct(s["actorName"], s["movieTitle"]))
    return steps.groupBy("path").agg(listed.alias("steps"))


def shared_titles(members: DataFrame, titles: DataFrame, a, b, limit: int = 10) -> DataFrame:
    """(label) of the titles that two people share: distinct, in order, at most 10 and at most limit."""
    x, y = (members.where(F.col("nconst") == F.lit(v)).select("tconst") for v in (a, b))
    return x.join(y, "tconst").join(titles.select("tconst", "label"), "tconst").select("label").distinct().orderBy("label").limit(min(10, limit))


def resolve_name(names: DataFrame, name: str) -> DataFrame:
    """(nconst): of those of exactly this name with a birth year and known titles, who is known for most; then the smallest id."""
    known = names.where((F.col("primaryName") == F.lit(name)) & F.col("birthYear").isNotNull() & F.col("knownForTitles").isNotNull() & (F.col("knownForTitles") != ""))
    return known.orderBy(comma_count(F.col("knownForTitles")).desc(), "nconst").limit(1).select("nconst")


def names_of(names: DataFrame, ids: DataFrame) -> DataFrame:
    return names.join(ids, "nconst", "left_semi").select("nconst", "primaryName")


def ids_from_csv(spark: SparkSession, csv: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.split(F.lit(csv), ",")).alias("nconst"))


def separation(spark: SparkSession, principals: DataFrame, names: DataFrame, name: str, source_id: str, max_depth: int = MAX_DEPTH) -> int:
    """Degrees between the person of that name and the source person; -1 for unknown people and beyond max_depth."""
    row = resolve_name(names, name).first()
    if row is None:
        return -1
    near = laid_out(principals)
    found = distance(spark, source_id, row["nconst"], near, max_depth)
    near.forget()
    return found


def separation_paths(spark: SparkSession, principals: DataFrame, names: DataFrame, titles: DataFrame, name: str, source_id: str, source_name: str, max_paths: int | None = None, config: SearchConfig = SearchConfig()) -> dict:
    """number and paths: null if there is none, [] for the source person, else up to max_paths (1 to 10, 3 if null)
    lists of steps. titles has (tconst, label). Neighbours get one path for each title they share."""
    limit, row = clamp_paths(max_paths), resolve_name(names, name).first()
    if row is None:
        return {"number": -1, "paths": None}
    if row["nconst"] == source_id:
        return {"number": 0, "paths": []}
    members, near = kept(membership(principals)), laid_out(principals)
    found = search(spark, row["nconst"], source_id, near, config.max_depth)
    if found is None:
        return {"number": -1, "paths": None}
    if found[0] == 1:
        labels = [r["label"] for r in shared_titles(members, titles, row["nconst"], source_id, limit).collect()]
        return {"number": 1, "paths": [[{"actorName": source_name, "movieTitle": x}] for x in labels]}
    labelled = label_paths(found_paths(*found, near, limit), members, names, titles).orderBy("path").limit(limit).collect()
    return {"number": found[0], "paths": [[s.asDict() for s in r["steps"]] for r in labelled]}


def source_distances(principals: DataFrame, source, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(node, distance) from one source, for all within max_depth: asked once, it answers for any target."""
    near = laid_out(principals)
    found = distances(root(principals.sparkSession, source), near, max_depth)
    near.forget()
    return found


def refreshed_distances(known: DataFrame, members: Neighbours, added: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(node, distance) of those who came nearer once memberships (tconst, nconst) were added, which members have already.

    Distances can only shrink. Each round looks at the titles of those who came nearer, at first at the titles that were
    added to, and lets their people be one farther than the nearest of them; it ends when nobody comes nearer.
    """
    titles = added.select("tconst").where("tconst is not null").distinct()
    now, changed = kept(known.select("node", "distance")), None
    while True:
        nearer = kept(members.nearer(titles, now, max_depth))
        if nearer.isEmpty():
            return nearer if changed is None else changed
        before = [now] if changed is None else [now, changed]
        replaced = lambda df: kept(df.join(nearer, "node", "left_anti").unionByName(nearer))  # noqa: B023,E731
        now, changed = replaced(now), nearer if changed is None else replaced(changed)
        titles = kept(members.titles(nearer))
        for table in before:
            forget(table)


def paths_by_distance(known: DataFrame, node, neighbours: Neighbours, limit: int = 10) -> DataFrame:
    """(path): the limit smallest shortest paths from a node to the source that known distances are from; none beyond them.

    No search: what lies on a shortest path is told by its distance.
    """
    spark = known.sparkSession
    start = root(spark, node)
    row = known.where(F.col("node") == F.lit(node)).first()
    if row is None:
        return start.select(F.array("node").alias("path")).limit(0)
    # On the way there each next node is one nearer, so every level on the way leads to the source.
    paths, on = start.select("node", F.array("node").alias("path")), start
    for left in range(row["distance"] - 1, -1, -1):
        on = kept(known.where(F.col("distance") == left).select("node").join(reached(neighbours, on), "node", "left_semi"))
        paths = kept(extended(neighbours, paths, on, limit))
    return paths.select("path").orderBy("path").limit(limit)


def known_separation(known: Table, names: Table, name: str) -> int:
    """separation() from the source whose distances a table (by node) has: the name from its copy by_name, and one look-up."""
    row = resolve_name(names.lookup([(name,)], "by_name"), name).first()
    found = known.lookup([(row["nconst"],)]).first() if row else None
    return -1 if found is None else found["distance"]
