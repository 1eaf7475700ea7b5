import os
import random
from collections import deque

import pytest

from cinegraph.operators import graph
from cinegraph.sources.layout import Layout, Table
from cinegraph.sources.load import COPIES

LINE4 = [("A", "B"), ("B", "C"), ("C", "D")]
MULTI = [("A", "B"), ("A", "C"), ("B", "C"), ("B", "D"), ("C", "D"), ("C", "E"), ("D", "F")]
DIAMOND = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")]
STAR = [("A", f"B{i}") for i in range(10)] + [(f"B{i}", "C") for i in range(10)]
PARTS = [("A", "B"), ("X", "Y")]


def members(spark, edges):
    rows = [(f"{u}_{v}", n) for u, v in edges for n in (u, v)]
    return spark.createDataFrame(rows, "tconst string, nconst string")


@pytest.mark.parametrize(
    ("edges", "source", "target", "depth", "expected"),
    [
        ([("P", "Q")], "A", "A", 6, 0),
        (LINE4, "A", "D", 10, 3),
        (LINE4[:2], "A", "C", 1, -1),
        (PARTS, "A", "Y", 10, -1),
        (MULTI, "A", "F", 10, 3),
        ([(f"n{i}", f"n{i + 1}") for i in range(7)], "n0", "n7", 6, -1),
        ([(f"n{i}", f"n{i + 1}") for i in range(6)], "n0", "n6", 6, 6),
    ],
)
def test_distance(spark, edges, source, target, depth, expected):
    near = graph.neighbours_of(members(spark, edges))
    assert graph.distance(spark, source, target, near, depth) == expected
    assert graph.distance(spark, target, source, near, depth) == expected


@pytest.mark.parametrize(
    ("edges", "source", "target", "depth", "expected"),
    [
        ([("P", "Q")], "A", "A", 6, ["A"]),
        (LINE4, "A", "D", 3, ["ABCD"]),
        (LINE4, "A", "D", 2, []),
        (PARTS, "A", "Y", 10, []),
        (DIAMOND, "A", "D", 2, ["ABD", "ACD"]),
        (STAR, "A", "C", 2, [f"AB{i}C" for i in range(10)]),
        ([("A", "B")], "A", "B", 1, ["AB"]),
    ],
)
def test_shortest_paths(spark, edges, source, target, depth, expected):
    got = graph.shortest_paths(spark, source, target, graph.neighbours_of(members(spark, edges)), depth, 10)
    assert ["".join(r.path) for r in got.orderBy("path").collect()] == expected


def test_meeting_nodes_of_a_star_are_its_middle(spark):
    total, a, b, meeting = graph.search(spark, "A", "C", graph.neighbours_of(members(spark, STAR)), 2)
    assert total == 2 and {r.node for r in meeting.collect()} <= {f"B{i}" for i in range(10)} | {"A", "C"}


def test_random_graphs_agree_with_plain_search(spark):
    rng = random.Random(4)
    for _ in range(2):
        nodes = [f"{i:02d}" for i in range(14)]
        edges = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(18)})
        near = {n: {v for e in edges for v in e if n in e and v != n} for n in nodes}
        dist, queue = {nodes[0]: 0}, deque([nodes[0]])
        while queue:
            u = queue.popleft()
            for v in near[u] - dist.keys():
                dist[v] = dist[u] + 1
                queue.append(v)
        m = members(spark, edges)
        got = graph.distances(spark.createDataFrame([(nodes[0],)], "node string"), graph.neighbours_of(m), 14)
        assert {r.node: r.distance for r in got.collect()} == dist
        far = max(dist, key=lambda n: (dist[n], n))
        paths = [r.path for r in graph.shortest_paths(spark, nodes[0], far, graph.neighbours_of(m), 14, 3).collect()]
        every = [[nodes[0]]]
        for _ in range(dist[far]):
            every = [p + [v] for p in every for v in near[p[-1]] if dist[v] == len(p)]
        assert sorted(paths) == sorted(p for p in every if p[-1] == far)[:3]


@pytest.fixture(scope="module")
def film(spark):
    p = [("t1", "a"), ("t1", "b"), ("t1", "b"), ("t2", "a"), ("t2", "b"), ("t3", "b"), ("t3", "c"), ("t4", "d"), (None, "a")]
    principals = spark.createDataFrame([(t, 1, n, "actor", None, None) for t, n in p], "tconst string, ordering int, nconst string, category string, job string, characters string")
    names = spark.createDataFrame([("a", "Ann", 1950, "t1"), ("b", "Bob", 1960, "t1,t2,t3"), ("c", "Cy", 1970, "t3"), ("d", "Di", 1, "t4"), ("e", "Bob", 1961, "t1"), ("f", "Bob", None, "t1,t2,t3,t4,t5"), ("g", "Gus", 1, "")], "nconst string, primaryName string, birthYear int, knownForTitles string")
    titles = spark.createDataFrame([("t1", "One"), ("t2", "Two"), ("t3", "Three")], "tconst string, label string")
    return principals, names, titles


def test_names_resolve_to_who_is_known_for_most(film):
    assert [graph.resolve_name(film[1], n).collect()[0].nconst if not graph.resolve_name(film[1], n).isEmpty() else None for n in ("Bob", "Ann", "Gus", "bob")] == ["b", "a", None, None]


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("Ann", {"number": 0, "paths": []}),
        ("Bob", {"number": 1, "paths": [[{"actorName": "Ann", "movieTitle": "One"}], [{"actorName": "Ann", "movieTitle": "Two"}]]}),
        ("Cy", {"number": 2, "paths": [[{"actorName": "Cy", "movieTitle": "Three"}, {"actorName": "Bob", "movieTitle": "One"}]]}),
        ("Di", {"number": -1, "paths": None}),
        ("Nobody", {"number": -1, "paths": None}),
    ],
)
def test_separation_paths(spark, film, name, expected):
    principals, names, titles = film
    assert graph.separation_paths(spark, principals, names, titles, name, "a", "Ann", 10) == expected
    assert graph.separation(spark, principals, names, name, "a") == expected["number"]


def test_unknown_labels_have_defaults(spark, film):
    paths = spark.createDataFrame([(["x", "a"],)], "path array<string>")
    steps = graph.label_paths(paths, graph.membership(film[0]), film[1], film[2]).first().steps
    assert [s.asDict() for s in steps] == [{"actorName": "Unknown", "movieTitle": "Unknown Movie"}]


def test_a_hub_title(spark):
    m = spark.createDataFrame([("t", f"p{i}") for i in range(1000)] + [("u", "p0")], "tconst string, nconst string")
    assert graph.costars(m, spark.createDataFrame([("p0",)], "nconst string")).count() == 999


def test_path_limits():
    assert [graph.clamp_paths(k) for k in (None, 0, -5, 3, 10, 99)] == [3, 1, 1, 3, 10, 10]


def leaves(plan):
    """(name, names above it) of the leaves of an executed plan."""
    text, out, stack = plan.toString(), [], []
    for line in text.split("\n"):
        body = line.lstrip(" :+-*")
        depth = len(line) - len(body)
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, body))
        if "Scan parquet" in body:
            out.append((body, [b for _, b in stack[:-1]]))
    return out


def test_members_are_never_shuffled(spark):
    """With joins that shuffle, what is shuffled is the frontier and what comes of it."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        near = graph.laid_out(spark.range(3000).selectExpr("id % 900 as tconst", "id % 700 as nconst"))
        reach = near.reach(graph.kept(spark.range(5).selectExpr("id as node")))
        assert reach.count() > 5
        scans = leaves(reach._jdf.queryExecution().executedPlan())
        members = [above for scan, above in scans if "Bucketed: true" in scan]
        assert len(members) == 2 and len(scans) == 3
        assert spark.catalog.listTables() and len({f.rsplit("/", 1)[0] for f in reach.inputFiles()}) == 3
        # Between a scan of members and the join that takes it there is no exchange.
        for above in members:
            to_join = above[max(i for i, b in enumerate(above) if "Join" in b) :]
            assert not any(b.startswith("Exchange") for b in to_join), to_join
        folders = {f.rsplit("/", 1)[0].removeprefix("file:") for f in reach.inputFiles()}
        near.forget()
        assert sum(os.path.exists(f) for f in folders) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def outputs(plan, found):
    """The most rows that an operator of an executed plan gave, in all its parts."""
    name, metrics = plan.nodeName(), plan.metrics()
    if "AdaptiveSparkPlan" in name:
        return outputs(plan.executedPlan(), found)
    if "QueryStage" in name:
        return outputs(plan.plan(), found)
    if metrics.contains("numOutputRows"):
        found.append(metrics.apply("numOutputRows").value())
    children = plan.children()
    for i in range(children.size()):
        outputs(children.apply(i), found)
    return max(found)


def test_a_title_of_many_people(spark):
    """Paths through titles of 5,000 people take rows in proportion to these, not to their squares."""
    crowd = 5000
    rows = [("t1", f"a{i:04d}") for i in range(crowd)] + [("t2", f"a{i:04d}") for i in range(crowd)] + [("t2", "z"), ("t0", "s"), *(("t0", f"a{i:04d}") for i in range(crowd))]
    principals = spark.createDataFrame(rows, "tconst string, nconst string")
    near = graph.laid_out(principals)
    paths = [r.path for r in graph.shortest_paths(spark, "s", "z", near, limit=4).collect()]
    assert paths == [["s", f"a{i:04d}", "z"] for i in range(4)]
    start = spark.createDataFrame([("s", ["s"])], "node string, path array<string>")
    one = graph.kept(graph.extended(near, start, principals.where("nconst <> 's'").select(graph.F.col("nconst").alias("node")).distinct(), 3))
    two = graph.extended(near, one, spark.createDataFrame([("z",)], "node string"), 3)
    assert [r.path for r in two.orderBy("path").collect()] == paths[:3]
    assert outputs(two._jdf.queryExecution().executedPlan(), [0]) <= 6 * crowd


def test_a_hook_without_reach(spark):
    """Neighbours of one's own need pairs only."""
    pairs = spark.createDataFrame([(a, b) for x in DIAMOND for a, b in (x, x[::-1])], "parent string, node string")
    near = lambda frontier: pairs.join(frontier.select(graph.F.col("node").alias("parent")), "parent", "left_semi")
    assert ["".join(r.path) for r in graph.shortest_paths(spark, "A", "D", near).collect()] == ["ABD", "ACD"]
    assert graph.distances_to(spark, "A", ["D", "B", "Q", None, "A"], near) == [2, 1, -1, -1, 0]


def test_distances_from_a_known_source(spark, tmp_path):
    """Refreshed distances are those of a search over all, and paths by them those that a search finds."""
    rng = random.Random(12)
    nodes = [f"{i:02d}" for i in range(40)]
    edges = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(70)})
    old, new = members(spark, edges[::2]), members(spark, edges[1::2])
    both = old.union(new).union(spark.createDataFrame([(None, "00"), ("lone", "41")], "tconst string, nconst string"))
    before, near = graph.source_distances(old, "00"), graph.laid_out(both)
    nearer = graph.refreshed_distances(before, near, new)
    known = before.join(nearer, "node", "left_anti").unionByName(nearer)
    want = {r.node: r.distance for r in graph.source_distances(both, "00").collect()}
    assert {r.node: r.distance for r in known.collect()} == want
    assert graph.refreshed_distances(known, near, new.limit(0)).isEmpty() and graph.refreshed_distances(known, near, both).isEmpty()
    far = max(want, key=lambda n: (want[n], n))
    for node in (far, "00", "41"):
        assert [r.path for r in graph.paths_by_distance(known, node, near, 4).collect()] == ([] if node not in want else [r.path for r in graph.shortest_paths(spark, node, "00", near, 14, 4).collect()])
    table = Table(Layout(spark, f"{tmp_path}/d", known.schema, ["node"], ["node"], buckets=4))
    table.upsert(known)
    people = spark.createDataFrame([("00", "Source", 1, "t"), (far, "Far", 1, "t"), ("41", "Lone", 1, "t")], "nconst string, primaryName string, birthYear int, knownForTitles string")
    names = Table(Layout(spark, f"{tmp_path}/n", people.schema, ["nconst"], ["nconst"], {"by_name": COPIES["name_basics"]["by_name"]}, 4))
    names.upsert(people)
    assert [graph.known_separation(table, names, n) for n in ("Source", "Far", "Lone", "Nobody")] == [0, want[far], -1, -1]
