import datetime as dt
import gzip
import hashlib
import http.server
import os
import threading
import time
import urllib.error

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.__main__ import main
from cinegraph.schemas import duplicate_keys, has_twins, orphans
from cinegraph.sources import layout, load
from cinegraph.sources.fetch import fetch, fetch_all
from cinegraph.sources.files import kept
from cinegraph.sources.layout import Copy, DuplicateKeys, Layout, Table
from cinegraph.sources.load import MissingParents, Store, changed_at, judged, sha256_of, upsert, utc_text, version
from cinegraph.sources.tsv import clean, cut_crew, first_line, last_line, read_keys, read_quoted, read_tsv, retain, write_tsv
from cinegraph.streaming.refresh import appended, drained, pages, refresh

HEADERS = {
    "name.basics": "nconst\tprimaryName\tbirthYear\tdeathYear\tprimaryProfession\tknownForTitles",
    "title.basics": "tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres",
    "title.ratings": "tconst\taverageRating\tnumVotes",
    "title.crew": "tconst\tdirectors\twriters",
    "title.principals": "tconst\tordering\tnconst\tcategory\tjob\tcharacters",
}
ROWS = {
    "name.basics": ["n1\tAnn\t1950\t\\N\t\tt1", "n2\tBob\t\\N\t\\N\tactor\t\\N", "n3\tCy\t1\t2\tx\tt9"],
    "title.basics": ['t1\tmovie\tx"y\t\t0\t2000\t\\N\t90\tDrama', "t2\ttvEpisode\tE\tE\t1\t\\N\t\\N\t\\N\t\\N", "t3\tshort\tS\tS\t0\t1\t1\t1\tA"],
    "title.ratings": ["t1\t8.5\t100", "t9\t1.0\t1"],
    "title.crew": ["t1\tn1,n2\t\\N", "t9\tn1\tn1"],
    "title.principals": ["t1\t1\tn1\tactor\t\\N\t\\N", "t2\t1\tn2\tactor\t\\N\t\\N", "t1\t2\tn9\tactor\t\\N\t\\N"],
}


@pytest.fixture()
def dumps(tmp_path):
    for name, rows in ROWS.items():
        with gzip.open(tmp_path / f"{name}.tsv.gz", "wt") as f:
            f.write("\n".join([HEADERS[name], *rows]) + "\n")
    return tmp_path


def test_cells_keep_their_meaning(spark, dumps):
    t = {r.tconst: r for r in read_tsv(spark, f"{dumps}/title.basics.tsv.gz", "title_basics", 3).collect()}
    assert (t["t1"].originalTitle, t["t1"].isAdult, t["t1"].endYear, t["t1"].primaryTitle, t["t2"].isAdult, t["t2"].genres) == ("", False, None, 'x"y', True, None)


def test_a_cell_of_another_type_is_an_error(spark, tmp_path):
    (tmp_path / "r.tsv").write_text(HEADERS["title.ratings"] + "\nt1\tgood\t3\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_tsv(spark, f"{tmp_path}/r.tsv", "title_ratings").collect()


def test_quoted_form_drops_rows_that_do_not_fit(spark, tmp_path):
    (tmp_path / "r.tsv").write_text(HEADERS["title.ratings"] + '\nt1\t8.5\t3\n"t2"\tgood\t3\nt3\t\\N\t4\n')
    assert [(r.tconst, r.averageRating) for r in read_quoted(spark, f"{tmp_path}/r.tsv", "title_ratings").orderBy("tconst").collect()] == [("t1", 8.5), ("t3", None)]


def tables(spark, dumps):
    return {n.replace(".", "_"): read_tsv(spark, f"{dumps}/{n}.tsv.gz", n.replace(".", "_")) for n in ROWS}


@pytest.mark.parametrize(("options", "titles"), [({}, ["t1", "t3"]), ({"with_tv_episodes": True}, ["t1", "t2", "t3"]), ({"minimal": True}, ["t1"])])
def test_cleaning_leaves_no_orphans(spark, dumps, options, titles):
    t = clean(tables(spark, dumps), **options)
    assert [r.tconst for r in t["title_basics"].orderBy("tconst").collect()] == titles
    assert "x'y" in [r.primaryTitle for r in t["title_basics"].collect()]
    for child, key, parent in (("title_principals", "tconst", "title_basics"), ("title_principals", "nconst", "name_basics"), ("title_ratings", "tconst", "title_basics"), ("title_crew", "tconst", "title_basics"), ("name_basics", "nconst", "title_principals")):
        assert orphans(t[child], t[parent], key, key).isEmpty(), (child, parent)


def test_write_and_read_again(spark, dumps, tmp_path):
    t = tables(spark, dumps)["title_basics"]
    write_tsv(t, f"{tmp_path}/out")
    assert sorted(read_tsv(spark, f"{tmp_path}/out", "title_basics").collect(), key=str) == sorted(t.collect(), key=str)


def test_crew_lists_are_cut_by_characters(spark):
    c = spark.createDataFrame([("t", "nm1,nm22,nm3", None)], "tconst string, directors string, writers string")
    assert cut_crew(c, "nm9", 2).first().directors == "nm1,nm2"


def test_upsert_keeps_what_vanished_and_refuses_twins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    stage = spark.createDataFrame([("B", 2), ("d", 4)], "v string, k int")
    once = upsert(base, stage, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert sorted(map(tuple, upsert(once, stage, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    with pytest.raises(DuplicateKeys):
        upsert(base, stage.union(stage), ["k"])
    assert [tuple(r) for r in duplicate_keys(stage.union(stage), ["k"]).orderBy("k").collect()] == [(2, 2), (4, 2)]


def whole(dumps):
    """The dumps without rows that lack a parent."""
    for name, rows in {"title.ratings": ["t1\t8.5\t100", "t3\t1.0\t1"], "title.crew": ["t1\tn1,n2\t\\N", "t2\tn1\tn1"], "title.principals": ["t1\t1\tn1\tactor\t\\N\t\\N", "t2\t1\tn2\tdirector\t\\N\t\\N", "t1\t2\tn3\tactress\t\\N\t\\N"]}.items():
        dump(dumps, name, rows)
    return dumps


def dump(folder, name, rows):
    with gzip.open(folder / f"{name}.tsv.gz", "wt") as f:
        f.write("\n".join([HEADERS[name], *rows]) + "\n")


def test_store_loads_what_changed(spark, dumps, tmp_path):
    whole(dumps)
    store = Store(spark, f"{tmp_path}/store", 4)
    assert store.read("title_ratings").isEmpty() and store.state().isEmpty()
    assert all(store.load_all(str(dumps), mode="init").values()) and not any(store.load_all(str(dumps)).values())
    dump(dumps, "title.ratings", ["t1\t9.0\t200", "t2\t5.0\t5"])
    assert not any(store.load_all(str(dumps), mode="init").values())
    assert [t for t, new in store.load_all(str(dumps)).items() if new] == ["title_ratings"]
    assert sorted(map(tuple, store.read("title_ratings").collect())) == [("t1", 9.0, 200), ("t2", 5.0, 5), ("t3", 1.0, 1)]
    assert {r.table: r.n for r in store.counts().collect()} == {"name_basics": 3, "title_basics": 3, "title_ratings": 3, "title_crew": 2, "title_principals": 3}
    assert {r.dataset_key: r.sha256 for r in store.state().collect()} == {t: sha256_of(spark, f"{dumps}/{t.replace('_', '.')}.tsv.gz") for t in ("name_basics", "title_basics", "title_ratings", "title_crew", "title_principals")}


def test_update_leaves_no_mark(spark, dumps, tmp_path):
    store = Store(spark, f"{tmp_path}/store", 2)
    store.load_all(str(whole(dumps)))
    assert not store.marked()


def test_rows_without_parents(spark, dumps, tmp_path):
    """Refused as a whole, or set aside with the reason; a null reference lacks nothing, a null key is wrong."""
    store = Store(spark, f"{tmp_path}/store", 4)
    for t in ("name_basics", "title_basics"):
        store.load(t, f"{dumps}/{t.replace('_', '.')}.tsv.gz")
    dump(dumps, "title.principals", ["t1\t1\tn1\tactor\t\\N\t\\N", "t9\t1\tn1\tactor\t\\N\t\\N", "t1\t2\tn9\tactor\t\\N\t\\N", "t8\t2\tn9\tactor\t\\N\t\\N", "t2\t3\t\\N\tactor\t\\N\t\\N"])
    path = f"{dumps}/title.principals.tsv.gz"
    with pytest.raises(MissingParents, match="1 with no parent of nconst, 2 with no parent of tconst, 1 with null nconst"):
        store.load("title_principals", path)
    assert store.current("title_principals") is None and store.read("title_principals").isEmpty()
    assert store.load("title_principals", path, orphans="aside")
    assert [(r.tconst, r.nconst) for r in store.read("title_principals").collect()] == [("t1", "n1")]
    assert sorted((r.tconst, r.ordering, r._wrong) for r in store.rejected("title_principals").collect()) == [("t1", 2, "no parent of nconst"), ("t2", 3, "null nconst"), ("t8", 2, "no parent of tconst"), ("t9", 1, "no parent of tconst")]
    ratings = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "tconst string, numVotes int")
    told = judged(ratings.withColumn("k", F.lit(1)), ["k"], [(spark.createDataFrame([("a",), ("a",)], "tconst string"), "tconst", "tconst")])
    assert sorted((r.numVotes, r._wrong) for r in told.collect()) == [(1, None), (2, None), (3, "no parent of tconst")]
    with pytest.raises(ValueError, match="no such way"):
        store.load("title_principals", path, orphans="keep")


def test_one_of_two_loaders_goes_again(spark, dumps, tmp_path):
    """A second loader makes the next version while the first one works: both loads are in the end there."""
    whole(dumps)
    one, two = Store(spark, f"{tmp_path}/store", 4), Store(spark, f"{tmp_path}/store", 4)
    for t in ("name_basics", "title_basics"):
        one.load(t, f"{dumps}/{t.replace('_', '.')}.tsv.gz")
    plain, tries = one._followed, []

    def meanwhile(*a):
        tries.append(1)
        new = plain(*a)
        if len(tries) == 1:
            assert two.load("title_ratings", f"{dumps}/title.ratings.tsv.gz")
        return new

    one._followed = meanwhile
    assert one.load("title_crew", f"{dumps}/title.crew.tsv.gz") and len(tries) == 2
    assert one.log.numbers() == [1, 2, 3, 4] and one.read("title_crew", number=3).isEmpty()
    assert one.read("title_ratings").count() == 2 and two.read("title_crew").count() == 2
    # What the loader wrote that had to go again is nobody's.
    gone = one.vacuum()
    assert gone and all(g.startswith("title_crew/main/") for g in gone) and two.log.numbers() == [4] and two.counts().where("n > 0").count() == 4
    assert not one.log.commit(4, {})


def scanned(df):
    """The rows that come out of a query's file scans."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName())


def wide_table(spark, root, rows=20_000, buckets=8):
    """Rows with two ways to be found, and a copy of some of them."""
    schema = T.StructType.fromDDL("k string, name string, v int")
    others = {"by_name": Copy(["name"], ["name", "k"], ["k", "name"]), "even": Copy(["k"], ["k"], ["k", "v"], "v % 2 = 0")}
    table = Table(Layout(spark, root, schema, ["k"], ["k"], others, buckets))
    table.upsert(spark.range(rows).select(F.format_string("k%05d", "id").alias("k"), F.format_string("n%04d", F.col("id") % 5000).alias("name"), F.col("id").cast("int").alias("v")))
    return table


def test_a_lookup_reads_little(spark, tmp_path):
    table = wide_table(spark, f"{tmp_path}/t")
    by_key, by_name = table.lookup([("k00077",)]), table.lookup([("n0077",)], "by_name")
    assert [r.v for r in by_key.collect()] == [77] and sorted(r.k for r in by_name.collect()) == ["k00077", "k05077", "k10077", "k15077"]
    for df in (by_key, by_name):
        assert len(df.inputFiles()) == 1 and scanned(df) < 20_000 / 8 * 1.2
    assert sorted(r.v for r in table.lookup([("k00003",), ("k19999",), ("none",)]).collect()) == [3, 19999] and table.lookup([]).isEmpty()
    assert table.read("even").count() == 10_000
    other = Table(Layout(spark, f"{tmp_path}/t", table.layout.schema, ["k"], ["k"], table.layout.others, 3))
    assert other.layout.buckets == 8 and [r.v for r in other.lookup([("k00077",)]).collect()] == [77]


def test_a_load_rewrites_what_it_touches(spark, tmp_path):
    """Rows written grow with the load; copies lose what a changed row was; older versions stay as they were."""
    root = f"{tmp_path}/t"
    table = wide_table(spark, root, buckets=32)
    before = table.log.latest()[1]["copies"]
    few = spark.createDataFrame([("k00001", "new", 2), ("k00002", "n0002", 3), ("x", "n0003", 4)], "k string, name string, v int")
    assert table.upsert(few)
    after = table.log.latest()[1]["copies"]
    changed = {name: [b for b, f in after[name].items() if before[name].get(b) != f] for name in after}
    assert 0 < len(changed["main"]) <= 3 and 0 < len(changed["by_name"]) <= 4 and 0 < len(changed["even"]) <= 3
    (folder,) = {after["main"][b] for b in changed["main"]}
    assert spark.read.parquet(f"{root}/main/{folder}").count() < 20_000 / 32 * 3 * 1.3
    assert {r.k for r in table.lookup([("n0001",)], "by_name").collect()} == {"k05001", "k10001", "k15001"} and [r.k for r in table.lookup([("new",)], "by_name").collect()] == ["k00001"]
    assert table.read("even").where("k in ('k00001', 'k00002', 'x')").count() == 2
    assert table.read().count() == 20_001 and table.read(number=1).count() == 20_000 and table.read("by_name").count() == 20_001
    with pytest.raises(DuplicateKeys):
        table.upsert(few.union(few))
    gone = table.layout.vacuum([after])
    assert sorted(gone) == sorted(f"{name}/{before[name][b]}/_bucket={b}" for name in changed for b in changed[name] if b in before[name])
    assert table.read().count() == 20_001 and table.layout.vacuum([after]) == []


def test_refresh_from_a_stream(spark, tmp_path):
    table = Table(Layout(spark, f"{tmp_path}/t", T.StructType.fromDDL("k int, v string"), ["k"], ["k"], buckets=4))
    table.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    for rows in ([(2, "z"), (3, "c")], [(2, "x"), (None, "n")]):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    refresh(spark, f"{tmp_path}/in", table, f"{tmp_path}/mark").awaitTermination()
    want = sorted([(1, "a"), (2, "x"), (3, "c"), (None, "n")], key=str)
    assert sorted(map(tuple, table.read().collect()), key=str) == want
    assert not table.upsert(spark.createDataFrame([(1, "again")], "k int, v string"), 0)
    refresh(spark, f"{tmp_path}/in", table, f"{tmp_path}/another").awaitTermination()
    assert sorted(map(tuple, table.read().collect()), key=str) == want


def test_refresh_takes_no_twins_of_one_file(spark, tmp_path):
    table = Table(Layout(spark, f"{tmp_path}/t", T.StructType.fromDDL("k int, v string"), ["k"], ["k"], buckets=4))
    spark.createDataFrame([(2, "x"), (2, "z")], "k int, v string").coalesce(1).write.parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="share k"):
        refresh(spark, f"{tmp_path}/in", table, f"{tmp_path}/mark").awaitTermination()


def test_hash_time_and_version(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc" * 100_000)
    assert sha256_of(spark, f"{tmp_path}/f") == hashlib.sha256(b"abc" * 100_000).hexdigest()
    assert abs(changed_at(spark, f"{tmp_path}/f").timestamp() - (tmp_path / "f").stat().st_mtime) < 1
    assert utc_text(dt.datetime(2020, 1, 2, 5, 4, 5, tzinfo=dt.timezone(dt.timedelta(hours=2)))) == "2020-01-02T03:04:05Z"
    assert version(spark).startswith("4.")


def test_key_lists(spark, tmp_path):
    (tmp_path / "keys").write_text("t1\n t3 \n\nt1\n")
    df = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", None), ("d", "t3")], "x string, tconst string")
    assert [r.x for r in retain(df, read_keys(spark, f"{tmp_path}/keys", "tconst")).orderBy("x").collect()] == ["a", "d"]


def test_commands(spark, dumps, tmp_path, capsys):
    main(["clean", str(dumps), f"{tmp_path}/tidy", "--minimal"], spark)
    main(["load", f"{tmp_path}/few", f"{tmp_path}/tidy", "--minimal"], spark)
    assert "title_basics 1 loaded" in capsys.readouterr().out
    main(["load", f"{tmp_path}/db", str(dumps), "--mode", "init", "--orphans", "aside", "--buckets", "3"], spark)
    assert "title_basics 3 loaded" in capsys.readouterr().out
    main(["load", f"{tmp_path}/db", str(dumps), "--mode", "init"], spark)
    assert "title_basics 3 unchanged" in capsys.readouterr().out
    store = Store(spark, f"{tmp_path}/db", 5)
    assert store.marked() and store.buckets == 3 and [r.primaryTitle for r in store.lookup("title_basics", ["t3"]).collect()] == ["S"]
    with pytest.raises(ValueError):
        store.load_all(str(dumps), "again")


def test_finite_streams(spark):
    a, b, c = (spark.range(x, x + 4) for x in (0, 4, 8))
    assert sorted(a.union(b).union(c).collect()) == sorted(a.union(b.union(c)).collect())
    assert [len(p) for p in pages(spark.range(10).orderBy("id"), 4)] == [4, 4, 2] and list(pages(spark.range(0), 4)) == []
    assert a.select((F.col("id") + 1).alias("id")).select((F.col("id") * 2).alias("id")).collect() == a.select(((F.col("id") + 1) * 2).alias("id")).collect()


def test_a_stream_is_drained(spark, tmp_path):
    for i, ks in enumerate(([1, 2], [3])):
        spark.createDataFrame([(k,) for k in ks], "k int").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema("k int").parquet(f"{tmp_path}/in/*").where("k > 1")
    assert sorted(r.k for r in drained(stream(), f"{tmp_path}/a").collect()) == [2, 3]
    assert drained(stream().where("k > 9"), f"{tmp_path}/b").collect() == []
    (tmp_path / "none").mkdir()
    assert drained(spark.readStream.schema("k int").parquet(f"{tmp_path}/none"), f"{tmp_path}/c").collect() == []


def test_streams_are_appended(spark, tmp_path):
    """(a + b) + c is a + (b + c), none is the neutral one, and a call that is made again takes nothing twice."""
    for name, ks in (("a", [1, 2]), ("b", [2, 3]), ("c", [9]), ("none", [])):
        spark.createDataFrame([(k,) for k in ks], "k int").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    stream = lambda n: spark.readStream.schema("k int").parquet(f"{tmp_path}/{n}")
    rows = lambda df: sorted((r._stream, r.k) for r in df.collect())
    both = appended([stream("a"), stream("b")], f"{tmp_path}/1")
    assert rows(both) == [(0, 1), (0, 2), (1, 2), (1, 3)]
    assert rows(appended([stream("a"), stream("b")], f"{tmp_path}/1")) == rows(both)
    order = lambda *names: [k for _, k in rows(appended([stream(n) for n in names], f"{tmp_path}/out/{'-'.join(names)}"))]
    assert order("a", "b", "c") == [k for _, k in rows(both)] + order("c") == order("a") + order("b", "c")
    assert order("none", "a") == order("a", "none") == order("a") and order("none") == []


def test_first_and_last_lines(spark, dumps, tmp_path):
    path = f"{dumps}/title.ratings.tsv.gz"
    assert (first_line(spark, path), last_line(spark, path)) == (HEADERS["title.ratings"], "t9\t1.0\t1")
    (tmp_path / "none").write_text("")
    assert first_line(spark, f"{tmp_path}/none") is None and last_line(spark, f"{tmp_path}/none") is None
    spark.range(2000).select(F.col("id").cast("string")).coalesce(1).write.text(f"{tmp_path}/long")
    assert last_line(spark, f"{tmp_path}/long") == "1999"


@pytest.fixture()
def published(dumps):
    """The dumps as a server has them, and what it was asked for."""
    asked = []

    class Handler(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *a):
            super().__init__(*a, directory=str(dumps))

        def log_message(self, form, *a):
            asked.append((self.command, a[1]))

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_dumps_are_fetched_if_newer(spark, dumps, tmp_path, published, capsys):
    url, asked = published
    whole(dumps)
    old = 1_600_000_000
    for f in dumps.glob("*.gz"):
        os.utime(f, (old, old))
    assert all(fetch_all(spark, url, f"{tmp_path}/here").values()) and not any(fetch_all(spark, url, f"{tmp_path}/here").values())
    assert {code for _, code in asked[-5:]} == {"304"}
    assert (tmp_path / "here" / "title.basics.tsv.gz").read_bytes() == (dumps / "title.basics.tsv.gz").read_bytes() and (tmp_path / "here" / "title.basics.tsv.gz").stat().st_mtime == old
    dump(dumps, "title.ratings", ["t1\t9.0\t200"])
    assert [t for t, new in fetch_all(spark, url, f"{tmp_path}/here").items() if new] == ["title_ratings"]
    (dumps / "title.crew.tsv.gz.minimal").write_bytes(b"few")
    assert fetch(spark, f"{url}/title.crew.tsv.gz.minimal", f"{tmp_path}/here/title.crew.minimal.tsv.gz")
    before = (tmp_path / "here" / "title.crew.tsv.gz").read_bytes()
    with pytest.raises(urllib.error.HTTPError):
        fetch(spark, f"{url}/nothing", f"{tmp_path}/here/title.crew.tsv.gz")
    assert (tmp_path / "here" / "title.crew.tsv.gz").read_bytes() == before and not [f for f in os.listdir(tmp_path / "here") if len(f) > 40]
    main(["load", f"{tmp_path}/db", f"{tmp_path}/here", "--from", url], spark)
    assert "title_ratings 1 loaded" in capsys.readouterr().out


def test_a_large_bucket_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Rows of few keys, too: with 50 rows a task, a bucket of 500 goes into about ten files, and a load over it keeps all."""
    monkeypatch.setattr(layout, "ROWS", 50, raising=False)
    monkeypatch.setattr(layout, "LEAST", 50, raising=False)
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("kind"), F.array((F.col("id") % 2), F.lit(7)).alias("many"))
    rows = rows.withColumn("many", F.when(F.col("id") >= 10, F.col("many")))
    others = {"by_kind": Copy(["kind"], ["kind", "id"], ["kind", "id"], "kind < 2"), "each": Copy(["one"], ["one", "id"], ["id"], each=("one", "many"))}
    table = Table(Layout(spark, f"{tmp_path}/t", rows.schema, ["id"], ["id"], others, 2))
    table.upsert(kept(rows))
    for name, copy in table.layout.copies().items():
        sizes = [r["count"] for r in table.read(name).groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == copy.of(rows).count() == copy.size(rows) and max(sizes) <= 120
    table.upsert(kept(rows.where("id % 10 = 0").withColumn("kind", F.lit(1).cast("long"))))
    want = {(i, 1 if i % 10 == 0 else i % 3) for i in range(1000)}
    assert {(r.id, r.kind) for r in table.read().collect()} == want and table.read().count() == 1000
    assert sorted(r.id for r in table.lookup([(1,)], "by_kind").collect()) == sorted(i for i, k in want if k == 1)
    assert table.lookup([(7,)], "each").count() == 990 and [r.kind for r in table.lookup([(20,)]).collect()] == [1]


def test_judging_sorts_no_rows(spark, monkeypatch):
    """Many parents are held by their parts; null references of any number are dealt over all tasks."""
    monkeypatch.setattr(load, "FEW", 0, raising=False)
    monkeypatch.setattr(load, "parts_of", lambda rows: 5, raising=False)
    rows = spark.range(200).select("id", F.when(F.col("id") >= 100, F.col("id") % 50).alias("ref"))
    parents = spark.range(40).union(spark.range(20)).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    told = judged(rows, ["id"], [(parents, "ref", "k")])
    got = {r.id: r._wrong for r in told.collect()}
    assert got == {i: "no parent of ref" if i >= 100 and (i % 50 == 0 or i % 50 >= 40) else None for i in range(200)} and told.count() == 200
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert len({r[0] for r in told.where("ref is null").select(F.spark_partition_id()).collect()}) == 5


def test_rows_move_only_if_a_parent_is_missing(spark, dumps, tmp_path, monkeypatch):
    """A load without faults judges single columns; one with faults judges whole rows once, whatever copies are made of them."""
    whole, seen = load.judged, []
    monkeypatch.setattr(load, "judged", lambda stage, keys, parents: (seen.append(len(stage.columns)), whole(stage, keys, parents))[1])
    store = Store(spark, f"{tmp_path}/store", 2)
    for t in ("name_basics", "title_basics"):
        store.load(t, f"{dumps}/{t.replace('_', '.')}.tsv.gz")
    dump(dumps, "title.principals", ["t1\t1\tn1\tactor\t\\N\t\\N", "t2\t1\tn2\tactor\t\\N\t\\N"])
    assert store.load("title_principals", f"{dumps}/title.principals.tsv.gz") and seen == [1, 1]
    dump(dumps, "title.principals", ["t3\t1\tn1\tactor\t\\N\t\\N", "t3\t2\tn9\tactor\t\\N\t\\N", "\\N\t1\tn2\tself\t\\N\t\\N"])
    seen.clear()
    assert store.load("title_principals", f"{dumps}/title.principals.tsv.gz", orphans="aside") and seen.count(6) == 1
    assert sorted((r.tconst, r.nconst) for r in store.read("title_principals", "by_person").collect()) == [("t1", "n1"), ("t2", "n2"), ("t3", "n1")]
    assert sorted((str(r.tconst), r.nconst, r._wrong) for r in store.rejected("title_principals").collect()) == [("None", "n2", "null tconst"), ("t3", "n9", "no parent of nconst")]
    assert not os.listdir(f"{tmp_path}/store/_stage")


def test_twins_are_told_from_hashes_and_keys(spark):
    rows = spark.createDataFrame([("a", None), (None, "a"), ("b", "c"), ("a", "c")], "x string, y string")
    assert spark.range(1).select(F.xxhash64(F.lit("a"), F.lit(None)) == F.xxhash64(F.lit(None), F.lit("a"))).first()[0]
    assert not has_twins(rows, ["x", "y"]) and has_twins(rows.union(rows.limit(1)), ["x", "y"]) and has_twins(rows, ["x"])
