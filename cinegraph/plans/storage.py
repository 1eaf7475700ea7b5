"""Queries of the loader, of laid-out tables, of distances from a known source, and of streams, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.functions.text import path_segment
from cinegraph.operators import graph, search
from cinegraph.plans.binding import Data
from cinegraph.plans.registry import DISTANCES, query
from cinegraph.schemas import parts_of
from cinegraph.sources import tsv
from cinegraph.sources.files import kept, new_folder
from cinegraph.sources.layout import Copy, Layout, Table
from cinegraph.sources.load import COPIES, Store, judged, sha256_of
from cinegraph.streaming.refresh import appended, pages

#: The driver's tables are small; a laid-out table of a cluster has thousands of buckets.
BUCKETS = 8


def laid(df: DataFrame, keys: list[str], others: dict[str, Copy] | None = None) -> Table:
    """A table of its own in the shared folder with the rows of df."""
    table = Table(Layout(df.sparkSession, new_folder(df.sparkSession), df.schema, keys, keys[:1], others or {}, BUCKETS))
    table.upsert(kept(df))
    return table


@query("with {roles} select {flat} from titles where tconst in (7, 11, 42, 999999)")
def indexed_titles(d: Data) -> DataFrame:
    """Titles by id, each from its bucket."""
    found = laid(d.titles(), ["tconst"]).lookup([(k,) for k in (7, 11, 42, 999999)])
    return found.select(*search.movie_fields(found))


@query("select p_partkey as nconst from part left join (select l_partkey, count(*) as c from lineitem group by 1) on l_partkey = p_partkey where p_name = 'hot ring' and c > 0 order by c desc, 1 limit 1")
def indexed_name(d: Data) -> DataFrame:
    """A name resolved from the copy of the names that is in buckets by name."""
    table = laid(d.names(), ["nconst"], {"by_name": COPIES["name_basics"]["by_name"]})
    return graph.resolve_name(table.lookup([("hot ring",)], "by_name"), "hot ring")


@query("""with {roles} select {flat} from titles where ("primaryTitle" ilike 'RED %' or "originalTitle" ilike 'RED %') and "titleType" = 'PROMO' order by tconst limit 1""")
def title_by_postings(d: Data) -> DataFrame:
    """title_lookup_ilike() by the titles of the pattern's trigrams only."""
    return search.find_by_postings(laid(d.titles(), ["tconst"], {"postings": search.POSTINGS}).view(), "RED %", "RED %", "PROMO")


@query("""select l_partkey as nconst, l_orderkey as tconst, l_linenumber as ordering, count(*) as n from lineitem where l_partkey in (3, 5, 8) and l_returnflag = 'R' group by all""")
def partial_index(d: Data) -> DataFrame:
    """What some people acted in, from a copy by person of the actors' rows only."""
    rows = d.principals("true").groupBy("tconst", "ordering", "nconst", "category").agg(F.count("*").alias("n"))
    table = laid(rows, ["tconst", "ordering", "nconst", "category"], {"actors_by_person": Copy(["nconst"], ["nconst", "tconst"], where="category = 'R'")})
    return table.lookup([(3,), (5,), (8,)], "actors_by_person").select("nconst", "tconst", "ordering", "n")


@query("select o_orderkey as k, case when o_orderstatus = 'F' then o_totalprice else o_totalprice + 1 end as price from orders")
def bucketed_upsert(d: Data) -> DataFrame:
    """upsert_orders() by the buckets that the load touches, over two versions."""
    o = d.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("s"))
    table = laid(o.where("s <> 'P'").drop("s"), ["k"])
    table.upsert(kept(o.where("s <> 'F'").select("k", (F.col("price") + 1).alias("price"))))
    return table.read()


@query("""select l_orderkey as tconst, l_linenumber as ordering, l_partkey as nconst, count(*) as n,
case when not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P') then 'no parent of tconst' else 'no parent of nconst' end as wrong from lineitem
where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P') or not exists (select 1 from part where p_partkey = l_partkey and p_type <> 'PROMO') group by all""")
def rows_set_aside(d: Data) -> DataFrame:
    """Of a load whose parents are not all there: what is set aside, and why."""
    parents = [(d.table("orders").where("o_orderstatus <> 'P'"), "tconst", "o_orderkey"), (d.table("part").where("p_type <> 'PROMO'"), "nconst", "p_partkey")]
    told = judged(d.principals("true"), ["tconst", "ordering", "nconst"], parents)
    wrong = told.where("_wrong is not null").repartition(parts_of(d.table("lineitem").count()), "tconst", "ordering", "nconst")
    return wrong.groupBy("tconst", "ordering", "nconst", F.col("_wrong").alias("wrong")).agg(F.count("*").alias("n"))


def dumps(d: Data) -> dict[str, DataFrame]:
    """The driver's tables as base tables."""
    line, null = d.table("lineitem"), F.lit(None).cast("string")
    # Few rows of an order are near each other, so they are dealt out as they are, to as many tasks as they need, and grouped there.
    line = line.repartition(parts_of(line.count()), "l_orderkey")
    t, n = F.concat(F.lit("tt"), "l_orderkey").alias("tconst"), F.concat(F.lit("nm"), "l_partkey").alias("nconst")
    year = F.lit(None).cast("int")
    return {
        "name_basics": d.table("part").select(F.concat(F.lit("nm"), "p_partkey").alias("nconst"), F.col("p_name").alias("primaryName"), F.col("p_size").alias("birthYear"), year.alias("deathYear"), F.col("p_type").alias("primaryProfession"), F.when(F.col("p_size") % 2 == 0, "").alias("knownForTitles")),
        "title_basics": d.table("orders").select(F.concat(F.lit("tt"), "o_orderkey").alias("tconst"), F.lit("movie").alias("titleType"), F.col("o_orderpriority").alias("primaryTitle"), F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("originalTitle"), (F.col("o_orderkey") % 2 == 0).alias("isAdult"), (1900 + F.col("o_orderkey") % 100).cast("int").alias("startYear"), year.alias("endYear"), F.lit(90).alias("runtimeMinutes"), null.alias("genres")),
        "title_ratings": line.groupBy("l_orderkey").agg(F.avg("l_quantity").alias("averageRating"), F.count("*").cast("int").alias("numVotes")).select(t, "averageRating", "numVotes"),
        "title_crew": line.groupBy("l_orderkey").agg(F.concat(F.lit("nm"), F.min("l_partkey")).alias("directors")).select(t, "directors", null.alias("writers")),
        "title_principals": line.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.when(F.max("l_returnflag") == "R", "actor").otherwise("director").alias("category")).select(t, F.col("l_linenumber").alias("ordering"), n, "category", null.alias("job"), null.alias("characters")),
    }


@query("""with l as (select * from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey))
select 'name_basics' as "table", count(*) as n from part union all select 'title_basics', count(*) from orders union all select 'title_ratings', count(distinct l_orderkey) from l
union all select 'title_crew', count(distinct l_orderkey) from l union all select 'title_principals', count(distinct (l_orderkey, l_linenumber, l_partkey)) from l where exists (select 1 from part where p_partkey = l_partkey)""")
def loader_counts(d: Data) -> DataFrame:
    """All tables written as gzipped dumps, loaded into a store with their parents checked, and counted there."""
    folder = new_folder(d.spark)
    for t, df in dumps(d).items():
        tsv.write_tsv(df, f"{folder}/dumps/{t.replace('_', '.')}.tsv.gz")
    store = Store(d.spark, f"{folder}/store", BUCKETS)
    store.load_all(f"{folder}/dumps", mode="init", orphans="aside")
    return store.counts()


@query("""select 'tt' || l_orderkey as tconst, avg(l_quantity) as "averageRating", (count(*) + case when any_value(o_orderstatus) = 'F' then 1 else 0 end)::int as "numVotes", true as loaded
from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey""")
def loader_refresh(d: Data) -> DataFrame:
    """Ratings after a second dump, which has some of them anew, and a third that is the same file and changes nothing."""
    folder, tables = new_folder(d.spark), dumps(d)
    store = Store(d.spark, f"{folder}/store", BUCKETS)
    finished = d.table("orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("tt"), "o_orderkey").alias("tconst"))
    parts = parts_of(d.table("orders").count())
    again = tables["title_ratings"].repartition(parts, "tconst").join(finished.repartition(parts, "tconst").hint("shuffle_hash"), "tconst", "left_semi").withColumn("numVotes", F.col("numVotes") + 1)
    done = []
    for i, (t, df) in enumerate((("title_basics", tables["title_basics"]), ("title_ratings", tables["title_ratings"]), ("title_ratings", again))):
        tsv.write_tsv(df, f"{folder}/{i}.tsv.gz")
        done.append(store.load(t, f"{folder}/{i}.tsv.gz", orphans="aside"))
    done.append(not store.load("title_ratings", f"{folder}/2.tsv.gz", orphans="aside"))
    return store.read("title_ratings").withColumn("loaded", F.lit(all(done)))


@query("""select 'tt' || o_orderkey as tconst, 'movie' as "titleType", o_orderpriority as "primaryTitle", case o_orderstatus when 'F' then '' when 'O' then o_orderpriority end as "originalTitle",
o_orderkey % 2 = 0 as "isAdult", (1900 + o_orderkey % 100)::int as "startYear", null::int as "endYear", 90 as "runtimeMinutes", null::varchar as genres from orders""")
def dump_round_trip(d: Data) -> DataFrame:
    """A table written as a gzipped dump and read again: empty cells and nulls stay apart."""
    path = new_folder(d.spark)
    tsv.write_tsv(dumps(d)["title_basics"], path)
    return tsv.read_tsv(d.spark, path, "title_basics")


@query("""select 'nconst' || chr(9) || 'primaryName' || chr(9) || 'birthYear' || chr(9) || 'deathYear' || chr(9) || 'primaryProfession' || chr(9) || 'knownForTitles' as first,
(select 'nm' || p_partkey || chr(9) || p_name || chr(9) || p_size || chr(9) || '\\N' || chr(9) || p_type || chr(9) || case when p_size % 2 = 0 then '' else '\\N' end from part order by p_partkey desc limit 1) as last""")
def dump_ends(d: Data) -> DataFrame:
    """The first and the last line of a dump in order of its keys."""
    path = new_folder(d.spark)
    names = dumps(d)["name_basics"].orderBy(F.substring("nconst", 3, 20).cast("long"))
    tsv.write_tsv(names, path)
    return d.spark.createDataFrame([(tsv.first_line(d.spark, path), tsv.last_line(d.spark, path))], "first string, last string")


@query("select (row_number() over (order by p_partkey) - 1) // 300 as page, p_partkey from part")
def cursor_pages(d: Data) -> DataFrame:
    """A sorted result taken page by page."""
    rows = [(k, r["p_partkey"]) for k, page in enumerate(pages(d.table("part").select("p_partkey").orderBy("p_partkey"), 300)) for r in page]
    return d.spark.createDataFrame(rows, "page long, p_partkey long")


@query("select event_id, value, case event_type when 'purchase' then 0 else 1 end as stream from events where event_type in ('purchase', 'click')")
def stream_append(d: Data) -> DataFrame:
    """Two file streams one after the other."""
    source = lambda kind: d.spark.readStream.schema(d.table("events").schema).parquet(f"{d.sf_dir}/events.parque[t]").where(F.col("event_type") == kind).select("event_id", "value")
    return appended([source("purchase"), source("click")], new_folder(d.spark)).withColumnRenamed("_stream", "stream")


_M = DISTANCES.replace("g a join g b", "m a join m b")


@query(_M + " select node, distance from dist")
def fixed_source_refresh(d: Data) -> DataFrame:
    """Distances from part 0 over some of the memberships, and then over all, by what was added."""
    old, new = (d.principals(f"l_returnflag = 'R' and l_linenumber {x}") for x in ("<= 3", "> 3"))
    known = graph.source_distances(old, 0)
    near = graph.laid_out(d.principals())
    nearer = graph.refreshed_distances(known, near, new)
    near.forget()
    return known.join(nearer, "node", "left_anti").unionByName(nearer)


@query(_M + """, asked as (select unnest(['hot ring', 'red plate', 'no such name']) as name), who as (select name, (select p_partkey from part left join (select l_partkey, count(*) as c from lineitem group by 1) on l_partkey = p_partkey where p_name = name and c > 0 order by c desc, 1 limit 1) as k from asked)
select name, coalesce(distance, -1)::int as number from who left join dist on node = k""")
def fixed_source_names(d: Data) -> DataFrame:
    """Degrees of some names from part 0: two look-ups each."""
    names = laid(d.names(), ["nconst"], {"by_name": COPIES["name_basics"]["by_name"]})
    known = laid(graph.source_distances(d.principals(), 0), ["node"])
    asked = ["hot ring", "red plate", "no such name"]
    return d.spark.createDataFrame([(n, graph.known_separation(known, names, n)) for n in asked], "name string, number int")


@query(_M + """, up as (select a.node as parent, b.node from dist a join e on e.x = a.node join dist b on b.node = e.y where b.distance = a.distance + 1),
paths as (select 0::bigint as node, [0::bigint] as path union all select up.node, list_append(path, up.node) from paths join up on up.parent = paths.node where len(path) <= (select coalesce(min(distance), 0) from dist where node = 33))
select array_to_string(list_reverse(path), '>') as path from paths where node = 33 order by list_reverse(path) limit 5""")
def fixed_source_paths(d: Data) -> DataFrame:
    """Paths from part 33 to part 0 by the distances from part 0, without a search."""
    principals = d.principals()
    found = graph.paths_by_distance(graph.source_distances(principals, 0), 33, graph.laid_out(principals), 5)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


_WHO = "{roles}, who as (select name, (select p_partkey from part left join (select l_partkey, count(*) as c from lineitem group by 1) on l_partkey = p_partkey where p_name = name and c > 0 order by c desc, 1 limit 1) as k from (select unnest(['hot ring', 'red plate', 'no such name']) as name))"


@query(_M.replace("{roles}", _WHO).replace("0::bigint as node", "(select k from who where name = 'red plate') as node") + """, up as (select a.node as parent, b.node from dist a join e on e.x = a.node join dist b on b.node = e.y where b.distance = a.distance + 1),
paths as (select (select k from who where name = 'red plate') as node, 0 as d union all select up.node, d + 1 from paths join up on up.parent = paths.node where d < (select distance from dist join who on k = node where name = 'hot ring')),
found as (select name, k, coalesce(distance, -1)::int as number from who left join dist on node = k)
select name, number, case number when -1 then null when 0 then 0 when 1 then (select least(3, count(distinct label)) from m a join m b using (t) join lab using (t) where a.n = found.k and b.n = (select k from who where name = 'red plate'))
else (select least(3, count(*)) from paths where node = found.k) end::int as paths from found""")
def separation_branches(d: Data) -> DataFrame:
    """Degrees and paths between the person of one name and those of three: another, the same, and nobody."""
    names, principals, labels = kept(d.names()), kept(d.principals()), d.labels()
    source = graph.resolve_name(names, "red plate").first()
    rows = []
    for name in ("hot ring", "red plate", "no such name"):
        found = graph.separation_paths(d.spark, principals, names, labels, name, source["nconst"] if source else -1, "red plate")
        rows.append((name, found["number"], None if found["paths"] is None else len(found["paths"])))
    return d.spark.createDataFrame(rows, "name string, number int, paths int")


@query("""with t as (select o_orderkey as k, case when o_orderkey % 3 = 0 then 'tvEpisode' when o_orderkey % 3 = 1 then 'movie' end as kind from orders),
kept as (select k from t where kind is null or kind <> 'tvEpisode'), l as (select distinct l_orderkey as t, l_linenumber as o, l_partkey as n from lineitem where l_orderkey in (select k from kept) and l_partkey in (select p_partkey from part where p_type <> 'PROMO'))
select 'title_basics' as "table", count(*) as n, min('tt' || k) as first from kept union all select 'title_principals', count(*), min('tt' || t || ',' || o || ',nm' || n) from l
union all select 'title_ratings', count(distinct l_orderkey), min('tt' || l_orderkey) from lineitem where l_orderkey in (select k from kept) union all select 'title_crew', count(distinct l_orderkey), min('tt' || l_orderkey) from lineitem where l_orderkey in (select k from kept)
union all select 'name_basics', count(distinct n), min('nm' || n) from l""")
def cleaned_dumps(d: Data) -> DataFrame:
    """Tables cleaned of episodes and then of all rows whose parents went, read from dumps and written to others."""
    tables, folder = dumps(d), new_folder(d.spark)
    k = F.substring("tconst", 3, 20).cast("long") % 3
    tables["title_basics"] = tables["title_basics"].withColumn("titleType", F.when(k == 0, "tvEpisode").when(k == 1, "movie"))
    tables["name_basics"] = tables["name_basics"].where("primaryProfession <> 'PROMO'")
    for t, df in tables.items():
        tsv.write_tsv(df, f"{folder}/{t}")
    out = None
    for t, df in tsv.clean({t: tsv.read_tsv(d.spark, f"{folder}/{t}", t) for t in tables}).items():
        tsv.write_tsv(df, f"{folder}/clean/{t}")
        again = tsv.read_tsv(d.spark, f"{folder}/clean/{t}", t)
        first = {"title_principals": F.concat_ws(",", "tconst", "ordering", "nconst"), "name_basics": F.col("nconst")}.get(t, F.col("tconst"))
        one = again.agg(F.count("*").alias("n"), F.min(first).alias("first")).select(F.lit(t).alias("table"), "n", "first")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select 'tt' || o_orderkey as tconst, o_totalprice as "averageRating", o_custkey::int as "numVotes" from orders where o_orderstatus <> 'P'""")
def quoted_dump(d: Data) -> DataFrame:
    """A quoted dump in which some rows do not fit: they are dropped."""
    path = new_folder(d.spark)
    o = d.table("orders").select(F.concat(F.lit("tt"), "o_orderkey").alias("tconst"), F.when(F.col("o_orderstatus") == "P", "many").otherwise(F.col("o_totalprice").cast("string")).alias("averageRating"), F.col("o_custkey").alias("numVotes"))
    o.write.csv(path, sep="\t", header=True, quoteAll=True)
    return tsv.read_quoted(d.spark, path, "title_ratings")


@query("select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity = 1)")
def key_list_filter(d: Data) -> DataFrame:
    """The rows whose key is in a file of one key a line."""
    path = new_folder(d.spark)
    d.table("lineitem").where("l_quantity = 1").select(F.concat(F.lit(" "), F.col("l_partkey").cast("string"))).write.text(path)
    keys = tsv.read_keys(d.spark, path, "p_partkey").select(F.col("p_partkey").cast("long"))
    return tsv.retain(d.table("part").select("p_partkey", "p_name"), keys)


@query("select sha256(sha256(string_agg(o_orderkey || ':' || o_orderpriority || chr(10), '' order by o_orderkey))) as digest from orders")
def file_hash(d: Data) -> DataFrame:
    """The hash of a file of all orders, and so of the folder that it is alone in."""
    path = new_folder(d.spark)
    d.table("orders").orderBy("o_orderkey").select(F.concat_ws(":", "o_orderkey", "o_orderpriority")).coalesce(1).write.text(path)
    return d.spark.createDataFrame([(sha256_of(d.spark, path),)], "digest string")


@query("""select p_partkey, p_name || '/+%' || p_brand as segment from part""")
def decoded_segments(d: Data) -> DataFrame:
    """Segments of URL paths, decoded: a plus is a plus there."""
    s = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("%20")), F.lit("%2F+%25"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("%23")))
    return d.table("part").select("p_partkey", path_segment(s).alias("segment"))


@query("""with recursive p as (select distinct l_partkey as x, -1 - l_suppkey as y from lineitem where l_returnflag = 'R' and l_quantity >= 45), e as (select x, y from p union select y, x from p),
walk as (select 0::bigint as node, 0 as d union select e.y, d + 1 from walk join e on e.x = node where d < 5) select node, min(d)::int as distance from walk group by node""")
def neighbours_of_ones_own(d: Data) -> DataFrame:
    """Distances in another graph, by a hook that gives pairs: parts and their suppliers, who have negative numbers."""
    p = d.table("lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_partkey").alias("parent"), (-1 - F.col("l_suppkey")).alias("node")).distinct()
    both = kept(p.unionByName(p.select(F.col("node").alias("parent"), F.col("parent").alias("node"))))

    def neighbours(frontier: DataFrame) -> DataFrame:
        return both.join(frontier.select(F.col("node").alias("parent")), "parent", "left_semi")

    return graph.distances(graph.root(d.spark, 0), neighbours, 5)
