"""The registered queries and their SQL, side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.functions import text
from cinegraph.operators import graph, ratings, search
from cinegraph.plans import storage  # noqa: F401  its queries are registered, too
from cinegraph.plans.binding import Data
from cinegraph.plans.registry import DISTANCES, ORACLE_SQL, QUERIES, ROLES, query  # noqa: F401
from cinegraph.schemas import duplicate_keys, orphans
from cinegraph.sources.load import upsert
from cinegraph.streaming.refresh import drained

def flat(df: DataFrame) -> DataFrame:
    return df.select("movie.*", "averageRating", "numOfVotes")


def rated(prefix: str, limit: int) -> str:
    return f"""with {{roles}} select {{flat}}, r as "averageRating", votes as "numOfVotes" from titles join ratings using (tconst)
    where genres ilike '{prefix}%' and "titleType" = 'PROMO' and votes > 25 order by r desc, tconst limit {limit}"""


@query(rated("small", 250))
def top_rated_by_genre(d: Data) -> DataFrame:
    return flat(ratings.top_rated(d.titles(), d.ratings(), "small", votes=25, kind="PROMO"))


@query(rated("HOT", 7))
def top_rated_limit(d: Data) -> DataFrame:
    return flat(ratings.top_rated(d.titles(), d.ratings(), "H O T", limit=7, votes=25, kind="PROMO"))


@query("with {roles} select count(*) filter (genres ilike 'ring%') as prefix, count(*) filter (genres ilike '%ring%') as contains from titles")
def genre_prefix_vs_contains(d: Data) -> DataFrame:
    return d.titles().agg(F.count_if(F.col("genres").ilike(text.genre_prefix("r ing"))).alias("prefix"), F.count_if(F.col("genres").ilike("%ring%")).alias("contains"))


@query("""with {roles} select {flat} from titles where ("primaryTitle" ilike 'RED %' or "originalTitle" ilike 'RED %') and "titleType" = 'PROMO' order by tconst limit 1""")
def title_lookup_ilike(d: Data) -> DataFrame:
    return search.find_by_title(d.titles(), "RED %", "RED %", "PROMO")


@query("with {roles} select {flat} from titles where tconst = 7")
def title_lookup_by_id(d: Data) -> DataFrame:
    return search.find_by_id(d.titles(), 7)


@query("""with {roles} select tconst, role, string_agg(s_name, ',' order by n) as people from crew join supplier on s_suppkey = n group by all""")
def cast_by_role(d: Data) -> DataFrame:
    return search.cast_and_crew(d.crew(), d.crew_names()).withColumn("people", F.array_join("people", ","))


@query("""with {roles}, movie as (select tconst, "primaryTitle" from titles where "primaryTitle" ilike 'hot ring' and "titleType" = 'PROMO' order by tconst limit 1)
select movie.tconst as id, "primaryTitle" as title, role, string_agg(s_name, ',' order by n) as people from movie left join crew using (tconst) left join supplier on s_suppkey = n group by all""")
def movie_detail(d: Data) -> DataFrame:
    found = search.movie_detail(d.titles(), d.crew(), d.crew_names(), "hot ring", "PROMO")
    rows = found.select(F.col("movie.movieId").alias("id"), F.col("movie.primaryTitle").alias("title"), F.explode_outer("castAndCrew").alias("c"))
    return rows.select("id", "title", "c.role", F.array_join("c.people", ",").alias("people"))


@query("""with {roles}, movie as (select {flat} from titles where "primaryTitle" ilike 'hot ring' and "titleType" = 'PROMO' order by tconst limit 1),
c as (select role, list(s_name order by n) as people from movie join crew on tconst = "movieId" join supplier on s_suppkey = n group by role)
select to_json({'movie': (select movie from movie), 'castAndCrew': coalesce((select list({'role': role, 'people': people} order by role) from c), [])})::varchar as json""")
def json_detail(d: Data) -> DataFrame:
    return search.as_json(search.movie_detail(d.titles(), d.crew(), d.crew_names(), "hot ring", "PROMO"))


@query("with {roles}, c as (select tconst, role, string_agg(s_name, ',' order by n) as people from crew join supplier on s_suppkey = n group by all) select titles.tconst, role, people from titles left join c using (tconst)")
def detail_assembly(d: Data) -> DataFrame:
    crew = search.cast_and_crew(d.crew(), d.crew_names()).withColumn("people", F.array_join("people", ","))
    return d.titles().select("tconst").join(crew, "tconst", "left")


@query('with {roles} select tconst, "primaryTitle", r, votes from titles join ratings using (tconst)')
def ratings_join(d: Data) -> DataFrame:
    return d.titles().join(d.ratings(), "tconst").select("tconst", "primaryTitle", F.col("averageRating").alias("r"), F.col("numVotes").alias("votes"))


@query("with {roles} select tconst, s_name, role from crew join supplier on s_suppkey = n")
def names_principals_join(d: Data) -> DataFrame:
    return d.crew().join(d.crew_names(), "nconst").select("tconst", F.col("primaryName").alias("s_name"), F.col("category").alias("role"))


def members(d: Data) -> DataFrame:
    return graph.membership(d.principals())


@query("with {roles} select a.n as x, b.n as y, count(*) as titles from m a join m b using (t) group by all")
def principals_self_join(d: Data) -> DataFrame:
    x, y = (members(d).withColumnRenamed("nconst", k) for k in "xy")
    return x.join(y, "tconst").groupBy("x", "y").agg(F.count("*").alias("titles"))


@query("with {roles} select a.n as x, b.n as y, label from m a join m b using (t) join lab using (t)")
def three_way_join(d: Data) -> DataFrame:
    x, y = (members(d).withColumnRenamed("nconst", k) for k in "xy")
    return x.join(y, "tconst").join(d.labels(), "tconst").select("x", "y", "label")


@query("with {roles} select a.n as x, count(distinct b.n) as others from m a join m b on a.t = b.t and a.n <> b.n group by 1")
def inequality_self_join(d: Data) -> DataFrame:
    x, y = (members(d).withColumnRenamed("nconst", k) for k in "xy")
    return x.join(y, "tconst").where("x <> y").groupBy("x").agg(F.countDistinct("y").alias("others"))


_NEAR = "with {roles}, f as (select unnest([%s]) as n), ts as (select distinct t from m where n in (select n from f)) select distinct n as nconst from m where t in (select t from ts) and n not in (select n from f)"


@query(_NEAR % "1, 2, 3, 5, 8, 13")
def costars_bulk(d: Data) -> DataFrame:
    people = graph.ids_from_csv(d.spark, "1,2,3,5,8,13").select(F.col("nconst").cast("long"))
    return graph.costars(members(d), people)


@query(_NEAR % "0")
def costars_single(d: Data) -> DataFrame:
    return graph.costars(members(d), d.spark.range(1).select(F.col("id").alias("nconst")))


@query("with {roles} select distinct n from m where not exists (select 1 from lineitem where l_partkey = n and l_quantity >= 50)")
def anti_join_frontier(d: Data) -> DataFrame:
    frontier = d.principals("l_quantity >= 50").select(F.col("nconst").alias("n")).distinct()
    return members(d).select(F.col("nconst").alias("n")).distinct().join(frontier, "n", "left_anti")


@query("with {roles} select t, n from m where exists (select 1 from orders where o_orderkey = t and o_orderstatus = 'F') and exists (select 1 from part where p_partkey = n and p_type = 'PROMO')")
def semi_join_principals(d: Data) -> DataFrame:
    t = d.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("tconst"))
    n = d.titles().where("titleType = 'PROMO'").select(F.col("tconst").alias("nconst"))
    return members(d).join(t, "tconst", "left_semi").join(n, "nconst", "left_semi").select(F.col("tconst").alias("t"), F.col("nconst").alias("n"))


@query("""with {roles} select tconst, r, votes from ratings where exists (select 1 from titles x where x.tconst = ratings.tconst and x."titleType" = 'PROMO')""")
def semi_join_ratings(d: Data) -> DataFrame:
    t = d.titles().where("titleType = 'PROMO'").select("tconst")
    return d.ratings().join(t, "tconst", "left_semi").select("tconst", F.col("averageRating").alias("r"), F.col("numVotes").alias("votes"))


@query("with {roles} select tconst, n, role from crew where tconst in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def semi_join_crew_like(d: Data) -> DataFrame:
    t = d.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("tconst"))
    return d.crew().join(t, "tconst", "left_semi").select("tconst", F.col("nconst").alias("n"), F.col("category").alias("role"))


@query("with {roles} select p_partkey as n, p_name as name from part where p_partkey in (select n from m)")
def prune_names(d: Data) -> DataFrame:
    p = d.table("part").select(F.col("p_partkey").alias("nconst"), F.col("p_name").alias("name"))
    return p.join(members(d).select("nconst").distinct(), "nconst", "left_semi").select(F.col("nconst").alias("n"), "name")


@query("select p_partkey as nconst from part left join (select l_partkey, count(*) as c from lineitem group by 1) on l_partkey = p_partkey where p_name = 'hot ring' and c > 0 order by c desc, 1 limit 1")
def resolve_name(d: Data) -> DataFrame:
    return graph.resolve_name(d.names(), "hot ring")


@query('select p_partkey as nconst, p_name as "primaryName" from part where p_partkey in (4, 7, 11, 999999)')
def names_by_ids(d: Data) -> DataFrame:
    return graph.names_of(d.names(), graph.ids_from_csv(d.spark, "4,7,11,999999").select(F.col("nconst").cast("long")))


@query('select p_name as "primaryName" from part where p_partkey = 12')
def name_by_id(d: Data) -> DataFrame:
    return d.names().where("nconst = 12").select("primaryName")


@query("with {roles} select distinct label from m a join m b using (t) join lab using (t) where a.n = 0 and b.n = (select min(x.n) from m x join m y using (t) where y.n = 0 and x.n <> 0) order by label limit 10")
def shared_titles(d: Data) -> DataFrame:
    near = graph.costars(members(d), d.spark.range(1).select(F.col("id").alias("nconst"))).agg(F.min("nconst")).first()[0]
    return graph.shared_titles(members(d), d.labels(), 0, near if near is not None else -1)


_R = DISTANCES.replace("g a join g b", "m a join m b")
_Q40 = DISTANCES.replace("{roles}", "{roles}, q as (select distinct l_orderkey as t, l_partkey as n from lineitem where l_quantity >= 40)").replace("g a join g b", "q a join q b")


def from_zero(d: Data, principals: DataFrame) -> DataFrame:
    return graph.source_distances(principals, 0)


@query(_R + " select node, distance from dist")
def distance_all(d: Data) -> DataFrame:
    return from_zero(d, d.principals())


@query(_R + " select distance, count(*) as people from dist group by 1")
def distance_histogram(d: Data) -> DataFrame:
    return from_zero(d, d.principals()).groupBy("distance").agg(F.count("*").alias("people"))


@query(_Q40 + " select distance, count(*) as people from dist group by 1")
def distance_histogram_capped(d: Data) -> DataFrame:
    return from_zero(d, d.principals("l_quantity >= 40")).groupBy("distance").agg(F.count("*").alias("people"))


def pairs(d: Data, targets: list, principals: DataFrame, depth: int = 6) -> DataFrame:
    near = graph.laid_out(principals)
    found = graph.distances_to(d.spark, 0, targets, near, depth)
    near.forget()
    return d.spark.createDataFrame(list(zip(targets, found, strict=True)), "target long, distance int")


_PAIR = " select t::bigint as target, coalesce(distance, -1)::int as distance from unnest([%s]) as x(t) left join dist on node = t"


@query(_R + _PAIR % "17, 33, 199")
def distance_pair(d: Data) -> DataFrame:
    return pairs(d, [17, 33, 199], d.principals())


@query("with {roles} select max(n) as target, 0::int as distance from m")
def distance_same_node(d: Data) -> DataFrame:
    """From the last part of all to itself."""
    last = members(d).agg(F.max("nconst")).first()[0]
    return d.spark.createDataFrame([(last, graph.distance(d.spark, last, last, graph.laid_out(d.principals())))], "target long, distance int")


@query("with {roles} select max(n) + 1 as target, -1::int as distance from m")
def distance_unknown(d: Data) -> DataFrame:
    """To a part that is in no order."""
    return pairs(d, [members(d).agg(F.max("nconst")).first()[0] + 1], d.principals())


@query(_Q40.replace("d < 6", "d < 2") + _PAIR % "17, 33")
def distance_capped(d: Data) -> DataFrame:
    return pairs(d, [17, 33], d.principals("l_quantity >= 40"), 2)


@query(_R + ", p as (select b.node, a.node as parent from dist a join e on e.x = a.node join dist b on b.node = e.y where b.distance = a.distance + 1) select node, count(distinct parent) as parents, min(parent) as first from p group by 1")
def shortest_path_parents(d: Data) -> DataFrame:
    dist = from_zero(d, d.principals())
    near = graph.neighbours_of(members(d))(dist.select("node"))
    a = dist.select(F.col("node").alias("parent"), F.col("distance").alias("before"))
    p = near.join(a, "parent").join(dist, "node").where("distance = before + 1")
    return p.groupBy("node").agg(F.countDistinct("parent").alias("parents"), F.min("parent").alias("first"))


_PATHS = _R + """, up as (select a.node as parent, b.node from dist a join e on e.x = a.node join dist b on b.node = e.y where b.distance = a.distance + 1),
paths as (select 0::bigint as node, [0::bigint] as path union all select up.node, list_append(path, up.node) from paths join up on up.parent = paths.node where len(path) <= (select coalesce(min(distance), 0) from dist where node = 33)),
best as (select path from paths where node = 33 order by path limit 5)"""


def five_paths(d: Data) -> DataFrame:
    return graph.shortest_paths(d.spark, 0, 33, graph.laid_out(d.principals()), limit=5)


@query(_PATHS + " select array_to_string(path, '>') as path from best")
def shortest_paths(d: Data) -> DataFrame:
    return five_paths(d).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(_PATHS + """, steps as (select path, i, path[i] as x, path[i + 1] as y from (select path, unnest(range(1, len(path))) as i from best)),
named as (select path, i, p_name || '/' || (select min(label) from m a join m b using (t) join lab using (t) where a.n = x and b.n = y) as step from steps join part on p_partkey = x)
select array_to_string(path, '>') as path, string_agg(step, ';' order by i) as steps from named group by path""")
def paths_labelled(d: Data) -> DataFrame:
    found = graph.label_paths(five_paths(d), members(d), d.table("part").select(F.col("p_partkey").alias("nconst"), F.col("p_name").alias("primaryName")), d.labels())
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws("/", s["actorName"], s["movieTitle"])), ";")
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), steps.alias("steps"))


@query("""with {roles}, a as (select distinct y.n from m x join m y using (t) where x.n = 0 and y.n <> 0),
far as (select min(y.n) as k from a join m x on x.n = a.n join m y using (t) where y.n <> 0 and y.n not in (select n from a)),
b as (select distinct y.n from m x join m y using (t) where x.n = (select k from far) and y.n <> x.n) select n as node from a where n in (select n from b)""")
def meeting_nodes(d: Data) -> DataFrame:
    """Where the searches from part 0 and from the first part at distance 2 meet."""
    near = graph.laid_out(d.principals())
    far = graph.distances(d.spark.range(1).select(F.col("id").alias("node")), near, 2).where("distance = 2").agg(F.min("node")).first()[0]
    return graph.search(d.spark, 0, far if far is not None else 0, near, 2)[3]


@query("select 'part' as name, count(*) as n from part union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem")
def table_counts(d: Data) -> DataFrame:
    one, two, three = (d.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("part", "orders", "lineitem"))
    return one.unionByName(two).unionByName(three)


def two_sets(d: Data) -> tuple[DataFrame, DataFrame]:
    line = d.table("lineitem")
    return line.where("l_returnflag = 'A'").select("l_partkey"), line.where("l_quantity > 40").select("l_partkey")


for _name, _word, _of in (("set_union", "union", lambda a, b: a.union(b).distinct()), ("set_intersect", "intersect", lambda a, b: a.intersect(b)), ("set_difference", "except", lambda a, b: a.subtract(b))):
    query(f"select l_partkey from lineitem where l_returnflag = 'A' {_word} select l_partkey from lineitem where l_quantity > 40", _name)(lambda d, of=_of: of(*two_sets(d)))


@query("select o_orderkey as k, case when o_orderstatus = 'F' then o_totalprice else o_totalprice + 1 end as price from orders")
def upsert_orders(d: Data) -> DataFrame:
    """Every order: those of status F are only in the base, those of status P only in the load, the others in both."""
    o = d.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("s"))
    return upsert(o.where("s <> 'P'").drop("s"), o.where("s <> 'F'").select("k", (F.col("price") + 1).alias("price")), ["k"])


@query("select l_orderkey, count(*) as n from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P') group by 1")
def orphan_check(d: Data) -> DataFrame:
    parents = d.table("orders").where("o_orderstatus <> 'P'")
    return orphans(d.table("lineitem"), parents, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def dup_key_check(d: Data) -> DataFrame:
    return duplicate_keys(d.table("lineitem"), ["l_orderkey", "l_linenumber"])


def of_parts(sql: str, expr, name: str) -> None:
    query(f"select p_partkey, {sql} as v from part", name)(lambda d: d.table("part").select("p_partkey", expr().alias("v")))


def csv() -> Column:
    return F.concat_ws(",", F.translate("p_name", " ", ","), "p_brand", "p_type")


_CSV = "replace(p_name, ' ', ',') || ',' || p_brand || ',' || p_type"
of_parts("""replace('"' || p_name || '"', '"', '''')""", lambda: text.straight_quotes(F.concat(F.lit('"'), "p_name", F.lit('"'))), "clean_quotes")
of_parts(f"substr({_CSV}, 1, 14)", lambda: text.first_ids(csv(), 4, 3), "truncate_list")
of_parts(f"array_to_string(string_split({_CSV}, ',')[1:3], ',')", lambda: text.first_whole_ids(csv(), 3), "truncate_list_whole")
of_parts(f"(length({_CSV}) - length(replace({_CSV}, ',', '')))::int", lambda: text.comma_count(csv()), "comma_count")
of_parts(r"regexp_replace(p_name, '\s', '', 'g')", lambda: text.no_space(F.col("p_name")), "strip_ws")
of_parts(f"array_to_string(string_split({_CSV}, ','), '|')", lambda: F.array_join(text.items(csv()), "|"), "list_roundtrip")
of_parts("sha256(p_name)", lambda: F.sha2("p_name", 256), "sha256_text")
of_parts("coalesce(nullif(p_type, 'PROMO'), 'Unknown')", lambda: F.coalesce(F.nullif(F.col("p_type"), F.lit("PROMO")), F.lit("Unknown")), "null_default")
of_parts("greatest(1, least(10, coalesce(case when p_type = 'PROMO' then null else p_size - 5 end, 3)))", lambda: graph.clamped(F.when(F.col("p_type") != "PROMO", F.col("p_size") - 5)), "clamp_limit")
of_parts("case p_size % 4 when 0 then null when 1 then '' else p_name end", lambda: F.when(F.col("p_size") % 4 == 1, "").when(F.col("p_size") % 4 > 1, F.col("p_name")), "option_values")


@query("select min(l_orderkey) as k from lineitem where l_partkey = 5")
def top1_unordered_fixed(d: Data) -> DataFrame:
    return d.table("lineitem").where("l_partkey = 5").agg(F.min("l_orderkey").alias("k"))


@query("select event_id, value * 2 as v from events where event_type = 'purchase' order by event_id limit 40")
def stream_map_filter_take(d: Data) -> DataFrame:
    """A file stream, filtered and mapped; 40 of its rows are taken once it has ended."""
    # As a pattern, the path may be that of a folder or of a single file, which a file stream does not take by name.
    events = d.spark.readStream.schema(d.table("events").schema).parquet(f"{d.sf_dir}/events.parque[t]")
    rows = drained(events.where("event_type = 'purchase'").select("event_id", (F.col("value") * 2).alias("v")), graph.new_folder(d.spark))
    return rows.orderBy("event_id").limit(40)


def nulled(d: Data) -> DataFrame:
    return d.table("part").select("p_partkey", F.nullif(F.col("p_type"), F.lit("PROMO")).alias("t"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")).alias("s"))


@query("select p_partkey from part where nullif(p_type, 'PROMO') is not null and case when p_size % 2 = 0 then '' else p_name end <> ''")
def pred_null_and_empty(d: Data) -> DataFrame:
    return nulled(d).where("t is not null and s <> ''").select("p_partkey")


@query("select p_partkey from part where p_type in ('SMALL', 'LARGE')")
def pred_in_list(d: Data) -> DataFrame:
    return d.table("part").where(F.col("p_type").isin("SMALL", "LARGE")).select("p_partkey")


@query("select l_orderkey, l_partkey from lineitem where l_orderkey <> l_partkey and l_quantity = 1")
def pred_col_ne_col(d: Data) -> DataFrame:
    return d.table("lineitem").where("l_orderkey <> l_partkey and l_quantity = 1").select("l_orderkey", "l_partkey")


@query("select p_partkey from part where (p_name ilike '%red%' or p_brand = 'Brand#2') and p_size > 10")
def pred_conj_disj(d: Data) -> DataFrame:
    return d.table("part").where((F.col("p_name").ilike("%red%") | (F.col("p_brand") == "Brand#2")) & (F.col("p_size") > 10)).select("p_partkey")


@query("select o_orderkey, o_orderpriority from orders where o_orderkey = 42")
def point_lookup_pushdown(d: Data) -> DataFrame:
    return d.table("orders").where("o_orderkey = 42").select("o_orderkey", "o_orderpriority")


@query("select p_partkey, p_name from part where p_name ilike 'hot%' order by length(p_name) - length(replace(p_name, 'o', '')) desc, p_partkey limit 20")
def param_binding(d: Data) -> DataFrame:
    return d.spark.sql("select p_partkey, p_name from {t} where p_name ilike :p order by length(p_name) - length(replace(p_name, 'o', '')) desc, p_partkey limit 20", args={"p": "hot%"}, t=d.table("part"))


@query("select k, v, p_name from (values (1, 'a'), (2, 'b'), (-1, 'c')) as t(k, v) join part on p_partkey = k")
def values_source(d: Data) -> DataFrame:
    return d.spark.sql("select k, v, p_name from values (1, 'a'), (2, 'b'), (-1, 'c') as t(k, v) join {p} on p_partkey = k", p=d.table("part"))


@query("with i as (select distinct l_partkey as k from lineitem where l_quantity > 49) select k from i order by k")
def cte_source(d: Data) -> DataFrame:
    return d.spark.sql("with i as (select distinct l_partkey as k from {t} where l_quantity > 49) select k from i order by k", t=d.table("lineitem"))


@query("select coalesce((select count(*) from orders where o_orderstatus = 'X'), 0) as none, coalesce((select count(*) from orders), 0) as n")
def scalar_subquery_count(d: Data) -> DataFrame:
    return d.spark.sql("select coalesce((select count(*) from {t} where o_orderstatus = 'X'), 0) as none, coalesce((select count(*) from {t}), 0) as n", t=d.table("orders"))


@query(_R.replace("d < 6", "d < 2") + " select distinct node from dist")
def level_union_fold(d: Data) -> DataFrame:
    """Who is within two levels of part 0: levels are added to the set of those seen."""
    near = graph.laid_out(d.principals())
    return graph.distances(d.spark.range(1).select(F.col("id").alias("node")), near, 2).select("node")


@query("select coalesce(min(a.l_linenumber + b.l_linenumber), -1)::int as total from lineitem a join lineitem b on a.l_partkey = b.l_partkey where a.l_returnflag = 'A' and b.l_returnflag = 'R'")
def depth_sum_min(d: Data) -> DataFrame:
    a, b = (d.table("lineitem").where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.min("l_linenumber").alias(k)) for f, k in (("A", "a"), ("R", "b")))
    return a.join(b, "l_partkey").agg(F.coalesce(F.min(F.col("a") + F.col("b")), F.lit(-1)).alias("total"))


@query("with {roles}, k as (select n, t, row_number() over (partition by n order by t) as r from m) select n, t, lead(t) over (partition by n order by t) as next from k where r <= 3")
def per_key_top_and_pairs(d: Data) -> DataFrame:
    by = Window.partitionBy("n").orderBy("t")
    m = members(d).select(F.col("nconst").alias("n"), F.col("tconst").alias("t")).withColumn("r", F.row_number().over(by)).where("r <= 3")
    return m.select("n", "t", F.lead("t").over(by).alias("next"))
