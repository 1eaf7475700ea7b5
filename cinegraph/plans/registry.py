"""Where queries and their SQL are registered."""

from __future__ import annotations

from cinegraph.plans.binding import Data

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Roles of the driver's tables, for the SQL.
ROLES = """titles as (select p_partkey as tconst, p_type as "titleType", p_name as "primaryTitle", p_brand as "originalTitle", p_size as "runtimeMinutes", replace(p_name, ' ', ',') as genres from part),
ratings as (select l_partkey as tconst, avg(l_quantity) as r, count(*)::int as votes from lineitem group by 1),
m as (select distinct l_orderkey as t, l_partkey as n from lineitem where l_returnflag = 'R'),
crew as (select distinct l_orderkey as tconst, l_suppkey as n, l_returnflag as role from lineitem),
lab as (select o_orderkey as t, o_orderpriority || '#' || o_orderkey as label from orders)"""
FLAT = 'tconst as "movieId", "titleType", "primaryTitle", "originalTitle", "runtimeMinutes" as "runtimeInMinutes", genres'


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Data as a query, with the SQL of the same rows; {roles} begins a list of tables."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql.replace("{roles}", ROLES).replace("{flat}", FLAT)
        return f

    return register


#: Distances from part 0 up to depth 6, by recursion with the depth in the row.
DISTANCES = """with recursive {roles}, e as (select distinct a.n as x, b.n as y from g a join g b on a.t = b.t and a.n <> b.n),
walk as (select 0::bigint as node, 0 as d union select e.y, d + 1 from walk join e on e.x = node where d < 6), dist as (select node, min(d)::int as distance from walk group by node)"""
