"""The join, search and upsert queries over whole tables, by hand, with ids far beyond any bound."""

from collections import defaultdict

import pytest

from cinegraph.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    lines = [(k, n, 1, 1, 10.0, "R") for k, ns in {5000: [0, 700], 5001: [700, 900], 5002: [900, 800, 700]}.items() for n in ns] + [(5003, 900, 2, 1, 50.0, "A"), (6000, 7, 3, 1, 1.0, "A")]
    put = lambda rows, kind, name: spark.createDataFrame(rows, kind).write.parquet(f"{sf}/{name}.parquet")
    put(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string", "lineitem")
    put([(k, float(k), "1-URGENT", "FOP"[k % 3]) for k in range(5000, 5013)], "o_orderkey long, o_totalprice double, o_orderpriority string, o_orderstatus string", "orders")
    put([(1, "one"), (2, "two"), (3, "three")], "s_suppkey long, s_name string", "supplier")
    put([(5001, "hot ring", "b", "PROMO", 1), (6000, "x y", "b", "PROMO", 1), (6001, "x y", "b", "PROMO", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int", "part")
    return sf


CASTS = {5000: [0, 700], 5001: [700, 900], 5002: [900, 800, 700]}


def test_whole_tables(spark, tables):
    got = {k: sorted(map(tuple, catalogue.QUERIES[k](spark, tables).collect()), key=str) for k in ("principals_self_join", "three_way_join", "detail_assembly", "shortest_path_parents", "level_union_fold", "anti_join_frontier", "upsert_orders", "names_principals_join")}
    pairs = defaultdict(int)
    for ns in CASTS.values():
        for x in ns:
            for y in ns:
                pairs[x, y] += 1
    assert got["principals_self_join"] == sorted(((*k, c) for k, c in pairs.items()), key=str)
    assert got["three_way_join"] == sorted(((x, y, f"1-URGENT#{t}") for t, ns in CASTS.items() for x in ns for y in ns), key=str)
    assert got["detail_assembly"] == [(5001, "R", "one"), (6000, "A", "three"), (6001, None, None)]
    assert got["shortest_path_parents"] == [(700, 1, 0), (800, 1, 700), (900, 1, 700)]
    assert got["level_union_fold"] == [(0,), (700,), (800,), (900,)]
    assert got["anti_join_frontier"] == [(0,), (700,), (800,)]
    assert got["upsert_orders"] == [(k, k + 1.0 if "FOP"[k % 3] != "F" else float(k)) for k in range(5000, 5013)]
    assert got["names_principals_join"] == [(5000, "one", "R"), (5001, "one", "R"), (5002, "one", "R"), (5003, "two", "A"), (6000, "three", "A")]
