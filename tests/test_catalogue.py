"""Every query against its SQL, and its plan's shape where that matters."""

import compare
import pytest

from pyspark.sql import functions as F

from chunkloom.operators import groups, links, ordered
from chunkloom.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, con, name):
    assert compare.differences(catalogue.QUERIES[name](spark, SF), con, catalogue.SQL[name]) == []


def test_entry_counts_all_documents(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert sum(r.n for r in rows) == 200 and [r.step for r in rows] == sorted(r.step for r in rows)


def test_ranges_join_up(spark):
    """Positions, sums, previous values and runs do not depend on how rows fall into partitions."""
    rows = [(k, v) for k, v in zip([0, 1, 2, 5, 6, 9, 20, 21, 22, 40], "aabbbaccca", strict=True)]
    df = spark.createDataFrame(rows, "k long, v string")
    for size in (1, 3, 10, 1 << 20):
        placed = ordered.positions(df, ["k"], "p", size).orderBy("k").collect()
        assert [r.p for r in placed] == list(range(1, 11))
        before = ordered.previous(df, ["k"], "v", "b", size).orderBy("k").collect()
        assert [r.b for r in before] == [None, *[v for _, v in rows[:-1]]]
        runs = ordered.runs(df, ["k"], "v", size).orderBy("first").collect()
        assert [(r["first"], r.n, r.v) for r in runs] == [(1, 2, "a"), (3, 3, "b"), (6, 1, "a"), (7, 3, "c"), (10, 1, "a")]
        found = ordered.islands(df, "k", size).orderBy("s").collect()
        assert [(r.s, r.e, r.n) for r in found] == [(0, 2, 3), (5, 6, 2), (9, 9, 1), (20, 22, 3), (40, 40, 1)]


def test_a_hot_key_and_sparse_keys_are_split(spark):
    """Two thirds of the rows have one key, the others keys far apart; no task has many of them."""
    df = spark.range(9000).selectExpr("if(id % 3 < 2, 7, (id << 40) - 4611686018427387904) as k", "id as v")
    own = ordered.Ordered(df, ["k"], 1000)
    sizes = [r["count"] for r in own.rows.groupBy("__part").count().collect()]
    assert max(sizes) < 3000 and sum(sizes) == 9000
    out = own.positions("p").running_sum(F.lit(2), "s").table().orderBy("p").collect()
    assert [(r.p, r.s) for r in out] == [(i + 1, 2 * i) for i in range(9000)]
    assert [r.k for r in out] == sorted(r.k for r in out)


def test_next_of_a_hot_key_is_linear(spark):
    """A window that looks ahead from each row would take minutes here."""
    df = spark.range(200_000).selectExpr("1 as u", "id", "id % 1000 = 5 as hit")
    got = df.select("id", links.next_of(df, "u", "id", F.col("hit")).alias("nxt"))
    assert got.agg(F.sum("nxt"), F.count("nxt")).first()[:] == (sum(1000 * ((i + 995) // 1000) + 5 for i in range(199_005)), 199_005)


def test_checksum_of_many_large_words(spark):
    df = spark.range(100_000).selectExpr("id % 2 as f", "4294967295 - id as w")
    got = {r.f: r.s for r in groups.checksum32(df, "f", F.col("w")).collect()}
    assert got == {f: sum(4294967295 - i for i in range(f, 100_000, 2)) % 2**32 for f in (0, 1)}


def test_descend_follows_edges(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "parent int, child int")
    start = spark.createDataFrame([(1, 1), (9, 9)], "root int, node int")
    got = sorted(tuple(r) for r in links.descend(start, edges, 2).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 4, 2), (9, 9, 0)]


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["padded_name"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in plan
    plan = catalogue.QUERIES["if_empty_else"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_discount,0.09)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_discount:double>" in plan
