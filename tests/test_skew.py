"""Medians and lookups with a label on a third of all rows: the results of the plain ways, and no task that holds the label."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from waymark.operators import places, skew
from waymark.plans import oracles, queries

R = random.Random(8)


def some_rows(n=6000):
    """A third of them hot, with different values; ties, an even and an odd group, one value, nulls, a group without any."""
    rows = [("hot", R.uniform(-180, 180), R.choice([1.0, 2.0, 3.0])) for _ in range(n // 3)]
    rows += [(f"g{R.randint(0, 40)}", R.choice([0.5, -0.0, 0.0, 7.25, R.random()]), R.random()) for _ in range(n - n // 3)]
    return rows + [("one", 4.0, None), ("two", 4.0, 1.0), ("two", 5.0, 2.0), ("none", None, None), (None, 1.0, 3.0), (None, 2.0, 5.0)]


def test_medians(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    got = {r.g: (r.x, r.y) for r in skew.medians(df, "g", "x", "y").collect()}
    values = {g: [[r[k] for r in rows if r[0] == g and r[k] is not None] for k in (1, 2)] for g in {r[0] for r in rows}}
    assert got == {g: tuple(statistics.median(v) if v else None for v in both) for g, both in values.items() if any(both)}
    plain = {r.g: (r.x, r.y) for r in df.groupBy("g").agg(F.median("x").alias("x"), F.median("y").alias("y")).collect()}
    assert all(got.get(g, (None, None)) == v for g, v in plain.items())


def test_medians_of_odd_tables(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert skew.medians(df, "g", "x").collect() == []
    ints = spark.createDataFrame([(1, 3), (1, 4), (2, None)], "g int, x int")
    assert [tuple(r) for r in skew.medians(ints, "g", "x").collect()] == [(1, 3.5)]


def test_a_hot_group_is_spread(spark):
    """Of 30,000 different values of one group no window holds more than its share of the sort."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(30_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 30_011).cast("double").alias("x"))
        counted = df.select("g", "x").repartitionByRange("g", "x").withColumn("s", F.spark_partition_id())
        assert counted.groupBy("s").count().agg(F.max("count")).first()[0] < 15_000
        assert skew.medians(df, "g", "x").first().x == statistics.median((i * 7919 % 30_011) for i in range(30_000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot", [0, 1, 3, 500])
def test_lookup(spark, monkeypatch, how, hot):
    monkeypatch.setattr(skew, "HOT", hot)
    rows = spark.createDataFrame([(i, R.choice(["hot", "hot", f"k{i % 9}", None, "absent"])) for i in range(400)], "id int, k string")
    table = rows.where("k is not null and k != 'absent'").groupBy("k").agg(F.count("*").alias("n"), F.concat(F.lit("v"), "k").alias("v")).unionByName(spark.createDataFrame([(None, 5, "null")], "k string, n long, v string"))
    got = {r.id: (r.k, r.v) for r in skew.lookup(rows, table, "k", "k", "n", how).collect()}
    want = {r.id: (r.k, f"v{r.k}" if r.k not in (None, "absent") else None) for r in rows.collect()}
    assert got == (want if how == "left" else {i: v for i, v in want.items() if v[1]})


def test_places_with_a_hot_label(spark):
    """A label on a third of all rows gives what the plain definitions give."""
    rows = [(i, "HOT" if i % 3 == 0 else f"Place {i % 17}", f"place {i % 13}", [[R.uniform(18, 19), R.uniform(-35, -34)], [R.uniform(18, 19), R.uniform(-35, -34)]]) for i in range(900)]
    routes = spark.createDataFrame(rows, "feature_ord long, ORGN string, DSTN string, pts array<array<double>>")
    none = spark.createDataFrame([], "alias string, target string"), spark.createDataFrame([], "key string, display string")
    points = {}
    for _, o, d, p in rows:
        points.setdefault(o, []).append(p[0])
        points.setdefault(d, []).append(p[1])
    got = {r.name: (r.lon, r.lat) for r in places.consensus(places.endpoints(routes)).collect()}
    assert got == {k: tuple(statistics.median(x[i] for x in v) for i in (0, 1)) for k, v in points.items()}
    named = {r.feature_ord: (r.canonical_origin, r.canonical_destination) for r in places.normalise_places(routes, *none).collect()}
    assert named == {i: (o.upper(), d.upper()) for i, o, d, _ in rows}
    spread = {r.name: r.median_m for r in places.own_spread(places.endpoints(routes)).collect()}
    assert spread.keys() == points.keys() and all(v > 0 for v in spread.values())
    assert places.label_geometry_mismatch(routes, *none, -1.0).count() == 1800


@pytest.mark.parametrize("name", ["normalise_places", "merge_report", "label_geometry_mismatch", "name_own_spread", "consensus_location"])
def test_queries(agree, name):
    agree(queries.QUERIES[name], oracles.ORACLE_SQL[name])
