"""Nearby and nearest points anywhere on earth, against all pairs."""

import math
import random

import pytest

from waymark.functions.geo import EARTH_M
from waymark.operators import matching
from waymark.plans import oracles, queries

R = random.Random(12)


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(h, 1.0)))


def around(lon, lat, n, spread=0.3):
    """Places about one, over the date line and a pole if need be."""
    out = []
    for _ in range(n):
        y, x = lat + R.uniform(-spread, spread), lon + R.uniform(-spread, spread) / max(0.02, math.cos(math.radians(lat)))
        if abs(y) > 90:
            y, x = math.copysign(180 - abs(y), y), x + 180
        out.append(((x + 180) % 360 - 180, y))
    return out


def table(spark, places, name):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(10_000, None, 1.0), (10_001, 1.0, None)], f"{name} long, lon double, lat double")


def test_nearby_of_copies_and_full_cubes(spark, monkeypatch):
    """Rows of one place meet as one, and a full cube is dealt to many tasks; ids repeat and are null as they are given."""
    monkeypatch.setattr(matching, "BLOCK", 8)
    a, b = around(18.5, -34, 40, 0.02) * 3 + [(18.5, -34.0)] * 300, around(18.5, -34, 30, 0.02) * 2 + [(18.5, -34.0)] * 200
    asked = table(spark, a, "request_id").unionAll(spark.createDataFrame([(0, 18.5, -34.0), (None, 18.5, -34.0)], "request_id long, lon double, lat double"))
    got = sorted((-1 if r.request_id is None else r.request_id, r.point_id, r.dist_m) for r in matching.nearby(asked, table(spark, b, "point_id"), 1500.0, digits=2).collect())
    want = sorted((i, j, round(metres(p, q), 2)) for i, p in [*enumerate(a), (0, (18.5, -34.0)), (-1, (18.5, -34.0))] for j, q in enumerate(b) if metres(p, q) <= 1500.0)
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 0.011 for g, w in zip(got, want, strict=True))
    met = matching.meetings(matching.together(asked, "request_id", "lon", "lat"), matching.together(table(spark, b, "point_id"), "point_id", "lon", "lat").toDF("plon", "plat", "pids"), 1500.0)
    rows = met.selectExpr("spark_partition_id() as task").groupBy("task").count().collect()
    assert len(rows) > 10 and sum(r[1] for r in rows) < len(want) / 20


@pytest.mark.parametrize(("lon", "lat"), [(0, 0), (18.5, -34), (179.95, 10), (-179.9, 60), (30, 85), (100, 89.9), (0, -90)])
def test_nearby(spark, lon, lat):
    a, b = around(lon, lat, 60), around(lon, lat, 80)
    for radius in (1_000.0, 15_000.0):
        got = {(r.request_id, r.point_id) for r in matching.nearby(table(spark, a, "request_id"), table(spark, b, "point_id"), radius).collect()}
        assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if metres(p, q) <= radius}


def test_nearby_of_half_the_earth(spark):
    a, b = [(0.0, 0.0), (180.0, 0.0)], [(180.0, 0.0), (-180.0, 0.0), (90.0, 0.0), (0.0, 90.0)]
    got = {(r.request_id, r.point_id) for r in matching.nearby(table(spark, a, "request_id"), table(spark, b, "point_id"), 3e7).collect()}
    assert len(got) == 8
    assert {(r.request_id, r.point_id) for r in matching.nearby(table(spark, a, "request_id"), table(spark, b, "point_id"), 1.0).collect()} == {(1, 0), (1, 1)}


@pytest.mark.parametrize(("leaf", "k"), [(1, 1), (4, 3), (16, 7), (64, 500)])
def test_nearest(spark, leaf, k):
    """Dense and sparse places, a third of all points in one place, requests far from all and over the date line."""
    points = around(179.99, 10, 60, 0.01) + around(-179.9, 10, 20, 3) + around(20, 89.5, 20) + [(18.5, -34.0)] * 50
    asked = around(179.99, 10, 10, 0.02) + around(-170, 10, 5, 8) + around(0, 90, 5) + around(18.5, -34, 5) + [(0.0, 0.0), (18.5, -34.0)]
    got = {}
    for r in matching.nearest(table(spark, asked, "request_id"), table(spark, points, "point_id"), k, leaf).collect():
        got.setdefault(r.request_id, []).append((r.nth, r.point_id, r.dist_m))
    assert got.keys() == {*range(len(asked))}
    for i, rows in got.items():
        want = sorted((metres(asked[i], q), j) for j, q in enumerate(points))[:k]
        rows.sort()
        assert [n for n, _, _ in rows] == [*range(1, len(want) + 1)]
        assert all(abs(m - d) < 1e-6 * max(1.0, d) + 2e-2 for (_, _, m), (d, _) in zip(rows, want, strict=True))
        assert sorted(j for _, j, _ in rows)[:1] and len({j for _, j, _ in rows}) == len(rows)


def test_nearest_looks_up_a_place_once(spark, monkeypatch):
    """What is kept of a level is for the places of requests, not for each request, and without the cubes below."""
    kept = []
    monkeypatch.setattr(matching, "checkpointed", lambda df, f=matching.checkpointed: kept.append(f(df)) or kept[-1])
    points = around(18.5, -34, 40, 0.05)
    asked = around(18.5, -34, 3, 0.05) * 300
    got = matching.nearest(table(spark, asked, "request_id"), table(spark, points, "point_id"), 2, 4).collect()
    assert sorted((r.request_id, r.nth) for r in got) == [(i, n) for i in range(900) for n in (1, 2)]
    assert all(points[r.point_id] in sorted(points, key=lambda q: metres(asked[r.request_id], q))[:2] for r in got)
    levels = [df for df in kept if "_r" in df.columns]
    assert len(levels) > 3 and max(df.count() for df in levels) < 200 and not any("below" in df.columns for df in levels)


def test_nearest_of_odd_tables(spark):
    none = table(spark, [], "point_id")
    assert matching.nearest(table(spark, [(1.0, 1.0)], "request_id"), none, 3).collect() == []
    twice = table(spark, [(1.0, 1.0)], "request_id").unionAll(table(spark, [(5.0, 5.0)], "request_id"))
    got = matching.nearest(twice, table(spark, [(1.0, 1.0), (5.0, 5.0)], "point_id"), 1).collect()
    assert sorted((r.request_id, r.point_id) for r in got) == [(0, 0), (0, 1)]


@pytest.mark.parametrize("name", ["nearest_points", "nearby_polar", "nearby_pickups"])
def test_queries(agree, name):
    agree(queries.QUERIES[name], oracles.ORACLE_SQL[name])
