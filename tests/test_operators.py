import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, labels
from waymark.operators import cleaning, integrity, matching, places, similarity
from waymark.plans import queries

ROUTES = "feature_ord long, ORGN string, DSTN string, pts array<array<double>>"


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([("ELMTN", "ELMTON")], "alias string, target string"), spark.createDataFrame([("OAKHILL", "OAK HILL")], "key string, display string")


@pytest.fixture(scope="module")
def routes(spark):
    rows = [
        (0, "ELMTON", "OAKHILL", [[18.0, -34.0], [18.1, -34.1]]),
        (1, "Elm ton", "OAK-HILL", [[18.0, -34.0], [18.2, -34.0]]),
        (2, "ELMTN", "ELMTON", [[18.5, -34.0], [18.0, -34.0]]),
        (3, "ELMTON (VIA N1)", "PINE", [[18.0, -34.0]]),
        (4, " ", "PINE", []),
        (5, "PINE", "PINE", [[18.3, -34.3], [18.3, -34.3]]),
    ]
    return spark.createDataFrame(rows, ROUTES)


def test_normalise_is_idempotent_and_keeps_rows(routes, rules):
    once = places.normalise_places(routes, *rules)
    assert once.orderBy("feature_ord").drop("pts").collect() == places.normalise_places(once, *rules).orderBy("feature_ord").drop("pts").collect()
    got = {r.feature_ord: (r.canonical_origin, r.canonical_destination, r.via_origin) for r in once.collect()}
    assert got[0] == ("ELMTON", "OAK HILL", None) and got[1][0] == "ELMTON" and got[2][0] == "ELMTON" and got[3] == ("ELMTON", "PINE", "N1") and got[4] == (None, "PINE", None)


def test_merge_report_measures_from_the_most_used_label(routes, rules):
    rows = {(r.canonical, r.name): r for r in places.merge_report(routes, *rules).collect()}
    base = rows["ELMTON", "ELMTON"]
    assert base.dist_m == 0 and base.review and not rows["OAK HILL", "OAKHILL"].review == (rows["OAK HILL", "OAKHILL"].spread_m <= 1000)
    assert rows["ELMTON", "ELMTON (VIA N1)"].dist_m is None  # one point only: counted, not placed
    assert rows["ELMTON", "ELMTN"].dist_m == pytest.approx(rows["ELMTON", "ELMTN"].spread_m)


def test_order_of_partitions_does_not_matter(routes, rules):
    a = places.merge_report(routes, *rules).orderBy("canonical", "name").collect()
    assert a == places.merge_report(routes.repartition(5, F.rand(3)), *rules).orderBy("canonical", "name").collect()


def test_summary(routes, rules):
    assert tuple(places.summary(routes, *rules).first()) == (8, 3, 1)


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(1000.0,), (1000.1,)], "spread_m double")
    assert [r[0] for r in df.select(places.exceeds("spread_m", 1000.0)).collect()] == [False, True]


def test_haversine(spark):
    a, b = (18.4, -33.9), (18.9, -34.1)
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    df = spark.createDataFrame([(*a, *b)], "a double, b double, c double, d double")
    far = df.select(geo.haversine(*map(F.col, "abcd")), geo.haversine(*map(F.col, "cdab")), geo.haversine(F.col("a"), F.col("b"), F.lit(None).cast("double"), F.col("d"))).first()
    assert far[0] == pytest.approx(2 * 6371000 * math.asin(math.sqrt(h))) and far[0] == pytest.approx(far[1]) and far[2] is None


def test_clean_routes(spark):
    df = spark.createDataFrame([(0, "A", "B", [[1.12345678, 2.0], [3.0, 4.0]]), (1, "A", "B", [[1.12345678, 2.0], [3.0, 4.0]]), (2, "A", "B", [[9.0, 2.0], [3.0, 4.0]]), (3, " ", "B", []), (4, "C", "C", [[1.0, 1.0]])], ROUTES)
    got = {r.feature_ord: r for r in cleaning.clean_routes(df).collect()}
    assert set(got) == {0, 2, 4} and got[0].pts[0][0] == 1.123457 and got[4].is_loop


def test_columns_that_data_decide(spark):
    df = spark.createDataFrame([("1", "1", " ", None), ("2", "2", "", None)], "stop_id string, stop_code string, d string, e string")
    assert cleaning.drop_blank_columns(df).columns == ["stop_id", "stop_code"]
    assert cleaning.drop_redundant_columns(df, [("stop_code", "stop_id"), ("d", "stop_id")]).columns == ["stop_id", "d", "e"]


def test_corrections_are_one_hop(spark):
    table = spark.createDataFrame([("a", "b"), ("b", "c")], "was string, now string")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r.x for r in cleaning.apply_corrections(df, "x", table).collect()].count("b") == 1


def test_service_dates(spark):
    import datetime

    df = spark.sql("select 'w' as service_id, 0 as sunday, 0 as monday, 0 as tuesday, 1 as wednesday, 0 as thursday, 1 as friday, 0 as saturday, date '2020-05-01' as start_date, date '2020-08-31' as end_date")
    days = [datetime.date(2020, 5, 1) + datetime.timedelta(i) for i in range(123)]
    assert {r.date for r in integrity.service_dates(df).collect()} == {d for d in days if d.weekday() in (2, 4)}


def test_close_pairs_are_all_pairs(spark):
    import itertools
    import random

    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(70)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words], "w string")
    for k in (1, 2):
        assert {(x.a, x.b, x.distance) for x in similarity.close_pairs(df, "w", k).collect()} == {(a, b, distance(a, b)) for a, b in itertools.combinations(words, 2) if distance(a, b) <= k}


def test_match_route_takes_the_fewest_changes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("a", "a"), (None, "z")], "canonical_origin string, canonical_destination string")
    assert {tuple(r) for r in matching.match_route(edges, "a").collect()} == {("b", 0), ("c", 0), ("a", 0), ("d", 1)}


def test_consecutive_points(spark):
    df = spark.createDataFrame([([],), ([[1.0, 2.0]],), ([[1.0, 2.0], [1.0, 2.0]],), ([[1.0, 2.0], [1.0, 3.0], [1.0, 2.0]],)], "p array<array<double>>")
    assert [r[0] for r in df.select(geo.repeats_point(F.col("p"))).collect()] == [False, False, True, False]


def test_flattened_lines_are_whole(spark, tmp_path):
    n = 1500
    spark.createDataFrame([(7,), (14,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, i, i % 5, 1) for i in range(n)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, "a b", "t", "b") for i in range(5)], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.feature_ord: (r.n_points, r.last_lon) for r in queries.QUERIES["coords_flatten"](spark, str(tmp_path)).collect()}
    assert got == {7: (n, 18 + (n - 1) % 5 / 1000), 14: (0, None)}


def test_title_case_of_a_long_word(spark):
    n = (1 << 20) + 50
    assert spark.range(1).select(labels.title_case(F.repeat(F.lit("aB"), n // 2)).alias("w")).select(F.length("w")).first()[0] == n


def test_route_legs_to_a_place(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("b", "a"), ("e", "f")], "canonical_origin string, canonical_destination string")
    assert [tuple(r) for r in matching.route_legs(edges, "a", "d").collect()] == [("d", 1, ["a", "b", "d"])]
    assert {tuple(r)[:2] for r in matching.route_legs(edges, "a", transfers=3).collect()} == {("b", 0), ("c", 0), ("a", 1), ("d", 1), ("e", 2), ("f", 3)}
    assert matching.route_legs(edges, "a", "f").count() == 0 and matching.route_legs(edges, "x", "a").count() == 0


def test_close_pairs_of_all_short_strings(spark):
    import itertools

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    words = ["".join(w) for n in range(6) for w in itertools.product("ab", repeat=n)] + ["long label of a place", "lang label of place", "long label of a plac", "label of a place long"]
    for k in (1, 2):
        got = {tuple(r) for r in similarity.close_pairs(spark.createDataFrame([(w,) for w in words], "s string"), "s", k).collect()}
        assert got == {(a, b, edits(a, b)) for a in words for b in words if a < b and edits(a, b) <= k}


def test_rules_that_differ(spark):
    table = spark.createDataFrame([("a", "z"), ("a", "b")], "was string, now string")
    assert [r.x for r in cleaning.apply_corrections(spark.createDataFrame([("a",), ("c",)], "x string"), "x", table).orderBy("x").collect()] == ["b", "c"]
