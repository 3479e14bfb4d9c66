"""Places of two feeds linked one to one, against taking the best pair that is left, again and again."""

import random

import pytest

from waymark.operators import matching
from waymark.plans import oracles, queries

R = random.Random(21)
PLACES, PAIRS = "id long, name string, lon double, lat double", "a_id long, b_id long, edits int, dist_m double"


def greedy(rows):
    out, used_a, used_b = set(), set(), set()
    for a, b, e, d in sorted(set(rows), key=lambda r: (r[2], r[3], r[0], r[1])):
        if a not in used_a and b not in used_b:
            out.add((a, b, e, d))
            used_a.add(a)
            used_b.add(b)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_assignment(spark, seed):
    r = random.Random(seed)
    rows = [(r.randint(0, 25), r.randint(0, 25), r.randint(0, 1), float(r.randint(0, 9))) for _ in range(120)]
    rows = [*{(a, b): (a, b, e, d) for a, b, e, d in rows}.values()]
    got = [tuple(x) for x in matching.assign(spark.createDataFrame(rows + rows[:5], PAIRS)).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows)


def test_a_chain_takes_many_rounds(spark):
    rows = [(i, i + j, 0, float(100 - 2 * i - j)) for i in range(12) for j in (0, 1)]
    assert {tuple(x) for x in matching.assign(spark.createDataFrame(rows, PAIRS)).collect()} == greedy(rows)
    assert matching.assign(spark.createDataFrame([], PAIRS)).collect() == []


def test_planted_pairs(spark):
    a = spark.createDataFrame([(1, "Main Rd", 18.5, -34.0), (2, "Main Rd", 18.501, -34.0), (3, "Oak (North)", 179.9999, 1.0), (4, None, 18.5, -34.0), (5, "Far", 18.5, -33.0), (6, "...", 18.5, -34.0), (7, "No place", None, None)], PLACES)
    b = spark.createDataFrame([(11, "MAIN RD.", 18.5009, -34.0), (12, "main-rdd", 18.5001, -34.0), (13, "OAK NORTH", -179.9999, 1.0), (15, "Far", 18.5, -34.0), (16, "!", 18.5, -34.0)], PLACES)
    links = matching.assign(matching.link_candidates(a, b, 300.0, 1))
    assert {(r.a_id, r.b_id) for r in links.collect()} == {(2, 11), (1, 12), (3, 13)}
    both = {(r.source, r.id): r.place for r in matching.unified(a, b, links).collect()}
    assert len(both) == 12 and both["b", "11"] == both["a", "2"] == "a:2" and both["b", "15"] == "b:15" and both["a", "4"] == "a:4"


def test_copies_meet_as_one(spark):
    """Places that agree are told apart again where they are found near, and no table is broadcast by the size of its source, which says nothing of what cubes make of it."""
    one = spark.range(3000).selectExpr("id", "'Main Rd' as name", "18.5D as lon", "-34D as lat")
    other = spark.range(2000).selectExpr("id + 5000 as id", "if(id % 2 = 0, 'main road', 'Main Rd.') as name", "18.5001D as lon", "-34D as lat")
    met = matching.link_candidates(one, other, 300.0, 1, digits=3)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.selectExpr("count(*)", "count(distinct a_id)", "count(distinct b_id)", "max(edits)", "count(distinct dist_m)").first() == (3_000_000, 3000, 1000, 0, 1)
    assert matching.close_places(one, other, 300.0, 1).count() < 1000


@pytest.mark.parametrize("seed", range(2))
def test_linked_is_the_assignment_of_candidates(spark, seed):
    """Copies, ties in a row of places a step apart, both ways round a place, and ids that lie between each other."""
    r = random.Random(seed)
    names = ["Oak", "Oaks", "Oaky", "Elm"]
    feeds = [[(i, r.choice(names), 18 + r.choice((r.randint(0, 3), 40 * r.randint(1, 3))) * 0.001, -34.0) for i in r.sample(range(1000), 260)] + [(5000, None, 18.0, -34.0), (None, "Oak", 18.0, -34.0)] for _ in "ab"]
    a, b = (spark.createDataFrame(f, PLACES) for f in feeds)
    want = greedy([tuple(x) for x in matching.link_candidates(a.where("id is not null"), b.where("id is not null"), 300.0, 1, digits=3).collect()])
    got = [tuple(x) for x in matching.linked(a, b, 300.0, 1, digits=3).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    again = spark.createDataFrame([(1, "Oak", 18.0, -34.0), (1, "Elm", 18.001, -34.0), (2, "Oak", 18.0, -34.0)], PLACES)
    assert {tuple(x)[:2] for x in matching.linked(again, again, 300.0, 0, digits=3).collect()} == {(1, 1), (2, 2)}


def test_rounds_do_not_grow_with_copies(spark, monkeypatch):
    """A place of 200 copies in either feed was linked a pair a round."""
    calls = []
    monkeypatch.setattr(matching, "checkpointed", lambda df, f=matching.checkpointed: calls.append(1) or f(df))
    a = spark.range(200).selectExpr("id", "'Oak' as name", "18D as lon", "-34D as lat")
    b = spark.range(150).selectExpr("id + 7 as id", "if(id % 2 = 0, 'Oaks', 'Oaky') as name", "18.0001D as lon", "-34D as lat")
    assert {(x.a_id, x.b_id) for x in matching.linked(a, b, 300.0, 1).collect()} == {(i, i + 7) for i in range(150)}
    assert len(calls) < 30


@pytest.mark.parametrize("name", ["link_candidates", "linked_places", "common_schema"])
def test_queries(agree, name):
    agree(queries.QUERIES[name], oracles.ORACLE_SQL[name])
