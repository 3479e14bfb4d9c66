"""Routes to the end of a network, and strings any number of edits apart."""

import itertools
import random

import pytest

from waymark.operators import matching, similarity
from waymark.plans import oracles, queries

EDGES = "canonical_origin string, canonical_destination string"


def plain(edges, start):
    """Breadth first: of each place the fewest hops and the first way by names."""
    level, seen, n = {start: [start]}, {}, 0
    while level:
        after = {}
        for o, d in edges:
            if o in level and d not in seen:
                after[d] = min(after.get(d, [*level[o], d]), [*level[o], d])
        seen |= {d: (n, way) for d, way in after.items()}
        level, n = after, n + 1
    return seen


def some_edges(seed, n=14, m=26):
    r = random.Random(seed)
    return sorted({(f"p{r.randint(0, n)}", f"p{r.randint(0, n)}") for _ in range(m)})


def test_a_chain_of_changes(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(14)] + [("c05", "c00"), ("c03", "c03")]
    edges = spark.createDataFrame([*chain, (None, "c09"), ("c02", None)], EDGES)
    assert {r.destination: r.transfers for r in matching.match_route(edges, "c00", None).collect()} == {d: n for d, (n, _) in plain(chain, "c00").items()}
    assert [tuple(r) for r in matching.route_between(edges, "c00", "c14").collect()] == [("c14", 13, [f"c{i:02}" for i in range(15)])]
    assert [tuple(r) for r in matching.route_between(edges, "c00", "c00").collect()] == [("c00", 5, [*(f"c{i:02}" for i in range(6)), "c00"])]
    assert [tuple(r) for r in matching.route_between(edges, "c03", "c03").collect()] == [("c03", 0, ["c03", "c03"])]
    assert matching.route_between(edges, "c14", "c00").count() == 0 and matching.route_between(edges, "x", "y").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_networks(spark, seed):
    edges = some_edges(seed)
    df, want = spark.createDataFrame(edges + edges[:5], EDGES), plain(edges, "p0")
    assert {r.destination: (r.transfers, r.places) for r in matching.route_legs(df, "p0", transfers=None).collect()} == want
    for end in ("p3", "p9"):
        got = [(r.transfers, r.places) for r in matching.route_between(df, "p0", end).collect()]
        assert got == ([want[end]] if end in want else [])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_close_pairs(spark, k):
    """Strings of all lengths about the bound where the way of finding them changes, each with some that are edited."""
    r = random.Random(k)
    words = {"", "a", "é😀", "b" * 40}
    for _ in range(60):
        w = "".join(r.choice("abcd") for _ in range(r.randint(0, 4 * k + 6)))
        words.add(w)
        for _ in range(r.randint(0, k + 1)):
            i = r.randint(0, len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :]])
        words.add(w)
    df = spark.createDataFrame([(w,) for w in [*words, *[*words][:9]]] + [(None,)], "s string")
    got = {tuple(x) for x in similarity.close_pairs(df, "s", k).collect()}
    assert got == {(a, b, n) for a, b in itertools.combinations(sorted(words), 2) if (n := distance(a, b)) <= k}


@pytest.mark.parametrize("name", ["route_reach", "route_chain", "route_pair", "route_legs", "route_match", "edit_distance_far", "token_edit_far", "edit_distance_pairs", "token_edit_pairs", "typo_geo_check"])
def test_queries(agree, name):
    agree(queries.QUERIES[name], oracles.ORACLE_SQL[name])
