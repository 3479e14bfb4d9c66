"""Route matching, fares and pickups. Their semantics are this library's own."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_M, haversine
from waymark.functions.labels import canonical_key
from waymark.operators.skew import lookup, ranked
from waymark.shared import checkpointed

def hops_of(edges: DataFrame) -> DataFrame:
    """(o, d): the different edges (canonical_origin, canonical_destination) between known places."""
    known = edges.select(F.col("canonical_origin").alias("o"), F.col("canonical_destination").alias("d"))
    return checkpointed(known.where("o is not null and d is not null").distinct())


def step(front: DataFrame, hops: DataFrame, seen: DataFrame, back: bool = False) -> DataFrame:
    """(place, places) of the places that one hop from the front reaches, or if back that reach it, and that weren't seen: each with the first of its ways by names."""
    here, there = ("d", "o") if back else ("o", "d")
    way = F.concat(F.array("o"), "places") if back else F.concat("places", F.array("d"))
    ways = front.join(hops, F.col("place") == F.col(here)).select(F.col(there).alias("place"), way.alias("places"))
    return checkpointed(ways.groupBy("place").agg(F.min("places").alias("places")).join(seen.select("place"), "place", "left_anti"))


#: Hops after which what was seen becomes one table again.
ROUNDS = 8


def route_legs(edges: DataFrame, start: str, end: str | None = None, transfers: int | None = 2) -> DataFrame:
    """(destination, transfers, places): for each place, or only `end`, the fewest changes with which it is reached from `start`, up to `transfers` or if that is None
    however many it takes, and the places of the way from start to destination: of ways with as few changes the first by names.

    edges: (canonical_origin, canonical_destination). Each hop is a job: one join of the places that the last hop reached first with the distinct edges, less those seen
    before. It ends when nothing new is reached, and with `end` when that is; for one pair of far places route_between does less.
    """
    hops = hops_of(edges)
    front = checkpointed(hops.where(F.col("o") == start).select(F.col("d").alias("place"), F.array("o", "d").alias("places")))
    seen, n = front.withColumn("transfers", F.lit(0)), 0
    while transfers is None or n < transfers:
        if not front.limit(1).count() or end is not None and front.where(F.col("place") == end).limit(1).count():
            break
        n += 1
        front = step(front, hops, seen)
        seen = seen.unionByName(front.withColumn("transfers", F.lit(n)))
        if n % ROUNDS == 0:
            seen = checkpointed(seen)
    found = seen if end is None else seen.where(F.col("place") == end)
    return found.select(F.col("place").alias("destination"), "transfers", "places")


def route_between(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(destination, transfers, places): the way from start to end with the fewest changes, however many, of several the first by names; no row if there is none.

    The search goes from both ends, each time a hop from the side whose front is smaller, until the fronts meet, so of a large network it sees two balls of half the
    way's radius. A way has a hop at least: from a place to itself it leads around, or along a loop.
    """
    hops = hops_of(edges)
    ahead = checkpointed(hops.where(F.col("o") == start).select(F.col("d").alias("place"), F.array("o", "d").alias("places")))
    behind = checkpointed(hops.sparkSession.createDataFrame([(end, [end])], "place string, places array<string>"))
    seen, n = [ahead, behind], 1
    while (sizes := [f.count() for f in (ahead, behind)]) and all(sizes):
        # levels are whole, so the first meeting is on shortest ways, and each of these passes it at this very level
        met = ahead.join(behind.toDF("place", "rest"), "place").agg(F.min(F.struct("places", "rest")).alias("m")).first().m
        if met is not None:
            return hops.sparkSession.createDataFrame([(end, n - 1, [*met.places, *met.rest[1:]])], "destination string, transfers int, places array<string>")
        n += 1
        side = int(sizes[1] < sizes[0])
        front = step(behind if side else ahead, hops, seen[side], bool(side))
        ahead, behind = (ahead, front) if side else (front, behind)
        seen[side] = seen[side].unionByName(front)
        if n % ROUNDS == 0:
            seen = [checkpointed(s) for s in seen]
    return hops.sparkSession.createDataFrame([], "destination string, transfers int, places array<string>")


def match_route(edges: DataFrame, start: str, transfers: int | None = 2) -> DataFrame:
    """(destination, transfers): the fewest changes with which each place is reached from `start`, up to `transfers`, or all that it takes if that is None."""
    return route_legs(edges, start, transfers=transfers).select("destination", "transfers")


def fare_consensus(reports: DataFrame) -> DataFrame:
    """(route_id, n_reports, n_confirmed, latest, typical): reports are (route_id, fare, confirmed, ts, report_id); the latest by time, then by id."""
    return reports.groupBy("route_id").agg(
        F.count("*").alias("n_reports"), F.count_if("confirmed").alias("n_confirmed"), F.max_by("fare", F.struct("ts", "report_id")).alias("latest"), F.median("fare").alias("typical")
    )


def on_sphere(lon: Column, lat: Column) -> list[Column]:
    """x, y and z of a place on the unit sphere: near places are near there at any latitude and over the date line."""
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def chord(metres: float) -> float:
    """How far apart two places so many metres apart are in space, on the unit sphere."""
    return 2 * math.sin(min(metres / (2 * EARTH_M), math.pi / 2))


#: Rows that agree stand together in rows of so many ids at most; a task of a cube meets so many ids of either side, about.
TOGETHER, BLOCK = 128, 4096
CUBE = ["x", "y", "z"]


def together(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """(by, ids): the keys of the rows that agree in the columns `by`, in order, TOGETHER a row at most. A sort over the cluster brings them together, so no task gets all of a group."""
    placed = rows.select(*by, F.col(key).alias("_id")).repartitionByRange(*by, "_id").sortWithinPartitions(*by, "_id")
    block = F.shiftright(F.monotonically_increasing_id(), TOGETHER.bit_length() - 1)
    found = placed.withColumn("_block", block).groupBy(*by, "_block").agg(F.collect_list("_id").alias("_ids"), F.count("*").alias("_n"))
    nulls = F.array_repeat(F.lit(None).cast(rows.schema[key].dataType), (F.col("_n") - F.size("_ids")).cast("int"))
    return checkpointed(found.select(*by, F.concat(nulls, "_ids").alias("ids")))


def meetings(asked: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """asked with the points within the radius, and dist_m. asked has lon, lat and ids, points plon, plat and pids, both may have more; both are read several times.

    A grid in space of cubes at least a radius wide: a point goes into its cube and those around it, a request into its own, and they meet in an equi-join. A cube with over BLOCK ids of a side is
    cut into blocks on that side, each block of one side meets each of the other, and blocks are dealt to tasks on their own. Sizes of files say little of these tables, so none is broadcast.
    """
    wide = max(chord(radius_m) * (1 + 1e-9) + 1e-12, 1e-7)
    cube = lambda c: F.floor(c / F.lit(wide)).cast("long")
    around = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(o, "ijk", strict=True)]) for o in itertools.product((-1, 0, 1), repeat=3)])
    at = lambda lon, lat: {n: cube(c) for c, n in zip(on_sphere(F.col(lon), F.col(lat)), CUBE, strict=True)}
    placed = points.where("plon is not null and plat is not null").withColumns(at("plon", "plat")).withColumn("o", F.explode(around))
    spread = placed.withColumns({n: F.col(n) + F.col(f"o.{d}") for n, d in zip(CUBE, "ijk", strict=True)}).drop("o")
    asked = asked.where("lon is not null and lat is not null").withColumns(at("lon", "lat"))
    many = [t.groupBy(*CUBE).agg(F.ceil(F.sum(F.size(c)) / BLOCK).cast("int").alias(n)) for t, c, n in ((asked, "ids", "_p"), (spread, "pids", "_q"))]
    both = many[0].join(many[1].hint("merge"), CUBE).where("_p > 1 or _q > 1")
    full = checkpointed(both.select(F.struct(*CUBE).alias("cube"), "_p", "_q", (F.col("_p").cast("long") * F.col("_q")).alias("used")))
    keys, blocks = CUBE, full.agg(F.sum("used")).first()[0]
    if blocks:
        cut = lambda t: lookup(t.withColumn("_at", F.struct(*CUBE)), full, "_at", "cube", "used").drop("_at")
        own = lambda n, *c: F.pmod(F.xxhash64(*c), F.coalesce(n, F.lit(1))).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, 1000))
        keys = [*CUBE, "_i", "_j"]
        asked = cut(asked).withColumn("_i", own(F.col("_p"), "lon", "lat", "ids")).withColumn("_j", each(F.col("_q"))).drop("_p", "_q").repartition(tasks, *keys)
        spread = cut(spread).withColumn("_j", own(F.col("_q"), "plon", "plat", "pids")).withColumn("_i", each(F.col("_p"))).drop("_p", "_q").repartition(tasks, *keys)
    met = asked.join(spread.hint("merge"), keys).withColumn("dist_m", haversine(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat")))
    return met.where(F.col("dist_m") <= radius_m).drop(*keys)


def nearby(requests: DataFrame, points: DataFrame, radius_m: float, digits: int | None = None) -> DataFrame:
    """(request_id, point_id, dist_m) of the pairs within the radius, anywhere on earth; both sides have an id, lon and lat. Places without either are near nothing. dist_m is rounded to so many digits, if any.

    Rows in one place stand together and meet as one; only what is near is told apart again, in the task that finds it.
    """
    known = "lon is not null and lat is not null"
    asked = together(requests.where(known), "request_id", "lon", "lat")
    placed = together(points.where(known), "point_id", "lon", "lat").toDF("plon", "plat", "pids")
    met = meetings(asked, placed, radius_m)
    far = F.col("dist_m") if digits is None else F.round("dist_m", digits)
    return met.select("ids", "pids", far.alias("dist_m")).select(F.explode("ids").alias("request_id"), "pids", "dist_m").select("request_id", F.explode("pids").alias("point_id"), "dist_m")


#: Places of a cube that isn't split, and how often cubes are split at most: the last are twelve metres wide.
LEAF, DEPTH = 64, 20
SPACE = ("x", "y", "z")


def cube(level: Column, depth: int) -> Column:
    """The cube of a level in which the finest cube (fx, fy, fz) lies; that of level 0 holds the earth, and each is halved three ways."""
    return F.struct(level.cast("int").alias("level"), *[F.floor(F.col(f"f{c}") / F.pow(F.lit(2.0), F.lit(depth) - level)).cast("long").alias(c) for c in SPACE])


def cube_tree(places: DataFrame, leaf: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(cubes, leaves) of places with fx, fy, fz. cubes: of every cube with over `leaf` places, but for the finest, the cubes that it is split into, `below`, with their places n. leaves: places with `cube`, the one that
    holds them and isn't split. Places are counted in the finest cubes first, so nothing is dealt by a large cube before it is small in rows."""
    fine = [f"f{c}" for c in SPACE]
    finest = checkpointed(places.groupBy(*fine).agg(F.count("*").alias("n")))
    every = finest.select(*fine, "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).withColumn("cube", cube(F.col("level"), depth))
    counts = every.groupBy("cube").agg(F.sum("n").alias("n"), F.first("level").alias("level"), *[F.min(c).alias(c) for c in fine])
    up = counts.where("level > 0").withColumn("parent", cube(F.col("level") - 1, depth))
    cubes = checkpointed(up.groupBy("parent").agg(F.collect_list(F.struct("cube", "n")).alias("below"), F.sum("n").alias("n")).where(F.col("n") > leaf).select(F.col("parent").alias("cube"), "below"))
    at = every.join(cubes.select("cube").hint("merge"), "cube", "left_semi").groupBy(*fine).agg(F.count("*").alias("level"))  # cubes above a split one are split
    deep = finest.join(at.hint("merge"), fine, "left").select(*fine, "n", F.coalesce("level", F.lit(0)).alias("level"))
    found = places.join(deep.drop("n").hint("merge"), fine)
    return cubes, found.withColumn("cube", cube(F.col("level"), depth)).drop("level", *fine)


def reach(name: str, far: bool) -> Column:
    """From x, y, z to the nearest or the farthest place of a cube, in space."""
    at = F.col(name)
    size = F.lit(2.0) / F.pow(F.lit(2.0), at["level"])
    low = {c: at[c] * size - 1 for c in SPACE}
    if far:
        off = [F.greatest(F.abs(F.col(c) - low[c]), F.abs(F.col(c) - low[c] - size)) for c in SPACE]
    else:
        off = [F.greatest(low[c] - F.col(c), F.col(c) - low[c] - size, F.lit(0.0)) for c in SPACE]
    return F.sqrt(sum(o * o for o in off))


def nearest(requests: DataFrame, points: DataFrame, k: int, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(request_id, nth, point_id, dist_m): the k points nearest to each request, anywhere on earth, of equal distances the first by id; all if there are fewer. Rows without a place are left out.

    Requests in one place are looked up as one. Points lie in a tree of cubes whose full ones are split. All places of requests go down it together, a level a job: of the cubes that a request looks at, those further than a radius within which others hold k places are
    left, so it comes to a few leaves however dense the points are, here or nearby. Of points in one place k are taken, as no request needs more. Cubes that many requests look at are looked up, not dealt to one task.
    """
    known = points.where("lon is not null and lat is not null").withColumn("_n", F.row_number().over(Window.partitionBy("lon", "lat").orderBy("point_id"))).where(F.col("_n") <= k).drop("_n")
    placed = known.select("point_id", "lon", "lat", *[v.alias(c) for c, v in zip(SPACE, on_sphere(F.col("lon"), F.col("lat")), strict=True)])
    most = (1 << depth) - 1
    placed = checkpointed(placed.withColumns({f"f{c}": F.greatest(F.least(F.floor((F.col(c) + 1) / 2 * (1 << depth)), F.lit(most)), F.lit(0)).cast("long") for c in SPACE}))
    cubes, leaves = cube_tree(placed, leaf, depth)
    held = checkpointed(leaves.groupBy("cube").agg(F.collect_list(F.struct("point_id", "lon", "lat")).alias("points")))
    rows = together(requests.where("lon is not null and lat is not null"), "request_id", "lon", "lat")
    asked = rows.select("lon", "lat").distinct().select("lon", "lat", *[v.alias(c) for c, v in zip(SPACE, on_sphere(F.col("lon"), F.col("lat")), strict=True)], F.monotonically_increasing_id().alias("_r"))
    asked = checkpointed(asked)
    total = placed.count()
    front = checkpointed(asked.select("_r", *SPACE, F.struct(F.lit(0).alias("level"), *[F.lit(0).cast("long").alias(c) for c in SPACE]).alias("at"), F.lit(total).cast("long").alias("n")))
    for _ in range(depth):
        front = looked_up(front, cubes, "below")
        whole = F.array(F.struct(F.col("at").alias("cube"), "n"))
        front = front.select("_r", *SPACE, F.col("below").isNotNull().alias("_open"), F.explode(F.coalesce("below", whole)).alias("e")).select("_r", *SPACE, "_open", F.col("e.cube").alias("at"), F.col("e.n").alias("n"))
        front = front.withColumns({"_near": reach("at", False), "_far": reach("at", True)})
        enough = F.sum("n").over(Window.partitionBy("_r").orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)) >= k
        front = front.withColumn("_enough", F.when(enough, F.col("_far"))).withColumn("_radius", F.min("_enough").over(Window.partitionBy("_r")))
        front = checkpointed(front.where(F.col("_radius").isNull() | (F.col("_near") <= F.col("_radius") * (1 + 1e-9) + 1e-9)).select("_r", *SPACE, "_open", "at", "n"))
        more = front.where("_open").limit(1).count()
        front = front.drop("_open")
        if not more:
            break
    met = looked_up(front.select("_r", "at"), held, "points").where("points is not null").select("_r", F.explode("points").alias("p"))
    far = asked.select("_r", "lon", "lat").join(met.hint("merge"), "_r").select("_r", "lon", "lat", "p.point_id", haversine(F.col("lon"), F.col("lat"), F.col("p.lon"), F.col("p.lat")).alias("dist_m"))
    nth = F.row_number().over(Window.partitionBy("_r").orderBy("dist_m", "point_id"))
    best = far.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("lon", "lat").agg(F.collect_list(F.struct("nth", "point_id", "dist_m")).alias("best"))
    found = rows.join(best.hint("merge"), ["lon", "lat"]).select(F.explode("ids").alias("request_id"), "best").select("request_id", F.explode("best").alias("p"))
    return found.select("request_id", "p.nth", "p.point_id", "p.dist_m")


def looked_up(front: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """front, a checkpointed table, with a column of table by cube, null where there is none."""
    used = front.groupBy(F.col("at").alias("cube")).agg(F.count("*").alias("used"))
    return lookup(front, checkpointed(table.join(used.hint("merge"), "cube")), "at", "cube", "used")


def common_schema(**sources: DataFrame) -> DataFrame:
    """The routes of several sources under one schema: source, route_id, origin, destination, n_points."""
    out = None
    for name, df in sources.items():
        part = df.select(F.lit(name).alias("source"), F.col("route_id").cast("string").alias("route_id"), "origin", "destination", F.col("n_points").cast("long").alias("n_points"))
        out = part if out is None else out.unionByName(part)
    return out


def keyed(places: DataFrame) -> DataFrame:
    """(id, lon, lat, key) of places that have a key and a location."""
    return places.select("id", "lon", "lat", canonical_key(F.col("name")).alias("key")).where("key != '' and lon is not null and lat is not null")


def few_edits(one: DataFrame, other: DataFrame, radius_m: float, edits: int) -> DataFrame:
    """meetings of two tables (lon, lat, key, ids), with edits, of the keys that are at most so many apart."""
    met = meetings(one, other.withColumnsRenamed({"lon": "plon", "lat": "plat", "key": "pkey", "ids": "pids"}), radius_m)
    return met.withColumn("edits", F.levenshtein("key", "pkey", edits)).where("edits >= 0")


def close_places(a: DataFrame, b: DataFrame, radius_m: float, edits: int) -> DataFrame:
    """(ids, pids, edits, dist_m): link_candidates, of places whose key and location agree together, TOGETHER ids a row at most."""
    return few_edits(*(together(keyed(df), "id", "lon", "lat", "key") for df in (a, b)), radius_m, edits)


def link_candidates(a: DataFrame, b: DataFrame, radius_m: float, edits: int, digits: int | None = None) -> DataFrame:
    """(a_id, b_id, edits, dist_m): the places of two sources, each (id, name, lon, lat), within the radius whose keys (labels.canonical_key) are at most so many edits apart. They meet by place, those that agree in key and
    location as one; a place without a name or a location meets none. dist_m is rounded to so many digits, if any."""
    far = F.col("dist_m") if digits is None else F.round("dist_m", digits)
    met = close_places(a, b, radius_m, edits).select("ids", "pids", "edits", far.alias("dist_m"))
    return met.select(F.explode("ids").alias("a_id"), "pids", "edits", "dist_m").select("a_id", F.explode("pids").alias("b_id"), "edits", "dist_m")


def assign(candidates: DataFrame) -> DataFrame:
    """(a_id, b_id, edits, dist_m): candidates chosen one to one, by edits, then distance, then ids: what taking the best that is left, again and again, gives.

    A round takes all pairs that are each other's best and drops what they rule out; the best of all is always one of them, so it ends. Rounds are jobs; most pairs go in the first few.
    """
    left, chosen, n = checkpointed(candidates.distinct()), [], 0
    order = F.struct("edits", "dist_m", "a_id", "b_id")
    while left.limit(1).count():
        best = [left.groupBy(i).agg(F.min(order).alias("m")).select("m.*") for i in ("a_id", "b_id")]
        taken = checkpointed(best[0].join(best[1].select("a_id", "b_id"), ["a_id", "b_id"]).select("a_id", "b_id", "edits", "dist_m"))
        chosen, n = [*chosen, taken], n + 1
        left = checkpointed(left.join(taken.select("a_id"), "a_id", "left_anti").join(taken.select("b_id"), "b_id", "left_anti").select(*left.columns))
        if n % ROUNDS == 0:
            chosen = [checkpointed(reduce(DataFrame.unionByName, chosen))]
    return reduce(DataFrame.unionByName, chosen) if chosen else left.select("a_id", "b_id", "edits", "dist_m")


def ties(edges: DataFrame) -> DataFrame:
    """edges (a, b, edits, dist_m) with _tie, one for all edges of equal edits and distance that hang together by their ends. Each round is a job; edges in a row of k take about k / 2."""
    now = checkpointed(edges).withColumn("_tie", F.monotonically_increasing_id())
    while True:
        now = now.withColumn("_low", F.min("_tie").over(Window.partitionBy("a", "edits", "dist_m")))
        now = checkpointed(now.withColumn("_low", F.min("_low").over(Window.partitionBy("b", "edits", "dist_m"))))
        more = now.where("_low < _tie").limit(1).count()
        now = now.drop("_tie").withColumnRenamed("_low", "_tie")
        if not more:
            return now


def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tie, given with its pairs of classes and the ids of these: the ids of one side in order take the smallest id left that they may."""
    for batch in batches:
        kind = [batch.schema.field(n).type.value_type.field("id").type for n in ("own", "theirs")]
        found: list[tuple] = []
        for row in batch.to_pylist():
            near, waiting = defaultdict(list), defaultdict(list)
            for e in row["pairs"]:
                near[e["a"]].append(e["b"])
            for e in sorted(row["theirs"], key=lambda e: e["id"], reverse=True):
                waiting[e["place"]].append(e["id"])
            for e in sorted(row["own"], key=lambda e: e["id"]):
                free = [b for b in near[e["place"]] if waiting[b]]
                if free:
                    found.append((e["id"], waiting[min(free, key=lambda b: waiting[b][-1])].pop(), row["edits"], row["dist_m"]))
        columns = zip(*found, strict=True) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (*kind, pa.int32(), pa.float64()), strict=True)], ["a_id", "b_id", "edits", "dist_m"])


#: Ids of a tie over which their ranks are counted over the cluster, not in a task.
MANY = 100_000


def linked(a: DataFrame, b: DataFrame, radius_m: float, edits: int, digits: int | None = None) -> DataFrame:
    """assign(link_candidates(...)), without the candidates one by one: places that agree in key and location are a class, and only classes meet. Places without an id are left out.

    Between two classes all pairs are as good but for their ids. A round takes all ties whose pairs of classes are the best of both, and which so stand in nobody's way: the best of all is always one. In a tie where every class
    may go with every other, the ids of both sides are paired by their ranks, which of over MANY ids are counted over the cluster; in others the ids go in turn, in a task that holds the ids of the tie. Rounds are jobs, and don't
    grow with the copies of a place.
    """
    sides = [checkpointed(together(keyed(df.where("id is not null")), "id", "lon", "lat", "key").withColumn("place", F.min(F.get("ids", F.lit(0))).over(Window.partitionBy("lon", "lat", "key")))) for df in (a, b)]
    left = [checkpointed(s.select("place", F.explode("ids").alias("id")).distinct()) for s in sides]
    if any(m.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() for m in left):  # an id with several names or locations
        return assign(link_candidates(a.where("id is not null"), b.where("id is not null"), radius_m, edits, digits))
    met = few_edits(*(checkpointed(s.groupBy("lon", "lat", "key").agg(F.array(F.min("place")).alias("ids"), F.sum(F.size("ids")).alias(n))) for s, n in zip(sides, ("na", "nb"), strict=True)), radius_m, edits)
    far = F.col("dist_m") if digits is None else F.round("dist_m", digits)
    edges = ties(met.select(F.get("ids", F.lit(0)).alias("a"), F.get("pids", F.lit(0)).alias("b"), "edits", far.alias("dist_m"), (F.col("na") + F.col("nb")).alias("_n")))
    large = edges.groupBy("_tie").agg((F.sum("_n") > MANY).alias("_large"))
    edges, chosen, order = checkpointed(edges.drop("_n").join(large.hint("merge"), "_tie")), [], F.struct("edits", "dist_m")
    out = f"a_id {a.schema['id'].dataType.simpleString()}, b_id {b.schema['id'].dataType.simpleString()}, edits int, dist_m double"
    while True:
        best = edges.withColumns({f"_{c}": F.min(order).over(Window.partitionBy(c)) for c in "ab"})
        sizes = best.groupBy("_tie").agg(F.bool_and((order == F.col("_a")) & (order == F.col("_b"))).alias("_ready"), F.count("*").alias("_n"), *[F.size(F.collect_set(c)).cast("long").alias(f"_n{c}") for c in "ab"])
        now = checkpointed(edges.join(sizes.where("_ready").select("_tie", (F.col("_n") == F.col("_na") * F.col("_nb")).alias("_all")).hint("merge"), "_tie"))
        kinds = {(r["_all"], r["_large"]) for r in now.select("_all", "_large").distinct().collect()}
        if not kinds:
            break
        taken = []
        for kind in kinds:
            these = now.where((F.col("_all") == kind[0]) & (F.col("_large") == kind[1]))
            ids = [these.select("_tie", "edits", "dist_m", F.col(c).alias("place")).distinct().join(m.hint("merge"), "place") for c, m in zip("ab", left, strict=True)]
            if kind[0]:
                nth = F.row_number().over(Window.partitionBy("_tie").orderBy("id"))
                one, other = (ranked(i, "_tie", "id") if kind[1] else i.withColumn("_rank", nth) for i in ids)
                pairs = one.withColumnRenamed("id", "a_id").join(other.select("_tie", "_rank", F.col("id").alias("b_id")).hint("merge"), ["_tie", "_rank"])
                taken.append(pairs.select("a_id", "b_id", "edits", "dist_m"))
            else:
                own, theirs = (i.groupBy("_tie").agg(F.collect_list(F.struct("place", "id")).alias(n)) for i, n in zip(ids, ("own", "theirs"), strict=True))
                some = these.groupBy("_tie").agg(F.collect_list(F.struct("a", "b")).alias("pairs"), F.first("edits").alias("edits"), F.first("dist_m").alias("dist_m"))
                taken.append(some.join(own.hint("merge"), "_tie").join(theirs.hint("merge"), "_tie").drop("_tie").mapInArrow(in_turn, out))
        taken = checkpointed(reduce(DataFrame.unionByName, taken))
        left = [checkpointed(m.join(taken.select(F.col(c).alias("id")).hint("merge"), "id", "left_anti")) for m, c in zip(left, ("a_id", "b_id"), strict=True)]
        edges = edges.join(now.select("_tie").hint("merge"), "_tie", "left_anti")
        for c, m in zip("ab", left, strict=True):
            edges = edges.join(m.select(F.col("place").alias(c)).hint("merge"), c, "left_semi")
        edges, chosen = checkpointed(edges), [*chosen, taken]
        if len(chosen) > ROUNDS:
            chosen = [checkpointed(reduce(DataFrame.unionByName, chosen))]
    return reduce(DataFrame.unionByName, chosen) if chosen else a.sparkSession.createDataFrame([], out)


def unified(a: DataFrame, b: DataFrame, links: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(source, id, name, lon, lat, place): the places of two sources under one schema, ids as text. place is one for the two of a link, that of the first source; others have a place of their own."""
    first = a.select(F.lit(names[0]).alias("source"), F.col("id").cast("string").alias("id"), "name", "lon", "lat")
    first = first.withColumn("place", F.concat_ws(":", "source", "id"))
    tied = links.select(F.col("b_id").alias("id"), F.concat(F.lit(names[0] + ":"), F.col("a_id").cast("string")).alias("_tied"))
    second = b.join(tied, "id", "left").select(F.lit(names[1]).alias("source"), F.col("id").cast("string").alias("id"), "name", "lon", "lat", F.coalesce("_tied", F.concat(F.lit(names[1] + ":"), F.col("id").cast("string"))).alias("place"))
    return first.unionByName(second)
