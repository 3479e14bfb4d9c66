"""Integrity of feeds as they are read: in the order of the file, shapes from points, days from ids; a fault of each kind is planted."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import integrity, ordered
from waymark.plans import oracles, queries, views
from waymark.sources import gtfs

TABLES = ("routes", "trips", "stops", "stop_times", "calendar", "shapes")
CLEAN = {
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_type\nr1,a,s,l,3\nr2,a,s,l,3\n",
    "trips": "route_id,service_id,trip_id,shape_id\nr1,weekdays,t1,h1\nr2,saturdays,t2,h2\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon\n1,1_A,-34.0,18.5\n2,2_A,-34.1,18.6\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,5:00:00,5:00:00,1,1\nt2,25:10:00,25:10:00,2,4\nt1,05:10:00,5:10:00,2,2\nt2,25:20:00,25:20:00,1,9\n",
    "calendar": "service_id,start_date,end_date,monday,tuesday,wednesday,thursday,friday,saturday,sunday\nweekdays,20200501,20200831,1,1,1,1,1,0,0\nsaturdays,20200501,20200831,0,0,0,0,0,1,0\n",
    "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nh1,-34,18.5,2\nh1,-34.1,18.5,1\nh2,-34,18.5,1\nh2,-34,18.6,70000\n",
}
FAULTS = {
    "trips without routes": ("trips", "r1,weekdays,t1,h1", "r9,weekdays,t1,h1", {"routes without trips": 1}),
    "trips without calendar": ("trips", "r1,weekdays,t1,h1", "r1,Weekdays2,t1,h1", {"calendar without trips": 1}),
    "stop_times without trips": ("stop_times", "t1,05:10", "t7,05:10", {}),
    "stop_times without stops": ("stop_times", "5:10:00,2,2", "5:10:00,,2", {}),
    "trips without shapes": ("trips", "t2,h2", "t2,h1\nr2,saturdays,t2b,h8", {"shapes without trips": 1, "trips without stop_times": 1}),
    "repeated keys of stops": ("stops", "2,2_A,-34.1,18.6", "2,2_A,-34.1,18.6\n2,2_B,-34.2,18.6", {}),
    "repeated keys of stop_times": ("stop_times", "1,9\n", "1,9\nt2,25:30:00,25:30:00,1,9\n", {"stop_sequence not rising": 1}),
    "stop_sequence not rising": ("stop_times", "5:10:00,2,2", "5:10:00,2,0", {}),
    "times not well formed": ("stop_times", "t1,5:00:00", "t1,5:0:00", {}),
    "stops outside the box": ("stops", "-34.1,18.6", "34.1,18.6", {}),
    "shapes that repeat a point": ("shapes", "-34,18.6,70000", "-34,18.5,70000", {}),
    "services unlike their name": ("calendar", "1,1,1,1,1,0,0", "0,0,1,0,1,0,0", {}),
}


def report(spark, folder, texts):
    for table, text in texts.items():
        (folder / f"{table}.txt").write_text(text)
    found = integrity.feed_report(gtfs.read_feed(spark, str(folder), TABLES, positions=True), views.BOX).collect()
    assert len({r.check for r in found}) == len(found)
    return {r.check: r.n_bad for r in found}


def test_a_clean_feed(spark, tmp_path):
    assert len(got := report(spark, tmp_path, CLEAN)) == 20 and not any(got.values())


@pytest.mark.parametrize("fault", FAULTS)
def test_every_fault_is_reported(spark, tmp_path, fault):
    table, was, now, others = FAULTS[fault]
    assert was in CLEAN[table]
    got = report(spark, tmp_path, CLEAN | {table: CLEAN[table].replace(was, now, 1)})
    assert {check: n for check, n in got.items() if n} == {fault: 1} | others


def test_a_trip_over_many_parts_of_a_file(spark, tmp_path):
    """The rows before are those of the file, whatever the parts in which it is read and how trips mix."""
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.5 else f"t{r.randint(0, 4)}", r.randint(0, 40)) for _ in range(3000)]
    (tmp_path / "stop_times.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(f"{t},5:00:00,5:00:00,{i},{n}\n" for i, (t, n) in enumerate(rows)))
    before, want = {}, []
    for i, (t, n) in enumerate(rows):
        if n <= before.get(t, -1):
            want.append((str(i), t, n, before[t]))
        before[t] = n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        times = gtfs.read_table(spark, str(tmp_path), "stop_times", positions=True)
        assert times.select("_block").distinct().count() > 10
        got = ordered.breaks_in_file(times, "trip_id", "stop_sequence").select("stop_id", "trip_id", "stop_sequence", "before").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == sorted(want)


def test_previous_rows_with_nulls(spark):
    rows = [(None, 1, 1, 5), (None, 2, 2, None), (None, 3, 3, 7), ("a", 1, 4, 1), ("a", 1, 5, 2)]
    df = spark.createDataFrame(rows, "g string, b int, o int, v int").repartition(3)
    got = {r.o: r.before for r in ordered.with_previous(df, ["g"], "b", ["o"], "v").collect()}
    assert got == {1: None, 2: 5, 3: None, 4: None, 5: 1}
    assert ordered.with_previous(df.limit(0), ["g"], "b", ["o"], "v").count() == 0


def test_paths_of_points(spark):
    df = spark.createDataFrame([("h", 2.0, 1.0, 7), ("h", 4.0, 3.0, 2), ("h", None, 3.0, 1), ("k", None, 1.0, 1), (None, 1.0, 1.0, 1)], "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int")
    assert [tuple(r) for r in ordered.paths(df).collect()] == [("h", [[3.0, 4.0], [1.0, 2.0]])]


def test_names_of_services(spark):
    df = spark.createDataFrame([("weekdays",), ("Week-day A",), ("SATURDAYS",), ("x_sunday",), ("1",), (None,)], "s string")
    assert [r[0] for r in df.select(integrity.label_of(F.col("s"))).collect()] == ["weekdays", "weekdays", "saturdays", "sundays", "other", "other"]


@pytest.mark.parametrize("name", ["sequence_in_file", "repeated_points", "shape_paths", "feed_report"])
def test_queries(agree, name):
    agree(queries.QUERIES[name], oracles.ORACLE_SQL[name])
