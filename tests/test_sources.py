import json

import pytest
from pyspark.sql import functions as F

from waymark.operators import cleaning, places
from waymark.plans import job
from waymark.sources import geojson, gtfs
from waymark.streaming import reports

DOC = (
    '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"x"}},"features":['
    '{"type":"Feature","properties":{"OBJECTID":7,"ORGN":"É (VIA N1)","DSTN":"B","n":1.50,"big":12345678901234567890},"geometry":{"type":"LineString","coordinates":[[18.1,-34.0],[18.2,-34.1]]}},'
    '{"type":"Feature","properties":{"OBJECTID":8,"ORGN":"B","DSTN":"C"},"geometry":{"type":"MultiLineString","coordinates":[[[1,2],[3,4]],[[5,6]]]}},'
    '{"type":"Feature","properties":{"OBJECTID":9,"ORGN":" ","DSTN":"C"},"geometry":null}]}'
)


def test_geojson_round_trip(spark, tmp_path):
    source = tmp_path / "in.geojson"
    source.write_text(DOC, encoding="utf-8")
    routes = geojson.read_routes(spark, str(source))
    assert [r.pts for r in routes.orderBy("feature_ord").collect()] == [[[18.1, -34.0], [18.2, -34.1]], [[1, 2], [3, 4], [5, 6]], []]
    aliases, preferred = spark.createDataFrame([], "alias string, target string"), spark.createDataFrame([], "key string, display string")
    out = str(tmp_path / "out")
    with pytest.raises(ValueError):
        geojson.write_routes(routes, str(source), str(source))
    geojson.write_routes(places.normalise_places(routes, aliases, preferred), out, str(source))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    doc = json.loads(text)
    assert '"n":1.50,"big":12345678901234567890' in text and doc["crs"] == json.loads(DOC)["crs"]
    first, _, last = doc["features"]
    assert first["properties"]["canonical_origin"] == "É" and first["properties"]["via_origin"] == "N1" and first["properties"]["via_destination"] is None
    assert last["geometry"] is None and [f["properties"]["OBJECTID"] for f in doc["features"]] == [7, 8, 9]


ODD = (
    '\ufeff{ "name" : "x, \\"features\\": [", "bbox":[1,2, 3.50,4],"type":"FeatureCollection", "features" : [ '
    '{"id":"f1","type":"Feature","bbox":[1.0,2],"properties":{"OBJECTID":1,"ORGN":"A STATIONS","via_origin":"old","n":{"a":[1,{"b":null}]},"DSTN":"é"},"geometry":{"type":"LineString","extra":true,"coordinates":[[18.10,-34],[18.2,-34.1]]},"more":[1]},'
    '{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[]},"properties":{"ORGN":"B","DSTN":"C"}}], "after":{"k":1.0e-7}}'
)


def test_all_members_pass_and_a_second_run_changes_nothing(spark, tmp_path):
    aliases, preferred = spark.createDataFrame([("B", "BEE")], "alias string, target string"), spark.createDataFrame([], "key string, display string")

    def run(source, out):
        geojson.write_routes(places.normalise_places(geojson.read_routes(spark, str(source)), aliases, preferred), str(tmp_path / out), str(source))
        return "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / out).glob("part-*")))

    (tmp_path / "in.geojson").write_text(ODD, encoding="utf-8")
    once = run(tmp_path / "in.geojson", "one")
    (tmp_path / "again.geojson").write_text(once, encoding="utf-8")
    assert run(tmp_path / "again.geojson", "two") == once
    was, now = json.loads(ODD.lstrip("\ufeff")), json.loads(once)
    own = dict(canonical_origin="A STATION", canonical_destination="É", via_origin=None, via_destination=None)
    was["features"][0]["properties"] |= own
    was["features"][1]["properties"] |= dict(canonical_origin="BEE", canonical_destination="C", via_origin=None, via_destination=None)
    assert now == was and [*now] == [*was] and [*now["features"][0]] == [*was["features"][0]] and "3.50" in once and "1.0e-7" in once
    assert once.count('"via_origin"') == 2


def test_empty_collection(spark, tmp_path):
    (tmp_path / "in.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    assert geojson.read_routes(spark, str(tmp_path / "in.geojson")).count() == 0


def test_job_reports_in_order_and_writes_only_with_a_target(spark, tmp_path):
    def feature(i, o, d, x):
        return {"type": "Feature", "properties": {"OBJECTID": i, "ORGN": o, "DSTN": d}, "geometry": {"type": "LineString", "coordinates": [[x, 0], [x + 1, 0]]}}

    rows = [("Zed", "Abe", 0), ("Z'ED", "ABE", 0.0), ("ZED", "Abe.", 3), ("zed", "Q (via N1)", 1), ("zed", "HOUTBAY", 1), ("zed", "Hout  Bay", 1)]
    (tmp_path / "in.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(i, *r) for i, r in enumerate(rows)]}))
    found = job.run(spark, str(tmp_path / "in.geojson"))
    assert tuple(found["summary"].first()) == (10, 4, 1)
    merges = [(r.canonical, r.nth, r.cnt, r.metres, r.name) for r in found["merges"].collect()]
    assert [m[:3] + m[4:] for m in merges] == [
        ("ABE", 1, 1, "Abe"), ("ABE", 2, 1, "ABE"), ("ABE", 3, 1, "Abe."), ("HOUT BAY", 1, 1, "HOUTBAY"), ("HOUT BAY", 2, 1, "Hout  Bay"), ("ZED", 1, 3, "zed"), ("ZED", 2, 1, "Zed"), ("ZED", 3, 1, "Z'ED"), ("ZED", 4, 1, "ZED"),
    ]
    assert merges[0][3] == "       0 m" and merges[2][3] == "  333585 m" and [r.canonical for r in found["reviews"].collect()] == ["ABE", "ZED"]
    assert [p.name for p in tmp_path.iterdir()] == ["in.geojson"]
    job.run(spark, str(tmp_path / "in.geojson"), str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("part-*"))


def test_whole_metres(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (1234.4999,), (12_345_678.0,), (None,)], "d double")
    assert [r[0] for r in df.select(places.whole_metres(F.col("d"))).collect()] == ["       0 m", "       2 m", "       2 m", "    1234 m", "12345678 m", "        ?"]


def test_feeds_keep_all_columns_and_are_cleaned(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_code,stop_name,stop_lat,stop_lon,stop_desc,note\n1,1,1_main ROAD SC,-34.12345678,18.5,,x\n2,2,2_oak n2,-34,18.60000004, ,\n")
    (tmp_path / "routes.txt").write_text("route_id,agency_id,route_short_name,route_long_name,route_type,route_url\nr,a,s,l,3,\n")
    feed = gtfs.read_feed(spark, str(tmp_path), ("stops", "routes"))
    assert "stop_code" in feed["stops"].columns and "route_url" in feed["routes"].columns
    clean = cleaning.clean_gtfs(feed)
    assert clean["stops"].columns == ["stop_id", "stop_name", "stop_lat", "stop_lon", "note"] and "route_url" not in clean["routes"].columns
    assert [tuple(r) for r in clean["stops"].orderBy("stop_id").collect()] == [("1", "1_Main Road SC", -34.123457, 18.5, "x"), ("2", "2_Oak n2", -34.0, 18.6, None)]
    assert {tuple(r) for r in gtfs.cardinalities(clean).collect()} == {("stops", 2), ("routes", 1)}


def test_feed_with_any_line_ends_and_a_mark(spark, tmp_path):
    (tmp_path / "stops.txt").write_bytes("﻿stop_id,stop_name,stop_lat,stop_lon\r\n007,1_a b,-34.0,18.5\r\n8,2_c,bad,18.6".encode())
    (tmp_path / "calendar.txt").write_text("service_id,start_date,end_date,monday,tuesday,wednesday,thursday,friday,saturday,sunday\nw,20200501,20200831,1,1,1,1,1,0,0")
    stops = gtfs.read_table(spark, str(tmp_path), "stops").orderBy(F.desc("stop_id")).collect()
    assert [tuple(r) for r in stops] == [("8", "2_c", None, 18.6), ("007", "1_a b", -34.0, 18.5)]
    assert str(gtfs.read_table(spark, str(tmp_path), "calendar").first().start_date) == "2020-05-01"


def test_stream_of_reports_agrees_with_the_table(spark, tmp_path):
    rows = spark.range(200).selectExpr("id % 3 as route_id", "cast(id as double) as fare", "id % 2 = 0 as confirmed", "timestamp_seconds(1700000000 + id * 60) as ts", "id as report_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = reports.fare_windows(stream, distinct=True).writeStream.format("memory").queryName("fares").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    closed = {tuple(r) for r in spark.table("fares").collect()}
    assert closed and closed <= {tuple(r) for r in reports.fare_windows(rows).collect()}
