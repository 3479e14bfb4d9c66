"""Routes, labels, stops, calendars and reports derived from the star-schema tables. plans.oracles derives the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = (18.2, 19.8, -34.9, -33.1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The shapes of a label by key modulo 10, in SQL that both engines read.
LABEL = """case p_partkey % 10
  when 0 then upper(p_name)
  when 1 then upper(p_name) || ' (VIA ' || p_type || ', N1 & ' || p_brand || ')'
  when 2 then 'VIA ' || p_type || ' RD -' || upper(p_name)
  when 3 then 'VIA ' || p_type || ' ' || upper(p_name)
  when 4 then upper(p_name) || ' via ' || p_type
  when 5 then p_name || ' (VIA ' || p_type || ' VIA ' || p_brand
  when 6 then replace(upper(p_name), ' ', '')
  when 7 then replace(p_name, ' ', ' ,') || ' railway  stations'
  when 8 then replace(upper(p_name), ' ', '''S ') || ' RAILWAY STATION(' || p_type
  else ' ' || upper(p_name) || '  (VIA' end"""
LON, LAT = "18 + cast(l_partkey % 2000 as double) / cast(1000 as double)", "-35 + cast(l_suppkey % 2000 as double) / cast(1000 as double)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label_id, name)"""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label_id"), F.expr(LABEL).alias("name"))


def with_labels(spark: SparkSession, sf_dir: str, paths: DataFrame) -> DataFrame:
    """(feature_ord, ORGN, DSTN, pts) of paths (l_orderkey, a, b, pts): every order, with the labels of the parts a and b; one without lines has blank labels and no points."""
    part = labels(spark, sf_dir)
    ends = table(spark, sf_dir, "orders").select("o_orderkey").join(paths, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    first, last = part.toDF("_a", "_o"), part.toDF("_b", "_d")
    named = ends.join(first, F.col("a") == F.col("_a"), "left").join(last, F.col("b") == F.col("_b"), "left")
    pts = F.coalesce("pts", F.array().cast("array<array<double>>"))
    return named.select(F.col("o_orderkey").alias("feature_ord"), F.coalesce("_o", F.lit(" ")).alias("ORGN"), F.coalesce("_d", F.lit(" ")).alias("DSTN"), pts.alias("pts"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(LON).alias("lon"), F.expr(LAT).alias("lat")).alias("p"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_ord, ORGN, DSTN, pts): an order is a route, its lines are points; one without lines has blank labels and no geometry.

    One shuffle brings the lines of an order together; labels are made from the part of the first and the last line only.
    """
    paths = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return with_labels(spark, sf_dir, paths.select("l_orderkey", F.get("p", F.lit(0))["l_partkey"].alias("a"), F.try_element_at("p", F.lit(-1))["l_partkey"].alias("b"), F.transform("p", lambda x: F.array(x["lon"], x["lat"])).alias("pts")))


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """routes with the first and the last point only, for what needs no others: an order's lines are reduced before the shuffle and never gathered."""
    found = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("n"))
    point = lambda c: F.array(F.col(c)["lon"], F.col(c)["lat"])
    return with_labels(spark, sf_dir, found.select("l_orderkey", F.col("a.l_partkey").alias("a"), F.col("b.l_partkey").alias("b"), F.when(F.col("n") > 1, F.array(point("a"), point("b"))).otherwise(F.array(point("a"))).alias("pts")))


def geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_ord, geom_type, coordinates) as raw GeoJSON: lines, multi-lines, points and none."""
    path = F.col("pts")
    kind = F.when(F.col("feature_ord") % 7 == 0, "MultiLineString").when(F.col("feature_ord") % 11 == 0, "Point").when(F.col("feature_ord") % 13 != 0, "LineString")
    text = F.when(F.col("feature_ord") % 7 == 0, F.to_json(F.array(F.slice(path, 1, 1), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))))).when(F.col("feature_ord") % 11 == 0, F.to_json(F.try_element_at(path, F.lit(1)))).otherwise(F.to_json(path))
    return routes(spark, sf_dir).select("feature_ord", kind.alias("geom_type"), text.alias("coordinates"))


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes with the raw text of their features, and of the collection's members: quotes, brackets and backslashes in strings, unknown members, nulls."""
    note = F.concat(F.lit('a "quote", {brace] and \\'), F.col("ORGN"))
    shape = F.when(F.size("pts") > 0, F.struct(F.lit("LineString").alias("type"), F.col("pts").alias("coordinates")))
    own = F.struct(F.col("feature_ord").alias("OBJECTID"), "ORGN", "DSTN", note.alias("note"))
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), own.alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"})
    return routes(spark, sf_dir).withColumns({"feature": text, "members": F.lit('{"type":"FeatureCollection","bbox":[1,2,3],"features":null,"more":{"features":[1,{}]}}')})


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alias, target) from the shorter part names."""
    name = F.upper("p_name")
    return table(spark, sf_dir, "part").where("length(p_name) % 5 = 0").select(name.alias("alias"), F.concat(F.regexp_replace(name, " .*$", ""), F.lit(" RAILWAY STATION")).alias("target")).distinct()


def preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, display) from some part names."""
    name = F.upper("p_name")
    return table(spark, sf_dir, "part").where("length(p_name) % 4 = 0").select(F.regexp_replace(name, "[^A-Z0-9]", "").alias("key"), F.concat(F.lit("THE "), name).alias("display")).distinct()


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(was, now) from part names."""
    return table(spark, sf_dir, "part").where("length(p_name) % 3 = 0").select(F.upper("p_name").alias("was"), F.concat(F.upper("p_name"), F.lit(" (CORRECTED)")).alias("now")).distinct()


STOP_NAME = "cast(p_partkey % 45 as string) || '_' || p_name || case p_partkey % 4 when 0 then ' SC' when 1 then ' n2 ROAD' when 2 then ' HOSPITAL R310' else '' end"


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stop_id, stop_code, stop_name, stop_lon, stop_lat, stop_desc)"""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("stop_id"),
        F.col("p_partkey").cast("string").alias("stop_code"),
        F.expr(STOP_NAME).alias("stop_name"),
        F.expr("18 + cast(p_partkey % 2000 as double) / cast(1000 as double)").alias("stop_lon"),
        F.expr("-35 + cast(p_size % 50 as double) / cast(20 as double)").alias("stop_lat"),
        F.lit(" ").alias("stop_desc"),
    )


TIME = "cast(5 + l_linenumber * 4 as string) || ':' || case when l_suppkey % 10 = 0 then cast(l_partkey % 70 as string) else lpad(cast(l_partkey % 60 as string), 2, '0') end || ':' || lpad(cast(l_suppkey % 60 as string), 2, '0')"


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, trip_id, stop_id, stop_sequence, arrival_time): the lines of an order by part are the stops of a trip."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"), F.col("l_suppkey").alias("supplier"), F.expr(TIME).alias("arrival_time"))


def stop_times_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stop_times in the order of the file of lines: with _block, a stretch of 65,536 rows of a file, and _row."""
    lines = table(spark, sf_dir, "lineitem")
    at = F.col("_metadata.row_index")
    return lines.select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence"), F.struct(F.col("_metadata.file_path").alias("file"), F.shiftright(at, 16).alias("n")).alias("_block"), at.alias("_row"))


def shape_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shape_id, shape_pt_lat, shape_pt_lon, shape_pt_sequence): the lines of a part are the points of a shape, at coarse places, so that some follow an equal one."""
    lon, lat = "18 + cast(l_suppkey % 3 as double)", "-35 + cast(l_linenumber % 2 as double)"
    number = "l_orderkey * 100000 + l_suppkey * 10 + l_linenumber"
    points = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("shape_id"), F.expr(lat).alias("shape_pt_lat"), F.expr(lon).alias("shape_pt_lon"), F.expr(number).alias("shape_pt_sequence"))
    return points.distinct()


#: The places of another feed: of every part but some, its name with a letter lost or doubled, a little moved, so that several lie near a stop of one name.
OTHER_NAME = "case when p_partkey % 3 = 0 then substr(p_name, 2) when p_partkey % 3 = 1 then lower(p_name) || 's' else upper(p_name) end"
OTHER_LON = "18 + cast(p_partkey % 2000 as double) / cast(1000 as double) + cast(p_partkey % 7 - 3 as double) / cast(2500 as double)"


def two_feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two sources of places (id, name, lon, lat): the stops by their part's name, and the places of another feed."""
    part = table(spark, sf_dir, "part")
    lat = F.expr("-35 + cast(p_size % 5 as double) / cast(20 as double)").alias("lat")
    one = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr("18 + cast(p_partkey % 2000 as double) / cast(1000 as double)").alias("lon"), lat)
    return one, part.where("p_partkey % 11 != 0").select((F.col("p_partkey") + 1_000_000).alias("id"), F.expr(OTHER_NAME).alias("name"), F.expr(OTHER_LON).alias("lon"), lat)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(service_id, label, the days' flags, start_date, end_date): a service a supplier."""
    k = F.col("s_suppkey")
    label = F.when(k % 4 == 0, "weekdays").when(k % 4 == 1, "saturdays").when(k % 4 == 2, "sundays").otherwise("other")
    week = F.when(k % 4 == 0, F.when(k % 3 == 0, 1).otherwise(k % 2)).otherwise((k % 8 == 3).cast("int"))
    days = {d: week.cast("int") for d in ("monday", "tuesday", "thursday")} | {"wednesday": F.when(k % 4 == 0, 1).otherwise(0), "friday": F.when(k % 4 == 0, 1).otherwise(0), "saturday": (k % 4 == 1).cast("int"), "sunday": (k % 4 == 2).cast("int")}
    start = F.date_add(F.to_date(F.lit("1998-01-01")), (k % 90).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("service_id"), label.alias("label"), *[v.alias(d) for d, v in days.items()], start.alias("start_date"), F.date_add(start, (k % 40).cast("int")).alias("end_date"))


def feed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A feed: customers are routes, orders trips, parts stops, lines stop times, suppliers services, the points of an order a shape."""
    return {
        "routes": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route_id")),
        "trips": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 120).cast("string")).alias("service_id")),
        "stops": stops(spark, sf_dir).withColumn("stop_id", F.col("stop_id").cast("long")),
        "stop_times": stop_times(spark, sf_dir),
        "calendar": calendar(spark, sf_dir),
        "shapes": routes(spark, sf_dir).select(F.col("feature_ord").alias("shape_id"), "pts"),
    }


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route_id, fare, confirmed, ts, report_id) from events."""
    return table(spark, sf_dir, "events").where("event_type in ('purchase', 'click')").select((F.col("user_id") % 50).alias("route_id"), F.col("value").alias("fare"), (F.col("event_type") == "click").alias("confirmed"), "ts", F.col("event_id").alias("report_id"))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(canonical_origin, canonical_destination): lines of forty places each from the parts, a place to the next, with a short cut from every seventh to twice its number."""
    place = lambda k: F.concat(F.lit("P"), F.lpad(k.cast("string"), 9, "0"))
    k = F.col("p_partkey")
    ahead = F.when(k % 7 == 0, F.array(F.when(k % 40 != 0, k + 1), 2 * k)).otherwise(F.array(F.when(k % 40 != 0, k + 1)))
    return table(spark, sf_dir, "part").select(place(k).alias("canonical_origin"), F.explode(ahead).alias("_to")).select("canonical_origin", place(F.col("_to")).alias("canonical_destination"))


def pickups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, lon, lat) from sign-ups."""
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("request_id"), F.expr("18 + cast(event_id * 7 % 2000 as double) / cast(1000 as double)").alias("lon"), F.expr("-35 + cast(user_id * 13 % 2000 as double) / cast(1000 as double)").alias("lat"))


def meeting_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, lon, lat) from suppliers."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), F.expr("18 + cast(s_suppkey * 37 % 2000 as double) / cast(1000 as double)").alias("lon"), F.expr("-35 + cast(s_suppkey * 53 % 2000 as double) / cast(1000 as double)").alias("lat"))


def rounded(column: str, digits: int = 3) -> Column:
    return F.round(column, digits).alias(column)
