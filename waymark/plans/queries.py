"""The registered queries: (spark, sf_dir) to a DataFrame, one for each operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, labels
from waymark.operators import cleaning, integrity, matching, ordered, places, similarity
from waymark.plans import views
from waymark.plans.views import rounded, table
from waymark.shared import shared_folder
from waymark.sources import geojson, gtfs
from waymark.streaming import reports

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def named(spark: SparkSession, d: str) -> DataFrame:
    return places.names(places.endpoints(views.ends(spark, d)))


def rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return views.ends(spark, d), views.aliases(spark, d), views.preferred(spark, d)


@query
def via_paren(spark, d):
    return named(spark, d).select("name", F.array_join(labels.paren_clauses(F.col("name")), "|").alias("clauses"), labels.without_paren(F.col("name")).alias("rest"))


@query
def via_leading_dash(spark, d):
    rest = named(spark, d).select("name", labels.without_paren(F.col("name")).alias("s")).where(F.rlike("s", F.lit(labels.LEADING_DASH)))
    return rest.select("name", *[F.regexp_extract("s", labels.LEADING_DASH, i).alias(c) for i, c in ((1, "via"), (2, "rest"))])


@query
def via_leading_token(spark, d):
    rest = named(spark, d).select("name", labels.without_paren(F.col("name")).alias("s"))
    rest = rest.where(F.rlike("s", F.lit(labels.LEADING_TOKEN)) & ~F.rlike("s", F.lit(labels.LEADING_DASH)))
    return rest.select("name", *[F.regexp_extract("s", labels.LEADING_TOKEN, i).alias(c) for i, c in ((1, "via"), (2, "rest"))])


@query
def via_trailing(spark, d):
    s = F.col("s")
    after = F.coalesce(labels.matched(s, labels.LEADING_DASH, 2), labels.matched(s, labels.LEADING_TOKEN, 2), s)
    rest = named(spark, d).select("name", labels.without_paren(F.col("name")).alias("s")).select("name", after.alias("r")).where(F.rlike("r", F.lit(labels.TRAILING)))
    return rest.select("name", *[F.regexp_extract("r", labels.TRAILING, i).alias(c) for i, c in ((2, "via"), (1, "rest"))])


@query
def via_join(spark, d):
    return labels.split_via(named(spark, d), "name").select("name", "place", "via")


@query
def tidy_label(spark, d):
    return labels.split_via(named(spark, d), "name").select("name", labels.tidy(F.col("place")).alias("tidied"))


@query
def alias_apply(spark, d):
    known = places.resolved(named(spark, d), views.aliases(spark, d))
    return labels.split_via(known.select("name", F.col("place").alias("p")), "name").select("name", labels.tidy(F.col("place")).alias("tidied"), F.col("p").alias("place"))


@query
def canonical_key(spark, d):
    return places.resolved(named(spark, d), views.aliases(spark, d)).select("name", "place", "key")


@query
def title_case(spark, d):
    return views.stops(spark, d).select("stop_id", labels.title_case(F.col("stop_name")).alias("stop_name"))


@query
def prefix_split(spark, d):
    return views.stops(spark, d).select("stop_id", labels.prefix_number(F.col("stop_name")).alias("number"), labels.prefix_base(F.col("stop_name")).alias("base"))


@query
def edit_distance_pairs(spark, d):
    return similarity.close_pairs(table(spark, d, "part"), "p_name")


@query
def token_edit_pairs(spark, d):
    return similarity.token_pairs(table(spark, d, "part"), "p_name")


@query
def edit_distance_far(spark, d):
    """Up to four edits apart."""
    return similarity.close_pairs(table(spark, d, "part"), "p_name", 4)


@query
def token_edit_far(spark, d):
    """Words up to three edits apart."""
    return similarity.token_pairs(table(spark, d, "part").select(F.col("p_type").alias("name")).unionAll(table(spark, d, "part").select("p_name")), "name", 3)


@query
def compound_flag(spark, d):
    return named(spark, d).select("name", labels.is_compound(F.col("name")).alias("compound"))


@query
def malformed_flag(spark, d):
    return named(spark, d).select("name", labels.is_malformed(F.col("name")).alias("malformed"))


@query
def time_format_check(spark, d):
    times = views.stop_times(spark, d).groupBy("arrival_time").agg(F.count("*").alias("n"))
    return times.select("arrival_time", "n", labels.is_time(F.col("arrival_time")).alias("well_formed"), F.coalesce(labels.seconds(F.col("arrival_time")), F.lit(-1)).alias("seconds"))


@query
def haversine(spark, d):
    a, b = F.get("pts", F.lit(0)), F.try_element_at("pts", F.lit(-1))
    return views.ends(spark, d).where("size(pts) >= 2").select("feature_ord", F.round(geo.haversine(a[0], a[1], b[0], b[1]), 3).alias("length_m"))


@query
def coords_flatten(spark, d):
    found = views.geometries(spark, d).select("feature_ord", geo.points(F.col("geom_type"), F.col("coordinates")).alias("pts"))
    return found.select("feature_ord", F.size("pts").cast("long").alias("n_points"), F.get(F.try_element_at("pts", F.lit(-1)), F.lit(0)).alias("last_lon"))


@query
def round_coords(spark, d):
    finer = F.transform("pts", lambda p: F.transform(p, lambda x: x / 7))
    lons = F.transform(geo.rounded(finer), lambda p: p[0])
    return views.routes(spark, d).where("size(pts) > 0").select("feature_ord", F.round(F.aggregate(lons, F.lit(0.0), lambda a, x: a + x), 6).alias("sum_lon"))


@query
def service_dates(spark, d):
    return integrity.service_dates(views.calendar(spark, d)).withColumn("date", F.col("date").cast("string"))


@query
def calendar_label_check(spark, d):
    return integrity.calendar_label_check(views.calendar(spark, d))


@query
def endpoint_unpivot(spark, d):
    return places.endpoints(views.ends(spark, d))


@query
def name_counts(spark, d):
    return named(spark, d)


@query
def consensus_location(spark, d):
    return places.consensus(places.endpoints(views.ends(spark, d))).select("name", rounded("lon", 6), rounded("lat", 6))


@query
def form_weights(spark, d):
    return places.form_weights(places.resolved(named(spark, d), views.aliases(spark, d)))


@query
def display_vote(spark, d):
    return places.displays(form_weights(spark, d), views.preferred(spark, d))


@query
def place_members(spark, d):
    return places.place_members(places.dictionary(*rules(spark, d))).withColumn("members", F.array_join("members", "|"))


@query
def summary_counts(spark, d):
    return places.summary(*rules(spark, d))


@query
def merge_report(spark, d):
    return places.merge_report(*rules(spark, d)).withColumns({c: F.round(c, 3) for c in ("dist_m", "spread_m")})


@query
def merge_reviews(spark, d):
    return places.merge_reviews(places.merge_report(*rules(spark, d))).withColumn("spread_m", F.round("spread_m", 3))


@query
def normalise_places(spark, d):
    done = places.normalise_places(*rules(spark, d))
    return done.select("feature_ord", F.col("ORGN").alias("orgn"), F.col("DSTN").alias("dstn"), "canonical_origin", "canonical_destination", "via_origin", "via_destination")


@query
def geojson_round_trip(spark, d):
    """The normalised routes written as a collection in parts and read again, many tasks each way."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.geojson"
    routes, aliases, preferred = views.collection(spark, d), views.aliases(spark, d), views.preferred(spark, d)
    geojson.write_routes(places.normalise_places(routes, aliases, preferred), path)
    found = geojson.read_routes(spark, path, chunk=1 << 20)
    own = {c: F.get_json_object("feature", f"$.properties.{c}") for c in (*geojson.DERIVED, "note")}
    return found.select(F.col("OBJECTID").alias("objectid"), F.col("ORGN").alias("orgn"), F.col("DSTN").alias("dstn"), F.size("pts").cast("long").alias("n_points"), *[v.alias(c) for c, v in own.items()])


@query
def clean_routes(spark, d):
    found = cleaning.clean_routes(views.routes(spark, d))
    return found.select("feature_ord", F.col("ORGN").alias("orgn"), F.col("DSTN").alias("dstn"), "is_loop", F.size("pts").cast("long").alias("n_points"), F.get(F.get("pts", F.lit(0)), F.lit(0)).alias("first_lon"))


@query
def clean_gtfs(spark, d):
    """Of the cleaned stops the rows, and which columns are left."""
    stops = cleaning.clean_gtfs({"stops": views.stops(spark, d).withColumn("stop_lat", F.col("stop_lat") / 7)})["stops"]
    return stops.withColumn("columns", F.lit(",".join(sorted(stops.columns))))


@query
def drop_blank_labels(spark, d):
    return cleaning.drop_blank_labels(views.ends(spark, d)).select("feature_ord", "ORGN", "DSTN")


@query
def loop_flag(spark, d):
    return views.ends(spark, d).select("feature_ord", cleaning.is_loop().alias("is_loop"))


@query
def blank_profile(spark, d):
    return cleaning.blank_profile(views.stops(spark, d))


@query
def redundant_columns(spark, d):
    return cleaning.redundant_columns(views.stops(spark, d), [("stop_code", "stop_id"), ("stop_desc", "stop_name")])


def outside(spark: SparkSession, d: str) -> DataFrame:
    return views.stops(spark, d).where(~geo.in_box(F.col("stop_lon"), F.col("stop_lat"), *views.BOX)).select("stop_id")


@query
def bbox_check(spark, d):
    return outside(spark, d)


@query
def fk_orphans(spark, d):
    """Orders without a line."""
    return integrity.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query
def unused_parents(spark, d):
    return integrity.usage(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query
def pk_duplicates(spark, d):
    return integrity.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query
def keep_first_dedupe(spark, d):
    return cleaning.keep_first(table(spark, d, "documents").select("doc_id", "text"), ["text"], "doc_id")


@query
def monotonic_sequence(spark, d):
    return integrity.breaks_in_order(views.stop_times(spark, d), "trip_id", "stop_sequence", "stop_id", "supplier", "stop_sequence").select("trip_id", "stop_sequence", "before")


@query
def sequence_in_file(spark, d):
    return ordered.breaks_in_file(views.stop_times_in_file(spark, d), "trip_id", "stop_sequence").select("trip_id", "stop_sequence", "before", F.col("_row").alias("row"))


@query
def repeated_points(spark, d):
    return ordered.repeated_points(views.shape_points(spark, d), size=1 << 22).select("shape_id", "shape_pt_sequence")


@query
def shape_paths(spark, d):
    """Of each shape gathered from its points how many there are, and its length."""
    line = ordered.paths(views.shape_points(spark, d))
    steps = F.zip_with(F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts") - 1), lambda a, b: geo.haversine(a[0], a[1], b[0], b[1]))
    return line.select("shape_id", F.size("pts").cast("long").alias("n_points"), F.round(F.aggregate(steps, F.lit(0.0), lambda x, y: x + y) / 1000, 3).alias("length_km"))


@query
def consecutive_points(spark, d):
    return views.routes(spark, d).select("feature_ord", geo.repeats_point(F.col("pts")).alias("repeats"))


@query
def prefix_gaps(spark, d):
    return cleaning.prefix_gaps(prefix_split(spark, d))


@query
def od_pairs(spark, d):
    return normalise_places(spark, d).select("canonical_origin", "canonical_destination").distinct()


@query
def od_multipath(spark, d):
    return integrity.od_multipath(views.routes(spark, d))


@query
def name_own_spread(spark, d):
    return places.own_spread(places.endpoints(views.ends(spark, d))).select("name", rounded("max_m"), rounded("median_m"))


@query
def typo_geo_check(spark, d):
    spots = views.stops(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("stop_id"), F.col("p_name").alias("name")), "stop_id")
    spots = spots.groupBy("name").agg(F.median("stop_lon").alias("lon"), F.median("stop_lat").alias("lat"))
    return similarity.typo_candidates(table(spark, d, "part"), "p_name", spots).withColumn("dist_m", F.round("dist_m", 3))


@query
def apply_corrections(spark, d):
    return cleaning.apply_corrections(table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("label")), "label", views.corrections(spark, d))


@query
def label_geometry_mismatch(spark, d):
    return places.label_geometry_mismatch(*rules(spark, d), 90_000.0).withColumn("dist_m", F.round("dist_m", 3))


@query
def common_schema(spark, d):
    one = views.routes(spark, d).select(F.col("feature_ord").alias("route_id"), F.col("ORGN").alias("origin"), F.col("DSTN").alias("destination"), F.size("pts").alias("n_points"))
    two = views.stop_times(spark, d).groupBy(F.col("trip_id").alias("route_id")).agg(F.min("arrival_time").alias("origin"), F.max("arrival_time").alias("destination"), F.count("*").alias("n_points"))
    return matching.common_schema(routes=one, trips=two)


@query
def integrity_report(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    return integrity.integrity_report({"orders without lines": integrity.orphans(orders, lines, "o_orderkey", "l_orderkey"), "repeated line keys": integrity.duplicates(lines, "l_orderkey", "l_linenumber"), "stops outside the box": outside(spark, d)})


@query
def feed_report(spark, d):
    return integrity.feed_report(views.feed(spark, d), views.BOX, ("stop_id", "supplier", "stop_sequence"))


@query
def trips_per_route(spark, d):
    feed = views.feed(spark, d)
    return integrity.usage(feed["routes"], feed["trips"], "route_id", "route_id")


@query
def cardinalities(spark, d):
    return gtfs.cardinalities(views.feed(spark, d))


@query
def report_lines(spark, d):
    return places.report_lines(places.merge_report(*rules(spark, d)))


@query
def review_lines(spark, d):
    return places.review_lines(places.merge_reviews(places.merge_report(*rules(spark, d))))


@query
def od_counts(spark, d):
    return integrity.od_counts(places.normalise_places(*rules(spark, d)))


@query
def route_legs(spark, d):
    """From the first of all origins by name, with the places of each way."""
    edges = normalise_places(spark, d)
    start = edges.where("canonical_origin is not null and canonical_destination is not null").agg(F.min("canonical_origin")).first()[0]
    return matching.route_legs(edges, start).withColumn("places", F.array_join("places", " > "))


@query
def route_match(spark, d):
    """From the first of all origins by name."""
    edges = normalise_places(spark, d)
    start = edges.where("canonical_origin is not null and canonical_destination is not null").agg(F.min("canonical_origin")).first()[0]
    return matching.match_route(edges, start)


@query
def route_reach(spark, d):
    """From the first of all origins by name, with as many changes as it takes."""
    edges = normalise_places(spark, d)
    start = edges.where("canonical_origin is not null and canonical_destination is not null").agg(F.min("canonical_origin")).first()[0]
    return matching.match_route(edges, start, None)


@query
def route_chain(spark, d):
    """To the end of a long chain of changes, over a network of lines."""
    return matching.route_legs(views.network(spark, d), "P000000001", transfers=None).withColumn("places", F.array_join("places", ">"))


@query
def route_pair(spark, d):
    """From the first place of the network to the last of its first line, searched from both ends."""
    return matching.route_between(views.network(spark, d), "P000000001", "P000000040").withColumn("places", F.array_join("places", ">"))


@query
def fare_consensus(spark, d):
    return matching.fare_consensus(views.reports(spark, d))


@query
def fare_windows(spark, d):
    return reports.fare_windows(views.reports(spark, d))


@query
def nearby_pickups(spark, d):
    return matching.nearby(views.pickups(spark, d), views.meeting_points(spark, d), 5000.0, digits=3)


@query
def nearest_points(spark, d):
    """The three meeting points nearest to each pickup."""
    return matching.nearest(views.pickups(spark, d), views.meeting_points(spark, d), 3, leaf=16).withColumn("dist_m", F.round("dist_m", 3))


@query
def nearby_polar(spark, d):
    """Pairs within 40 km about a pole and over the date line."""
    moved = lambda df: df.withColumns({"lat": F.col("lat") + F.lit(122.9), "lon": F.col("lon") * 180 - 3400})
    wrapped = lambda df: moved(df).withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))).where("lat <= 90 and lon between -180 and 180")
    return matching.nearby(wrapped(views.pickups(spark, d)), wrapped(views.meeting_points(spark, d)), 40_000.0, digits=2)


@query
def link_candidates(spark, d):
    return matching.link_candidates(*views.two_feeds(spark, d), 800.0, 2, digits=3)


@query
def linked_places(spark, d):
    """The places of two feeds under one schema, linked one to one."""
    a, b = views.two_feeds(spark, d)
    links = matching.linked(a, b, 800.0, 2, digits=3)
    return matching.unified(a, b, links, ("stops", "other"))
