"""Canonical places: dirty labels are split, tidied, aliased, grouped and voted on; geometry checks every merge.

Work is done once for each distinct label. routes have feature_ord (the order in the document, which settles every tie), ORGN, DSTN and pts. Rule tables
are arguments: aliases (alias, target) match a tidied place exactly, preferred (key, display) overrides a group's vote. A label may be on a third of all rows: what
is known of it is looked up, and its median found, without its rows in one task (operators.skew). The dictionary of labels and the medians are worked out when an operator
that needs them is called, and kept in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import haversine
from waymark.functions.labels import canonical_key, split_via, station_words, tidy
from waymark.operators.skew import lookup, medians
from waymark.shared import checkpointed

WARN_M = 1000.0


def endpoints(routes: DataFrame) -> DataFrame:
    """(name, ord, lon, lat): two rows a route. Routes of under two points count, but give no point."""
    near = F.when(F.size("pts") >= 2, F.get("pts", F.lit(0)))
    far = F.when(F.size("pts") >= 2, F.try_element_at("pts", F.lit(-1)))
    both = F.array(F.struct(F.col("ORGN").alias("name"), (2 * F.col("feature_ord")).alias("ord"), near.alias("p")), F.struct(F.col("DSTN").alias("name"), (2 * F.col("feature_ord") + 1).alias("ord"), far.alias("p")))
    return routes.select(F.explode(both).alias("e")).select("e.name", "e.ord", F.get("e.p", F.lit(0)).alias("lon"), F.get("e.p", F.lit(1)).alias("lat"))


def names(ends: DataFrame) -> DataFrame:
    """(name, cnt, first_ord) of the distinct labels."""
    return ends.groupBy("name").agg(F.count("*").alias("cnt"), F.min("ord").alias("first_ord"))


def consensus(ends: DataFrame) -> DataFrame:
    """(name, lon, lat): component-wise medians of the points that claim a label; labels without a point are missing."""
    return medians(ends.where("lon is not null"), "name", "lon", "lat")


def resolved(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """labels (name, ...) with place, via and key. The alias is looked up before the station words change."""
    split = split_via(labels, "name").withColumn("tidied", tidy(F.col("place")))
    rules = aliases.groupBy("alias").agg(F.min("target").alias("target"))  # of rules that differ the first by name
    found = split.join(rules, F.col("tidied") == F.col("alias"), "left")
    place = F.nullif(station_words(F.coalesce("target", "tidied")), F.lit(""))
    return found.withColumn("place", place).drop("tidied", "alias", "target").withColumn("key", canonical_key(F.col("place")))


def form_weights(known: DataFrame) -> DataFrame:
    """(key, place, weight): how many endpoints use each form of a group."""
    return known.where("place is not null").groupBy("key", "place").agg(F.sum("cnt").alias("weight"))


def displays(weights: DataFrame, preferred: DataFrame) -> DataFrame:
    """(key, canonical): the preferred form, or that of the largest weight, then the shortest, then the first."""
    voted = weights.groupBy("key").agg(F.min_by("place", F.struct(-F.col("weight"), F.length("place"), F.col("place"))).alias("voted"))
    rules = preferred.groupBy("key").agg(F.min("display").alias("display"))
    return voted.join(rules, "key", "left").select("key", F.coalesce("display", "voted").alias("canonical"))


def dictionary(routes: DataFrame, aliases: DataFrame, preferred: DataFrame) -> DataFrame:
    """(name, cnt, first_ord, place, via, key, canonical) of every distinct label; canonical is null where no place is left."""
    known = resolved(names(endpoints(routes)), aliases)
    return known.join(displays(form_weights(known), preferred), "key", "left")


def normalise_places(routes: DataFrame, aliases: DataFrame, preferred: DataFrame) -> DataFrame:
    """routes with canonical_origin, canonical_destination, via_origin and via_destination. Raw columns stay, so a second run gives the same."""
    entries = checkpointed(dictionary(routes, aliases, preferred).select("name", "canonical", "via", "cnt"))
    made = ("canonical_origin", "canonical_destination", "via_origin", "via_destination")
    out = routes.drop(*made)
    for role, end in (("ORGN", "origin"), ("DSTN", "destination")):
        out = lookup(out, entries.toDF("_name", f"canonical_{end}", f"via_{end}", "_cnt"), role, "_name", "_cnt")
    return out.select(*routes.drop(*made).columns, *made)


def merge_report(routes: DataFrame, aliases: DataFrame, preferred: DataFrame, warn_m: float = WARN_M) -> DataFrame:
    """(canonical, name, cnt, first_ord, dist_m, spread_m, review): the labels of every place that unites two or more.

    The base of a place is its most used label, of equals the first seen; dist_m is from the base's consensus to the label's, null where either has no
    point; spread_m is the largest, 0 if there is none; review tells that it exceeds warn_m.
    """
    ends = endpoints(routes)
    members = dictionary(routes, aliases, preferred).where("canonical is not null").select("canonical", "name", "cnt", "first_ord")
    placed = checkpointed(members.join(consensus(ends), "name", "left"))
    base = placed.groupBy("canonical").agg(F.min_by(F.struct("lon", "lat"), F.struct(-F.col("cnt"), F.col("first_ord"))).alias("base"), F.count("*").alias("n")).where("n >= 2").drop("n")
    far = placed.join(base, "canonical").withColumn("dist_m", haversine(F.col("base.lon"), F.col("base.lat"), F.col("lon"), F.col("lat")))
    spread = far.groupBy("canonical").agg(F.coalesce(F.max("dist_m"), F.lit(0.0)).alias("spread_m"))
    return far.join(spread, "canonical").select("canonical", "name", "cnt", "first_ord", "dist_m", "spread_m", exceeds("spread_m", warn_m).alias("review"))


def exceeds(column: str, limit: float) -> Column:
    return F.col(column) > F.lit(limit)


def merge_reviews(report: DataFrame) -> DataFrame:
    """(canonical, spread_m) of the flagged places."""
    return report.where("review").select("canonical", "spread_m").distinct()


def whole_metres(distance: Column) -> Column:
    """A distance as text of ten characters, in whole metres, halves to the even one; a question mark where there is none."""
    return F.when(distance.isNull(), F.lpad(F.lit("?"), 9, " ")).otherwise(F.format_string("%8.0f m", F.bround(distance, F.lit(0))))


def report_lines(report: DataFrame) -> DataFrame:
    """(canonical, nth, cnt, metres, name, review) of a merge report in its order: places by name, the labels of each by use, then as first seen; nth counts them."""
    nth = F.row_number().over(Window.partitionBy("canonical").orderBy(F.desc("cnt"), "first_ord"))
    return report.select("canonical", nth.alias("nth"), "cnt", whole_metres(F.col("dist_m")).alias("metres"), "name", "review").orderBy("canonical", "nth")


def review_lines(reviews: DataFrame) -> DataFrame:
    """(canonical, metres) of merge_reviews in its order: by spread, largest first, then by name."""
    return reviews.orderBy(F.desc("spread_m"), "canonical").select("canonical", whole_metres(F.col("spread_m")).alias("metres"))


def summary(routes: DataFrame, aliases: DataFrame, preferred: DataFrame) -> DataFrame:
    """One row: raw_names, canonical_places, via_endpoint_values."""
    return dictionary(routes, aliases, preferred).agg(
        F.count("*").alias("raw_names"), F.countDistinct("canonical").alias("canonical_places"), F.coalesce(F.sum(F.when(F.col("via").isNotNull(), F.col("cnt"))), F.lit(0)).alias("via_endpoint_values")
    )


def place_members(entries: DataFrame) -> DataFrame:
    """(canonical, n, members): the labels of each place that has two or more, in order of the label."""
    return entries.where("canonical is not null").groupBy("canonical").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("members")).where("n >= 2")


def label_geometry_mismatch(routes: DataFrame, aliases: DataFrame, preferred: DataFrame, limit_m: float) -> DataFrame:
    """(ord, name, canonical, dist_m): endpoints further than limit_m from the consensus of their place's endpoints."""
    known = checkpointed(dictionary(routes, aliases, preferred).where("canonical is not null").select("name", "canonical", "cnt"))
    ends = lookup(endpoints(routes).where("lon is not null"), known, "name", "name", "cnt", "inner")
    centre = medians(ends, "canonical", "lon", "lat").toDF("canonical", "clon", "clat").join(known.groupBy("canonical").agg(F.sum("cnt").alias("cnt")), "canonical")
    far = lookup(ends, checkpointed(centre), "canonical", "canonical", "cnt", "inner").withColumn("dist_m", haversine(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat")))
    return far.where(exceeds("dist_m", limit_m)).select("ord", "name", "canonical", "dist_m")


def own_spread(ends: DataFrame) -> DataFrame:
    """(name, max_m, median_m): how far a label's own points lie from its consensus."""
    placed = ends.where("lon is not null")
    centre = checkpointed(consensus(placed).toDF("name", "clon", "clat").join(placed.groupBy("name").agg(F.count("*").alias("cnt")), "name"))
    far = lookup(placed, centre, "name", "name", "cnt", "inner").select("name", haversine(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat")).alias("m"))
    return far.groupBy("name").agg(F.max("m").alias("max_m")).join(medians(far, "name", "m").toDF("name", "median_m"), "name")
