"""Integrity of feeds: keys, order, formats, ranges, calendars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import in_box, repeats_point
from waymark.functions.labels import is_time
from waymark.operators.ordered import breaks_in_file, repeated_points

DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key isn't in parent."""
    return child.join(parent.select(F.col(parent_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def usage(parent: DataFrame, child: DataFrame, key: str, child_key: str) -> DataFrame:
    """(key, n): how many child rows use each parent, 0 for unused ones."""
    used = child.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("_n"))
    return parent.select(key).join(used, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_n", F.lit(0)).alias("n"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of the keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def breaks_in_order(df: DataFrame, group: str, number: str, *order: str) -> DataFrame:
    """Rows whose number isn't above that of the row before in their group."""
    before = F.lag(number).over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("before", before).where(F.col(number) <= F.col("before"))


def service_dates(calendar: DataFrame) -> DataFrame:
    """(service_id, date): the days from start_date to end_date, both included, whose flag is set."""
    days = calendar.select("service_id", F.array(*DAYS).alias("_flags"), F.explode(F.sequence("start_date", "end_date")).alias("date"))
    return days.where(F.get("_flags", F.dayofweek("date") - 1) == 1).select("service_id", "date")


def calendar_label_check(calendar: DataFrame) -> DataFrame:
    """(service_id, label, fits): a service that is named for weekdays, Saturdays or Sundays has those days and no others."""
    week = sum(F.col(d) for d in DAYS[1:6])
    fits = F.when(F.col("label") == "weekdays", (week == 5) & (F.col("saturday") == 0) & (F.col("sunday") == 0)).when(F.col("label") == "saturdays", (week == 0) & (F.col("saturday") == 1) & (F.col("sunday") == 0)).when(F.col("label") == "sundays", (week == 0) & (F.col("saturday") == 0) & (F.col("sunday") == 1))
    return calendar.select("service_id", "label", fits.alias("fits"))


def integrity_report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n_bad), one row a check: the number of rows each of the DataFrames holds."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("check"), F.count("*").alias("n_bad")) for name, df in checks.items()])


#: The keys of a feed's tables, and which columns are keys of which tables.
KEYS = {"routes": ("route_id",), "trips": ("trip_id",), "stops": ("stop_id",), "calendar": ("service_id",), "stop_times": ("trip_id", "stop_sequence")}
REFERENCES = (("trips", "route_id", "routes"), ("trips", "service_id", "calendar"), ("stop_times", "trip_id", "trips"), ("stop_times", "stop_id", "stops"), ("trips", "shape_id", "shapes"))


def label_of(service: Column) -> Column:
    """What a service is named for: weekdays, saturdays, sundays, or other."""
    found = F.when(F.rlike(service, F.lit("(?i)week[ _-]?day")), "weekdays")
    return found.when(F.rlike(service, F.lit("(?i)saturday")), "saturdays").when(F.rlike(service, F.lit("(?i)sunday")), "sundays").otherwise("other")


def reference_report(child: DataFrame, parent: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """(check, n_bad) in two rows: child rows whose key isn't in parent, and keys of parent that no child has. One join of the distinct keys, counted before the shuffle; a null key leads nowhere."""
    used = child.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    known = parent.select(F.col(key).alias("_p")).distinct().withColumn("_is", F.lit(True))
    both = used.join(known, F.col("_k") == F.col("_p"), "full_outer")
    one = both.agg(F.coalesce(F.sum(F.when(F.col("_is").isNull(), F.col("_n"))), F.lit(0)).alias("lost"), F.count_if(F.col("_n").isNull()).alias("idle"))
    c, p = names
    return one.select(F.explode(F.array(F.struct(F.lit(f"{c} without {p}").alias("check"), F.col("lost").alias("n_bad")), F.struct(F.lit(f"{p} without {c}").alias("check"), F.col("idle").alias("n_bad")))).alias("r")).select("r.*")


def feed_report(feed: dict[str, DataFrame], box: tuple[float, float, float, float], file_order: tuple[str, ...] = ("stop_sequence",)) -> DataFrame:
    """(check, n_bad) of every check that the tables of a feed allow: keys that lead nowhere, rows that nothing leads to, repeated keys, the order of stops, times,
    places outside the box, points that repeat, and services whose days aren't those of their name.

    stop_times read with positions are checked in the order of their file, block by block; without, `file_order` are columns that give it. shapes have a row a point,
    as they are read, or pts. calendar may have a label; without, the id of a service is its name.
    """
    checks, reports = {}, []
    for child, key, parent in REFERENCES:
        if child in feed and parent in feed and key in feed[child].columns:
            reports.append(reference_report(feed[child], feed[parent], key, (child, parent)))
    for table, keys in KEYS.items():
        if table in feed:
            checks[f"repeated keys of {table}"] = duplicates(feed[table], *keys)
    if "stop_times" in feed:
        times = feed["stop_times"]
        in_file = {"_block", "_row"} <= {*times.columns}
        checks["stop_sequence not rising"] = breaks_in_file(times, "trip_id", "stop_sequence") if in_file else breaks_in_order(times, "trip_id", "stop_sequence", *file_order)
        checks["times not well formed"] = times.where(~F.coalesce(is_time(F.col("arrival_time")), F.lit(False)))
    if "stops" in feed:
        checks["stops outside the box"] = feed["stops"].where(~F.coalesce(in_box(F.col("stop_lon"), F.col("stop_lat"), *box), F.lit(False)))
    if "shapes" in feed:
        checks["shapes that repeat a point"] = feed["shapes"].where(repeats_point(F.col("pts"))) if "pts" in feed["shapes"].columns else repeated_points(feed["shapes"]).select("shape_id").distinct()
    if "calendar" in feed:
        named = feed["calendar"]
        checks["services unlike their name"] = calendar_label_check(named if "label" in named.columns else named.withColumn("label", label_of(F.col("service_id")))).where("not fits")
    return reduce(DataFrame.unionByName, reports + ([integrity_report(checks)] if checks else []))


def od_pairs(routes: DataFrame) -> DataFrame:
    return routes.select("ORGN", "DSTN").distinct()


def od_counts(routes: DataFrame) -> DataFrame:
    """One row: how many different pairs of raw labels normalised routes have, and how many of canonical places."""
    pairs = lambda a, b: F.count_distinct(F.struct(a, b))
    return routes.agg(pairs("ORGN", "DSTN").alias("before"), pairs("canonical_origin", "canonical_destination").alias("after"))


def od_multipath(routes: DataFrame) -> DataFrame:
    """(ORGN, DSTN, n_paths) of the pairs with several different paths. Paths are told apart by digests of 256 bits, so they aren't shuffled."""
    return routes.groupBy("ORGN", "DSTN").agg(F.countDistinct(F.unhex(F.sha2(F.to_json("pts"), 256))).alias("n_paths")).where("n_paths > 1")
