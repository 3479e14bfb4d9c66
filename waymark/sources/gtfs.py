"""GTFS feeds: header CSV whose known columns have types. Ids are text, times are text (they pass 24 hours), dates are yyyyMMdd."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.integrity import DAYS

SCHEMAS = {
    "agency": "agency_id string, agency_name string, agency_timezone string, agency_lang string",
    "calendar": "service_id string, " + ", ".join(f"{d} int" for d in (*DAYS[1:], DAYS[0])) + ", start_date string, end_date string",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_type int",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string, trip_short_name string, direction_id int, shape_id string",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
}


def read_table(spark: SparkSession, folder: str, table: str, positions: bool = False) -> DataFrame:
    """A table of a feed, its columns found by the header and all kept: those of SCHEMAS with their types, others as text. Line ends of either kind and a byte order mark are taken as they come; absent columns are null.

    positions: also _block, the stretch of the file that a row was read in, and _row, which rises in it: together the order of the file, with nothing sorted.
    """
    path = f"{folder}/{table}.txt"
    text = spark.read.option("header", True).csv(path)
    kinds = dict(c.strip().split(" ") for c in SCHEMAS[table].split(","))
    have = {c.replace("\ufeff", "").strip(): c for c in text.columns}
    place = [F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")] if positions else []
    df = text.select(
        *[(F.col(f"`{raw}`").try_cast(kinds[c]) if c in kinds else F.col(f"`{raw}`")).alias(c) for c, raw in have.items()],
        *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items() if c not in have],
        *place,
    )
    if table == "calendar":
        df = df.withColumns({c: F.try_to_date(c, "yyyyMMdd") for c in ("start_date", "end_date")})
    return df


def read_feed(spark: SparkSession, folder: str, tables: tuple[str, ...] = ("agency", "calendar", "routes", "trips", "stops"), positions: bool = False) -> dict[str, DataFrame]:
    """The tables by name; positions: stop_times with those of its rows in the file, which feed_report then goes by."""
    return {t: read_table(spark, folder, t, positions and t == "stop_times") for t in tables}


def cardinalities(feed: dict[str, DataFrame]) -> DataFrame:
    """(table, n), one row a table."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(t).alias("table"), F.count("*").alias("n")) for t, df in feed.items()])
