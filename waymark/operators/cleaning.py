"""Cleaning of routes and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import rounded
from waymark.functions.labels import title_case


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row, by `order`, of those that agree in keys. An aggregate and not a window: a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def is_blank(label: Column) -> Column:
    return F.coalesce(F.trim(label), F.lit("")) == ""


def drop_blank_labels(routes: DataFrame) -> DataFrame:
    return routes.where(~is_blank(F.col("ORGN")) & ~is_blank(F.col("DSTN")))


def is_loop() -> Column:
    """Origin and destination are one label; such routes are kept."""
    return F.col("ORGN").eqNullSafe(F.col("DSTN"))


def clean_routes(routes: DataFrame) -> DataFrame:
    """Routes without repeats (of labels and points; the first stays) and blank labels, their coordinates in six decimals, loops flagged."""
    kept = drop_blank_labels(keep_first(routes, ["ORGN", "DSTN", "pts"], "feature_ord"))
    return kept.withColumn("pts", rounded(F.col("pts"))).withColumn("is_loop", is_loop())


def blank_profile(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_filled), one row a column, in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).isNotNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"`{c}`").alias("n_filled")) for c in df.columns])).alias("r")).select("r.*")


def drop_blank_columns(df: DataFrame) -> DataFrame:
    """df without the columns that no row fills. Eager: the schema depends on the data."""
    return df.drop(*[r["column"] for r in blank_profile(df).where("n_filled = 0").collect()])


def redundant_columns(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(column, same_as, redundant): whether a column equals another on all rows."""
    one = df.agg(*[F.coalesce(F.bool_and(F.col(a).eqNullSafe(F.col(b))), F.lit(True)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("column"), F.lit(b).alias("same_as"), F.col(f"r{i}").alias("redundant")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def drop_redundant_columns(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """df without the first column of each pair that is the same on all rows. Eager."""
    return df.drop(*[r["column"] for r in redundant_columns(df, pairs).where("redundant").collect()])


def normalise_text(text: Column) -> Column:
    """Line feeds for CR LF, and no byte order mark."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "^﻿", "")


#: Columns that say the same as another one where they agree on all rows.
DOUBLED = {"stops": [("stop_code", "stop_id")]}


def clean_table(table: str, df: DataFrame) -> DataFrame:
    """A table of a feed with stop names in title case, coordinates in six decimals, and without blank or doubled columns."""
    finer = {c: F.round(c, 6) for c in df.columns if c.endswith(("_lat", "_lon"))}
    names = {"stop_name": title_case(F.col("stop_name"))} if table == "stops" and "stop_name" in df.columns else {}
    tidy = df.withColumns(finer | names) if finer or names else df
    pairs = [p for p in DOUBLED.get(table, []) if {*p} <= {*tidy.columns}]
    return drop_blank_columns(drop_redundant_columns(tidy, pairs) if pairs else tidy)


def clean_stops(stops: DataFrame) -> DataFrame:
    return clean_table("stops", stops)


def clean_gtfs(feed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """clean_table of every table of a feed; line ends and byte order marks are gone once it is read."""
    return {table: clean_table(table, df) for table, df in feed.items()}


def apply_corrections(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """df with exact labels replaced by table (was, now); one hop. Of rules that differ for a label the first by name counts."""
    rules = table.groupBy("was").agg(F.min("now").alias("now"))
    return df.join(rules, F.col(column) == F.col("was"), "left").withColumn(column, F.coalesce("now", column)).drop("was", "now")


def prefix_gaps(stops: DataFrame) -> DataFrame:
    """(base, number, gap): places where the numbers of a base name skip some."""
    step = F.col("number") - F.lag("number").over(Window.partitionBy("base").orderBy("number")) - 1
    return stops.select("base", "number").distinct().withColumn("gap", step).where("gap > 0")
