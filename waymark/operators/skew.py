"""Lookups and medians that a hot key can't overload: a label may be on a third of all rows, with as many different points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.shared import checkpointed

#: So many of the most used keys are looked up by broadcast; any other is on less than one in so many rows.
HOT = 500


def lookup(rows: DataFrame, table: DataFrame, column: str, key: str, used: str, how: str = "left") -> DataFrame:
    """rows with the columns of table, but for key and used, where rows[column] is table[key]. table has each key once; `used` says how often, at least in proportion.

    The rows of the HOT most used keys stay where they are and get their entries, HOT at most, by broadcast; the others are joined as Spark sees fit. table is read three
    times: it should be a checkpointed one. how: left or inner. A null matches nothing.
    """
    known = table.where(F.col(key).isNotNull())
    top = known.orderBy(F.desc(used), key).limit(HOT)
    hot, names = F.broadcast(top.drop(used).withColumnRenamed(key, "_key")), F.broadcast(top.select(F.col(key).alias("_hot")))
    cold = known.join(names, F.col(key) == F.col("_hot"), "left_anti").drop(used).withColumnRenamed(key, "_key")
    met = rows.join(hot, F.col(column) == F.col("_key")).drop("_key")
    rest = rows.join(names, F.col(column) == F.col("_hot"), "left_anti").join(cold, F.col(column) == F.col("_key"), how).drop("_key")
    return met.unionByName(rest)


def matched(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with table by keys, nulls equal to each other; the keys are those of rows."""
    other = table.withColumnsRenamed({k: f"_of{k}" for k in keys})
    return rows.join(other, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys]), how).drop(*[f"_of{k}" for k in keys])


def medians(df: DataFrame, group: str, *columns: str) -> DataFrame:
    """(group, columns): the exact median of each of the columns, doubles, in every group; of an even number the mean of the two in the middle. Nulls don't count; a group without a value is missing, and a column without one null.

    Equal values are counted first. What is left is sorted over the cluster by group, column and value; the sizes of a group's stretches tell in which its middle
    ranks lie, and only there ranks are counted. No task holds more than a stretch of the sort, and a group gives a row for each of its stretches.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_which"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(columns)]))
    counted = df.select(F.col(group).alias("_group"), each.alias("e")).select("_group", "e.*").where("_value is not null").groupBy("_group", "_which", "_value").agg(F.count("*").alias("_n"))
    placed = checkpointed(counted.repartitionByRange("_group", "_which", "_value").withColumn("_stretch", F.spark_partition_id()))
    keys = ["_group", "_which"]
    sizes = placed.groupBy(*keys, "_stretch").agg(F.sum("_n").alias("_size"))
    upto = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_stretch"))
    sizes = sizes.withColumns({"_before": upto - F.col("_size"), "_total": F.sum("_size").over(Window.partitionBy(*keys))})
    sizes = sizes.withColumns({"_low": F.floor((F.col("_total") - 1) / 2), "_high": F.floor(F.col("_total") / 2)}).where("_before <= _high and _before + _size > _low")
    middle = matched(placed, sizes, [*keys, "_stretch"])
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_stretch").orderBy("_value"))
    picked = middle.withColumn("_last", last).where("_last > _low and _last - _n <= _high")
    found = picked.groupBy("_group", "_which").agg((F.min("_value") * 0.5 + F.max("_value") * 0.5).alias("_median"))
    return found.groupBy(F.col("_group").alias(group)).agg(*[F.max(F.when(F.col("_which") == i, F.col("_median"))).alias(c) for i, c in enumerate(columns)])


def ranked(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows with _rank, from 0 on by key inside each group, of rows without nulls in either. A sort over the cluster whose stretches are counted, so a group may be of any size."""
    placed = rows.repartitionByRange(group, key).sortWithinPartitions(group, key).withColumns({"_stretch": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = checkpointed(placed)
    sizes = placed.groupBy(group, "_stretch").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_stretch")) - F.col("_n"))
    return placed.join(sizes.hint("merge"), [group, "_stretch"]).withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_stretch", "_at", "_n", "_first", "_before")
