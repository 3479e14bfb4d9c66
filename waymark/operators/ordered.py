"""Scans in an order that don't put a group into one task: work is done inside blocks of the order, and what a block ends with is handed to the group's next block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.skew import matched


def with_previous(df: DataFrame, groups: list[str], block: str, order: list[str], value: str, name: str = "before") -> DataFrame:
    """df with `name`, the value of the row before in its group, null in the group's first row. Rows of a group go by block, and in a block by `order`.

    A task holds rows of one group and block at a time. The rest is a row for each group and block: its last value, which the next one takes, so a group
    of a third of all rows costs a window over its blocks. Null groups are a group. `order` has no ties in a group and block, or the row before is any of them.
    """
    inside = Window.partitionBy(*groups, block).orderBy(*order)
    rows = df.withColumns({"_own": F.lag(value).over(inside), "_nth": F.row_number().over(inside)})
    last = df.groupBy(*groups, block).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    handed = last.withColumn("_last", F.lag("_last").over(Window.partitionBy(*groups).orderBy(block)))
    found = matched(rows, handed, [*groups, block], "left")
    return found.select(*df.columns, F.when(F.col("_nth") == 1, F.col(f"_last.{value}")).otherwise(F.col("_own")).alias(name))


def breaks_in_file(df: DataFrame, group: str, number: str, block: str = "_block", row: str = "_row") -> DataFrame:
    """Rows whose number isn't above that of the row before of their group in the file, with that number as `before`. block and row give the order of the file."""
    return with_previous(df, [group], block, [row], number).where(F.col(number) <= F.col("before"))


def repeated_points(points: DataFrame, shape: str = "shape_id", number: str = "shape_pt_sequence", block: str | None = None, size: int = 1 << 16) -> DataFrame:
    """The points that follow an equal one of their shape, by number. Shapes aren't gathered: blocks of so many numbers are scanned, or those of a column."""
    some = points.withColumn("_at", F.struct("shape_pt_lon", "shape_pt_lat"))
    some = some.withColumn("_block", F.floor(F.col(number) / size) if block is None else F.col(block))
    found = with_previous(some, [shape], "_block", [number], "_at", "_previous")
    return found.where(F.col("_previous.shape_pt_lon").isNotNull() & (F.col("_previous") == F.col("_at"))).select(*points.columns)


def paths(points: DataFrame) -> DataFrame:
    """(shape_id, pts): the points of each shape of a feed, by number, as [longitude, latitude]. Points without a place are left out, and so is a shape without any other. A shape is one row: one path."""
    known = points.where("shape_id is not null and shape_pt_lon is not null and shape_pt_lat is not null")
    line = F.sort_array(F.collect_list(F.struct("shape_pt_sequence", "shape_pt_lon", "shape_pt_lat")))
    return known.groupBy("shape_id").agg(F.transform(line, lambda p: F.array(p["shape_pt_lon"], p["shape_pt_lat"])).alias("pts"))
