"""Typo candidates. They are only proposed: a person approves a table of corrections, which is then applied.

Pairs of strings at most k edits apart are found by equi-joins for any k; no pair is missed and no cross join is needed. n is the length of the shorter, m that of the longer one.

Long strings, from 2 (k + 1) characters on, are cut: of the shorter one's k + 1 equal parts one is touched by no edit, and the other string holds it, at most (k - (m - n)) / 2
places before its own place and (k + m - n) / 2 behind, as what shifts it one way must be made up for the other way.

Short ones, whose parts would be a character each, lose characters: both keep a common subsequence of m - k characters, so they meet in one of the
strings left when the longer loses k characters and the shorter k - (m - n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import haversine


def shorter_ones(s: Column) -> Column:
    """The strings that a loss of one character makes of each of an array of strings."""
    without = lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)))
    return F.array_distinct(F.flatten(F.transform(s, lambda v: F.when(F.length(v) > 0, without(v)).otherwise(F.array(v)))))


def by_losses(strings: DataFrame, k: int, bound: int) -> DataFrame:
    """(x, y) of strings (s, n), x under `bound` characters and y as long or longer, that a loss of up to k characters can make equal."""
    left, levels = strings.where(F.col("n") < bound + k), [F.array("s")]
    for j in range(k):
        left = left.withColumn(f"l{j}", levels[-1])
        levels.append(shorter_ones(F.col(f"l{j}")))
    left = left.withColumn(f"l{k}", levels[-1])
    longer = left.select(F.col("s").alias("y"), F.col("n").alias("m"), F.explode(f"l{k}").alias("kept"))
    asked = F.array(*[F.struct((F.col("n") + d).alias("m"), F.col(f"l{k - d}").alias("kept")) for d in range(k + 1)])
    shorter = left.where(F.col("n") < bound).select(F.col("s").alias("x"), F.explode(asked).alias("a")).select("x", "a.m", F.explode("a.kept").alias("kept"))
    return shorter.join(longer, ["m", "kept"]).select("x", "y")


def by_parts(strings: DataFrame, k: int, bound: int) -> DataFrame:
    """(x, y) of strings (s, n), x of `bound` characters or more and y as long or longer, that share one of x's k + 1 parts about its place."""
    numbers = F.sequence(F.lit(0), F.lit(k))
    begin = lambda length, i: F.floor(length * i / (k + 1)).cast("int")
    size = begin(F.col("n"), F.col("i") + 1) - begin(F.col("n"), F.col("i"))
    parts = strings.where(F.col("n") >= bound).select(F.col("s").alias("x"), "n", F.explode(numbers).alias("i"))
    parts = parts.select("x", "n", "i", F.substr("x", begin(F.col("n"), F.col("i")) + 1, size).alias("part"))
    asked = strings.select(F.col("s").alias("y"), F.col("n").alias("m"), F.explode(F.transform(numbers, lambda d: F.col("n") - d)).alias("n")).where(F.col("n") >= bound)
    more = F.col("m") - F.col("n")
    shifts = F.sequence(-F.floor((k - more) / 2).cast("int"), F.floor((k + more) / 2).cast("int"))
    asked = asked.select("y", "n", shifts.alias("shifts"), F.explode(numbers).alias("i"))
    asked = asked.select("y", "n", "i", size.alias("size"), F.explode(F.transform("shifts", lambda d: begin(F.col("n"), F.col("i")) + d)).alias("at")).where("at >= 0 and at + size <= length(y)")
    asked = asked.select("y", "n", "i", F.substr("y", F.col("at") + 1, F.col("size")).alias("part")).distinct()
    return parts.join(asked, ["n", "i", "part"]).select("x", "y")


def close_pairs(names: DataFrame, column: str, k: int = 2) -> DataFrame:
    """(a, b, distance), a < b: the distinct strings at most k edits apart, for any k of 1 or more. Nulls are left out; an empty string is a string."""
    if k < 1:
        raise ValueError("k is 1 or more")
    strings = names.select(F.col(column).alias("s")).where("s is not null").distinct().withColumn("n", F.length("s"))
    bound = 2 * (k + 1)
    met = by_parts(strings, k, bound).unionByName(by_losses(strings, k, bound))
    pairs = met.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", k)).where("distance >= 0")


def token_pairs(names: DataFrame, column: str, k: int = 2) -> DataFrame:
    """close_pairs of the words inside the strings."""
    return close_pairs(names.select(F.explode(F.split(column, r"[^\p{L}\p{N}]+")).alias("token")).where("token != ''"), "token", k)


def with_distance(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """pairs (a, b, distance) with dist_m between their consensus points in places (name, lon, lat); null where either has none."""
    a, b = places.toDF("a", "alon", "alat"), places.toDF("b", "blon", "blat")
    far = haversine(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat"))
    return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", "distance", far.alias("dist_m"))


def typo_candidates(names: DataFrame, column: str, places: DataFrame, k: int = 2) -> DataFrame:
    return with_distance(close_pairs(names, column, k), places)
