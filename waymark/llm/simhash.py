"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 2 bits differ in at most 2 of their 8 bytes, so a linked pair shares at least 6
positional bytes: that count is the filter. A posting list of one positional byte would hold a 256th of all fingerprints, and tallying its pairs would be quadratic,
so the tally is taken in the index: a posting's key is six positional bytes at once, 28 keys a fingerprint, and a pair meets if and only if its tally of shared
bytes reaches six; with fewer it is no candidate (`needed` sets the count). Then the bits are compared. The members of a list differ in two bytes only, so there are
65,536 at most however large the corpus is: no list is hot, and none needs another way. Only distinct fingerprints are indexed, so copies cost nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import checkpointed, hot_join, map_texts, written

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Positional bytes that a linked pair is guaranteed to share, of eight.
NEEDED = 8 - DISTANCE


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """The space-joined runs of `size` words of the text in lower case (A-Z), repeats included; all its words if fewer."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """The fingerprint of each text: a bit is set if it is set in over half of the hashes of the shingles."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        parts = shingles(t)
        hashes += [digest(p, SEED) for p in parts]
        sizes.append(len(parts))
    ones = np.zeros((len(texts), 64), np.int64)
    if hashes:
        size = np.array(sizes)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        # blocks of at most 255 hashes of one text, so that eight byte-wide counters fit a word
        blocks = -(-size // 255)
        owner = np.repeat(np.arange(len(size)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view("<u8")
        sums = np.add.reduceat(bits, first[owner] + 255 * nth, axis=0).view(np.uint8)
        np.add.at(ones, owner, sums)
    over = 2 * ones > np.array(sizes).reshape(-1, 1)
    return np.packbits(over, axis=1, bitorder="little").view("<i8").ravel()


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a long column fp. Narrow."""

    def made(texts: list[str | None]) -> dict[str, list]:
        return {"fp": fingerprints(texts)}

    return map_texts(docs, text, made, T.StructType([T.StructField("fp", T.LongType())]))


def masks(needed: int) -> list[int]:
    """The bits of each choice of so many positional bytes, as signed longs."""
    every = (sum(0xFF << 8 * p for p in at) for at in itertools.combinations(range(8), needed))
    return [m - (1 << 64) if m >> 63 else m for m in every]


def postings(fps: DataFrame, needed: int = NEEDED) -> DataFrame:
    """(at, bits, fp): for each choice of `needed` positional bytes which it is, and these bytes."""
    keys = [F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks(needed))]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp").select("key.at", "key.bits", "fp")


def pairs_of(lists: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """(a, b, tally), a < b, of the sorted posting lists: the pairs of each list at most `distance` bits apart, and how many positional bytes they share."""
    left = tuple(np.zeros(0, np.int64) for _ in range(3))
    empty = [False]
    for batch in itertools.chain(lists, empty):
        at, bits, fp = (np.concatenate([x, batch.column(i).to_numpy()]) if batch else x for i, x in enumerate(left))
        if not len(fp):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (bits[1:] != bits[:-1])]))
        size = np.diff(np.concatenate([new, [len(fp)]]))
        if batch:  # the last list may go on
            left = tuple(x[new[-1] :] for x in (at, bits, fp))
            new, size = new[:-1], size[:-1]
        rest = np.repeat(size, size) - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)) - 1  # members after this one
        here, step = np.flatnonzero(rest > 0), 1
        while len(here):
            a, b = fp[here], fp[here + step]
            differ = (a ^ b).astype(np.uint64)
            near = np.bitwise_count(differ) <= distance
            shared = (differ[near].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[near]), pa.array(np.maximum(a, b)[near]), pa.array(shared.astype(np.int32))], ["a", "b", "tally"])
            step += 1
            here = here[rest[here] >= step]


def links(fps: DataFrame, needed: int = NEEDED, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints at most `distance` bits apart."""
    lists = postings(fps, needed).repartition("at", "bits").sortWithinPartitions("at", "bits")
    return lists.mapInArrow(lambda b: pairs_of(b, distance), "a long, b long, tally int").where(F.col("tally") >= needed).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) can reach, by alternating large and small stars.

    Each round ties every node's larger neighbours, then its smaller ones, to the smallest node it knows; the tree ends as stars, after rounds in the order of
    the squared logarithm of the longest chain. A hot node's neighbours are never gathered: rounds are joins with an aggregate. The lineage is cut each round.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v").distinct())
        before = now


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id): one row a row of docs. component_id is the smallest key of a linked document, the document's own included.

    Equal fingerprints link; so do those at most two bits apart, and links chain. A text without words (empty, blank, null) has fingerprint zero and
    links like any other. Rows whose key is null belong to their component but don't name it; it is null if all its keys are.
    Extra columns of docs are left out. Copies are grouped by fingerprint before anything is joined, and the rows of a hot one stay where they are.
    """
    known = checkpointed(with_fingerprint(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), "text").select("id", "fp"))
    classes = checkpointed(known.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    tied = components(links(classes.select("fp")))
    rooted = classes.join(tied, classes.fp == tied.node).select("fp", "least", "root")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    every = written(classes.join(by_fp, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    return hot_join(known, every, ["fp"]).select(F.col("id").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one of the rows with a key of each component: that of the smallest key, and where it repeats that of the smallest hash of the text.

    Rows are chosen by themselves: one whose key repeats in other components is kept or dropped by its own. Rows that agree in key and text are told apart
    by a number that is written with them. Rows without a key link documents but stay. Columns stay.
    """
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.struct(*fields).alias("row"))
    numbered = with_fingerprint(rows.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()}), "text")
    known = written(numbered.drop("text"))
    best = known.where("id is not null").groupBy("fp").agg(F.min(F.struct("id", "h", "n")).alias("best"))
    tied = components(links(known.select("fp").distinct()))
    rooted = best.join(tied, best.fp == tied.node, "left").select(F.coalesce("root", "fp").alias("root"), "best")
    chosen = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.n").alias("n"))
    kept = known.where("id is not null").join(chosen, "n", "left_semi").select("row").unionAll(known.where("id is null").select("row"))
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def hexadecimal(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
