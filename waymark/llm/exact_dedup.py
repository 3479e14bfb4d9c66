"""Exact duplicates by counting quotient filters.

Every partition builds filters of the 64-bit fingerprints of its texts. A fingerprint's first bits name its slice; of the rest the quotient is kept in unary, as the
places of the runs, and only the remainder is stored, with a count where it stands more than once. Nothing is lost by that, so the filters
of a slice are merged, one task a slice, by their sorted remainders, and give the exact number of every fingerprint. One that stands once has no copy, and its text goes nowhere. The texts
of all others are compared as bytes, copies of a partition as one before the shuffle, so that texts which share a fingerprint only stay apart.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import hot_join, written

#: Fingerprints of a filter while it is built, about those of a merged slice, and the fewest bits that name a slice.
HELD, SLICE, FEWEST = 1 << 20, 1 << 22, 5
FILTERS = "slice int, quotient_bits int, runs binary, remainders binary, repeated binary, counts binary"


def encoded(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[int, bytes, bytes, bytes, bytes]:
    """A filter of sorted different keys of so many bits with their counts: its quotient bits, runs, remainders, which of them repeat, and the counts of those."""
    n = len(keys)
    quotient = min(bits, n.bit_length())
    rest = bits - quotient
    high = (keys >> np.uint64(rest)).astype(np.int64) if quotient else np.zeros(n, np.int64)
    runs = np.zeros((1 << quotient) + n, np.uint8)
    runs[high + np.arange(n)] = 1
    low = (keys & np.uint64((1 << rest) - 1)).astype("<u8")
    stored = low.view(np.uint8).reshape(n, 8)[:, : -(-rest // 8)]
    more = counts > 1
    return quotient, np.packbits(runs).tobytes(), stored.tobytes(), np.packbits(more).tobytes(), counts[more].astype("<u8").tobytes()


def decoded(quotient: int, runs: bytes, remainders: bytes, repeated: bytes, counts: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of a filter."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(runs, np.uint8)))
    n, rest = len(at), bits - quotient
    low = np.zeros((n, 8), np.uint8)
    low[:, : -(-rest // 8)] = np.frombuffer(remainders, np.uint8).reshape(n, -(-rest // 8))
    high = (at - np.arange(n)).astype(np.uint64)
    keys = low.view("<u8").ravel() | (high << np.uint64(rest) if quotient else np.uint64(0))
    number = np.ones(n, np.int64)
    number[np.unpackbits(np.frombuffer(repeated, np.uint8))[:n] == 1] = np.frombuffer(counts, "<u8")
    return keys, number


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with counts, those of equal keys added."""
    if len(parts) == 1:
        return parts[0]
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")  # merges sorted runs
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def filters(fps: DataFrame, slice_bits: int) -> DataFrame:
    """The filters of each partition of fps (fp), by slice."""
    bits = 64 - slice_bits

    def built(values: np.ndarray) -> pa.RecordBatch:
        keys, counts = np.unique(values.view(np.uint64), return_counts=True)
        at = (keys >> np.uint64(bits)).astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rest = keys & np.uint64((1 << bits) - 1)
        made = [(int(at[a]), *encoded(rest[a:b], counts[a:b], bits)) for a, b in zip(begin, [*begin[1:], len(keys)], strict=True)]
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], [x.split()[0] for x in FILTERS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for batch in batches:
            if batch.num_rows:
                some.append(batch.column(0).to_numpy())
                n += batch.num_rows
            if n >= HELD:
                yield built(np.concatenate(some))
                some, n = [], 0
        if n:
            yield built(np.concatenate(some))

    return fps.select("fp").mapInArrow(run, FILTERS)


def counted(fps: DataFrame, slice_bits: int) -> DataFrame:
    """(fp, n) of the fingerprints that stand more than once, n their exact number."""
    bits = 64 - slice_bits

    def several(at: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        more = counts > 1
        full = keys[more] | np.uint64(at << bits)
        return pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(counts[more].astype(np.int64))], ["fp", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        for at, some in itertools.groupby(rows, key=lambda r: r[0]):
            parts: list = []
            for _, *row in some:
                parts.append(decoded(*row, bits))
                while len(parts) > 1 and len(parts[-2][0]) <= 2 * len(parts[-1][0]):  # like sizes first, so each key is merged a few times only
                    parts[-2:] = [merged(parts[-2:])]
            yield several(at, *merged(parts))

    return filters(fps, slice_bits).repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "fp long, n long")


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", normalise: Callable[[Column], Column] = lambda t: t, bits: int = 64) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), one row a row of docs: the largest key among the rows of an equal text, how many they are, whether this row stays, and the text's digest.

    Texts are equal if all their bytes are, once `normalise` is applied; it changes nothing unless one is given. A null text counts as empty. Of rows that agree in
    key and text one stays. A null key is below all others: such a row stays only in a group without keys, and keep_id is then null. Extra columns of docs are left out.
    bits: of the fingerprint; fewer make the work of the comparison only.
    """
    plain = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(normalise(F.col(f"`{text}`").cast("string")), F.lit("")).alias("text"))
    plain = plain.withColumn("fp", F.shiftleft(F.xxhash64("text"), 64 - bits) if bits < 64 else F.xxhash64("text"))
    marks = written(plain.select("id", "fp", F.unhex(F.sha2("text", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")))
    slice_bits = max(FEWEST, (marks.count() // SLICE).bit_length())
    several = written(counted(marks, slice_bits))
    texts = hot_join(plain, several, ["fp"]).groupBy("fp", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    classes = written(texts.select("fp", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "n"))
    equal = hot_join(marks, classes, ["fp", "sha"]).where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("fp", "sha").agg(F.min("row").alias("first"))
    chosen = written(classes.join(equal, ["fp", "sha"]).withColumn("group_size", F.col("n")))
    found = hot_join(marks, chosen, ["fp", "sha"], "left")
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def oracle() -> str:
    whole = "coalesce(text, '')"
    return f"select doc_id, max(doc_id) over (partition by {whole}) as keep_id, count(*) over (partition by {whole}) as group_size, doc_id = max(doc_id) over (partition by {whole}) as kept, sha256({whole}) as text_sha256 from documents"
