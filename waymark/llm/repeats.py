"""Exact removal of long repeated byte strings by prefix-free parsing.

Every text is parsed by a rolling trigger: where the hash of the last 8 bytes falls under a threshold, a phrase ends. Where a phrase ends depends on those bytes
alone, so equal strings are parsed equally wherever they stand. A window of 400 bytes is known by its first phrase end: a proper phrase
suffix up to there (of the dictionary), then the parse from there on; no such suffix is a prefix of another, as the first trigger ends it. All windows
that share a phrase end are one fragment: a left side, the phrase read backwards from its end, and a right side, the phrases that follow, as far as windows reach.

1. For the first 200 places of windows before the end, the 200 bytes after it lie in every window; for the places beyond, the 200 bytes before it. Their hash is
   the key that equal windows meet under. A key that stands once in the corpus settles its fragment: unique. If all fragments of a key are equal, all are repeated.
2. The distinct left sides of the other fragments are the dictionary, their distinct right sides the parse. Both are sorted over the cluster, and the lengths of the
   prefixes that neighbours share are kept: suffix arrays of dictionary and parse, with them the suffix trees: the depths at which each string's path branches.
3. Dictionary and parse combine into corpus order: the windows that begin at a place are next to each other in it, with 400 bytes in common, if their left
   sides pass through one branch of the dictionary's tree and their right sides through one of the parse's. A fragment passes through few such pairs of branches, each
   for a run of places, and the pairs are counted over the cluster. No group is gathered, whatever its size.

A window without a trigger inside ends its first phrase where the hash is least, at the first place of equals.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import checkpointed, few_samples, hot_join, runs, written

LENGTH, GRAM = 400, 8
#: Bytes for each end of a phrase, on average.
PHRASE = 128


def hashes(data: bytes) -> np.ndarray:
    """The hash of the GRAM bytes before each place from GRAM on."""
    n = len(data) - GRAM + 1
    out = np.empty(max(0, n), np.uint64)
    for o in range(min(GRAM, max(0, n))):
        x = np.frombuffer(data, "<u8", (len(data) - o) // GRAM, o) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        out[o::GRAM] = x * np.uint64(0xD6E8FEB86659FD93)
    return out


def ends(h: np.ndarray, phrase: int) -> np.ndarray:
    return np.flatnonzero(h < np.uint64((1 << 64) // phrase)) + GRAM


def served(e: np.ndarray, first: int, last: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the phrase ends e, the least and most bytes before it at which a window among the starts first..last begins whose first end it is."""
    before = np.concatenate([[-length], e[:-1]])
    return np.maximum(GRAM, e - last), np.minimum(np.minimum(length, e - first), e - before + GRAM - 1)


def fragments(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, contents' hashes, places) of the fragments of a text; a place is end << 20 | least << 10 | most."""
    last = len(data) - length
    if last < 0:
        return (np.zeros(0, np.int64),) * 3
    h = hashes(data)
    e = ends(h, PHRASE)
    parts = [(e, *served(e, 0, last, length), 0)]
    # windows without an end: after the end before them, up to those that reach the next
    left, right = np.concatenate([[0], e - GRAM + 1]), np.concatenate([e - length - 1, [last]])
    for k in np.flatnonzero(left <= np.minimum(right, last)).tolist():
        i0, i1 = int(left[k]), min(int(right[k]), last)
        least = np.arange(i0, i1 + 1) + np.lib.stride_tricks.sliding_window_view(h[i0 : i1 + length - GRAM + 1], length - GRAM + 1).argmin(axis=1) + GRAM
        edge = np.flatnonzero(np.diff(least)) + 1
        begin, stop = np.concatenate([[0], edge]), np.concatenate([edge, [len(least)]]) - 1
        parts.append((least[begin], least[begin] - i0 - stop, least[begin] - i0 - begin, 2))
    keys, contents, places = [], [], []
    half, digest = length // 2, xxhash.xxh64_intdigest
    for e, lo, hi, kind in parts:
        for side in (0, 1):
            a, b = (lo, np.minimum(hi, half)) if side == 0 else (np.maximum(lo, half + 1), hi)
            for end, x, y in zip(*(v[a <= b].tolist() for v in (e, a, b)), strict=True):
                content = data[end - y : end - x + length]
                keys.append(digest(data[end : end + half] if side == 0 else data[end - half : end], kind + side))
                contents.append(digest(content))
                places.append(end << 20 | x << 10 | y)
    return np.array(keys, "<u8").view("<i8"), np.array(contents, "<u8").view("<i8"), np.array(places, np.int64)


FRAGMENTS = "id long, th long, key long, content long, place long"
SIDES = "key long, content long, place long, l binary, r binary, hl binary, hr binary"
NEIGHBOURS = "part int, h binary, n long, size int, lcp int, edge binary"
PROFILES = "part int, first binary, last binary, onward array<int>, back array<int>"
BRANCHES = "h binary, n long, depths array<int>"
LOCI = "key long, content long, h1 long, h2 long, least int, most int"


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of a schema as written above."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.field("element", pa.int32()))}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], [f for f, _ in fields])


def parse(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in runs(b, None):
            ids, ths, made, sizes = part.column(0).to_numpy(), part.column(1).to_numpy(), [], []
            for data in part.column(2).to_pylist():
                made.append(fragments(data or b"", length))
                sizes.append(len(made[-1][0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(ths, sizes)), *[pa.array(np.concatenate([m[k] for m in made])) for k in range(3)]], ["id", "th", "key", "content", "place"])


def least_most(place: int) -> tuple[int, int]:
    return place >> 10 & 1023, place & 1023


def sides(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The left sides, backwards, and the right sides of the fragments wanted of texts (data, wanted), each after a byte that keeps near and far places apart."""
    digest = xxhash.xxh3_128_digest
    for b in batches:
        for part in runs(b, None):
            rows = []
            for data, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for w in wanted:
                    end, (lo, hi) = w["place"] >> 20, least_most(w["place"])
                    mark = b"\1" if lo > length // 2 else b"\0"
                    left, right = mark + data[end - hi : end][::-1], mark + data[end : end - lo + length]
                    rows.append((w["key"], w["content"], w["place"], left, right, digest(left), digest(right)))
            yield batch(rows, SIDES)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax()) if x.any() else n


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted strings (part, h, n, s) of a partition: the length of each and of the prefix that it shares with the one before; the string itself of the first and the last."""
    before, held_back = b"", None
    for b in batches:
        for part in runs(b, None):
            strings = part.column(3).to_pylist()
            size = np.fromiter(map(len, strings), np.int64, len(strings))
            pairs = [before, *strings]
            width = max(map(len, pairs))
            bytes_ = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pairs]), np.uint8).reshape(-1, width)
            differ = bytes_[1:] != bytes_[:-1]
            lcp = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(size, [len(x) for x in pairs[:-1]]))
            rows = [list(r) for r in zip(*(part.column(i).to_pylist() for i in range(3)), size.tolist(), lcp.tolist(), [None] * len(strings), strict=True)]
            if held_back is None:
                rows[0][5] = strings[0]
            rows, held_back, before = [*([held_back] if held_back else []), *rows[:-1]], rows[-1], strings[-1]
            yield batch(rows, NEIGHBOURS)
    if held_back:
        held_back[5] = before
        yield batch([held_back], NEIGHBOURS)


def minima(values: list[int], below: int = 1 << 30) -> list[int]:
    """The values that are under all before them."""
    out = []
    for v in values:
        if v < below:
            out.append(v)
            below = v
    return out


def whole(batches: Iterator[pa.RecordBatch]) -> list[list]:
    """The columns of a partition of neighbours but the strings: some numbers a row."""
    found = [*batches]
    return [[x for b in found for x in b.column(i).to_pylist()] for i in range(6)]


def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What other partitions need of a sorted one: its first and last string, and the minima of its shared prefixes from either end."""
    part, _, _, _, lcp, edge = whole(batches)
    if part:
        yield batch([(part[0], edge[0], edge[-1], minima(lcp[1:]), minima(lcp[:0:-1]))], PROFILES)


def outside(found: list) -> dict[int, tuple[list[int], list[int]]]:
    """By partition, the minima of shared prefixes that strings have with those before and after the partition."""
    found = sorted(found, key=lambda r: r["part"])
    seams = [common(bytes(a["last"]), bytes(b["first"])) for a, b in zip(found, found[1:], strict=False)]
    before, after = [[] for _ in found], [[] for _ in found]
    for i in range(1, len(found)):
        before[i] = minima([seams[i - 1], *found[i - 1]["back"], *before[i - 1]])
    for i in range(len(found) - 2, -1, -1):
        after[i] = minima([seams[i], *found[i + 1]["onward"], *after[i + 1]])
    return {r["part"]: x for r, *x in zip(found, before, after, strict=True)}


class Stairs:
    """For strings in order, the falling minima of the prefixes shared with those already seen, as chains that share their ends."""

    def __init__(self, seen: list[int]):
        self.values, self.rest, self.top = [0], [0], 0
        for v in reversed(seen):
            self.step(v)

    def step(self, lcp: int) -> int:
        """The chain of the next string, which shares so much with the last."""
        while self.values[self.top] > lcp:
            self.top = self.rest[self.top]
        if self.values[self.top] < lcp:
            self.values.append(lcp)
            self.rest.append(self.top)
            self.top = len(self.values) - 1
        return self.top

    def chain(self, at: int) -> list[int]:
        out = []
        while at:
            out.append(self.values[at])
            at = self.rest[at]
        return out


def branches(batches: Iterator[pa.RecordBatch], known: dict[int, tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
    """The depths at which a string's path branches, less the mark; its whole length is one if fragments share it."""
    part, h, n, size, lcp, _ = whole(batches)
    if not part:
        return
    before, after = known[part[0]]
    up, down = Stairs(before), Stairs(after)
    left = [up.top, *map(up.step, lcp[1:])]
    right = [down.top, *map(down.step, lcp[:0:-1])][::-1]
    for i in range(0, len(h), 10_000):
        rows = []
        for k in range(i, min(i + 10_000, len(h))):
            depths = {*up.chain(left[k]), *down.chain(right[k])}
            if n[k] > 1:
                depths.add(size[k])
            rows.append((h[k], n[k], sorted(d - 1 for d in depths if d > 0)))
        yield batch(rows, BRANCHES)


def tree(strings: DataFrame, parts: int | None = None) -> DataFrame:
    """(h, n, depths) of distinct strings (h, n, s), h: a digest of 128 bits, n: how many fragments have it. Sorted over the cluster; the driver gets two strings and some lengths of each partition."""
    spread = strings.repartitionByRange(parts, "s") if parts else strings.repartitionByRange("s")
    ordered = spread.sortWithinPartitions("s").select(F.spark_partition_id().alias("part"), "h", "n", "s")
    with few_samples(strings.sparkSession):
        near = checkpointed(ordered.mapInArrow(neighbours, NEIGHBOURS))
    known = outside(near.mapInArrow(profiles, PROFILES).collect())
    sent = strings.sparkSession.sparkContext.broadcast(known)
    return written(near.mapInArrow(lambda b: branches(b, sent.value), BRANCHES))


def loci(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The pairs of branches that a fragment (key, content, place, l, r, left depths, right depths) passes through, as a hash of their strings, and for which places."""
    for b in batches:
        for part in runs(b, None):
            rows = []
            for key, content, place, left, right, dl, dr in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                at, hi = least_most(place)
                if not dr or dr[0]:
                    dr = [0, *dr]
                hi = min(hi, dl[-1] if dl else 0)
                at = max(at, length - dr[-1])
                while at <= hi:
                    v, j = dl[bisect_left(dl, at)], bisect_left(dr, length - at)
                    most = min(hi, v, length - 1 - dr[j - 1] if j else hi)
                    d = xxhash.xxh3_128_digest(left[v:0:-1] + right[1 : dr[j] + 1], v)
                    rows.append((key, content, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), at, most))
                    at = most + 1
            yield batch(rows, LOCI)


def repeated_places(contents: DataFrame, texts: DataFrame, length: int, parts: int | None = None) -> DataFrame:
    """(key, content, ranges) of the different fragments of keys that have several: the places before the end whose windows stand in another one too."""
    # with a shuffle of its own a side can be split where rows that repeat make the other one skewed
    wanted = contents.groupBy("first.id", "first.th").agg(F.collect_list(F.struct("key", "content", "first.place")).alias("wanted")).repartition("id", "th")
    found = written(texts.join(wanted, ["id", "th"]).select("data", "wanted").mapInArrow(lambda b: sides(b, length), SIDES))
    of = lambda h, s: tree(found.groupBy(F.col(h).alias("h")).agg(F.count("*").alias("n"), F.min(s).alias("s")), parts)
    dictionary, after = of("hl", "l"), of("hr", "r")
    known = hot_join(hot_join(found, dictionary.select(F.col("h").alias("hl"), "n", F.col("depths").alias("dl")), ["hl"]), after.select(F.col("h").alias("hr"), "n", F.col("depths").alias("dr")), ["hr"])
    passed = written(known.select("key", "content", "place", "l", "r", "dl", "dr").mapInArrow(lambda b: loci(b, length), LOCI))
    runs_of = passed.groupBy("h1", "h2", "least", "most").agg(F.count("*").alias("n"))
    met = written(runs_of.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.collect_list(F.struct("least", "most", "n")).alias("all")).where("n > 1"))
    x, y = F.col("least"), F.col("most")
    shared = F.transform(F.col("all"), lambda o: F.when((o["least"] != x) | (o["most"] != y) | (o["n"] > 1), F.struct(F.greatest(x, o["least"]).alias("least"), F.least(y, o["most"]).alias("most"))))
    ranges = hot_join(passed, met, ["h1", "h2"]).select("key", "content", F.filter(shared, lambda o: o["least"] <= o["most"]).alias("ranges"))
    return ranges.groupBy("key", "content").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def repeated_spans(found: DataFrame, docs: DataFrame, length: int = LENGTH, parts: int | None = None) -> DataFrame:
    """(id, th, spans) of the texts that hold a repeated string, from their fragments and docs (id, th, row, data). A span is [start, end) in bytes; they may overlap."""
    keys = written(found.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("b")).where("n > 1").select("key", "n", F.expr("a != b").alias("mixed")))
    met = written(hot_join(found, keys, ["key"]))
    mixed = met.where("mixed").drop("mixed")
    contents = written(mixed.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "place")).alias("first")))
    places = repeated_places(contents, docs.select("id", "th", "data"), length, parts)
    end, least, most = (F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(F.lit(1023)), F.col("place").bitwiseAND(F.lit(1023)))
    every = F.array(F.struct(least.cast("int").alias("least"), most.cast("int").alias("most")))
    settled = contents.join(places, ["key", "content"], "left").where("n > 1 or ranges is not null").select("key", "content", "n", F.when(F.col("n") == 1, F.col("ranges")).alias("ranges"))
    ranged = hot_join(mixed, written(settled), ["key", "content"]).select("id", "th", "place", F.coalesce("ranges", every).alias("ranges"))
    ranged = met.where("not mixed").select("id", "th", "place", every.alias("ranges")).unionByName(ranged)
    spans = ranged.select("id", "th", F.explode(F.transform("ranges", lambda r: F.struct((end - r["most"]).alias("start"), (end - r["least"] + length).alias("end")))).alias("span"))
    return spans.groupBy("id", "th").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


KEPT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, parts: int | None = None) -> DataFrame:
    """docs with n_bytes of the text, `removed` (the maximal runs [start, end) of bytes inside strings of `length` bytes that start anywhere else too) and `kept`, the other bytes.

    Matches stay inside a document; overlapping ones count, and all are judged on the input. A null text is empty; a text of under `length` bytes keeps all. Repeated
    rows are copies of each other like any. A document is found again by its key (null counts as one) and a hash of its text. Extra columns stay.
    parts: partitions that strings are sorted into, as many as Spark takes if None.
    """
    kept = [c for c in docs.columns if c not in KEPT.fieldNames()]
    data = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    known = docs.select(F.coalesce(F.xxhash64(F.col(f"`{key}`")), F.lit(0)).alias("id") if dict(docs.dtypes)[key] not in ("bigint", "int") else F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-1)).alias("id"), F.xxhash64(data).alias("th"), data.alias("data"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept) if c != text]).alias("row"))
    found = written(known.select("id", "th", "data").mapInArrow(lambda b: parse(b, length), FRAGMENTS))
    spans = repeated_spans(found, known, length, parts)
    joined = known.join(spans.repartition("id", "th"), ["id", "th"], "left").select("row", "data", "spans")
    out = T.StructType([joined.schema["row"], T.StructField("data", T.BinaryType()), *KEPT.fields])
    types = [pa.int64(), pa.list_(pa.field("element", pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, None):
                made = []
                for data, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    away = merged(spans)
                    edges = [0, *(x for s in away for x in s), len(data)]
                    made.append((len(data), [{"start": a, "end": b} for a, b in away], b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array([m[i] for m in made], t) for i, t in enumerate(types)]], ["row", "data", *KEPT.fieldNames()])

    at = {c: F.col("data").cast("string") if c == text else F.col(f"row.c{i}") for i, c in enumerate(kept)}
    return joined.mapInArrow(cut, out).select(*[x.alias(c) for c, x in at.items()], *KEPT.fieldNames())
