"""Routes from and to a GeoJSON FeatureCollection.

Members that the library doesn't know pass through untouched, wherever they stand: every feature is kept as its raw text, and so are the members of the collection.
Only the derived fields are put into a feature's properties, in the place of those that it has already, so a second run gives the same text.

One document is read by many tasks. Whether a byte is in a string, and how deep, depends on all before it; so each chunk first says how it would end for each way in which it can
begin, which is a few numbers, these are chained, and then every chunk is cut into the features that begin in it. A folder of parts, in the order of their names, is one document, and such
is what is written: sorted parts by many tasks, the head in the first and the foot in the last, which Spark commits together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import points

DERIVED = ("canonical_origin", "canonical_destination", "via_origin", "via_destination")
decode = json.JSONDecoder().raw_decode
encode = json.JSONEncoder(ensure_ascii=False).encode
PASSED = {signs: re.compile(rf"[\s{signs}]*").match for signs in ("", ":", ",")}


def after(text: str, at: int, signs: str = "") -> int:
    """The first place from `at` on that is neither white space nor one of the signs."""
    return PASSED[signs](text, at).end()


def members(text: str, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """(name, where its value begins, where it ends) of the members of the object that begins at `at`. The values are only passed over."""
    at = after(text, after(text, at) + 1)
    while text[at] != "}":
        name, at = decode(text, at)
        begin = after(text, at, ":")
        _, end = decode(text, begin)
        yield name, begin, end
        at = after(text, end, ",")


def put_together(parts: list[tuple[str, str]]) -> str:
    return "{" + ",".join(f"{encode(name)}:{raw}" for name, raw in parts) + "}"


#: Bytes of a chunk, and bytes read at a time where a feature goes on behind its chunk.
CHUNK, MORE = 16 << 20, 1 << 20
#: The ways in which a chunk can begin: outside a string, inside one, and inside one behind a backslash.
OUT, IN, ESCAPED = 0, 1, 2
STEP = np.zeros(256, np.int8)
STEP[[*b"{["]], STEP[[*b"}]"]] = 1, -1
IS_SIGN = STEP != 0
IS_SIGN[ord(",")] = True
FEATURES = re.compile(rb'"features"\s*:\s*')


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a document in order: one, or those of a folder by name."""
    system, at = filesystem(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = [i for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and i.base_name[0] not in "._"]
        return [(i.path, i.size) for i in sorted(found, key=lambda i: i.base_name)]
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return [(at, info.size)]


class Document:
    """The bytes of the files of a path, one after another."""

    def __init__(self, path: str, files: list[tuple[str, int]]):
        self.system, self.files = filesystem(path)[0], files
        self.size = sum(n for _, n in files)

    def read(self, begin: int, end: int) -> bytes:
        out, at = [], 0
        for path, n in self.files:
            if at < end and begin < at + n:
                with self.system.open_input_file(path) as f:
                    a = max(begin - at, 0)
                    out.append(f.read_at(min(end - at, n) - a, a))
            at += n
        return b"".join(out)


class Signs:
    """The signs of structure in some bytes: their places, whether each is in a string, and what it does to the depth."""

    def __init__(self, data: bytes, way: int):
        if way == ESCAPED:
            data = b" " + data[1:]
        some = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(some == 34)
        slashes = np.flatnonzero(some == 92)
        runs = np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) > 1, slashes, 0))
        plain = slashes[(slashes - runs) % 2 == 0] + 1  # behind an odd number of backslashes, if a quote is there
        plain = plain[plain < len(some)]
        plain = plain[some[plain] == 34]
        mark = np.zeros(len(some), np.uint8)
        mark[quotes] = 1
        mark[plain] = 0
        inside = np.bitwise_xor.accumulate(mark) ^ (way != OUT) if len(some) else mark
        self.quotes = np.flatnonzero(mark)
        at = np.flatnonzero(IS_SIGN[some])
        self.at = at[inside[at] == 0]
        self.step = STEP[some[self.at]]
        self.depth = np.cumsum(self.step, dtype=np.int64)
        ends_in = bool(inside[-1]) if len(some) else way != OUT
        self.end = OUT if not ends_in else ESCAPED if self.backslashes(data, len(data)) % 2 else IN

    @staticmethod
    def backslashes(data: bytes, end: int) -> int:
        """How many stand right before a place."""
        return end - len(data[:end].rstrip(b"\\")) if end < 64 else next((k for k in range(end) if data[end - 1 - k] != 92), end)

    def commas(self) -> dict[int, int]:
        """By depth, counted from the chunk's begin, how many commas stand there."""
        depths, counts = np.unique(self.depth[self.step == 0], return_counts=True)
        return dict(zip(depths.tolist(), counts.tolist(), strict=True))


SUMMARY = "n int, way int, ending int, change long, lowest long, commas map<long,long>"


def summaries(path: str, files: list[tuple[str, int]], chunk: int):
    """Chunk numbers to how each chunk ends, by the ways in which it can begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = Document(path, files)
        for batch in batches:
            for n in batch.column(0).to_pylist():
                data = doc.read(max(0, n * chunk - 1), (n + 1) * chunk)
                ways = (OUT,) if n == 0 else (OUT, IN, ESCAPED) if data[:1] == b"\\" else (OUT, IN)
                if n == 0 and data[:3] == b"\xef\xbb\xbf":
                    data = b"   " + data[3:]
                rows = []
                for way in ways:
                    signs = Signs(data[n > 0 :], way)
                    rows.append((n, way, signs.end, int(signs.depth[-1]) if len(signs.depth) else 0, int(signs.depth.min(initial=0)), [*signs.commas().items()]))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.map_(pa.int64(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], "n way ending change lowest commas".split())

    return run


def head_of(doc: Document, chunk: int) -> tuple[int, int]:
    """Where the array of features begins, or -1, and how many commas stand at its depth before it. Reads up to there."""
    end = 0
    while end < doc.size:
        end = min(doc.size, max(chunk, 2 * end))
        data = doc.read(0, end)
        signs = Signs(b"   " + data[3:] if data[:3] == b"\xef\xbb\xbf" else data, OUT)
        for m in FEATURES.finditer(data):
            before = np.searchsorted(signs.at, m.start())
            outside = np.searchsorted(signs.quotes, m.start()) % 2 == 0
            if outside and before and signs.depth[before - 1] == 1 and m.end() < len(data):
                return (m.end() if data[m.end() : m.end() + 1] == b"[" else -1), int(((signs.depth == 2) & (signs.step == 0))[:before].sum())
    return -1, 0


Start = tuple[int, int, int, int]


def starts(doc: Document, first: int, skipped: int, found: dict[tuple[int, int], object], chunk: int) -> list[Start]:
    """(chunk, way, depth, commas at the depth of the features before it) of the chunks in which features stand, from how each chunk ends."""
    way, depth, commas, out = OUT, 0, -skipped, []
    for n in range(-(-doc.size // chunk)):
        end = found[n, way]
        if n > first // chunk and depth <= 1:
            break
        if n >= first // chunk:
            out.append((n, way, depth, commas))
            if n > first // chunk and depth + end.lowest <= 1:
                break
        commas += end.commas.get(2 - depth, 0)
        way, depth = end.ending, depth + end.change
    return out


def cut(doc: Document, start: Start, first: int, chunk: int) -> tuple[list[tuple[int, str]], int]:
    """(number, raw text) of the features that begin in a chunk, and where their array ends, or -1 if it goes on."""
    n, way, depth, commas = start
    base = n * chunk
    data = doc.read(base, base + chunk)
    while True:
        signs = Signs(b"   " + data[3:] if n == 0 and data[:3] == b"\xef\xbb\xbf" else data, way)
        levels = signs.depth + depth
        after = signs.at + base > first
        ends = np.flatnonzero(after & (levels <= 1))
        last = int(signs.at[ends[0]]) if len(ends) else -1
        bars = signs.at[after & (levels == 2) & (signs.step == 0)]
        if last >= 0:
            bars = bars[bars < last]
        begins = bars[bars < chunk].tolist()
        if base <= first < base + chunk:
            begins.insert(0, first - base)
        stops = [*bars.tolist(), *([last] if last >= 0 else [])]
        if not begins or len([b for b in stops if b > begins[-1]]) or base + len(data) >= doc.size:
            break
        data += doc.read(base + len(data), base + len(data) + max(MORE, len(data) - chunk))  # the last feature goes on
    before = commas + int(((levels == 2) & (signs.step == 0) & ~after).sum())
    number = before + (0 if begins and begins[0] == first - base else 1)
    texts = []
    for begin, stop in zip(begins, [s for s in stops if not begins or s > begins[0]], strict=False):
        texts.append((number + len(texts), data[begin + 1 : stop].decode().strip()))
    if len(texts) == 1 and not texts[0][1]:
        texts = []
    return texts, base + last if 0 <= last < chunk or last >= 0 and base + len(data) >= doc.size else -1


def read_routes(spark: SparkSession, path: str, origin: str = "ORGN", destination: str = "DSTN", key: str = "OBJECTID", chunk: int = CHUNK) -> DataFrame:
    """feature_ord, OBJECTID, ORGN, DSTN, geom_type, pts, and members (of the collection) and feature as raw text, one row a feature.

    The document is looked over once when this is called, by a job over its chunks, and read again by what uses the rows. A path that is a folder is one document in parts. The driver holds a few
    numbers for each chunk, and the text before and behind the features.
    """
    files = files_of(path)
    doc = Document(path, files)
    many = -(-doc.size // chunk)
    first, skipped = head_of(doc, chunk)
    known: list[Start] = []
    tasks = min(many, max(spark.sparkContext.defaultParallelism, -(-doc.size // CHUNK)))  # small chunks are several a task
    if first >= 0:
        ends = spark.range(0, many, 1, tasks).select(F.col("id").cast("int").alias("n")).mapInArrow(summaries(path, files, chunk), SUMMARY)
        known = starts(doc, first, skipped, {(r.n, r.way): r for r in ends.collect()}, chunk)
    stop = next((e for e in (cut(doc, s, first, chunk)[1] for s in reversed(known)) if e >= 0), -1)
    text = (doc.read(0, first) + b"null" + doc.read(stop + 1, doc.size) if stop >= 0 else doc.read(0, doc.size)).decode("utf-8-sig").strip()
    rest = put_together([(name, text[b:e]) for name, b, e in members(text)]) if text else "{}"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some, _ = cut(Document(path, files), row, first, chunk)
                for i in range(0, len(some), 1000):
                    number, raw = zip(*some[i : i + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(raw, pa.string())], ["feature_ord", "feature"])

    places = spark.createDataFrame(known, "n int, way int, depth long, commas long")
    rows = (places.repartition(min(tasks, len(known))) if len(known) > 1 else places).mapInArrow(features, "feature_ord long, feature string").withColumn("members", F.lit(rest))
    own = lambda name: F.get_json_object("feature", f"$.properties.{name}")
    kind, coordinates = F.get_json_object("feature", "$.geometry.type"), F.get_json_object("feature", "$.geometry.coordinates")
    return rows.select("feature_ord", own(key).cast("long").alias("OBJECTID"), own(origin).alias("ORGN"), own(destination).alias("DSTN"), kind.alias("geom_type"), points(kind, coordinates).alias("pts"), "members", "feature")


def with_fields(feature: str, fields: dict[str, str | None]) -> str:
    """A feature's raw text with these properties: those that it has are replaced where they stand, others are put last; nulls are written."""
    parts = [(name, feature[b:e]) for name, b, e in members(feature)]
    own = next((raw for name, raw in parts if name == "properties" and raw != "null"), "{}")
    values = {name: own[b:e] for name, b, e in members(own)} | {name: encode(v) for name, v in fields.items()}
    made = put_together([*values.items()])
    if all(name != "properties" for name, _ in parts):
        parts.append(("properties", made))
    return put_together([(name, made if name == "properties" else raw) for name, raw in parts])


def feature_text(routes: DataFrame, last: int | None) -> DataFrame:
    """text: each feature as JSON, with the derived fields, and a comma but for the last, in the order of the rows. A row of an edge of the document passes as it is."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            text = [feature if edge else with_fields(feature, dict(zip(DERIVED, fields, strict=True))) + ("," if at < last else "") for at, edge, feature, *fields in rows]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["text"])

    return routes.select("feature_ord", "edge", "feature", *DERIVED).mapInArrow(written, "text string")


def write_routes(routes: DataFrame, path: str, source: str | None = None) -> None:
    """Writes the routes, with their derived fields, as one FeatureCollection in document order to a new path, a folder of parts. Refuses the path being read.

    The lines of the parts, in the order of their names, are the document's: the head, a feature each, the foot. Parts are sorted by many tasks; small ones are one. Spark commits
    all of them or none, and read_routes takes the folder for the document. join_parts makes a file of it.
    """
    if source is not None and path.rstrip("/") == source.rstrip("/"):
        raise ValueError("the routes are read from this path; write to another one")
    spark = routes.sparkSession
    seen = routes.agg(F.max("feature_ord"), F.min("members")).first()
    rest = seen[1] or '{"type":"FeatureCollection","features":null}'
    begin, end = next((b, e) for name, b, e in members(rest) if name == "features")
    edges = spark.createDataFrame([(-1, rest[:begin] + "["), (1 << 62, "]" + rest[end:])], "feature_ord long, feature string")
    body = routes.select("feature_ord", F.lit(False).alias("edge"), "feature", *DERIVED)
    every = body.unionByName(edges.withColumn("edge", F.lit(True)), allowMissingColumns=True)
    # a sort over the cluster works out its rows twice, so the texts are made behind it
    feature_text(every.repartitionByRange("feature_ord").sortWithinPartitions("feature_ord"), seen[0]).write.text(path)


def join_parts(folder: str, path: str) -> None:
    """Makes one new file of the parts of a document. It appears under its name once it is whole."""
    system, to = filesystem(path)
    if system.get_file_info(to).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    parts, source = files_of(folder), filesystem(folder)[0]
    with system.open_output_stream(f"{to}.part") as out:
        for name, _ in parts:
            with source.open_input_stream(name) as f:
                while block := f.read(MORE):
                    out.write(block)
    system.move(f"{to}.part", to)
