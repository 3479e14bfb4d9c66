"""GeoJSON in chunks of any size: features are those of a JSON reader, as they are written."""

import json
import random

import pyarrow as pa
import pytest

from waymark.plans import oracles, queries
from waymark.sources import geojson

R = random.Random(6)


def string():
    return json.dumps("".join(R.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "😀", "\n", '"features":[', " "]) for _ in range(R.randint(0, 12))), ensure_ascii=R.random() < 0.5)


def value(depth=0):
    kind = R.randint(0, 6) if depth < 4 else R.randint(2, 6)
    if kind == 0:
        return "{" + R.choice(["", " "]) + ", ".join(f"{string()} : {value(depth + 1)}" for _ in range(R.randint(0, 3))) + "}"
    if kind == 1:
        return "[" + ",".join(value(depth + 1) for _ in range(R.randint(0, 4))) + R.choice(["", "\n "]) + "]"
    return string() if kind < 5 else R.choice(["1.50", "-2e7", "true", "null", "12345678901234567890"])


def document(n):
    features = [f'{{"type":"Feature","x":{value()},"properties":{value()}}}' for _ in range(n)]
    before = "".join(f'"m{i}": {value()} , ' for i in range(R.randint(0, 3)))
    after = "".join(f', "z{i}":{value()}' for i in range(R.randint(0, 3)))
    blank = R.choice(["", " ", "\n\t"])
    return features, f'{R.choice(["", chr(0xFEFF)])}{blank}{{{before}"features"{blank}:{blank}[{blank}{(blank + "," + blank).join(features)}{blank}]{after}}}{blank}'


def read(path, chunk):
    files = geojson.files_of(path)
    doc = geojson.Document(path, files)
    first, skipped = geojson.head_of(doc, chunk)
    numbers = pa.RecordBatch.from_arrays([pa.array(range(-(-doc.size // chunk)), pa.int32())], ["n"])
    ends = {}
    for batch in geojson.summaries(path, files, chunk)(iter([numbers])):
        for row in batch.to_pylist():
            ends[row["n"], row["way"]] = type("Row", (), row | {"commas": dict(row["commas"])})
    known = geojson.starts(doc, first, skipped, ends, chunk)
    cuts = [geojson.cut(doc, s, first, chunk) for s in known]
    return [x for some, _ in cuts for x in some], [e for _, e in cuts if e >= 0][-1:], doc


@pytest.mark.parametrize("seed", range(12))
def test_chunks_of_any_size(tmp_path, seed):
    R.seed(seed)
    features, text = document(R.randint(0, 12))
    path = tmp_path / "d.geojson"
    path.write_text(text, encoding="utf-8")
    json.loads(text.lstrip("﻿"))
    for chunk in (4, 5, 7, 16, 33, 100, 1000, 1 << 20):
        found, end, doc = read(str(path), chunk)
        assert [t for _, t in sorted(found)] == features and [n for n, _ in sorted(found)] == [*range(len(features))], chunk
        assert doc.read(end[0], end[0] + 1) == b"]"


def test_a_feature_over_many_chunks_and_backslashes(tmp_path):
    feature = '{"type":"Feature","properties":{"a":"' + "\\\\" * 300 + '\\"}],{","b":[' + ",".join(["[1,2]"] * 500) + "]}}"
    path = tmp_path / "d.geojson"
    path.write_text('{"features":[' + ",".join([feature] * 3) + ']}')
    for chunk in (50, 51, 64, 999):
        assert [t for _, t in sorted(read(str(path), chunk)[0])] == [feature] * 3


@pytest.mark.parametrize("chunk", [64, 4096, 1 << 24])
def test_rows(spark, tmp_path, chunk):
    """By Spark, of a folder of parts; members stand once, around a null."""
    R.seed(5)
    features, text = document(40)
    raw = text.encode()
    (tmp_path / "d").mkdir()
    for i, at in enumerate(range(0, len(raw), 777)):
        (tmp_path / "d" / f"part-{i:05}").write_bytes(raw[at : at + 777])
    (tmp_path / "d" / "_SUCCESS").write_text("")
    rows = geojson.read_routes(spark, str(tmp_path / "d"), chunk=chunk).orderBy("feature_ord").collect()
    assert [r.feature for r in rows] == features and [r.feature_ord for r in rows] == [*range(40)]
    whole = json.loads(text.lstrip("﻿"))
    assert {r.members for r in rows} == {rows[0].members} and json.loads(rows[0].members) == whole | {"features": None}


@pytest.mark.parametrize("text", ["", "{}", '{"type":"FeatureCollection"}', '{"features":null,"a":[1,{}]}', '{"a":{"features":[{}]}}', '{"features":[ ]}'])
def test_documents_without_features(spark, tmp_path, text):
    (tmp_path / "d.geojson").write_text(text)
    assert geojson.read_routes(spark, str(tmp_path / "d.geojson"), chunk=8).collect() == []


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        geojson.read_routes(spark, str(tmp_path / "no"))


def test_many_parts_are_one_document(spark, tmp_path):
    """Written by several tasks in order, read again as one, and joined to one file whole or not at all."""
    rows = [(i, '{"type":"FeatureCollection","features":null,"k":1}', f'{{"type":"Feature","properties":{{"OBJECTID":{i}}},"geometry":null}}', f"O{i}", None, None, "v") for i in range(500)]
    routes = spark.createDataFrame(rows, "feature_ord long, members string, feature string, canonical_origin string, canonical_destination string, via_origin string, via_destination string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        geojson.write_routes(routes, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) > 2
    geojson.join_parts(str(tmp_path / "out"), str(tmp_path / "one.geojson"))
    with pytest.raises(FileExistsError):
        geojson.join_parts(str(tmp_path / "out"), str(tmp_path / "one.geojson"))
    doc = json.loads((tmp_path / "one.geojson").read_text())
    assert [f["properties"]["OBJECTID"] for f in doc["features"]] == [*range(500)] and doc["k"] == 1 and doc["features"][7]["properties"]["canonical_origin"] == "O7"
    for source in ("out", "one.geojson"):
        again = geojson.read_routes(spark, str(tmp_path / source), chunk=1000)
        assert [r.OBJECTID for r in again.orderBy("feature_ord").collect()] == [*range(500)]


def test_texts_are_made_once_and_chunks_share_tasks(spark, tmp_path, monkeypatch):
    """A sort works out its rows twice, so no Python stands below it; and small chunks don't make a task each."""
    plans = []
    monkeypatch.setattr(geojson, "feature_text", lambda *a, f=geojson.feature_text: plans.append(a[0]) or f(*a))
    rows = [(i, '{"features":null}', f'{{"properties":{{"OBJECTID":{i},"a":"\\\\\\" é"}}}}', "O", None, None, "v") for i in range(3000)]
    geojson.write_routes(spark.createDataFrame(rows, "feature_ord long, members string, feature string, canonical_origin string, canonical_destination string, via_origin string, via_destination string"), str(tmp_path / "out"))
    assert len(plans) == 1 and "MapInArrow" not in plans[0]._jdf.queryExecution().toString() and "feature_ord" in plans[0].columns
    again = geojson.read_routes(spark, str(tmp_path / "out"), chunk=500)
    assert again.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert [(r.OBJECTID, json.loads(r.feature)["properties"]["a"]) for r in again.orderBy("feature_ord").collect()] == [(i, '\\" é') for i in range(3000)]


@pytest.mark.parametrize("name", ["geojson_round_trip", "clean_routes", "clean_gtfs", "title_case"])
def test_queries(agree, name):
    agree(queries.QUERIES[name], oracles.ORACLE_SQL[name])
