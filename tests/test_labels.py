import pytest
from pyspark.sql import functions as F

from waymark.functions import labels
from waymark.operators import places

CASES = [
    ("VIA PLUM RD -ELMTON", "ELMTON", "PLUM RD"),
    ("VIA PLUM ELMTON", "ELMTON", "PLUM"),
    ("ELMTON WEST (VIA", "ELMTON WEST", None),
    ("ELMTON (via Oak Rd, N9 & PINE)", "ELMTON", "Oak Rd, N9 & PINE"),
    ("ELMTON VIA OAK", "ELMTON", "OAK"),
    ("ELMTON (VIA OAK VIA PINE)", "ELMTON", "OAK, PINE"),
    ("ELMTON (VIA OAK) (VIA PINE)", "ELMTON", "OAK, PINE"),
    ("VIA OAK", "VIA OAK", None),
    (" VIA OAK", None, "OAK"),
    ("VIA OAK RD ELMTON", "RD ELMTON", "OAK"),
    ("VIA PLUM-TREE RD - X", "TREE RD - X", "PLUM"),
    ("elm's  town(north)", "ELMS TOWN (NORTH)", None),
    ("ELMTON,NORTH", "ELMTON, NORTH", None),
    ("ELMTON (A) (B", "ELMTON (A)", None),
    ("(NORTH) ELMTON", "NORTH) ELMTON", None),
    ("ELM RAILWAY STATIONS", "ELM RAILWAY STATION", None),
    ("ELM RAILWAY STATION", "ELM STATION", None),
    ("ELM POWER STATION", "ELM POWER STATION", None),
    ("ELM TOWN", "ELM TOWN", None),
    (" ", None, None),
    ("", None, None),
    (None, None, None),
]


@pytest.fixture(scope="module")
def resolved(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in CASES], "name string")
    rules = spark.createDataFrame([("OLD NAME", "NEW NAME")], "alias string, target string")
    return {r["name"]: (r["place"], r["via"]) for r in places.resolved(df, rules).collect()}


@pytest.mark.parametrize("label,place,via", CASES)
def test_label(resolved, label, place, via):
    assert resolved[label] == (place, via)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def test_title_case(spark):
    assert one(spark, "12_elmton SC n2 ROAD", labels.title_case) == "12_Elmton SC n2 Road"


def test_key_keeps_order_and_qualifier(spark):
    assert one(spark, "Town Centre (Plain)", labels.canonical_key) == "TOWNCENTREPLAIN"
    assert one(spark, "Plain (Town Centre)", labels.canonical_key) == "PLAINTOWNCENTRE"


@pytest.mark.parametrize("text,seconds", [("25:10:00", 90600), ("5:00:01", 18001), ("5:60:00", None), ("x", None), (None, None)])
def test_times(spark, text, seconds):
    assert one(spark, text, labels.seconds) == seconds
