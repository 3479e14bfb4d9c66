"""Nested, cut-off and stored streams, compression bombs, and escapes of further kinds."""

import base64
import gzip
import random
import time
import zlib

import pytest

from waymark.llm import secret_scan
from waymark.llm.secret_scan import deep_scan, explored, masked

SECRET = b"password=correcthorse7"


def b64(b):
    return base64.b64encode(b).decode()


def stored(b):
    c = zlib.compressobj(0)
    return c.compress(b) + c.flush()


def fixed(b):
    c = zlib.compressobj(9, zlib.DEFLATED, 15, 9, zlib.Z_FIXED)
    return c.compress(b) + c.flush()


@pytest.mark.parametrize("n", [15, 250, 10_000])
def test_nested_cut_off_streams(n):
    begin = time.process_time()
    deep_scan("x " + b64(b"\x78\x01\x00\xf0\xff\x0f\x00" * n + b"y" * 20) + " y")
    assert time.process_time() - begin < 3


@pytest.mark.parametrize("block", [b"\x78\x01\x01\xff", b"\x78\x9c\x4b\x04", b"\x1f\x8b\x08\x00\0\0\0\0\0\0\x00\x05\x00\xfa\xff12345", b"\x78\x01\x00\x10\x00\xef\xff0123456789abcdef", b"\x78\x01\x00\x09\x00\xf6\xff"])
@pytest.mark.parametrize("wrap", [b64, lambda b: "".join(f"%{x:02x}" for x in b)])
def test_hostile_streams_end(block, wrap):
    begin = time.process_time()
    deep_scan(wrap(block * 2000))
    assert time.process_time() - begin < 60


@pytest.mark.parametrize("pack", [stored, fixed, zlib.compress, gzip.compress])
@pytest.mark.parametrize("depth", [1, 2, 5, 30])
def test_levels(pack, depth):
    inner = b"\xff" * 3 + SECRET + b"\xff"
    for _ in range(depth):
        inner = pack(inner)
    text = "before " + b64(inner) + " after"
    base, every = deep_scan(text)
    assert base == [] and every and all(7 <= a < b <= len(text) - 6 and k == 0 for a, k, b in every)
    assert "after" in masked(text, every, "-") and deep_scan(masked(text, every, "-"))[1] == []


@pytest.mark.parametrize("cut", [1, 4, 7])
def test_cut_off(cut):
    noise = bytes(random.Random(1).randbytes(300))
    assert deep_scan("x " + b64(zlib.compress(SECRET + noise)[:-cut]))[1]


def test_one_content_in_two_places():
    one = b64(gzip.compress(SECRET, mtime=0))
    text = f"a {one} b {one} c %{one[0].encode().hex()}{one[1:]}"
    every = deep_scan(text)[1]
    assert {a for a, _, _ in every} >= {2, 5 + len(one)} and deep_scan(masked(text, every, "-"))[1] == []


def test_bombs():
    """One level within the budget is read whole; several stand as unread, and are masked."""
    one = b64(zlib.compress(b"\xff" * 3_000_000 + SECRET + b"\xff"))
    assert deep_scan(one)[1] and not explored(one)[2]
    deep = b"\0" * 40_000_000 + SECRET
    for _ in range(3):
        deep = zlib.compress(deep * 2, 9)
    text = "safe " + b64(deep) + " safe"
    begin = time.process_time()
    base, _, unread = explored(text, 1 << 22)
    assert unread and time.process_time() - begin < 20
    assert masked(text, sorted(unread), "-") == "safe - safe" or "safe" in masked(text, sorted(unread), "-")
    assert all(5 <= a < b <= len(text) - 5 for a, _, b in unread) and base == []


@pytest.mark.parametrize("wrap", [
    lambda s: "".join(f"\\{ord(c):03o}" for c in s), lambda s: "".join(f"%u{ord(c):04x}" for c in s), lambda s: s.replace("=", "&equals;"), lambda s: s.replace("p", "\\160"),
    lambda s: s.replace("=", "%u003d"), lambda s: s.replace("=", "&amp;equals;"), lambda s: s.replace("=", "&#61;"),
])
def test_further_escapes(wrap):
    inner = wrap(SECRET.decode())
    text = f"é {inner} &nosuch; &lt; 100%used \\ end"
    base, every = deep_scan(text)
    assert base == [] and any(k == 0 and 2 <= a < b <= 2 + len(inner) for a, k, b in every)
    assert "correcthorse" not in masked(text, every, "-")


def test_quine_like_content_ends():
    assert explored("%2541" * 50)[0] == []


def test_registered_columns(spark):
    df = spark.createDataFrame([(1, "x " + b64(gzip.compress(SECRET))), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.find_secrets(df).collect()}
    assert got[1].secret_spans and got[1].unread_spans == [] and got[2].secret_spans == []
