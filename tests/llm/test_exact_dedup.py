"""Exact duplicates: the filters lose nothing, and groups are those of equal texts whatever the fingerprints."""

import collections
import hashlib
import random

import numpy as np
import pytest

from waymark.llm import exact_dedup
from waymark.llm import queries as llm

R = random.Random(3)


@pytest.mark.parametrize("bits", [64, 59, 40, 20])
@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_filters_are_lossless(bits, n):
    keys = np.unique(np.array([R.getrandbits(bits) for _ in range(n)], np.uint64))
    counts = np.array([R.choice([1, 1, 2, 3, 300, 1 << 40]) for _ in keys], np.int64)
    got = exact_dedup.decoded(*exact_dedup.encoded(keys, counts, bits), bits)
    assert (got[0] == keys).all() and (got[1] == counts).all()


def test_merging_adds_counts():
    lists = [[R.randint(0, 50) for _ in range(R.randint(1, 60))] for _ in range(7)]
    parts = [np.unique(np.array(x, np.uint64), return_counts=True) for x in lists]
    keys, counts = exact_dedup.merged(parts)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == collections.Counter(x for part in lists for x in part)


def plain(rows):
    """The contract: the largest id of each text, one row of those that agree in both."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return collections.Counter((i, largest[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def check(spark, rows, **given):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"fp": llm.F.lit(1), "n": llm.F.lit("x"), "sha": llm.F.lit(2.5)})
    got = exact_dedup.exact_duplicates(table, **given).collect()
    want, texts = plain(rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    stay = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in stay) and sorted(r.text_sha256 for r in stay) == sorted(texts)


@pytest.mark.parametrize("bits", [64, 4, 1])
def test_groups(spark, bits):
    """Also with fingerprints of so few bits that texts collide; a third of the rows are one text."""
    texts = ["", None, " ", "hot " * 50, "x" * 300_000, "x" * 299_999 + "y", "ä", "ä", *[f"text {k}" for k in range(60)]]
    rows = [(i, R.choice(texts)) for i in range(200)] + [(1000 + i, "hot " * 50) for i in range(120)]
    check(spark, rows, bits=bits)


def test_repeated_and_missing_keys(spark):
    check(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (7, None), (7, ""), (3, None)])


def test_empty_table(spark):
    check(spark, [])


def test_normalised(spark):
    table = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(table, normalise=llm.F.lower).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (3, True)}


def test_many_filters_of_a_partition(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD", 7)
    values = [R.randint(0, 90) << 50 for _ in range(400)]
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").repartition(3)
    got = {r.fp % (1 << 64): r.n for r in exact_dedup.counted(fps, 5).collect()}
    assert got == {k: n for k, n in collections.Counter(values).items() if n > 1}


def test_registered_query(agree):
    agree(llm.op11_exact_dedup, llm.ORACLE_SQL["op11_exact_dedup"])
