"""Spelling variants: the composed machine against all pairs, forms and roots against a plain version of the contract."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from waymark.llm import queries as llm
from waymark.llm import variants

R = random.Random(5)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_near(words):
    return {(a, b) for a in words for b in words if a < b and near(a, b)}


def some_words(alphabet, least, n=300):
    return sorted({"".join(R.choice(alphabet) for _ in range(R.randint(least, least + 5))) for _ in range(n)})


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc", "aäßéÀ", "abcdefgh", "日本語😀z"])
@pytest.mark.parametrize("least", [1, 2, 7])
def test_machine(alphabet, least):
    """Every near pair comes once, whichever way edits can be aligned; doubled letters give several."""
    words = some_words(alphabet, least)
    entered = sorted((k, s, w[::-1] if s else w, len(w)) for w in words for k in (len(w), len(w) - 1) if k > 0 for s in (0, 1))
    shorter, side, strings, n = map(list, zip(*entered, strict=True))
    got = variants.near_in(shorter, side, strings, np.array(n))
    pairs = [tuple(sorted(p)) for p in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == all_near(words)
    assert got["a_n"].to_pylist() == [*map(len, got["a"].to_pylist())] and got["b_n"].to_pylist() == [*map(len, got["b"].to_pylist())]


def test_acceptor_is_minimal():
    """As many states as different sets of endings."""
    words = some_words("abc", 2, 80)
    machine = variants.Acceptor(words, np.zeros(len(words), np.int64))
    heads = {w[:i] for w in words for i in range(len(w) + 1)}
    assert len(machine.ends) == len({frozenset(w[len(h) :] for w in words if w.startswith(h)) for h in heads})


def test_pairs_over_partitions(spark, monkeypatch):
    """Batches of few words, a very long word, a group far larger than a batch."""
    monkeypatch.setattr(variants, "BATCH", 20)
    words = some_words("ab", 7, 200) + ["q" * 5000, "q" * 4999 + "r", "q" * 4999]
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(3)
    got = [tuple(sorted((r.a, r.b))) for r in variants.near_words(table).collect()]
    assert len(got) == len(set(got)) and set(got) == all_near(words)


def plain(rows, least=7, often=2, ratio=10):
    total = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    n = {w: k for w, k in total.items() if len(w) >= least and k >= often}
    holes = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
    form, number = {}, {}
    for w in n:
        others = {v for i in range(len(w)) for v in holes[w[:i] + "\0" + w[i + 1 :]]} | {w[:i] + w[i + 1 :] for i in range(len(w))} & n.keys()
        others |= {v for i in range(len(w) + 1) for v in holes[w[:i] + "\0" + w[i:]]}
        others.discard(w)
        number[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], number[w], n.get(form[w]))
    return out


def as_dict(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_registered_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = llm.op12_spelling_variants(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got, want = as_dict(got), plain(rows)
    assert got == want and any(v[0] for v in want.values())


def test_chains_and_ties(spark):
    """Four hops to a root; of two forms as common the first by code points; exactly ten times is enough, less isn't."""
    counts = {"abcdefgh": 1, "abcdefg": 10, "abcdefgz": 9, "abcdefgzz": 100, "xbcdefgzz": 1000, "xbcdefgzzy": 10_000, "mmmmmmma": 20, "mmmmmmmb": 20, "mmmmmmmc": 2, "ÀÀÀÀÀÀÀ": 5}
    table = spark.createDataFrame([*counts.items()], "word string, n long")
    got = as_dict(variants.variants(table))
    assert got["abcdefgz"] == ("abcdefgzz", "xbcdefgzzy", 9, 3, 100) and got["abcdefg"][:2] == (None, "abcdefg") and got["abcdefgh"][:2] == ("abcdefg", "abcdefg")
    assert got["mmmmmmmc"][0] == "mmmmmmma" and got["mmmmmmma"][0] is None and got["ÀÀÀÀÀÀÀ"] == (None, "ÀÀÀÀÀÀÀ", 5, 0, None)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "¿? 12 7x8"), (None, "Wonderful Wonderful wonderfu1"), (4, "wonderful" * 30_000), (4, "wonderful" * 30_000), (5, "straße STRASSE Straßen straßen ÀÉÎÕÜÇÑ ÀÉÎÕÜÇÑ")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = as_dict(variants.spelling_variants(table, noise=None))
    assert got.keys() == {"wonderful", "wonderful" * 30_000, "straßen", "ÀÉÎÕÜÇÑ"} and got["wonderful"][2] == 2
    assert as_dict(variants.spelling_variants(table.limit(0))) == {}
    assert as_dict(variants.spelling_variants(table.limit(0), noise=None)) == {}
