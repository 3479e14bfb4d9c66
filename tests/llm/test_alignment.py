"""Cross-tokenizer alignment against a plain version of the contract, and the bitmaps against sets."""

import bisect
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from waymark.llm import alignment
from waymark.llm import queries as llm

R = random.Random(9)
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_level(piece):
    """The usual table, written out the other way round: which byte a character stands for."""
    moved = [*range(33), *range(127, 161), 173]
    return bytes(moved[ord(c) - 256] if ord(c) >= 256 else ord(c) for c in piece)


def tokens(models, text):
    a, b = models
    if not text:
        return [], []
    x = [(i, byte_level(a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])


def ends(side):
    at, out = 0, []
    for i, t in side:
        at += len(t)
        out.append((at, i))
    return out


def plain(models, rows):
    """(key, row of the contract) of each (key, text), and of each pair its documents and links."""
    count, documents, texts = collections.Counter(), collections.Counter(), {}
    for text in {t for _, t in rows}:
        x, y = tokens(models, text)
        a, b = ends(x), ends(y)
        at = dict(a)
        links = [(at[e], j) for e, j in b if e in at]
        common = sorted({e for e, _ in a} & {e for e, _ in b})
        groups = [([], []) for _ in common]
        for side, some in ((0, a), (1, b)):
            for e, i in some:
                groups[bisect.bisect_left(common, e)][side].append(str(i))
        texts[text] = (len(a), len(b), links, ";".join(",".join(p) + "|" + ",".join(q) for p, q in groups))
    for _, t in rows:
        count.update(texts[t][2])
        documents.update(set(texts[t][2]))
    best = collections.Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for k, t in rows:
        n_a, n_b, links, groups = texts[t]
        n_groups = groups.count(";") + 1 if groups else 0
        out.append((k, n_a, n_b, n_groups, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return out, {p: (documents[p], count[p]) for p in count}


def check(models, found, pairs, rows):
    want, counts = plain(models, rows)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want)
    if pairs is not None:
        assert {(r.a, r.b): (r.documents, r.links) for r in pairs.collect()} == counts


ODD = [None, "", " ", "  a", "<|endoftext|> <s> </s> <unk> <0x0A>", "a▁b", "▁", "naïve Straße 漢字 😀👩‍👩‍👧 ́", "tab\tnew\nline \r\n  two", "\x00\x1f\x7f\xa0　", "x" * 500, "1234567890 " * 30, "Don't we'll I'M", "﻿�\U0010ffff"]


def test_odd_texts(spark, models):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "some text"), (3, "some text"), (3, "some text")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pair int, number string").repartition(3)
    check(models, *alignment.aligned_pairs(table, A, B), rows)
    assert alignment.aligned_pairs(table.limit(0), A, B)[0].count() == 0 and alignment.aligned_pairs(table.where("text is null"), A, B)[1].count() == 0


def test_registered_query(spark, sf, models):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(models, llm.op13_tokenizer_alignment(spark, sf), None, rows)


def test_planes_blocks_and_dense_bitmaps(spark, models, monkeypatch):
    """Bits instead of numbers, several postings of a pair and a block, pairs linked many times."""
    monkeypatch.setattr(alignment, "DENSE", 8)
    monkeypatch.setattr(alignment, "LINKS", 40)
    rows = [(i, R.choice(["the cat sat", "the " * R.randint(1, 300), "a cat, a hat", "to be or not to be"])) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    check(models, *alignment.aligned_pairs(table, A, B), rows)


def test_texts_are_cut_where_nothing_changes(models, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 20)
    monkeypatch.setattr(alignment, "KNOWN", 30)
    model = alignment.Aligner(A, B)
    texts = [" ".join(R.choice(["word", "Über", "漢字漢字", "it's", "12", "...", "", "\n", "a\tb", "x" * 150]) for _ in range(400)) for _ in range(30)]
    for some in (texts[:20], texts[10:]):
        for t, (n_a, n_b, groups, _) in zip(some, model.align(some), strict=True):
            assert len(model.stretches(t)) > 10
            a, b = alignment.ids_of(groups, 0), alignment.ids_of(groups, 1)
            assert (a, b) == (models[0].encode(" " + t, add_special_tokens=False).ids, models[1].encode(t)) and (n_a, n_b) == (len(a), len(b))
    assert all(len(s) <= alignment.LONG for s in model.known)


def test_align_gives_groups(spark, models):
    got = alignment.align(spark.createDataFrame([(1, "Hello, world")], "doc_id long, text string"), A, B).first()
    x, y = tokens(models, "Hello, world")
    assert got.a_ids == [i for i, _ in x] and got.b_ids == [i for i, _ in y]
    assert [s for g in got.groups.split(";") for s in g.split("|")[0].split(",")] == [str(i) for i in got.a_ids]


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 5000, 65_536])
def test_bitmaps(n):
    some = np.array(sorted(R.sample(range(65_536), n)), np.int64)
    other = np.array(sorted(R.sample(range(65_536), 700)), np.int64)
    packed = alignment.compressed(some)
    assert alignment.members(packed).tolist() == some.tolist() and alignment.population(packed) == n
    assert alignment.members(alignment.either([packed, alignment.compressed(other)])).tolist() == sorted({*some.tolist()} | {*other.tolist()})
