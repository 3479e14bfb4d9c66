"""The registered queries on a whole table against plain versions of their contracts, and the pipeline against its operators' contracts."""

import collections
import hashlib
import random
import re
import struct

import public_tokenizers
import pytest
import tiktoken
import zlib

import __spark_entry__ as entry
from tests.llm.test_brute_force import docs, fingerprint, prose, removed, roots
from waymark.llm import bpe, repeats, secret_scan

R = random.Random(11)


@pytest.fixture(scope="module")
def rows(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()


def result(spark, sf, name):
    got = entry.queries()[name](spark, sf).collect()
    assert len({r.doc_id for r in got}) == len(got)
    return {r.doc_id: r for r in got}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, sf, rows):
    fps = {r.doc_id: fingerprint(r.text) for r in rows}
    up = roots(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {i: (r.fingerprint, r.component_id) for i, r in result(spark, sf, "op1_simhash_near_dedup").items()} == {i: (f"{fps[i]:016x}", up[i]) for i in fps}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_op2(spark, sf, rows):
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words_of(r.text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(r.item_id))
    got = result(spark, sf, "op2_decontamination")
    for r in rows:
        w, hit, found = words_of(r.text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (items := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    found |= items
        want = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w))
        assert tuple(got[r.doc_id])[1:6] == want


def test_op3(spark, sf, rows):
    want = {r.doc_id: w for r, w in zip(rows, removed([r.text for r in rows], 400), strict=True)}
    for i, r in result(spark, sf, "op3_repeated_passages").items():
        n, spans, kept = want[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) == (n, n - len(kept), spans, sha(kept), kept.decode("utf-8", "replace"))


def test_passages_about_the_length_and_under_one_hot_key(spark):
    passage = prose(150)[:500]
    texts = [f"{prose(20)} {passage[:n]} {prose(20)}" for n in (398, 399, 400, 401, 450, 500) for _ in range(2)]
    hot = "".join(R.choice("abcdef ") for _ in range(420))
    texts += [f"{prose(R.randint(1, 30))}{R.randint(0, 9)} {hot[R.randint(0, 25) :]}{R.randint(0, 9)} {prose(5)}" for _ in range(500)]
    got = {r.doc_id: (r.n_bytes, len(r.removed), bytes(r.kept)) for r in repeats.remove_repeats(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 400)


def test_op5(spark, sf, rows):
    codec = bpe.Codec.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = result(spark, sf, "op5_byte_bpe")
    for r in rows:
        ids = theirs.encode_ordinary(r.text or "")
        assert tuple(got[r.doc_id])[1:4] == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((r.text or "").encode()))


def test_op5_in_levels(monkeypatch):
    """Trees of several levels, and words, matches and halves at their bounds."""
    codec = bpe.Codec.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    monkeypatch.setattr(bpe, "LEAF_IDS", 4)
    monkeypatch.setattr(bpe, "KNOWN", 20)
    monkeypatch.setattr(bpe, "ROWS", 5)
    texts = ["".join(R.choice("aeinrst") for _ in range(R.randint(0, 90))) + R.choice(["", " ", "\n", "  x", "'s", " 's", " über straße"]) for _ in range(400)]
    texts = [" ".join(texts[i : i + 4]) for i in range(0, 400, 4)] + ["", " ", "\n", "a" * 3000]
    for _ in range(2):
        ids, begin = codec.encode_texts(texts)
        for t, a, b in zip(texts, begin, begin[1:], strict=False):
            assert ids[a:b].tolist() == theirs.encode_ordinary(t) and codec.decode(ids[a:b]) == t.encode()


def test_op8(spark, sf, rows):
    langs = {r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang").distinct().collect()}
    for i, r in result(spark, sf, "op8_language_id").items():
        text = next(x.text for x in rows if x.doc_id == i)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.lang_pred in langs | {"und"} and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))


def test_op9(spark, sf, rows):
    kinds = (
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    got = result(spark, sf, "op9_secret_scan")
    for r in rows:
        found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(r.text or "") if ok(m))
        base = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in found]
        g = got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == j for _, k, _ in found) for j in range(3))
        assert g.base_sha256 == sha(",".join(base).encode()) and set(base) <= set(g.spans.split(",")) | {""}
