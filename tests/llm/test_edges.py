"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns; and the pipeline."""

import pytest

import corpus_pipeline
import __spark_entry__ as entry
from waymark.llm import bpe, chat, decontam, html_text, langid, quality, repeats, secret_scan, simhash, token_count
from waymark.llm.common import runs

SCHEMA = "doc_id long, text string, lang string, source string, row string, fp string, n_words string, hit_spans string, data string, `a b` string"
LONG = "word " * 60_000 + "z" * 50_000
ROWS = [(1, "One two three. " * 30, "en"), (1, "One two three. " * 30, "en"), (None, "One two three. " * 30, None), (None, None, None), (2, "", "en"), (3, LONG, "en"), (4, "\n\n \t", "de"), (5, None, "de"), (6, "ein Haus. " * 20, "de")]
ROWS = [(*r, None, "r", "f", "w", "h", "d", "ab") for r in ROWS]


def operators(spark):
    import public_tokenizers as P

    bench = spark.createDataFrame([("1", "One two three one two three one two three one two three one two"), (None, "ein"), ("2", None)], "item_id string, text string")
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    return {
        "near_duplicates": simhash.near_duplicates,
        "keep_one": simhash.keep_one,
        "find_hits": lambda d: decontam.find_hits(d, bench),
        "remove_hits": lambda d: decontam.remove_hits(d, bench),
        "remove_repeats": repeats.remove_repeats,
        "digests": lambda d: bpe.digests(d, ranks, P.PATTERN),
        "encode": lambda d: bpe.encode(d, ranks, P.PATTERN),
        "measured": quality.measured,
        "clean": quality.clean,
        "count_tokens": lambda d: token_count.count_tokens(d, P.path("piece_bpe_32k.model")),
        "identify": lambda d: langid.identify(d, langid.learn(d)),
        "keep_known": lambda d: langid.keep_known(d, langid.learn(d)),
        "find_secrets": secret_scan.find_secrets,
        "redact": secret_scan.redact,
        "extract": lambda d: html_text.extract(d, "text"),
    }


NAMES = "near_duplicates keep_one find_hits remove_hits remove_repeats digests encode measured clean count_tokens identify keep_known find_secrets redact extract".split()


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = operators(spark)[name](df)
    got = out.collect()
    if name in ("keep_one", "remove_hits", "clean", "keep_known", "redact"):
        assert out.columns == df.columns and len(got) <= len(ROWS)
    else:
        assert len(got) == len(ROWS)
    if name == "keep_one":
        assert [r.doc_id for r in got if r.doc_id is not None].count(1) == 1 and len([r for r in got if r.doc_id is None]) == 2
    if name == "redact":
        assert sorted(map(repr, got)) == sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_benchmark(spark):
    empty = spark.createDataFrame([], "item_id string, text string")
    assert decontam.remove_hits(spark.createDataFrame(ROWS, SCHEMA), empty).count() == len(ROWS)


def test_odd_turns(spark):
    rows = [(None, None, None, None, "x"), (None, 1, "user", "u", "x"), (1, 0, "user", "<|im_end|>", "x"), (1, 0, "user", "<|im_end|>", "x"), (2, -5, "USER ", "v", "x"), (3, 0, "system", None, "x")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")).collect()
    assert len(got) == len(rows) and chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert all("<|im_end|>" not in r.piece.replace("<|im_end|>\n", "") for r in got)


def test_runs_keep_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 50)], ["t"])
    assert sum(p.num_rows for p in runs(batch, None, 3000)) == 50 and len([*runs(batch, None, 3000)]) > 10


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids and len(left) == out.count()
        if name == "near_dedup":
            found = simhash.near_duplicates(docs).collect()
            assert left == {r.component_id for r in found}
        elif name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert left == {r.doc_id for r in decontam.find_hits(docs, bench).where(~decontam.contaminated()).collect()} and decontam.find_hits(out, bench).where("size(hit_spans) > 0").count() == 0
        elif name in ("secrets", "encoding"):
            assert left == ids
        docs, ids = out, left
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == ids


def test_registered():
    names = entry.queries()
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_pipeline_decodes(spark, sf):
    import hashlib

    df = spark.createDataFrame(ROWS, SCHEMA)
    got = corpus_pipeline.encoding(spark, df, sf).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in ROWS)
    assert all(len(r.token_ids) == r.n_tokens for r in got)


def test_columns_stay_as_they_are(spark):
    """Values, and not only names, of columns that clash with what the operators make."""
    from waymark.llm import html_text as h

    text = "".join(f"One {i} two{i} three, four{i} five. " for i in range(40))
    names = ["doc_id", "text", "lang", "nth", "n_words", "kept", "hit_words before", "seen before", "row", "doc", "c0", "h", "n", "more", "rows", "part", "key"]
    df = spark.createDataFrame([(1, text, "en", *(f"mine {c}" for c in names[3:])), (2, text + "and more words here. " * 30, "en", *(f"mine {c}" for c in names[3:]))], ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    bench = spark.createDataFrame([(str(i), f"b{i} " * 20) for i in range(10)], "item_id string, text string")
    stay = names[3:]
    for name, made in {
        "clean": quality.clean(df),
        "redact": secret_scan.redact(df),
        "keep_one": simhash.keep_one(df),
        "remove_hits": decontam.remove_hits(df, bench),
        "find_hits": decontam.find_hits(df, bench),
        "find_hits in blocks": decontam.find_hits(df, bench, block_words=30),
        "remove_repeats": repeats.remove_repeats(df),
        "find_secrets": secret_scan.find_secrets(df),
        "extract": h.extract(df, "text"),
    }.items():
        got = made.collect()
        assert got and all(r[c] == f"mine {c}" for r in got for c in stay if (name, c) != ("remove_repeats", "kept")), name


def test_two_texts_under_one_key(spark):
    a, b, c = ("alpha beta gamma delta " * 40), ("one two three four five six " * 40), ("eins zwei drei " * 50)
    rows = [(3, a), (7, a), (7, b), (7, b), (8, c)] + [(None, f"null {i} " * 60) for i in range(300)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == sorted([(3, a), (7, b), (8, c)])
    assert {r.text for r in got if r.doc_id is None} == {t for k, t in rows if k is None}


def test_checkpoint_folder(spark, monkeypatch):
    from waymark.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        common.shared_folder(Session())
