"""The training sample is of whole rows, bounded by rows, and what tasks send to the driver by their characters."""

import zlib

import numpy as np

from waymark.llm import langid
from waymark.llm import queries as llm


def test_rows_are_whole_and_long_ones_several(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(langid, "fit", lambda sample: drawn.extend(sample))
    rows = [(i, f"word{i} " * 500, "en") for i in range(8)] + [(i, "x" * 65_000, "long") for i in range(100, 104)] + [(200, "½ 123 " * 20_000, "none")]
    langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert max(len(t) for t, _ in drawn) <= langid.SAMPLE_CHARS
    learned = [t for i, t, _ in rows[:8] if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(t for t, x in drawn if x == "en") == sorted(learned)
    assert sum(len(t) for t, x in drawn if x == "long") <= 4 * 65_000


def test_registered_query_has_the_language(spark, sf):
    """On the held-out documents; and the prediction is that of the model on the whole text, row by row."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = llm.op8_language_id(spark, sf).join(table.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    model = langid.learn(table)
    for r in got[:40]:
        words = langid.words_of(r.text)
        first = [True] + [False] * (len(words) - 1)
        sums = model.marginals(model.emissions(words), np.array(first)).sum(axis=0)
        assert model.labels[int(sums.argmax())] == r.lang_pred and abs(sums.max() / len(words) - r.score) < 1e-9
