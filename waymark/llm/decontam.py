"""Benchmark decontamination with a generalised suffix automaton.

The automaton accepts every run of words of every benchmark item. The words of a document are streamed through it; the state and
the longest matching length say at every word which windows end there. Nothing is hashed, so nothing can collide.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import held, map_texts, written

WINDOW = 13
#: Words of benchmark items that one automaton may hold, and words of a piece of a very long item.
BLOCK_WORDS, PIECE_WORDS = 200_000, 5_000

#: Lower case for A-Z; a blank for every other ASCII character but 0-9 and a-z. Other bytes belong to words.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, none if it is null."""
    return (text or "").encode().translate(TO_WORDS).split()


class Automaton:
    """A generalised suffix automaton over the words of items [(id, words)], with the windows of the items marked in its states."""

    def __init__(self, items: list[tuple[str | None, list[bytes], bool]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in words], whole) for i, words, whole in items]
        for _, word_ids, _ in coded:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        #: By state: the items of the window that a match through this state ends with; of shorter items, (words, id).
        self.items, self.short = defaultdict(set), defaultdict(set)
        self.least = window
        for i, word_ids, whole in coded:
            state = 0
            for n, w in enumerate(word_ids, 1):
                state = self.next[state][w]
                if n >= window:
                    self.items[self._ending(state)].add(i)
            if whole and 0 < len(word_ids) < window:
                self.short[state].add((len(word_ids), i))
                self.least = min(self.least, len(word_ids))
        self.ending = {}
        self.shorts: dict[int, list] = {0: []}

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, to: dict, length: int) -> int:
        self.next.append(to)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _ending(self, state: int) -> int:
        """The state of the last `window` words of the strings of a state that is at least so long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _shorts(self, state: int) -> list[tuple[int, str]]:
        """The short items that are suffixes of the strings of a state, shortest first."""
        if state not in self.shorts:
            self.shorts[state] = sorted({*self._shorts(self.link[state]), *self.short.get(state, ())}, key=lambda x: (x[0], str(x[1])))
        return self.shorts[state]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans of words [start, end) that windows cover, merged and in order, and the items that the windows are of."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        known = bytes(map(self.vocab.__contains__, words))
        for run in re.finditer(rb"\x01{%d,}" % self.least, known):
            state = matched = 0
            for at in range(*run.span()):
                w = self.vocab[words[at]]
                while state and w not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                state = self.next[state].get(w, 0)
                matched = matched + 1 if state else 0
                covers = 0
                if matched >= self.window:
                    if state not in self.ending:
                        self.ending[state] = self._ending(state)
                    found |= self.items[self.ending[state]]
                    covers = self.window
                if self.short:
                    for n, item in self._shorts(state):
                        if n <= matched:
                            found.add(item)
                            covers = max(covers, n)
                if covers:
                    start = at + 1 - covers
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at + 1))
        return spans, found


SPAN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
HITS = T.StructType([T.StructField("hit_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(SPAN, False)), T.StructField("hit_chars", T.ArrayType(SPAN, False)), T.StructField("hit_items", T.ArrayType(T.StringType(), False))])
PIECES = "item string, n long, whole boolean, words array<binary>"


def pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """The words of the items, very long ones in pieces that overlap by a window less one word, so that no window is lost."""

    def cut(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                step = max(1, PIECE_WORDS - window + 1)
                starts = range(0, max(1, len(words) - window + 1), step) if words else ()
                rows += [(item, len(part), len(words) == len(part), part) for s in starts for part in [words[s : s + step + window - 1]]]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.binary())))], names)

    cut_up = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(cut, PIECES)
    return cut_up.dropDuplicates(["item", "whole", "words"])


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with hit_words (words of the text), hit_spans (runs of words [start, end) inside occurring windows), hit_chars (the same runs in code points, each up to
    the next word) and hit_items.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. A null text has no words; an empty
    benchmark hits nothing; an item whose id is null hits but is not listed. Repeated items and repeated documents count as they are. Columns of docs
    that have the new names are replaced, all others stay.
    What is broadcast is bounded: an automaton holds about block_words words. Where the benchmark has more, its pieces are dealt to blocks by a hash of all they
    are, the documents are written once and read by each block, and of the blocks after the first only documents with hits are joined.
    """
    spark, parts = docs.sparkSession, written(pieces(benchmark, window))
    total = parts.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-total // block_words))
    block = lambda n: F.pmod(F.xxhash64("item", "whole", "words"), F.lit(n))
    while n_blocks > 1 and parts.groupBy(block(n_blocks).alias("k")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > 2 * block_words + PIECE_WORDS:
        n_blocks *= 2

    def matched(rows: DataFrame, text: str, k: int) -> DataFrame:
        found = parts.where(block(n_blocks) == k).collect() if total else []
        sent = spark.sparkContext.broadcast([(r.item, [bytes(w) for w in r.words], r.whole) for r in found])
        return map_texts(rows, text, matcher(sent, uuid.uuid4().hex, window), HITS)

    if n_blocks == 1:
        return matched(docs, text, 0)
    kept = [c for c in docs.columns if c not in HITS.fieldNames()]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    rows = written(docs.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("nth")))
    others = [matched(rows.select("nth", "text"), "text", k).where(F.size("hit_spans") > 0) for k in range(1, n_blocks)]
    lists = ("hit_spans", "hit_chars", "hit_items")
    more = reduce(DataFrame.unionByName, others).groupBy("nth").agg(F.struct(*[F.flatten(F.collect_list(c)).alias(c) for c in lists]).alias("more"))
    both = matched(rows, "text", 0).join(more, "nth", "left")
    every = {c: F.concat(c, F.coalesce(f"more.{c}", F.array().cast(HITS[c].dataType))) for c in lists}
    return both.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)],
        "hit_words",
        *[joined(every[c], HITS[c].dataType).alias(c) for c in lists[:2]],
        F.array_sort(F.array_distinct(every["hit_items"])).alias("hit_items"),
    )


def matcher(block, name: str, window: int):
    def match(texts: list[str | None]) -> dict[str, list]:
        automaton, out = held(("automaton", name), lambda: Automaton(block.value, window)), {f: [] for f in HITS.fieldNames()}
        for t in texts:
            words = words_of(t)
            spans, found = automaton.match(words)
            out["hit_words"].append(len(words))
            out["hit_spans"].append([{"start": a, "end": b} for a, b in spans])
            out["hit_chars"].append(in_characters(t, spans) if spans else [])
            out["hit_items"].append(sorted(x for x in found if x is not None))
        return out

    return match


def joined(spans: Column, kind: T.DataType) -> Column:
    """Spans in order, those that meet or overlap as one."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (last(acc)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def hit_count() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(percent: int = 5) -> Column:
    """True if any word is hit and the hit words are at least `percent` of all."""
    return (hit_count() > 0) & (100 * hit_count() >= percent * F.col("hit_words"))


#: The words in a text that still has its capitals.
PATTERN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def in_characters(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as code points of the text, each up to the next word."""
    at = [*(m.start() for m in PATTERN_WORD.finditer(text)), len(text)]
    return [{"start": at[a], "end": at[b]} for a, b in spans]


def remove_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = 5, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones (coverage limit); of the others, the spans that windows cover are cut out (length limit). Columns stay."""
    named = docs.withColumnsRenamed({c: f"doc {c}" for c in docs.columns})
    hits = find_hits(named, benchmark, f"doc {text}", window).where(~contaminated(percent))
    whole = F.col(f"`doc {text}`")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("hit_chars", lambda s: s["end"]))
    ends = F.concat(F.transform("hit_chars", lambda s: s["start"]), F.array(F.char_length(whole).cast("long")))
    left = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substr(whole, (a + 1).cast("int"), (b - a).cast("int"))), "")
    cut = F.when(F.size("hit_chars") > 0, left).otherwise(whole)
    return hits.select(*[(cut if c == text else F.col(f"`doc {c}`")).alias(c) for c in docs.columns])
