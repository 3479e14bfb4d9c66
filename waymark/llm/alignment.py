"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

A text is encoded by both, and where tokens of both end at the same byte they are linked. Documents are numbered; of each pair of ids an index holds the numbers of the
documents that link it as compressed bitmaps, one for each block of 65,536 documents: sorted numbers below 4,096, bits from there on. Where a pair is linked
more than once in a document, bit planes hold how often. Bitmaps of a pair and a block are merged by OR; the sums of their populations, planes
weighted, are the pair's documents and links. The postings then carry these back: each gives its documents the pair's count,
and they are summed a block at a time. No task holds more than one block's sums, whatever the pair.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import held, map_texts, runs, written

BLOCK, DENSE = 1 << 16, 1 << 12
#: Characters that are encoded at a time, links that a task indexes at once, stretches that a worker knows, and the characters of one that it doesn't keep.
PIECE, LINKS, KNOWN, LONG = 1 << 17, 4_000_000, 250_000, 100
CUT = re.compile(r"(?<=\S)\x20(?!\Z)")
#: A stretch behind which a text can be cut, and whose characters both sides take as they are.
SOLID = re.compile(r"\A[^▁]*[^▁\s]\Z")
DIGITS = "n_a n_b n_groups n_links".split()


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """The bytes of each id of a vocabulary, and its ids as digits with each of some signs behind."""

    def __init__(self, tokens: list[bytes], signs: str):
        self.tokens = tokens
        self.size = np.array([*map(len, tokens)], np.int64)
        self.digits = [np.array([f"{i}{sign}".encode() for i in range(len(tokens))], "S8") for sign in signs]

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: What a stretch of a text gives: its ids of both sides, its groups, and the linked pairs as bytes.
Part = tuple[int, int, str, bytes]


class Aligner:
    """Two tokenizers: a byte-level one, A, which encodes a blank and the text, and one of pieces, B, which puts the blank itself.

    A blank behind a letter or digit begins a token of A, and one of B if no piece has a blank behind another character. So a text is cut there: each stretch is encoded and
    aligned for itself, with a blank before it like a text, and the results stand one after another. Stretches that recur are looked up.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a_model, self.b_model = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_model.encode_special_tokens = True
        letters, vocabulary = byte_alphabet(), self.a_model.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            tokens[i] = b"".join(bytes([letters[c]]) if c in letters else c.encode() for c in piece)
        self.a = Side(tokens, ",|")
        ids = range(self.b_model.get_piece_size())
        pieces = [self.b_model.id_to_piece(i) for i in ids]
        self.b = Side([bytes([int(p[3:5], 16)]) if self.b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)], ",;\n")
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, Part | None] = {}
        self.old: dict[str, Part | None] = {}

    def stretches(self, text: str | None) -> list[str]:
        """The text cut at blanks, each gone from its stretch."""
        return (CUT.split(text) if self.cuts else [text]) if text else []

    def learn(self, stretches: Iterable[str]) -> None:
        """Encodes and aligns the stretches that aren't known yet. Those whose bytes one side doesn't give back are known as None.

        Stretches are encoded as one text, whose cuts are known; those that end with a blank, behind which a text can't be cut, are texts of their own, and so are all of a text that doesn't come out right.
        """
        alone = []
        for some in batches_of(stretches, PIECE):
            fit = [s for s in some if SOLID.search(s)]
            alone += [s for s in some if not SOLID.search(s)]
            if fit and not self.put(fit):
                alone += fit
        for s in alone:
            if not self.put([s]):
                self.known[s] = None

    def put(self, some: list[str]) -> bool:
        """Encodes and aligns stretches as one text, if both sides give its bytes back and have tokens that end with each stretch."""
        text = " ".join(some)
        a_ids, b_ids, data = self.a_model.encode(" " + text, add_special_tokens=False).ids, self.b_model.encode(text), (" " + text).encode()
        if not self.a.spelled(a_ids) == data == self.b.spelled(b_ids):
            return False
        a, b, ends = np.array(a_ids, np.int64), np.array(b_ids, np.int64), np.cumsum([1 + len(s.encode()) for s in some])
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        last_a, last_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        if (a_end[last_a] != ends).any() or (b_end[last_b] != ends).any():
            return False
        self.known.update(zip(some, self.aligned(a, b, a_end, b_end, last_a, last_b), strict=True))
        return True

    def aligned(self, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> Iterator[Part]:
        """The parts of stretches from the ids of both sides, the bytes where these end, and the last ids of each stretch. Every token has a byte at least, so one of each side ends where a group does, and these two are linked."""
        b_place = np.searchsorted(b_end, a_end)
        a_last = np.flatnonzero(b_end[b_place] == a_end)
        b_last = b_place[a_last]
        a_text, b_text = self.a.digits[0][a], self.b.digits[0][b]
        a_text[a_last], b_text[b_last], b_text[last_b] = self.a.digits[1][a[a_last]], self.b.digits[1][b[b_last]], self.b.digits[2][b[last_b]]
        both = np.empty(len(a) + len(b), "S8")
        group = np.concatenate([[0], np.cumsum(np.bincount(a_last, minlength=len(a)))])[:-1]  # of each token of A
        both[np.arange(len(a)) + np.concatenate([[0], b_last + 1])[group]] = a_text
        both[np.arange(len(b)) + (a_last + 1)[np.searchsorted(b_last, np.arange(len(b)))]] = b_text
        groups = both.tobytes().replace(b"\0", b"").decode().split("\n")
        pairs = (a[a_last] << 32 | b[b_last]).tobytes()
        ends = [0, *(8 * (np.searchsorted(b_last, last_b) + 1)).tolist()]
        sizes = (np.diff(x, prepend=-1).tolist() for x in (last_a, last_b))
        return zip(*sizes, groups[:-1], (pairs[i:j] for i, j in itertools.pairwise(ends)), strict=True)

    def align(self, texts: list[str | None]) -> Iterator[Part]:
        """What each of the texts gives: nothing if there is no text or if either tokenizer's bytes aren't those of a blank and the text."""
        cut = [self.stretches(t) for t in texts]
        here = set(itertools.chain.from_iterable(cut))
        if len(self.known) > KNOWN:
            self.known, self.old = {}, self.known  # what isn't asked for again until the next time is forgotten
        for s in here.difference(self.known).intersection(self.old):
            self.known[s] = self.old[s]
        fresh = here.difference(self.known)
        self.learn(fresh)
        for some in cut:
            parts = [*map(self.known.__getitem__, some)]
            if not parts or None in parts:
                yield 0, 0, "", b""
                continue
            n_a, n_b, groups, pairs = zip(*parts, strict=True)
            yield sum(n_a), sum(n_b), ";".join(groups), b"".join(pairs)
        for s in fresh:
            if len(s) > LONG:
                del self.known[s]


def batches_of(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Texts in runs of so many characters, of one text at least."""
    some, n = [], 0
    for t in texts:
        if some and n + len(t) > most:
            yield some
            some, n = [], 0
        some.append(t)
        n += len(t)
    if some:
        yield some


def aligner(a_path: str, b_path: str) -> Aligner:
    return held(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


ALIGNED = T.StructType([T.StructField("a_ids", T.ArrayType(T.LongType(), False)), T.StructField("b_ids", T.ArrayType(T.LongType(), False)), T.StructField("groups", T.StringType())])


def ids_of(groups: str, side: int) -> list[int]:
    return [int(i) for g in groups.split(";") for i in g.split("|")[side].split(",")] if groups else []


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """docs with a_ids, b_ids and groups, the ids in text order as `a1,a2|b1;a3|b2,b3`, cut where tokens of both end. Narrow.

    A text that is null or empty, or whose bytes either tokenizer doesn't give back, has no ids and no groups.
    """

    def made(texts: list[str | None]) -> dict[str, list]:
        groups = [g for _, _, g, _ in aligner(a_path, b_path).align(texts)]
        return {"a_ids": [ids_of(g, 0) for g in groups], "b_ids": [ids_of(g, 1) for g in groups], "groups": groups}

    return map_texts(docs, text, made, ALIGNED)


def compressed(numbers: np.ndarray) -> bytes:
    """Sorted numbers below BLOCK as a bitmap: themselves if there are few, or bits; the lengths tell which."""
    if len(numbers) < DENSE:
        return numbers.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[numbers] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def members(bitmap: bytes) -> np.ndarray:
    """The numbers in a bitmap, sorted."""
    if len(bitmap) < 2 * DENSE:
        return np.frombuffer(bitmap, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))


def population(bitmap: bytes) -> int:
    return len(bitmap) // 2 if len(bitmap) < 2 * DENSE else int(np.bitwise_count(np.frombuffer(bitmap, np.uint8)).sum())


def either(bitmaps: list[bytes]) -> bytes:
    """The OR of bitmaps."""
    return bitmaps[0] if len(bitmaps) == 1 else compressed(np.unique(np.concatenate([members(b) for b in bitmaps])))


def planes(numbers: np.ndarray, times: np.ndarray) -> list[bytes]:
    """Plane k holds the numbers whose times have bit k set; no planes if all stand once."""
    most = int(times.max())
    return [compressed(numbers[times >> k & 1 == 1]) for k in range(most.bit_length())] if most > 1 else []


POSTINGS = "pair long, block long, documents binary, planes array<binary>"
ROW = f"key long, number long, {', '.join(f'{c} long' for c in DIGITS)}, groups_sha256 string, {POSTINGS}"


def postings(pairs: list[np.ndarray], numbers: list[int], block: int) -> pa.RecordBatch | None:
    """The postings of one block: of each document its linked pairs and its number in the block, which rise."""
    each = [np.unique(p, return_counts=True) for p in pairs]
    pair, times = np.concatenate([p for p, _ in each]), np.concatenate([t for _, t in each])
    if not len(pair):
        return None
    number = np.repeat(np.array(numbers), [len(p) for p, _ in each])
    order = np.argsort(pair, kind="stable")
    pair, times, number = pair[order], times[order], number[order]
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    end = np.concatenate([begin[1:], [len(pair)]])
    several = np.maximum.reduceat(times, begin) > 1
    n = len(begin)
    documents = [compressed(number[a:b]) for a, b in zip(begin, end, strict=True)]
    more = [planes(number[a:b], times[a:b]) if many else [] for a, b, many in zip(begin, end, several, strict=True)]
    return batch_of(n, pair=pa.array(pair[begin]), block=pa.array(np.full(n, block)), documents=pa.array(documents, pa.binary()), planes=pa.array(more, pa.list_(pa.binary())))


FIELDS = [("key", pa.int64()), ("number", pa.int64()), *[(c, pa.int64()) for c in DIGITS], ("groups_sha256", pa.string()), ("pair", pa.int64()), ("block", pa.int64()), ("documents", pa.binary()), ("planes", pa.list_(pa.binary()))]


def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in FIELDS], [name for name, _ in FIELDS])


def indexed(docs: DataFrame, a_path: str, b_path: str, text: str, key: str) -> DataFrame:
    """Rows of two kinds: of each document its key, number and counts, and the postings of the index, whose pair isn't null. docs are numbered by partition and place."""
    numbered = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        numbers: list[int] = []
        block = links = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            if pairs and (made := postings(pairs, numbers, block)) is not None:
                yield made
            pairs.clear()
            numbers.clear()

        for part in itertools.chain.from_iterable(runs(b, 1) for b in batches):
            model = aligner(a_path, b_path)
            rows = []
            for number, (n_a, n_b, groups, linked) in zip(part.column(2).to_pylist(), model.align(part.column(1).to_pylist()), strict=True):
                linked = np.frombuffer(linked, np.int64)
                rows.append((number, n_a, n_b, len(linked), len(linked), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
                if number >> 16 != block or links >= LINKS:
                    yield from flushed()
                    block, links = number >> 16, 0
                pairs.append(linked)
                numbers.append(number & 0xFFFF)
                links += len(linked)
            number, *counts, digest = zip(*rows, strict=True)
            yield batch_of(len(rows), key=part.column(0), number=pa.array(number), groups_sha256=pa.array(digest), **{c: pa.array(x) for c, x in zip(DIGITS, counts, strict=True)})
        yield from flushed()

    return numbered.mapInArrow(run, ROW)


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, documents, links) of postings: the bitmaps of each pair and block are merged and their populations summed by pair. A pair in all blocks is spread over the tasks by its blocks."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        out: list[tuple[int, int, int]] = []
        for (pair, _), some in itertools.groupby(rows, key=lambda r: r[:2]):
            some = [(d, p or [d]) for _, _, d, p in some]
            links = sum(population(either(level)) << k for k, level in enumerate([x for x in level if x] for level in itertools.zip_longest(*(p for _, p in some))) if level)
            out.append((pair, population(either([d for d, _ in some])), links))
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["pair", "documents", "links"])
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["pair", "documents", "links"])

    dealt = index.select("pair", "block", "documents", "planes").repartition("pair", "block").sortWithinPartitions("pair", "block")
    return dealt.mapInArrow(counted, "pair long, documents long, links long").groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))


def scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """(number, count_sum, n_best) of the documents with links: the sum over their links of the pair's count, and how many links are of a pair with the highest count of its B id."""
    best = counts.select("pair", "links", (F.col("links") == F.max("links").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))).alias("best"))  # as many rows a B id as A has ids, at most

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        for block, some in itertools.groupby(rows, key=lambda r: r[0]):
            total, highest = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            for _, documents, levels, links, top in some:
                for k, bitmap in enumerate(levels or [documents]):
                    at = members(bitmap)
                    total[at] += links << k
                    if top:
                        highest[at] += 1 << k
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at + (block << 16)), pa.array(total[at]), pa.array(highest[at])], ["number", "count_sum", "n_best"])

    dealt = index.join(best, "pair").select("block", "documents", "planes", "links", "best").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(summed, "number long, count_sum long, n_best long")


def aligned_pairs(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Two DataFrames. (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row a row of docs; and of each linked pair of ids (a, b, documents, links).

    A text without tokens (see align) has zeros and the digest ''. Copies of a text count each time; repeated or null keys do no harm. Extra columns of docs are left out.
    """
    index = written(indexed(docs, a_path, b_path, text, key))
    bitmaps = index.where("pair is not null").select("pair", "block", "documents", "planes")
    counts = written(pair_counts(bitmaps))
    rows = index.where("pair is null").select("key", "number", *DIGITS, "groups_sha256").join(scores(bitmaps, counts), "number", "left")
    found = rows.select(F.col("key").alias(key), *DIGITS, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    return found, counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "documents", "links")
