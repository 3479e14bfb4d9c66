"""Byte-level BPE encoding and decoding by tree reduction.

The encodings of byte strings form a monoid under "encode the concatenation". A match of the split pattern is halved until
its parts are short, the parts are merged by rank, and neighbours are joined going up the tree. A join encodes anew only a
window around the seam. It may stop as soon as the two pairs of tokens at the window's edges are compatible, where a pair
(a, b) is compatible if encoding the bytes of a and b together gives (a, b) again. That is a proof and not a heuristic: merging
always takes the lowest rank, then the leftmost place, so the first merge across some token boundary of the whole string
would also be made when the two tokens beside it are encoded alone; if every adjacent pair is compatible there is none.
Pairs inside a part are compatible because the part is an encoding. Otherwise the window doubles, from the seam alone on.

The trees of all new matches of a run of texts go up together, a level at a time, so that what a level has to merge is merged in one go
on arrays; texts are looked up in what comes of their distinct words. Decoding halves the ids, looks up the bytes of short parts
and concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.common import held, map_texts

#: Bytes of a leaf when encoding, ids of one when decoding, bytes of the longest string that is merged on arrays, strings merged at a time.
LEAF, LEAF_IDS, WIDE, ROWS = 8, 4096, 64, 1 << 14
NONE = np.int32((1 << 31) - 1)
#: Words and matches of the pattern whose ids a worker remembers; when there are more all are forgotten.
KNOWN = 100_000

SPACES = "".join(c for c in map(chr, range(0x10000)) if c.isspace())

#: Arrays end to end: the values, and where each array begins and how long it is.
Ragged = tuple[np.ndarray, np.ndarray, np.ndarray]


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of an array that begin at these places and have these sizes, end to end."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Store:
    """Ids by string, packed in one array."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, strings: list[str], make: Callable[[list[str]], Ragged]) -> np.ndarray:
        """Where begin and size have the ids of each string; those that are new are made together."""
        if len(self.index) > KNOWN or len(self.flat) > 16 * KNOWN:
            self.__init__()
        index = self.index
        fresh = [s for s in dict.fromkeys(strings) if s not in index]
        if fresh:
            flat, begin, size = make(fresh)
            index.update(zip(fresh, range(len(self.begin), len(self.begin) + len(fresh)), strict=True))
            self.begin, self.size = np.concatenate([self.begin, begin + len(self.flat)]), np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
        return np.fromiter(map(index.__getitem__, strings), np.int64, len(strings))


class Codec:
    """Encodes and decodes with a table of ranks, token bytes to id, that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        tokens = {i: b for b, i in ranks.items()}
        self.size = np.zeros(max(tokens) + 1, np.int64)
        self.size[list(tokens)] = [len(b) for b in tokens.values()]
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes2 = np.array([ranks.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)], np.int32)
        pairs = sorted({(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks})
        self.pairs, self.pair_ids = np.array([p for p, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int32)
        self.words, self.matches = Store(), Store()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    # merging by rank

    def merge(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Ragged:
        """The ids of slices of bytes: of the adjacent pairs the one of lowest rank is merged, the leftmost of equals, until none has a rank."""
        at, count, parts, total, least = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [np.zeros(0, np.int32)], 0, 1
        for width in (LEAF, 2 * LEAF, 4 * LEAF, WIDE):
            found = np.flatnonzero((size >= least) & (size <= width))
            for i in range(0, len(found), ROWS):
                part = found[i : i + ROWS]
                ids, n = self._merge_rows(data, begin[part], size[part], width)
                at[part], count[part] = total + np.arange(len(part)) * width, n
                parts.append(ids.ravel())
                total += len(parts[-1])
            least = width + 1
        for k in np.flatnonzero(size > WIDE).tolist():
            parts.append(np.array(self._merge_long(data[begin[k] : begin[k] + size[k]].tobytes()), np.int32))
            at[k], count[k] = total, len(parts[-1])
            total += len(parts[-1])
        return np.concatenate(parts), at, count

    def _merge_rows(self, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(a row of ids for each, how many of it count) of slices of at most `width` bytes, a merge of each at a time."""
        columns = np.arange(width)
        rows = data[np.minimum(begin[:, None] + columns, len(data) - 1)]
        ids, left = self.byte[rows], sizes.copy()
        low = self.bytes2[rows[:, :-1].astype(np.int32) << 8 | rows[:, 1:]]
        low[columns[1:] >= sizes[:, None]] = NONE
        done, count, live = np.zeros_like(ids), sizes.copy(), np.arange(len(sizes))
        while True:
            row = np.arange(len(live))
            at = low.argmin(axis=1)
            new = low[row, at]
            go = new != NONE
            if not go.all():
                done[live[~go]], count[live[~go]] = ids[~go], left[~go]
                live, ids, low, left, at, new = live[go], ids[go], low[go], left[go], at[go], new[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            left -= 1
            ids = np.take_along_axis(ids, np.minimum(columns + (columns > at[:, None]), width - 1), axis=1)
            low = np.take_along_axis(low, np.minimum(columns[:-1] + (columns[:-1] >= at[:, None]), width - 2), axis=1)
            low[:, -1] = NONE
            ids[row, at] = new
            for k, there in ((at, at + 1 < left), (at - 1, at > 0)):
                r = row[there]
                low[r, k[there]] = self._rank(ids[r, k[there]], ids[r, k[there] + 1])
            low[row[at + 1 >= left], at[at + 1 >= left]] = NONE
        return done, count

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ids[at], NONE)

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for one string with a heap, for windows that grew."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or not alive[mid] or end[mid] != stop:
                continue
            alive[mid], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (j := before[i]) >= 0 and (r := ranks.get(data[j:stop])) is not None:
                heapq.heappush(heap, (r, j, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where encoding the bytes of a pair of tokens gives these two again."""
        pairs, back = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        both = np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)
        size = self.size[both]
        data, total = gathered(self.flat, self.begin[both].ravel(), size.ravel()), size.sum(axis=1)
        flat, at, count = self.merge(data, np.cumsum(total) - total, total)
        return ((count == 2) & (flat[at] == both[:, 0]) if len(pairs) else np.zeros(0, bool))[back]

    # the tree

    def encode_pieces(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Ragged:
        """The ids of slices of bytes, of one byte at least, by trees whose leaves have LEAF bytes."""
        n = -(-size // LEAF)
        owner = np.repeat(np.arange(len(size)), n)
        start = begin[owner] + LEAF * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(start + LEAF, (begin + size)[owner])
        flat, at, count = self.merge(data, start, stop - start)
        while len(owner) > len(size):
            node = np.arange(len(owner))
            nth = node - np.maximum.accumulate(np.where(np.diff(owner, prepend=-1) != 0, node, 0))
            left = np.flatnonzero((nth[:-1] % 2 == 0) & (owner[1:] == owner[:-1]))
            made = self._join(data, (flat, at[left], count[left]), (flat, at[left + 1], count[left + 1]), stop[left])
            at[left], count[left], stop[left] = made[1] + len(flat), made[2], stop[left + 1]
            flat = np.concatenate([flat, made[0]])
            owner, at, count, stop = (np.delete(x, left + 1) for x in (owner, at, count, stop))
        return flat, at, count

    def _join(self, data: np.ndarray, left: Ragged, right: Ragged, seam: np.ndarray) -> Ragged:
        """The encodings of the concatenations of encoded neighbours; seam: where in the data they meet."""
        flat, a, n = left
        _, b, m = right
        before, after = n.copy(), np.zeros_like(m)  # how many ids stay on the left, and go on the right
        middle, size, parts, total = np.zeros_like(n), np.zeros_like(n), [flat], len(flat)
        until = np.concatenate([[0], np.cumsum(self.size[flat])])
        open_ = np.flatnonzero(~self.compatible(flat[a + n - 1], flat[b]))
        width = 1
        while len(open_):
            i = open_
            before[i], after[i] = np.maximum(0, n[i] - width), np.minimum(m[i], width)
            from_ = seam[i] - until[a[i] + n[i]] + until[a[i] + before[i]]
            new, at, count = self.merge(data, from_, seam[i] + until[b[i] + after[i]] - until[b[i]] - from_)
            middle[i], size[i] = at + total, count
            parts.append(new)
            total += len(new)
            bad, x, y = np.zeros(len(i), bool), np.flatnonzero(before[i] > 0), np.flatnonzero(after[i] < m[i])
            bad[x] |= ~self.compatible(flat[a[i[x]] + before[i[x]] - 1], new[at[x]])
            bad[y] |= ~self.compatible(new[at[y] + count[y] - 1], flat[b[i[y]] + after[i[y]]])
            open_, width = i[bad], 2 * width
        begins, sizes = np.stack([a, middle, b + after], axis=1), np.stack([before, size, m - after], axis=1)
        every = sizes.sum(axis=1)
        return gathered(np.concatenate(parts), begins.ravel(), sizes.ravel()), np.cumsum(every) - every, every

    # texts

    def _of_matches(self, matches: list[str]) -> Ragged:
        """A match that is a token is that token; the others go up the tree."""
        raw = [m.encode() for m in matches]
        whole = np.fromiter((self.ranks.get(b, -1) for b in raw), np.int64, len(raw))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        begin, rest = np.cumsum(size) - size, np.flatnonzero(whole < 0)
        flat, at, count = self.encode_pieces(np.frombuffer(b"".join(raw), np.uint8), begin[rest], size[rest])
        begins, counts = np.arange(len(raw)) + len(flat), np.ones(len(raw), np.int64)
        begins[rest], counts[rest] = at, count
        return np.concatenate([flat, whole.astype(np.int32)]), begins, counts

    def _of_texts(self, texts: list[str]) -> Ragged:
        """Texts that are split by the pattern each."""
        lists = list(map(self.split, texts))
        at = self.matches.places([m for ms in lists for m in ms], self._of_matches)
        until = np.concatenate([[0], np.cumsum(self.matches.size[at])])
        ends = until[np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return gathered(self.matches.flat, self.matches.begin[at], self.matches.size[at]), begin, ends - begin

    def _of_words(self, words: list[str]) -> Ragged:
        """Words, each with the blank before it, are split by the pattern as one text."""
        matches = self.split("".join(words))
        at = self.matches.places(matches, self._of_matches)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        last = np.searchsorted(np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches))), ends, side="right")
        until = np.concatenate([[0], np.cumsum(self.matches.size[at])])[last]
        begin = np.concatenate([[0], until[:-1]])
        return gathered(self.matches.flat, self.matches.begin[at], self.matches.size[at]), begin, until - begin

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each begins and the last ends).

        The pattern breaks before a single blank between other characters, so there texts are cut, and words that repeat are encoded once;
        a text with more white space in a place, or with some at its ends, is split by the pattern whole.
        """
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begin = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        bad = pc.not_equal(pc.utf8_length(pc.utf8_trim(coded.dictionary, SPACES)), pc.max_element_wise(pc.utf8_length(coded.dictionary), 1)).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(np.add.reduceat(bad[at], begin[:-1], dtype=np.int64)) if len(texts) else np.zeros(0, np.int64)
        count = np.diff(begin)
        count[odd] = 1
        rest = np.ones(len(at), bool)  # words that follow a blank
        rest[begin[:-1]] = False
        for i in odd.tolist():
            rest[begin[i] : begin[i + 1]] = False
        bare = [words[k] for k in at[begin[:-1]].tolist()]
        for i in odd.tolist():
            bare[i] = texts[i]
        used = np.zeros(len(words), bool)
        used[at[rest]] = True
        where = np.zeros(len(words), np.int64)
        where[used] = self.words.places([" " + words[k] for k in np.flatnonzero(used).tolist()], self._of_words)
        where = where[at[rest]]
        flat, bare_at, bare_n = self._of_texts(bare)
        is_bare = np.zeros(len(texts) + len(where), bool)
        is_bare[np.cumsum(count) - count] = True
        begins, sizes = np.empty(len(is_bare), np.int64), np.empty(len(is_bare), np.int64)
        begins[is_bare], sizes[is_bare] = bare_at + len(self.words.flat), bare_n
        begins[~is_bare], sizes[~is_bare] = self.words.begin[where], self.words.size[where]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(count)])]
        return gathered(np.concatenate([self.words.flat, flat]), begins, sizes).astype("<u4"), ends

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_texts([text])[0].tobytes()

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The bytes of ids, packed or as an array: halves are decoded each and concatenated, short parts are looked up."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        if len(ids) > LEAF_IDS:
            half = LEAF_IDS << (-(-len(ids) // LEAF_IDS) - 1).bit_length() - 1
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return gathered(self.flat, self.begin[ids], self.size[ids]).tobytes()


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, one for each Python worker."""
    return held(("codec", path, pattern), lambda: Codec.from_file(path, pattern))


ENCODED = T.StructType([T.StructField("token_ids", T.ArrayType(T.LongType(), False)), T.StructField("n_tokens", T.LongType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
ROUND_TRIP = T.StructType([*ENCODED.fields, T.StructField("decoded_sha256", T.StringType())])


def per_text(path: str, pattern: str, texts: list[str | None]):
    """(codec, text, ids) of each text; a null one is empty."""
    c, texts = codec(path, pattern), [t or "" for t in texts]
    ids, begin = c.encode_texts(texts)
    for t, a, b in zip(texts, begin.tolist(), begin[1:].tolist(), strict=False):
        yield c, t, ids[a:b]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with token_ids and n_tokens of every whole text. A null text counts as empty: no ids. Narrow, no shuffle."""

    def ids(texts: list[str | None]) -> dict[str, list]:
        made = [x.astype("i8") for _, _, x in per_text(path, pattern, texts)]
        return {"token_ids": made, "n_tokens": [len(x) for x in made]}

    return map_texts(docs, text, ids, ENCODED)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with token_ids, n_tokens and decoded_sha256: encodes every whole text, decodes the ids and fails if that isn't the text. A null text counts as empty."""

    def made(texts: list[str | None]) -> dict[str, list]:
        out = {f: [] for f in ROUND_TRIP.fieldNames()}
        for c, t, ids in per_text(path, pattern, texts):
            decoded = c.decode(ids)
            if decoded != t.encode():
                raise ValueError("the ids of a text decode to another text")
            out["token_ids"].append(ids.astype("i8"))
            out["n_tokens"].append(len(ids))
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
        return out

    return map_texts(docs, text, made, ROUND_TRIP)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: encodes every whole text and decodes the ids. A null text counts as empty."""

    def hashed(texts: list[str | None]) -> dict[str, list]:
        out = {f: [] for f in DIGESTS.fieldNames()}
        for c, _, ids in per_text(path, pattern, texts):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
        return out

    return map_texts(docs, text, hashed, DIGESTS)
