"""Spelling variants of a corpus's words by finite-state composition.

The pairs of words one edit apart are what the minimised acceptor of the vocabulary, composed with a one-edit transducer and the acceptor again, accepts. Before its edit the
composed machine is in the same state on both sides; the edit takes it to a pair of states, from which both sides read the same. So pairs of states
are found from the edits of every state onwards, those that can't end are trimmed, and the accepted pairs are listed by the ranks of their words. As states are those
of the minimal acceptor, a pair is worked out once for all words that lead there.

The work is dealt by initial state. Of two words one edit apart, the shorter of length L, the first or the last c = (L - 1) // 2 characters agree; so every
word is entered under the state that its first c characters lead to, and reversed under that of its last c, for L its own length and one less. All edits
behind the first c characters are found in the one, all others in the other. A group is the words of two lengths that agree in half of their
characters; a task holds a batch of groups, of one at least.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import runs, written

RUN, LOWER = r"[A-Za-zÀ-ÿ]", r"[a-zÀ-ÿ]"
#: Different words that a task counts before it passes them on, and words of a batch of groups.
HELD, BATCH = 300_000, 150_000


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7, noise: int | None = 31) -> DataFrame:
    """(word, n): how often each run of letters of at least so many characters stands in the whole texts, A-Z in lower case. A null text has none.

    noise: a run loses a character where the checksum of `<key>:<run>` is divisible by it, that at the checksum modulo the run's length; None: none does. A null key is written as nothing.
    """
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    find = re.compile(LOWER + "{%d,}" % least).findall

    def passed_on(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc32, total = zlib.crc32, Counter()
        for batch in batches:
            for part in runs(batch, 1):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    here = Counter(find(t.encode().lower().decode())) if t else {}
                    if noise is None:
                        total.update(here)
                        continue
                    begin = crc32(f"{k}:".encode())
                    for w, n in here.items():
                        h = crc32(w.encode(), begin)
                        if h % noise == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least:
                                continue
                        total[w] += n
                if len(total) >= HELD:
                    yield passed_on(total)
                    total.clear()
        yield passed_on(total)

    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal acceptor of groups of words: of sorted strings, each with its group, which are sorted too. States are numbered from the longest way to an end upwards."""

    def __init__(self, strings: list[str], group: np.ndarray):
        n, self.size = len(strings), np.fromiter(map(len, strings), np.int64, len(strings))
        codes = np.array(strings)
        wide = codes.dtype.itemsize // 4
        codes = codes.view(np.uint32).reshape(n, wide)
        shared = np.full(n, -1)
        equal = codes[1:] == codes[:-1]
        shared[1:] = np.where(equal.all(axis=1), wide, equal.argmin(axis=1))
        shared[1:] = np.minimum(shared[1:], np.minimum(self.size[1:], self.size[:-1]))
        shared[1:][group[1:] != group[:-1]] = -1
        # the trie, depth by depth: its nodes in the order of their first words, so that a node's children stand together
        first, parent, label, bounds, node = [], [], [], [0], None
        for depth in range(wide + 1):
            new = (self.size >= depth) & (shared < depth)
            at = np.flatnonzero(new)
            first.append(at)
            parent.append(np.full(len(at), -1) if node is None else node[at])
            label.append(np.zeros(len(at), np.int64) if node is None else codes[at, depth - 1].astype(np.int64))
            node = np.cumsum(new) - 1 + bounds[-1]
            bounds.append(bounds[-1] + len(at))
        #: Of each node of the trie the first word below it.
        self.first = np.concatenate(first)
        parent, label, total = np.concatenate(parent), np.concatenate(label), len(self.first)
        depth = np.repeat(np.arange(wide + 1), np.diff(bounds))
        ends = self.size[self.first] == depth
        words, far, near = ends.astype(np.int64), np.zeros(total, np.int64), np.where(ends, 0, 1 << 40)
        for a, b in zip(bounds[-2:0:-1], bounds[:1:-1], strict=True):
            np.add.at(words, parent[a:b], words[a:b])
            np.maximum.at(far, parent[a:b], far[a:b] + 1)
            np.minimum.at(near, parent[a:b], near[a:b] + 1)
        below = bounds[1]  # nodes from here on have a parent; they stand in its order
        children = np.bincount(parent[below:], minlength=total)
        child = np.cumsum(children) - children + below
        # nodes of equal height are one state if they end alike and their edges, taken from the last, make equal lists
        self.state, states, stand = np.full(total, -1), 0, []
        order = np.argsort(far, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(far[order])) + 1):
            tail, known = ends[some].astype(np.int64), 2
            for k in range(int(children[some].max(initial=0))):
                have = np.flatnonzero(children[some] > k)
                to = child[some[have]] + children[some[have]] - 1 - k
                edge = np.unique(label[to] << 40 | self.state[to], return_inverse=True)[1]
                made, tail[have] = np.unique(edge << 32 | tail[have], return_inverse=True)
                tail[have] += known
                known += len(made)
            _, one, which = np.unique(tail, return_index=True, return_inverse=True)
            self.state[some] = which + states
            states += len(one)
            stand.append(some[one])
        stand = np.concatenate(stand) if stand else np.zeros(0, np.int64)
        self.ends, self.words, self.far, self.near = ends[stand], words[stand], far[stand], near[stand]
        #: Edges by state and label: from, label, to, and how many of the state's words come before those of the edge.
        degree = children[stand]
        self.source = np.repeat(np.arange(states), degree)
        self.begin = np.concatenate([[0], np.cumsum(degree)])
        at = np.repeat(child[stand] - self.begin[:-1], degree) + np.arange(self.begin[-1])
        self.label, self.to = label[at], self.state[at]
        passed = np.cumsum(self.words[self.to]) - self.words[self.to]
        self.skipped = passed - passed[self.begin[self.source]] + self.ends[self.source]
        self.key = self.source << 21 | self.label
        #: Nodes of the trie by state.
        self.nodes = np.argsort(self.state, kind="stable")
        self.node_begin = np.concatenate([[0], np.cumsum(np.bincount(self.state, minlength=states))])

    def edits(self) -> tuple[np.ndarray, ...]:
        """(state, left state, right state, words skipped on the left, on the right) of every edit: another character, or one that only the left side has."""
        every = [(self.source, self.to, self.source, self.skipped, np.zeros(len(self.to), np.int64))]
        step, e = 1, np.arange(len(self.to))
        while len(e := e[e + step < len(self.to)]) and len(e := e[self.source[e] == self.source[e + step]]):
            every.append((self.source[e], self.to[e], self.to[e + step], self.skipped[e], self.skipped[e + step]))
            step += 1
        found = tuple(np.concatenate(c) for c in zip(*every, strict=True))
        return self.chosen(found, self.can_meet(found[1], found[2]))

    @staticmethod
    def chosen(columns: tuple[np.ndarray, ...], rows: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(c[rows] for c in columns)

    def can_meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words of equal length go on from both states. A group's words have two neighbouring lengths, so from its states these are ranges."""
        return np.maximum(self.near[a], self.near[b]) <= np.minimum(self.far[a], self.far[b])

    def steps(self, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(which of the pairs, pair it leads to, words skipped on the left, on the right) of every character that both states of a pair read."""
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        degree = self.begin[a + 1] - self.begin[a]
        which = np.repeat(np.arange(len(pairs)), degree)
        e = np.repeat(self.begin[a] - (np.cumsum(degree) - degree), degree) + np.arange(len(which))
        wanted = b[which] << 21 | self.label[e]
        f = np.searchsorted(self.key, wanted)
        met = np.flatnonzero(self.key[np.minimum(f, len(self.key) - 1)] == wanted) if len(self.key) else np.zeros(0, np.int64)
        which, e, f = which[met], e[met], f[met]
        met = self.can_meet(self.to[e], self.to[f])
        return which[met], (self.to[e] << 32 | self.to[f])[met], self.skipped[e][met], self.skipped[f][met]

    def accepted(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of words, by number, one edit apart within a group: the longer first, or if they are as long in either order; some more than once."""
        state, left, right, x, y = self.edits()
        start = left << 32 | right
        known = fresh = np.unique(start)
        every: list[tuple[np.ndarray, ...]] = []
        while len(fresh):
            which, to, *skipped = self.steps(fresh)
            every.append((fresh[which], to, *skipped))
            fresh = np.setdiff1d(to, known)
            known = np.union1d(known, fresh)
        source, to, dx, dy = (np.concatenate(c) for c in zip(*every, strict=True)) if every else (np.zeros(0, np.int64),) * 4
        source, to, start = (np.searchsorted(known, k) for k in (source, to, start))
        last = self.ends[known >> 32] & self.ends[known & 0xFFFFFFFF]
        good = last.copy()
        while len(more := source[good[to] & ~good[source]]):
            good[more] = True
        source, to, dx, dy = self.chosen((source, to, dx, dy), np.flatnonzero(good[to] & good[source]))
        order = np.argsort(source, kind="stable")
        source, to, dx, dy = self.chosen((source, to, dx, dy), order)
        begin = np.searchsorted(source, np.arange(len(known) + 1))
        now = self.chosen((state, start, x, y), np.flatnonzero(good[start]))
        found = []
        while len(now[0]):
            found.append(self.chosen((now[0], now[2], now[3]), last[now[1]]))
            degree = begin[now[1] + 1] - begin[now[1]]
            which = np.repeat(np.arange(len(degree)), degree)
            e = np.repeat(begin[now[1]] - (np.cumsum(degree) - degree), degree) + np.arange(len(which))
            now = (now[0][which], to[e], now[2][which] + dx[e], now[3][which] + dy[e])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        state, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        ways = self.node_begin[state + 1] - self.node_begin[state]
        which = np.repeat(np.arange(len(state)), ways)
        word = self.first[self.nodes[np.repeat(self.node_begin[state] - (np.cumsum(ways) - ways), ways) + np.arange(len(which))]]
        return word + x[which], word + y[which]


def half(length):
    """Of the length of the shorter word how many characters at one end agree."""
    return (length - 1) // 2


def near_in(shorter: list[int], side: list[int], strings: list[str], n: np.ndarray) -> pa.RecordBatch:
    """(a, a_n, b, b_n) of the near words of whole groups, sorted by shorter, side and string; strings are reversed on side 1."""
    cut = [half(k) for k in shorter]
    heads = [(k, s, t[:c]) for k, s, t, c in zip(shorter, side, strings, cut, strict=True)]
    begins = [True] + [a != b for a, b in itertools.pairwise(heads)]
    machine = Acceptor([t[c:] for t, c in zip(strings, cut, strict=True)], np.cumsum(begins))
    x, y = machine.accepted()
    x, y = np.minimum(x, y), np.maximum(x, y)
    both = np.unique(x << 32 | y)
    x, y = both >> 32, both & 0xFFFFFFFF
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    of = np.array(shorter)
    mine = np.minimum(size[x], size[y]) == of[x]
    x, y = x[mine].tolist(), y[mine].tolist()
    words = [t[::-1] if s else t for t, s in zip(strings, side, strict=True)]
    kept = [(i, j) for i, j in zip(x, y, strict=True) if not side[i] or words[i][: cut[i]] != words[j][: cut[j]]]  # those that agree in the first half were found there
    x, y = [i for i, _ in kept], [j for _, j in kept]
    columns = [pa.array([words[i] for i in x], pa.string()), pa.array(n[x] if x else [], pa.int64()), pa.array([words[j] for j in y], pa.string()), pa.array(n[y] if y else [], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["a", "a_n", "b", "b_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two of the different words (word, n) that one inserted, deleted or replaced character makes equal, once, in either order."""
    lengths = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda k: k > 0)
    entered = words.where("word is not null and word != ''").select("word", "n", F.explode(lengths).alias("shorter")).select("shorter", F.posexplode(F.array("word", F.reverse("word"))).alias("side", "string"), "n")
    dealt = entered.repartition("shorter", "side", F.substring(F.col("string"), F.lit(1), F.floor((F.col("shorter") - 1) / 2).cast("int"))).sortWithinPartitions("shorter", "side", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def done(n: int) -> pa.RecordBatch:
            shorter, side, strings, counts = zip(*rows[:n], strict=True)
            del rows[:n]
            return near_in(list(shorter), list(side), list(strings), np.array(counts, np.int64))

        def head(i: int) -> tuple:
            return (*rows[i][:2], rows[i][2][: half(rows[i][0])])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[0] > 2 * rows[0][0] + 16:  # lengths of a batch are alike
                    yield done(len(rows))
                rows.append(row)
            if len(rows) >= BATCH:
                n = len(rows) - 1
                while n and head(n - 1) == head(n):
                    n -= 1
                if n:
                    yield done(n)
        if rows:
            yield done(len(rows))

    return dealt.select("shorter", "side", "string", "n").mapInArrow(run, "a string, a_n long, b string, b_n long")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of different words (word, n): how many words are near each, and the commonest of them, of equals the first in code-point order, if it is `ratio` times as common at least; root follows forms to the last.

    A word without a form is its own root. Empty and null words are left out of the near ones. words is read twice: it should be a written table.
    """
    both = F.explode(F.array(*[F.struct(F.col(a).alias("word"), F.struct((-F.col(f"{b}_n")).alias("less"), F.col(b).alias("near")).alias("other")) for a, b in (("a", "b"), ("b", "a"))]))
    near = near_words(words).select(both.alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    known = written(known)
    ties = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a form is several times as common, so ways are short, and every round doubles what is known of them
        up = ties.select(F.col("word").alias("root"), F.col("root").alias("above"))
        ties = written(ties.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if not ties.where("moved").limit(1).count():
            break
        ties = ties.drop("moved")
    return known.join(ties.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7, often: int = 2, ratio: int = 10, noise: int | None = 31) -> DataFrame:
    """variants of the words of whole texts that have `least` characters and stand `often` times in all, or more. Nulls and empty tables give no words; copies count as often as they stand."""
    return variants(written(word_counts(docs, text, key, least, noise).where(F.col("n") >= often)), ratio)
