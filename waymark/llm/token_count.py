"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie.

A text's count is the sum of those of its pre-tokens. The distinct pre-tokens are inserted in a trie; the forward score of a node, the best score of
any segmentation of the string from the root to it, needs only the nodes above, so it is computed once for all pre-tokens that share the
prefix, and with it the number of pieces of the best segmentation, which is the count where a pre-token ends. A worker keeps its trie from one run of texts to the next.

The scores are not fitted, as tokenizers are not trained here and the given vocabulary, one of merges, has no probabilities: a piece has the log probability that Zipf's law
gives its place in the file, which is in the order of merging and so nearly that of frequency. Other scores are a parameter of Unigram.
"""

from __future__ import annotations

import math
from itertools import chain

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.common import held, map_texts

#: Stands before every pre-token, as the vocabulary writes a blank.
BLANK = "▁"
SCALE = 1_000_000
#: Nodes that a worker's trie has before it is begun anew, counts of pre-tokens that it remembers, characters of a pre-token that goes into the trie; a longer one is scored alone.
NODES, KNOWN, LONG = 400_000, 200_000, 1_000


class Unigram:
    """Pieces with scores, whole numbers, which sum without error; a character without a piece costs `byte` for each of its UTF-8 bytes, a token each."""

    def __init__(self, scores: dict[str, int], byte: int):
        self.scores, self.byte = scores, byte
        lengths: dict[str, set[int]] = {}
        for p in scores:
            if len(p) > 1:
                lengths.setdefault(p[-2:], set()).add(len(p))
        #: By the last two characters, the lengths of the pieces that end with them.
        self.lengths = {k: tuple(sorted(v)) for k, v in lengths.items()}
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        """Begins the trie anew: by node and character the child, by node the forward score and the number of pieces."""
        self.children: dict[int, int] = {}
        self.best, self.number = [0], [0]

    @classmethod
    def from_vocabulary(cls, path: str) -> Unigram:
        """The pieces of a vocabulary file, scored by Zipf's law on their ids; control and byte pieces left out."""
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        total = math.log(sum(1 / (r + 1) for r in range(len(ids))))
        scores = {sp.id_to_piece(i): -round(SCALE * (math.log(r + 1) + total)) for r, i in enumerate(ids)}
        return cls(scores, min(scores.values()) - SCALE)

    def counts(self, words: list[str]) -> list[int]:
        """The number of pieces of each of the words, which are sorted: of the best segmentation, and of equals of the shortest."""
        score, children, best, number = self.score, self.children, self.best, self.number
        path, before, out = [0], "", []
        for w in words:
            if len(w) > LONG:
                out.append(self.alone(w))
                continue
            if len(best) > NODES:
                self.clear()
                children, best, number, path, before = self.children, self.best, self.number, [0], ""
            shared, most = 0, min(len(before), len(w))
            while shared < most and before[shared] == w[shared]:
                shared += 1
            del path[shared + 1 :]
            for j in range(shared + 1, len(w) + 1):
                key = path[-1] << 21 | ord(w[j - 1])
                node = children.get(key)
                if node is None:
                    node = children[key] = len(best)
                    b, n = score(w, j, path, best, number)
                    best.append(b)
                    number.append(n)
                path.append(node)
            out.append(number[path[-1]])
            before = w
        return out

    def score(self, w: str, j: int, path: list[int], best: list[int], number: list[int]) -> tuple[int, int]:
        """(score, pieces) of the best segmentation of the first j characters, from those of the nodes above, path[i] after i characters."""
        get = self.scores.get
        s = get(w[j - 1])
        size = 1 if s is not None else len(w[j - 1].encode())
        up = path[j - 1]
        b, n = best[up] + (s if s is not None else size * self.byte), number[up] + size
        if j > 1:
            for k in self.lengths.get(w[j - 2 : j], ()):
                if k > j:
                    break
                s = get(w[j - k : j])
                if s is not None:
                    up = path[j - k]
                    t, m = best[up] + s, number[up] + 1
                    if t > b or t == b and m < n:
                        b, n = t, m
        return b, n

    def alone(self, w: str) -> int:
        """The count of one long word; only the scores that a piece can reach back to are held."""
        ring = self.longest + 1
        best, number, path = [0] * ring, [0] * ring, Ring(ring)
        for j in range(1, len(w) + 1):
            best[j % ring], number[j % ring] = self.score(w, j, path, best, number)
        return number[len(w) % ring]


class Ring:
    """A path whose node after i characters is i modulo a size."""

    def __init__(self, size: int):
        self.size = size

    def __getitem__(self, i: int) -> int:
        return i % self.size


COUNTED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_words (runs without ASCII white space) and n_tokens of every whole text. A null or blank text has none. Narrow, no shuffle."""

    def counted(texts: list[str | None]) -> dict[str, list]:
        table, known = held(("unigram", path), lambda: (Unigram.from_vocabulary(path), {}))
        lists = [(t or "").encode().split() for t in texts]
        here = set(chain.from_iterable(lists))
        fresh = {BLANK + w.decode(): w for w in here if w not in known}
        if len(known) + len(fresh) > KNOWN:
            for w in [w for w in known if w not in here]:
                del known[w]
        order = sorted(fresh)
        known.update((fresh[w], n) for w, n in zip(order, table.counts(order), strict=True))
        return {"n_words": [len(ws) for ws in lists], "n_tokens": [sum(map(known.__getitem__, ws)) for ws in lists]}

    return map_texts(docs, text, counted, COUNTED)
