"""Language identification with a linear-chain conditional random field over words.

Every word has a language. Its features are affixes, character n-grams and membership in the lexicons of frequent words; transitions between the
languages of neighbours are learned with them, so that text which switches languages is followed. The marginals of forward-backward
label the words; a document's language is the one with the largest sum of marginals. Training and labelling run on arrays in numpy: the
chains of a batch are laid end to end, cut into equal blocks, and the recursions run over all blocks at once, so a very long text costs
no more steps than a short one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import held, map_texts

#: Labelled rows that the model is fitted on, rows that a language has in any case if there are so many, characters of a row, words of a training chain, and chains that an excerpt has.
SAMPLE_ROWS, LANGUAGE_ROWS, SAMPLE_CHARS, CHAIN, SAMPLE_CHAINS = 1200, 50, 20_000, 40, 4
#: With more languages than this, chains are run through word by word, as a matrix a step would cost too much.
MATRIX_LANGUAGES = 16
#: Numbers that the steps run through at once may take; a longer text is run through in stretches, which give the same marginals.
STEPS = 1 << 22
BUCKETS, LEXICON, EPOCHS, RATE, L2 = 1 << 15, 1500, 4, 0.3, 1e-6
UNKNOWN = "und"

#: Characters of a run of letters that are one word, and what stands at the edge of a piece of a longer run.
PIECE, CUT = 24, "\0"
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Numbers that aren't digits, which WORD takes for letters.
NUMBER = regex.compile(r"[\p{No}\p{Nl}]")


def letters(text: str | None) -> str:
    """The text in lower case, with blanks for numbers such as fractions."""
    low = (text or "").lower()
    return low if low.isascii() or not NUMBER.search(low) else NUMBER.sub(" ", low)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, joined by inner apostrophes and hyphens, in lower case; a run of over PIECE characters is cut into pieces."""
    found = WORD.findall(letters(text))
    return [p for w in found for p in pieces(w)] if max(map(len, found), default=0) > PIECE else found


def pieces(word: str) -> list[str]:
    """A long run in pieces of PIECE characters, each with the two that follow, so that no n-gram is lost; CUT marks where the run goes on."""
    if len(word) <= PIECE:
        return [word]
    return [CUT * (i > 0) + word[i : i + PIECE + 2] + CUT * (i + PIECE + 2 < len(word)) for i in range(0, len(word) - 2, PIECE)]


def features(words: list[str], lexicon: dict[str, int], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """(word's number, bucket) of every feature of distinct words, repeated ones included.

    Bucket 0 is on for every word, then come the lexicons, then hashed parts: the character n-grams of one to three within the marked word, which hold
    the short affixes, the affixes of four, and the word. A piece of a long run has the run's start or end only where these are its own.
    """
    marked = [f"{'' if w[0] == CUT else '^'}{w}{'' if w[-1] == CUT else '$'}" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.cumsum(size) - size
    code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(code))  # characters from here to the word's end
    owners, hashes = [word], [code]
    gram = code
    for n in (2, 3, 4):
        gram = gram[:-1] * np.uint64(0x9E3779B1) + code[n - 1 :]
        inside = left[: len(gram)] >= n
        if n == 4:  # affixes only
            inside &= (left[: len(gram)] == 4) | (np.arange(len(gram)) == start[word[: len(gram)]])
        owners.append(word[: len(gram)][inside])
        hashes.append(gram[inside] + np.uint64(n << 60))
    power = np.cumprod(np.full(PIECE + 4, 0x9E3779B97F4A7C15, np.uint64))
    owners.append(np.arange(len(words)))
    hashes.append(np.add.reduceat(code * power[np.arange(len(code)) - start[word]], start) ^ np.uint64(7 << 60))
    mixed = np.concatenate(hashes) * np.uint64(0xD6E8FEB86659FD93)
    base = languages + 1
    at = (mixed >> np.uint64(32)) % np.uint64(BUCKETS - base) + np.uint64(base)
    masks = [lexicon.get(w, 0) for w in words]
    known = np.array([(i, 1 + y) for i, m in enumerate(masks) if m for y in range(languages) if m >> y & 1], np.int64).reshape(-1, 2)
    return np.concatenate([*owners, np.arange(len(words)), known[:, 0]]), np.concatenate([at.astype(np.int64), np.zeros(len(words), np.int64), known[:, 1]])


class Model:
    """Weights of the features, of transitions and of starts, for the languages `labels`."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights, self.moves, self.start = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)

    def emissions(self, words: list[str]) -> np.ndarray:
        """The scores of distinct words, by label."""
        owner, at = features(words, self.lexicon, len(self.labels))
        return np.stack([np.bincount(owner, self.weights[at, y], len(words)) for y in range(len(self.labels))], axis=1)

    def marginals(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The marginals of words (rows) of chains laid end to end; first: True where a chain begins."""
        return forward_backward(emissions, first, self.moves, self.start)[0]

    def stretches(self, rows: Callable[[int, int], np.ndarray], n: int) -> Iterator[np.ndarray]:
        """The marginals of one chain of n words, a stretch at a time; rows: gives the emissions of a stretch.

        The product of each stretch's steps is formed first, so that each gets the vectors that the others send into it, and then it is run through on its own.
        """
        most = max(1, STEPS // len(self.labels) ** 2)
        cuts = [(i, min(i + most, n)) for i in range(0, n, most)]
        opens = lambda i, size: np.arange(i, i + size) == 0
        products = [product(rows(i, j), opens(i, j - i), self.moves, self.start) for i, j in cuts]
        into, out = [np.ones(len(self.labels))], [np.ones(len(self.labels))]
        for p in products[:-1]:
            into.append(into[-1] @ p / (into[-1] @ p).max())
        for p in products[:0:-1]:
            out.append(p @ out[-1] / (p @ out[-1]).max())
        for (i, j), v, w in zip(cuts, into, reversed(out), strict=True):
            yield forward_backward(rows(i, j), opens(i, j - i), self.moves, self.start, ends=(v, w))[0]


def laid_out(e: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps of chains laid end to end, in equal blocks side by side, and each block's product, scaled."""
    n, k = e.shape
    size = max(1, int(n**0.5))
    blocks = -(-n // size)
    pad = blocks * size - n
    emit = np.exp(e - e.max(axis=1, keepdims=True))
    step = np.exp(moves)[None] * emit[:, None, :]
    step[first] = (np.exp(start) * emit[first])[:, None, :]
    if pad:
        step = np.concatenate([step, np.broadcast_to(np.eye(k), (pad, k, k))])
    step = np.ascontiguousarray(step.reshape(blocks, size, k, k).transpose(1, 0, 2, 3))
    whole = step[0].copy()
    for t in range(1, size):
        whole = whole @ step[t]
        whole /= whole.max(axis=(1, 2), keepdims=True)
    return step, whole


def product(e: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The product of the steps of some words, scaled."""
    out = np.eye(e.shape[1])
    if e.shape[1] > MATRIX_LANGUAGES:
        emit, move, begin = np.exp(e - e.max(axis=1, keepdims=True)), np.exp(moves), np.exp(start)
        for i in range(len(e)):
            out = (np.broadcast_to(begin, out.shape) if first[i] else out @ move) * emit[i]
            out = out / out.max()
        return out
    for m in laid_out(e, first, moves, start)[1]:
        out = out @ m
        out /= out.max()
    return out


def forward_backward(e: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False, ends: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of labels, and summed marginals of neighbours if wanted.

    A step is a matrix: the transitions times the word's emissions, or at a chain's first word the same start row from any label. Blocks of steps are
    first multiplied out, all blocks side by side; a pass over the products gives every block its entry and exit vectors; then all
    blocks run forward and backward side by side. Vectors are scaled at every step, which marginals don't see. ends: the vectors that what is before and after sends in.
    """
    n, k = e.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k)) if pairs else None
    ends = ends or (np.ones(k), np.ones(k))
    if k > MATRIX_LANGUAGES:
        return summed(*in_order(e, first, moves, start, *ends), e, first, moves, pairs)
    step, whole = laid_out(e, first, moves, start)
    size, blocks = step.shape[:2]
    into, out = np.ones((blocks, k)), np.ones((blocks, k))
    into[0], out[-1] = ends
    for b in range(1, blocks):
        v = into[b - 1] @ whole[b - 1]
        into[b] = v / v.max()
    for b in range(blocks - 2, -1, -1):
        v = whole[b + 1] @ out[b + 1]
        out[b] = v / v.max()
    alpha, beta = np.empty((size, blocks, k)), np.empty((size, blocks, k))
    v = into[:, None, :]
    for t in range(size):
        v = v @ step[t]
        v /= v.max(axis=2, keepdims=True)
        alpha[t] = v[:, 0]
    v = out[:, :, None]
    for t in range(size - 1, -1, -1):
        beta[t] = v[:, :, 0]
        v = step[t] @ v
        v /= v.max(axis=1, keepdims=True)
    flat = lambda x: x.transpose(1, 0, 2).reshape(blocks * size, k)[:n]
    return summed(flat(alpha), flat(beta), e, first, moves, pairs)


def in_order(e: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward and backward vectors, word by word, from those at the ends."""
    emit, move, begin = np.exp(e - e.max(axis=1, keepdims=True)), np.exp(moves), np.exp(start)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    for i in range(len(e)):
        v = (begin if first[i] else v @ move) * emit[i]
        v /= v.max()
        alpha[i] = v
    for i in range(len(e) - 1, -1, -1):
        beta[i] = w
        w = np.ones(e.shape[1]) if first[i] else move @ (emit[i] * w)
        w /= w.max()
    return alpha, beta


def summed(a: np.ndarray, b: np.ndarray, e: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals, and summed marginals of neighbours if wanted, from forward and backward vectors."""
    m = a * b
    m /= m.sum(axis=1, keepdims=True)
    if not pairs:
        return m, None
    inner = np.flatnonzero(~first)
    before, after, move = a[inner - 1], np.exp(e[inner] - e[inner].max(axis=1, keepdims=True)) * b[inner], np.exp(moves)
    total = ((before @ move) * after).sum(axis=1, keepdims=True)
    return m, move * ((before / total).T @ after)


def fit(rows: list[tuple[str, str]], seed: int = 0) -> Model:
    """A model from (text, language) pairs. Some training chains change from one text to another half-way, which teaches the transitions."""
    labels = sorted({lang for _, lang in rows})
    of = {x: i for i, x in enumerate(labels)}
    texts = [(words_of(t), of[lang]) for t, lang in rows if lang in of]
    texts = [(w, y) for w, y in texts if w]
    counts: list[dict[str, int]] = [{} for _ in labels]
    for words, y in texts:
        for w in words:
            counts[y][w] = counts[y].get(w, 0) + 1
    lexicon: dict[str, int] = {}
    for y, c in enumerate(counts):
        for w in sorted(c, key=lambda w: (-c[w], w))[:LEXICON]:
            if c[w] > 1:
                lexicon[w] = lexicon.get(w, 0) | 1 << y
    model, rng = Model(labels, lexicon), np.random.default_rng(seed)
    if not texts:
        return model
    chains = [(words[i : i + CHAIN], y) for words, y in texts for i in range(0, len(words), CHAIN)]
    order = rng.permutation(len(chains))
    mixed = [(chains[i][0] + chains[j][0], [chains[i][1]] * len(chains[i][0]) + [chains[j][1]] * len(chains[j][0])) for i, j in zip(order[::5], order[1::5], strict=False)]
    data = [(w, [y] * len(w)) for w, y in chains] + mixed
    vocabulary = sorted({w for words, _ in data for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    owner, bucket = features(vocabulary, lexicon, len(labels))
    turn = np.argsort(owner, kind="stable")
    bucket, n_features = bucket[turn], np.bincount(owner, minlength=len(vocabulary))
    begins = np.cumsum(n_features) - n_features
    data = [(np.array([number[w] for w in words]), np.array(y)) for words, y in data]
    k, eye = len(labels), np.eye(len(labels))
    squares = [np.full_like(x, 1e-8) for x in (model.weights, model.moves, model.start)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for i in range(0, len(order), 64):
            part = [data[j] for j in order[i : i + 64]]
            words, gold = np.concatenate([ws for ws, _ in part]), np.concatenate([y for _, y in part])
            first = np.zeros(len(words), bool)
            first[np.cumsum([0, *(len(ws) for ws, _ in part[:-1])])] = True
            sizes = n_features[words]
            starts = np.cumsum(sizes) - sizes
            of_word = np.repeat(np.arange(len(words)), sizes)
            at = bucket[np.arange(len(of_word)) - starts[of_word] + begins[words][of_word]]
            e = np.add.reduceat(model.weights[at], starts, axis=0)
            m, both = forward_backward(e, first, model.moves, model.start, pairs=True)
            truth = eye[gold]
            inner = np.flatnonzero(~first)
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
            used, back = np.unique(at, return_inverse=True)
            rise = np.stack([np.bincount(back, (truth - m)[of_word, y], len(used)) for y in range(k)], axis=1)
            for x, g, s, rows_at in ((model.weights, rise / 64 - L2 * model.weights[used], squares[0], used), (model.moves, (seen - both) / 64, squares[1], slice(None)), (model.start, (truth - m)[first].sum(axis=0) / 64, squares[2], slice(None))):
                s[rows_at] += g * g
                x[rows_at] += RATE * g / np.sqrt(s[rows_at])
    return model


def held_out(key: str = "doc_id"):
    """True for the documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def quotas(counts: dict[str, int], rows: int, least: int) -> dict[str, int]:
    """How many rows to draw of each language: `rows` in all, dealt evenly as far as a language has so many, and `least` of each in any case if it has them."""
    out, left = {}, rows
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        even = min(n, max(0, left) // (len(counts) - i))
        out[lang] = max(even, min(n, least))
        left -= even
    return out


def excerpt(text: str, chains: int = SAMPLE_CHAINS) -> str:
    """A text of at most so many training chains whole, of a longer one that many, spread evenly over all of it."""
    at = [m.span() for m in WORD.finditer(letters(text))]
    n = -(-len(at) // CHAIN)
    if n <= chains:
        return text
    low = letters(text)
    return "\n".join(low[at[k * CHAIN][0] : at[min((k + 1) * CHAIN, len(at)) - 1][1]] for k in ((2 * i + 1) * n // (2 * chains) for i in range(chains)))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, chains: int | None = None, least: int = LANGUAGE_ROWS) -> Model:
    """A model fitted on a sample of the labelled rows that aren't held out: of each language those of the smallest hashes of key and text, whole.

    This is the documented bound of the sample, the same at every size of the table: `rows` in all, dealt evenly over the languages, or `least` of each
    language if that is more; a text of over SAMPLE_CHARS characters counts as several rows of so many. So the driver gets rows * SAMPLE_CHARS characters at most. A first count by language sets a bound on the hashes under which about twice its share lies, so the tasks together send
    no more than these to be put in order. Rows without a language, a text or a key are not learned from, nor counted; repeated ones count once. chains: runs of CHAIN words that are taken of a row, from all over it; None takes all.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    whole = F.col(text).cast("string")
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.char_length("t"), F.lit(1)) - 1) / SAMPLE_CHARS)), lambda i: F.substr("t", (i * SAMPLE_CHARS + 1).cast("int"), F.lit(SAMPLE_CHARS)))
    dealt = usable.select(F.col(key).alias("k"), whole.alias("t"), F.col(lang).cast("string").alias("l")).select("k", F.explode(stretches).alias("t"), "l")
    hashed = dealt.select(F.xxhash64("k", F.lit("sample"), "t").alias("h"), "t", "l")
    counts = {r.l: max(1, r.n) for r in hashed.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    wanted = quotas(counts, rows, least)
    bounds = {x: (1 << 63) - 1 if counts[x] <= 3 * q + 100 else int((2 * q + 60) / counts[x] * (1 << 64)) - (1 << 63) for x, q in wanted.items()}
    bound = F.try_element_at(F.from_json(F.lit(json.dumps(bounds)), "map<string,bigint>"), F.col("l"))

    drawn = hashed.where(F.col("h") <= bound).distinct()
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    most = max(wanted.values(), default=0)
    found = drawn.withColumn("nth", nth).where(F.col("nth") <= max(1, 2 * most)).orderBy("h", "t", "l").collect() if wanted else []
    # counts of distinct rows are approximate, so a small language's quota is all that it has
    sample = [r for r in found if r.nth <= (wanted[r.l] if counts[r.l] > 3 * wanted[r.l] + 100 or wanted[r.l] < counts[r.l] else most)]
    return fit([(r.t if chains is None else excerpt(r.t, chains), r.l) for r in sample])


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
SURE = T.StructType([*PREDICTED.fields, T.StructField("lang_sure", T.DoubleType())])
#: Words whose emissions a worker remembers.
KNOWN_WORDS = 150_000


def identify(docs: DataFrame, model: Model, text: str = "text", added: T.StructType = PREDICTED) -> DataFrame:
    """docs with lang_pred and lang_score, from the text alone: the language with the largest sum of marginals over the words, and its share of the sum.

    A text that is null or has no letter, and any text under a model without languages, is `und` with score 0. Ties go to the first language by name.
    With `added` SURE also lang_sure, the share of the words of which one language has half of the marginals.
    The model is broadcast; its size is fixed by BUCKETS and LEXICON for each language and does not grow with the rows. Narrow: no shuffle.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def predicted(texts: list[str | None]) -> dict[str, list]:
        m, known = held(("languages", name), lambda: (sent.value, {}))
        k = len(m.labels)
        langs, scores, sure = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        lists = [words_of(t) for t in texts] if k else []
        here = set().union(*lists)
        fresh = [w for w in here if w not in known]
        if len(known) + len(fresh) > KNOWN_WORDS:
            for w in [w for w in known if w not in here]:
                del known[w]
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            known.update(zip(part, (row.tobytes() for row in m.emissions(part)), strict=True))
        live = [i for i, ws in enumerate(lists) if ws]
        most = STEPS // max(1, k * k)
        for group in grouped(live, [len(lists[i]) for i in live], most):
            sizes = np.array([len(lists[i]) for i in group])
            rows = lambda words: np.frombuffer(b"".join([known[w] for w in words])).reshape(-1, k)
            if len(group) == 1 and sizes[0] > most:
                words, sums, confident = lists[group[0]], np.zeros((1, k)), np.zeros(1)
                for marginals in m.stretches(lambda i, j: rows(words[i:j]), len(words)):
                    sums += marginals.sum(axis=0)
                    confident += (marginals.max(axis=1) >= 0.5).sum()
            else:
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                first = np.zeros(sizes.sum(), bool)
                first[starts] = True
                marginals = m.marginals(rows(w for i in group for w in lists[i]), first)
                sums, confident = np.add.reduceat(marginals, starts, axis=0), np.add.reduceat((marginals.max(axis=1) >= 0.5).astype(float), starts)
            for i, s, c, n in zip(group, sums, confident, sizes, strict=True):
                best = int(s.argmax())
                langs[i], scores[i], sure[i] = m.labels[best], float(min(1.0, s[best] / n)), float(c / n)
        return {"lang_pred": langs, "lang_score": scores, "lang_sure": sure}

    return map_texts(docs, text, predicted, added)


def grouped(items: list[int], sizes: list[int], most: int):
    """Runs of items of at most `most` in size; an item over that is alone."""
    part, total = [], 0
    for i, n in zip(items, sizes, strict=True):
        if part and total + n > most:
            yield part
            part, total = [], 0
        part.append(i)
        total += n
    if part:
        yield part


def keep_known(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """docs without those whose language can't be told: no letters, or under `least` of the words sure (see identify), unless one language has `least` of the marginals. Columns stay."""
    named = identify(docs.withColumnsRenamed({c: f"doc {c}" for c in docs.columns}), model, f"doc {text}", SURE)
    kept = (F.col("lang_pred") != UNKNOWN) & (F.greatest("lang_sure", "lang_score") >= least)
    return named.where(kept).select(*[F.col(f"`doc {c}`").alias(c) for c in docs.columns])
