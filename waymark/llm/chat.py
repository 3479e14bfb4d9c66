"""Chat formatting with minimum-cost role repair.

A legal conversation opens with a system turn or a user turn, goes on with users and assistants in turn, and ends with an assistant: an automaton whose
state is the role of the turn last written. Dynamic programming over it finds for every conversation the cheapest repairs: a turn may be merged
into the one before of the same role, relabelled, or have empty turns put in before it. Then the repaired turns are rendered.

A turn's step is a matrix of costs from state to state, and steps compose by the (min, +) product. So a conversation of any length is cut into blocks of
bounded size, by places that a sort over the cluster gives: each block's matrix, products of matrices level by level up to one, then down again the best states
at the borders, then each block on its own. No task holds a whole conversation, and texts are only looked at turn by turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import checkpointed, few_samples, runs

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
#: Costs: of a merge, of another role than the turn's, of a role for a turn without a known one, of an empty turn.
MERGE, RELABEL, NAME, INSERT = 1, 2, 1, 3
FAR = 1 << 40
#: Turns of a block, and matrices that one product takes.
BLOCK, FAN = 512, 512


@cache
def inserted(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns after which a turn of the role may follow the state."""
    paths: list[tuple[int, ...]] = [()]
    while paths:
        for p in paths:
            if role in LEGAL[p[-1] if p else state]:
                return p
        paths = [(*p, r) for p in paths if len(p) < 3 for r in LEGAL[p[-1] if p else state]]
    return None


@cache
def step(given: int, state: int, role: int) -> tuple[int, bool, tuple[int, ...]]:
    """(cost, merged, empty turns before) of writing a turn of the given role (0: unknown) as `role` after a state."""
    cost = 0 if given == role else RELABEL if given else NAME
    if state == role:
        empty = inserted(state, role)
        if empty is None or MERGE <= INSERT * len(empty):
            return cost + MERGE, True, ()
    empty = inserted(state, role)
    return (FAR, False, ()) if empty is None else (cost + INSERT * len(empty), False, empty)


@cache
def closing(state: int) -> tuple[int, ...]:
    """The empty turns after which a conversation may end in the state."""
    return {START: (), ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}[state]


def product(roles: list[int]) -> list[int]:
    """The matrix of a block, by rows: the least cost from each state to each."""
    rows = []
    for s in range(4):
        costs = [FAR] * 4
        costs[s] = 0
        for given in roles:
            costs = [FAR] + [min(costs[p] + step(given, p, r)[0] for p in range(4)) for r in (SYSTEM, USER, ASSISTANT)]
        rows += [min(c, FAR) for c in costs]
    return rows


def times(a: list[int], b: list[int]) -> list[int]:
    """The product of two matrices."""
    return [min(FAR, *(a[4 * s + p] + b[4 * p + r] for p in range(4))) for s in range(4) for r in range(4)]


def ending(costs: list[int]) -> int:
    """The cheapest state to end in, the lowest of equals."""
    return min(range(4), key=lambda r: (costs[r] + INSERT * len(closing(r)), r))


def borders(matrices: list[list[int]], enter: int = START, leave: int | None = None) -> tuple[list[int], int]:
    """The state before each block and after the last on the cheapest way from `enter` to `leave`, or to any end, and its cost; of equals the one of lower states, from the end."""
    costs, back = [FAR] * 4, []
    costs[enter] = 0
    for m in matrices:
        back.append([min(range(4), key=lambda p: (costs[p] + m[4 * p + r], p)) for r in range(4)])
        costs = [min(FAR, costs[back[-1][r]] + m[4 * back[-1][r] + r]) for r in range(4)]
    last = ending(costs) if leave is None else leave
    states = [last]
    for b in reversed(back):
        states.append(b[states[-1]])
    return states[::-1], costs[last] + (INSERT * len(closing(last)) if leave is None else 0)


def path(roles: list[int], enter: int, leave: int) -> list[int]:
    """The role that each turn of a block is written as on the cheapest way between two states; of equals that of lower states, from the end."""
    costs, back = [FAR] * 4, []
    costs[enter] = 0
    for given in roles:
        back.append([min(range(4), key=lambda p: (costs[p] + step(given, p, r)[0], p)) if r else 0 for r in range(4)])
        costs = [FAR] + [costs[back[-1][r]] + step(given, back[-1][r], r)[0] for r in (SYSTEM, USER, ASSISTANT)]
    states = [leave]
    for b in reversed(back[1:]):
        states.append(b[states[-1]])
    return states[::-1] if roles else []


def opened(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


CLOSED = "<|im_end|>\n"


def plain(text: str | None) -> str:
    """A turn's text in which nothing passes for a marker; null is empty."""
    return (text or "").replace("<|im_", "<| im_")


def rendered(given: int, text: str | None, state: int, role: int, final: bool) -> tuple[str, str, int, str]:
    """(role, action, empty turns put in, piece) of a turn written as `role` after a state; the pieces of a conversation, joined, are its rendering."""
    _, merged, empty = step(given, state, role)
    action = "+".join([*(["insert"] if empty else []), *(["merge"] if merged else []), *(["relabel"] if given != role else [])]) or "keep"
    piece = "\n" + plain(text) if merged else (CLOSED if state else "") + "".join(opened(r) + CLOSED for r in empty) + opened(role) + plain(text)
    n = len(empty)
    if final:
        after = closing(role)
        piece += CLOSED + "".join(opened(r) + CLOSED for r in after)
        n, action = n + len(after), action if not after else "append" if action == "keep" else action + "+append"
    return ROLES[role], action, n, piece


def codes() -> Column:
    """The number of the role of a turn, 0 if it is unknown."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    known = {**{r: r for r in ROLES[1:]}, **ALIASES}
    out = F.lit(0)
    for name, r in known.items():
        out = F.when(role == name, ROLES.index(r)).otherwise(out)
    return out


def placed(turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, turn, given, text, place) with each turn's place in its conversation, from 0, and the most places of a conversation.

    Turns are sorted over the cluster, so that a long conversation spans partitions; the driver gets what each partition begins and ends with.
    """
    known = turns.select("conv_id", "turn", codes().cast("int").alias("given"), F.col("text").cast("string").alias("text"))
    known = known.withColumns({"begin": F.substring("text", 1, 64), "hash": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "given", "begin", "hash", "nth")]
    spread = known.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "turn", "given", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, runs_, at, n = (), 0, 0, 0
        for b in batches:
            nth, within = [], []
            for c in b.column(1).to_pylist():
                if (c,) != last:
                    last, runs_, n = (c,), runs_ + 1, 0
                nth.append((at, n, runs_ == 1))
                at, n = at + 1, n + 1
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([x[i] for x in nth], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]], [*b.schema.names, "at", "within", "opens"])

    types = dict(spread.dtypes)
    with few_samples(turns.sparkSession):
        found = checkpointed(spread.mapInArrow(counted, ", ".join(f"{c} {types[c]}" for c in spread.columns) + ", at long, within long, opens boolean"))
    ends = found.groupBy("part").agg(F.min_by(F.struct("conv_id"), "at").alias("first"), F.max_by(F.struct("conv_id"), "at").alias("last"), F.count_if("opens").alias("n_first"), (F.max_by("within", "at") + 1).alias("n_last"), F.count("*").alias("n"), F.max("within").alias("most"))
    carried, of, offsets, most = 0, None, [], 0
    for r in sorted(ends.collect(), key=lambda r: r.part):
        offset = carried if r.first == of else 0
        offsets.append((r.part, offset))
        most = max(most, r.most, offset + r.n_first - 1)
        carried, of = (offset + r.n if r.n == r.n_first else r.n_last), r.last
    here = F.broadcast(turns.sparkSession.createDataFrame(offsets, "part int, offset long"))
    place = F.col("within") + F.when(F.col("opens"), F.col("offset")).otherwise(0)
    return found.join(here, "part").select("conv_id", "turn", "given", "text", place.alias("place")), most


def batch(rows: list[tuple], conv: pa.DataType, **types: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((conv, *types.values()))], ["conv_id", *types])


SPANS = {"part": pa.int64(), "enter": pa.int32(), "leave": pa.int32(), "final": pa.bool_()}


def format_chats(turns: DataFrame) -> DataFrame:
    """One row a turn of turns (conv_id, turn, role, text): conv_id, part (of BLOCK places), place in the conversation, turn, role as written, action, n_inserted, piece.

    Turns are taken by number, null first, then by role and by the text's first 64 characters and its hash, so that ties have an order; rows that repeat are turns of their own. A null conv_id is a
    conversation like any; a null or unknown role is to be named; a null text is empty. Extra columns are left out. Where a conversation ends with a
    user, the empty assistant is put after the last turn.
    """
    numbered, most = placed(turns)
    numbered = numbered.withColumn("part", F.floor(F.col("place") / BLOCK))
    conv = dict(turns.dtypes)["conv_id"]

    def gathered(rows: DataFrame, *cols: str) -> DataFrame:
        return rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("all"))

    def joined(a: DataFrame, b: DataFrame, *cols: str) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        return a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part"))).select("a.*", *[f"b.{c}" for c in cols])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [reduce(times, [x["matrix"] for x in xs]) if "matrix" in xs[0] else product([x["given"] for x in xs]) for xs in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int64()))], ["conv_id", "part", "matrix"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch([(c, k, START, borders([m])[0][-1], True) for c, k, m in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)], b.column(0).type, **SPANS)

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, xs, enter, leave, final in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                states, _ = borders([x["matrix"] for x in xs], enter, leave)
                rows += [(c, x["child"], states[i], states[i + 1], final and i + 1 == len(xs)) for i, x in enumerate(xs)]
            yield batch(rows, b.column(0).type, **SPANS)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, k, xs, enter, leave, final in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                rows.append((c, k, [enter, *path([x["given"] for x in xs], enter, leave)], final))
            yield batch(rows, b.column(0).type, part=pa.int64(), states=pa.list_(pa.int32()), final=pa.bool_())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in runs(b, None):
                made = [rendered(*x) for x in zip(*(part.column(i).to_pylist() for i in range(4, 9)), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *[pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))]], ["conv_id", "part", "place", "turn", "role", "action", "n_inserted", "piece"])

    levels = [gathered(numbered, "place", "given")]
    matrices = f"conv_id {conv}, part long, matrix array<long>"
    last = most // BLOCK
    while last:
        below = levels[-1].mapInArrow(multiplied, matrices).select("conv_id", F.col("part").alias("child"), F.floor(F.col("part") / FAN).alias("part"), "matrix")
        levels.append(gathered(below, "child", "matrix"))
        last //= FAN
    spans = f"conv_id {conv}, part long, enter int, leave int, final boolean"
    found = levels[-1].mapInArrow(multiplied, matrices).mapInArrow(whole, spans)
    for level in reversed(levels[1:]):
        found = joined(level, found, "enter", "leave", "final").mapInArrow(divided, spans)
    roles = joined(levels[0], found, "enter", "leave", "final").mapInArrow(written, f"conv_id {conv}, part long, states array<int>, final boolean")
    nth = (F.col("place") % BLOCK).cast("int")
    final = F.col("final") & (nth == F.size("states") - 2)
    every = joined(numbered, roles, "states", "final").select("conv_id", "part", "place", "turn", "given", "text", F.get("states", nth).alias("state"), F.get("states", nth + 1).alias("role"), final.alias("final"))
    turn = dict(turns.dtypes)["turn"]
    return every.mapInArrow(pieces, f"conv_id {conv}, part long, place long, turn {turn}, role string, action string, n_inserted long, piece string")


#: Characters of a rendering that stand in one row.
ROW = 32 << 20


def render_chats(turns: DataFrame, row: int = ROW) -> DataFrame:
    """(conv_id, part, n_turns, n_kept, n_inserted, text): the repaired conversations of format_chats as texts, one row a conversation.

    One whose rendering has over `row` characters comes in parts of about as many, whose texts joined in order are its rendering, as a conversation can be a third of a table. Blocks of BLOCK turns are joined
    first; their sizes, a row a block, tell which go together, and part is 0 for all others.
    """
    made = format_chats(turns)
    blocks = made.groupBy("conv_id", F.col("part").alias("block")).agg(F.count("*").alias("n_turns"), F.count_if(F.col("action") == "keep").alias("n_kept"), F.sum("n_inserted").alias("n_inserted"), F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("all"))
    texts = checkpointed(blocks.withColumn("text", F.array_join("all.piece", "")).drop("all"))
    sizes = texts.select("conv_id", "block", F.char_length("text").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("n")
    part = F.floor(upto / row).alias("part")
    dealt = sizes.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), part)
    both = texts.join(dealt, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    whole = both.groupBy("conv_id", "part").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_kept").alias("n_kept"), F.sum("n_inserted").alias("n_inserted"), F.sort_array(F.collect_list(F.struct("block", "text"))).alias("all"))
    return whole.select("conv_id", "part", "n_turns", "n_kept", "n_inserted", F.array_join("all.text", "").alias("text"))
