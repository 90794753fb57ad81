"""Conversation structure repair by Hirschberg's divide and conquer.

The rows of a conversation are edited at least cost so that their roles read
``(s?(ua)+)?`` by initials: Keep 0, Rerole to user or assistant 1, Delete 2
(the only edit for a blank or duplicate row), Insert an empty user or assistant
row 5; a truncated row that stays adds 5.  Among the cheapest edits the one
whose letters D, I, K, R read ASCII-least is taken.

There are four states: nothing yet, after s, after u, after a.  Inserts belong
to the row that follows them, so a prefix of rows ends in a letter that is no
I, and no such letter string begins another.  A forward vector holds per state
the least cost of reaching it and the place of its letters among the four; a
backward vector the least cost of ending from it.  The two vectors meet in the
middle; of the states on a cheapest way the one with the least letters is the
crossing, and both halves are solved alike, in linear space.

Rows are cut into blocks of ``BLOCK`` in the order of the whole table.  A block
is summed up by its costs and letter places between each two states, so long
conversations are solved twice: over the blocks for the states at their
borders, then inside each block.  Spark sorts a narrow table (keys and text
digests) by range, so a conversation with a third of all rows is spread over
all tasks; first occurrences are a map-side minimum.  Only the last step brings
a conversation's rows together: in order, as a stream, one block at a time.

Defined cases: null text is blank, a null role has no initial; rows of one turn
go by role and then by the MD5 of the text (null first), so rows equal in both
are adjacent; null conversation ids are one conversation; null turns come
first; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.llm.common import shared_table

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
#: The state that a user or assistant row, kept, reroled or inserted, leads to.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}

Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs and letter places of the four states
Element = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]  # the same from each state


def code_of(initial: int, fault: int) -> int:
    """A row as a number under 16: the place of its initial in ``INITIALS`` (3: another) and its fault."""
    return initial * 4 + fault


def edits_of(code: int) -> list[list[tuple[int, str] | None]]:
    """``[from][to]``: cheapest (cost, letters) of one row with the inserts before it."""
    initial, fault = divmod(code, 4)
    out: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state, letters, cost = start, "", 0
        for _ in range(3):  # a third insert would come back to a state at a higher cost
            ways = [(state, "D", 2)]
            if fault not in (BLANK, DUPLICATE):
                stay = 5 if fault == TRUNCATED else 0
                ways.append((NEXT[state], "R", 1 + stay))
                if (initial == 0 and state == NOTHING) or (initial in (1, 2) and NEXT[state] == initial + 1):
                    ways.append((initial + 1, "K", stay))
            for to, letter, price in ways:
                found = (cost + price, letters + letter)
                if out[start][to] is None or found < out[start][to]:
                    out[start][to] = found
            state, letters, cost = NEXT[state], letters + "I", cost + 5
    return out


EDITS = [edits_of(code) for code in range(16)]
#: What is inserted after the last row, by the state it leaves; ends are NOTHING and ASSISTANT.
TAIL = ("", "II", "I", "")


def placed(keys: Sequence) -> tuple[int, ...]:
    """Places of the keys among themselves; None comes last."""
    known = sorted(k for k in keys if k is not None)
    return tuple(known.index(k) if k is not None else 4 for k in keys)


ROWS: list[Element] = [
    (tuple(tuple(FAR if w is None else w[0] for w in ways) for ways in EDITS[code]),
     tuple(placed([None if w is None else w[1] for w in ways]) for ways in EDITS[code])) for code in range(16)]


def unit(state: int) -> Vector:
    return tuple(0 if s == state else FAR for s in range(4)), tuple(0 if s == state else 4 for s in range(4))


def forward(vector: Vector, element: Element) -> Vector:
    costs, places = vector
    best = []
    for to in range(4):
        ways = [(costs[s] + element[0][s][to], places[s], element[1][s][to]) for s in range(4)
                if costs[s] < FAR and element[0][s][to] < FAR]
        best.append(min(ways, default=None))
    return (tuple(FAR if b is None else b[0] for b in best), placed([None if b is None else b[1:] for b in best]))


def backward(costs: tuple[int, ...], element: Element) -> tuple[int, ...]:
    return tuple(min(FAR, *(element[0][s][to] + costs[to] for to in range(4))) for s in range(4))


@lru_cache(1 << 16)
def _row_forward(low: tuple[int, ...], places: tuple[int, ...], code: int) -> tuple[int, Vector]:
    costs, places = forward((low, places), ROWS[code])
    least = min(costs)
    return least, (tuple(c if c >= FAR else c - least for c in costs), places)


@lru_cache(1 << 16)
def _row_backward(low: tuple[int, ...], code: int) -> tuple[int, tuple[int, ...]]:
    costs = backward(low, ROWS[code])
    least = min(costs)
    return least, tuple(c if c >= FAR else c - least for c in costs)


def _lift(costs: tuple[int, ...], by: int) -> tuple[int, ...]:
    return tuple(c if c >= FAR else c + by for c in costs)


class Rows:
    """Vectors over row codes: differences between states are few, so steps are remembered."""

    def __init__(self, codes: bytes):
        self.codes = codes

    def __len__(self) -> int:
        return len(self.codes)

    def forward(self, state: int, lo: int, hi: int) -> Vector:
        total, (costs, places) = 0, unit(state)
        for code in self.codes[lo:hi]:
            more, (costs, places) = _row_forward(costs, places, code)
            total += more
        return _lift(costs, total), places

    def backward(self, state: int, lo: int, hi: int) -> tuple[int, ...]:
        total, costs = 0, unit(state)[0]
        for code in reversed(self.codes[lo:hi]):
            more, costs = _row_backward(costs, code)
            total += more
        return _lift(costs, total)


class Blocks:
    """The same over the summaries of blocks."""

    def __init__(self, elements: list[Element]):
        self.elements = elements

    def __len__(self) -> int:
        return len(self.elements)

    def forward(self, state: int, lo: int, hi: int) -> Vector:
        vector = unit(state)
        for e in self.elements[lo:hi]:
            vector = forward(vector, e)
        return vector

    def backward(self, state: int, lo: int, hi: int) -> tuple[int, ...]:
        costs = unit(state)[0]
        for e in reversed(self.elements[lo:hi]):
            costs = backward(costs, e)
        return costs


def crossings(seq: Rows | Blocks, start: int, end: int) -> list[int]:
    """The states at all borders of the cheapest, then letter-least way from ``start`` to ``end``."""
    states = [start] * (len(seq) + 1)
    states[-1] = end
    todo = [(0, len(seq))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        costs, places = seq.forward(states[lo], lo, mid)
        rest = seq.backward(states[hi], mid, hi)
        states[mid] = min(range(4), key=lambda s: (costs[s] + rest[s], places[s]))
        todo += [(lo, mid), (mid, hi)]
    return states


def last_state(seq: Rows | Blocks) -> tuple[int, int]:
    """(state after the last row, cost of all edits) of a whole conversation."""
    costs, places = seq.forward(NOTHING, 0, len(seq))
    end = min(range(4), key=lambda s: (costs[s] + 5 * len(TAIL[s]), places[s]))
    return end, costs[end] + 5 * len(TAIL[end])


def summary(codes: bytes) -> Element:
    ways = [Rows(codes).forward(s, 0, len(codes)) for s in range(4)]
    return tuple(c for c, _ in ways), tuple(p for _, p in ways)


# ---- Spark ------------------------------------------------------------------

SPACE = r"\x20\x09-\x0D"


def blocks(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(k, block, turn, role, digest, codes, element)``: the blocks of each conversation, with the first row's keys."""
    letter = F.substring(F.coalesce("role", F.lit("")), 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    text = F.coalesce("text", F.lit(""))
    fault = (F.when(~text.rlike(f"[^{SPACE}]"), BLANK)
             .when(~text.rlike(f"[.!?][{SPACE}]*\\z"), TRUNCATED).otherwise(0))
    narrow = rows.select(F.col(key).alias("k"), "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
                         (initial * 4 + fault).cast("int").alias("code"))
    order = ["k", "turn", "role", "digest"]
    placed_rows = shared_table(
        narrow.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt")
        .sortWithinPartitions(*order).drop("salt").withColumn("pos", F.monotonically_increasing_id()), "order")
    block = F.shiftright("pos", BLOCK_BITS).alias("block")
    same = ["k", "role", "digest"]
    first = placed_rows.groupBy(*same).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        *[F.col(c).alias("o_" + c) for c in same], "first")
    again = placed_rows.join(first, [F.col(c).eqNullSafe(F.col("o_" + c)) for c in same]).filter("pos <> first").select(
        "k", block, F.struct("pos", F.lit(-1).alias("code")).alias("row"))
    parts = (placed_rows.select("k", block, F.struct("pos", "code").alias("row"), F.struct("pos", "turn", "role", "digest").alias("head"))
             .unionByName(again, allowMissingColumns=True).groupBy("k", "block")
             .agg(F.array_sort(F.collect_list("row")).alias("rows"), F.min("head").alias("head")))  # at most two per row of the block

    def add(batches):
        import pyarrow as pa
        for batch in batches:
            codes, elements = [], []
            for found in batch.column(batch.schema.get_field_index("rows")).to_pylist():
                out, seen = bytearray(), None
                for r in found:  # a mark of repetition stands before its row
                    if r["code"] < 0:
                        seen = r["pos"]
                    else:
                        initial, fault = divmod(r["code"], 4)
                        out.append(code_of(initial, DUPLICATE if seen == r["pos"] and fault != BLANK else fault))
                codes.append(bytes(out))
                elements.append(np.array(summary(codes[-1]), np.int64).tobytes())
            head = batch.column(batch.schema.get_field_index("head")).flatten()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *head[1:], pa.array(codes, pa.binary()), pa.array(elements, pa.binary())],
                names=["k", "block", "turn", "role", "digest", "codes", "element"])

    kinds = {f.name: f.dataType for f in placed_rows.schema}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in ("k", "block", "turn", "role", "digest")]
                          + [T.StructField(c, T.BinaryType()) for c in ("codes", "element")])
    return shared_table(parts.mapInArrow(add, schema), "blocks")


def repair(rows: DataFrame, key: str = "conv_id", conversations: DataFrame | None = None) -> DataFrame:
    """The edits of ``rows(key, turn, role, text)``, in order: ``(key, step, edit, initial, fault, turn, role, text)``.

    ``edit`` is a letter; ``role`` and ``text`` are the repaired ones (the old ones
    of a deleted row); ``initial`` is the old role's first character, ``fault`` the row's first
    fault (0 none, 1 blank, 2 duplicate, 3 truncated).  A conversation's edits are
    adjacent within a partition.  One of ``conversations(key)`` without rows gives one row with a null edit.
    """
    parts = blocks(rows, key)
    kinds = {f.name: f.dataType for f in parts.schema}
    texts = rows.select(F.col(key).alias("k"), "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")

    def tagged(df: DataFrame, stage: int, **own) -> DataFrame:
        columns = {"turn": kinds["turn"].simpleString(), "role": "string", "digest": "binary", "block": "long", "codes": "binary", "text": "string"}
        return df.select("k", F.lit(stage).alias("stage"), *[own[c].alias(c) if c in own else F.lit(None).cast(t).alias(c)
                                                           for c, t in columns.items()])

    keys = {c: F.col(c) for c in ("turn", "role", "digest")}
    mixed = (tagged(parts, 1, block=F.col("block"), codes=F.col("element"))
             .unionByName(tagged(parts, 2, block=F.col("block"), codes=F.col("codes"), **keys))
             .unionByName(tagged(texts, 2, text=F.col("text"), block=F.lit(1 << 62).cast("long"), **keys)))  # after its block
    if conversations is not None:
        mixed = mixed.unionByName(tagged(conversations.select(F.col(key).alias("k")).distinct(), 0))
    mixed = mixed.repartition("k").sortWithinPartitions("k", "stage", "turn", "role", "digest", "block")
    schema = T.StructType([T.StructField(key, kinds["k"]), T.StructField("step", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("initial", T.StringType()), T.StructField("fault", T.IntegerType()),
                           T.StructField("turn", kinds["turn"]), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def edit(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
        rows, size = [], 0
        for row in log(r for batch in batches for r in stream_rows(batch)):
            rows.append(row)
            size += len(row[-1] or "") + 64
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return mixed.mapInArrow(edit, schema)


def stream_rows(batch) -> Iterator[tuple]:
    """The rows of a record batch, a few hundred as Python values at a time."""
    for at in range(0, batch.num_rows, 256):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def log(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edit rows of the sorted stream of markers, block summaries, blocks and texts."""
    import itertools
    for k, own in itertools.groupby(rows, key=lambda r: r[0]):
        elements, states, waiting, step, last = [], None, [], 0, NOTHING
        path: Iterator[tuple[int, int, int]] = iter(())
        marked = False
        for _, stage, turn, role, _, block, payload, text in own:
            if stage == 0:
                marked = True
            elif stage == 1:
                numbers = np.frombuffer(payload, np.int64).reshape(2, 4, 4)
                elements.append(tuple(tuple(map(tuple, x)) for x in numbers.tolist()))
            elif payload is not None:
                if states is None:
                    whole = Blocks(elements)
                    last, _ = last_state(whole)
                    states = iter(crossings(whole, NOTHING, last))
                    at = next(states)
                waiting.append(payload)
            else:
                found = next(path, None)
                if found is None:
                    codes, (at, start) = waiting.pop(0), (next(states), at)
                    inside = crossings(Rows(codes), start, at)
                    path = zip(codes, inside, inside[1:])
                    found = next(path)
                code, before, after = found
                for letter in EDITS[code][before][after][1]:
                    if letter == "I":
                        before = NEXT[before]
                        yield k, step, "I", None, 0, None, NAMES[before], ""
                    else:
                        new = NAMES[NEXT[before]] if letter == "R" else role
                        yield k, step, letter, (role or "")[:1], code % 4, turn, new, text
                    step += 1
        for letter in TAIL[last]:
            last = NEXT[last]
            yield k, step, "I", None, 0, None, NAMES[last], ""
            step += 1
        if marked and not step:
            yield k, 0, None, None, 0, None, None, None
