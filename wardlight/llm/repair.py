"""Conversation structure repair: cheapest edits to turns by divide and conquer over four-state cost vectors.

A repaired conversation is an optional system turn and then pairs of user and assistant turns. What has been written so far
is in one of four states: nothing, after system, after user, after assistant. An edit keeps (K), reroles (R) or deletes (D)
a turn, or inserts (I) one in front of it. A letter leads from a state to one state only, so an audit (the letters in
order) names its edits, and audits over the same turns are never a beginning of one another.

Hirschberg's scheme: a stretch of turns with a known state at both ends is halved; a cost vector from the front
(with the order of the least audits that reach each state) and one from the back meet in the middle; of the cheapest
crossings the one with the least audit is taken, and both halves go on alone. No table of all turns is kept.

The same scheme holds a conversation of any length: turns are cut into blocks of at most ``BLOCK``; a block becomes a
4 x 4 matrix of costs and orders, blocks of one file part are composed to one matrix, and parts of one conversation
likewise. Crossings then come down: from conversations to parts, to blocks, to turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 0, 3, 4, 3, 3
#: letters of one turn's edits, in ASCII order
PIECES = ["D", "IK", "IR", "K", "R"]
#: what completes a conversation from each state
TAIL = ["", "II", "I", ""]
FAR = 1 << 40
#: a block is ``1 << BLOCK_BITS`` turns at most
BLOCK_BITS = 10
PART_BITS = 33  # monotonically_increasing_id: the part of the file above, the row below
MUST_GO = 8  # class of a turn that is blank or repeated; 0 to 3 are sound ones by initial, 4 to 7 truncated ones


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Cost and piece from each state to each state, by class of turn."""
    cost = np.full((9, 4, 4), FAR, np.int64)
    piece = np.zeros((9, 4, 4), np.int64)

    def offer(kind: int, a: int, b: int, price: int, letters: str) -> None:
        k = PIECES.index(letters)
        if (price, k) < (cost[kind, a, b], piece[kind, a, b]):
            cost[kind, a, b], piece[kind, a, b] = price, k

    for kind in range(9):
        for a in range(4):
            offer(kind, a, a, DELETE_COST, "D")
            if kind == MUST_GO:
                continue
            role, extra = kind % 4, CUT_COST * (kind >= 4)
            if a == START and role == 0:
                offer(kind, a, SYSTEM, KEEP_COST + extra, "K")
            here = ASSISTANT if a == USER else USER  # what may stand next
            other = USER if here == ASSISTANT else ASSISTANT  # what may stand behind an inserted turn
            for inserted, b in ((0, here), (1, other)):
                own = role == (1 if b == USER else 2)
                offer(kind, a, b, INSERT_COST * inserted + (KEEP_COST if own else REROLE_COST) + extra, "I" * inserted + ("K" if own else "R"))
    return cost, piece


COST, PIECE = _transitions()
TAIL_COST = np.array([INSERT_COST * len(x) for x in TAIL], np.int64)


def _steps(length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(step, lanes not yet at their end), until all are."""
    order = np.argsort(-length, kind="stable")
    left = np.sort(length)
    for i in range(int(length.max(initial=0))):
        yield i, order[: len(length) - int(np.searchsorted(left, i, "right"))]


def _advance(v: np.ndarray, cost: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One element further: ``v`` is 4 * cost + order of the least audit, by state; ``cost`` and ``order`` are (lanes, from, to)."""
    offers = v[:, :, None] + 4 * cost
    best = offers.min(1)
    way = offers.argmin(1)
    own = (best & 3) * 8 + np.take_along_axis(order, way[:, None, :], 1)[:, 0, :]
    own = np.where(best >= FAR, 99, own)
    return (best >> 2 << 2) + (own[:, :, None] > own[:, None, :]).sum(2).clip(0, 3)


def forward(cost: np.ndarray, order: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Vectors at the end of each lane's elements ``start : start + length``, from the state ``entry``."""
    v = np.full((len(start), 4), 4 * FAR, np.int64)
    v[np.arange(len(start)), entry] = 0
    for i, lane in _steps(length):
        at = start[lane] + i
        v[lane] = np.minimum(_advance(v[lane], cost[at], order[at]), 4 * FAR + 3)
    return v


def backward(cost: np.ndarray, end: np.ndarray, length: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Costs from each state to ``last`` over each lane's elements ``end - length : end``."""
    v = np.full((len(end), 4), FAR, np.int64)
    v[np.arange(len(end)), last] = 0
    for i, lane in _steps(length):
        v[lane] = np.minimum((cost[end[lane] - 1 - i] + v[lane][:, None, :]).min(2), FAR)
    return v


def crossings(cost: np.ndarray, order: np.ndarray, start: np.ndarray, stop: np.ndarray, entry: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The state in front of every element on the cheapest, audit-least way of each lane; all lanes are halved at once."""
    out = np.zeros(len(cost), np.int64)
    while len(start):
        one = stop - start == 1
        out[start[one]] = entry[one]
        start, stop, entry, last = (x[~one] for x in (start, stop, entry, last))
        if not len(start):
            break
        mid = (start + stop) // 2
        meet = forward(cost, order, start, mid - start, entry) + 4 * backward(cost, stop, stop - mid, last)
        state = meet.argmin(1)
        start, stop, entry, last = np.concatenate([start, mid]), np.concatenate([mid, stop]), np.concatenate([entry, state]), np.concatenate([state, last])
    return out


def matrices(cost: np.ndarray, order: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each lane as one element: 4 * cost + order, by state in front and state behind."""
    lanes = np.repeat(np.arange(len(start)), 4)
    v = forward(cost, order, start[lanes], length[lanes], np.tile(np.arange(4), len(start)))
    return v.reshape(len(start), 4, 4)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column, and where each list starts and stops."""
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    return column.flatten().to_numpy(zero_copy_only=False), bounds[:-1], bounds[1:]


def _blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrices, start, stop) of a column of lists of packed matrices."""
    blobs, start, stop = _lists(column)
    packed = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 4, 4)
    return packed, start, stop


def _pack(m: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(m)], pa.binary())


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks or parts with a list of classes or matrices: the same columns with one matrix more."""
    for b in batches:
        last = b.column(b.num_columns - 1)
        if pa.types.is_binary(last.type.value_type):
            packed, start, stop = _blobs(last)
            m = matrices(packed >> 2, packed & 3, start, stop - start)
        else:
            kinds, start, stop = _lists(last)
            m = matrices(COST[kinds], PIECE[kinds], start, stop - start)
        yield pa.RecordBatch.from_arrays([*b.columns, _pack(m)], [*b.schema.names, "matrix"])


class Plan(NamedTuple):
    rows: DataFrame  # id, pos, role, text: turns in order
    edits: DataFrame  # id, pos of the first turn of a block, letters of its turns, whether it is the last block
    report: DataFrame  # id, gaps, blank, duplicate, truncated, illegal, cost: conversations with turns


def plan(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> Plan:
    """Faults and cheapest edits of every conversation.

    Turns stand in the order of turn (nulls first), role, the first 32 characters of the text, and its digest. A null role or
    text counts as one space; rows with a null id are one conversation; rows that agree in all columns are turns of their own.
    Roles count by their first character (``s``, ``u``, ``a``). Other columns are not read. An empty table gives empty ones.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"))
    # the last key spreads rows that agree in everything
    order = ["id", "turn", "role", F.substring("text", 1, 32), F.md5("text"), F.col("salt")]
    rows = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    body = F.rtrim("text", F.lit("\t\n\x0b\x0c\r "))
    rows = keep(
        rows.select(
            "id", "turn", F.monotonically_increasing_id().alias("pos"), "role", "text",
            F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))).alias("same"),
            F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", 0, "u", 1, "a", 2)]), F.substring("role", 1, 1)), F.lit(3)).alias("initial"),
            (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"),
        )
    )
    light = rows.select("id", "turn", "pos", "same", "initial", "blank", "cut")
    first = light.groupBy("id", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    kind = F.when(F.col("fault").isin(1, 2), MUST_GO).when(F.col("fault") == 3, 4 + F.col("initial")).otherwise(F.col("initial"))
    known = light.join(first, "pos", "left").withColumn("fault", fault).select("id", "pos", "turn", "initial", "fault", kind.cast("byte").alias("kind"))

    part = F.shiftright("block", PART_BITS - BLOCK_BITS)
    count = lambda n: F.sum((F.col("fault") == n).cast("long"))
    listed = known.groupBy("id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "kind", "initial"))).alias("own"), F.array_sort(F.collect_set("turn")).alias("seen"),
        count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"),
    )
    illegal = F.expr("size(filter(own, (x, i) -> i > 0 and array(own[i - 1].initial, x.initial) not in (array(0, 1), array(1, 2), array(2, 1))))")
    fields = ["first", "last", "low", "high", "distinct", "blank", "duplicate", "truncated", "illegal"]
    listed = listed.select(
        "id", "block", F.element_at("own", 1)["pos"].alias("pos"), F.element_at("own", 1)["initial"].alias("first"), F.element_at("own", -1)["initial"].alias("last"),
        F.try_element_at("seen", F.lit(1)).alias("low"), F.try_element_at("seen", F.lit(-1)).alias("high"), F.size("seen").cast("long").alias("distinct"),
        "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"), F.expr("transform(own, x -> x.kind)").alias("kinds"),
    )
    kinds = {"first": "int", "last": "int"}
    schema = "id long, {}, " + ", ".join(f"{c} {kinds.get(c, 'long')}" for c in fields)
    blocks = keep(listed.mapInArrow(_summed, schema.format("block long, pos long") + ", kinds array<tinyint>, matrix binary"))
    parts = keep(_composed(blocks, ["id", part.alias("part")], "block", fields).mapInArrow(_summed, schema.format("part long, names array<long>") + ", matrices array<binary>, matrix binary"))
    whole = keep(_composed(parts, ["id"], "part", fields).mapInArrow(_solved, schema.format("names array<long>") + ", matrices array<binary>, entries array<tinyint>, exits array<tinyint>, cost long"))

    down = lambda df: df.select("id", F.explode(F.arrays_zip("names", "entries", "exits")).alias("x")).select("id", "x.*")
    of_parts = _matched(parts.select("id", "part", "names", "matrices"), down(whole), "part")
    of_blocks = down(of_parts.mapInArrow(_lowered, "id long, names array<long>, entries array<tinyint>, exits array<tinyint>"))
    edits = _matched(blocks.select("id", "block", "pos", "kinds"), of_blocks, "block").mapInArrow(_lettered, "id long, pos long, letters string")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("distinct")).cast("long")
    return Plan(rows.select("id", "pos", "role", "text"), edits, whole.select("id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost"))


def _composed(df: DataFrame, keys: list, name: str, fields: list[str]) -> DataFrame:
    """Neighbouring stretches as one: at most the blocks of a part, or the parts of a table, are listed together."""
    df = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(name, *fields, "matrix"))).alias("own"))
    total = lambda c: f"aggregate(own, 0L, (a, x) -> a + x.{c})"
    border = "(x, i) -> i > 0 and array(own[i - 1].last, x.first) not in (array(0, 1), array(1, 2), array(2, 1))"
    # turns are in order, nulls first: a stretch starts with the turn that the one before ended with, or with a new one
    shared = "size(filter(own, (x, i) -> i > 0 and x.low = own[i - 1].high))"
    keys = [c if isinstance(c, str) else "part" for c in keys]
    exprs = {
        "first": "own[0].first", "last": "element_at(own, -1).last", "low": "array_min(transform(own, x -> x.low))", "high": "array_max(transform(own, x -> x.high))",
        "distinct": f"{total('distinct')} - {shared}", "illegal": f"{total('illegal')} + size(filter(own, {border}))",
    }
    out = [F.expr(exprs.get(c, total(c))).alias(c) for c in fields]
    return df.select(*keys, F.expr(f"transform(own, x -> x.{name})").alias("names"), *out, F.expr("transform(own, x -> x.matrix)").alias("matrices"))


def _matched(df: DataFrame, states: DataFrame, name: str) -> DataFrame:
    b = states.select(F.col("id").alias("_id"), F.col("names").alias("_name"), "entries", "exits")
    return df.join(b, F.col("id").eqNullSafe(F.col("_id")) & (F.col(name) == F.col("_name"))).drop("_id", "_name")


def _state_lists(states: np.ndarray, last: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[pa.Array]:
    """States in front of and behind the elements of each list."""
    behind = np.append(states[1:], 0)
    behind[stop - 1] = last
    offsets = pa.array(np.append(start, stop[-1] if len(stop) else 0).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int8))) for x in (states, behind)]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest end of each conversation, and the states between its parts."""
    for b in batches:
        packed, start, stop = _blobs(b.column(b.num_columns - 1))
        cost, order = packed >> 2, packed & 3
        entry = np.zeros(len(start), np.int64)
        v = forward(cost, order, start, stop - start, entry) + 4 * TAIL_COST
        last = v.argmin(1)
        states = crossings(cost, order, start, stop, entry, last)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, *_state_lists(states, last, start, stop), pa.array(v.min(1) >> 2)], [*b.schema.names, "entries", "exits", "cost"]
        )


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states between the blocks of each part, whose own ends are known."""
    for b in batches:
        packed, start, stop = _blobs(b.column(b.schema.get_field_index("matrices")))
        entry, last = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("entries", "exits"))
        states = crossings(packed >> 2, packed & 3, start, stop, entry, last)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.schema.get_field_index("names")), *_state_lists(states, last, start, stop)], ["id", "names", "entries", "exits"])


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each block's turns."""
    pieces = np.array(PIECES, object)
    for b in batches:
        kinds, start, stop = _lists(b.column(b.schema.get_field_index("kinds")))
        entry, last = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("entries", "exits"))
        states = crossings(COST[kinds], PIECE[kinds], start, stop, entry, last)
        behind = np.append(states[1:], 0)
        behind[stop - 1] = last
        words = pieces[PIECE[kinds, states, behind]]
        letters = ["".join(words[a:z]) for a, z in zip(start, stop)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.schema.get_field_index("pos")), pa.array(letters, pa.string())], ["id", "pos", "letters"])


def _merged(p: Plan) -> DataFrame:
    """Letters of a block, then its turns, in order, conversation by conversation."""
    none = F.lit(None).cast("string")
    letters = p.edits.select("id", "pos", F.lit(0).alias("is_turn"), "letters", none.alias("role"), none.alias("text"))
    turns = p.rows.select("id", "pos", F.lit(1).alias("is_turn"), none.alias("letters"), "role", "text")
    return letters.unionByName(turns).repartition("id").sortWithinPartitions("id", "pos", "is_turn")


NEXT = {("s", START): SYSTEM, **{("u", s): USER for s in (START, SYSTEM, ASSISTANT)}, ("a", USER): ASSISTANT}


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, edit, role, text) of every edit in order; an id's turns follow each other. Nothing of a conversation is held but its place."""

    def due(state: int) -> tuple[str, int]:
        return ("assistant", ASSISTANT) if state == USER else ("user", USER)

    at, state, left = None, START, iter(())
    for b in batches:
        for i, is_turn, letters, role, text in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4, 5))):
            if at is None or at[0] != i:
                if at is not None:
                    for x in TAIL[state]:
                        role_, state = due(state)
                        yield at[0], x, role_, ""
                at, state, left = (i,), START, iter(())
            if not is_turn:
                left = iter(letters)
                continue
            edit = next(left)
            if edit == "I":
                new, state = due(state)
                yield i, "I", new, ""
                edit = next(left)
            if edit == "R":
                role, state = due(state)
            elif edit == "K":
                state = NEXT[role[:1], state]
            yield i, edit, role, text
    if at is not None:
        for x in TAIL[state]:
            role_, state = due(state)
            yield at[0], x, role_, ""


def repaired(p: Plan) -> DataFrame:
    """(id, place, edit, role, text): every edit of a conversation in order, deleted turns with edit D and their old role."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place, out, size = None, 0, [], 0
        for i, edit, role, text in _applied(batches):
            place = place + 1 if at == (i,) else 0
            at = (i,)
            out.append((i, place, edit, role, text))
            size += len(text)
            if len(out) >= 10_000 or size > 1 << 22:
                yield pa.RecordBatch.from_pylist([dict(zip(("id", "place", "edit", "role", "text"), x)) for x in out], schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "place", "edit", "role", "text"), x)) for x in out], schema)

    schema = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _merged(p).mapInArrow(rows, "id long, place long, edit string, role string, text string")


def digests(p: Plan) -> DataFrame:
    """(id, audit, repaired_sha256) per conversation with turns: its edits' letters, and the digest of ``role:text`` of what stays.

    A digest is sequential by definition: one conversation streams through one task, and only its audit is held.
    """
    schema = pa.schema([("id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, audit, digest, empty, out = None, [], None, True, []

        def close():
            out.append({"id": at[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})

        for i, edit, role, text in _applied(batches):
            if at != (i,):
                if at is not None:
                    close()
                at, audit, digest, empty = (i,), [], hashlib.sha256(), True
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            audit.append(edit)
            if edit != "D":
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        if at is not None:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _merged(p).mapInArrow(rows, "id long, audit string, repaired_sha256 string")
