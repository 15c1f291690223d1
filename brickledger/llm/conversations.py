"""Repair of the role structure of conversations at least cost, by Four-Russians block tables.

A repaired conversation has the role initials ``(s?(ua)+)?``.  The cost to go
from a row on, for each state of that pattern, is a vector of four numbers.
Less its minimum it takes few values, so all transitions of such vectors over
every block of ``BLOCK`` rows are computed once and looked up from then on.
Vectors run backward over the rows; a block is expanded row by row, again by
lookup, only where the edits are traced forward.

Transitions are functions on a small set and compose.  A conversation of any
length is therefore cut into segments, whose functions are composed in a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..operators.storage import stored
from .common import whole_texts

RETYPE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3  # costs; keeping costs nothing, a truncated row that stays CUT_OFF more
BLOCK = 4  # rows of a table entry
SEGMENT = 4_096  # rows of a conversation that one task looks up at a time
FAN = 1_024  # segments composed by one task; beyond, a level more
SPACE = " \t\n\v\f\r"

# Symbols of rows: a role class, +1 if truncated; rows that must go; nothing, to fill a block.
ROLES = "suao"
GONE, NOTHING, SYMBOLS = 8, 9, 10
# States of the pattern: before the first row, after s, after u, after a.
STATES, ACCEPTING = 4, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FAR = 1 << 20


# ---------------------------------------------------------------- block tables

@dataclass
class Tables:
    """Everything that is looked up; a vector is known by its number."""

    vectors: np.ndarray  # (vector, state): cost to go, least 0
    end: int  # number of the vector behind the last row
    end_cost: int
    row_next: np.ndarray  # (vector behind, symbol): vector before
    row_cost: np.ndarray  # what its costs lie above
    row_edits: np.ndarray  # (vector behind, symbol, state): code of the edits
    row_state: np.ndarray  # state behind the row
    block_next: np.ndarray  # as above, for the code of a block
    block_cost: np.ndarray
    block_state: np.ndarray
    edits: list[str]  # by code: inserted roles, then K, D, or the new role as U or A
    last_edits: list[str]  # by state: what is inserted behind the last row


def wanted(state: int) -> str:
    """The role that may be inserted or given in a state."""
    return "a" if state == 2 else "u"


def with_inserts(costs: tuple[int, ...]) -> tuple[int, ...]:
    best = list(costs)
    for _ in range(STATES):
        best = [min(best[s], INSERT + best[NEXT[s, wanted(s)]]) for s in range(STATES)]
    return tuple(best)


def options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """``(edit, cost, state behind)`` of one row, in the order of the edits' initials D, K, R."""
    if symbol == NOTHING:
        return [("", 0, state)]
    made = [("D", DELETE, state)]
    if symbol != GONE:
        role, more = ROLES[symbol // 2], CUT_OFF * (symbol % 2)
        if (state, role) in NEXT:
            made.append(("K", more, NEXT[state, role]))
        made.append((wanted(state).upper(), RETYPE + more, NEXT[state, wanted(state)]))
    return made


def before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Cost to go before a row from those behind it."""
    if symbol == NOTHING:
        return costs
    return with_inserts(tuple(min(cost + costs[to] for _, cost, to in options(symbol, s)) for s in range(STATES)))


def row_trace(costs: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """The cheapest edits up to and with a row; of equal ones those whose initials come first: D, I, K, R."""
    if symbol == NOTHING:
        return "", state
    best, made = before(costs, symbol), ""
    while True:
        found = {edit: to for edit, cost, to in options(symbol, state) if cost + costs[to] == best[state]}
        if "D" in found:
            return made + "D", found["D"]
        after = NEXT[state, wanted(state)]
        if INSERT + best[after] == best[state]:
            made += wanted(state)
            state = after
            continue
        edit = "K" if "K" in found else next(iter(found))
        return made + edit, found[edit]


@lru_cache(maxsize=1)
def tables(block: int = BLOCK) -> Tables:
    """All vectors that occur, all rows and all blocks over them."""
    last = with_inserts(tuple(0 if s in ACCEPTING else FAR for s in range(STATES)))
    end_cost = min(last)
    numbers = {tuple(c - end_cost for c in last): 0}
    queue = list(numbers)
    row = {}
    for vector in queue:  # grows until no new vector is met
        for symbol in range(SYMBOLS):
            made = before(vector, symbol)
            shape = tuple(c - min(made) for c in made)
            if shape not in numbers:
                numbers[shape] = len(numbers)
                queue.append(shape)
            row[numbers[vector], symbol] = numbers[shape], min(made)
    n = len(queue)
    row_next, row_cost = (np.array([[row[v, s][i] for s in range(SYMBOLS)] for v in range(n)], np.int64) for i in (0, 1))
    codes: dict[str, int] = {}
    traced = [[[row_trace(queue[v], s, q) for q in range(STATES)] for s in range(SYMBOLS)] for v in range(n)]
    row_edits = np.array([[[codes.setdefault(e, len(codes)) for e, _ in x] for x in y] for y in traced], np.int64)
    row_state = np.array([[[to for _, to in x] for x in y] for y in traced], np.int64)
    # a block is its last row, then the rows before it: codes have the first row as their highest digit
    block_next, block_cost = np.arange(n)[:, None], np.zeros((n, 1), np.int64)
    block_state = np.broadcast_to(np.arange(STATES), (n, 1, STATES))
    for _ in range(block):
        cost = block_cost[:, None, :] + row_cost[block_next].transpose(0, 2, 1)
        state = np.take_along_axis(  # the row in front first, then the rows behind it
            np.broadcast_to(block_state[:, None], (n, SYMBOLS, *block_state.shape[1:])),
            row_state[block_next].transpose(0, 2, 1, 3), axis=3)
        block_next = row_next[block_next].transpose(0, 2, 1).reshape(n, -1)
        block_cost, block_state = cost.reshape(n, -1), state.reshape(n, -1, STATES)
    ends = []
    for s in range(STATES):
        made = ""
        while s not in ACCEPTING:
            made, s = made + wanted(s), NEXT[s, wanted(s)]
        ends.append(made)
    return Tables(np.array(queue), 0, end_cost, row_next, row_cost, row_edits, row_state, block_next, block_cost, block_state, list(codes), ends)


def blocks(symbols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows as digits, filled in front to whole blocks, and the codes of the blocks."""
    width = -(-max(map(len, symbols), default=0) // BLOCK) * BLOCK
    raw = np.frombuffer("".join(s.rjust(width, str(NOTHING)) for s in symbols).encode(), np.uint8)
    digits = (raw - ord("0")).astype(np.int64).reshape(len(symbols), width)
    codes = digits.reshape(len(symbols), -1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    return digits, codes


def backward(codes: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors behind each block and before the first, and the cost they gained."""
    t, at = tables(), [behind]
    cost = np.zeros(len(codes), np.int64)
    for j in range(codes.shape[1] - 1, -1, -1):
        cost += t.block_cost[at[-1], codes[:, j]]
        at.append(t.block_next[at[-1], codes[:, j]])
    return np.stack(at[::-1], axis=1), cost


def trace(symbols: list[str], behind: np.ndarray, state: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """Edits of every row of each segment, and the state behind it."""
    t = tables()
    digits, codes = blocks(symbols)
    at, _ = backward(codes, behind)
    edits = np.zeros(digits.shape, np.int64)
    for j in range(codes.shape[1]):
        vector = [at[:, j + 1]]  # expanded backward, only for the rows of this block
        for i in range(BLOCK - 1, 0, -1):
            vector.append(t.row_next[vector[-1], digits[:, j * BLOCK + i]])
        for i in range(BLOCK):
            here = vector[BLOCK - 1 - i], digits[:, j * BLOCK + i], state
            edits[:, j * BLOCK + i], state = t.row_edits[here], t.row_state[here]
    names = t.edits
    return [[names[c] for c in row[len(row) - len(s):]] for row, s in zip(edits.tolist(), symbols)], state


# -------------------------------------------------------------- rows and faults

def bare(text: str) -> Column:
    """The text without space at its end."""
    return F.rtrim(F.col(text), F.lit(SPACE))


def ordered(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, pos)``: rows of each conversation numbered from 1 by turn, null turns first.

    Rows of one turn go by role, then by the text's first characters and its digest.
    """
    keyed = rows.withColumns({"_head": F.substring("text", 1, 64), "_digest": F.sha2("text", 256)})
    return numbered(keyed, ["conv"], [F.col("turn").asc_nulls_first(), "role", "_head", "_digest"], "pos").drop("_head")


def with_faults(placed: DataFrame) -> DataFrame:
    """Add ``fault`` (blank, duplicate, truncated or null), ``initial`` and ``symbol``.

    The first row of equal ones comes from an aggregate and is joined back on
    its place, which is unique, so rows that are very often the same stay spread.
    """
    first = placed.groupBy("conv", "role", "_digest").agg(F.min("pos").alias("pos")).select(
        F.col("conv").alias("_conv"), F.col("pos").alias("_pos"), F.lit(True).alias("_first"))
    there = placed.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")), "left")
    end = bare("text")
    fault = F.when(end == "", "blank").when(F.col("_first").isNull(), "duplicate").when(
        ~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 2).when(initial == "a", 4).otherwise(6)
    made = there.withColumns({"fault": fault, "initial": initial})
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    cut = F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int")
    return made.withColumn("symbol", F.when(gone, F.lit(GONE)).otherwise(role + cut)).select(
        "conv", "pos", "turn", "role", "text", "fault", "initial", "symbol")


# --------------------------------------------------------- segments and the tree

def scan(maps: DataFrame, start: int, forward: bool) -> DataFrame:
    """``(conv, seg, at)``: what comes into each segment when ``start`` goes through the functions of those before it.

    ``maps`` has ``(conv, seg, map)``, segments from 0 without gaps.  With
    ``forward`` false, segments behind count as before.  A task composes
    ``FAN`` functions at most; more segments are composed level by level.
    """
    def step(at: Column, x: Column) -> Column:
        return F.element_at(x["map"], at + 1)

    maps = stored(maps, "maps")
    top = maps.agg(F.max("seg")).first()[0]
    part = maps.withColumn("seg_of", F.floor(F.col("seg") / FAN))
    lists = part.groupBy("conv", "seg_of").agg(F.sort_array(F.collect_list(F.struct("seg", "map")), forward).alias("each"))
    if top is None or top < FAN:
        coming = F.lit(start)
    else:
        size = F.size(F.element_at("each", 1)["map"])
        through = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.aggregate("each", k, step))
        upper = scan(lists.select("conv", F.col("seg_of").alias("seg"), through.alias("map")), start, forward)
        upper = upper.select(F.col("conv").alias("_conv"), F.col("seg").alias("_seg"), F.col("at").alias("_in"))
        lists = lists.join(upper, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("seg_of") == F.col("_seg")))
        coming = F.col("_in")
    begin = F.struct(coming.cast("int").alias("at"), F.array().cast("array<int>").alias("made"))
    met = F.aggregate("each", begin, lambda a, x: F.struct(
        step(a["at"], x).cast("int").alias("at"), F.concat(a["made"], F.array(a["at"])).alias("made")))["made"]
    rows = lists.withColumn("_met", met).select("conv", F.inline(F.arrays_zip(F.col("each.seg").alias("seg"), F.col("_met").alias("at"))))
    return rows.toDF("conv", "seg", "at")


def same_segment(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"conv": "_conv", "seg": "_seg"})
    return left.join(right, left.conv.eqNullSafe(F.col("_conv")) & (left.seg == F.col("_seg"))).drop("_conv", "_seg")


def looked_up(df: DataFrame, function, schema: str) -> DataFrame:
    """``df`` with what ``function`` makes of its symbols and further columns, in batches of bounded size."""
    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                made = function(batch.column("symbols").to_pylist(), batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(task, f"{names}, {schema}")


def vector_maps(symbols: list[str], batch: pa.RecordBatch) -> dict:
    """For every vector behind a segment the one before it."""
    _, codes = blocks(symbols)
    n = len(tables().vectors)
    at = np.tile(np.arange(n), (len(symbols), 1))
    for j in range(codes.shape[1] - 1, -1, -1):
        at = tables().block_next[at, codes[:, [j]]]
    return {"map": pa.array(at.tolist(), pa.list_(pa.int32()))}


def state_maps(symbols: list[str], batch: pa.RecordBatch) -> dict:
    """For every state before a segment the one behind it; the cost its vectors gain, and what they leave from the first state on."""
    _, codes = blocks(symbols)
    behind, gained = backward(codes, batch.column("behind").to_numpy().astype(np.int64))
    at = np.tile(np.arange(STATES), (len(symbols), 1))
    for j in range(codes.shape[1]):
        at = tables().block_state[behind[:, [j + 1]], codes[:, [j]], at]
    return {"map": pa.array(at.tolist(), pa.list_(pa.int32())), "gained": pa.array(gained), "to_go": pa.array(tables().vectors[behind[:, 0], 0])}


def edit_lists(symbols: list[str], batch: pa.RecordBatch) -> dict:
    edits, state = trace(symbols, batch.column("behind").to_numpy().astype(np.int64), batch.column("state").to_numpy().astype(np.int64))
    last = batch.column("is_last").to_pylist()
    ends = [tables().last_edits[s] if x else "" for s, x in zip(state.tolist(), last)]
    return {"edits": pa.array([[*e[:-1], e[-1] + "|" + end] for e, end in zip(edits, ends)], pa.list_(pa.string()))}


@dataclass
class Repair:
    """What ``repair`` gives: the rows with their faults, their edits, and a line for each conversation."""

    rows: DataFrame  # (conv, pos, turn, role, text, fault, edits)
    summary: DataFrame  # (conv, n_rows, gaps, blank, duplicate, truncated, illegal, cost)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Faults of every row, and the cheapest edits that give the role initials ``(s?(ua)+)?``.

    ``edits`` of a row has a letter for each edit: ``u`` or ``a`` for a row
    inserted before it, then K (kept), D (deleted), U or A (given that role);
    on the last row ``|`` and what is inserted behind it.  Of equally cheap
    repairs the one whose initials (D, I, K, R) come first is taken.

    A null role or text counts as one space, null turns come first, a null
    conversation is one of its own.  Rows of one turn go by role, then text;
    equal rows are duplicates of the first of them.  Texts and conversations
    may have any length: a conversation is cut into segments of 4,096 rows,
    and no more than those, without their texts, are ever gathered.  An empty
    table gives none.  Other columns are not looked at.
    """
    named = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    placed = stored(with_faults(ordered(named)), "placed")
    seg = F.floor((F.col("pos") - 1) / SEGMENT)
    cells = F.struct("pos", "symbol", F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o").alias("initial"))
    segments = placed.withColumn("seg", seg).groupBy("conv", "seg").agg(F.sort_array(F.collect_list(cells)).alias("each")).select(
        "conv", "seg", F.concat_ws("", F.transform("each", lambda c: c["symbol"].cast("string"))).alias("symbols"),
        F.concat_ws("", F.transform("each", lambda c: c["initial"])).alias("initials"))
    segments = stored(segments, "segments")
    maps = looked_up(segments.select("conv", "seg", "symbols"), vector_maps, "map array<int>").drop("symbols")
    behind = scan(maps, tables().end, forward=False).withColumnRenamed("at", "behind")
    passed = stored(looked_up(same_segment(segments, behind), state_maps, "map array<int>, gained long, to_go long"), "passed")
    state = scan(passed.select("conv", "seg", "map"), 0, forward=True).withColumnRenamed("at", "state")
    by_conv = Window.partitionBy("conv").orderBy("seg")  # a row per 4,096 rows of a conversation
    known = same_segment(passed.drop("map"), state).withColumns({
        "is_last": F.lead("seg").over(by_conv).isNull(), "initial_before": F.lag(F.right("initials", F.lit(1))).over(by_conv)})
    traced = stored(looked_up(known, edit_lists, "edits array<string>"), "traced")
    each = traced.select(F.col("conv").alias("_conv"), "seg", F.posexplode("edits").alias("_place", "edits")).select(
        "_conv", (F.col("seg") * SEGMENT + F.col("_place") + 1).alias("_pos"), "edits")
    edited = placed.join(each, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos"))).select(
        "conv", "pos", "turn", "role", "text", "fault", F.regexp_replace("edits", r"\|$", "").alias("edits"))

    pair = F.concat(F.coalesce("initial_before", F.lit("")), "initials")
    legal = F.regexp_count(pair, F.lit("s(?=u)")) + F.regexp_count(pair, F.lit("u(?=a)")) + F.regexp_count(pair, F.lit("a(?=u)"))
    roles = traced.groupBy("conv").agg(
        F.sum(F.length(pair) - 1 - legal).alias("illegal"),
        (F.sum("gained") + F.max(F.when(F.col("seg") == 0, F.col("to_go"))) + tables().end_cost).alias("cost"))

    def of(fault: str) -> Column:
        return F.count(F.when(F.col("fault") == fault, 1)).alias(fault)

    turns = placed.groupBy("conv").agg(
        F.count("*").alias("n_rows"), F.max("turn").alias("_high"), F.min("turn").alias("_low"), F.count_distinct("turn").alias("_turns"),
        of("blank"), of("duplicate"), of("truncated"))
    gaps = F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_turns"), F.lit(0))
    summary = turns.join(roles.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).select(
        "conv", "n_rows", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost")
    return Repair(edited, summary)


# ---------------------------------------------------------------- repaired rows

INSERTED = {"u": "user", "a": "assistant"}


INITIALS = str.maketrans("uaUA", "IIRR", "|")  # of the edits: K, R, D, I


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``(conv, pos, nth, role, text)`` of the repaired conversations, in the order of ``pos`` and ``nth``."""
    letters = F.filter(F.split("edits", ""), lambda e: ~e.isin("", "|", "D"))
    new_role = F.when(F.lower("_edit") == "u", INSERTED["u"]).when(F.lower("_edit") == "a", INSERTED["a"]).otherwise(F.col("role"))
    text = F.when(F.col("_edit").isin("u", "a"), "").otherwise(F.col("text"))
    return rows.select("*", F.posexplode(letters).alias("nth", "_edit")).select("conv", "pos", "nth", new_role.alias("role"), text.alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """``(conv, audit, repaired_sha256)``: all initials, and the SHA-256 of the repaired ``role:text`` lines.

    A digest takes its lines in order, so the rows of a conversation, sorted by
    Spark, stream through one task, which holds a batch of them at a time.
    """
    lines = F.when(F.col("edits").contains("D"), "").otherwise(F.concat_ws(
        ":", F.when(F.col("edits").contains("U"), "user").when(F.col("edits").contains("A"), "assistant").otherwise(F.col("role")), "text"))
    sent = rows.select("conv", "pos", "edits", lines.cast("binary").alias("line"))
    sent = whole_texts(sent.repartition("conv").sortWithinPartitions("conv", "pos"))

    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, letters, begun = None, None, [], False
        done: list[tuple] = []

        def line(content: bytes) -> None:
            nonlocal begun
            if begun:
                sha.update(b"\n")
            sha.update(content)
            begun = True

        def made() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done)] or [[], [], []]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], conv_type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                                              ["conv", "audit", "repaired_sha256"])
        conv_type = None
        for batch in source:
            conv_type = batch.schema.field("conv").type
            for conv, edits, content in zip(batch.column("conv").to_pylist(), batch.column("edits").to_pylist(), batch.column("line").to_pylist()):
                if sha is None or conv != now:
                    if sha is not None:
                        done.append((now, "".join(letters), sha.hexdigest()))
                    now, sha, letters, begun = conv, hashlib.sha256(), [], False
                for e in edits:
                    if e in INSERTED:
                        line(f"{INSERTED[e]}:".encode())
                    elif e in "KUA":
                        line(content)
                letters.append(edits.translate(INITIALS))
            yield made()
        if sha is not None:
            done.append((now, "".join(letters), sha.hexdigest()))
            yield made()

    return sent.mapInArrow(task, f"conv {rows.schema['conv'].dataType.simpleString()}, audit string, repaired_sha256 string")


# ---------------------------------------------------------------------- damage

def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by ``crc32(conv:turn) % 20``; nulls are written as one space.

    0 drops the row, 1 empties its text, 2 takes its full stops and the like,
    3 repeats it, 4 makes its role user; the others stay as they are.
    """
    def filled(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", filled(conv_col), filled(turn_col)).cast("binary")) % 20
    known = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"),
                        kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return known.filter("kind <> 0").select(
        F.col("conv").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")
