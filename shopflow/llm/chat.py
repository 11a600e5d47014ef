"""Chat formatting with a minimum-cost repair of roles.

A legal conversation may open with the system, then the user, and user and assistant take
turns. Turns that break this are merged with the one before, given another role, or preceded by
an empty turn. Dynamic programming over the states of this automaton finds the cheapest repair.

A conversation may be of any length. Its turns, in order, are dealt in runs to tasks and cut
into blocks. A block is a matrix of costs from each state to each; matrices combine like
products (sums for products, minima for sums), so blocks are folded in groups, level by level,
until a conversation is one matrix. The way back gives each group, and at last each block, the
states in which the cheapest repair enters and leaves it, and each block is repaired alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from shopflow.llm.common import map_groups
from shopflow.sources.scratch import stored

ROLES = ("system", "user", "assistant")
STATES = 4  # 0: nothing yet; 1, 2, 3: the last turn is of role 0, 1, 2
FREE = 1 << 40  # more than any repair costs
MERGE, RELABEL, SYSTEM_RELABEL, UNKNOWN, INSERT = 2, 3, 5, 1, 4
BLOCK_TURNS, BLOCK_CHARS, FAN = 256, 1 << 20, 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def relabel_cost(role: str | None, new: int) -> int:
    """Cost of reading ``role`` as ROLES[new]; roles that aren't known may become any."""
    if role not in ROLES:
        return UNKNOWN + (new == 0)
    if role == ROLES[new]:
        return 0
    return SYSTEM_RELABEL if "system" in (role, ROLES[new]) else RELABEL


#: (state, new role) -> (cost, roles of the empty turns inserted, merged), where legal.
MOVES: dict[tuple[int, int], tuple[int, tuple[int, ...], bool]] = {
    (0, 0): (0, (), False),
    (0, 1): (0, (), False),
    (0, 2): (INSERT, (1,), False),
    (1, 0): (MERGE, (), True),
    (1, 1): (0, (), False),
    (1, 2): (INSERT, (1,), False),
    (2, 1): (MERGE, (), True),
    (2, 2): (0, (), False),
    (3, 1): (0, (), False),
    (3, 2): (MERGE, (), True),
}


def step(role: str | None) -> np.ndarray:
    """Costs from each state to each over one turn."""
    costs = np.full((STATES, STATES), FREE, np.int64)
    for (state, new), (cost, _, _) in MOVES.items():
        costs[state, new + 1] = cost + relabel_cost(role, new)
    return costs


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FREE)


def identity() -> np.ndarray:
    return np.where(np.eye(STATES, dtype=bool), 0, FREE).astype(np.int64)


def path(steps: list[np.ndarray], entry: int, exit: int | None) -> list[int]:
    """The cheapest states before each step and after the last; ties go to smaller states."""
    costs = [np.where(np.arange(STATES) == entry, 0, FREE)]
    for s in steps:
        costs.append(np.minimum((costs[-1][:, None] + s).min(axis=0), FREE))
    at = int(costs[-1].argmin()) if exit is None else exit
    states = [at]
    for cost, s in zip(reversed(costs[:-1]), reversed(steps), strict=True):
        at = int((cost + s[:, at]).argmin())
        states.append(at)
    return states[::-1]


def to_list(m: np.ndarray) -> list[int]:
    return m.ravel().tolist()


def from_list(m: list[int]) -> np.ndarray:
    return np.array(m, np.int64).reshape(STATES, STATES)


def blocks_of(turns: DataFrame) -> DataFrame:
    """Runs of turns in order: conv_id, part, seq (among the part's blocks of the conversation),
    matrix, and turns, roles and texts of the block.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["turn", "role", "text"]
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))  # spreads equal rows
    rows = turns.select("conv_id", *names).withColumn("salt", salt)
    order = [F.asc_nulls_first(c) for c in ("conv_id", *names, "salt")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = {k: rows.schema[k].dataType for k in ("conv_id", *names)}
    schema = StructType.fromDDL(
        f"conv_id {kinds['conv_id'].simpleString()}, part int, seq int, matrix array<bigint>,"
        f" turns array<{kinds['turn'].simpleString()}>, roles array<string>, texts array<string>"
    )

    def run(batches):
        part = TaskContext.get().partitionId()
        key, seq, held, size, started = None, 0, [], 0, False
        out: list[tuple] = []

        def close():
            nonlocal held, size, seq
            if held:
                m = identity()
                for _, role, _ in held:
                    m = product(m, step(role))
                out.append((key, part, seq, to_list(m), *map(list, zip(*held, strict=True))))
                seq += 1
                held, size = [], 0

        for batch in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if not started or conv != key:
                    close()
                    key, seq, started = conv, 0, True
                elif len(held) >= BLOCK_TURNS or size >= BLOCK_CHARS:
                    close()
                held.append((turn, role, text or ""))
                size += len(text or "")
            if out:
                yield frame(out, batch)
                out.clear()
        close()
        if out:
            yield frame(out, batch)

    def frame(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        kind = [like.schema.field(0).type, pa.int32(), pa.int32(), pa.list_(pa.int64())]
        kind += [pa.list_(like.schema.field(1).type), pa.list_(pa.string()), pa.list_(pa.string())]
        arrays = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kind, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema.names)

    return stored(rows.mapInArrow(run, schema), "blocks")


def folded(level: DataFrame) -> DataFrame:
    """Matrices of groups of FAN neighbours: conv (a key that is never null), place, matrix."""

    def fold(key: tuple, members: list[tuple]) -> list[tuple]:
        m = identity()
        for _, matrix in members:
            m = product(m, from_list(matrix))
        return [(*key, to_list(m))]

    grouped = level.withColumn("group", F.floor(F.col("place") / FAN))
    made = {"conv": "string", "place": "long", "matrix": "array<long>"}
    return stored(map_groups(grouped, ["conv", "group"], ["place", "matrix"], made, fold), "level")


def routed(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """Entry and exit state of each member of a level, from those of the groups above it.

    Without ``above`` each conversation is one group, entered in state 0 and left in the
    cheapest state.
    """
    grouped = level.withColumn("group", F.floor(F.col("place") / FAN))
    if above is None:
        grouped = grouped.withColumn("entry", F.lit(0)).withColumn("exit", F.lit(-1))
    else:
        grouped = grouped.join(above.withColumnRenamed("place", "group"), ["conv", "group"])

    def route(key: tuple, members: list[tuple]) -> list[tuple]:
        entry, exit = members[0][2], members[0][3]
        states = path([from_list(m[1]) for m in members], entry, None if exit < 0 else exit)
        return [(key[0], m[0], states[k], states[k + 1]) for k, m in enumerate(members)]

    made = {"conv": "string", "place": "long", "entry": "int", "exit": "int"}
    values = ["place", "matrix", "entry", "exit"]
    return stored(map_groups(grouped, ["conv", "group"], values, made, route), "routes")


def repaired(turns: DataFrame) -> DataFrame:
    """The cheapest legal conversation of each conv_id, a row for each turn, in their order.

    ``turns``: conv_id, turn, role and text. The order is that of (turn, role, text), nulls
    first; repeated rows are turns. Returns conv_id, place (from 0), turn, role, new_role,
    inserted (roles of the empty turns before it, joined by commas), merged (with the turn
    before), cost and rendered: rendered pieces in order of place are the formatted
    conversation. A null text is empty, a null or unknown role may become any role, and null
    conv_ids are one conversation.
    """
    blocks = blocks_of(turns)
    # Places of blocks: those of earlier tasks first. Few rows of each conversation: one a task.
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    blocks = blocks.withColumn("conv", key)
    sizes = blocks.groupBy("conv", "part").agg(
        F.count("*").alias("blocks"), F.sum(F.size("turns")).alias("rows")
    )
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    starts = sizes.select(
        "conv",
        "part",
        F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("start"),
        F.sum("blocks").over(whole).alias("total"),
    )
    placed = blocks.join(starts, ["conv", "part"]).withColumn("place", F.col("start") + F.col("seq"))
    placed = stored(placed, "placed")
    levels = [placed.select("conv", "place", "matrix")]
    longest = placed.agg(F.max("total")).first()[0] or 0
    while longest > FAN:
        levels.append(folded(levels[-1]))
        longest = -(-longest // FAN)
    routes = None
    for level in reversed(levels):
        routes = routed(level, routes)
    # Places of turns inside the conversation: rows of earlier blocks.
    lengths = placed.select("conv", "part", "place", F.size("turns").alias("n"))
    in_part = Window.partitionBy("conv", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    part_starts = sizes.select(
        "conv", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")
    )
    firsts = lengths.withColumn("inside", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(
        part_starts, ["conv", "part"]
    )
    firsts = firsts.select("conv", "place", (F.col("inside") + F.col("rows_before")).alias("first"))
    ready = placed.join(routes, ["conv", "place"]).join(firsts, ["conv", "place"])
    ready = ready.select(
        "conv_id", "turns", "roles", "texts", "entry", "exit", "first",
        (F.col("place") == F.col("total") - 1).alias("last"),
    )
    kind, turn = blocks.schema["conv_id"].dataType, blocks.schema["turns"].dataType.elementType
    schema = StructType(
        [
            StructField("conv_id", kind),
            StructField("place", LongType()),
            StructField("turn", turn),
            *(StructField(c, StringType()) for c in ("role", "new_role", "inserted")),
            *(StructField(c, IntegerType()) for c in ("merged", "cost")),
            StructField("rendered", StringType()),
        ]
    )

    def run(batches):
        for batch in batches:
            at, out = [], []
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            for k, (roles, texts, entry, exit, first, last) in enumerate(rows):
                made = block(roles, texts, entry, exit, first, last)
                at += [k] * len(made)
                out += made
            index = pa.array(at, pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), *[pa.string()] * 3, *[pa.int32()] * 2, pa.string()]
            new = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
            turn_column = batch.column(1).flatten()
            arrays = [batch.column(0).take(index), new[0], turn_column, *new[1:]]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return ready.mapInArrow(run, schema).withColumn("merged", F.col("merged") == 1)


def block(
    roles: list, texts: list[str], entry: int, exit: int, first: int, last: bool
) -> list[tuple]:
    """(place, role, new role, inserted, merged, cost, rendered) of the turns of a block."""
    states = path([step(r) for r in roles], entry, exit)
    out = []
    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        state, new = states[k], states[k + 1] - 1
        cost, inserted, merged = MOVES[state, new]
        pieces = []
        if merged:
            pieces.append("\n")
        else:
            pieces.append(CLOSE if state else "")
            pieces += [f"{OPEN}{ROLES[r]}\n{CLOSE}" for r in inserted]
            pieces.append(f"{OPEN}{ROLES[new]}\n")
        pieces.append(text)
        if last and k == len(roles) - 1:
            pieces.append(CLOSE)
        names = ",".join(ROLES[r] for r in inserted)
        total = cost + relabel_cost(role, new)
        out.append((first + k, role, ROLES[new], names, int(merged), total, "".join(pieces)))
    return out
