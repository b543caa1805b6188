"""Transcript parsing: roles of a transcript's lines by Viterbi, then canonical turns.

A hidden Markov model has a state for each role and for whether a line begins a turn
or goes on with one.  A line is observed through its speaker marker ("User:",
"### Assistant", "Q:", none, ...), its length, whether it ends as a question, and
whether the line before it is blank.  Probabilities are smoothed counts of lines
whose roles are known, summed by Spark; only those tables (states by observations)
reach the driver.

Rows are put in one order by range, and cut into blocks of at most ``block`` lines
that never hold two conversations.  So a conversation, a turn number or a single text
of any length is spread over blocks, which tasks decode side by side.  Exactly: a block
is summed up as the best score from each first to each last state; these tables are
combined up a tree with ``fan`` children a node, the best states at every border are
fixed on the way down, and blocks are decoded between them.  A turn that crosses
borders is put together before it is rendered, so results do not show the blocks.

Null and empty texts are one blank line.  Rows of a null conversation are one
conversation, and a null turn number comes first.  Rows of one turn number follow
each other by the hash of their text; equal rows stay as many as they are.  With no row
of known role every line takes the first role.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import in_batches, partitions, stored, values

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role r begins: 2 r, goes on: 2 r + 1
NAMES = {
    "system": "system", "instruction": "system", "instructions": "system", "prompt": "system",
    "user": "user", "human": "user", "question": "user", "q": "user", "customer": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant", "model": "assistant",
}
_MARKER = re.compile(r"^\s*(?:(?:#{1,6}|\*\*|>|[-*]|\[|\(|<\|?|<)\s*)?([A-Za-z]{1,12})\s*(?:(?:\*\*|\]|\)|\|?>)\s*:?|:(?:\*\*)?|$)\s*")
LENGTHS = (1, 40, 120, 240, 480, 960)
SYMBOLS = (len(ROLES) + 2) * (len(LENGTHS) + 1) * 2 * 2


def marker(line: str) -> tuple[int, str]:
    """(0 for none, 1 for an unknown name, or 2 + role), and the line without it."""
    m = _MARKER.match(line)
    if not m or (m.end() == len(line) and not re.match(r"\s*[#*\[(<]", line) and ":" not in m[0]):
        return 0, line
    role = NAMES.get(m[1].lower())
    return (2 + ROLES.index(role), line[m.end() :]) if role else (1, line)


def symbol(line: str, after_blank: bool) -> int:
    kind, rest = marker(line)
    size = sum(len(rest) >= n for n in LENGTHS)
    return ((kind * (len(LENGTHS) + 1) + size) * 2 + rest.rstrip().endswith("?")) * 2 + after_blank


LINE = ("conv", "part", "block", "at", "turn", "row", "line", "text", "symbol", "role")


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def lines(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str | None = None, block: int = 256) -> DataFrame:
    """``conv, block, at, turn, row, line, text, symbol`` (and ``role``) for each line of ``conv, turn, text`` rows, as a stored table.

    ``row`` numbers the rows and ``block`` the blocks in order; ``at`` is a line's place in its block.
    """
    n = partitions(turns.sparkSession)
    role_column = F.col(role) if role else F.lit(None).cast("string")
    given = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(text, F.lit("")).alias("text"), role_column.alias("role"))
    order = ["conv", "turn", "tie", "role"]
    ordered = given.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def make():
        rows = blocks = at = 0
        last: tuple | None = None

        def each(batch):
            nonlocal rows, blocks, at, last
            out = []
            for c, n, t, r, part in zip(*(values(batch, x) for x in ("conv", "turn", "text", "role", "part"))):
                blank = True
                if last is not None and last != (c,):
                    blocks, at = blocks + 1, 0
                last = (c,)
                for k, one in enumerate(t.split("\n")):
                    if at == block:
                        blocks, at = blocks + 1, 0
                    out.append((c, part, blocks, at, n, rows, k, one, symbol(one, blank), r))
                    at += 1
                    blank = not one.strip()
                    if len(out) == 1 << 15:
                        yield dict(zip(LINE, map(list, zip(*out))))
                        out = []
                rows += 1
            if out:
                yield dict(zip(LINE, map(list, zip(*out))))

        return each

    # block and row numbers go on from one partition to the next; a number for each partition is ordered
    found = stored(in_batches(ordered, "conv long, part int, block long, at int, turn long, row long, line int, text string, symbol int, role string", make), "transcript-lines")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.groupBy("part").agg((F.max("block") + 1).alias("blocks"), (F.max("row") + 1).alias("rows"))
    before = counts.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("blocks", "rows")])
    placed = found.join(F.broadcast(before), "part")  # a row for each partition
    return placed.select("conv", (F.col("block") + F.col("blocks")).alias("block"), "at", "turn", (F.col("row") + F.col("rows")).alias("row"), "line", "text", "symbol", "role")


def _moves(turns: DataFrame, block: int) -> Iterator[tuple[int, int, int]]:
    """(last, next, count) over neighbouring rows of ``conv, at, first, last``; a null state is a turn of unknown role, and no move."""
    level = turns
    while True:
        several = level.groupBy("conv").count()
        long = not several.where(F.col("count") > block).isEmpty()
        group = F.floor(F.col("at") / block) if long else F.lit(0).cast("long")
        level = level.withColumn("group", group)
        own = Window.partitionBy("conv", "group").orderBy("at")
        pairs = level.select("last", F.lead("first").over(own).alias("next")).where("last is not null and next is not null")
        yield from pairs.groupBy("last", "next").count().collect()
        if not long:
            return
        level = stored(level.groupBy("conv", "group").agg(F.min_by("first", "at").alias("first"), F.max_by("last", "at").alias("last")).withColumnRenamed("group", "at"), "turn-ranges")


def fit(known: DataFrame, smooth: float = 0.5, block: int = 256) -> Model:
    """From :func:`lines` of rows whose roles are known.  Moves to the next row there is are counted in ranges of ``block`` rows, then between the ranges, so no conversation is gathered."""
    role = F.when(F.col("role") == ROLES[0], 0)
    for i, r in enumerate(ROLES[1:], 1):
        role = role.when(F.col("role") == r, i)
    state = 2 * role + F.when(F.col("line") > 0, 1).otherwise(0)
    rows = stored(known.select("conv", "row", "line", "symbol", state.cast("int").alias("state")), "known-lines")
    emit, move, start = np.full((STATES, SYMBOLS), smooth), np.full((STATES, STATES), smooth), np.full(STATES, smooth)
    for s, o, n in rows.where("state is not null").groupBy("state", "symbol").count().collect():
        emit[s, o] += n
    turns = rows.groupBy("conv", "row").agg(F.min_by("state", "line").alias("first"), F.max_by("state", "line").alias("last"), F.max("line").alias("more"))
    turns = stored(turns, "known-turns")
    for s, t, n in _moves(turns.select("conv", F.col("row").alias("at"), "first", "last"), block):
        move[s, t] += n
    for s, n, more in turns.where("first is not null and more > 0").groupBy("first").agg(F.count("*"), F.sum("more")).collect():
        move[s, s + 1] += n
        move[s + 1, s + 1] += more - n
    for s, n in turns.groupBy("conv").agg(F.min_by("first", "row").alias("s")).where("s is not null").groupBy("s").count().collect():
        start[s] += n
    move[:, 1::2] *= np.array([[s // 2 == t for t in range(len(ROLES))] for s in range(STATES)])  # a turn goes on in its own role
    start[1::2] = 0
    with np.errstate(divide="ignore"):
        return Model(*(np.log(x / x.sum(-1, keepdims=True)) for x in (start, move, emit)))


def viterbi(model: Model, seen: np.ndarray, first: int | None = None, last: int | None = None) -> np.ndarray:
    """The best states; ``first`` and ``last`` fix those of a block inside a conversation."""
    value = model.start + model.emit[:, seen[0]] if first is None else np.where(np.arange(STATES) == first, model.emit[:, seen[0]], -np.inf)
    back = np.zeros((len(seen), STATES), dtype=np.int8)
    for t in range(1, len(seen)):
        scores = value[:, None] + model.move
        back[t] = scores.argmax(0)
        value = scores.max(0) + model.emit[:, seen[t]]
    path = np.empty(len(seen), dtype=np.int64)
    path[-1] = value.argmax() if last is None else last
    for t in range(len(seen) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def summary(model: Model, seen: np.ndarray) -> np.ndarray:
    """Best score from each first to each last state of a block."""
    m = np.where(np.eye(STATES, dtype=bool), model.emit[:, seen[0]][:, None], -np.inf)
    for o in seen[1:]:
        m = (m[:, :, None] + model.move[None]).max(1) + model.emit[:, o]
    return m


def joined(model: Model, parts: list[np.ndarray]) -> np.ndarray:
    m = parts[0]
    for p in parts[1:]:
        step = (m[:, :, None] + model.move[None]).max(1)
        m = (step[:, :, None] + p[None]).max(1)
    return m


def borders(model: Model, parts: list[np.ndarray], first: int | None, last: int | None) -> list[tuple[int, int]]:
    """(first, last state) of each part on the best path between ``first`` and ``last``."""
    begin = model.start if first is None else np.where(np.arange(STATES) == first, 0.0, -np.inf)
    trace, entry = [], begin
    for p in parts:
        scores = entry[:, None] + p
        trace.append((scores.argmax(0), scores.max(0)))
        entry_scores = trace[-1][1][:, None] + model.move
        trace[-1] += (entry_scores.argmax(0),)
        entry = entry_scores.max(0)
    end = int(trace[-1][1].argmax()) if last is None else last
    out = []
    for source, _, _ in reversed(trace):
        a = int(source[end])
        out.append((a, end))
        k = len(trace) - len(out) - 1
        end = int(trace[k][2][a]) if k >= 0 else end
    return out[::-1]


def _groups(batch_columns: list[str], keys: int, flush) -> tuple:
    """(each, finish) that call ``flush(rows)`` for each run of rows with equal first ``keys`` columns."""
    waiting: list[tuple] = []

    def each(batch) -> Iterator[dict]:
        for row in zip(*(values(batch, c) for c in batch_columns)):
            if waiting and waiting[-1][:keys] != row[:keys]:
                yield from flush(waiting)
                waiting.clear()
            waiting.append(row)

    def finish() -> Iterator[dict]:
        if waiting:
            yield from flush(waiting)

    each.finish = finish
    return each


def _fixed(rows: DataFrame, model: Model, fan: int) -> DataFrame | None:
    """``block, first, last``: the best states at the borders of all blocks of conversations that have several."""
    spark, n = rows.sparkSession, partitions(rows.sparkSession)
    spans = rows.groupBy("conv").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    several = stored(spans.select(F.col("conv").alias("_conv")), "long-conversations")
    if several.isEmpty():
        return None
    shared = spark.sparkContext.broadcast(model)  # tables of fixed size

    def leaves():
        def flush(rows):
            m = summary(shared.value, np.array([r[2] for r in rows]))
            yield {"conv": [rows[0][0]], "block": [rows[0][1]], "score": [m.reshape(-1).tolist()]}

        return _groups(["conv", "block", "symbol"], 2, flush)

    def parents():
        def flush(rows):
            m = joined(shared.value, [np.array(r[3]).reshape(STATES, STATES) for r in rows])
            yield {"conv": [rows[0][0]], "block": [rows[0][1]], "score": [m.reshape(-1).tolist()]}

        return _groups(["conv", "up", "block", "score"], 2, flush)

    schema = "conv long, block long, score array<double>"
    own = rows.join(several, F.col("conv").eqNullSafe(F.col("_conv")), "left_semi").select("conv", "block", "at", "symbol").repartition(n, "block").sortWithinPartitions("block", "at")
    levels = [stored(in_batches(own.select("conv", "block", "symbol"), schema, leaves), "blocks")]
    up = F.floor(F.col("block") / fan).alias("up")
    ranked = lambda level: level.select("conv", up, "block", "score").repartition(n, "conv", "up").sortWithinPartitions("conv", "up", "block")
    while not levels[-1].groupBy("conv").count().where("count > 1").isEmpty():
        levels.append(stored(in_batches(ranked(levels[-1]), schema, parents), "blocks"))
    fixed = levels.pop().select("conv", "block", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def children():
        def flush(rows):
            ends = borders(shared.value, [np.array(r[3]).reshape(STATES, STATES) for r in rows], rows[0][4], rows[0][5])
            yield {"conv": [r[0] for r in rows], "block": [r[2] for r in rows], "first": [a for a, _ in ends], "last": [b for _, b in ends]}

        return _groups(["conv", "up", "block", "score", "first", "last"], 2, flush)

    while levels:
        above = fixed.select(F.col("conv").alias("_conv"), F.col("block").alias("_up"), "first", "last")
        level = levels.pop().select("conv", up, "block", "score")
        level = level.join(above, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("up") == F.col("_up")))
        level = level.select("conv", "up", "block", "score", "first", "last").repartition(n, "conv", "up").sortWithinPartitions("conv", "up", "block")
        fixed = stored(in_batches(level, "conv long, block long, first int, last int", children), "borders")
    return fixed.drop("conv")


TURN = "conv long, turn long, line int, role string, n_lines int, content string, rendered string, truth string"
PART = "conv long, block long, begins boolean, ends boolean, turn long, line int, role string, n_lines int, raw string, truth string"


def _rendered(role: str, raw: str) -> tuple[str, str]:
    content = raw.strip()
    return content, f"<|{role}|>\n{content}\n<|end|>\n"


def turns_of(rows: DataFrame, model: Model, fan: int = 256) -> DataFrame:
    """Canonical turns of :func:`lines`: ``conv, turn, line`` (of the first line), ``role, n_lines, content, rendered`` and ``truth`` (the first line's given role)."""
    spark, n = rows.sparkSession, partitions(rows.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # tables of fixed size
    fixed = _fixed(rows, model, fan)
    none = F.lit(None).cast("int")
    if fixed is None:
        rows = rows.withColumns({"first": none, "last": none, "goes_on": F.lit(False)})
    else:
        after = fixed.select((F.col("block") - 1).alias("block"), (F.col("first") % 2 == 1).alias("goes_on"))  # what lies in another conversation begins
        rows = rows.join(fixed.join(after, "block", "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False))), "block", "left")
    names = [f.name for f in T.StructType.fromDDL(PART)]

    def make():
        def flush(rows):
            path = viterbi(shared.value, np.array([r[5] for r in rows]), rows[0][6], rows[0][7])
            starts = [0, *(i for i in range(1, len(path)) if path[i] % 2 == 0), len(path)]
            out = []
            for a, b in zip(starts, starts[1:]):
                begins = bool(path[a] % 2 == 0)
                raw = "\n".join([marker(rows[a][4])[1] if begins else rows[a][4], *(r[4] for r in rows[a + 1 : b])])
                out.append((rows[a][0], rows[a][1], begins, not (b == len(path) and rows[0][9]), rows[a][2], rows[a][3], ROLES[path[a] // 2], b - a, raw, rows[a][8]))
            yield dict(zip(names, map(list, zip(*out))))

        return _groups(["conv", "block", "turn", "line", "text", "symbol", "first", "last", "role", "goes_on"], 2, flush)

    ordered = rows.repartition(n, "block").sortWithinPartitions("block", "at")
    parts = in_batches(ordered.select("conv", "block", "turn", "line", "text", "symbol", "first", "last", "role", "goes_on"), PART, make)
    if fixed is None:
        return _put_together(parts.withColumn("parts", F.array(F.struct("n_lines", "raw"))))
    parts = stored(parts, "turn-parts")
    whole = parts.where("begins and ends").select("conv", "turn", "line", "role", "truth", F.array(F.struct("n_lines", "raw")).alias("parts"))
    return _put_together(whole.unionByName(_crossing(parts.where("not (begins and ends)"))))


def _crossing(parts: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Turns in several parts: each part belongs to the last beginning before it.

    At most two parts of a block lie here, and one of them begins a turn.  The running
    maximum is taken in ranges of ``width`` blocks, and between the ranges over a row for each.
    """
    begun = F.when(F.col("begins"), F.col("block"))
    ranged = parts.withColumn("_range", F.floor(F.col("block") / width).cast("long"))
    own = Window.partitionBy("_range").orderBy("block", "begins").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy("_range").agg(F.max(begun).alias("_top")).select("_range", F.max("_top").over(earlier).alias("_before"))
    chained = ranged.withColumn("_own", F.max(begun).over(own)).join(tops, "_range").withColumn("_chain", F.coalesce("_own", "_before"))
    inside = F.struct("block", "begins", "n_lines", "raw")
    turns = chained.groupBy("_chain").agg(
        F.max_by(F.struct("conv", "turn", "line", "role", "truth"), F.col("begins")).alias("head"),  # one part alone begins
        F.array_sort(F.collect_list(inside)).alias("all"),  # of one turn, which the result holds whole
    )
    return turns.select("head.*", F.transform("all", lambda p: F.struct(p["n_lines"].alias("n_lines"), p["raw"].alias("raw"))).alias("parts"))


def _put_together(turns: DataFrame) -> DataFrame:
    names = [f.name for f in T.StructType.fromDDL(TURN)]

    def make():
        def each(batch):
            out = []
            for c, turn, line, role, truth, parts in zip(*(values(batch, x) for x in ("conv", "turn", "line", "role", "truth", "parts"))):
                content, rendered = _rendered(role, "\n".join(p["raw"] for p in parts))
                out.append((c, turn, line, role, sum(p["n_lines"] for p in parts), content, rendered, truth))
            yield dict(zip(names, map(list, zip(*out))))

        return each

    return in_batches(turns.select("conv", "turn", "line", "role", "truth", "parts"), TURN, make)


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """The ``conversations`` table as raw transcripts: ``conv_id, turn, text`` with markers of five styles, one of them none, and every sixth marker missing."""
    style, lost = F.pmod(F.xxhash64("conv_id"), F.lit(5)), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6)) == 0
    by_role: dict[str, tuple[str, ...]] = {
        "system": ("System: ", "### System\n", "**Instructions:** ", "<|system|> "),
        "user": ("User: ", "### Human\n", "**Q:** ", "<|user|> "),
        "assistant": ("Assistant: ", "### Assistant\n", "**A:** ", "<|assistant|> "),
    }
    mark: Column = F.lit("")
    for role, forms in by_role.items():
        for k, form in enumerate(forms):
            mark = F.when((F.col("role") == role) & (style == k) & ~lost, F.lit(form)).otherwise(mark)
    return conversations.withColumn("text", F.concat(mark, F.coalesce("text", F.lit(""))))
