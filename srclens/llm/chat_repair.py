"""Chat formatting by minimum-cost role repair.

A conversation must walk a legal-turn automaton: at most one system turn, first, then user and
assistant in alternation from the user on; it may end with either. Dynamic
programming over the automaton's states finds the cheapest repair: a turn is kept, relabelled
or merged into the turn before, and empty turns are inserted where roles are missing. The repaired
sequence is rendered with role markers. Ties go to the first of keep, merge, relabel, insert.

A conversation of up to ``BLOCK`` turns, nearly every one, is repaired where its turns meet. The turns of longer ones
are sorted over range partitions, so that a conversation may span many, and dealt in order to
blocks. Each block's part of a conversation, a piece, is reduced to its table of least costs from state to
state. Costs are carried along the pieces forward, one piece after another, and the chosen states back; then all pieces are
rendered in parallel between their states, and put together again where that makes at most ``WHOLE_BYTES``. Only a conversation above both bounds
is a row a piece, whose texts in order of ``piece`` are the whole and whose counts and costs add up.

Defined results for odd input: roles are compared trimmed in lower case, ``ALIASES`` are their
names, other roles and null must be relabelled; a null text is empty; turns in order of (turn, role, text) with nulls first, so ties and
repeated rows have a place; a turn with a null conv_id is a conversation of its own; markers inside texts are
broken by a space; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srclens.llm.common import Scratch, written

ALIASES = {
    "system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user",
    "assistant": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "gpt": "assistant",
}
SYSTEM, USER, ASSISTANT, START = 0, 1, 2, 3
NAMES = ("system", "user", "assistant")
#: Roles that may follow each state, the last role; START has no turn yet.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (USER, ASSISTANT)
#: Costs of the repairs. A merge with a turn of another role costs more, a turn of unknown role is cheap to label.
MERGE, MERGE_OTHER, RELABEL, LABEL_UNKNOWN, INSERT = 10, 25, 20, 5, 14
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns of a block, all of which a task holds at once.
BLOCK = 128
#: Bytes of rendered text up to which the pieces of a conversation become one row.
WHOLE_BYTES = 1 << 24
#: Numbers of long conversations up to which their ids are broadcast.
FEW_IDS = 100_000
STATES = (SYSTEM, USER, ASSISTANT, START)


def _insertions() -> dict[tuple[int, int], list[int]]:
    """The fewest empty turns that make ``role`` legal after ``state``, by breadth-first search."""
    out: dict[tuple[int, int], list[int]] = {}
    for state in NEXT:
        reached = [(state, [])]
        for at, path in reached:
            for role in NEXT[at]:
                if (state, role) not in out:
                    out[state, role] = path
                    reached.append((role, [*path, role]))
    return out


INSERTIONS = _insertions()


def steps_of(roles: list[int | None], start: int = START) -> tuple[dict[int, int], list[dict[int, tuple[int, str, list[int]]]]]:
    """The least cost of every state after the turns, from ``start``, and for every turn how each state was reached."""
    big = 1 << 60
    best = {start: 0}
    back: list[dict[int, tuple[int, str, list[int]]]] = []
    for role in roles:
        now: dict[int, int] = {}
        how: dict[int, tuple[int, str, list[int]]] = {}
        for state, cost in best.items():
            options = []
            if role is not None and (state, role) in INSERTIONS:
                options.append((0, role, "keep", INSERTIONS[state, role]))
            if state != START:
                options.append((MERGE if role == state else MERGE_OTHER, state, "merge", []))
            for other in (SYSTEM, USER, ASSISTANT):
                if other != role and (state, other) in INSERTIONS:
                    options.append((RELABEL if role is not None else LABEL_UNKNOWN, other, "relabel", INSERTIONS[state, other]))
            for price, to, action, inserted in options:
                total = cost + price + INSERT * len(inserted)
                if total < now.get(to, big):
                    now[to] = total
                    how[to] = (state, action, inserted)
        back.append(how)
        best = now
    return best, back


def ending(costs: dict[int, int]) -> tuple[int, int]:
    """The least cost of an end, with an empty turn where the state isn't a final one, and its state."""
    return min((cost + (0 if state in FINAL or state == START else INSERT), state) for state, cost in costs.items())


def repair(roles: list[int | None], start: int = START, end: int | None = None) -> tuple[int, list[tuple[str, int, list[int]]]]:
    """The least cost, and for every turn what becomes of it: the action, the role it ends in and the empty turns before it.

    The last entry, ``end``, has the empty turns after the last turn; with a state ``end`` the conversation goes on and has none.
    """
    best, back = steps_of(roles, start)
    if end is None:
        cost, state = ending(best)
        after = [] if state in FINAL or state == START else [USER]
    else:
        cost, state, after = best[end], end, []
    steps: list[tuple[str, int, list[int]]] = [("end", state, after)]
    for how in reversed(back):
        before, action, inserted = how[state]
        steps.append((action, state, inserted))
        state = before
    return cost, steps[::-1]


def known_roles(roles: list[str | None]) -> list[int | None]:
    known = [ALIASES.get((r or "").strip().lower()) for r in roles]
    return [NAMES.index(r) if r else None for r in known]


def render(roles: list[str | None], texts: list[str | None], start: int = START, end: int | None = None) -> dict:
    """The repaired conversation of raw roles and texts, or the piece of one between two states.

    ``lead`` is what goes on in the turn before the piece; ``opens`` tells whether a turn begins in it, and ``filled`` whether its last turn has
    any text in it.
    """
    cost, steps = repair(known_roles(roles), start, end)
    turns: list[tuple[int, list[str]]] = []
    lead: list[str] = []
    count = {"keep": 0, "merge": 0, "relabel": 0, "end": 0}
    inserted = 0
    for (action, role, empty), text in zip(steps, [*texts, None], strict=True):
        turns += [(r, [""]) for r in empty]
        inserted += len(empty)
        count[action] += 1
        if action == "merge":
            (turns[-1][1] if turns else lead).append(text or "")
        elif action != "end":
            turns.append((role, [text or ""]))
    safe = lambda parts: "\n".join(x for x in parts if x).replace("<|im_", "< |im_")
    closed = f"{CLOSE}\n"
    body = closed.join(f"{OPEN}{NAMES[r]}\n{safe(parts)}" for r, parts in turns)
    return {
        "n_turns": len(texts),
        "n_rendered": len(turns),
        "n_merged": count["merge"],
        "n_relabelled": count["relabel"],
        "n_inserted": inserted,
        "cost": cost,
        "roles": ",".join(NAMES[r] for r, _ in turns),
        "lead": safe(lead),
        "text": (closed if turns and start != START else "") + body + (closed if end is None and (turns or start != START) else ""),
        "opens": bool(turns),
        "filled": any(turns[-1][1]) if turns else any(lead),
    }


_ID = "conv_id long, own long, part long, block long"
_COUNTS = ("n_turns", "n_rendered", "n_merged", "n_relabelled", "n_inserted", "cost")
_PIECE = f"{_ID}, {', '.join(f'{n} long' for n in _COUNTS)}, roles string, lead string, text string, opens boolean, filled boolean"
_NAMES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _NAMES[x.split()[1]]) for x in ddl.split(", ")])


def _runs(table: pa.Table) -> Iterator[tuple[tuple, list[dict]]]:
    """The turns of each conversation of a block, in order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
    return ((k, list(rows)) for k, rows in groupby(rows, key=lambda r: (r["conv_id"], r["own"])))


def _costs(key, table):
    """A piece's least costs from state to state, 16 numbers; -1 where there is no way."""
    out = []
    for (conv_id, own), rows in _runs(table):
        roles = known_roles([r["role"] for r in rows])
        costs = [best.get(to, -1) for best in (steps_of(roles, at)[0] for at in STATES) for to in STATES]
        out.append({"conv_id": conv_id, "own": own, "part": key[0].as_py(), "block": key[1].as_py(), "costs": costs})
    return pa.Table.from_pylist(out, schema=_schema(f"{_ID}, costs array<long>"))


def _through(entry: dict[int, int], costs: list[int]) -> dict[int, tuple[int, int]]:
    """For every state after a piece the least cost and the state before it, from the costs before it."""
    ways = [(cost + costs[4 * at + to], at, to) for at, cost in entry.items() for to in STATES if costs[4 * at + to] >= 0]
    return {to: min((cost, at) for cost, at, x in ways if x == to) for to in {x for _, _, x in ways}}


def _stream(df: DataFrame, ddl: str, each, newest_first: bool = False) -> DataFrame:
    """``each(state, row) -> (state, out)`` along the pieces of every conversation; only the state is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if at != (row["conv_id"], row["own"]):
                    at, state = (row["conv_id"], row["own"]), None
                state, found = each(state, row)
                out.append(found)
            yield pa.RecordBatch.from_pylist(out, schema=_schema(ddl))

    way = [F.col(c).desc() if newest_first else F.col(c).asc() for c in ("part", "block")]
    return df.repartition("conv_id", "own").sortWithinPartitions("conv_id", "own", *way).mapInArrow(run, ddl)


def _pick(row: dict, **more) -> dict:
    return {k: row[k] for k in ("conv_id", "own", "part", "block")} | more


def _forward(state, row):
    """Costs of the states before a piece."""
    entry = state or {START: 0}
    after = {to: cost for to, (cost, _) in _through(entry, row["costs"]).items()}
    return after, _pick(row, costs=row["costs"], entry=[entry.get(s, -1) for s in STATES])


def _backward(state, row):
    """The states before and after a piece; -1 after the last."""
    ways = _through({s: c for s, c in zip(STATES, row["entry"], strict=True) if c >= 0}, row["costs"])
    end = ending({to: cost for to, (cost, _) in ways.items()})[1] if state is None else state
    return ways[end][1], _pick(row, start=ways[end][1], end=-1 if state is None else end)


def _filled(state, row):
    """Whether the turn that a piece goes on with has text already."""
    after = row["filled"] if row["opens"] else bool(state) or row["filled"]
    return after, _pick(row, before=bool(state))


def _pieces(key, turns, states):
    found = {(s["conv_id"], s["own"]): s for s in states.to_pylist()}
    out = []
    for at, rows in _runs(turns):
        s = found[at]
        piece = render([r["role"] for r in rows], [r["text"] for r in rows], s["start"], None if s["end"] < 0 else s["end"])
        out.append(_pick(s) | piece)
    return pa.Table.from_pylist(out, schema=_schema(_PIECE))


_OUT = f"conv_id long, piece int, {', '.join(f'{n} long' for n in _COUNTS)}, roles string, text string"


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rendered conversations, whose turns come one after another."""
    schema = pa.schema([(x.split()[0], pa.int32() if x.split()[1] == "int" else _NAMES[x.split()[1]]) for x in _OUT.split(", ")])
    at, turns, out = None, [], []

    def done() -> None:
        if turns:
            found = render([r["role"] for r in turns], [r["text"] for r in turns])
            out.append({"conv_id": turns[0]["conv_id"], "piece": 0} | {n: found[n] for n in (*_COUNTS, "roles", "text")})
            turns.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if at != (row["conv_id"], row["own"]):
                done()
                at = row["conv_id"], row["own"]
            turns.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    done()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def chat_format(turns: DataFrame, block: int = BLOCK, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """A row a conversation, or a piece of a very long one: ``conv_id, piece``, counts of the repairs, ``cost``, ``roles`` and the rendered ``text``."""
    order = ["conv_id", "own", "turn", "role", "text", "_n"]
    by = [F.col(c).asc_nulls_first() for c in order]
    named = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("_n", F.monotonically_increasing_id())
    named = named.withColumn("own", F.when(F.col("conv_id").isNull(), F.col("_n")).otherwise(F.lit(-1)))
    counts = turns.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").groupBy("conv_id").count()
    long = written(counts.where(F.col("count") > block).select("conv_id"), "long-conversations")
    n_long = long.count()
    if n_long:
        ids = F.broadcast(long) if n_long <= FEW_IDS else long
        short = named.join(ids, "conv_id", "left_anti")
    else:
        short = named
    short = short.repartition("conv_id", "own").sortWithinPartitions(*by).select("conv_id", "own", "role", "text").mapInArrow(_wholes, _OUT)
    if not n_long:
        return short
    return short.unionByName(_in_pieces(named.join(ids, "conv_id", "left_semi").select(*order), by, block, whole_bytes))


def _in_pieces(ordered: DataFrame, by: list, block: int, whole_bytes: int) -> DataFrame:
    """The rows of long conversations, by blocks."""
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    ordered = ordered.select("conv_id", "own", "role", "text", at.alias("at"))
    seq = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    key = [x.split()[0] for x in _ID.split(", ")]
    with Scratch(ordered.sparkSession) as scratch:
        # Written once, as another sort might cut the partitions elsewhere.
        placed = scratch.written(ordered.select("conv_id", "own", F.shiftright("at", 33).alias("part"), F.floor(seq / block).alias("block"), seq.alias("seq"), "role", "text"), "turns")
        costs = placed.select("conv_id", "own", "part", "block", "seq", "role").groupBy("part", "block").applyInArrow(_costs, f"{_ID}, costs array<long>")
        forward = _stream(costs, f"{_ID}, costs array<long>, entry array<long>", _forward)
        states = _stream(forward, f"{_ID}, start long, end long", _backward, newest_first=True)
        both = placed.groupBy("part", "block").cogroup(states.groupBy("part", "block"))
        pieces = scratch.written(both.applyInArrow(_pieces, _PIECE), "pieces")
        before = _stream(pieces.select(*key, "opens", "filled"), f"{_ID}, before boolean", _filled)
        numbered = before.withColumn("piece", F.row_number().over(Window.partitionBy("conv_id", "own").orderBy("part", "block")) - 1)
        gap = F.when(F.col("before") & (F.col("lead") != ""), "\n").otherwise("")
        found = pieces.join(numbered, key).withColumn("text", F.concat(gap, "lead", "text"))
        found = written(found.select("conv_id", "piece", *_COUNTS, "roles", "text"), "conversation-pieces")
    sizes = found.groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("_bytes"))
    small = sizes.where(F.col("_bytes") <= whole_bytes).select("conv_id")
    parts = F.sort_array(F.collect_list(F.struct("piece", "roles", "text")))
    joined = found.join(small, "conv_id", "left_semi").groupBy("conv_id").agg(F.lit(0).alias("piece"), *[F.sum(n).alias(n) for n in _COUNTS], parts.alias("_p"))
    joined = joined.withColumn("roles", F.array_join(F.filter(F.transform("_p", lambda x: x["roles"]), lambda r: r != ""), ",")).withColumn("text", F.array_join(F.transform("_p", lambda x: x["text"]), ""))
    apart = found.join(small, "conv_id", "left_anti")
    return joined.drop("_p").unionByName(apart)
