"""Chat formatting: minimum-cost role repair, then rendering.

A legal conversation is a path of an automaton: an optional system turn, then
user and assistant in turn, ending with the assistant.  A given turn can keep
its role, be relabelled, and either open a turn or be merged into the one
before; empty turns can be inserted.  Dynamic programming over the automaton's
states finds the cheapest repair.

Costs add along a conversation and the states are four, so a stretch of turns
is a 4 x 4 matrix of cheapest costs from state to state, and stretches combine
by (min, +) products.  Turns are dealt to tasks by ranges of (conversation,
turn): a conversation of any length is spread over tasks.  Only the stretches
at task borders (two a task at most) meet on the driver: first their matrices,
from which come the cheapest costs at every border; then, for each state at a
stretch's end, the state at its start that retracing leads to; so every task
retraces its stretches between known states.

Of repairs of equal cost one is chosen by a rule that looks at whole
conversations only: retracing from the end takes the first step, in the fixed
order of steps, that reaches the cheapest cost from the conversation's start.
Costs are whole millionths, hence exact, and the result is the same however
turns are dealt.  It is a row per turn and inserted turn; joined in order they
are the rendered conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

START, SYSTEM, USER, ASSISTANT = range(4)
_ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
_INF = 1 << 60
#: Costs are counted in this part of one.
UNIT = 1_000_000
#: Characters of a text that place it among turns equal in number and role.
PREFIX = 64


@dataclass(frozen=True)
class Costs:
    """Of merging a turn into the one before, of relabelling it (by given and new role), of an empty turn."""

    merge: float = 1.0
    relabel: float = 3.0
    relabel_system: float = 1.25
    unknown: float = 0.5
    insert: float = 1.5


@dataclass(frozen=True)
class Template:
    """How a turn is written: opened, joined within, closed."""

    open: str = "<|{role}|>\n"
    join: str = "\n\n"
    close: str = "<|end|>\n"


def normal_role(role: str | None) -> str:
    """A role's usual name; what is not known is `unknown`."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in _ROLES else "unknown"


def _units(cost: float) -> int:
    return round(cost * UNIT)


def _steps(role: str, costs: Costs):
    """(from state, to state, cost in units, new role, merged, inserted roles before), cheapest and simplest first."""
    out = []
    merge, insert = _units(costs.merge), _units(costs.insert)
    for state in range(4):
        for to, new in ((SYSTEM, "system"), (USER, "user"), (ASSISTANT, "assistant")):
            base = _units(0 if new == role else costs.unknown if role == "unknown" else costs.relabel_system if role == "system" else costs.relabel)
            if state == to:
                out.append((state, to, base + merge, new, True, ()))
            if to == SYSTEM:
                between = () if state == START else None
            elif to == USER:
                between = ("assistant",) if state == USER else ()
            else:
                between = ("user",) if state in (START, SYSTEM, ASSISTANT) else ()
            if between is not None:
                out.append((state, to, base + insert * len(between), new, False, between))
    return sorted(out, key=lambda s: (s[2], len(s[5]), s[4], s[0], s[1]))


def step_table(costs: Costs) -> dict[str, list]:
    return {role: _steps(role, costs) for role in (*_ROLES, "unknown")}


def ending(state: int, costs: Costs) -> tuple[int, tuple[str, ...]]:
    """Cost and turns to insert so that a conversation may end."""
    after = {START: (), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}[state]
    return _units(costs.insert) * len(after), after


#: Cheapest costs at the start of a conversation.
BEGIN = (0, _INF, _INF, _INF)


def block_matrix(roles: list[str], table: dict) -> list[list[int]]:
    """Cheapest cost from each state to each state over a stretch of turns."""
    return [_forward(roles, [_INF if t != s else 0 for t in range(4)], table)[-1] for s in range(4)]


def _forward(roles: list[str], before, table: dict) -> list[list[int]]:
    """Cheapest costs at every state before the first turn, after it, and so on."""
    now = list(before)
    rows = [now]
    for role in roles:
        new = [_INF] * 4
        for a, b, cost, *_ in table[role]:
            if now[a] + cost < new[b]:
                new[b] = now[a] + cost
        rows.append(new)
        now = new
    return rows


def trace(roles: list[str], before, end: int, table: dict, rows=None) -> list[tuple]:
    """The steps that lead to state `end` at cheapest costs, given those before the stretch; of equal ones the first in order, from the end on."""
    rows = rows or _forward(roles, before, table)
    steps, state = [], end
    for i in range(len(roles), 0, -1):
        for step in table[roles[i - 1]]:
            if step[1] == state and rows[i - 1][step[0]] + step[2] == rows[i][state] < _INF:
                steps.append(step)
                state = step[0]
                break
    return steps[::-1]


def best_end(costs_at_end: list[int], costs: Costs) -> int:
    return min(range(4), key=lambda s: (costs_at_end[s] + ending(s, costs)[0], s))


def repair(roles: list[str | None], costs: Costs = Costs()) -> tuple[float, list[tuple]]:
    """(cost, steps) of one conversation in memory; the end's inserted turns are not among the steps."""
    table = step_table(costs)
    names = [normal_role(r) for r in roles]
    rows = _forward(names, BEGIN, table)
    end = best_end(rows[-1], costs)
    return (rows[-1][end] + ending(end, costs)[0]) / UNIT, trace(names, BEGIN, end, table, rows)


def _stretches(batches):
    """Consecutive rows of one conversation, kept whole within a task: (conversation, rows without it)."""
    held, key, any_ = [], None, False
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if any_ and conv != key:
                yield key, held
                held = []
            key, any_ = conv, True
            held.append(row)
    if any_:
        yield key, held


def _ends(batches):
    """(place, conversation, roles) of the first stretch (0) and the last one (1) of a task of (conversation, role) rows."""
    first = last = None
    count = 0
    for conv, held in _stretches(batches):
        last, count = (conv, [normal_role(r) for (r,) in held]), count + 1
        first = first or last
    if count:
        yield 0, *first
    if count > 1:
        yield 1, *last


_BORDER = "pid int, place int, conv_id long, numbers array<long>"
_OUT = "conv_id long, turn long, piece int, role string, action string, cost double, text string, rendered string"


def _chains(borders: list) -> list[list]:
    """Border stretches in order, by conversation."""
    out: list[list] = []
    for r in sorted(borders, key=lambda r: (r["pid"], r["place"])):
        if out and out[-1][-1]["conv_id"] == r["conv_id"]:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def _before(chains: list[list]) -> dict[tuple[int, int], tuple[int, ...]]:
    """(task, place) to the cheapest costs before that stretch."""
    out = {}
    for chain in chains:
        now = BEGIN
        for r in chain:
            m = r["numbers"]
            out[r["pid"], r["place"]] = now
            now = tuple(min(_INF, *(now[a] + m[4 * a + b] for a in range(4))) for b in range(4))
    return out


def _joints(chains: list[list], before: dict, traced: dict, costs: Costs) -> dict[tuple[int, int], tuple[tuple[int, ...], int, int, bool]]:
    """(task, place) to the costs before the stretch, its states at entry and exit and whether the conversation ends with it."""
    out = {}
    for chain in chains:
        state, last = None, True
        for r in reversed(chain):
            at = r["pid"], r["place"]
            if state is None:
                state = best_end([min(_INF, *(before[at][a] + r["numbers"][4 * a + b] for a in range(4))) for b in range(4)], costs)
            entry = traced[at][state] if len(chain) > 1 else START
            out[at] = (before[at], entry, state, last)
            state, last = entry, False
    return out


def format_chats(turns: DataFrame, costs: Costs = Costs(), template: Template = Template(), id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, turn, piece, role, action, cost, text, rendered: repaired turns in order.

    One row for each given turn (piece 1000, action keep, relabel, merge or
    relabel+merge) and for each inserted one (pieces before 1000 stand before
    the turn, later ones after it; action insert).  The rendered pieces of a
    conversation joined by (turn, piece) and row order are its whole text.

    Turns are ordered by turn, role, text, nulls first; rows that repeat are
    turns of their own.  A null or unknown role must be relabelled, a null
    text is empty, rows with a null conv_id are one conversation.  An empty
    table gives no rows; other columns are ignored.
    """
    cols = [F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")]
    # Equal prefixes stay together, so places by prefix and by the whole text agree.
    rows = turns.select(*cols).withColumn("mark", F.substring("text", 1, PREFIX))
    n = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written, so that all passes see the same rows in the same tasks.
    dealt = materialise(rows.repartitionByRange(n, "conv_id", "turn", "role", "mark").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text"))
    table, context = step_table(costs), turns.sparkSession.sparkContext

    def told(numbers):
        """The border stretches of every task with what `numbers` says of them."""

        def run(batches):
            from pyspark import TaskContext

            pid = TaskContext.get().partitionId()
            rows = [(pid, place, conv, numbers(pid, place, roles)) for place, conv, roles in _ends(batches)]
            if rows:
                columns = zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["pid", "place", "conv_id", "numbers"])

        return dealt.select("conv_id", "role").mapInArrow(run, _BORDER).collect()

    chains = _chains(told(lambda pid, place, roles: [c for row in block_matrix(roles, table) for c in row]))
    before = context.broadcast(_before(chains))

    def entries(pid, place, roles):
        """The state at entry for every state at the exit."""
        start = before.value[pid, place]
        rows = _forward(roles, start, table)
        return [next((s[0] for s in trace(roles, start, end, table, rows)[:1]), START) for end in range(4)]

    traced = {(r["pid"], r["place"]): r["numbers"] for r in told(entries)} if any(len(c) > 1 for c in chains) else {}
    joints = context.broadcast(_joints(chains, before.value, traced, costs))

    def write(batches):
        from pyspark import TaskContext

        pid, waiting, place, out = TaskContext.get().partitionId(), None, 0, []
        for stretch in _stretches(batches):
            if waiting is not None:
                out += _render(waiting, joints.value[pid, 0] if place == 0 else None, costs, template, table)
                place = 1
                if len(out) > 2000:
                    yield _batch(out)
                    out = []
            waiting = stretch
        if waiting is not None:
            out += _render(waiting, joints.value[pid, place], costs, template, table)
        if out:
            yield _batch(out)

    return dealt.mapInArrow(write, _OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string())
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _render(stretch, joint, costs: Costs, template: Template, table: dict) -> list[tuple]:
    """Output rows of a stretch; `joint`: as of _joints, or none for a whole conversation."""
    conv, held = stretch
    roles = [normal_role(r) for _, r, _ in held]
    start, entry, end, last = joint or (BEGIN, START, None, True)
    rows = _forward(roles, start, table)
    if end is None:
        end = best_end(rows[-1], costs)
    out = []
    opened = template.open.replace("{role}", "%s")
    state = entry
    for (turn, _, text), role, (_, to, cost, new, merged, before) in zip(held, roles, trace(roles, start, end, table, rows)):
        close = template.close if state != START else ""
        piece = 1000 - len(before)
        for extra in before:
            out.append((conv, turn, piece, extra, "insert", costs.insert, "", close + opened % extra))
            piece, close, cost = piece + 1, template.close, cost - _units(costs.insert)
        action = ("keep" if new == role else "relabel") if not merged else ("merge" if new == role else "relabel+merge")
        out.append((conv, turn, 1000, new, action, cost / UNIT, text or "", (template.join if merged else close + opened % new) + (text or "")))
        state = to
    if last:
        _, after = ending(end, costs)
        turn, piece = held[-1][0], 1000
        for extra in after:
            piece += 1
            out.append((conv, turn, piece, extra, "insert", costs.insert, "", template.close + opened % extra))
        whole = out[-1]
        out[-1] = (*whole[:-1], whole[-1] + template.close)
    return out
