import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
COSTS = chat.Costs()


def ways(roles):
    """(cost, steps) of every repair, by trying every step at every turn; as the rule prefers them: cheapest, least end state, first steps from the end on."""
    table, found = chat.step_table(COSTS), []
    names = [chat.normal_role(r) for r in roles]
    for way in itertools.product(*[range(len(table[n])) for n in names]):
        steps = [table[n][i] for n, i in zip(names, way)]
        state, cost = chat.START, 0
        for step in steps:
            if step[0] != state:
                break
            state, cost = step[1], cost + step[2]
        else:
            found.append((cost + chat.ending(state, COSTS)[0], state, way[::-1], steps))
    found.sort(key=lambda f: f[:3])
    return [(f[0] / chat.UNIT, f[3]) for f in found]


def brute(roles):
    return ways(roles)[0][0]


def rendered(turns, steps):
    """The whole text of (role, text) turns repaired by these steps, written turn by turn."""
    said = []
    for (_, text), (_, _, _, new, merged, before) in zip(turns, steps):
        said += [[role, ""] for role in before]
        if merged:
            said[-1][1] += "\n\n" + text
        else:
            said.append([new, text])
    state = steps[-1][1] if steps else chat.START
    said += [[role, ""] for role in chat.ending(state, COSTS)[1]]
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in said)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_repairs_equal_brute_force_whatever_the_tasks(spark, parts):
    rng = np.random.default_rng(11)
    roles = ["user", "assistant", "system", "tool"]
    rows = [(c, t, roles[int(rng.integers(0, 4))], f"c{c} t{t}") for c in range(40) for t in range(int(rng.integers(1, 5)))]
    rows += [(100, t, ["user", "user", "assistant", "assistant", "system"][int(rng.integers(0, 5))], f"long {t}") for t in range(200)]
    rows += [(200, 1, "user", f"{chr(97 + i % 5) * 80}{i % 7}") for i in range(60)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1:])
        cost, steps = ways([r[2] for r in own])[0] if len(own) < 5 else chat.repair([r[2] for r in own])
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.turn) if conv != 200 else [r for r in got if r.conv_id == conv]
        if conv != 200:
            mine.sort(key=lambda r: (r.turn, r.piece))
        assert sum(r.cost for r in mine) == pytest.approx(cost)
        assert [(r.text, r.role, "merge" in r.action) for r in mine if r.action != "insert"] == [(o[3], s[3], s[4]) for o, s in zip(own, steps)]
        assert "".join(r.rendered for r in mine) == rendered([o[2:] for o in own], steps)


@pytest.mark.parametrize("roles", [["user", "assistant"], ["assistant"], ["user", "user", "assistant"], ["system", "system", "user"], ["user", None, "assistant", "system"], ["bogus"], []])
def test_cost_is_least(roles):
    assert chat.repair(roles)[0] == pytest.approx(brute(roles))


def legal(rows):
    turns = []
    for r in rows:
        if "merge" not in r.action:
            turns.append(r.role)
    body = turns[1:] if turns and turns[0] == "system" else turns
    return body == ["user", "assistant"] * (len(body) // 2)


def test_conversations_over_task_borders(spark):
    rng = np.random.default_rng(4)
    roles = ["user", "assistant", "system", "User ", "tool", None]
    rows = [(int(c), t, roles[int(rng.integers(0, 6))], f"t{t}") for c in range(12) for t in range(int(rng.integers(1, 9)))]
    rows += [(99, t, roles[int(rng.integers(0, 3))], f"long {t}") for t in range(700)] + [(None, 1, "user", None), (None, None, "user", "x"), (50, 1, "user", "same"), (50, 1, "user", "same")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"piece": F.lit(1), "mark": F.lit(2), "cost": F.lit(0)})
    got = chat.format_chats(df).collect()
    assert sum(r.action != "insert" for r in got) == len(rows)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        mine = [r for r in got if r.conv_id == conv]
        assert sum(r.cost for r in mine) == pytest.approx(chat.repair([r[2] for r in own])[0])
        ordered = sorted(mine, key=lambda r: (r.turn is not None, r.turn or 0, r.piece))
        if conv != 50 and conv is not None:
            assert legal(ordered)
            whole = "".join(r.rendered for r in ordered)
            assert whole.endswith("<|end|>\n") and whole.count("<|end|>") == whole.count("<|user|>") + whole.count("<|assistant|>") + whole.count("<|system|>")
            assert all((r[3] or "") in whole for r in own)


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
