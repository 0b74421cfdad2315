import functools
import random

import pytest

from ordercast.llm.chat_repair import Costs, repaired

TURNS = "conv_id long, turn int, role string, text string"
COSTS = Costs()
NUMBER = {"system": 1, "user": 2, "assistant": 3}
AFTER = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


@functools.cache
def cheapest(roles, state=0):
    """The least cost by trying everything."""
    if not roles:
        return 0 if state in (2, 3) else COSTS.insert if state == 1 else 1 << 30
    role, rest = NUMBER.get(roles[0], 0), roles[1:]
    ways = [(n, 0) for n in AFTER[state]]
    ways += [(n, COSTS.insert) for k in AFTER[state] if k != 1 for n in AFTER[k]]
    costs = [c + (0 if n == role else COSTS.relabel) + cheapest(rest, n) for n, c in ways]
    if state:
        costs.append((COSTS.merge if state == role else COSTS.merge_other) + cheapest(rest, state))
    return min(costs)


def roles_shown(text):
    return [h.split("|>")[0] for h in text.split("<|") if h and not h.startswith("end|>")]


@pytest.mark.parametrize("longest", [1000, 3])
def test_repair_is_legal_and_cheapest(spark, longest):
    rng = random.Random(5)
    rows = []
    for c in range(120):
        rows += [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "user"]), f"t{t}.") for t in range(rng.randint(1, 9))]
    rows += [(500, t, rng.choice(["user", "assistant", "system"]), "x") for t in range(400)]
    found = {}
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'own' as task", "'own' as cost", "'own' as piece")
    for r in repaired(df, longest=longest).orderBy("conv_id", "position").collect():
        found.setdefault(r.conv_id, []).append(r)
    for c, turns in found.items():
        roles = tuple(r[2] for r in rows if r[0] == c)
        assert len(turns) == len(roles) and {t.cost for t in turns} == {cheapest(roles)}
        text = "".join(t.rendered for t in turns)
        shown = roles_shown(text)
        if shown[0] == "system":
            shown = shown[1:]
        assert shown and shown == ["user", "assistant"] * (len(shown) // 2) + ["user"] * (len(shown) % 2)
        assert text.endswith("<|end|>\n") and text.count("<|end|>") == len(roles_shown(text))
        if c != 500:
            assert [w for w in text.replace("\n", " ").replace("<|end|>", " ").split() if w.startswith("t")] == [f"t{k}." for k in range(len(roles))]


def test_legal_conversations_are_left_alone(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", None)]
    found = sorted(repaired(spark.createDataFrame(rows, TURNS)).collect())
    assert [(r.action, r.role_out, r.cost) for r in found] == [("s", "system", 0), ("u", "user", 0), ("a", "assistant", 0), ("u", "user", 0)]
    assert "".join(r.rendered for r in found[:3]) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"


def test_odd_rows(spark):
    big = (1 << 60) + 1
    rows = [(None, None, None, None), (None, 1, "user", "a"), (big, 0, "assistant", "hi"), (3, 1, "user", "x"), (3, 1, "user", "x"), (4, None, "system", "")]
    found = repaired(spark.createDataFrame(rows, TURNS)).orderBy("position").collect()
    assert len(found) == len(rows) and {r.conv_id for r in found} == {None, big, 3, 4}
    assert "".join(r.rendered for r in found if r.conv_id == 3) == "<|user|>\nx\nx<|end|>\n"
    assert "".join(r.rendered for r in found if r.conv_id == 4) == "<|system|>\n<|end|>\n<|user|>\n<|end|>\n"
    assert repaired(spark.createDataFrame([], TURNS)).collect() == []
