"""Minimum-cost repair of the roles in conversations, and rendering.

Legal conversations are the words of an automaton: an optional system turn, then user and assistant turns in
alternation, the user first. For each turn the repair chooses to keep or change its role, or to merge it into
the turn before; before a turn, an empty turn may be inserted, and one at the end. Costs are fixed
(:class:`Costs`); of equally cheap repairs the one with the smaller state and action numbers is taken.

A turn maps the automaton's state before it to the states after it, at a cost: a small matrix, with minimum
for sum and sum for product. Products are associative, so a conversation of any length is cut into stretches
that tasks work on alone: each gives, for every pair of states at its ends, the cheapest cost and the choices.
Only these go on, one small row per stretch; the cheapest way through them picks each stretch's choices. No
task holds a conversation, and merged turns are rendered without being put together: a merged turn's text
simply follows, without a header.

The order of turns is that of (turn, role, text), nulls first. Null or unknown roles fit no role: changing
them costs as for any other wrong role. Null text is empty. Turns of null conversations form one conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercast.llm.common import prepare, stage

ROLES = ("system", "user", "assistant")
#: States: nothing yet, and the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: For each state, the roles that may come next.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Where a conversation may end.
FINAL = (USER, ASSISTANT)
_FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 3  # into the turn before, of the same role
    merge_other: int = 8  # into a turn of another role
    relabel: int = 5
    insert: int = 4

    def moves(self, role: int) -> list[tuple[int, int, int, str]]:
        """(state before, state after, cost, action) for a turn of a role (0 if it is none of them).

        An action is the roles of inserted empty turns, and then the turn's own role, by their first
        letters, or m for a merge.
        """
        out = []
        for before in range(STATES):
            if before != START:
                out.append((before, before, self.merge if before == role else self.merge_other, "m"))
            paths = [(before, 0, "")]
            paths += [(k, self.insert, "sua"[k - 1]) for k in NEXT[before] if k != SYSTEM]
            for state, cost, inserted in paths:
                for after in NEXT[state]:
                    out.append((before, after, cost + (0 if after == role else self.relabel), inserted + "sua"[after - 1]))
        return out


def stretch(roles: list[int], costs: Costs) -> tuple[np.ndarray, list[list[str]]]:
    """For each pair of states before and after some turns: the least cost, and the actions, comma-separated."""
    moves = [costs.moves(role) for role in range(STATES)]
    best = np.full((STATES, STATES), _FAR)
    np.fill_diagonal(best, 0)
    back: list[dict[tuple[int, int], tuple[int, str]]] = []
    for role in roles:
        now = np.full((STATES, STATES), _FAR)
        choice: dict[tuple[int, int], tuple[int, str]] = {}
        for before, after, cost, action in moves[role]:
            for first in range(STATES):
                if best[first, before] + cost < now[first, after]:
                    now[first, after] = best[first, before] + cost
                    choice[first, after] = before, action
        best = now
        back.append(choice)
    actions = [[""] * STATES for _ in range(STATES)]
    for first in range(STATES):
        for last in range(STATES):
            if best[first, last] < _FAR:
                taken, state = [], last
                for choice in reversed(back):
                    state, action = choice[first, state]
                    taken.append(action)
                actions[first][last] = ",".join(reversed(taken))
    return best, actions


def through(tables: list[np.ndarray], costs: Costs) -> tuple[int, list[tuple[int, int]], str]:
    """The cheapest way through the stretches: cost, states at the ends of each, and turns inserted at the end."""
    best, back = [0, _FAR, _FAR, _FAR], []
    for table in tables:
        ways = [[(best[a] + int(table[a, b]), a) for a in range(STATES)] for b in range(STATES)]
        back.append([min(w)[1] for w in ways])
        best = [min(w)[0] for w in ways]
    ends = [(best[s], s, "") for s in FINAL] + [(best[SYSTEM] + costs.insert, SYSTEM, "u")]
    cost, state, added = min(ends)
    path = []
    for choice in reversed(back):
        path.append((choice[state], state))
        state = choice[state]
    return cost, path[::-1], added


def repaired(conversations: DataFrame, costs: Costs = Costs(), longest: int = 1000) -> DataFrame:
    """One row per turn: conv_id, turn, role_in, action, role_out, and rendered, the text that stands for it.

    ``rendered`` of a conversation's rows, in the order of ``position``, is the conversation as a template shows it.
    """
    spark = conversations.sparkSession
    prepare(spark)
    id_type, turn_type = (dict(conversations.dtypes)[c] for c in ("conv_id", "turn"))
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    # Ranges by (conversation, turn): a long conversation spans as many tasks as its share asks for.
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = {name: k for k, name in enumerate(ROLES, 1)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, current, piece, at = TaskContext.get().partitionId(), object(), 0, 0
        for batch in batches:
            rows = []
            for conversation in batch.column("conv_id").to_pylist():
                if conversation != current or at == longest:
                    piece, at, current = piece + 1, 0, conversation
                rows.append((task, piece, at))
                at += 1
            added = [pa.array([r[k] for r in rows], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "task", "piece", "place"])

    schema = f"conv_id {id_type}, turn {turn_type}, role string, text string, task int, piece int, place int"
    placed = stage(dealt.mapInArrow(numbered, schema), "turns")

    def tables(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        best, actions = stretch([numbers.get(r, 0) for r in part["role"]], costs)
        row = part.iloc[0][["conv_id", "task", "piece"]].to_dict()
        return pd.DataFrame([row | {"costs": best.ravel().tolist(), "actions": sum(actions, [])}])

    # Dealt by number: the rows are few bytes and much work, and adaptive execution would put them into one task.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    stretches = stage(
        placed.select("conv_id", "task", "piece", "place", "role")
        .repartition(n, "task", "piece")
        .groupBy("task", "piece")
        .applyInPandas(tables, f"conv_id {id_type}, task int, piece int, costs array<long>, actions array<string>"),
        "stretches",
    )

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["task", "piece"])
        costs_of = [np.array(c).reshape(STATES, STATES) for c in part["costs"]]
        cost, path, added = through(costs_of, costs)
        ways = pd.DataFrame(path, columns=["before", "after"], index=part.index)
        ways = part[["task", "piece"]].join(ways).assign(added="", final=False, cost=cost)
        ways.iloc[-1, ways.columns.get_indexer(["added", "final"])] = [added, True]
        return ways

    # A row per stretch without its choices: a conversation of a million turns has a thousand of them.
    ways = (
        stretches.select("conv_id", "task", "piece", "costs")
        .repartition(n, "conv_id")
        .groupBy("conv_id")
        .applyInPandas(choose, "task int, piece int, before int, after int, added string, final boolean, cost long")
    )
    way = F.col("before") * STATES + F.col("after")
    taken = stretches.join(ways, ["task", "piece"]).select(
        "task", "piece", "before", "added", "final", "cost", F.split(F.get("actions", way), ",").alias("chosen")
    )
    return _rendered(placed.join(taken, ["task", "piece"]))


def _rendered(rows: DataFrame) -> DataFrame:
    """Actions, roles and text of each turn, from its place in its stretch and the stretch's actions."""
    action = F.get("chosen", F.col("place"))
    last = F.col("place") == F.size("chosen") - 1
    # A merged turn has the role of the last turn before it that is none; in an earlier stretch, that is its state.
    own = F.filter(F.slice("chosen", 1, F.col("place") + 1), lambda a: a != "m")
    state = F.substring(F.lit("?sua"), F.col("before") + 1, F.lit(1))
    names = F.create_map(*(F.lit(x) for r in ROLES for x in (r[0], r)))
    role_out = names[F.coalesce(F.right(F.try_element_at(own, F.lit(-1)), F.lit(1)), state)]
    head = lambda role: F.concat(F.lit("<|"), role, F.lit("|>\n"))
    close = F.lit("<|end|>\n")
    opening = (F.col("place") == 0) & (F.col("before") == START)
    inserted = F.when(F.length(action) > 1, F.concat(head(names[F.left(action, F.lit(1))]), close))
    opened = F.concat(F.when(opening, "").otherwise(close), F.coalesce(inserted, F.lit("")), head(role_out), "text")
    body = F.when(action == "m", F.concat(F.lit("\n"), "text")).otherwise(opened)
    added = F.when(F.col("added") != "", F.concat(close, head(names[F.col("added")]))).otherwise("")
    ending = F.when(last & F.col("final"), F.concat(added, close)).otherwise("")
    return rows.select(
        "conv_id",
        "turn",
        F.col("role").alias("role_in"),
        action.alias("action"),
        role_out.alias("role_out"),
        F.concat(body, ending).alias("rendered"),
        "cost",
        F.struct("task", "piece", "place").alias("position"),
    )
