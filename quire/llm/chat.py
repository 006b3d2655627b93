"""Chat formatting with minimum-cost role repair.

A legal conversation is, at most, one system message and then user and assistant messages in turn, user first,
ending with either. A dynamic program over that automaton reads the turns in order and chooses for each to keep
its role, to relabel it, or to merge it into the message before it; where that leaves a gap, an empty message of
the missing role goes in. The cheapest choice wins, of equally cheap ones the first in a fixed order.

Turns are range-partitioned by (conv_id, turn) and cut into parts of at most PART rows and PART_CHARS characters, so that a
conversation of any length is spread over tasks. A conversation inside one part is repaired there. Of those at a part's ends, two a part, each
part gives a table of least costs from any state before its turns to any after them. Those tables are chained by
conversation, one row for PART turns, which gives each part the states to start and end with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, stage, table

#: What was said last: nothing, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
RELABEL, MERGE, MERGE_RELABEL, INSERT = 4.0, 1.0, 5.0, 2.0
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
PART = 20_000
PART_CHARS = 1 << 24
#: Characters of a text that turns of equal number and role go by.
PREFIX = 64


def _inserted(state: int, role: int) -> int | None:
    """The role of the empty message that `role` needs after `state`, 0 if none; None where it can't follow."""
    if role == SYSTEM:
        return 0 if state == START else None
    if role == USER:
        return ASSISTANT if state == USER else 0
    return 0 if state == USER else USER


#: For each given role (0: none of the three, so that any label is a guess and costs nothing) the choices: (from, to, cost, action, empty role before).
CHOICES: dict[int, list[tuple[int, int, float, str, int]]] = {}
for given in range(4):
    CHOICES[given] = []
    for state in range(4):
        for role in (SYSTEM, USER, ASSISTANT):
            label = 0.0 if given in (0, role) else RELABEL
            gap = _inserted(state, role)
            if gap is not None:
                CHOICES[given].append((state, role, label + (INSERT if gap else 0), "keep" if given == role else "relabel", gap))
            if state == role:
                CHOICES[given].append((state, role, MERGE if given in (0, role) else MERGE_RELABEL, "merge", 0))
COSTS = np.full((4, 4, 4), np.inf)
for given, choices in CHOICES.items():
    for state, role, cost, _, _ in choices:
        COSTS[given, state, role] = min(COSTS[given, state, role], cost)
BEST = {(g, s, r): min((c for c in CHOICES[g] if c[:2] == (s, r)), key=lambda c: c[2]) for g in range(4) for s in range(4) for r in range(4) if np.isfinite(COSTS[g, s, r])}


def role_number(role: str | None) -> int:
    r = (role or "").strip().lower()
    return ROLES.index(r) if r in ROLES else 0


def least_costs(roles: np.ndarray) -> np.ndarray:
    """Costs from each state before the turns to each after them."""
    total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for r in roles:
        total = (total[:, :, None] + COSTS[r][None]).min(axis=1)
    return total


def resolve(roles: np.ndarray, first: int, last: int) -> list[tuple[int, str, int]]:
    """Role, action and empty role before, for each turn, on a cheapest way from state first to state last."""
    cost = np.full((len(roles) + 1, 4), np.inf)
    cost[0, first] = 0
    back = np.zeros((len(roles), 4), np.int8)
    for k, r in enumerate(roles):
        step = cost[k][:, None] + COSTS[r]
        back[k] = step.argmin(axis=0)
        cost[k + 1] = step.min(axis=0)
    out, state = [], last
    for k in range(len(roles) - 1, -1, -1):
        before = int(back[k, state])
        choice = BEST[int(roles[k]), before, state]
        out.append((state, choice[3], choice[4]))
        state = before
    return out[::-1]


def chained(costs: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last state of each part of a conversation, given in order, on a cheapest way through all."""
    forward = [np.array([0.0, np.inf, np.inf, np.inf])]
    for c in costs:
        forward.append((forward[-1][:, None] + c).min(axis=0))
    state = int(forward[-1].argmin())
    out = []
    for c, before in zip(reversed(costs), reversed(forward[:-1]), strict=True):
        first = int((before + c[:, state]).argmin())
        out.append((first, state))
        state = first
    return out[::-1]


def _segments(conv: pd.Series) -> list[tuple[int, int]]:
    key = conv.to_numpy()
    cut = np.concatenate([[0], 1 + np.flatnonzero(key[1:] != key[:-1]), [len(key)]])
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def _edges(group: pd.DataFrame) -> pd.DataFrame:
    """Costs of the first and of the last conversation of a part."""
    group = group.sort_values("position")
    segments = _segments(group["conv"])
    rows = []
    for a, b in dict.fromkeys((segments[0], segments[-1])):
        roles = [role_number(r) for r in group["role"].iloc[a:b]]
        rows.append((group["conv"].iloc[a], group["part"].iloc[0], least_costs(np.array(roles)).ravel().tolist()))
    return pd.DataFrame(rows, columns=["conv", "part", "costs"])


def _ends(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    states = chained([np.array(c, np.float64).reshape(4, 4) for c in group["costs"]])
    last = group["part"].iloc[-1]
    return pd.DataFrame({"part": group["part"], "conv": group["conv"], "first": [a for a, _ in states], "last": [b for _, b in states], "final": group["part"] == last})


def _settled(group: pd.DataFrame) -> pd.DataFrame:
    """A part's turns with what is done to each."""
    group = group.sort_values("position")
    known = {e["conv"]: e for e in group["ends"].iloc[0]}
    rendered, actions, roles, inserted = [], [], [], []
    texts = group["text"].tolist()
    for a, b in _segments(group["conv"]):
        given = np.array([role_number(r) for r in group["role"].iloc[a:b]])
        end = known.get(group["conv"].iloc[a])
        state, last, final = (end["first"], end["last"], end["final"]) if end is not None else (START, *chained([least_costs(given)])[0][1:], True)
        way = resolve(given, state, last)
        for k, (role, action, gap) in enumerate(way):
            piece = texts[a + k] or ""
            if action == "merge":
                piece = "\n" + piece
            else:
                piece = (CLOSE if state != START else "") + (OPEN.format(ROLES[gap]) + CLOSE if gap else "") + OPEN.format(ROLES[role]) + piece
            if final and a + k + 1 == b:
                piece += CLOSE
            rendered.append(piece), actions.append(action), roles.append(ROLES[role]), inserted.append(ROLES[gap] if gap else None)
            state = role
    return group[["conv_id", "turn", "position", "role", "text"]].assign(action=actions, new_role=roles, inserted=inserted, rendered=rendered)


def _cut(rows: DataFrame, part: int) -> DataFrame:
    """rows with their part cut anew where it has more than `part` rows or PART_CHARS characters; only a text beyond that alone makes a
    longer one. A running sum over lengths tells the first positions, a few for each part, and texts are not moved for it."""
    before = Window.partitionBy("part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    chars, count = (F.coalesce(c.over(before), F.lit(0)) for c in (F.sum("size"), F.count("*")))
    sums = rows.select("part", "position", F.coalesce(F.length("text"), F.lit(0)).alias("size")).select("part", "position", (F.floor(chars / PART_CHARS) + F.floor(count / part)).alias("sub"))
    firsts = sums.groupBy("part", "sub").agg(F.min("position").alias("at")).groupBy("part").agg(F.array_sort(F.collect_list("at")).alias("firsts"))
    sub = F.size(F.filter("firsts", lambda at: at <= F.col("position"))).cast("long")
    return rows.join(firsts, "part").withColumn("part", F.shiftleft(F.col("part").cast("long"), 32) + sub).drop("firsts")


def repaired(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, turn, position, role, text, and action (keep, relabel, merge), new_role, inserted (the role of an empty
    message put before, or null) and rendered: the turn's piece of the formatted conversation, which is the pieces of
    a conv_id joined in the order of position.

    Turns go by turn, then role, then the first PREFIX characters of the text, nulls first, then its hash; rows that are equal all
    count. Rows of null conv_id form a conversation of their own; a null or strange role may become any; a null text is empty. Texts
    of any length stay whole; parts have at most `part` rows, and PART_CHARS characters before their last text. An empty table gives no
    rows; other columns are not looked at.
    """
    spark = turns.sparkSession
    ship(spark)
    given = turns.select("conv_id", "turn", "role", "text", F.concat(F.when(F.col("conv_id").isNull(), "").otherwise("="), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("conv"))
    keys = ["conv", "turn", "role", F.substring("text", 1, PREFIX), F.xxhash64("text"), "_tie"]
    size = given.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["rows"] // part), -(-size["chars"] // PART_CHARS))
    dealt = given.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    # written, so that parts and positions stay what they are
    rows = _cut(stage(dealt.withColumn("part", F.spark_partition_id()).withColumn("position", F.monotonically_increasing_id()), "turns"), part)
    edges = rows.select("part", "position", "conv", "role").groupBy("part").applyInPandas(_edges, "conv string, part long, costs array<double>")
    ends = edges.groupBy("conv").applyInPandas(_ends, "part long, conv string, first int, last int, final boolean")
    ends = ends.groupBy("part").agg(F.collect_list(F.struct("conv", "first", "last", "final")).alias("ends"))
    fields = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    kind = f"conv_id {fields['conv_id']}, turn {fields['turn']}, position long, role string, text string, action string, new_role string, inserted string, rendered string"
    return rows.join(ends, "part").groupBy("part").applyInPandas(_settled, kind)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations")).drop("text")
