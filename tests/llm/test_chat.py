import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string, part string"
CODE = {r: k for k, r in enumerate(C.ROLES)}


def cheapest(roles):
    """The least cost over every choice for every turn."""
    best = float("inf")
    for way in itertools.product((1, 2, 3), (False, True), repeat=len(roles)):
        state, cost = C.START, 0.0
        for given, role, merge in zip(roles, way[::2], way[1::2], strict=True):
            label = 0 if given in (0, role) else C.RELABEL
            if merge:
                cost += (C.MERGE_RELABEL if label else C.MERGE) if state == role else float("inf")
            else:
                gap = C._inserted(state, role)
                cost += float("inf") if gap is None else label + (C.INSERT if gap else 0)
            state = role
        best = min(best, cost)
    return best


def check(rows, rendered=True):
    """Legal after repair, every text in it once, and the cost paid."""
    cost, state, out = 0.0, C.START, ""
    for r in rows:
        given, role = C.role_number(r.role), CODE[r.new_role]
        if r.action == "merge":
            assert state == role
            cost += C.MERGE if given in (0, role) else C.MERGE_RELABEL
        else:
            gap = C._inserted(state, role)
            assert gap is not None and (r.inserted or "") == C.ROLES[gap]
            cost += (C.INSERT if gap else 0) + (0 if given in (0, role) else C.RELABEL)
        state = role
        out += r.rendered
    messages = [m.split("\n", 1) for m in out.split(C.CLOSE)]
    assert messages.pop() == [""]
    said = [m[0].removeprefix("<|").removesuffix("|>") for m in messages]
    assert "system" not in said[1:]
    said = said[said[:1] == ["system"] :]
    assert said == ["user", "assistant"] * (len(said) // 2) + ["user"] * (len(said) % 2)
    return cost


@pytest.mark.parametrize("part", [20_000, 3])
def test_cheapest_and_legal(spark, part):
    rng = random.Random(8)
    rows = []
    for conv in range(40):
        rows += [(conv, t, rng.choice(["user", "assistant", "system", "User ", "tool", None]), f"m{conv}.{t}", "p") for t in range(rng.randrange(1, 6))]
    rows += [(None, None, "assistant", None, "p"), (None, 1, "user", "", "p"), (900, 1, "user", "same", "p"), (900, 1, "user", "same", "p")]
    rng.shuffle(rows)
    by = defaultdict(list)
    for r in C.repaired(spark.createDataFrame(rows, TURNS), part=part).orderBy("position").collect():
        by[r.conv_id].append(r)
    assert sum(map(len, by.values())) == len(rows)
    for conv, got in by.items():
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x) for x in r[1:4]))
        assert [(r.turn, r.role, r.text) for r in got] == [r[1:4] for r in own]
        assert check(got) == cheapest([C.role_number(r[2]) for r in own])


def test_one_conversation_over_many_parts(spark):
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant"]), "x", "p") for t in range(400)]
    got = C.repaired(spark.createDataFrame(rows, TURNS).repartition(4), part=20).orderBy("position").collect()
    roles = np.array([C.role_number(r[2]) for r in rows])
    assert check(got) == C.least_costs(roles)[C.START].min()
    assert C.repaired(spark.createDataFrame([], TURNS)).count() == 0


def test_long_texts_are_cut_into_parts(spark, monkeypatch):
    """Long texts side by side in few rows: no part has more characters than the bound before its last text."""
    monkeypatch.setattr(C, "PART_CHARS", 5000)
    rng = random.Random(10)
    long = [(7, t, rng.choice(["user", "assistant"]), f"{t} " + "y" * rng.choice([10, 900, 20_000]), "p") for t in range(60)]
    rows = [(c, 0, "user", "short", "p") for c in range(40)] + long
    df = spark.createDataFrame(rows, TURNS)
    placed = C.stage(df.select("*", F.lit(0).alias("part_"), F.monotonically_increasing_id().alias("position")).drop("part").withColumnRenamed("part_", "part"), "placed")
    parts = defaultdict(list)
    for r in C._cut(placed, 25).orderBy("position").collect():
        parts[r.part].append(len(r.text))
    assert len(parts) > 15 and all(sum(p[:-1]) < 5000 and len(p) <= 25 for p in parts.values()) and list(parts) == sorted(parts)
    got = C.repaired(df, part=25).where("conv_id = 7").orderBy("position").collect()
    assert [r.turn for r in got] == sorted([0, *range(60)])
    states = np.array([C.role_number(r.role) for r in got])
    assert check(got) == C.least_costs(states)[C.START].min()
    assert "".join(r.rendered for r in got).count("y") == sum(r[3].count("y") for r in long)


def test_query_has_every_turn(spark, tmp_path):
    """The registered query against the whole table: each row once, and each conversation at its least cost."""
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "bot"]), rng.choice([None, "", "a" * 70 + str(t), "a" * 70 + "x"]), "p") for c in range(30) for t in range(rng.randrange(1, 7))]
    rows += rows[:5]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    by = defaultdict(list)
    for r in C.op2_chat_formatting(spark, str(tmp_path)).orderBy("position").collect():
        by[r.conv_id].append(r)
    for conv in range(30):
        own = [r for r in rows if r[0] == conv]
        assert sorted((r.turn, r.role or "") for r in by[conv]) == sorted((r[1], r[2] or "") for r in own)
        assert check(by[conv]) == C.least_costs(np.array([C.role_number(r.role) for r in by[conv]]))[C.START].min()
        assert sum(r.rendered.count("a" * 70) for r in by[conv]) == sum((r[3] or "").startswith("a") for r in own)
