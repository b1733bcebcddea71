"""Repaired splits against visits one by one."""

import random

import pytest

from tierwise.operators import splits as SP

KIND = "task string, sample long, split string, model_order int, failed boolean"


def plain(rows, passes=3):
    """The rule of repair_train, an id at a time."""
    out = {}
    for task in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == task]
        split = {r[1]: r[2] for r in mine}
        for _ in range(passes):
            moved = False
            for model in sorted({r[3] for r in mine}):
                has = {r[1]: bool(r[4]) for r in mine if r[3] == model}
                train = sorted(i for i in has if split[i] == "train")
                rest = sorted(i for i in has if split[i] != "train" and train and has[i] != has[train[0]])
                if len({has[i] for i in train}) == 1 and rest:
                    split[rest[0]], split[train[-1]], moved = "train", "val", True
            if not moved:
                break
        out |= {(task, i): s for i, s in split.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair_equals_visits_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for task in ("a", "b", None, "one"):
        for i in range(12):
            split = rng.choice(["train", "train", "val", "test"])
            rows += [(task, i, split, m, rng.choice([True, False, False, False, None]) if task != "one" else False) for m in range(4) if rng.random() < 0.9]
    got = SP.repair_train(spark.createDataFrame(rows, KIND).repartition(3)).collect()
    assert {(r.task, r.sample): r.split for r in got} == plain(rows) and len(got) == len(plain(rows))


def test_repair_of_nothing_and_of_repeated_rows(spark):
    assert SP.repair_train(spark.createDataFrame([], KIND)).collect() == []
    rows = [("t", i, "train" if i < 3 else "test", 0, i == 4) for i in range(6)]
    once, twice = ({(r.sample, r.split) for r in SP.repair_train(spark.createDataFrame(x, KIND)).collect()} for x in (rows, rows * 2))
    assert once == twice == {(0, "train"), (1, "train"), (2, "val"), (3, "test"), (4, "train"), (5, "test")}
