import random
import re

import numpy as np
import pytest

from loomgraph.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, h int"


def test_targets():
    assert M.targets({}) == {}
    t = M.targets({"b": 100, "a": 100, None: 100})
    assert t == {"a": 187.5, "b": 75.0, None: 37.5}
    t = M.targets({"a": 10, "b": 500, "c": 500})
    assert t["a"] == 30 and abs(sum(t.values()) - 1010) < 1e-6 and abs(t["b"] / t["c"] - 2) < 1e-9


@pytest.mark.parametrize("seed", range(20))
def test_choose_is_exact_when_it_can_be(seed):
    r = random.Random(seed)
    sizes = np.array(sorted(r.sample(range(1, 60), r.randint(1, 6))))
    counts = np.array([r.randint(1, 4) for _ in sizes])
    budget = r.randint(0, int((sizes * counts).sum()))
    reach = {0}
    for s, c in zip(sizes, counts, strict=True):
        reach = {x + k * int(s) for x in reach for k in range(c + 1)}
    taken = M.choose(sizes, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    assert (taken * sizes).sum() == max(x for x in reach if x <= budget)


def test_choose_large():
    r = np.random.default_rng(1)
    sizes, counts = np.arange(1, 5000), r.integers(0, 50, 4999)
    total = int((sizes * counts).sum())
    for budget in (total // 3, total - 7, 123_456):
        taken = M.choose(sizes, counts, budget)
        assert (taken <= counts).all() and (taken * sizes).sum() == budget


def test_plan_and_mix(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), r.choice(["a", "b", "c", "d", None, ""]), "s", 1) for i in range(600)]
    rows += [(None, "x y z", "a", "s", 1), (7, None, "b", "s", 1), (8, "same same", "c", "s", 1), (8, "same same", "c", "s", 1), (9, "very " * 5000, "d", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.plan(df).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(M.SIZE, t or ""))
    per = {}
    for _, t, s, *_ in rows:
        per[s] = per.get(s, 0) + words(t)
    want = M.targets(per)
    for s in per:
        own = [g for g in got if g.source == s]
        assert {g.source_size for g in own} == {per[s]} and all(0 <= g.copies <= 3 for g in own)
        assert all(abs(g.target - want[s]) < 1e-6 for g in own)
        longest = max(g.size for g in own)
        assert abs(sum(g.copies * g.size for g in own) - want[s]) <= (2 if longest < 1000 else longest)
    assert sorted(map(str, got)) == sorted(map(str, M.plan(df).collect()))
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    assert sum(words(x.text) for x in mixed.collect()) == sum(g.copies * g.size for g in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert M.plan(empty).count() == 0 and M.mix(empty).count() == 0
