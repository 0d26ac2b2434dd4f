import random

import numpy as np
import pytest

from loomgraph.llm import near_dup as N
from loomgraph.llm.common import NULL_ID

SCHEMA = "doc_id long, text string, sid string, doc int"


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Partition of the distinct (doc_id, text) by mutual containment."""
    docs = sorted({(NULL_ID if d is None else d, t or "") for d, t in rows})
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * max(len(sets[i]), len(sets[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {docs[i]: docs[find(i)] for i in range(len(docs))}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = []
    for g in range(14):
        base = [word() for _ in range(r.choice([3, 6, 12, 60, 300]))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.2:
                w += [word() for _ in range(len(w) // 10)]
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rows += [(2000 + i, t) for i, (_, t) in enumerate(rows[:5])]
    rows += [(3, None), (6, ""), (9, " \n"), (None, rows[0][1]), (rows[1][0], rows[1][1]), (rows[1][0], "another text of the same id"), (12, "One"), (15, "one"), (18, "one two three four five six " * 9000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "e", 1) for d, t in rows], SCHEMA)
    got = N.classes(df).collect()
    want = brute(rows)
    assert len(got) == len(want)
    text = {}
    from pyspark.sql import functions as F

    from loomgraph.llm.common import text_hash

    for r in df.select("text", text_hash().alias("th")).distinct().collect():
        text.setdefault(r.th, r.text or "")
    found = {(g.doc, text[g.th]): (g.class_doc, text[g.class_th]) for g in got}
    wrong = [k for k in want if found[k] != want[k]]
    assert not wrong, [(k, found[k], want[k]) for k in wrong][:3]
    kept = N.dedup(df)
    assert kept.columns == df.columns
    left = sorted(((NULL_ID if r.doc_id is None else r.doc_id), r.text or "") for r in kept.collect())
    assert left == sorted(set(want.values()))
    assert F


def brute_containers(rows, queries):
    docs = sorted({(NULL_ID if d is None else d, t or "") for d, t in rows})
    sets = {k: shingles(k[1]) for k in docs}
    return {(q, x) for q in docs if q[0] in queries and sets[q] for x in docs if x != q and len(sets[x]) >= len(sets[q]) and len(sets[q] & sets[x]) >= 0.8 * len(sets[q])}


@pytest.mark.parametrize(("seed", "members"), [(3, N.MEMBERS), (4, 2)])
def test_containers_against_brute_force(spark, seed, members):
    r = random.Random(seed)
    rows = corpus(seed)
    long = " ".join(f"v{i}" for i in range(3000))
    rows += [(5000, long), (5001, " ".join(long.split()[100:160])), (5002, " ".join(long.split()[200:210] + ["x"] + long.split()[210:290])), (5003, "a shared licence line of eight words here")]
    rows += [(6000 + i, f"t{i} " * 9 + "a shared licence line of eight words here " + " ".join(f"s{i}x{r.random()}" for _ in range(40))) for i in range(30)]
    df = spark.createDataFrame([(d, t, "e", 1) for d, t in rows], SCHEMA)
    from pyspark.sql import functions as F

    from loomgraph.llm.common import order_id, text_hash

    keyed = df.select(order_id().alias("doc"), text_hash().alias("th"), F.coalesce("text", F.lit("")).alias("t"))
    text = {r.th: r.t for r in keyed.collect()}
    ids = {r.doc for r in keyed.collect() if r.doc % 3 == 1 or r.doc in (5001, 5002, 5003)}
    queries = keyed.where(F.col("doc").isin(*ids)).select("doc", "th")
    got = N.containers(df, queries, members=members).collect()
    want = brute_containers(rows, ids)
    assert {((g.q, text[g.qth]), (g.doc, text[g.th])) for g in got} == want and len(got) == len(want)
    assert {(5001, 5000), (5002, 5000), (5003, 6007)} <= {(g.q, g.doc) for g in got}
    some = N.containers(df, queries, keyed.where("doc < 6010").select("doc", "th"), members=members)
    assert {(g.q, g.doc) for g in some.collect()} == {(q[0], x[0]) for q, x in want if x[0] < 6010}
    assert N.containers(df, queries.limit(0)).count() == 0


def test_containers_of_classes(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (20, " ".join(base[60:120])), (21, " ".join(base[60:121])), (40, None), (60, "nothing like it at all in here")]
    df = spark.createDataFrame([(d, t, "e", 1) for d, t in rows], SCHEMA)
    got = {g.doc: (g.class_doc, g.n_containers, g.container_doc) for g in N.with_containers(df, N.classes(df)).collect()}
    assert got == {1: (1, None, None), 2: (1, None, None), 20: (20, 1, 1), 21: (20, 1, 1), 40: (40, 0, None), 60: (60, 0, None)}


def test_mixed_buckets_and_hot_pivots(spark, monkeypatch):
    """Documents that share half of their text meet in buckets without being near; a pivot with many members is dealt out."""
    monkeypatch.setattr(N, "MEMBERS", 3)
    r = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(40):
        w = common + [f"g{g}x{i}" for i in range(40)]
        for _ in range(r.randint(1, 4)):
            v = list(w)
            v[r.randrange(60, 100)] = f"r{r.random()}"
            rows.append((len(rows), " ".join(v)))
    got = {g.doc: g.class_doc for g in N.classes(spark.createDataFrame([(d, t, "e", 1) for d, t in rows], SCHEMA)).collect()}
    assert got == {k[0]: v[0] for k, v in brute(rows).items()}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.classes(df).count() == 0 and N.dedup(df).count() == 0


def test_partitions_and_bandings():
    n = np.arange(1, 3000)
    p = N.partition_of(n)
    for a in (1, 4, 5, 17, 99, 1234):
        near = n[(n >= a) & (a >= 0.8 * n)]
        assert set(p[near - 1] - p[a - 1]) <= {0, 1}
    for q in range(0, 40):
        s = N.least_jaccard(q)
        r, b = N.banding(q)
        assert s == 1 and b == 0 or 1 - (1 - s**r) ** b >= N.RECALL and r * b <= N.HASHES


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(bytes([a >> 8, a & 255]), bytes([b >> 8, b & 255])) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(x.v, "big"): int.from_bytes(x.label, "big") for x in N.components(df).collect()}
    assert got == {v: find(v) for v in got} and len(got) == len(root)
