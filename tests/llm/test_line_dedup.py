import hashlib

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm.line_dedup import CuckooFilter, LineIndex, line_dedup

SCHEMA = "doc_id long, text string, key string, doc string, pos int"
WS = " \t\n\x0b\x0c\r"


def brute(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(WS))
    num = lambda d: -1 if d is None else d
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(num(d))
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (len(held.get(key(x), ())) > 1 and min(held[key(x)]) != num(d))]
        out.append((d, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (1, "A shared line here\nown line number one\n\nshort"),
    (2, "  a SHARED line HERE \t\nshort\nÄ shared line here"),
    (3, "ä shared line here\nÄ shared line here\nÄ shared line here\n"),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (7, "own line number one\x0b\nlong " + "x" * 100_000),
    (8, "long " + "x" * 100_000),
    (None, "own line number one"),
    (9, "twice in one\ntwice in one document\ntwice in one document"),
    (10, "ties ties ties"),
    (10, "ties ties ties"),
]


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "k", "d", 1) for d, t in rows], SCHEMA)


def test_against_brute_force(spark):
    assert result(line_dedup(frame(spark, ROWS))) == brute(ROWS)
    assert result(line_dedup(frame(spark, []))) == []


def test_insert_and_delete_are_reversible(spark):
    a, b = ROWS[:6], ROWS[6:]
    one = LineIndex(spark, 3).insert(frame(spark, a))
    both = one.insert(frame(spark, b))
    assert result(both.apply(frame(spark, ROWS))) == brute(ROWS)
    back = both.delete(frame(spark, b).select("doc_id"))
    state = lambda ix: sorted((bytes(r.key), r.refs, r.owner) for r in ix.refs.collect())
    assert state(back) == state(one)
    assert result(back.apply(frame(spark, a))) == brute(a)
    # Without its smallest holder, a line belongs to the next one.
    rest = [r for r in ROWS if r[0] != 1]
    assert result(both.delete(spark.createDataFrame([(1,)], "doc_id long")).apply(frame(spark, rest))) == brute(rest)


def test_untouched_shards_stay(spark):
    """A version shares the files of the shards that aren't touched, and a filter of which no key changed."""
    import os

    rows = [(i, f"line of document {i}\nshared by pairs {i // 2}") for i in range(60)]
    one = LineIndex(spark, 16).insert(frame(spark, rows))
    assert set(one.filters) <= set(one.where) and len(one.where) > 10
    two = one.insert(frame(spark, [(900, "a line that nobody else has")]))
    moved = {k for k in two.where if two.where[k] != one.where.get(k)}
    assert len(moved) == 1 and two.filters == one.filters
    three = two.delete(spark.createDataFrame([(900,)], "doc_id long"))
    assert {k for k in three.where if three.where[k] != two.where[k]} <= moved and three.filters == one.filters
    four = three.delete(spark.createDataFrame([(0,), (2,)], "doc_id long"))
    changed = {k for k in three.where if four.where.get(k) != three.where[k]}
    assert 1 <= len(changed) <= 4
    assert all(four.filters[k] == three.filters[k] for k in three.filters if k not in changed) and any(four.filters.get(k) != three.filters[k] for k in changed & set(three.filters))
    assert all(os.path.exists(f) for f in four.filters.values())
    rest = [r for r in rows if r[0] not in (0, 2)]
    assert result(four.apply(frame(spark, rest))) == brute(rest)


def test_hot_line_and_clashes(spark):
    import pytest

    from loomgraph.llm.line_dedup import keyed

    rows = [(i, f"one line that all hold\nown line of {i}") for i in range(40)]
    df = frame(spark, rows)
    index = LineIndex(spark).insert(df)
    assert result(index.apply(df, index.drops_keyed(keyed(df), spread=3))) == brute(rows)
    for name in ("n_lines", "n_dropped", "kept_text"):
        with pytest.raises(ValueError):
            line_dedup(df.withColumn(name, F.lit(1)))


def test_cuckoo_filter(tmp_path):
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**63), 2**63 - 1, 20_000)
    f = CuckooFilter(len(h))
    f.insert(h)
    assert f.contains(h).all()
    assert f.contains(rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.01
    f.delete(h[:10_000])
    assert f.contains(h[10_000:]).all() and f.contains(h[:10_000]).mean() < 0.01
    f.save(str(tmp_path / "f"))
    assert CuckooFilter.read(str(tmp_path / "f")).contains(h[10_000:]).all()
