"""Queries over all rows of their tables, against their SQL."""

import os

import pytest

from loomgraph import registry

SF = "/root/testdata/sf0.001"
TABLES = "part lineitem documents".split()
WHOLE = ["gr9_merge_makes_cycle", "gr5_is_reachable", "gr13_wrap", "gr2_cycle_members", "gr6_strong_components", "gr32_synchronous_cycles", "sf11_format_size", "tx2_update_range", "tx3_append_prepend", "tx4_remove_relocate", "tx5_slice_reset", "tx10_dictionary"]


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", WHOLE)
def test_query_takes_all_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql = registry.oracle_sql()[name]
    df = registry.queries()[name](spark, SF)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    rows = df.select(*rel.columns).collect()
    assert sorted((plain(r) for r in rows), key=repr) == sorted((plain(r) for r in rel.fetchall()), key=repr)


def test_format_size_halves(spark):
    from loomgraph.functions import text as X

    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 kB", 1280: "1.2 kB", 1281: "1.3 kB", 1792: "1.8 kB", 1048575: "1024.0 kB", 1048576: "1.0 MB", 1310720: "1.2 MB", 1835008: "1.8 MB", 10**13: "9536743.2 MB"}
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert {r.n: r.s for r in df.select("n", X.format_size(df.n).alias("s")).collect()} == sizes
    assert all(s == (f"{n} B" if n < 1024 else f"{n / 1024:.1f} kB" if n < 1048576 else f"{n / 1048576:.1f} MB") for n, s in sizes.items())


def test_edits_beyond_the_end(spark, tmp_path):
    """Edits are clipped to the text; those of a null text are null."""
    texts = [None, "", "abc", "abcdefgh", "abcdefghijklmno", "abcdefghijklmnopqrstuvw"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {
        "tx2_update_range": lambda t: ("<" + t[3:10] + "two" + t[20:],),
        "tx3_append_prepend": lambda t: ("intro" + t[:5] + "LR" + t[5:] + "outro",),
        "tx4_remove_relocate": lambda t: (t[:5] + t[10:], t[5:10] + t[:5] + t[10:], t[5:10]),
        "tx5_slice_reset": lambda t: (t[8:25], t[-4:]),
    }
    for name, f in want.items():
        got = {r[0]: tuple(r[1:]) for r in registry.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {i: f(t) if t is not None else (None,) * len(f("")) for i, t in enumerate(texts)}, name


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_pairs_of_entries_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = registry.queries()["gr5_is_reachable"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan.split("BroadcastNestedLoopJoin")[0]
    assert above != plan and "Exchange" not in above


def test_reachable_pairs_of_many_entries(spark):
    """More entries than a word has bits, one module entered twice, a cycle."""
    from loomgraph.operators.graph import reachable_pairs

    at = [*range(150), 3]
    edges = [(i, i + 1) for i in range(60, 140)] + [(140, 60), (3, 200), (200, 149), (149, 149)]
    entries = spark.createDataFrame(list(enumerate(at)), "entry_idx int, module_idx long")
    got = sorted(tuple(r) for r in reachable_pairs(entries, spark.createDataFrame(edges, "src long, dst long")).collect())
    cycle = range(60, 141)
    assert got == sorted((a, b, (a in cycle and b in cycle) or (a in (3, 149) and b == 149)) for a in at for b in at)
