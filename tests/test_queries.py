"""A part of the registered queries against their SQL in DuckDB, on the smallest test tables."""

import os

import pytest

from loomgraph import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "gr3_entry_reach", "gr10_top_level_await", "gr12_side_effects", "gr24_update_superset", "gr30_graph_delta", "jn3_binding", "jn8_client_needs", "jn10_as_of", "ag2_manual_groups", "ag12_hook_costs", "ag13_busy_time", "wn2_premature", "wn5_lag_similarity", "wn11_minified_names",
    "se4_demand", "st1_debounce", "st1_debounce_streaming", "st2_fold_changes", "st14_incremental_importers", "flt1_include_exclude", "flt4_filter_tree", "flt7_query_values", "sf8_data_url", "tx1_replace", "tx13_line_offsets", "ud2_fold", "snk1_write_outputs", "src8_resolution",
]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_llm_is_optional():
    """The library doesn't import that subpackage."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "loomgraph")
    for at, _, names in os.walk(root):
        if "llm" not in at.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    assert "loomgraph.llm" not in open(os.path.join(at, n)).read(), n
