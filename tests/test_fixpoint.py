from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgraph.operators.fixpoint import closure, components, peel, roots, strict_closure

graphs = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=18)
few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def reachable(edges):
    out = set(edges)
    while True:
        new = out | {(a, d) for a, b in out for c, d in edges if b == c}
        if new == out:
            return out
        out = new


@few
@given(graphs)
def test_closures_and_components(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    want = reachable(edges)
    assert {tuple(r) for r in strict_closure(df).collect()} == want
    seeds = spark.createDataFrame([(7, 0), (8, 1)], "who long, v long")
    got = {tuple(r) for r in closure(seeds, df, "v").collect()}
    assert got == {(7, 0), (8, 1)} | {(7, b) for a, b in want if a == 0} | {(8, b) for a, b in want if a == 1}
    mutual = {}
    for a, b in want:
        if (b, a) in want:
            mutual.setdefault(a, set()).add(b)
    assert {(r.v, r.label, r.size) for r in components(df).collect()} == {(v, min(s), len(s)) for v, s in mutual.items()}


@few
@given(graphs)
def test_peel(spark, edges):
    v = {x for e in edges for x in e}
    got = {r.v: r.level for r in peel(spark.createDataFrame([(x,) for x in v], "v long"), spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = reachable(edges)
    cyclic = {a for a, b in want if a == b}
    assert set(got) == {x for x in v if x not in cyclic and not any((c, x) in want for c in cyclic)}
    assert all(got[a] < got[b] for a, b in edges if a in got and b in got)


@few
@given(st.lists(st.integers(0, 100), min_size=1, max_size=30))
def test_roots(spark, parents):
    links = [(i + 1, p % (i + 1)) for i, p in enumerate(parents)]
    up = dict(links)

    def root(x):
        while x in up:
            x = up[x]
        return x

    assert {tuple(r) for r in roots(spark.createDataFrame(links, "v long, parent long")).collect()} == {(v, root(v)) for v, _ in links}


@few
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(3, 7)), min_size=1, max_size=14), st.sets(st.tuples(st.integers(0, 7), st.integers(0, 4)), min_size=1, max_size=25))
def test_loaded(spark, imports, own):
    """Entries 0 to 2 are a user's; those no user entry leads to have no row, and candidates are the only rows made."""
    from loomgraph.operators.graph import loaded

    atoms, users = {m for _, m in own}, range(3)
    absent, grown = set(), True
    while grown:
        new = {(d, m) for x, d in imports for m in atoms if (x, m) not in own and (x in users or (x, m) in absent)}
        grown, absent = new != absent, new
    met = {d for d in range(3, 8) if any((u, d) in reachable(imports) for u in users)}
    users_df = spark.createDataFrame([(u,) for u in users], "entry_idx long")
    got = loaded(spark.createDataFrame(sorted(own), "entry_idx long, module_idx long"), spark.createDataFrame(sorted(imports), "importer long, d long"), users_df)
    assert {tuple(r) for r in got.collect()} == {(d, len(atoms) - sum((d, m) in absent for m in atoms)) for d in met}


def test_rounds_send_no_table_to_the_driver(spark, monkeypatch):
    """Nor do chunks made of them: each join in a round would send one more."""
    from loomgraph.operators import fixpoint, graph, relational

    plans, kept = [], fixpoint.kept

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    for module in (fixpoint, graph, relational):
        monkeypatch.setattr(module, "kept", noted)
    rec = spark.createDataFrame([(0, 1, "import-statement"), (1, 2, "import-statement"), (2, 3, "dynamic-import")], "importer long, importee long, kind string")
    ent = spark.createDataFrame([(0, 0, 0), (1, 3, 1)], "entry_idx int, module_idx long, kind int")
    mod = spark.createDataFrame([(i, 100, f"m{i}", "p", "js", False) for i in range(4)], "module_idx long, size long, id string, package_id string, module_type string, has_side_effects boolean")
    reached = graph.reach(ent, graph.edges_of(rec))
    chunks = relational.chunk_modules(mod, rec, ent, reached)
    assert {(r.module_idx, tuple(r.entry_set)) for r in chunks.collect()} == {(0, (0,)), (1, (0,)), (2, (0,)), (3, (0, 1))}
    targets = relational.merge_targets(chunks, rec, ent, reached)
    assert targets.count() == 1
    assert relational.merge_targets(chunks, rec, ent).collect() == targets.collect()
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (chunks, targets, relational.chunk_edges(rec, chunks))]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
