"""Graph operators: reachability, cycles, propagation and other monotone fixpoints over import records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.fixpoint import closure, components, kept, least_fixpoint, peel, roots
from loomgraph.operators.graph import backward, distances, edges_of, execution_order, inclusion, loaded, reach, reachable_pairs, statements
from loomgraph.registry import query
from loomgraph.sources import testdata as D
from loomgraph.sources.testdata import ENTRIES, MODULES, RECORDS, REACH, with_

G = with_(MODULES, RECORDS, ENTRIES, REACH, recursive=True)


def _base(spark, sf):
    return D.modules(spark, sf), D.import_records(spark, sf), D.entries(spark, sf)


@query("gr3_entry_reach", G + """SELECT r.module_idx, list(r.entry_idx ORDER BY r.entry_idx) AS entry_set, count(*) AS share_count, bool_or(e.kind = 0) AS initial
FROM reach r JOIN entries e USING (entry_idx) GROUP BY r.module_idx""")
def gr3(spark, sf):
    _, rec, ent = _base(spark, sf)
    return reach(ent, edges_of(rec)).join(ent.select("entry_idx", "kind"), "entry_idx").groupBy("module_idx").agg(F.sort_array(F.collect_set("entry_idx")).alias("entry_set"), F.count(F.lit(1)).alias("share_count"), F.bool_or(F.col("kind") == 0).alias("initial"))


@query("reach_report", G + "SELECT r.entry_idx, count(*) AS modules, sum(m.size)::BIGINT AS size FROM reach r JOIN modules m USING (module_idx) GROUP BY r.entry_idx")
def reach_report(spark, sf):
    mod, rec, ent = _base(spark, sf)
    return reach(ent, edges_of(rec)).join(mod.select("module_idx", "size"), "module_idx").groupBy("entry_idx").agg(F.count(F.lit(1)).alias("modules"), F.sum("size").alias("size"))


@query("gr4_static_or_dynamic_reach", G + "SELECT e.module_idx AS root, r.module_idx FROM reach r JOIN entries e USING (entry_idx)")
def gr4(spark, sf):
    _, rec, ent = _base(spark, sf)
    return closure(ent.select(F.col("module_idx").alias("root"), "module_idx"), edges_of(rec), "module_idx")


PATHS = """edges AS (SELECT DISTINCT importer AS src, importee AS dst FROM import_records WHERE kind = 'import-statement'),
paths AS (SELECT src, dst FROM edges UNION SELECT p.src, e.dst FROM paths p JOIN edges e ON e.src = p.dst)"""


@query("gr5_is_reachable", with_(RECORDS, ENTRIES, PATHS, recursive=True) + """SELECT a.module_idx AS src, b.module_idx AS dst, EXISTS (SELECT 1 FROM paths p WHERE p.src = a.module_idx AND p.dst = b.module_idx) AS reachable
FROM entries a, entries b""")
def gr5(spark, sf):
    """Is there a path of one edge or more, for all pairs of entries."""
    _, rec, ent = _base(spark, sf)
    return reachable_pairs(ent, edges_of(rec, "import-statement"))


SCC = """mutual AS (SELECT a.src AS v, min(a.dst) AS label, count(*) AS size FROM paths a JOIN paths b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"""


@query("gr6_strong_components", with_(RECORDS, PATHS.replace("WHERE kind = 'import-statement'", ""), SCC, recursive=True) + "SELECT v, label, size FROM mutual")
def gr6(spark, sf):
    """Members of components of two vertices or more, or with a self-loop, labelled by the smallest member."""
    return components(edges_of(D.import_records(spark, sf)))


@query("gr1_execution_order", None)
def gr1(spark, sf):
    _, rec, ent = _base(spark, sf)
    return execution_order(ent.withColumn("graph", F.lit("all")), rec.where(D.kind_is(*D.STATIC)).withColumn("graph", F.lit("all"))).drop("graph")


@query("gr23_expected_and_actual_order", None)
def gr23(spark, sf):
    """The order by sources against the order that packages, taken as chunks, would be run in."""
    mod, rec, ent = _base(spark, sf)
    order = kept(gr1(spark, sf))
    at = order.join(mod.select("module_idx", "package_id"), "module_idx")
    lead = at.groupBy("package_id").agg(F.min("exec_order").alias("first"))
    actual = at.join(lead, "package_id").select("module_idx", "exec_order", F.row_number().over(Window.orderBy("first", "exec_order")).alias("actual"))
    return actual.select("module_idx", "exec_order", (F.col("actual") - 1).alias("actual"))


@query("gr2_cycle_members", with_(RECORDS, PATHS, SCC, recursive=True) + "SELECT label, list(v ORDER BY v) AS members FROM mutual GROUP BY label")
def gr2(spark, sf):
    return components(edges_of(D.import_records(spark, sf), "import-statement")).groupBy("label").agg(F.sort_array(F.collect_list("v")).alias("members"))


@query("gr32_synchronous_cycles", with_(MODULES, RECORDS, PATHS.replace("kind = 'import-statement'", "kind <> 'dynamic-import' AND importer % 13 <> 0 AND importee % 13 <> 0"), SCC, recursive=True) + "SELECT v FROM mutual")
def gr32(spark, sf):
    mod, rec, _ = _base(spark, sf)
    own = mod.where("not is_external").select("module_idx")
    e = edges_of(rec, *D.STATIC).join(own, F.col("src") == own.module_idx, "left_semi").join(own, F.col("dst") == own.module_idx, "left_semi")
    return components(e).select("v")


@query("gr7_reaches_cycle", with_(MODULES, RECORDS, ENTRIES, REACH, PATHS, SCC, recursive=True) + "SELECT r.entry_idx, bool_or(m.v IS NOT NULL) AS cyclic FROM reach r LEFT JOIN mutual m ON m.v = r.module_idx GROUP BY r.entry_idx")
def gr7(spark, sf):
    _, rec, ent = _base(spark, sf)
    members = components(edges_of(rec, "import-statement")).select(F.col("v").alias("module_idx"), F.lit(True).alias("c"))
    return reach(ent, edges_of(rec)).join(members, "module_idx", "left").groupBy("entry_idx").agg(F.coalesce(F.bool_or("c"), F.lit(False)).alias("cyclic"))


@query("gr8_cycle_test", with_(RECORDS, PATHS, recursive=True) + "SELECT count(*) > 0 AS cyclic FROM paths WHERE src = dst")
def gr8(spark, sf):
    """Whatever peeling leaves holds a cycle."""
    e = kept(edges_of(D.import_records(spark, sf), "import-statement"))
    v = e.select(F.col("src").alias("v")).union(e.select("dst")).distinct()
    return v.join(peel(v, e), "v", "left_anti").agg((F.count(F.lit(1)) > 0).alias("cyclic"))


PACKAGES = """pack AS (SELECT DISTINCT a.package_id AS src, b.package_id AS dst FROM import_records r JOIN modules a ON a.module_idx = r.importer JOIN modules b ON b.module_idx = r.importee
  WHERE a.package_id <> b.package_id AND r.kind = 'import-statement')"""


def _package_edges(mod, rec):
    a, b = mod.select(F.col("module_idx").alias("importer"), F.col("package_id").alias("src")), mod.select(F.col("module_idx").alias("importee"), F.col("package_id").alias("dst"))
    return rec.where("kind = 'import-statement'").join(a, "importer").join(b, "importee").where("src <> dst").select("src", "dst").distinct()


@query("gr9_merge_makes_cycle", with_(MODULES, RECORDS, PACKAGES, """pairs AS (SELECT DISTINCT src AS a, dst AS b FROM pack),
walk AS (SELECT p.a, p.b, e.dst AS v FROM pairs p JOIN pack e ON e.src IN (p.a, p.b) WHERE e.dst NOT IN (p.a, p.b)
  UNION SELECT w.a, w.b, e.dst FROM walk w JOIN pack e ON e.src = w.v WHERE w.v NOT IN (w.a, w.b))""", recursive=True) + "SELECT p.a, p.b, EXISTS (SELECT 1 FROM walk w WHERE w.a = p.a AND w.b = p.b AND w.v IN (p.a, p.b)) AS cyclic FROM pairs p")
def gr9(spark, sf):
    """For each edge of the package graph: would contracting it close a cycle through a third vertex?"""
    mod, rec, _ = _base(spark, sf)
    e = kept(_package_edges(mod, rec))
    pairs = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    first = pairs.join(e, F.col("src").isin(F.col("a"), F.col("b"))).where("dst not in (a, b)").select("a", "b", F.col("dst").alias("v"))

    def step(new):
        return new.where("v not in (a, b)").join(e, F.col("v") == F.col("src")).select("a", "b", F.col("dst").alias("v"))

    hit = least_fixpoint(first, step).where("v in (a, b)").select("a", "b", F.lit(True).alias("cyclic")).distinct()
    return pairs.join(hit, ["a", "b"], "left").fillna(False, ["cyclic"])


@query("gr10_top_level_await", with_(MODULES, RECORDS, """tla AS (SELECT module_idx FROM modules WHERE has_tla UNION SELECT i.importer FROM tla t JOIN import_records i ON i.importee = t.module_idx WHERE i.kind = 'import-statement')""", recursive=True) + "SELECT module_idx FROM tla")
def gr10(spark, sf):
    mod, rec, _ = _base(spark, sf)
    return backward(mod.where("has_tla").select(F.col("module_idx").alias("v")), edges_of(rec, "import-statement")).select(F.col("v").alias("module_idx"))


@query("gr11_require_of_tla", with_(MODULES, RECORDS, """back AS (SELECT module_idx AS v, 0 AS depth FROM modules WHERE has_tla
  UNION SELECT i.importer, b.depth + 1 FROM back b JOIN import_records i ON i.importee = b.v WHERE i.kind = 'import-statement' AND b.depth < 60),
dist AS (SELECT v, min(depth) AS depth FROM back GROUP BY v)""", recursive=True) + "SELECT DISTINCT r.importer, r.importee, d.depth AS chain FROM import_records r JOIN dist d ON d.v = r.importee WHERE r.kind = 'require-call'")
def gr11(spark, sf):
    """Require edges into a module that awaits, with the length of the shortest import chain to the cause."""
    mod, rec, _ = _base(spark, sf)
    far = distances(mod.where("has_tla").select(F.col("module_idx").alias("v")), edges_of(rec, "import-statement").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return rec.where("kind = 'require-call'").join(far, F.col("importee") == F.col("v")).select("importer", "importee", F.col("depth").alias("chain")).distinct()


@query("gr12_side_effects", with_(MODULES, RECORDS, """eff AS (SELECT module_idx FROM modules WHERE has_side_effects
  UNION SELECT i.importer FROM eff e JOIN import_records i ON i.importee = e.module_idx JOIN modules m ON m.module_idx = i.importer WHERE NOT m.side_effects_pinned)""", recursive=True) + "SELECT module_idx, module_idx IN (SELECT module_idx FROM eff) AS side_effects FROM modules")
def gr12(spark, sf):
    """Side effects spread to importers, but not into those whose flag is pinned."""
    mod, rec, _ = _base(spark, sf)
    pinned = mod.where("side_effects_pinned").select(F.col("module_idx").alias("v"))
    found = backward(mod.where("has_side_effects").select(F.col("module_idx").alias("v")), edges_of(rec), pinned).withColumn("e", F.lit(True))
    return mod.join(found, mod.module_idx == found.v, "left").select("module_idx", F.coalesce("e", F.lit(False)).alias("side_effects"))


@query("gr13_wrap", with_(MODULES, RECORDS, """w AS (SELECT DISTINCT importee AS module_idx FROM import_records WHERE kind = 'require-call' UNION SELECT i.importee FROM w JOIN import_records i ON i.importer = w.module_idx)""", recursive=True) + """SELECT w.module_idx, EXISTS (SELECT 1 FROM import_records r WHERE r.importee = w.module_idx AND r.kind = 'require-call') AS required FROM w""")
def gr13(spark, sf):
    rec = kept(D.import_records(spark, sf))
    seeds = rec.where("kind = 'require-call'").select(F.col("importee").alias("module_idx"))
    required = rec.where("kind = 'require-call'").select(F.col("importee").alias("module_idx"), F.lit(True).alias("required")).distinct()
    return closure(seeds, edges_of(rec), "module_idx").join(required, "module_idx", "left").fillna(False, ["required"])


@query("gr14_dynamic_exports", with_(MODULES, RECORDS, """dyn AS (SELECT module_idx FROM modules WHERE is_external UNION SELECT i.importer FROM dyn d JOIN import_records i ON i.importee = d.module_idx WHERE i.is_export_star)""", recursive=True) + "SELECT module_idx FROM dyn")
def gr14(spark, sf):
    mod, rec, _ = _base(spark, sf)
    return backward(mod.where("is_external").select(F.col("module_idx").alias("v")), edges_of(rec.where("is_export_star"))).select(F.col("v").alias("module_idx"))


# Inclusion: nodes are modules (k = 0) and statements (k = 1, three to a module); see gr15.
STMTS = """stmts AS (SELECT module_idx * 3 + s AS stmt, module_idx, s, (module_idx + s) % 4 = 0 AS effect FROM modules, (SELECT unnest([0, 1, 2]) AS s)),
uses AS (SELECT importer * 3 + rec_idx % 3 AS stmt, importee * 3 + rec_idx % 2 AS target FROM import_records WHERE kind <> 'dynamic-import')"""
INCLUDED = """inc AS (SELECT 0 AS k, module_idx AS key FROM entries WHERE kind = 0
  UNION SELECT e.k2, e.key2 FROM inc i JOIN demand e ON e.k = i.k AND e.key = i.key)"""
DEMAND = """demand AS (SELECT 0 AS k, module_idx AS key, 1 AS k2, stmt AS key2 FROM stmts WHERE effect
  UNION ALL SELECT 1, stmt, 0, module_idx FROM stmts UNION ALL SELECT 1, stmt, 1, target FROM uses)"""


def _uses(rec):
    return rec.where("kind <> 'dynamic-import'").select((F.col("importer") * 3 + F.col("rec_idx") % 3).alias("stmt"), (F.col("importee") * 3 + F.col("rec_idx") % 2).alias("target")).distinct()


@query("gr15_inclusion", with_(MODULES, RECORDS, ENTRIES, STMTS, DEMAND, INCLUDED, recursive=True) + "SELECT k, key FROM inc")
def gr15(spark, sf):
    mod, rec, ent = _base(spark, sf)
    return inclusion(ent.where("kind = 0"), statements(mod), _uses(rec))


@query("gr16_on_demand_effects", with_(MODULES, RECORDS, ENTRIES, STMTS, DEMAND, INCLUDED, recursive=True) + "SELECT s.module_idx, count(*) AS gated FROM stmts s JOIN inc m ON m.k = 0 AND m.key = s.module_idx WHERE NOT s.effect AND s.s = 2 AND EXISTS (SELECT 1 FROM uses u JOIN inc i ON i.k = 1 AND i.key = u.stmt WHERE u.target // 3 = s.module_idx) GROUP BY s.module_idx")
def gr16(spark, sf):
    """Gated statements (the third of a module) come in if their module is in and something of it is used by what is in."""
    mod, rec, ent = _base(spark, sf)
    st, uses = kept(statements(mod)), kept(_uses(rec))
    inc = kept(inclusion(ent.where("kind = 0"), st, uses))
    demanded = uses.join(inc.where("k = 1"), uses.stmt == inc.key, "left_semi").select(F.floor(F.col("target") / 3).alias("module_idx")).distinct()
    modules_in = inc.where("k = 0").select(F.col("key").alias("module_idx"))
    return st.where("not effect and s = 2").join(modules_in, "module_idx", "left_semi").join(demanded, "module_idx", "left_semi").groupBy("module_idx").agg(F.count(F.lit(1)).alias("gated"))


@query("gr17_dynamic_entry_liveness", with_(MODULES, RECORDS, ENTRIES, STMTS, DEMAND, INCLUDED, recursive=True) + "SELECT r.importee AS module_idx, bool_or(i.key IS NOT NULL) AS alive FROM import_records r LEFT JOIN inc i ON i.k = 1 AND i.key = r.importer * 3 + r.rec_idx % 3 WHERE r.kind = 'dynamic-import' GROUP BY r.importee")
def gr17(spark, sf):
    mod, rec, ent = _base(spark, sf)
    inc = inclusion(ent.where("kind = 0"), statements(mod), _uses(rec)).where("k = 1").select(F.col("key").alias("stmt"), F.lit(True).alias("in"))
    made = rec.where("kind = 'dynamic-import'").select(F.col("importee").alias("module_idx"), (F.col("importer") * 3 + F.col("rec_idx") % 3).alias("stmt"))
    return made.join(inc, "stmt", "left").groupBy("module_idx").agg(F.coalesce(F.bool_or("in"), F.lit(False)).alias("alive"))


DYNAMIC = """dyn_edges AS (SELECT DISTINCT importer AS src, importee AS dst FROM import_records WHERE kind = 'dynamic-import' AND importer < importee)"""


@query("gr18_dynamic_entry_order", with_(RECORDS, DYNAMIC, """lv AS (SELECT src AS v, 0 AS level FROM dyn_edges UNION SELECT dst, 0 FROM dyn_edges UNION SELECT e.dst, l.level + 1 FROM lv l JOIN dyn_edges e ON e.src = l.v)""", recursive=True) + "SELECT v, max(level) AS level FROM lv GROUP BY v")
def gr18(spark, sf):
    """Topological levels of the (acyclic) dynamic import edges: the longest path to each vertex."""
    e = kept(edges_of(D.import_records(spark, sf).where("importer < importee"), "dynamic-import"))
    return peel(e.select(F.col("src").alias("v")).union(e.select("dst")), e)


@query("gr19_entry_to_dynamic_entries", G + "SELECT DISTINCT r.entry_idx, d.entry_idx AS dynamic_entry FROM reach r JOIN entries d ON d.module_idx = r.module_idx WHERE d.kind = 1 AND d.entry_idx <> r.entry_idx")
def gr19(spark, sf):
    _, rec, ent = _base(spark, sf)
    dyn = ent.where("kind = 1").select("module_idx", F.col("entry_idx").alias("dynamic_entry"))
    return reach(ent, edges_of(rec)).join(dyn, "module_idx").where("entry_idx <> dynamic_entry").select("entry_idx", "dynamic_entry").distinct()


LOADED = """stat AS (SELECT entry_idx, module_idx FROM entries UNION SELECT r.entry_idx, i.importee FROM stat r JOIN import_records i ON i.importer = r.module_idx AND i.kind <> 'dynamic-import'),
dyn AS (SELECT DISTINCT a.entry_idx AS importer, d.entry_idx AS d FROM stat a JOIN import_records r ON r.importer = a.module_idx AND r.kind <> 'import-statement' JOIN entries d ON d.module_idx = r.importee AND d.kind = 1),
atoms AS (SELECT DISTINCT module_idx FROM stat),
missing AS (SELECT DISTINCT x.importer AS e, x.d, a.module_idx FROM dyn x, atoms a WHERE NOT EXISTS (SELECT 1 FROM stat s WHERE s.entry_idx = x.importer AND s.module_idx = a.module_idx)),
absent AS (SELECT m.d AS e, m.module_idx FROM missing m JOIN entries i ON i.entry_idx = m.e AND i.kind = 0
  UNION SELECT m.d, m.module_idx FROM absent a JOIN missing m ON m.e = a.e AND m.module_idx = a.module_idx)"""


@query("gr20_already_loaded", with_(RECORDS, ENTRIES, LOADED, recursive=True) + "SELECT e AS entry_idx, count(*) AS absent FROM absent GROUP BY e")
def gr20(spark, sf):
    """How many atoms may be absent before a dynamic entry: all but those surely loaded."""
    _, rec, ent = _base(spark, sf)
    ent = kept(ent)
    stat = kept(reach(ent, edges_of(rec, *D.STATIC)))
    target = ent.where("kind = 1").select(F.col("module_idx").alias("importee"), F.col("entry_idx").alias("d"))
    dyn = kept(stat.join(rec.where("kind <> 'import-statement'"), stat.module_idx == rec.importer).join(target, "importee").select(F.col("entry_idx").alias("importer"), "d").distinct())
    sure = loaded(stat, dyn, ent.where("kind = 0").select("entry_idx"))
    atoms = stat.select("module_idx").distinct().agg(F.count(F.lit(1)).alias("atoms"))
    return sure.join(atoms, F.lit(True)).select("entry_idx", (F.col("atoms") - F.col("loaded")).alias("absent")).where("absent > 0")


@query("gr21_backward_static", with_(MODULES, RECORDS, """up AS (SELECT module_idx FROM modules WHERE module_idx % 17 = 0 UNION SELECT i.importer FROM up u JOIN import_records i ON i.importee = u.module_idx WHERE i.kind = 'import-statement')""", recursive=True) + "SELECT module_idx FROM up")
def gr21(spark, sf):
    mod, rec, _ = _base(spark, sf)
    return backward(mod.where("module_idx % 17 = 0").select(F.col("module_idx").alias("v")), edges_of(rec, "import-statement")).select(F.col("v").alias("module_idx"))


GROW = """at_risk AS (SELECT v FROM mutual UNION SELECT i.importer FROM at_risk a JOIN import_records i ON i.importee = a.v WHERE i.kind = 'import-statement')"""


@query("gr22_emergent_cycles", with_(RECORDS, PATHS, SCC, GROW, recursive=True) + "SELECT v FROM at_risk")
def gr22(spark, sf):
    """The set at risk: members of cycles and all that imports them; grown until nothing is added."""
    rec = D.import_records(spark, sf)
    e = kept(edges_of(rec, "import-statement"))
    return backward(components(e).select("v"), e)


@query("gr24_update_superset", with_(MODULES, RECORDS, """up AS (SELECT module_idx FROM modules WHERE module_idx % 19 = 0
  UNION SELECT i.importer FROM up u JOIN modules m ON m.module_idx = u.module_idx JOIN import_records i ON i.importee = u.module_idx WHERE NOT m.self_accepting AND (i.importer + i.importee) % 6 <> 0)""", recursive=True) + "SELECT module_idx FROM up")
def gr24(spark, sf):
    """What a change may touch: importers, not beyond a module that accepts itself, nor along an edge its importer accepts."""
    mod, rec, _ = _base(spark, sf)
    stop = mod.where("self_accepting").select(F.col("module_idx").alias("src"))
    back = edges_of(rec.where("(importer + importee) % 6 <> 0")).select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(stop, "src", "left_anti").select("src", "dst")
    return closure(mod.where("module_idx % 19 = 0").select("module_idx"), back, "module_idx")


@query("gr25_lazy_dependencies", with_(MODULES, RECORDS, ENTRIES, """c AS (SELECT module_idx AS client FROM entries WHERE kind = 1),
down AS (SELECT client, client AS module_idx FROM c UNION SELECT d.client, i.importee FROM down d JOIN import_records i ON i.importer = d.module_idx
  WHERE (i.kind <> 'dynamic-import' OR d.module_idx = d.client) AND (i.importee + d.client) % 5 <> 0)""", recursive=True) + "SELECT client, module_idx FROM down")
def gr25(spark, sf):
    """Static dependencies of each client's root; dynamic ones from the root alone; what the client holds is pruned."""
    _, rec, ent = _base(spark, sf)
    rec = kept(rec)
    seeds = ent.where("kind = 1").select(F.col("module_idx").alias("client"), "module_idx")

    def step(new):
        return new.join(rec, new.module_idx == rec.importer).where((F.col("kind") != "dynamic-import") | (new.module_idx == new.client)).where((F.col("importee") + F.col("client")) % 5 != 0).select("client", F.col("importee").alias("module_idx"))

    return least_fixpoint(seeds, step)


LINKS = """links AS (SELECT importer AS v, min(importee) AS parent FROM import_records WHERE kind = 'import-statement' AND importee < importer GROUP BY importer),
jump AS (SELECT v, parent, 1 AS depth FROM links UNION ALL SELECT j.v, l.parent, j.depth + 1 FROM jump j JOIN links l ON l.v = j.parent)"""


@query("gr26_canonical_symbols", with_(RECORDS, LINKS, recursive=True) + "SELECT v, arg_max(parent, depth) AS root FROM jump GROUP BY v")
def gr26(spark, sf):
    """The root of each linked symbol: links are directed, the base takes the target's root."""
    links = D.import_records(spark, sf).where("kind = 'import-statement' and importee < importer").groupBy(F.col("importer").alias("v")).agg(F.min("importee").alias("parent"))
    return roots(links)


@query("gr27_content_closure", G + "SELECT r.entry_idx, sum(m.size)::BIGINT AS content, min(r.module_idx) AS first FROM reach r JOIN modules m USING (module_idx) GROUP BY r.entry_idx")
def gr27(spark, sf):
    mod, rec, ent = _base(spark, sf)
    return reach(ent, edges_of(rec)).join(mod, "module_idx").groupBy("entry_idx").agg(F.sum("size").alias("content"), F.min("module_idx").alias("first"))


@query("gr28_barrel_demand", with_(RECORDS, ENTRIES, """ask AS (SELECT module_idx, 'n' || entry_idx % 3 AS name FROM entries UNION
  SELECT i.importee, a.name FROM ask a JOIN import_records i ON i.importer = a.module_idx WHERE i.is_export_star OR a.name = 'n' || i.rec_idx % 3)""", recursive=True) + "SELECT module_idx, list(name ORDER BY name) AS names FROM ask GROUP BY module_idx")
def gr28(spark, sf):
    """Requested names spread along the re-exports that can answer them; only what is newly requested goes on."""
    _, rec, ent = _base(spark, sf)
    rec = kept(rec)
    name = lambda c: F.concat(F.lit("n"), (F.col(c) % 3).cast("string"))

    def step(new):
        return new.join(rec, new.module_idx == rec.importer).where(F.col("is_export_star") | (F.col("name") == name("rec_idx"))).select(F.col("importee").alias("module_idx"), "name")

    return least_fixpoint(ent.select("module_idx", name("entry_idx").alias("name")), step).groupBy("module_idx").agg(F.sort_array(F.collect_list("name")).alias("names"))


@query("gr29_import_chain", with_(RECORDS, ENTRIES, """back AS (SELECT module_idx AS v, 0 AS depth FROM entries UNION SELECT i.importee, b.depth + 1 FROM back b JOIN import_records i ON i.importer = b.v WHERE b.depth < 60)""", recursive=True) + "SELECT v, min(depth) AS depth FROM back GROUP BY v")
def gr29(spark, sf):
    """How many imports lie between an entry and each module, on the shortest chain."""
    _, rec, ent = _base(spark, sf)
    return distances(ent.select(F.col("module_idx").alias("v")), kept(edges_of(rec)))


@query("gr30_graph_delta", with_(RECORDS) + """SELECT importer, list(DISTINCT importee ORDER BY importee) FILTER (WHERE kind <> 'dynamic-import') AS static_out, list(DISTINCT importee ORDER BY importee) FILTER (WHERE kind = 'dynamic-import') AS dynamic_out FROM import_records GROUP BY importer""")
def gr30(spark, sf):
    own = lambda c: F.nullif(F.sort_array(F.collect_set(F.when(c, F.col("importee")))), F.array().cast("array<bigint>"))
    return D.import_records(spark, sf).groupBy("importer").agg(own(F.col("kind") != "dynamic-import").alias("static_out"), own(F.col("kind") == "dynamic-import").alias("dynamic_out"))


@query("gr31_last_write_edges", with_(RECORDS, """delta AS (SELECT DISTINCT importer, importee + 1 AS importee FROM import_records WHERE importer % 5 = 0),
now AS (SELECT importer, importee FROM import_records WHERE importer NOT IN (SELECT importer FROM delta) UNION SELECT importer, importee FROM delta)""") + "SELECT importee, list(importer ORDER BY importer) AS importers FROM now GROUP BY importee")
def gr31(spark, sf):
    """A delta replaces all out-edges of the modules it names."""
    rec = D.import_records(spark, sf)
    delta = rec.where("importer % 5 = 0").select("importer", (F.col("importee") + 1).alias("importee")).distinct()
    now = rec.select("importer", "importee").join(delta.select("importer").distinct(), "importer", "left_anti").unionByName(delta).distinct()
    return now.groupBy("importee").agg(F.sort_array(F.collect_list("importer")).alias("importers"))


@query("gr33_top_level_evaluated", with_(MODULES, RECORDS, ENTRIES, """one AS (SELECT module_idx FROM entries WHERE entry_idx = 0), ev AS (SELECT module_idx FROM one UNION SELECT i.importee FROM ev e JOIN import_records i ON i.importer = e.module_idx AND i.kind = 'import-statement')""", recursive=True) + "SELECT e.module_idx, m.size AS stamp FROM ev e JOIN modules m USING (module_idx) WHERE (SELECT count(*) FROM one) = 1")
def gr33(spark, sf):
    """Modules evaluated at top level under a single entry; nothing if there are several."""
    mod, rec, ent = _base(spark, sf)
    one = ent.where("entry_idx = 0").select("module_idx")
    single = one.agg((F.count(F.lit(1)) == 1).alias("single")).where("single")
    return closure(one, edges_of(rec, "import-statement"), "module_idx").join(mod, "module_idx").join(single, F.lit(True)).select("module_idx", F.col("size").alias("stamp"))


@query("gr34_star_externals", with_(MODULES, RECORDS, ENTRIES, """star AS (SELECT entry_idx, module_idx FROM entries UNION SELECT s.entry_idx, i.importee FROM star s JOIN import_records i ON i.importer = s.module_idx AND i.is_export_star)""", recursive=True) + "SELECT s.entry_idx, s.module_idx FROM star s JOIN modules m USING (module_idx) WHERE m.is_external")
def gr34(spark, sf):
    mod, rec, ent = _base(spark, sf)
    return reach(ent, edges_of(rec.where("is_export_star"))).join(mod.where("is_external"), "module_idx", "left_semi").select("entry_idx", "module_idx")


@query("gr35_chunk_roots", with_(MODULES, RECORDS) + """SELECT m.package_id, list(m.module_idx ORDER BY m.module_idx) AS roots FROM modules m WHERE NOT EXISTS (SELECT 1 FROM import_records r JOIN modules p ON p.module_idx = r.importer WHERE r.importee = m.module_idx AND p.package_id = m.package_id AND p.module_idx <> m.module_idx) GROUP BY m.package_id""")
def gr35(spark, sf):
    """Members of a group that no other member imports."""
    mod, rec, _ = _base(spark, sf)
    a = mod.select(F.col("module_idx").alias("importer"), F.col("package_id").alias("p"))
    b = mod.select(F.col("module_idx").alias("importee"), F.col("package_id").alias("q"))
    inner = rec.join(a, "importer").join(b, "importee").where("p = q and importer <> importee").select(F.col("importee").alias("module_idx")).distinct()
    return mod.join(inner, "module_idx", "left_anti").groupBy("package_id").agg(F.sort_array(F.collect_list("module_idx")).alias("roots"))


@query("gr36_helper_liveness", with_(MODULES, RECORDS, ENTRIES, STMTS, DEMAND, INCLUDED, recursive=True) + "SELECT s.s AS helper, count(*) FILTER (WHERE i.key IS NOT NULL) > 0 AS alive, count(*) AS statements FROM stmts s LEFT JOIN inc i ON i.k = 1 AND i.key = s.stmt GROUP BY s.s")
def gr36(spark, sf):
    """A helper stays if an included statement asks for it."""
    mod, rec, ent = _base(spark, sf)
    st = kept(statements(mod))
    inc = inclusion(ent.where("kind = 0"), st, _uses(rec)).where("k = 1").select(F.col("key").alias("stmt"), F.lit(1).alias("in"))
    return st.join(inc, "stmt", "left").groupBy(F.col("s").alias("helper")).agg((F.count("in") > 0).alias("alive"), F.count(F.lit(1)).alias("statements"))
