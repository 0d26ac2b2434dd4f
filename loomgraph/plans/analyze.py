"""The bundle report as tables, and queries that show the surface for user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import text as X
from loomgraph.functions.hooks import Hook, Hooks, only_where
from loomgraph.operators.fixpoint import closure, kept, unsent
from loomgraph.operators.graph import edges_of, reach
from loomgraph.operators.relational import chunk_edges, chunk_modules
from loomgraph.plans.relational import G, M, R, _chunks
from loomgraph.registry import query
from loomgraph.sources import testdata as D
from loomgraph.sources.testdata import table, with_


@query("an1_modules", G + "SELECT id, size, row_number() OVER (PARTITION BY chunk_idx ORDER BY module_idx) - 1 AS ord, chunk_idx FROM chunk_modules")
def an1(spark, sf):
    return _chunks(spark, sf).select("id", "size", (F.row_number().over(Window.partitionBy("chunk_idx").orderBy("module_idx")) - 1).alias("ord"), "chunk_idx")


@query("an2_importers", R[:-1] + " SELECT importee AS module_idx, count(DISTINCT importer) AS importers, count(DISTINCT importer) FILTER (WHERE kind = 'dynamic-import') AS dynamic FROM import_records GROUP BY importee")
def an2(spark, sf):
    dyn = F.when(F.col("kind") == "dynamic-import", F.col("importer"))
    return D.import_records(spark, sf).groupBy(F.col("importee").alias("module_idx")).agg(F.count_distinct("importer").alias("importers"), F.count_distinct(dyn).alias("dynamic"))


EDGES = "ce AS (SELECT DISTINCT a.chunk_idx AS src, b.chunk_idx AS dst, r.kind = 'dynamic-import' AS dyn FROM import_records r JOIN chunk_modules a ON a.module_idx = r.importer JOIN chunk_modules b ON b.module_idx = r.importee WHERE a.chunk_idx <> b.chunk_idx)"
GE = G[:-1] + ",\n" + EDGES + "\n"


@query("an3_chunks", GE + "SELECT c.chunk_idx, count(*) AS modules, sum(c.size)::BIGINT AS size, (SELECT list(dst ORDER BY dst) FROM ce WHERE src = c.chunk_idx AND NOT dyn) AS imports, (SELECT list(dst ORDER BY dst) FROM ce WHERE src = c.chunk_idx AND dyn) AS dynamic_imports FROM chunk_modules c GROUP BY c.chunk_idx")
def an3(spark, sf):
    ch, rec = kept(_chunks(spark, sf)), kept(D.import_records(spark, sf))
    out = lambda kinds, name: chunk_edges(rec.where(kinds), ch).groupBy(F.col("src").alias("chunk_idx")).agg(F.sort_array(F.collect_list("dst")).alias(name))
    base = ch.groupBy("chunk_idx").agg(F.count(F.lit(1)).alias("modules"), F.sum("size").alias("size"))
    return base.join(unsent(out("kind <> 'dynamic-import'", "imports")), "chunk_idx", "left").join(unsent(out("kind = 'dynamic-import'", "dynamic_imports")), "chunk_idx", "left")


@query("an4_entry_modules", G + "SELECT r.entry_idx, list(r.module_idx ORDER BY r.module_idx) AS modules FROM reach r GROUP BY r.entry_idx")
def an4(spark, sf):
    return reach(D.entries(spark, sf), edges_of(D.import_records(spark, sf))).groupBy("entry_idx").agg(F.sort_array(F.collect_list("module_idx")).alias("modules"))


@query("an5_summary", G + "SELECT sum(size)::BIGINT AS size, count(*) AS modules, (SELECT count(*) FROM entries) AS entries, count(DISTINCT chunk_idx) FILTER (WHERE len(entry_set) > 1) AS common FROM chunk_modules")
def an5(spark, sf):
    common = F.count_distinct(F.when(F.size("entry_set") > 1, F.col("chunk_idx")))
    n = D.entries(spark, sf).agg(F.count(F.lit(1)).alias("entries"))
    return _chunks(spark, sf).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("modules"), common.alias("common")).join(n, F.lit(True))


@query("an6_largest", G + "SELECT id, size, size * 100.0::DOUBLE / (SELECT sum(size) FROM chunk_modules) AS percent FROM chunk_modules ORDER BY size DESC, id LIMIT 15")
def an6(spark, sf):
    ch = kept(_chunks(spark, sf))
    return ch.orderBy(F.desc("size"), "id").limit(15).join(ch.agg(F.sum("size").alias("total")), F.lit(True)).select("id", "size", (F.col("size") * 100.0 / F.col("total")).alias("percent"))


@query("an7_entry_points", G + "SELECT r.entry_idx, c.chunk_idx, count(*) AS modules, sum(c.size)::BIGINT AS size FROM reach r JOIN chunk_modules c USING (module_idx) GROUP BY r.entry_idx, c.chunk_idx")
def an7(spark, sf):
    rec, ent = D.import_records(spark, sf), D.entries(spark, sf)
    reached = reach(ent, edges_of(rec))
    ch = chunk_modules(D.modules(spark, sf), rec, ent, reached)
    return reached.join(unsent(ch.select("module_idx", "chunk_idx", "size")), "module_idx").groupBy("entry_idx", "chunk_idx").agg(F.count(F.lit(1)).alias("modules"), F.sum("size").alias("size"))


STATIC = """sreach AS (SELECT entry_idx, module_idx FROM entries UNION SELECT r.entry_idx, i.importee FROM sreach r JOIN import_records i ON i.importer = r.module_idx AND i.kind <> 'dynamic-import')"""


@query("an8_suggestions", with_(D.MODULES, D.RECORDS, D.ENTRIES, D.REACH, D.CHUNKS, STATIC, """one AS (SELECT c.chunk_idx, c.module_idx, c.size, min(s.entry_idx) AS entry_idx FROM chunk_modules c JOIN sreach s USING (module_idx) WHERE len(c.entry_set) > 1 GROUP BY ALL HAVING count(*) = 1),
weight AS (SELECT chunk_idx, sum(size) AS total FROM chunk_modules GROUP BY chunk_idx)""", recursive=True) + "SELECT chunk_idx, entry_idx, count(*) AS modules, sum(size)::BIGINT AS size, sum(size) * 100.0::DOUBLE / any_value(total) AS percent, CASE WHEN sum(size) * 100.0 / any_value(total) > 50 THEN 'HIGH' WHEN sum(size) * 100.0 / any_value(total) >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM one JOIN weight USING (chunk_idx) GROUP BY chunk_idx, entry_idx")
def an8(spark, sf):
    """Modules of a shared chunk that a single entry needs statically could move into that entry."""
    rec, ent = kept(D.import_records(spark, sf)), D.entries(spark, sf)
    ch = kept(_chunks(spark, sf))
    static = reach(ent, edges_of(rec, *D.STATIC))
    one = ch.where(F.size("entry_set") > 1).join(unsent(static), "module_idx").groupBy("chunk_idx", "module_idx", "size").agg(F.min("entry_idx").alias("entry_idx"), F.count(F.lit(1)).alias("n")).where("n = 1")
    total = ch.groupBy("chunk_idx").agg(F.sum("size").alias("total"))
    out = one.groupBy("chunk_idx", "entry_idx").agg(F.count(F.lit(1)).alias("modules"), F.sum("size").alias("size")).join(unsent(total), "chunk_idx")
    return out.withColumn("percent", F.col("size") * 100.0 / F.col("total")).withColumn("level", X.level(F.col("percent"))).drop("total")


@query("an9_most_imported", R[:-1] + " SELECT importee AS module_idx, count(DISTINCT importer) AS importers FROM import_records GROUP BY importee HAVING count(DISTINCT importer) >= 2")
def an9(spark, sf):
    return D.import_records(spark, sf).groupBy(F.col("importee").alias("module_idx")).agg(F.count_distinct("importer").alias("importers")).where("importers >= 2")


@query("an10_module_graph", with_(D.MODULES, D.RECORDS) + "SELECT m.id, (SELECT list(DISTINCT importee ORDER BY importee) FROM import_records r WHERE r.importer = m.module_idx) AS imports, (SELECT list(DISTINCT importer ORDER BY importer) FROM import_records r WHERE r.importee = m.module_idx) AS importers FROM modules m")
def an10(spark, sf):
    rec = D.import_records(spark, sf)
    out = rec.groupBy(F.col("importer").alias("module_idx")).agg(F.sort_array(F.collect_set("importee")).alias("imports"))
    back = rec.groupBy(F.col("importee").alias("module_idx")).agg(F.sort_array(F.collect_set("importer")).alias("importers"))
    return D.modules(spark, sf).join(out, "module_idx", "left").join(back, "module_idx", "left").select("id", "imports", "importers")


@query("an11_raw_lines", with_(D.MODULES, D.RECORDS) + "SELECT '[MODULE: ' || id || ' ' || size || ']' AS line FROM modules UNION ALL SELECT '[IMPORT: ' || a.id || ' -> ' || b.id || ']' FROM import_records r JOIN modules a ON a.module_idx = r.importer JOIN modules b ON b.module_idx = r.importee")
def an11(spark, sf):
    mod, rec = D.modules(spark, sf), D.import_records(spark, sf)
    a, b = mod.select(F.col("module_idx").alias("importer"), F.col("id").alias("a")), mod.select(F.col("module_idx").alias("importee"), F.col("id").alias("b"))
    tagged = mod.select(F.format_string("[MODULE: %s %d]", "id", "size").alias("line"))
    return tagged.unionByName(rec.join(a, "importer").join(b, "importee").select(F.format_string("[IMPORT: %s -> %s]", "a", "b").alias("line")))


@query("chunk_reach", GE[:-1] + """, w AS (SELECT DISTINCT src AS root, dst AS chunk_idx FROM ce UNION SELECT w.root, e.dst FROM w JOIN ce e ON e.src = w.chunk_idx)
SELECT root, count(*) AS chunks FROM w GROUP BY root""")
def chunk_reach(spark, sf):
    """How many chunks loading one may bring along."""
    e = kept(chunk_edges(D.import_records(spark, sf), _chunks(spark, sf)))
    return closure(e.select(F.col("src").alias("root"), F.col("dst").alias("chunk_idx")), e, "chunk_idx").groupBy("root").agg(F.count(F.lit(1)).alias("chunks"))


# User functions ---------------------------------------------------------------------------------------------------------------


def _hooks() -> Hooks:
    h = Hooks()
    h.add("resolve", Hook("late", lambda c: F.concat(F.lit("?"), c), "post"))
    h.add("resolve", Hook("css", lambda c: F.when(c.endswith(".css"), F.lit("style"))))
    h.add("resolve", Hook("json", lambda c: F.when(c.endswith(".json"), F.lit("data")), "pre"))
    h.add("transform", Hook("up", lambda t: F.upper(t)))
    h.add("transform", Hook("cut", lambda t: F.when(F.length(t) > 12, F.substring(t, 1, 12)), "pin-post"))
    h.add("transform", Hook("dot", lambda t: F.concat(t, F.lit(".")), "pin-post"))
    h.add("banner", Hook("a", lambda c: F.lit("/*a*/")))
    h.add("banner", Hook("b", lambda c: F.concat(F.lit("/*"), c, F.lit("*/"))))
    h.add("bundle", Hook("big", lambda df: df.where("size >= 2500")))
    h.add("bundle", Hook("count", lambda df: df.groupBy("module_type").agg(F.count(F.lit(1)).alias("n")), "post"))
    return h


@query("ud1_first_answer", M + "SELECT module_idx, CASE WHEN module_type = 'json' THEN 'data' WHEN module_type = 'css' THEN 'style' ELSE '?' || id END AS resolved FROM modules")
def ud1(spark, sf):
    return D.modules(spark, sf).select("module_idx", _hooks().first("resolve", F.col("id")).alias("resolved"))


@query("ud2_fold", M + "SELECT module_idx, CASE WHEN length(upper(package_id) || '.') > 12 THEN substr(upper(package_id) || '.', 1, 12) ELSE upper(package_id) || '.' END AS code FROM modules")
def ud2(spark, sf):
    return D.modules(spark, sf).select("module_idx", _hooks().fold("transform", F.col("package_id")).alias("code"))


@query("ud3_joined", M + "SELECT module_idx, '/*a*//*' || package_id || '*/' AS banner FROM modules")
def ud3(spark, sf):
    return D.modules(spark, sf).select("module_idx", _hooks().joined("banner", F.col("package_id")).alias("banner"))


@query("ud4_whole_table", M + "SELECT module_type, count(*) AS n FROM modules WHERE size >= 2500 GROUP BY module_type")
def ud4(spark, sf):
    return _hooks().table("bundle", D.modules(spark, sf))


@query("ud5_hook_order", "SELECT * FROM (VALUES ('up', 0), ('dot', 1), ('cut', 2)) t(name, pos)")
def ud5(spark, sf):
    return spark.createDataFrame([(h.name, i) for i, h in enumerate(_hooks().of("transform"))], "name string, pos int")


@query("ud6_hook_usage", "SELECT * FROM (VALUES ('transform', true), ('load', false)) t(stage, used)")
def ud6(spark, sf):
    return spark.createDataFrame([(s, bool(_hooks().of(s))) for s in ("transform", "load")], "stage string, used boolean")


@query("ud7_filter_before_udf", M + "SELECT module_idx, CASE WHEN module_type = 'css' THEN reverse(package_id) END AS code FROM modules")
def ud7(spark, sf):
    """Only the rows that pass the filter reach Python."""

    @F.pandas_udf("string")
    def turned(s: pd.Series) -> pd.Series:
        return s.str[::-1]

    mod = D.modules(spark, sf).select("module_idx", "module_type", "package_id")
    return only_where(mod, F.col("module_type") == "css", lambda df: df.withColumn("code", turned("package_id"))).select("module_idx", "code")


@query("ud8_emitted_files", M + "SELECT module_idx, unnest([id, id || '.map']) AS file FROM modules WHERE module_type = 'js'")
def ud8(spark, sf):
    return D.modules(spark, sf).where("module_type = 'js'").select("module_idx", F.explode(F.array("id", F.concat("id", F.lit(".map")))).alias("file"))


@query("ud9_parallel_workers", "SELECT doc_id, length(text) AS n FROM documents")
def ud9(spark, sf):
    """A vectorised function in parallel Python workers."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": b["text"].str.len()})

    return table(spark, sf, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, n long")


@query("ud11_module_info", with_(D.MODULES, D.RECORDS) + "SELECT m.module_idx, m.id, m.module_type, (SELECT count(*) FROM import_records r WHERE r.importer = m.module_idx) AS imports, (SELECT count(*) FROM import_records r WHERE r.importee = m.module_idx) AS imported FROM modules m")
def ud11(spark, sf):
    rec = D.import_records(spark, sf)
    out = rec.groupBy(F.col("importer").alias("module_idx")).agg(F.count(F.lit(1)).alias("imports"))
    back = rec.groupBy(F.col("importee").alias("module_idx")).agg(F.count(F.lit(1)).alias("imported"))
    return D.modules(spark, sf).select("module_idx", "id", "module_type").join(out, "module_idx", "left").join(back, "module_idx", "left").fillna(0, ["imports", "imported"])
