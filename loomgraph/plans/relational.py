"""Sources, sinks, joins, aggregates, ordered scans, sorts and set operations."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import text as X
from loomgraph.operators.fixpoint import kept, least_fixpoint, shared_path, unsent
from loomgraph.operators.graph import edges_of, reach
from loomgraph.operators.relational import as_of, best_split, chunk_edges, chunk_modules, client_needs, conflict_names, copy_files, exports, files, imports, in_flight, match_rules, merge_small, merge_targets, merge_snapshot, star_exports, unique_names, write_outputs
from loomgraph.registry import query
from loomgraph.sources import testdata as D
from loomgraph.sources.testdata import CHUNKS, ENTRIES, MODULES, RECORDS, REACH, table, with_

M, R = with_(MODULES), with_(RECORDS)
G = with_(MODULES, RECORDS, ENTRIES, REACH, CHUNKS, recursive=True)


def _chunks(spark, sf):
    return chunk_modules(D.modules(spark, sf), D.import_records(spark, sf), D.entries(spark, sf))


# Sources --------------------------------------------------------------------------------------------------------------------


@query("src1_file_scan", None)
def src1(spark, sf):
    return files(spark, sf, "*.parquet").select(X.basename(F.col("path")).alias("file"), "length")


@query("src2_memory_files", "SELECT * FROM (VALUES ('/a.js', 12), ('/b/c.ts', 4)) t(path, length)")
def src2(spark, sf):
    rows = [("/a.js", b"import './b'"), ("/b/c.ts", b"x=1;")]
    return spark.createDataFrame(rows, "path string, content binary").select("path", F.octet_length("content").alias("length"))


@query("src3_load_source", M + "SELECT module_idx, CASE WHEN module_idx % 10 = 0 THEN 'hook' || module_idx ELSE upper(module_type) END AS loaded FROM modules")
def src3(spark, sf):
    """What a hook gives, else what the loader of the type makes."""
    hook = F.when(F.col("module_idx") % 10 == 0, F.concat(F.lit("hook"), F.col("module_idx").cast("string")))
    return D.modules(spark, sf).select("module_idx", F.coalesce(hook, F.upper("module_type")).alias("loaded"))


@query("src4_loader_by_suffix", M + "SELECT module_idx, CASE WHEN module_idx % 5 = 0 THEN CASE module_type WHEN 'json' THEN 'bundle' ELSE CASE module_type WHEN 'css' THEN 'css' WHEN 'ts' THEN 'ts' ELSE 'js' END END ELSE CASE module_type WHEN 'css' THEN 'css' WHEN 'json' THEN 'json' WHEN 'ts' THEN 'ts' ELSE 'js' END END AS loader FROM modules")
def src4(spark, sf):
    name = F.when(F.col("module_idx") % 5 == 0, F.concat(F.lit("x.b."), F.col("module_type"))).otherwise(F.col("id"))
    return D.modules(spark, sf).select("module_idx", X.loader_of(name, {"css": "css", "json": "json", "ts": "ts", "b.json": "bundle"}).alias("loader"))


@query("src5_crawl", with_(MODULES, RECORDS, ENTRIES, """found AS (SELECT module_idx FROM entries UNION SELECT i.importee FROM found f JOIN import_records i ON i.importer = f.module_idx)""", recursive=True) + "SELECT f.module_idx, m.id FROM found f JOIN modules m USING (module_idx)")
def src5(spark, sf):
    """Modules discovered from the entries, each loaded once: requests are resolved by a join with the files."""
    mod, rec = D.modules(spark, sf), kept(D.import_records(spark, sf))

    def step(new):
        return new.join(rec, new.module_idx == rec.importer).select(F.col("importee").alias("module_idx"))

    return least_fixpoint(D.entries(spark, sf).select("module_idx"), step).join(mod.select("module_idx", "id"), "module_idx")


@query("src6_partial_scan", R[:-1] + """, delta AS (SELECT importer, rec_idx, importee + 1 AS importee FROM import_records WHERE importer % 9 = 0)
SELECT importer, rec_idx, importee FROM import_records WHERE importer % 9 <> 0 UNION ALL SELECT importer, rec_idx, importee FROM delta""")
def src6(spark, sf):
    rec = D.import_records(spark, sf).select("importer", "rec_idx", "importee")
    delta = rec.where("importer % 9 = 0").withColumn("importee", F.col("importee") + 1)
    return merge_snapshot(rec, delta, ["importer"])


@query("src7_rollback", R[:-1] + " SELECT importer, count(*) AS n FROM import_records GROUP BY importer")
def src7(spark, sf):
    """A failed partial scan leaves the snapshot as it was: versions are whole tables, and the current one is swapped last."""
    rec = D.import_records(spark, sf)
    broken = merge_snapshot(rec, rec.where("importer % 9 = 0").withColumn("importee", F.lit(None).cast("bigint")), ["importer"])
    failed = broken.where("importee is null").limit(1).count() > 0
    return (rec if failed else broken).groupBy("importer").agg(F.count(F.lit(1)).alias("n"))


@query("src8_resolution", M[:-1] + """, asked AS (SELECT module_idx AS importer, '/repo/src/' || split_part(id, '/', 4) || '/m' || (module_idx + 4) AS want FROM modules)
SELECT a.importer, min(m.module_idx) AS resolved FROM asked a LEFT JOIN modules m ON m.id IN (a.want || '.js', a.want || '.ts', a.want || '.json', a.want || '.css') GROUP BY a.importer""")
def src8(spark, sf):
    """The first candidate that exists, in the order of extensions: an equi-join on the candidates."""
    mod = D.modules(spark, sf)
    want = F.concat(X.dirname(F.col("id")), F.lit("/m"), (F.col("module_idx") + 4).cast("string"))
    asked = mod.select(F.col("module_idx").alias("importer"), F.posexplode(F.transform(F.array(*[F.lit(e) for e in D.EXTENSIONS]), lambda e: F.concat(want, F.lit("."), e))).alias("rank", "id"))
    return asked.join(mod.select("module_idx", "id"), "id", "left").groupBy("importer").agg(F.min_by("module_idx", F.when(F.col("module_idx").isNotNull(), F.col("rank"))).alias("resolved"))


@query("src9_glob_import", M + "SELECT list(id ORDER BY id) AS files FROM modules WHERE regexp_matches(id, '^/repo/src/[^/]*/m1[^/]*\\.json$') AND NOT regexp_matches(id, '^/repo/src/[^/]*/m11[^/]*$')")
def src9(spark, sf):
    hit = F.col("id").rlike(X.glob_regex("/repo/src/*/m1*.json")) & ~F.col("id").rlike(X.glob_regex("/repo/src/*/m11*"))
    return D.modules(spark, sf).where(hit).agg(F.sort_array(F.collect_list("id")).alias("files"))


@query("src10_expression_glob", "SELECT './p' || page_id % 7 || '/*.' || ['js', 'json', 'css'][page_id % 3 + 1] AS glob, page_id FROM pages")
def src10(spark, sf):
    """A template or concatenation with its dynamic parts as stars; runs of stars are one."""
    p = F.col("page_id")
    ext = F.element_at(F.array(F.lit("js"), F.lit("json"), F.lit("css")), (p % 3 + 1).cast("int"))
    text = F.concat(F.lit("`./p"), (p % 7).cast("string"), F.lit("/${x"), p.cast("string"), F.lit("}${y}."), ext, F.lit("`"))
    glob = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\$\{[^}]*\}", "*"), r"\*+", "*"), "^`|`$", "")
    return table(spark, sf, "pages").select(glob.alias("glob"), "page_id")


@query("src11_data_urls", "SELECT page_id, ['text/html', 'text/plain', 'image/svg+xml'][page_id % 3 + 1] AS mime, page_id % 2 = 0 AS is_base64, url AS payload FROM pages")
def src11(spark, sf):
    u = F.col("url")
    mime = F.element_at(F.array(F.lit("text/html"), F.lit("text/plain"), F.lit("image/svg+xml")), (F.col("page_id") % 3 + 1).cast("int"))
    made = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(u.cast("binary")), "\r\n", ""))).otherwise(F.concat(F.lit("data:"), mime, F.lit(";x=1,"), X.percent_encode(u)))
    pages = table(spark, sf, "pages").select("page_id", made.alias("d"))
    return pages.select("page_id", *[c.alias(n) for n, c in X.parse_data_url(F.col("d")).items()])


@query("src12_json_exports", "SELECT event_id, 'k' AS key, (props::JSON ->> 'k')::DOUBLE AS number FROM events")
def src12(spark, sf):
    """Top-level keys of a JSON document with numbers as doubles."""
    keys = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.explode(keys).alias("key", "value")).select("event_id", "key", F.col("value").cast("double").alias("number"))


@query("src14_aliases", M + "SELECT module_idx, CASE WHEN starts_with(id, '/repo/src/LARGE') THEN '@large' || substr(id, 16) WHEN starts_with(id, '/repo/src/') THEN '@' || substr(id, 10) ELSE id END AS alias FROM modules")
def src14(spark, sf):
    """Rules in order; the first whose pattern matches rewrites."""
    out = F.col("id")
    for find, put in reversed([("/repo/src/LARGE", "@large"), ("/repo/src/", "@/")]):
        out = F.when(F.col("id").startswith(find), F.concat(F.lit(put), F.substring("id", len(find) + 1, 1 << 30))).otherwise(out)
    return D.modules(spark, sf).select("module_idx", out.alias("alias"))


# Sinks ----------------------------------------------------------------------------------------------------------------------


@query("snk1_write_outputs", M + "SELECT module_type, count(*) AS n, sum(size)::BIGINT AS size FROM modules GROUP BY module_type")
def snk1(spark, sf):
    """Written by type below the shared folder, and read again."""
    at = shared_path(spark, "outputs")
    write_outputs(D.modules(spark, sf).select("module_type", "id", "size"), at, ["module_type"])
    return spark.read.parquet(at).groupBy("module_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("snk8_copy_assets", None)
def snk8(spark, sf):
    """Files passed through byte by byte, each by the task that reads it."""
    at = shared_path(spark, "copies")
    if "://" in at and not at.startswith("file:"):
        raise ValueError("copies need a mounted shared folder")
    copied = copy_files(files(spark, sf, "*.parquet"), sf, "/" + at.removeprefix("file:").lstrip("/"))
    return copied.select("file", "length")


@query("snk2_path_guard", M + "SELECT module_idx, module_idx % 6 <> 0 AS allowed FROM modules")
def snk2(spark, sf):
    """Is a file name below the output folder, and free of NUL?"""
    name = F.when(F.col("module_idx") % 6 == 0, F.concat(F.lit("a/../../"), F.col("module_type"))).otherwise(F.concat(F.lit("a/../b/"), F.col("module_type")))
    depth = F.aggregate(F.split(name, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda s, p: F.struct(F.when(p == "..", s.d - 1).when(p.isin("", "."), s.d).otherwise(s.d + 1).alias("d"), F.least(s.low, F.when(p == "..", s.d - 1).otherwise(s.d)).alias("low")))
    return D.modules(spark, sf).select("module_idx", ((depth.low >= 0) & ~F.contains(name, F.lit("\0")) & ~name.startswith("/")).alias("allowed"))


@query("snk3_asset_dedup", "SELECT sha256(text) AS hash, arg_min('d' || doc_id, struct_pack(a := length('d' || doc_id), b := 'd' || doc_id)) AS name, list('d' || doc_id ORDER BY doc_id) AS names FROM documents GROUP BY sha256(text)")
def snk3(spark, sf):
    """Equal contents are one asset, under its shortest name."""
    docs = table(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("n"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "n"))), lambda s: s.n)
    return docs.groupBy("hash").agg(F.min_by("n", F.struct(F.length("n"), "n")).alias("name"), names.alias("names"))


@query("snk4_manifest", M + "SELECT package_id AS key, arg_min(id, struct_pack(a := CASE module_type WHEN 'js' THEN 0 ELSE 1 END, b := id)) AS file, count(*) AS candidates FROM modules GROUP BY package_id")
def snk4(spark, sf):
    """One file a key, code before assets."""
    return D.modules(spark, sf).groupBy(F.col("package_id").alias("key")).agg(F.min_by("id", F.struct((F.col("module_type") != "js").cast("int"), "id")).alias("file"), F.count(F.lit(1)).alias("candidates"))


@query("snk5_import_map", M + "SELECT package_id, map_from_entries(list(struct_pack(k := substr(id, 7), v := substr(sha256(id), 1, 8)) ORDER BY id)) AS imports FROM modules GROUP BY package_id")
def snk5(spark, sf):
    pair = F.struct(F.substring("id", 7, 1 << 30).alias("k"), F.substring(F.sha2(F.col("id").cast("binary"), 256), 1, 8).alias("v"))
    return D.modules(spark, sf).groupBy("package_id").agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("imports"))


@query("snk6_string_dictionary", "SELECT sha256(text) AS hash, count(*) AS uses, bool_or(length(text) > 10240) AS referenced FROM documents WHERE length(text) > 5120 GROUP BY sha256(text)")
def snk6(spark, sf):
    """Long strings go once to a side table; the longest are replaced by their reference."""
    t = F.col("text")
    return table(spark, sf, "documents").where(F.char_length(t) > 5120).groupBy(F.sha2(t.cast("binary"), 256).alias("hash")).agg(F.count(F.lit(1)).alias("uses"), F.bool_or(F.char_length(t) > 10240).alias("referenced"))


@query("snk7_json_report", M + "SELECT package_id, '{\"modules\":' || count(*) || ',\"size\":' || sum(size) || '}' AS report FROM modules GROUP BY package_id")
def snk7(spark, sf):
    return D.modules(spark, sf).groupBy("package_id").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("modules"), F.sum("size").alias("size"))).alias("report"))


@query("snk9_reference_rewrite", M + "SELECT module_idx, 'url(../' || substr(id, 11) || ')' AS code FROM modules")
def snk9(spark, sf):
    """Placeholders become paths relative to the chunk: references found by a join, replaced in the row."""
    mod = D.modules(spark, sf)
    code = mod.select("module_idx", F.concat(F.lit("url(__REF_"), F.col("module_idx").cast("string"), F.lit("__)")).alias("code"))
    refs = code.select("*", F.regexp_extract("code", r"__REF_(\d+)__", 1).cast("bigint").alias("ref"))
    named = refs.join(mod.select(F.col("module_idx").alias("ref"), X.relative_path(F.col("id"), F.lit("/repo/src/out")).alias("to")), "ref")
    return named.select("module_idx", F.replace("code", F.concat(F.lit("__REF_"), F.col("ref").cast("string"), F.lit("__")), F.col("to")).alias("code"))


# Joins ----------------------------------------------------------------------------------------------------------------------


@query("jn1_edge_vertex", with_(MODULES, RECORDS) + "SELECT r.importer, r.rec_idx, m.id, m.size FROM import_records r JOIN modules m ON m.module_idx = r.importee")
def jn1(spark, sf):
    return D.import_records(spark, sf).join(D.modules(spark, sf), F.col("importee") == F.col("module_idx")).select("importer", "rec_idx", "id", "size")


@query("jn2_chunk_edges", G + "SELECT DISTINCT a.chunk_idx AS src, b.chunk_idx AS dst FROM import_records r JOIN chunk_modules a ON a.module_idx = r.importer JOIN chunk_modules b ON b.module_idx = r.importee WHERE a.chunk_idx <> b.chunk_idx")
def jn2(spark, sf):
    return chunk_edges(D.import_records(spark, sf), _chunks(spark, sf))


BIND = """exports AS (SELECT module_idx, 'e' || k AS name FROM modules, (SELECT unnest([0, 1]) AS k) WHERE (module_idx + k) % 3 <> 0),
imports AS (SELECT importer, rec_idx, importee, CASE WHEN rec_idx % 5 = 4 THEN '*' ELSE 'e' || rec_idx % 3 END AS name FROM import_records WHERE kind = 'import-statement')"""


@query("jn3_binding", with_(MODULES, RECORDS, BIND) + "SELECT i.importer, i.rec_idx, CASE WHEN i.name = '*' THEN 'Namespace' WHEN e.name IS NOT NULL THEN 'Normal' ELSE 'NoMatch' END AS status FROM imports i LEFT JOIN exports e ON e.module_idx = i.importee AND e.name = i.name")
def jn3(spark, sf):
    e = exports(D.modules(spark, sf)).select(F.col("module_idx").alias("importee"), "name", F.lit(True).alias("found"))
    got = imports(D.import_records(spark, sf)).join(e, ["importee", "name"], "left")
    return got.select("importer", "rec_idx", F.when(F.col("name") == "*", "Namespace").when(F.col("found"), "Normal").otherwise("NoMatch").alias("status"))


STAR = """stars AS (SELECT DISTINCT importer AS src, importee AS dst FROM import_records WHERE is_export_star AND importer <> importee),
via AS (SELECT module_idx AS root, module_idx AS origin, name FROM exports WHERE name <> 'default'
  UNION SELECT s.src, v.origin, v.name FROM via v JOIN stars s ON s.dst = v.root WHERE NOT EXISTS (SELECT 1 FROM exports o WHERE o.module_idx = s.src AND o.name = v.name))"""


def _stars(spark, sf):
    stars = D.import_records(spark, sf).where("is_export_star and importer <> importee").select(F.col("importer").alias("src"), F.col("importee").alias("dst")).distinct()
    return star_exports(exports(D.modules(spark, sf)), stars)


@query("jn4_star_exports", with_(MODULES, RECORDS, BIND, STAR, recursive=True) + "SELECT root, name, count(DISTINCT origin) AS origins, count(DISTINCT origin) > 1 AS ambiguous FROM via GROUP BY root, name")
def jn4(spark, sf):
    return _stars(spark, sf).groupBy("root", "name").agg(F.count_distinct("origin").alias("origins")).withColumn("ambiguous", F.col("origins") > 1)


@query("jn5_unambiguous", with_(MODULES, RECORDS, BIND, STAR, recursive=True) + "SELECT root, name, min(origin % 50) AS canonical FROM via GROUP BY root, name HAVING count(DISTINCT origin % 50) = 1")
def jn5(spark, sf):
    """Names whose candidates are one after canonicalisation (here: origin mod 50)."""
    c = F.col("origin") % 50
    return _stars(spark, sf).groupBy("root", "name").agg(F.min(c).alias("canonical"), F.count_distinct(c).alias("n")).where("n = 1").drop("n")


@query("jn6_referencing_constants", with_(MODULES, RECORDS) + "SELECT m.module_idx FROM modules m WHERE EXISTS (SELECT 1 FROM import_records r WHERE r.importer = m.module_idx AND r.importee % 8 = 0)")
def jn6(spark, sf):
    return D.modules(spark, sf).select("module_idx").join(D.import_records(spark, sf).where("importee % 8 = 0").select(F.col("importer").alias("module_idx")), "module_idx", "left_semi")


@query("jn7_unassigned", G + "SELECT m.module_idx FROM modules m WHERE m.module_idx NOT IN (SELECT module_idx FROM chunk_modules)")
def jn7(spark, sf):
    return D.modules(spark, sf).select("module_idx").join(unsent(_chunks(spark, sf)), "module_idx", "left_anti")


SHIP = """clients AS (SELECT DISTINCT user_id % 20 AS client FROM events), affected AS (SELECT module_idx FROM modules WHERE module_idx % 3 = 0),
shipped AS (SELECT client, module_idx, (module_idx + client) % 7 AS stamp FROM clients, modules WHERE (module_idx + client) % 4 <> 0)"""


@query("jn8_client_needs", with_(MODULES, SHIP) + "SELECT c.client, m.module_idx FROM clients c CROSS JOIN modules m LEFT JOIN shipped s ON s.client = c.client AND s.module_idx = m.module_idx WHERE (m.module_idx % 3 = 0 AND s.stamp IS NULL) OR m.module_idx % 6 > s.stamp")
def jn8(spark, sf):
    """Modules to carry to a client: affected ones it lacks, and stale ones. Every client is asked about every module."""
    return client_needs(*_ships(spark, sf))


def _ships(spark, sf):
    mod = D.modules(spark, sf).select("module_idx", (F.col("module_idx") % 6).alias("latest"), (F.col("module_idx") % 3 == 0).alias("affected"))
    clients = table(spark, sf, "events").select((F.col("user_id") % 20).alias("client")).distinct()
    s = (F.col("module_idx") + F.col("client")) % 7
    shipped = clients.join(mod, F.lit(True)).where("(module_idx + client) % 4 <> 0").select("client", "module_idx", s.alias("stamp"))
    return clients, mod, shipped


@query("jn9_by_dependency_file", R[:-1] + " SELECT DISTINCT r.importer AS module_idx FROM import_records r JOIN events e ON e.user_id = r.importee WHERE e.event_type = 'error'")
def jn9(spark, sf):
    deps = D.import_records(spark, sf).groupBy(F.col("importer").alias("module_idx")).agg(F.collect_set("importee").alias("deps"))
    changed = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("path")).distinct()
    return deps.select("module_idx", F.explode("deps").alias("path")).join(changed, "path").select("module_idx").distinct()


@query("jn10_as_of", """SELECT e.event_id, e.user_id, e.ts, (SELECT max_by(o.event_id, (o.ts, o.event_id)) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'signup' AND o.ts <= e.ts) AS before FROM events e WHERE e.event_type <> 'signup'""")
def jn10(spark, sf):
    ev = table(spark, sf, "events")
    marks = ev.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("before"))
    return as_of(ev.where("event_type <> 'signup'").select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", "before")


@query("jn11_cross_chunk_symbols", G + "SELECT a.chunk_idx, b.chunk_idx AS owner, list(DISTINCT r.importee ORDER BY r.importee) AS symbols FROM import_records r JOIN chunk_modules a ON a.module_idx = r.importer JOIN chunk_modules b ON b.module_idx = r.importee WHERE a.chunk_idx <> b.chunk_idx GROUP BY ALL")
def jn11(spark, sf):
    ch = _chunks(spark, sf)
    a, b = ch.select(F.col("module_idx").alias("importer"), "chunk_idx"), ch.select(F.col("module_idx").alias("importee"), F.col("chunk_idx").alias("owner"))
    return D.import_records(spark, sf).join(unsent(a), "importer").join(unsent(b), "importee").where("chunk_idx <> owner").groupBy("chunk_idx", "owner").agg(F.sort_array(F.collect_set("importee")).alias("symbols"))


@query("jn12_ineffective_dynamic", G + "SELECT DISTINCT d.importee FROM import_records d JOIN chunk_modules a ON a.module_idx = d.importer JOIN chunk_modules b ON b.module_idx = d.importee AND b.chunk_idx = a.chunk_idx WHERE d.kind = 'dynamic-import' AND d.importee IN (SELECT importee FROM import_records WHERE kind <> 'dynamic-import')")
def jn12(spark, sf):
    ch, rec = _chunks(spark, sf), D.import_records(spark, sf)
    a, b = ch.select(F.col("module_idx").alias("importer"), F.col("chunk_idx").alias("x")), ch.select(F.col("module_idx").alias("importee"), F.col("chunk_idx").alias("y"))
    dyn = rec.where("kind = 'dynamic-import'").join(unsent(a), "importer").join(unsent(b), "importee").where("x = y")
    return dyn.join(rec.where("kind <> 'dynamic-import'").select("importee"), "importee", "left_semi").select("importee").distinct()


@query("jn13_placeholder_edges", R[:-1] + " SELECT DISTINCT importer AS src, importee AS dst FROM import_records WHERE kind = 'import-statement'")
def jn13(spark, sf):
    """Texts that hold other chunks' placeholders depend on them."""
    texts = D.import_records(spark, sf).where("kind = 'import-statement'").groupBy("importer").agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit("!~{"), F.col("importee").cast("string"), F.lit("}~")))).alias("code"))
    return texts.select(F.col("importer").alias("src"), F.explode(F.regexp_extract_all("code", F.lit(r"!~\{(\d+)\}~"), 1)).alias("dst")).select("src", F.col("dst").cast("bigint").alias("dst")).distinct()


@query("jn14_common_chunks", G + "SELECT chunk_idx, count(*) AS modules, any_value(len(entry_set)) AS entries, any_value(len(entry_set)) > 1 AS common FROM chunk_modules GROUP BY chunk_idx")
def jn14(spark, sf):
    return _chunks(spark, sf).groupBy("chunk_idx").agg(F.count(F.lit(1)).alias("modules"), F.first(F.size("entry_set")).alias("entries")).withColumn("common", F.col("entries") > 1)


@query("jn15_enriched_dependencies", with_(RECORDS) + "SELECT importer AS module_idx, importee AS dep FROM import_records UNION SELECT importer, importee % 20 + 1 FROM import_records WHERE rec_idx % 2 = 0 UNION SELECT importer, 1 FROM import_records WHERE kind = 'require-call'")
def jn15(spark, sf):
    """Dependencies, owners of what is referenced, and the runtime where helpers are used."""
    rec = D.import_records(spark, sf)
    parts = [rec.select(F.col("importer").alias("module_idx"), F.col("importee").alias("dep")), rec.where("rec_idx % 2 = 0").select(F.col("importer").alias("module_idx"), (F.col("importee") % 20 + 1).alias("dep")), rec.where("kind = 'require-call'").select(F.col("importer").alias("module_idx"), F.lit(1).cast("bigint").alias("dep"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("jn16_needed_symbols", with_(MODULES, RECORDS) + "SELECT r.importer, r.rec_idx, CASE WHEN m.is_external THEN 'external' WHEN r.kind = 'require-call' THEN 'wrapper' WHEN r.is_export_star THEN 'namespace' ELSE 'plain' END AS needs FROM import_records r JOIN modules m ON m.module_idx = r.importee")
def jn16(spark, sf):
    needs = F.when(F.col("is_external"), "external").when(F.col("kind") == "require-call", "wrapper").when(F.col("is_export_star"), "namespace").otherwise("plain")
    return D.import_records(spark, sf).join(D.modules(spark, sf), F.col("importee") == F.col("module_idx")).select("importer", "rec_idx", needs.alias("needs"))


@query("jn17_exports_kind", with_(RECORDS) + "SELECT importee AS module_idx, CASE arg_min(kind, struct_pack(a := importer, b := rec_idx)) WHEN 'require-call' THEN 'CommonJs' ELSE 'Esm' END AS exports_kind FROM import_records WHERE kind <> 'dynamic-import' GROUP BY importee")
def jn17(spark, sf):
    """The first deciding edge in scan order."""
    first = F.min_by("kind", F.struct("importer", "rec_idx"))
    return D.import_records(spark, sf).where("kind <> 'dynamic-import'").groupBy(F.col("importee").alias("module_idx")).agg(F.when(first == "require-call", "CommonJs").otherwise("Esm").alias("exports_kind"))


# Aggregates -----------------------------------------------------------------------------------------------------------------


@query("ag1_chunks_by_entries", G + "SELECT chunk_idx, list(module_idx ORDER BY module_idx) AS modules, sum(size)::BIGINT AS size FROM chunk_modules GROUP BY chunk_idx")
def ag1(spark, sf):
    return _chunks(spark, sf).groupBy("chunk_idx").agg(F.sort_array(F.collect_list("module_idx")).alias("modules"), F.sum("size").alias("size"))


MERGE = """shared AS (SELECT DISTINCT chunk_idx, entry_set FROM chunk_modules WHERE len(entry_set) > 1),
member AS (SELECT s.chunk_idx, e.* FROM (SELECT chunk_idx, unnest(entry_set) AS entry_idx FROM shared) s JOIN entries e USING (entry_idx)),
sizes AS (SELECT chunk_idx, count(*) FILTER (WHERE kind = 0) AS users FROM member GROUP BY chunk_idx),
grp AS (SELECT m.*, s.users FROM member m JOIN sizes s USING (chunk_idx) WHERE s.users = 0 OR m.kind = 0),
tgt AS (SELECT g.chunk_idx, min(g.entry_idx) AS t FROM grp g WHERE NOT EXISTS (SELECT 1 FROM grp o WHERE o.chunk_idx = g.chunk_idx AND o.entry_idx <> g.entry_idx
  AND NOT EXISTS (SELECT 1 FROM import_records r WHERE r.importer = o.module_idx AND r.importee = g.module_idx AND r.kind <> 'dynamic-import')) GROUP BY g.chunk_idx),
plan AS (SELECT s.chunk_idx, s.users, t.t FROM sizes s LEFT JOIN tgt t USING (chunk_idx)),
reached AS (SELECT DISTINCT r.entry_idx, d.entry_idx AS d FROM reach r JOIN entries u ON u.entry_idx = r.entry_idx AND u.kind = 0 JOIN entries d ON d.module_idx = r.module_idx AND d.kind = 1),
inside AS (SELECT p.chunk_idx, p.t, m.entry_idx AS d FROM plan p JOIN member m ON m.chunk_idx = p.chunk_idx AND m.kind = 1 WHERE p.users > 0 AND p.t IS NOT NULL),
effects AS (SELECT c.entry_set[1] AS t FROM chunk_modules c JOIN modules m USING (module_idx) WHERE len(c.entry_set) = 1 GROUP BY 1 HAVING bool_or(m.has_side_effects)),
judged AS (SELECT p.*,
  EXISTS (SELECT 1 FROM inside i WHERE i.chunk_idx = p.chunk_idx AND NOT EXISTS (SELECT 1 FROM reached r WHERE r.entry_idx = p.t AND r.d = i.d)) AS unreached,
  EXISTS (SELECT 1 FROM inside i JOIN reached r ON r.d = i.d AND r.entry_idx <> i.t JOIN effects e ON e.t = i.t WHERE i.chunk_idx = p.chunk_idx) AS leaks,
  EXISTS (SELECT 1 FROM chunk_modules c JOIN entries d ON d.module_idx = c.module_idx AND d.kind = 1 JOIN import_records r ON r.importee = c.module_idx AND r.kind = 'dynamic-import' LEFT JOIN chunk_modules h ON h.module_idx = r.importer
    WHERE p.users > 0 AND c.chunk_idx = p.chunk_idx AND NOT coalesce(h.entry_set = [p.t], false) AND NOT coalesce(h.chunk_idx = p.chunk_idx AND h.module_idx NOT IN (SELECT module_idx FROM entries WHERE kind = 1), false)) AS importers,
  EXISTS (SELECT 1 FROM chunk_modules c JOIN member m ON m.module_idx = c.module_idx AND m.chunk_idx = c.chunk_idx AND m.kind = 1 WHERE p.users = 0 AND c.chunk_idx = p.chunk_idx AND m.entry_idx <> p.t) AS pollutes FROM plan p),
verdicts AS (SELECT chunk_idx, t, CASE WHEN t IS NULL THEN 'no_target' WHEN pollutes THEN 'pollutes' WHEN unreached THEN 'unreached' WHEN leaks THEN 'leaks' WHEN importers THEN 'importers' ELSE 'merged' END AS verdict FROM judged)"""


@query("co1_merge_targets", with_(MODULES, RECORDS, ENTRIES, REACH, CHUNKS, MERGE, recursive=True) + "SELECT chunk_idx, CASE WHEN verdict = 'merged' THEN t END AS target, verdict FROM verdicts")
def co1(spark, sf):
    """Shared chunks that may be folded into an entry, before the sequential test of each merge for cycles."""
    rec, ent = kept(D.import_records(spark, sf)), kept(D.entries(spark, sf))
    reached = reach(ent, edges_of(rec))
    return merge_targets(chunk_modules(D.modules(spark, sf), rec, ent, reached), rec, ent, reached)


RULES = [(0, "steel", "STEEL", 10, 0, 3000), (1, "large", "LARGE", 20, 500, 1 << 40), (2, "any", "", 0, 0, 1 << 40)]
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in RULES) + ") t(rule_idx, name, test, priority, min_size, max_size))"


def _rules(spark):
    return spark.createDataFrame(RULES, "rule_idx int, name string, test string, priority int, min_size long, max_size long")


@query("ag2_manual_groups", with_(MODULES, RULES_SQL) + "SELECT rule_idx, name, count(*) AS n, sum(size)::BIGINT AS size FROM modules JOIN rules ON contains(id, test) AND size BETWEEN min_size AND max_size GROUP BY rule_idx, name")
def ag2(spark, sf):
    return match_rules(D.modules(spark, sf), _rules(spark)).groupBy("rule_idx", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("ag3_entry_aware_groups", with_(MODULES, RECORDS, ENTRIES, REACH, CHUNKS, RULES_SQL, recursive=True) + "SELECT rule_idx, name, entry_set, sum(size)::BIGINT AS size FROM chunk_modules JOIN rules ON contains(id, test) AND size BETWEEN min_size AND max_size GROUP BY ALL")
def ag3(spark, sf):
    return match_rules(_chunks(spark, sf), _rules(spark)).groupBy("rule_idx", "name", "entry_set").agg(F.sum("size").alias("size"))


@query("ag4_merge_small_groups", None)
def ag4(spark, sf):
    """Sequential by nature: each rule's groups (entry sets, not modules) go to one task."""
    sets = ag3(spark, sf).withColumn("key", F.array_join(F.col("entry_set").cast("array<string>"), ","))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = merge_small(pdf, 5000)
        out.insert(0, "rule_idx", pdf["rule_idx"].iloc[0])
        return out

    return sets.groupBy("rule_idx").applyInPandas(run, "rule_idx int, key string, entry_set array<long>, size double, merged long")


@query("ag5_priority_assignment", with_(MODULES, RULES_SQL) + "SELECT module_idx, name FROM (SELECT module_idx, name, row_number() OVER (PARTITION BY module_idx ORDER BY priority DESC, rule_idx, name) AS r FROM modules JOIN rules ON contains(id, test) AND size BETWEEN min_size AND max_size) WHERE r = 1")
def ag5(spark, sf):
    """Each module's first rule; as an aggregate, so partial results are combined before the shuffle."""
    return match_rules(D.modules(spark, sf), _rules(spark)).groupBy("module_idx").agg(F.min_by("name", F.struct(-F.col("priority"), "rule_idx", "name")).alias("name"))


@query("ag6_packages", G + "SELECT m.package_id, count(*) AS modules, sum(m.size)::BIGINT AS size, list(DISTINCT c.chunk_idx ORDER BY c.chunk_idx) FILTER (WHERE c.chunk_idx IS NOT NULL) AS chunks, bool_or(c.chunk_idx IS NOT NULL) AS used FROM modules m LEFT JOIN chunk_modules c USING (module_idx) GROUP BY m.package_id")
def ag6(spark, sf):
    ch = _chunks(spark, sf).select("module_idx", "chunk_idx")
    chunks = F.sort_array(F.collect_set("chunk_idx"))
    return D.modules(spark, sf).join(unsent(ch), "module_idx", "left").groupBy("package_id").agg(F.count(F.lit(1)).alias("modules"), F.sum("size").alias("size"), F.when(F.size(chunks) > 0, chunks).alias("chunks"), F.bool_or(F.col("chunk_idx").isNotNull()).alias("used"))


@query("ag7_importers", R[:-1] + " SELECT importee AS module_idx, list(DISTINCT importer ORDER BY importer) AS importers FROM import_records GROUP BY importee")
def ag7(spark, sf):
    return D.import_records(spark, sf).groupBy(F.col("importee").alias("module_idx")).agg(F.sort_array(F.collect_set("importer")).alias("importers"))


@query("ag8_transitive_hash", G + "SELECT r.entry_idx, sha256(string_agg(sha256(m.id), ',' ORDER BY sha256(m.id))) AS hash FROM reach r JOIN modules m USING (module_idx) GROUP BY r.entry_idx")
def ag8(spark, sf):
    own = D.modules(spark, sf).select("module_idx", F.sha2(F.col("id").cast("binary"), 256).alias("h"))
    found = reach(D.entries(spark, sf), edges_of(D.import_records(spark, sf))).join(own, "module_idx")
    return found.groupBy("entry_idx").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("h"))).cast("binary"), 256).alias("hash"))


@query("ag9_scans", M + "SELECT max(length(id)) AS longest, max(size) AS largest, sum(size)::BIGINT AS total, bool_or(size > 4900) AS any_large FROM modules")
def ag9(spark, sf):
    return D.modules(spark, sf).agg(F.max(F.char_length("id").cast("long")).alias("longest"), F.max("size").alias("largest"), F.sum("size").alias("total"), F.bool_or(F.col("size") > 4900).alias("any_large"))


@query("ag10_grouped_report", M + "SELECT CASE module_type WHEN 'js' THEN 0 WHEN 'ts' THEN 0 WHEN 'css' THEN 1 ELSE 2 END AS grp, id, size, row_number() OVER (PARTITION BY CASE module_type WHEN 'js' THEN 0 WHEN 'ts' THEN 0 WHEN 'css' THEN 1 ELSE 2 END, package_id ORDER BY size, id) AS pos FROM modules")
def ag10(spark, sf):
    grp = F.when(F.col("module_type").isin("js", "ts"), 0).when(F.col("module_type") == "css", 1).otherwise(2)
    return D.modules(spark, sf).select(grp.alias("grp"), "id", "size", F.row_number().over(Window.partitionBy(grp, "package_id").orderBy("size", "id")).alias("pos"))


@query("ag11_compressed_size", None)
def ag11(spark, sf):
    import zlib

    @F.pandas_udf("long")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: len(zlib.compress((t or "").encode(), 9, 31)))

    return table(spark, sf, "documents").select("doc_id", packed("text").alias("gzip"))


SWEEP = """points AS (SELECT owner, hook, start_us AS t, 1 AS d FROM calls UNION ALL SELECT owner, hook, end_us, -1 FROM calls),
steps AS (SELECT owner, hook, t, sum(d) AS d FROM points GROUP BY ALL),
flight AS (SELECT owner, hook, t, sum(d) OVER (PARTITION BY owner, hook ORDER BY t) AS n, lead(t) OVER (PARTITION BY owner, hook ORDER BY t) - t AS dt FROM steps)"""


@query("ag12_hook_costs", with_(D.CALLS, SWEEP) + "SELECT owner, hook, (SELECT count(*) FROM calls c WHERE c.owner = f.owner AND c.hook = f.hook) AS calls, max(n)::BIGINT AS most, coalesce(sum(greatest(n - 1, 0) * dt), 0)::BIGINT AS overlap FROM flight f GROUP BY owner, hook")
def ag12(spark, sf):
    calls = kept(D.hook_calls(spark, sf).select("owner", "hook", "start_us", "end_us"))
    n = calls.groupBy("owner", "hook").agg(F.count(F.lit(1)).alias("calls"))
    return in_flight(calls, ["owner", "hook"]).groupBy("owner", "hook").agg(F.max("n").alias("most"), F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0)) * F.col("dt")), F.lit(0)).alias("overlap")).join(n, ["owner", "hook"])


@query("ag13_busy_time", with_(D.CALLS, SWEEP) + "SELECT owner, hook, sum(CASE WHEN n > 0 THEN dt ELSE 0 END)::BIGINT AS busy FROM flight GROUP BY owner, hook")
def ag13(spark, sf):
    """The length of the union of spans."""
    return in_flight(D.hook_calls(spark, sf), ["owner", "hook"]).groupBy("owner", "hook").agg(F.sum(F.when(F.col("n") > 0, F.col("dt")).otherwise(0)).alias("busy"))


@query("ag14_min_by", with_(MODULES, RECORDS) + "SELECT r.importee, arg_min(m.id, struct_pack(a := m.size, b := m.id)) AS name FROM import_records r JOIN modules m ON m.module_idx = r.importer GROUP BY r.importee")
def ag14(spark, sf):
    return D.import_records(spark, sf).join(D.modules(spark, sf), F.col("importer") == F.col("module_idx")).groupBy("importee").agg(F.min_by("id", F.struct("size", "id")).alias("name"))


@query("ag15_conflicts", with_(RECORDS, "per AS (SELECT 'n' || importee % 40 AS name, importer, list(DISTINCT importee % 6 ORDER BY importee % 6) AS refs FROM import_records GROUP BY ALL)") + "SELECT name, refs, min(importer) AS first, count(*) AS n FROM per GROUP BY name, refs")
def ag15(spark, sf):
    per = D.import_records(spark, sf).groupBy(F.concat(F.lit("n"), (F.col("importee") % 40).cast("string")).alias("name"), "importer").agg(F.sort_array(F.collect_set(F.col("importee") % 6)).alias("refs"))
    return per.groupBy("name", "refs").agg(F.min("importer").alias("first"), F.count(F.lit(1)).alias("n"))


@query("ag16_external_merging", with_(MODULES, RECORDS) + "SELECT m.package_id, r.importee, r.importer, first_value(r.importer) OVER (PARTITION BY m.package_id, r.importee ORDER BY r.importer, r.rec_idx) AS linked FROM import_records r JOIN modules m ON m.module_idx = r.importer")
def ag16(spark, sf):
    """All of a chunk's uses of an external link to the first one."""
    w = Window.partitionBy("package_id", "importee").orderBy("importer", "rec_idx")
    return D.import_records(spark, sf).join(D.modules(spark, sf), F.col("importer") == F.col("module_idx")).select("package_id", "importee", "importer", F.first("importer").over(w).alias("linked"))


@query("ag17_common_directory", with_(MODULES, """segs AS (SELECT module_type, unnest(string_split(id, '/')[1:-2]) AS seg, generate_subscripts(string_split(id, '/')[1:-2], 1) AS i FROM modules),
n AS (SELECT module_type, count(*) AS n FROM modules GROUP BY module_type),
same AS (SELECT module_type, i, min(seg) AS seg, count(DISTINCT seg) = 1 AND count(*) = any_value(n) AS same FROM segs JOIN n USING (module_type) GROUP BY module_type, i),
upto AS (SELECT *, bool_and(same) OVER (PARTITION BY module_type ORDER BY i) AS shared FROM same)""") + "SELECT module_type, string_agg(seg, '/' ORDER BY i) FILTER (WHERE shared) AS dir FROM upto GROUP BY module_type")
def ag17(spark, sf):
    """Only the least and the greatest path of a group are needed."""
    return D.modules(spark, sf).groupBy("module_type").agg(X.common_directory(F.array(F.min("id"), F.max("id"))).alias("dir"))


# Ordered scans --------------------------------------------------------------------------------------------------------------


@query("wn1_exec_order", M + "SELECT module_idx, package_id, row_number() OVER (PARTITION BY package_id ORDER BY size DESC, id) - 1 AS exec_order FROM modules")
def wn1(spark, sf):
    return D.modules(spark, sf).select("module_idx", "package_id", (F.row_number().over(Window.partitionBy("package_id").orderBy(F.desc("size"), "id")) - 1).alias("exec_order"))


@query("wn2_premature", M + "SELECT module_idx, coalesce(size < max(size) OVER (PARTITION BY package_id ORDER BY module_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS premature FROM modules")
def wn2(spark, sf):
    w = Window.partitionBy("package_id").orderBy("module_idx").rowsBetween(Window.unboundedPreceding, -1)
    return D.modules(spark, sf).select("module_idx", F.coalesce(F.col("size") < F.max("size").over(w), F.lit(False)).alias("premature"))


@query("wn3_order_difference", M[:-1] + """, x AS (SELECT module_idx, package_id, size FROM modules WHERE module_idx % 4 <> 1), a AS (SELECT module_idx FROM modules WHERE module_idx % 4 <> 2),
p AS (SELECT x.module_idx, coalesce(size < max(size) OVER (PARTITION BY package_id ORDER BY x.module_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS premature FROM x JOIN a USING (module_idx))
SELECT coalesce(x.module_idx, a.module_idx) AS module_idx FROM x FULL JOIN a USING (module_idx) LEFT JOIN p USING (module_idx) WHERE x.module_idx IS NULL OR a.module_idx IS NULL OR p.premature""")
def wn3(spark, sf):
    """At risk: in one order only, or too early in the other."""
    mod = D.modules(spark, sf)
    x, a = mod.where("module_idx % 4 <> 1").select("module_idx", "package_id", "size"), mod.where("module_idx % 4 <> 2").select("module_idx", F.lit(True).alias("actual"))
    w = Window.partitionBy("package_id").orderBy("module_idx").rowsBetween(Window.unboundedPreceding, -1)
    both = x.join(a, "module_idx").where(F.lit(True)).withColumn("premature", F.coalesce(F.col("size") < F.max("size").over(w), F.lit(False))).where("premature").select("module_idx")
    one = x.join(a, "module_idx", "full").where("actual is null or size is null").select("module_idx")
    return both.unionByName(one).distinct()


@query("wn4_prefix_sum", M + "SELECT module_idx, (sum(size) OVER (PARTITION BY package_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto FROM modules")
def wn4(spark, sf):
    return D.modules(spark, sf).select("module_idx", F.sum("size").over(Window.partitionBy("package_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query("wn5_lag_similarity", M[:-1] + """, p AS (SELECT module_idx, id, lag(id) OVER (PARTITION BY package_id ORDER BY id) AS prev FROM modules)
SELECT module_idx, list_sum(list_transform(range(1, least(length(id), length(prev)) + 1), lambda i: greatest(0, 10 - abs(ascii(substr(id, i, 1)) - ascii(substr(prev, i, 1))))))::BIGINT AS similarity FROM p WHERE prev IS NOT NULL""")
def wn5(spark, sf):
    rows = D.modules(spark, sf).withColumn("prev", F.lag("id").over(Window.partitionBy("package_id").orderBy("id"))).where("prev is not null")
    n = F.least(F.length("id"), F.length("prev"))
    at = lambda c, i: F.ascii(F.substr(F.col(c), i, F.lit(1)))
    return rows.select("module_idx", F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda s, i: s + F.greatest(F.lit(0), 10 - F.abs(at("id", i) - at("prev", i)))).alias("similarity"))


@query("wn6_best_split", None)
def wn6(spark, sf):
    """Sequential within a group; the list of a group's modules is its size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        at = best_split(pdf["id"].tolist(), pdf["size"].tolist(), 5000, 60000)
        return pd.DataFrame({"package_id": [pdf["package_id"].iloc[0]], "split": pd.array([at], "Int64"), "n": [len(pdf)]})

    return D.modules(spark, sf).select("package_id", "id", "size").groupBy("package_id").applyInPandas(run, "package_id string, split long, n long")


@query("wn7_chunk_order", G + "SELECT chunk_idx, row_number() OVER (ORDER BY min(module_idx), count(*) DESC, chunk_idx) - 1 AS exec_order FROM chunk_modules GROUP BY chunk_idx")
def wn7(spark, sf):
    """Chunks, of which there are few, by their first module."""
    lead = _chunks(spark, sf).groupBy("chunk_idx").agg(F.min("module_idx").alias("first"), F.count(F.lit(1)).alias("n"))
    return lead.select("chunk_idx", (F.row_number().over(Window.orderBy("first", F.desc("n"), "chunk_idx")) - 1).alias("exec_order"))


@query("wn8_module_order", G + "SELECT module_idx, chunk_idx, row_number() OVER (PARTITION BY chunk_idx ORDER BY CASE WHEN module_idx % 3 <> 0 THEN 0 ELSE 1 END, CASE WHEN module_idx % 3 <> 0 THEN id END, module_idx) AS pos FROM chunk_modules")
def wn8(spark, sf):
    """Leaves without side effects by id first, then the rest by order."""
    leaf = F.col("module_idx") % 3 != 0
    w = Window.partitionBy("chunk_idx").orderBy(F.when(leaf, 0).otherwise(1), F.when(leaf, F.col("id")), "module_idx")
    return _chunks(spark, sf).select("module_idx", "chunk_idx", F.row_number().over(w).alias("pos"))


@query("wn9_conflict_names", M + "SELECT module_idx, split_part(package_id, '#', 1) || CASE WHEN r = 0 THEN '' ELSE '$' || r END AS name FROM (SELECT *, row_number() OVER (PARTITION BY split_part(package_id, '#', 1) ORDER BY size DESC, id) - 1 AS r FROM modules)")
def wn9(spark, sf):
    """In order of size; names that may clash are alike but for a $ and digits at the end, and those are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id"], ascending=[False, True])
        return pd.DataFrame({"module_idx": pdf["module_idx"], "name": conflict_names(pdf["base"].tolist())})

    base = F.substring_index("package_id", "#", 1)
    rows = D.modules(spark, sf).select("module_idx", "size", "id", base.alias("base"), F.regexp_replace(base, r"(\$[0-9]+)+\z", "").alias("family"))
    return rows.groupBy("family").applyInPandas(run, "module_idx long, name string")


@query("wn10_unique_file_names", M + "SELECT module_idx, split_part(package_id, '#', 1) || CASE WHEN r = 1 THEN '' ELSE r::VARCHAR END || '.' || module_type AS file FROM (SELECT *, row_number() OVER (PARTITION BY split_part(package_id, '#', 1), module_type ORDER BY module_idx) AS r FROM modules)")
def wn10(spark, sf):
    """Each outcome depends on all before; names that may clash share a stem without its digits, which makes the groups.

    No name here holds digits or differs in case alone, so the SQL needs only a rank.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("module_idx")
        return pd.DataFrame({"module_idx": pdf["module_idx"], "file": unique_names(pdf["name"].tolist())})

    name = F.concat(F.substring_index("package_id", "#", 1), F.lit("."), F.col("module_type"))
    rows = D.modules(spark, sf).select("module_idx", name.alias("name")).withColumn("stem", F.lower(F.regexp_replace("name", r"[0-9]", "")))
    return rows.groupBy("stem").applyInPandas(run, "module_idx long, file string")


ALPHA = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ$_"


@query("wn11_minified_names", M + f"SELECT module_idx, substr('{ALPHA}', (module_idx % 54 + 1)::INT, 1) || CASE WHEN module_idx // 54 > 0 THEN substr('{ALPHA}0123456789', ((module_idx // 54 - 1) % 64 + 1)::INT, 1) ELSE '' END || CASE WHEN module_idx // 54 > 0 AND (module_idx // 54 - 1) // 64 > 0 THEN substr('{ALPHA}0123456789', (((module_idx // 54 - 1) // 64 - 1) % 64 + 1)::INT, 1) ELSE '' END AS name FROM modules")
def wn11(spark, sf):
    return D.modules(spark, sf).select("module_idx", X.minified_name(F.col("module_idx")).alias("name"))


# Sorts and sets -------------------------------------------------------------------------------------------------------------


@query("so1_entry_order", with_(ENTRIES) + "SELECT entry_idx, kind, row_number() OVER (ORDER BY kind, module_idx) AS pos FROM entries")
def so1(spark, sf):
    return D.entries(spark, sf).select("entry_idx", "kind", F.row_number().over(Window.orderBy("kind", "module_idx")).alias("pos"))


@query("so2_render_order", with_(ENTRIES) + "SELECT entry_idx, row_number() OVER (ORDER BY kind <> 0, CASE WHEN kind = 0 THEN entry_idx END, module_idx DESC) AS pos FROM entries")
def so2(spark, sf):
    w = Window.orderBy(F.col("kind") != 0, F.when(F.col("kind") == 0, F.col("entry_idx")), F.desc("module_idx"))
    return D.entries(spark, sf).select("entry_idx", F.row_number().over(w).alias("pos"))


@query("so3_top_costs", with_(D.CALLS) + "SELECT owner, ms, greatest((SELECT count(DISTINCT owner) FROM calls) - 12, 0) AS hidden FROM (SELECT owner, sum(end_us - start_us)::BIGINT // 1000 AS ms FROM calls GROUP BY owner) ORDER BY ms DESC, owner LIMIT 12")
def so3(spark, sf):
    """The twelve dearest owners, and how many aren't shown."""
    per = kept(D.hook_calls(spark, sf).groupBy("owner").agg(F.floor(F.sum(F.col("end_us") - F.col("start_us")) / 1000).alias("ms")))
    hidden = per.agg(F.greatest(F.count(F.lit(1)) - 12, F.lit(0)).alias("hidden"))
    return per.orderBy(F.desc("ms"), "owner").limit(12).join(hidden, F.lit(True))


@query("so4_largest_modules", M + "SELECT id, size, size * 100.0::DOUBLE / (SELECT sum(size) FROM modules) AS percent FROM modules ORDER BY size DESC, id LIMIT 20")
def so4(spark, sf):
    mod = D.modules(spark, sf)
    total = mod.agg(F.sum("size").alias("total"))
    return mod.orderBy(F.desc("size"), "id").limit(20).join(total, F.lit(True)).select("id", "size", (F.col("size") * 100.0 / F.col("total")).alias("percent"))


@query("so5_output_order", M + "SELECT id, row_number() OVER (PARTITION BY package_id ORDER BY CASE module_type WHEN 'js' THEN 0 WHEN 'ts' THEN 1 ELSE 2 END, id) AS pos FROM modules")
def so5(spark, sf):
    kind = F.when(F.col("module_type") == "js", 0).when(F.col("module_type") == "ts", 1).otherwise(2)
    return D.modules(spark, sf).select("id", F.row_number().over(Window.partitionBy("package_id").orderBy(kind, "id")).alias("pos"))


@query("se1_set_algebra", with_(RECORDS, "s AS (SELECT importer, list(DISTINCT importee % 16 ORDER BY importee % 16) AS a, list(DISTINCT rec_idx % 16 ORDER BY rec_idx % 16) AS b FROM import_records GROUP BY importer)") + "SELECT importer, list_sort(list_distinct(list_concat(a, b))) AS both, list_sort(list_intersect(a, b)) AS common, len(a) AS n FROM s")
def se1(spark, sf):
    s = D.import_records(spark, sf).groupBy("importer").agg(F.sort_array(F.collect_set((F.col("importee") % 16).cast("long"))).alias("a"), F.sort_array(F.collect_set((F.col("rec_idx") % 16).cast("long"))).alias("b"))
    return s.select("importer", F.sort_array(F.array_union("a", "b")).alias("both"), F.sort_array(F.array_intersect("a", "b")).alias("common"), F.size("a").alias("n"))


@query("se2_symmetric_difference", with_(RECORDS, "s AS (SELECT importer, bit_or(1::BIGINT << (importee % 60)::INT) AS a, bit_or(1::BIGINT << (rec_idx % 60)::INT) AS b FROM import_records GROUP BY importer)") + "SELECT importer, bit_count(xor(a, b))::INT AS n FROM s")
def se2(spark, sf):
    bit = lambda c: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(c) % 60).cast("int")))
    return D.import_records(spark, sf).groupBy("importer").agg(bit("importee").alias("a"), bit("rec_idx").alias("b")).select("importer", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("n"))


@query("se3_union", R[:-1] + " SELECT importer, importee FROM import_records WHERE kind <> 'dynamic-import' UNION SELECT importer, importee FROM import_records WHERE kind = 'dynamic-import'")
def se3(spark, sf):
    rec = D.import_records(spark, sf).select("importer", "importee", "kind")
    return rec.where("kind <> 'dynamic-import'").drop("kind").unionByName(rec.where("kind = 'dynamic-import'").drop("kind")).distinct()


@query("se4_demand", with_(RECORDS, "s AS (SELECT importer, CASE WHEN bool_or(is_export_star AND importee % 5 = 0) THEN NULL ELSE list(DISTINCT importee % 9) END AS asked, list(DISTINCT rec_idx % 9) AS had FROM import_records GROUP BY importer)") + "SELECT importer, asked IS NULL AS everything, list_sort(list_filter(asked, lambda x: NOT list_contains(had, x))) AS rest FROM s")
def se4(spark, sf):
    """Null asks for everything and absorbs lists; what was had is taken off."""
    s = D.import_records(spark, sf).groupBy("importer").agg(F.bool_or(F.col("is_export_star") & (F.col("importee") % 5 == 0)).alias("everything"), F.collect_set((F.col("importee") % 9).cast("long")).alias("asked"), F.collect_set((F.col("rec_idx") % 9).cast("long")).alias("had"))
    return s.select("importer", "everything", F.when(~F.col("everything"), F.sort_array(F.array_except("asked", "had"))).alias("rest"))
