"""Queries on names, urls, filters and texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import predicates as P
from loomgraph.functions import text as X
from loomgraph.registry import query
from loomgraph.sources import testdata as D
from loomgraph.sources.testdata import MODULES, RECORDS, table, with_

M = with_(MODULES)


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url")


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


# Filters --------------------------------------------------------------------------------------------------------------------


@query("flt1_include_exclude", M + r"""SELECT id, CASE WHEN regexp_matches(id, '^(?:.*/)?[^/]*7\.js$') THEN false WHEN regexp_matches(id, '^/repo/src/[^/]*/m1[^/]*\.(?:js|ts)$') THEN true ELSE false END AS kept FROM modules""")
def flt1(spark, sf):
    return D.modules(spark, sf).select("id", P.pattern_filter(F.col("id"), ["src/*/m1*.{js,ts}"], ["**/*7.js"], "/repo").alias("kept"))


@query("flt2_code_filter", "SELECT doc_id, CASE WHEN contains(text, 'licen') THEN false WHEN contains(text, 'the ') OR regexp_matches(text, '[0-9]{3}') THEN true ELSE false END AS kept FROM documents")
def flt2(spark, sf):
    return _docs(spark, sf).select("doc_id", P.code_filter(F.col("text"), ["the ", "/[0-9]{3}/"], ["licen"]).alias("kept"))


@query("flt3_glob", M + r"SELECT count(*) FILTER (WHERE regexp_matches(id, '^/repo/src/(?:.*/)?m[^/]5\.[^/]*$')) AS relative, count(*) FILTER (WHERE regexp_matches(id, '^(?:.*/)?[^/]*\.css$')) AS anywhere FROM modules")
def flt3(spark, sf):
    hit = lambda g: F.count_if(F.col("id").rlike(X.glob_regex(g, "/repo")))
    return D.modules(spark, sf).agg(hit("src/**/m?5.*").alias("relative"), hit("**/*.css").alias("anywhere"))


TREE = [("id", "**/*.html"), ("clean_url", ("id", "**/en/*")), ("query", "page", "2"), ("or", 2), "not", ("and", 2)]


@query("flt4_filter_tree", r"""SELECT page_id, regexp_matches(url, '^(?:.*/)?[^/]*\.html$') AND NOT (regexp_matches(regexp_extract(url, '^([^?#]*)', 1), '^(?:.*/)?en/[^/]*$') OR coalesce(regexp_extract(regexp_extract(url, '^[^?]*\?([^#]*)', 1), '(?:^|&)page=([^&]*)', 1) = '2', false)) AS kept FROM pages""")
def flt4(spark, sf):
    """And, or, not over ids, cleaned ids and query values."""
    return _pages(spark, sf).select("page_id", P.compile_filter(P.parse(TREE), P.Inputs(id=F.col("url"))).alias("kept"))


@query("flt5_first_match", M + "SELECT id, CASE WHEN module_type = 'css' THEN false WHEN contains(id, 'STEEL') THEN true WHEN size > 2000 THEN false ELSE false END AS kept FROM modules")
def flt5(spark, sf):
    items = [("exclude", F.col("module_type") == "css"), ("include", F.col("id").contains("STEEL")), ("exclude", F.col("size") > 2000)]
    return D.modules(spark, sf).select("id", P.ordered_filter(items).alias("kept"))


@query("flt6_filter_tokens", "SELECT count(*) FILTER (WHERE url LIKE 'https:%' AND NOT (url LIKE '%#top')) AS kept, count(*) AS n FROM pages")
def flt6(spark, sf):
    tree = P.parse([("id", "https:**"), ("id", "**#top"), "not", ("and", 2)])
    return _pages(spark, sf).agg(F.count_if(P.compile_filter(tree, P.Inputs(id=F.col("url")))).alias("kept"), F.count(F.lit(1)).alias("n"))


@query("flt7_query_values", r"""SELECT page_id, CASE WHEN regexp_matches(q, '(?:^|&)page=') THEN regexp_extract(q, '(?:^|&)page=([^&]*)', 1) END AS page, regexp_matches(q, '(?:^|&)ref(?:=|&|$)') AS has_ref FROM (SELECT page_id, regexp_extract(url, '^[^?]*\?([^#]*)', 1) AS q FROM pages)""")
def flt7(spark, sf):
    u = F.col("url")
    return _pages(spark, sf).select("page_id", X.query_value(u, "page").alias("page"), X.query_value(u, "ref").isNotNull().alias("has_ref"))


@query("flt8_look_around", "SELECT doc_id, regexp_matches(text, '[^a-z]the [a-z]+ing') AS hit FROM documents")
def flt8(spark, sf):
    """Java expressions cover look-around; here a look-behind."""
    return _docs(spark, sf).select("doc_id", F.col("text").rlike(r"(?<=[^a-z])the [a-z]+ing").alias("hit"))


@query("flt9_edges_by_kind", with_(RECORDS) + "SELECT kind, kind <> 'dynamic-import' AS static, count(*) AS n FROM import_records GROUP BY kind")
def flt9(spark, sf):
    return D.import_records(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("static", F.col("kind").isin(*D.STATIC))


@query("flt10_dependencies", with_(RECORDS) + "SELECT DISTINCT importer, importee FROM import_records WHERE kind NOT IN ('dynamic-import', 'require-call')")
def flt10(spark, sf):
    return D.import_records(spark, sf).where(~D.kind_is("dynamic-import", "require-call") & F.col("importee").isNotNull()).select("importer", "importee").distinct()


@query("flt11_side_effect_globs", M + r"SELECT id, regexp_matches(id, '^(?:.*/)?[^/]*\.css$') OR regexp_matches(id, '^(?:.*/)?m[^/]*9\.js$') AS side_effects FROM modules")
def flt11(spark, sf):
    """Package globs; bare ones apply in any directory."""
    globs = [g if g.startswith(("/", "**/")) else "**/" + g.removeprefix("./") for g in ("*.css", "./m*9.js")]
    return D.modules(spark, sf).select("id", P._any([F.col("id").rlike(X.glob_regex(g)) for g in globs]).alias("side_effects"))


@query("flt12_tags", M + "SELECT module_idx, (tags & 5) = 5 AS has_all FROM (SELECT module_idx, has_side_effects::INT + 2 * has_tla::INT + 4 * self_accepting::INT AS tags FROM modules)")
def flt12(spark, sf):
    tags = F.col("has_side_effects").cast("int") + 2 * F.col("has_tla").cast("int") + 4 * F.col("self_accepting").cast("int")
    return D.modules(spark, sf).select("module_idx", (tags.bitwiseAND(F.lit(5)) == 5).alias("has_all"))


# Scalars --------------------------------------------------------------------------------------------------------------------


@query("sf1_clean_url", r"SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS clean, regexp_extract(url, '^[^?]*\?([^#]*)', 1) AS query FROM pages")
def sf1(spark, sf):
    return _pages(spark, sf).select("page_id", X.clean_url(F.col("url")).alias("clean"), X.get_query(F.col("url")).alias("query"))


@query("sf2_stabilize_id", M + "SELECT module_idx, substr(id, 7) AS stable_id FROM modules")
def sf2(spark, sf):
    return D.modules(spark, sf).select("module_idx", X.stabilize_id(F.col("id"), "/repo").alias("stable_id"))


@query("sf3_paths", M + r"""SELECT module_idx, regexp_replace(id, '/[^/]*$', '') AS dir, regexp_extract(id, '([^/]*)$', 1) AS base, module_type AS ext, '../' || substr(id, 11) AS rel FROM modules""")
def sf3(spark, sf):
    i = F.col("id")
    return D.modules(spark, sf).select("module_idx", X.dirname(i).alias("dir"), X.basename(i).alias("base"), X.extension(i).alias("ext"), X.relative_path(i, F.lit("/repo/src/zz")).alias("rel"))


@query("sf4_sanitize", r"""SELECT page_id, regexp_replace(url, '[\x00-\x1f"#$%&*+,:;<=>?\[\]^`{|}\x7f]', '_', 'g') AS name FROM pages""")
def sf4(spark, sf):
    return _pages(spark, sf).select("page_id", X.sanitize_file_name(F.col("url")).alias("name"))


@query("sf5_identifiers", "SELECT p_partkey, CASE WHEN regexp_matches(n, '^[0-9]') THEN '_' || n ELSE n END AS name, '[\"' || raw || '\"]' AS access FROM (SELECT p_partkey, p_size || ' ' || p_name AS raw, regexp_replace(p_size || ' ' || p_name, '[^A-Za-z0-9_$]', '_', 'g') AS n FROM part)")
def sf5(spark, sf):
    raw = F.concat_ws(" ", F.col("p_size").cast("string"), "p_name")
    return table(spark, sf, "part").select("p_partkey", X.identifier(raw).alias("name"), X.property_access(raw).alias("access"))


@query("sf6_path_like", M + "SELECT count(*) FILTER (WHERE regexp_matches(s, '^(\\.{1,2}(/|$)|/)')) AS path_like, count(*) AS n FROM (SELECT CASE module_idx % 3 WHEN 0 THEN './' || module_idx WHEN 1 THEN id ELSE package_id END AS s FROM modules)")
def sf6(spark, sf):
    m = F.col("module_idx")
    s = F.when(m % 3 == 0, F.concat(F.lit("./"), m.cast("string"))).when(m % 3 == 1, F.col("id")).otherwise(F.col("package_id"))
    return D.modules(spark, sf).agg(F.count_if(X.is_path_like(s)).alias("path_like"), F.count(F.lit(1)).alias("n"))


@query("sf7_base64", "SELECT page_id, to_base64(encode(url)) AS standard, replace(replace(regexp_replace(to_base64(encode(url)), '=+$', ''), '+', '-'), '/', '_') AS url_safe FROM pages")
def sf7(spark, sf):
    return _pages(spark, sf).select("page_id", F.translate(F.base64(F.col("url").cast("binary")), "\r\n", "").alias("standard"), X.base64_url(F.col("url")).alias("url_safe"))


@query("sf8_data_url", """SELECT page_id, CASE WHEN length(p) < length(b) THEN p ELSE b END AS data FROM (SELECT page_id, 'data:text/plain,' || url_encode(url) AS p, 'data:text/plain;base64,' || to_base64(encode(url)) AS b FROM pages)""")
def sf8(spark, sf):
    return _pages(spark, sf).select("page_id", X.data_url(F.col("url"), "text/plain").alias("data"))


MIME = {"js": "text/javascript", "ts": "text/typescript", "json": "application/json"}


@query("sf9_mime", M + "SELECT module_idx, CASE module_type WHEN 'js' THEN 'text/javascript' WHEN 'ts' THEN 'text/typescript' WHEN 'json' THEN 'application/json' ELSE 'application/octet-stream' END AS mime FROM modules")
def sf9(spark, sf):
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return D.modules(spark, sf).select("module_idx", F.coalesce(F.try_element_at(known, X.extension(F.col("id"))), F.lit("application/octet-stream")).alias("mime"))


@query("sf10_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def sf10(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("sf11_format_size", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f kB', n_chars / 1024.0) ELSE printf('%.1f MB', n_chars / 1048576.0) END AS size FROM documents")
def sf11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.format_size(F.col("n_chars")).alias("size"))


@query("sf12_display_size", "SELECT doc_id, n_chars * 997 // 1000 AS kb, lpad((n_chars * 997 % 1000 // 10)::VARCHAR, 2, '0') AS part FROM documents")
def sf12(spark, sf):
    d = X.display_size(F.col("n_chars") * 997)
    return table(spark, sf, "documents").select("doc_id", F.translate(F.substring_index(d, ".", 1), ",", "").cast("long").alias("kb"), F.substring(F.substring_index(d, ".", -1), 1, 2).alias("part"))


@query("sf13_placeholders", M + "SELECT module_idx, '!~{' || module_idx || '}~' AS found, 'a-[hash]-b' AS plain FROM modules")
def sf13(spark, sf):
    text = F.concat(F.lit("a-!~{"), F.col("module_idx").cast("string"), F.lit("}~-b"))
    shape = r"!~\{[0-9a-zA-Z_$]+\}~"
    return D.modules(spark, sf).select("module_idx", F.regexp_extract(text, f"({shape})", 1).alias("found"), F.regexp_replace(text, shape, "[hash]").alias("plain"))


@query("sf14_file_template", M + "SELECT module_idx, 'm' || module_idx || '-' || substr(sha256(id), 1, 8) || '.' || module_type AS file FROM modules")
def sf14(spark, sf):
    out = F.lit("[name]-[hash:8].[ext]")
    for key, value in (("[name]", F.regexp_extract("id", r"([^/.]*)\.[^/]*$", 1)), ("[hash:8]", F.substring(F.sha2(F.col("id").cast("binary"), 256), 1, 8)), ("[ext]", F.col("module_type"))):
        out = F.replace(out, F.lit(key), value)
    return D.modules(spark, sf).select("module_idx", out.alias("file"))


@query("sf15_safe_to_inline", "SELECT event_id, CASE event_type WHEN 'view' THEN value = trunc(value) AND value BETWEEN -99 AND 999 WHEN 'click' THEN octet_length(encode(props)) <= 3 ELSE true END AS safe FROM events")
def sf15(spark, sf):
    v = F.col("value")
    number = (v == F.floor(v)) & v.between(-99, 999)
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", number).when(F.col("event_type") == "click", F.octet_length("props") <= 3).otherwise(True).alias("safe"))


@query("sf17_levels", "SELECT p_partkey, CASE WHEN p_size > 50 THEN 'HIGH' WHEN p_size >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM part")
def sf17(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.level(F.col("p_size")).alias("level"))


@query("sf18_plugin_bound", "SELECT o_orderkey, o_totalprice >= 3000 AND l > 0 AND (o_totalprice - l) / l > 100 AS bound FROM (SELECT *, o_custkey % 50 AS l FROM orders)")
def sf18(spark, sf):
    link = F.col("o_custkey") % 50
    return table(spark, sf, "orders").select("o_orderkey", ((F.col("o_totalprice") >= 3000) & (link > 0) & F.coalesce((F.col("o_totalprice") - link) / F.nullif(link, F.lit(0)) > 100, F.lit(False))).alias("bound"))


@query("sf19_uuid", None)
def sf19(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", F.uuid().alias("uuid"))


@query("sf20_literals", r"""SELECT conv_id, turn, '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' AS literal FROM conversations""")
def sf20(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.string_literal(X.strip_bom(F.concat(F.lit("﻿"), F.col("text")))).alias("literal"))


# Texts ----------------------------------------------------------------------------------------------------------------------


def replace_first(c, old: str, new: str, n: int = 1):
    """The first ``n`` occurrences of a literal, in the original text."""
    parts = F.split(c, "\\Q" + old + "\\E", n + 1)
    return F.array_join(parts, new)


@query("tx1_replace", "SELECT doc_id, regexp_replace(text, 'the', 'THE') AS first, replace(text, 'the', 'THE') AS every, regexp_replace(regexp_replace(text, 'the', '<>'), 'the', '<>') AS two FROM documents")
def tx1(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", replace_first(t, "the", "THE").alias("first"), F.replace(t, F.lit("the"), F.lit("THE")).alias("every"), replace_first(t, "the", "<>", 2).alias("two"))


def apply_edits(text, edits):
    """Edits struct(start, end, content) (0-based, end exclusive, not overlapping) on the original text, left to right; clipped to its end, null for null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    ordered = F.array_sort(edits)
    done = F.aggregate(ordered, start, lambda s, e: F.struct(e.end.cast("int").alias("at"), F.concat(s.out, F.substr(text, s["at"] + 1, e.start - s["at"]), e.content).alias("out")))
    return F.concat(done.out, F.substr(text, done["at"] + 1))


EDIT = lambda a, b, c: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("content"))


@query("tx2_update_range", "SELECT doc_id, '<' || substr(text, 4, 7) || 'two' || substr(text, 21) AS out FROM documents")
def tx2(spark, sf):
    return _docs(spark, sf).select("doc_id", apply_edits(F.col("text"), F.array(EDIT(10, 20, "two"), EDIT(0, 3, "<"))).alias("out"))


@query("tx3_append_prepend", "SELECT doc_id, 'intro' || substr(text, 1, 5) || 'LR' || substr(text, 6) || 'outro' AS out FROM documents")
def tx3(spark, sf):
    return _docs(spark, sf).select("doc_id", F.concat(F.lit("intro"), apply_edits(F.col("text"), F.array(EDIT(5, 5, "LR"))), F.lit("outro")).alias("out"))


@query("tx4_remove_relocate", "SELECT doc_id, substr(text, 1, 5) || substr(text, 11) AS removed, substr(text, 6, 5) || substr(text, 1, 5) || substr(text, 11) AS moved, substr(text, 6, 5) AS snip FROM documents")
def tx4(spark, sf):
    t = F.col("text")
    removed = apply_edits(t, F.array(EDIT(5, 10, "")))
    return _docs(spark, sf).select("doc_id", removed.alias("removed"), F.concat(F.substring(t, 6, 5), removed).alias("moved"), F.substring(t, 6, 5).alias("snip"))


@query("tx5_slice_reset", "SELECT doc_id, substr(text, 9, 17) AS slice, right(text, 4) AS tail FROM documents")
def tx5(spark, sf):
    return _docs(spark, sf).select("doc_id", F.substring("text", 9, 17).alias("slice"), F.right("text", F.lit(4)).alias("tail"))


@query("tx6_trim", "SELECT doc_id, regexp_replace(text, '^[A-Ta-t]+', '') AS start, regexp_replace(text, '[.\\s]+$', '') AS end, regexp_replace(text, '^\\n+', '') AS lines FROM documents")
def tx6(spark, sf):
    return _docs(spark, sf).select("doc_id", F.regexp_replace("text", "^[A-Ta-t]+", "").alias("start"), F.regexp_replace("text", r"[.\s]+\z", "").alias("end"), F.regexp_replace("text", r"^\n+", "").alias("lines"))


@query("tx7_indent", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN l = '' THEN l ELSE '  ' || l END), chr(10)) AS out FROM documents")
def tx7(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), lambda l: F.when(l == "", l).otherwise(F.concat(F.lit("  "), l))), "\n").alias("out"))


@query("tx8_measures", "SELECT doc_id, right(text, 1) AS last_char, string_split(text, chr(10))[-1] AS last_line, length(text) AS n, octet_length(encode(text)) AS bytes, text <> trim(text) AS changed FROM documents")
def tx8(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.right(t, F.lit(1)).alias("last_char"), F.element_at(F.split(t, "\n", -1), -1).alias("last_line"), F.char_length(t).cast("long").alias("n"), F.octet_length(t).cast("long").alias("bytes"), (t != F.trim(t)).alias("changed"))


@query("tx9_join", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS joined FROM conversations GROUP BY conv_id")
def tx9(spark, sf):
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(r.role, F.lit(": "), r.text)), "\n").alias("joined"))


WORDS = {"the": "DER", "then": "DANN", "and": "UND"}


@query("tx10_dictionary", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\bthen\\b', 'DANN', 'g'), '\\bthe\\b', 'DER', 'g'), '\\band\\b', 'UND', 'g') AS out FROM documents")
def tx10(spark, sf):
    """Whole words, longest keys first; each text is scanned once a key. Words end at what isn't an ASCII letter, digit or underscore."""
    out = F.col("text")
    for k in sorted(WORDS, key=lambda k: (-len(k), k)):
        out = F.regexp_replace(out, rf"(?<![0-9A-Za-z_]){k}(?![0-9A-Za-z_])", WORDS[k])
    return _docs(spark, sf).select("doc_id", out.alias("out"))


@query("tx11_typeof_guards", "SELECT page_id, replace(replace('typeof window; ' || url, 'typeof window', '\"object\"'), 'http', 'HTTP') AS out FROM pages")
def tx11(spark, sf):
    """A dictionary key a.b.c also answers ``typeof`` of its heads; expanded on the driver."""
    guards = {f"typeof {k.split('.')[0]}": '"object"' for k in ("window.x",)} | {"http": "HTTP"}
    out = F.concat(F.lit("typeof window; "), F.col("url"))
    for k, v in guards.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return _pages(spark, sf).select("page_id", out.alias("out"))


@query("tx12_concatenation_offsets", "SELECT conv_id, turn, n, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_line FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM conversations)")
def tx12(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf, "conversations").withColumn("n", F.size(F.split("text", "\n", -1)).cast("long"))
    return rows.select("conv_id", "turn", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first_line"))


@query("tx13_line_offsets", """SELECT doc_id, pos - 1 AS line, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""")
def tx13(spark, sf):
    """Where each line starts; within a row, so no shuffle."""
    lines = F.split("text", "\n", -1)
    grown = F.aggregate(lines, F.array(F.lit(0).cast("bigint")), lambda s, l: F.concat(s, F.array(F.element_at(s, -1) + F.char_length(l) + 1)))
    return _docs(spark, sf).select("doc_id", F.posexplode(F.slice(grown, 1, F.size(grown) - 1)).alias("line", "offset"))


@query("tx14_shift_tokens", "SELECT l_orderkey, l_linenumber + 10 AS line, l_partkey FROM lineitem WHERE l_linenumber > 2")
def tx14(spark, sf):
    return table(spark, sf, "lineitem").where("l_linenumber > 2").select("l_orderkey", (F.col("l_linenumber") + 10).alias("line"), "l_partkey")


@query("tx15_extract_imports", """SELECT page_id, pos - 1 AS rec_idx, target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos FROM pages)""")
def tx15(spark, sf):
    """References in a text, in order."""
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("rec_idx", "target"))
