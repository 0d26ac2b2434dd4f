"""Queries on change streams and incremental snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.fixpoint import shared_path
from loomgraph.operators.relational import merge_snapshot
from loomgraph.registry import query
from loomgraph.sources import testdata as D
from loomgraph.sources.testdata import CHANGES, MODULES, RECORDS, table, with_
from loomgraph.streaming import changes as C

ISLANDS = """marks AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM changes WINDOW w AS (PARTITION BY path ORDER BY ts, seq)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, seq) - 1 AS session FROM marks)"""


@query("st1_debounce", with_(CHANGES, ISLANDS) + "SELECT path, count(*) AS n, min(ts) AS first, max(ts) AS last FROM isl GROUP BY path, session")
def st1(spark, sf):
    return C.sessions(D.file_changes(spark, sf))


@query("st1_debounce_global", with_(CHANGES, "marks AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, seq) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM changes), isl AS (SELECT *, sum(new) OVER (ORDER BY ts, seq) AS session FROM marks)") + "SELECT count(*) AS n, min(ts) AS first, max(ts) AS last FROM isl GROUP BY session")
def st1_global(spark, sf):
    """One debouncer for all paths. Sessions are aggregates: events are merged before they meet."""
    return C.sessions(D.file_changes(spark, sf), "30 minutes", None)


@query("st1_debounce_streaming", with_(CHANGES, ISLANDS) + "SELECT path, count(*) AS n, min(ts) AS first, max(ts) AS last FROM isl GROUP BY path, session")
def st1_stream(spark, sf):
    """The same from a stream of files, with every session given out when the input ends (complete mode)."""
    at = shared_path(spark, "stream")
    src = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    kind = F.when(F.col("event_type") == "signup", "Create").when(F.col("event_type") == "error", "Delete").otherwise("Update")
    changes = src.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("path"), kind.alias("kind"))
    return C.run_available(C.sessions(changes), at, "complete")


@query("st1_debounce_watermark", with_(CHANGES, ISLANDS) + "SELECT path, count(*) AS n, min(ts) AS first, max(ts) AS last FROM isl GROUP BY path, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM changes) - INTERVAL 1 DAY")
def st1_watermark(spark, sf):
    """From the same stream in append mode: sessions that no event can join any more, by a watermark a day behind."""
    at = shared_path(spark, "stream")
    src = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    out = C.run_available(C.debounced_stream(src.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("path"))), at)
    return out.select("path", "n", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


FOLD = """kinds AS (SELECT path, list(kind ORDER BY ts, seq) AS ks FROM changes GROUP BY path),
folded AS (SELECT path, len(ks) AS n, list_reduce(list_prepend('', ks), lambda s, k: CASE WHEN s = '' THEN k WHEN s = 'Create' AND k = 'Update' THEN 'Create' WHEN s = 'Create' AND k = 'Delete' THEN '' WHEN s = 'Delete' AND k = 'Create' THEN 'Update' ELSE k END) AS kind FROM kinds)"""


@query("src13_watched_files", with_(CHANGES) + "SELECT kind, count(*) AS n FROM changes GROUP BY kind")
def src13(spark, sf):
    """Changes read as a stream of files, as far as there are any."""
    at = shared_path(spark, "stream")
    src = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    kind = F.when(F.col("event_type") == "signup", "Create").when(F.col("event_type") == "error", "Delete").otherwise("Update")
    return C.run_available(src.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")), at, "complete")


@query("st2_fold_changes", with_(CHANGES, FOLD) + "SELECT path, kind, n FROM folded WHERE kind <> ''")
def st2(spark, sf):
    return C.fold_changes(D.file_changes(spark, sf), ["path"])


@query("st3_cancelled", with_(CHANGES.replace("FROM events", "FROM events WHERE event_type IN ('signup', 'error')"), FOLD) + "SELECT count(*) FILTER (WHERE kind <> '') AS built, count(*) FILTER (WHERE kind = '') AS idle FROM folded")
def st3(spark, sf):
    """A batch whose changes all cancel builds nothing."""
    ch = D.file_changes(spark, sf).where("kind <> 'Update'")
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("ts", "seq", "kind"))), lambda c: c.kind)
    return ch.groupBy("path").agg(C.fold_kinds(kinds).alias("kind")).agg(F.count("kind").alias("built"), F.count_if(F.col("kind").isNull()).alias("idle"))


WATCH = """steps AS (SELECT path, list(struct_pack(us := epoch_us(ts), input := CASE kind WHEN 'Delete' THEN 'close' ELSE 'change' END) ORDER BY ts, seq) AS es FROM changes GROUP BY path),
ended AS (SELECT path, list_reduce(list_transform(es, lambda e: {'state': e.input, 'builds': 0::BIGINT, 'ignored': 0::BIGINT, 'last': e.us}), lambda s, e: {
  'state': CASE WHEN s.state IN ('Closing', 'Closed') THEN 'Closed' WHEN e.state = 'close' THEN 'Closing' ELSE 'Debouncing' END,
  'builds': s.builds + CASE WHEN s.state = 'Debouncing' AND e.last - s.last > 21600000000 THEN 1 ELSE 0 END,
  'ignored': s.ignored + CASE WHEN s.state IN ('Closing', 'Closed') THEN 1 ELSE 0 END,
  'last': CASE WHEN s.state IN ('Closing', 'Closed') THEN s.last ELSE e.last END}, {'state': 'Idle', 'builds': 0::BIGINT, 'ignored': 0::BIGINT, 'last': 0::BIGINT}) AS s FROM steps)"""


@query("st4_state_machine", with_(CHANGES, WATCH) + "SELECT path, s.state AS state, s.builds AS builds, s.ignored AS ignored FROM ended")
def st4(spark, sf):
    """A watcher for each path: what state it ends in, how many builds it gave out, and what came too late."""
    change = F.when(F.col("kind") == "Delete", "close").otherwise("change")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), change.alias("input")))), lambda c: F.struct(c.us.alias("us"), c.input.alias("input")))
    return D.file_changes(spark, sf).groupBy("path").agg(C.watcher(ordered, 6 * 3_600_000_000).alias("s")).select("path", "s.state", "s.builds", "s.ignored")


@query("st5_split_renames", with_(CHANGES) + "SELECT seq, path, 'Delete' AS kind FROM changes WHERE seq % 10 = 0 UNION ALL SELECT seq, path + 1, 'Create' FROM changes WHERE seq % 10 = 0 UNION ALL SELECT seq, path, kind FROM changes WHERE seq % 10 <> 0")
def st5(spark, sf):
    ch = D.file_changes(spark, sf)
    both = F.array(F.struct("path", F.lit("Delete").alias("kind")), F.struct((F.col("path") + 1).alias("path"), F.lit("Create").alias("kind")))
    return ch.select("seq", F.inline(F.when(F.col("seq") % 10 == 0, both).otherwise(F.array(F.struct("path", "kind")))))


@query("st6_classify", "SELECT user_id AS path, CASE arg_max(event_type, struct_pack(a := ts, b := event_id)) WHEN 'signup' THEN 'Create' WHEN 'error' THEN 'Delete' ELSE 'Update' END AS kind FROM events GROUP BY user_id")
def st6(spark, sf):
    """The last raw event of a path decides."""
    return D.file_changes(spark, sf).groupBy("path").agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"))


@query("st7_dirty_tasks", with_(MODULES, CHANGES) + "SELECT DISTINCT m.package_id AS task FROM modules m JOIN changes c ON c.path = m.module_idx WHERE c.kind <> 'Update'")
def st7(spark, sf):
    changed = D.file_changes(spark, sf).where("kind <> 'Update'").select(F.col("path").alias("module_idx")).distinct()
    return D.modules(spark, sf).join(changed, "module_idx", "left_semi").select(F.col("package_id").alias("task")).distinct()


COORDINATOR = """q AS (SELECT user_id AS owner, list(CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'change' WHEN 'view' THEN 'change' WHEN 'error' THEN 'failed' ELSE 'done' END ORDER BY ts, event_id) AS xs FROM events GROUP BY user_id),
ended AS (SELECT owner, list_reduce(list_transform(xs, lambda x: {'state': x, 'builds': 0::BIGINT, 'buffered': 0::BIGINT, 'released': 0::BIGINT, 'queued': 0::BIGINT, 'drained': 0::BIGINT, 'drains': 0::BIGINT}), lambda s, e:
  CASE s.state
  WHEN 'Initialized' THEN CASE WHEN e.state = 'start' THEN struct_update(s, state := 'FullBuildInProgress', builds := s.builds + 1) ELSE s END
  WHEN 'FullBuildInProgress' THEN CASE
    WHEN e.state IN ('change', 'start') THEN struct_update(s, buffered := s.buffered + 1)
    WHEN e.state = 'failed' THEN struct_update(s, state := 'FullBuildFailed')
    WHEN s.buffered > 0 THEN struct_update(s, state := 'InProgress', builds := s.builds + 1, released := s.released + s.buffered, buffered := 0::BIGINT)
    ELSE struct_update(s, state := 'Idle') END
  WHEN 'InProgress' THEN CASE
    WHEN e.state IN ('change', 'start') THEN struct_update(s, queued := s.queued + 1)
    WHEN s.queued > 0 THEN struct_update(s, builds := s.builds + 1, drained := s.drained + s.queued, drains := s.drains + 1, queued := 0::BIGINT)
    WHEN e.state = 'failed' THEN struct_update(s, state := 'Failed')
    ELSE struct_update(s, state := 'Idle') END
  WHEN 'FullBuildFailed' THEN CASE WHEN e.state IN ('change', 'start') THEN struct_update(s, state := 'FullBuildInProgress', builds := s.builds + 1, buffered := 0::BIGINT) ELSE s END
  ELSE CASE WHEN e.state IN ('change', 'start') THEN struct_update(s, state := 'InProgress', builds := s.builds + 1) ELSE s END END,
  {'state': 'Initialized', 'builds': 0::BIGINT, 'buffered': 0::BIGINT, 'released': 0::BIGINT, 'queued': 0::BIGINT, 'drained': 0::BIGINT, 'drains': 0::BIGINT}) AS s FROM q)"""


def _coordinators(spark, sf):
    """One build coordinator for each user, its inputs read off their events."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type").isin("click", "view"), "change").when(F.col("event_type") == "error", "failed").otherwise("done")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", kind.alias("input")))), lambda c: c.input)
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("owner")).agg(C.coordinator(ordered).alias("s"))


@query("st8_drained_changes", with_(COORDINATOR) + "SELECT owner, s.drained AS drained, s.drains AS drains, s.queued AS queued FROM ended")
def st8(spark, sf):
    """What gathers during a build is drained after it, as one batch: changes drained, batches, and those that wait yet."""
    return _coordinators(spark, sf).select("owner", "s.drained", "s.drains", "s.queued")


QUEUE = """q AS (SELECT user_id AS owner, list(CASE event_type WHEN 'signup' THEN 'FullBuild' WHEN 'error' THEN 'Rebuild' WHEN 'click' THEN 'Hmr' ELSE 'HmrRebuild' END ORDER BY ts, event_id) AS ts FROM events GROUP BY user_id)"""


@query("st9_coalesce_queue", with_(QUEUE) + """SELECT owner, list_reduce(list_transform(ts, lambda t: [t]), lambda s, t: CASE WHEN s[-1] = 'FullBuild' OR t[1] = 'FullBuild' THEN s[1:-2] || ['FullBuild'] WHEN s[-1] = t[1] THEN s
  WHEN s[-1] IN ('Hmr', 'HmrRebuild') AND t[1] IN ('Hmr', 'HmrRebuild') THEN s[1:-2] || ['HmrRebuild'] ELSE s || t END) AS queue FROM q""")
def st9(spark, sf):
    """Adjacent tasks merge; a fold over each queue in the row."""
    task = F.when(F.col("event_type") == "signup", "FullBuild").when(F.col("event_type") == "error", "Rebuild").when(F.col("event_type") == "click", "Hmr").otherwise("HmrRebuild")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", task.alias("task")))), lambda s: s.task)
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("owner")).agg(C.coalesce_queue(ordered).alias("queue"))


@query("st10_coordinator", with_(COORDINATOR) + "SELECT owner, s.state AS state, s.builds AS builds FROM ended")
def st10(spark, sf):
    """The coordinator's state after all its transitions, and how many builds it started."""
    return _coordinators(spark, sf).select("owner", "s.state", "s.builds")


@query("st11_buffered_changes", with_(COORDINATOR) + "SELECT owner, s.buffered AS buffered, s.released AS released FROM ended")
def st11(spark, sf):
    """Changes that wait for the full build, and those that were released by its end."""
    return _coordinators(spark, sf).select("owner", "s.buffered", "s.released")


@query("st12_stamps", with_(CHANGES) + "SELECT path, max(seq // 100) AS stamp FROM changes GROUP BY path")
def st12(spark, sf):
    return D.file_changes(spark, sf).groupBy("path").agg(F.max(F.floor(F.col("seq") / 100)).alias("stamp"))


@query("st13_unchanged_outputs", "SELECT doc_id FROM documents WHERE sha256(text) <> sha256(replace(text, 'ing', 'in'))")
def st13(spark, sf):
    """Of the changed, only those whose output differs."""
    docs = table(spark, sf, "documents")
    before = docs.select("doc_id", F.xxhash64("text").alias("a"))
    after = docs.select("doc_id", F.xxhash64(F.replace("text", F.lit("ing"), F.lit("in"))).alias("b"))
    return before.join(after, "doc_id").where("a <> b").select("doc_id")


@query("st14_incremental_importers", with_(RECORDS) + "SELECT importee, list(DISTINCT importer ORDER BY importer) AS importers FROM (SELECT importer, CASE WHEN importer % 9 = 0 THEN importee + 1 ELSE importee END AS importee FROM import_records) GROUP BY importee")
def st14(spark, sf):
    """A delta replaces its modules' records; reverse sets are made anew for the targets that it touches, others are kept."""
    rec = D.import_records(spark, sf).select("importer", "importee")
    delta = rec.where("importer % 9 = 0").withColumn("importee", F.col("importee") + 1)
    own = lambda df: df.groupBy("importee").agg(F.sort_array(F.collect_set("importer")).alias("importers"))
    touched = rec.where("importer % 9 = 0").select("importee").union(delta.select("importee")).distinct()
    merged = merge_snapshot(rec, delta, ["importer"])
    return own(rec).join(touched, "importee", "left_anti").unionByName(own(merged.join(touched, "importee", "left_semi").select("importer", "importee")))


@query("st15_importers_from_scratch", with_(RECORDS) + "SELECT importee, list(DISTINCT importer ORDER BY importer) AS importers FROM (SELECT importer, CASE WHEN importer % 9 = 0 THEN importee + 1 ELSE importee END AS importee FROM import_records) GROUP BY importee")
def st15(spark, sf):
    rec = D.import_records(spark, sf).select("importer", "importee")
    delta = rec.where("importer % 9 = 0").withColumn("importee", F.col("importee") + 1)
    return merge_snapshot(rec, delta, ["importer"]).groupBy("importee").agg(F.sort_array(F.collect_set("importer")).alias("importers"))


@query("st16_client_updates", with_(CHANGES) + "SELECT path % 20 AS client, count(DISTINCT path) AS modules FROM changes WHERE kind = 'Delete' GROUP BY path % 20")
def st16(spark, sf):
    return D.file_changes(spark, sf).where("kind = 'Delete'").groupBy((F.col("path") % 20).alias("client")).agg(F.count_distinct("path").alias("modules"))
