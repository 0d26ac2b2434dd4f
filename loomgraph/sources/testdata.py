"""The graph tables derived from the test tables, as DataFrames and as the same DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXTENSIONS = ("js", "ts", "json", "css")
KINDS = {"A": "import-statement", "N": "require-call"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (p % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        p.alias("module_idx"),
        F.concat(F.lit("/repo/src/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/m"), p.cast("string"), F.lit("."), ext).alias("id"),
        ext.alias("module_type"),
        (F.col("p_size") * 100).cast("long").alias("size"),
        F.col("p_brand").alias("package_id"),
        (p % 3 == 0).alias("has_side_effects"),
        (p % 7 == 0).alias("side_effects_pinned"),
        (p % 11 == 0).alias("has_tla"),
        (p % 5 == 0).alias("self_accepting"),
        (p % 13 == 0).alias("is_external"),
    )


def import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """importer, rec_idx, importee, kind, is_export_star: consecutive lines of an order import one another."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("importer"), "l_returnflag", "l_discount", "l_tax", "l_linenumber", F.lead("l_partkey").over(w).alias("importee"))
    rows = rows.where("importee is not null and l_discount = 0.0 and l_tax <= 0.05")
    kind = F.when(F.col("l_returnflag") == "A", "import-statement").when(F.col("l_returnflag") == "N", "require-call").otherwise("dynamic-import")
    order = Window.partitionBy("importer").orderBy("l_orderkey", "l_linenumber", "importee")
    return rows.select("importer", (F.row_number().over(order) - 1).alias("rec_idx"), "importee", kind.alias("kind"), (F.col("l_linenumber") % 2 == 0).alias("is_export_star"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_idx, module_idx, kind (0 user, 1 dynamic). As few as entry points are."""
    p = table(spark, sf_dir, "part").where("p_size <= 2")
    return p.select((F.row_number().over(Window.orderBy("p_partkey")) - 1).alias("entry_idx"), F.col("p_partkey").alias("module_idx"), (F.col("p_size") - 1).alias("kind"))


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "Create").when(F.col("event_type") == "error", "Delete").otherwise("Update")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("path"), kind.alias("kind"))


def hook_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, hook, start_us, end_us: overlapping spans."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("hook"), start.alias("start_us"), (start + (F.col("value") * 100_000_000).cast("long") + 1).alias("end_us"), F.col("event_id").alias("seq"))


def kind_is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


STATIC = ("import-statement", "require-call")

MODULES = """modules AS (SELECT p_partkey AS module_idx,
  '/repo/src/' || replace(p_type, ' ', '_') || '/m' || p_partkey || '.' || ['js', 'ts', 'json', 'css'][p_partkey % 4 + 1] AS id,
  ['js', 'ts', 'json', 'css'][p_partkey % 4 + 1] AS module_type, (p_size * 100)::BIGINT AS size, p_brand AS package_id,
  p_partkey % 3 = 0 AS has_side_effects, p_partkey % 7 = 0 AS side_effects_pinned, p_partkey % 11 = 0 AS has_tla,
  p_partkey % 5 = 0 AS self_accepting, p_partkey % 13 = 0 AS is_external FROM part)"""
RECORDS = """lines AS (SELECT l_orderkey, l_partkey AS importer, l_returnflag, l_discount, l_tax, l_linenumber, lead(l_partkey) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS importee FROM lineitem),
import_records AS (SELECT importer, row_number() OVER (PARTITION BY importer ORDER BY l_orderkey, l_linenumber, importee) - 1 AS rec_idx, importee,
  CASE l_returnflag WHEN 'A' THEN 'import-statement' WHEN 'N' THEN 'require-call' ELSE 'dynamic-import' END AS kind, l_linenumber % 2 = 0 AS is_export_star
  FROM lines WHERE importee IS NOT NULL AND l_discount = 0.0 AND l_tax <= 0.05)"""
ENTRIES = "entries AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS entry_idx, p_partkey AS module_idx, p_size - 1 AS kind FROM part WHERE p_size <= 2)"
REACH = """reach AS (SELECT entry_idx, module_idx FROM entries UNION
  SELECT r.entry_idx, i.importee FROM reach r JOIN import_records i ON i.importer = r.module_idx)"""
CHANGES = "changes AS (SELECT event_id AS seq, ts, user_id AS path, CASE event_type WHEN 'signup' THEN 'Create' WHEN 'error' THEN 'Delete' ELSE 'Update' END AS kind FROM events)"
CALLS = """calls AS (SELECT user_id AS owner, event_type AS hook, epoch_us(ts) AS start_us, epoch_us(ts) + trunc(value * 100000000)::BIGINT + 1 AS end_us, event_id AS seq FROM events)"""
CHUNKS = """sets AS (SELECT module_idx, list(entry_idx ORDER BY entry_idx) AS entry_set FROM reach GROUP BY module_idx),
chunk_modules AS (SELECT s.module_idx, s.entry_set, dense_rank() OVER (ORDER BY array_to_string(s.entry_set, ',')) - 1 AS chunk_idx, m.size, m.id, m.package_id, m.module_type
  FROM sets s JOIN modules m USING (module_idx))"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
