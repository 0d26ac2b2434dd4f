"""Change streams: debounced sessions, folded change kinds, stamps and fan-out, in batch and as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP = "6 hours"
GONE = "Removed"


def merge_kind(old: Column, new: Column) -> Column:
    """Two changes of one path as one; null for both stands for nothing to tell."""
    return (
        F.when(old.isNull(), new)
        .when((old == "Create") & (new == "Update"), "Create")
        .when((old == "Create") & (new == "Delete"), F.lit(None))
        .when((old == "Delete") & (new == "Create"), "Update")
        .otherwise(new)
    )


def fold_kinds(kinds: Column) -> Column:
    """An ordered array of kinds as one; null if they cancel out."""
    return F.aggregate(kinds, F.lit(None).cast("string"), lambda s, k: merge_kind(s, k))


def fold_changes(changes: DataFrame, by: list[str]) -> DataFrame:
    """by, kind, n: changes (ts, seq, kind) folded in order; those that cancel out are left away."""
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("ts", "seq", "kind"))), lambda c: c.kind)
    return changes.groupBy(*by).agg(fold_kinds(kinds).alias("kind"), F.count(F.lit(1)).alias("n")).where("kind is not null")


def sessions(changes: DataFrame, gap: str = GAP, key: str | None = "path") -> DataFrame:
    """Debounced batches: changes at most a gap apart belong together; without ``key`` over all paths."""
    by = [F.session_window("ts", gap).alias("w")] + ([F.col(key)] if key else [])
    return changes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("w")


def islands(changes: DataFrame, gap: str, by: list[str]) -> DataFrame:
    """``changes`` with session, counted from 0 for each key; the batch form, where rows are needed and not just counts."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    new = F.coalesce(F.col("ts") > F.lag("ts").over(w) + F.expr(f"interval {gap}"), F.lit(False)).cast("int")
    return changes.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Changes as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def debounced_stream(changes: DataFrame, gap: str = GAP, late: str = "1 day") -> DataFrame:
    """The sessions of a stream, given out once no event can join them any more."""
    return sessions(changes.withWatermark("ts", late), gap)


def run_available(df: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, each micro-batch into a table of its own below the shared folder ``at``.

    The rows of all batches; in complete mode those of the last one. A repeated batch replaces its table.
    """
    schema, done = df.schema, []

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{k}")
        done.append(k)

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = df.sparkSession
    paths = [f"{at}/out/{k}" for k in sorted(set(done))][-1 if mode == "complete" else 0 :]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


TASKS = ("FullBuild", "Rebuild", "Hmr", "HmrRebuild")


def join_tasks(a: Column, b: Column) -> Column:
    """Two adjacent queued tasks as one, null if they don't merge."""
    return F.when((a == "FullBuild") | (b == "FullBuild"), "FullBuild").when(a == b, a).when(a.isin("Hmr", "HmrRebuild") & b.isin("Hmr", "HmrRebuild"), "HmrRebuild")


def coalesce_queue(tasks: Column) -> Column:
    """An ordered array of tasks with adjacent ones merged as they come."""

    def push(s: Column, t: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        merged = join_tasks(last, t)
        return F.when(merged.isNotNull(), F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(s, F.array(t)))

    return F.aggregate(tasks, F.array().cast("array<string>"), push)


def watcher(events: Column, quiet_us: int) -> Column:
    """state, builds, ignored, last after an ordered array of events struct(us, input); inputs are change and close.

    Idle or Debouncing goes to Debouncing at a change, which puts the deadline off; from a deadline that has passed, the
    changes are built and the watcher is Idle. A close leads to Closing, and what comes next finds it Closed; neither takes changes.
    """

    def step(s: Column, e: Column) -> Column:
        due = (s.state == "Debouncing") & (e.us - s["last"] > quiet_us)
        over = s.state.isin("Closing", "Closed")
        state = F.when(over, "Closed").when(e.input == "close", "Closing").otherwise("Debouncing")
        return F.struct(
            state.alias("state"),
            (s.builds + due.cast("long")).alias("builds"),
            (s.ignored + over.cast("long")).alias("ignored"),
            F.when(over, s["last"]).otherwise(e.us).alias("last"),
        )

    zero = F.lit(0).cast("long")
    return F.aggregate(events, F.struct(F.lit("Idle").alias("state"), zero.alias("builds"), zero.alias("ignored"), zero.alias("last")), step)


COORDINATOR = ("state", "builds", "buffered", "released", "queued", "drained", "drains")


def coordinator(inputs: Column) -> Column:
    """COORDINATOR after an ordered array of inputs: start, change, done (a build ended), failed (it ended with an error).

    A full build is started once. Changes during it are buffered, and released as one build when it has succeeded; if it fails
    they are dropped with the next change, which starts it again. Changes during other builds are queued, merged, and drained
    as one build when that ends, whether it succeeded or not. An end without a build, and a change before the start, are ignored.
    """

    def step(s: Column, x: Column) -> Column:
        full, busy, ready = s.state == "FullBuildInProgress", s.state == "InProgress", s.state.isin("Idle", "Failed")
        change, ended = x.isin("change", "start") & (s.state != "Initialized"), x.isin("done", "failed")
        begins = (s.state == "Initialized") & (x == "start")
        release = full & (x == "done") & (s.buffered > 0)
        drain = busy & ended & (s.queued > 0)
        again = change & (s.state == "FullBuildFailed")
        state = (
            F.when(begins | again, "FullBuildInProgress")
            .when(release | drain | (change & ready), "InProgress")
            .when(full & (x == "failed"), "FullBuildFailed")
            .when(busy & (x == "failed"), "Failed")
            .when((full | busy) & ended, "Idle")
            .otherwise(s.state)
        )
        n = lambda c: c.cast("long")
        return F.struct(
            state.alias("state"),
            (s.builds + n(begins | again | release | drain | (change & ready))).alias("builds"),
            F.when(release | again, n(F.lit(0))).otherwise(s.buffered + n(change & full)).alias("buffered"),
            (s.released + F.when(release, s.buffered).otherwise(n(F.lit(0)))).alias("released"),
            F.when(drain, n(F.lit(0))).otherwise(s.queued + n(change & busy)).alias("queued"),
            (s.drained + F.when(drain, s.queued).otherwise(n(F.lit(0)))).alias("drained"),
            (s.drains + n(drain)).alias("drains"),
        )

    zero = F.lit(0).cast("long")
    return F.aggregate(inputs, F.struct(F.lit("Initialized").alias("state"), *[zero.alias(c) for c in COORDINATOR[1:]]), step)
