"""Semi-naive fixpoints over DataFrames: the driver only counts, every round is a join against the new rows alone.

Lineage is cut by ``kept``: a table in the folder that spark.checkpoint.dir names, so a lost executor costs a
reread and not the rounds so far.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 1000
#: A round that begins with no more new rows than this takes HOPS steps at once: its fixed cost outweighs what is met twice.
FEW_ROWS = 200_000
HOPS = 4


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where that is unset, in a temporary one, with a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, its plan replaced by a table in the shared folder: its size is known to later joins."""
    at = shared_path(df.sparkSession, "kept")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and shuffles both sides: a table joined in every round would pass the driver as often."""
    return df.hint("merge")


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def least_fixpoint(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = MAX_ROUNDS) -> DataFrame:
    """The smallest set of rows that holds ``seeds`` and, with any rows, what ``step`` makes of them.

    ``step`` must distribute over unions: it sees only the rows that the last round added. What it joins them with should
    be ``kept``, for it is read anew every round; that join is ``unsent``. Raises if the fixpoint isn't reached.
    """
    new = kept(seeds.distinct())
    parts, n = [new], new.count()
    for _ in range(rounds):
        if not n:
            return _together(parts)
        hops = [new]
        for _ in range(HOPS if n <= FEW_ROWS else 1):
            hops.append(step(unsent(hops[-1])).select(*seeds.columns).distinct())
        new = kept(_without(_together(hops[1:]).distinct() if len(hops) > 2 else hops[1], parts))
        n = new.count()
        parts.append(new)
        if len(parts) > 12:  # keep the union short
            parts = [kept(_together(parts))]
    raise RuntimeError(f"no fixpoint in {rounds} rounds")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _without(found: DataFrame, parts: list[DataFrame]) -> DataFrame:
    seen = unsent(_together(parts))
    on = [found[c].eqNullSafe(seen[c]) for c in found.columns]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return found.join(seen, cond, "left_anti")


def closure(seeds: DataFrame, edges: DataFrame, at: str, src: str = "src", dst: str = "dst", rounds: int = MAX_ROUNDS) -> DataFrame:
    """``seeds`` and all rows that differ from one in ``at`` alone and are reached from it along ``edges``.

    Other columns of the seeds go along: with (entry, module) it is the closure of all entries at once.
    """
    step_edges = kept(edges.select(F.col(src).alias("__src"), F.col(dst).alias("__dst")).distinct())
    rest = [c for c in seeds.columns if c != at]

    def step(new: DataFrame) -> DataFrame:
        return new.join(step_edges, new[at] == step_edges["__src"]).select(*rest, F.col("__dst").alias(at))

    return least_fixpoint(seeds, step, rounds)


def strict_closure(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """All (src, dst) joined by a path of one edge or more."""
    return closure(edges.select("src", "dst").distinct(), edges, "dst", rounds=rounds)


def peel(vertices: DataFrame, edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """v, level: vertices in layers, each with no edge from outside the layers before; those on or behind a cycle have none."""
    left, out, level = kept(edges.select("src", "dst").distinct()), None, 0
    rest = kept(vertices.select("v").distinct())
    for _ in range(rounds):
        free = kept(rest.join(unsent(left).select(F.col("dst").alias("v")).distinct(), "v", "left_anti"))
        if not some(free):
            return out if out is not None else vertices.select("v", F.lit(0).alias("level")).limit(0)
        layer = free.withColumn("level", F.lit(level))
        out = layer if out is None else out.unionByName(layer)
        rest = kept(rest.join(unsent(free), "v", "left_anti"))
        left = kept(left.join(unsent(free), left.src == free.v, "left_anti"))
        level += 1
    raise RuntimeError(f"not peeled in {rounds} rounds")


def roots(links: DataFrame, rounds: int = 64) -> DataFrame:
    """v, root: where each vertex of parent pointers (v, parent) ends, by pointer jumping; a root points to itself."""
    at = kept(links.select("v", "parent"))
    for _ in range(rounds):
        up = at.select(F.col("v").alias("__v"), F.col("parent").alias("__up"))
        new = kept(unsent(at).join(up, at.parent == up["__v"], "left").select("v", "parent", F.coalesce("__up", "parent").alias("__next")))
        if not some(new.where("parent <> __next")):
            return at.withColumnRenamed("parent", "root")
        at = new.select("v", F.col("__next").alias("parent"))
    raise RuntimeError(f"pointers aren't settled in {rounds} rounds; is there a cycle?")


def _trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """``edges`` without those of vertices that nothing leads to, or that lead nowhere: these are on no cycle."""
    for _ in range(rounds):
        into, out = edges.select(F.col("dst").alias("__v")).distinct(), edges.select(F.col("src").alias("__v")).distinct()
        edges = kept(edges.join(unsent(into), F.col("src") == F.col("__v"), "left_semi").join(unsent(out), F.col("dst") == F.col("__v"), "left_semi"))
    return edges


def components(edges: DataFrame, rounds: int = MAX_ROUNDS, trims: int = 2) -> DataFrame:
    """v, label, size: strongly connected components with a cycle, labelled by their smallest vertex.

    By colouring, in O(V + E) rows a round: every vertex takes the least vertex that leads to it, in an order drawn anew each
    time; those that lead back to their colour's own vertex are its component. What is settled goes, and the rest is coloured again.
    """
    left = kept(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    loops = left.where("src = dst").select(F.col("src").alias("v"), F.col("dst").alias("label"), F.lit(-1).cast("long").alias("turn"))
    found, left = [kept(loops)], kept(left.where("src <> dst"))
    for turn in range(rounds):
        left = _trimmed(left, trims)
        if not some(left):
            break
        order = lambda v: F.struct(F.xxhash64(v, F.lit(turn)).alias("h"), F.col(v).alias("v"))  # noqa: B023, E731
        vertices = left.select(F.col("src").alias("v")).union(left.select("dst")).distinct()
        colour = new = kept(vertices.select("v", order("v").alias("c")))
        few = left.count() <= FEW_ROWS
        for _ in range(rounds):
            now, moving = colour.withColumn("was", F.col("c")), new
            for _ in range(HOPS if few else 1):
                offered = unsent(left).join(moving.select(F.col("v").alias("src"), "c"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("offer"))
                now = now.join(unsent(offered), "v", "left").select("v", F.least("c", F.coalesce("offer", "c")).alias("c"), "was")
                moving = now.where("c < was").select("v", "c")
            now = kept(now)
            colour, new = now.select("v", "c"), now.where("c < was").select("v", "c")
            if not some(new):
                break
        own = colour.select("v", F.col("c.v").alias("label"))
        one, two = own.select(F.col("v").alias("src"), F.col("label").alias("a")), own.select(F.col("v").alias("dst"), F.col("label").alias("b"))
        back = left.join(unsent(one), "src").join(unsent(two), "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        settled = kept(closure(own.where("v = label").select("label", "v"), back, "v", rounds=rounds).select("v", "label"))
        found.append(settled.withColumn("turn", F.lit(turn).cast("long")))
        gone = settled.select(F.col("v").alias("__v"))
        left = kept(left.join(unsent(gone), F.col("src") == F.col("__v"), "left_anti").join(unsent(gone), F.col("dst") == F.col("__v"), "left_anti"))
    else:
        raise RuntimeError(f"not settled in {rounds} rounds")
    # A vertex with a loop may be in a larger component too.
    member = _together(found).groupBy("v").agg(F.max_by("label", "turn").alias("root"), F.bool_or(F.col("turn") < 0).alias("loop"))
    named = member.groupBy("root").agg(F.min("v").alias("label"), F.count(F.lit(1)).alias("size"), F.bool_or("loop").alias("loop")).where("size > 1 or loop")
    return member.select("v", "root").join(named.select("root", "label", "size"), "root").select("v", "label", "size")
