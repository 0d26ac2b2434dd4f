"""Graph operators on edges (src, dst), records (importer, rec_idx, importee, kind) and entries (entry_idx, module_idx)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.fixpoint import closure, kept, least_fixpoint, some, unsent

#: So many pairs go to one task.
PAIRS = 10_000_000


def edges_of(records: DataFrame, *kinds: str) -> DataFrame:
    """src, dst of the resolved records of these kinds, or of all."""
    rows = records.where(F.col("kind").isin(*kinds)) if kinds else records
    return rows.where("importee is not null").select(F.col("importer").alias("src"), F.col("importee").alias("dst")).distinct()


def reach(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """entry_idx, module_idx: what every entry reaches, itself among it."""
    return closure(entries.select("entry_idx", "module_idx"), edges, "module_idx")


def reachable_pairs(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, reachable for all pairs of entries: is there a path of one edge or more?

    There are as many rows as pairs, but pairs are neither shuffled nor stored: a source keeps the targets it reaches as words of 64 bits
    (``entry_idx`` counts from 0 without gaps), and each pair is made from its source's row and the list of targets by words. That list, 8 bytes an entry, goes to all executors.
    """
    entries = kept(entries.select("entry_idx", "module_idx"))
    n = entries.count()
    at = entries.select((F.col("entry_idx") % 64).cast("int").alias("bit"), F.floor(F.col("entry_idx") / 64).alias("word"), F.col("module_idx").alias("dst"))
    e = kept(edges)
    found = closure(e.join(entries, e.src == entries.module_idx, "left_semi").select("src", "dst"), e, "dst").join(at, "dst")
    words = found.groupBy("src", "word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    held = words.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    sources = entries.select(F.col("module_idx").alias("src")).join(held, "src", "left").repartition(max(1, min(n, n * n // PAIRS)), "src")
    targets = at.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("bit", "dst"))), lambda t: t.dst).alias("targets"))
    wide = sources.crossJoin(F.broadcast(targets)).select("src", F.coalesce(F.try_element_at("held", "word"), F.lit(0)).alias("bits"), "targets")
    return wide.select("src", "bits", F.posexplode("targets").alias("bit", "dst")).select("src", "dst", (F.getbit("bits", "bit") == 1).alias("reachable"))


def loaded(stat: DataFrame, dyn: DataFrame, users: DataFrame) -> DataFrame:
    """entry_idx, loaded: how many atoms are surely loaded before each dynamic entry that is met on a way from ``users``.

    An entry's importers (importer, d) each bring what they load themselves (``stat``: entry_idx, module_idx) and what was loaded before them;
    sure is what all bring, in the greatest fixpoint. It lies within what one chain of importers from a user entry brings, so only those
    atoms are candidates, and rows are never made for the absent ones. A user entry is no dynamic one.
    """
    stat, dyn = kept(stat), kept(dyn)
    # Importers that are never loaded take nothing away.
    depth = kept(distances(users.select(F.col("entry_idx").alias("v")), dyn.select(F.col("importer").alias("src"), F.col("d").alias("dst"))))
    dyn = kept(dyn.join(depth.select(F.col("v").alias("importer"), "depth"), "importer"))
    own = stat.groupBy(F.col("entry_idx").alias("importer")).agg(F.count(F.lit(1)).alias("n"))
    deep = depth.where("depth > 0").select(F.col("v").alias("d"), F.col("depth").alias("own_depth"))
    chain = kept(dyn.join(deep, "d").where("depth = own_depth - 1").join(own, "importer", "left").groupBy("d").agg(F.min_by("importer", F.struct(F.coalesce("n", F.lit(0)), "importer")).alias("parent")))

    below = chain.select(F.col("d").alias("__d"), F.col("parent").alias("d"))

    def down(new):
        return new.join(below, "d").select(F.col("__d").alias("d"), "module_idx")

    may = kept(least_fixpoint(chain.join(stat, chain.parent == stat.entry_idx).select("d", "module_idx"), down))
    # Candidates that an importer doesn't load itself; absent if that one is a user entry or lacks them too.
    lacks = kept(dyn.join(may, "d").join(stat.withColumnRenamed("entry_idx", "importer"), ["importer", "module_idx"], "left_anti").select("importer", "d", "module_idx", "depth"))
    before = may.withColumnRenamed("d", "importer")
    unsure = lacks.where("depth > 0").join(before, ["importer", "module_idx"], "left_anti").select(*lacks.columns)
    first = lacks.where("depth = 0").unionByName(unsure).select(F.col("d").alias("e"), "module_idx")
    passed = kept(lacks.where("depth > 0").select(F.col("importer").alias("e"), "module_idx", "d"))

    def step(new):
        return new.join(passed, ["e", "module_idx"]).select(F.col("d").alias("e"), "module_idx")

    absent = least_fixpoint(first, step).withColumnRenamed("e", "d")
    sure = may.join(absent, ["d", "module_idx"], "left_anti").groupBy("d").agg(F.count(F.lit(1)).alias("loaded"))
    met = dyn.select("d").distinct()
    return met.join(sure, "d", "left").select(F.col("d").alias("entry_idx"), F.coalesce("loaded", F.lit(0)).alias("loaded"))


def backward(seeds: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """v: seeds and what reaches them; vertices in ``stop`` are not passed nor entered."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if stop is not None:
        turned = turned.join(stop.select(F.col("v").alias("dst")), "dst", "left_anti").select("src", "dst")
    return closure(seeds.select("v"), turned, "v")


def post_order(entries: list[int], edges: dict[int, list[int]]) -> list[int]:
    """Depth first from the entries in order, along each vertex's edges in order; a vertex comes after what it leads to."""
    out, state = [], {}
    for e in entries:
        stack = [(e, iter(edges.get(e, ())))] if e not in state else []
        state.setdefault(e, 1)
        while stack:
            v, rest = stack[-1]
            for w in rest:
                if w not in state:
                    state[w] = 1
                    stack.append((w, iter(edges.get(w, ()))))
                    break
            else:
                out.append(v)
                stack.pop()
    return out


def execution_order(entries: DataFrame, records: DataFrame) -> DataFrame:
    """graph, module_idx, exec_order, for each value of ``graph`` in the records (graph, importer, rec_idx, importee) and entries.

    The order of a depth-first search is sequential by nature: each graph is one group, read by one task.
    """
    rows = entries.select("graph", F.lit(None).cast("long").alias("importer"), F.col("entry_idx").cast("long").alias("rec_idx"), F.col("module_idx").alias("importee")).unionByName(
        records.select("graph", "importer", F.col("rec_idx").cast("long").alias("rec_idx"), "importee")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rec_idx", kind="stable")
        first = pdf["importer"].isna()
        edges: dict[int, list[int]] = {}
        for a, b in zip(pdf.loc[~first, "importer"].astype("int64"), pdf.loc[~first, "importee"], strict=True):
            edges.setdefault(int(a), []).append(int(b))
        order = post_order([int(x) for x in pdf.loc[first, "importee"]], edges)
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "module_idx": order, "exec_order": range(len(order))})

    return rows.groupBy("graph").applyInPandas(run, "graph string, module_idx long, exec_order long")


def distances(seeds: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """v, depth: how many edges from the nearest seed; breadth first, each vertex once."""
    new = seen = kept(seeds.select("v", F.lit(0).alias("depth")).distinct())
    for depth in range(1, rounds):
        found = unsent(new).join(edges, new.v == edges.src).select(F.col("dst").alias("v")).distinct()
        new = kept(found.join(unsent(seen), "v", "left_anti").withColumn("depth", F.lit(depth)))
        if not some(new):
            return seen
        seen = kept(seen.unionByName(new))
    raise RuntimeError("too deep")


def statements(mod: DataFrame) -> DataFrame:
    """stmt, module_idx, s, effect: three statements a module."""
    s = mod.select("module_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("s"))
    return s.select((F.col("module_idx") * 3 + F.col("s")).alias("stmt"), "module_idx", "s", ((F.col("module_idx") + F.col("s")) % 4 == 0).alias("effect"))


def inclusion(roots_: DataFrame, stmts: DataFrame, uses: DataFrame) -> DataFrame:
    """k, key: the included modules (0) and statements (1); a module brings its effects, a statement its module and what it uses."""
    brings = (
        stmts.where("effect").select(F.lit(0).alias("k"), F.col("module_idx").alias("key"), F.lit(1).alias("k2"), F.col("stmt").alias("key2"))
        .unionByName(stmts.select(F.lit(1).alias("k"), F.col("stmt").alias("key"), F.lit(0).alias("k2"), F.col("module_idx").alias("key2")))
        .unionByName(uses.select(F.lit(1).alias("k"), F.col("stmt").alias("key"), F.lit(1).alias("k2"), F.col("target").alias("key2")))
    )
    brings = kept(brings)

    def step(new):
        return new.join(brings, ["k", "key"]).select(F.col("k2").alias("k"), F.col("key2").alias("key"))

    return least_fixpoint(roots_.select(F.lit(0).alias("k"), F.col("module_idx").alias("key")), step)
