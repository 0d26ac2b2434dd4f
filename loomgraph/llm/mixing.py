"""Mixing sources to target weights by exact budgets.

Sources in code point order, null last, weigh as ``weights`` says, repeated; together they get 100 % of all sizes, a
source at most MOST times its own, the excess shared again by weight. Within a source every document is taken
``floor(target / size)`` times; the rest of the budget is met by a choice of documents counted by exact length: a
proportional part of every length, then a bounded-knapsack dynamic programme over the lengths left for the last words. Which documents
of a length are taken is decided by a seeded hash.

Size: runs of ``[^\\x20\\x09-\\x0D]+``. Cases: null or empty text has size 0 and counts for nothing; a null source is a
source; null doc_ids and rows that share an id are documents of their own (repeated equal rows differ in nothing, so it
is left open which of them is taken once more); other columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import order_id, saved, small, text_hash

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 20_25
#: Words of a budget that are left to the dynamic programme.
RESERVE = 1 << 16
SIZE = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words that each source should give. One entry a source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def choose(sizes: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many of each length to take, at most ``counts``, so that the words come near ``budget``; if that is at most ``reserve``, as near below as can be."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.copy()
    if budget > reserve and 2 * budget > total:  # choose what stays out: then the words come as near above
        return counts - choose(sizes, counts, total - budget, reserve)
    share = counts * (max(0, budget - reserve) / total)
    taken = np.floor(share).astype(np.int64)
    left = budget - int((sizes * taken).sum())
    for i in np.lexsort((sizes, taken - share)).tolist():  # the largest fractions first
        if left - sizes[i] >= reserve and taken[i] < counts[i]:
            taken[i] += 1
            left -= int(sizes[i])
    for i in np.argsort(-sizes).tolist():
        if left <= reserve:
            break
        n = min(int(counts[i] - taken[i]), int((left - reserve) // sizes[i])) if sizes[i] else 0
        taken[i] += max(0, n)
        left -= max(0, n) * int(sizes[i])
    # Bounded knapsack: bit s of ``reach`` says that s words can be met; parent[s] is the part that first met them.
    left = min(left, total)
    reach, parent, parts = 1, np.full(left + 1, -1, np.int64), []
    for i in np.argsort(-sizes).tolist():
        n, size = int(counts[i] - taken[i]), int(sizes[i])
        if not 0 < size <= left or n <= 0 or (reach >> left) & 1:
            continue
        n, k = min(n, left // size), 1
        while n > 0:
            k = min(k, n)
            new = (reach << (k * size)) & ~reach & ((1 << (left + 1)) - 1)
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
                parent[np.flatnonzero(bits)] = len(parts)
                reach |= new
            parts.append((i, k))
            n, k = n - k, 2 * k
    at = reach.bit_length() - 1
    while at > 0:
        i, k = parts[int(parent[at])]
        taken[i] += k
        at -= k * int(sizes[i])
    return taken


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, doc, th, source, size, source_size, target, copies: for every row of ``docs``."""
    spark = docs.sparkSession
    rows = saved(
        docs.select(
            F.col("doc_id"),
            order_id().alias("doc"),
            text_hash().alias("th"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SIZE)).cast("long").alias("size"),
        ).withColumns({"src": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), "h": F.xxhash64(F.lit(seed), "doc", "th")}),
        "sized",
    )
    per = {r.source: r.size for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}  # one row a source
    want = targets(per, weights, most)
    budget = []
    for s, size in per.items():
        times = min(most, int(want[s] // size)) if size else 1
        rest = min(size, round(want[s] - times * size)) if times < most else 0
        budget.append(("n" if s is None else "s" + s, size, want[s], times, max(0, rest)))
    budgets = small(spark, [("src", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("times", pa.int32()), ("rest", pa.int64())], budget)

    def pick(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("size")
        lengths["extra"] = choose(lengths["size"].to_numpy(), lengths["n"].to_numpy(), int(lengths["rest"].iloc[0]))
        return lengths[["src", "size", "extra"]]

    # A group is the lengths of one source: as many rows as there are lengths.
    extra = rows.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")).join(budgets, "src").select("src", "size", "n", "rest").groupBy("src").applyInPandas(pick, "src string, size long, extra long").where("extra > 0")
    # Of each length the smallest hashes: all of the lower buckets of 2**16, and in the last one by rank.
    bucket = F.shiftrightunsigned(F.col("h"), 48)
    per_length = Window.partitionBy("src", "size").orderBy("bucket")
    cut = (
        rows.groupBy("src", "size", bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(per_length.rowsBetween(Window.unboundedPreceding, 0)))
        .join(extra, ["src", "size"])
        .where("upto >= extra and upto - n < extra")
        .select("src", "size", F.col("bucket").alias("cut"), (F.col("extra") - F.col("upto") + F.col("n")).alias("in_cut"))
    )
    marked = rows.withColumn("bucket", bucket).join(cut, ["src", "size"], "left").join(budgets, "src")
    sure = F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False))
    edge = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("h", "doc", "th"))
    cols = ["doc_id", "doc", "th", "source", "size", "source_size", "target"]
    flat = marked.where(~edge).select(*cols, (F.col("times") + sure.cast("int")).alias("copies"))
    last = marked.where(edge).select(*cols, (F.col("times") + (rank <= F.col("in_cut")).cast("int")).alias("copies"))
    return flat.unionByName(last)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it is taken."""
    # Equal rows are alike: their copies are added up, and dealt to them anew.
    copies = plan(docs, **how).groupBy("doc", "th", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__src")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    one = docs.withColumns({"__doc": order_id(), "__th": text_hash(), "__src": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))})
    joined = one.join(copies.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), "__src", F.col("copies").alias("__copies"), F.col("rows").alias("__rows")), ["__doc", "__th", "__src"])
    alike = Window.partitionBy("__doc", "__th", "__src").orderBy("__doc")
    single = joined.where("__rows = 1").withColumn("__k", F.col("__copies"))
    several = joined.where("__rows > 1").withColumn("__k", F.floor(F.col("__copies") / F.col("__rows")) + (F.row_number().over(alike) <= F.col("__copies") % F.col("__rows")).cast("int"))
    return single.unionByName(several).where("__k > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__k").cast("int")))).select(*docs.columns)


