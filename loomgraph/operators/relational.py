"""Chunks, bindings, as-of joins, snapshots, rules and ordered scans on tables of modules and records."""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.fixpoint import kept, least_fixpoint, unsent
from loomgraph.operators.graph import edges_of, reach


def chunk_modules(mod: DataFrame, rec: DataFrame, ent: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """module_idx, entry_set, chunk_idx and the module's columns: modules with the same entries share a chunk.

    Chunks are numbered over their distinct sets, of which there are as many as chunks, not as modules. ``reached`` is what the entries
    reach, where the caller has it.
    """
    reached = reach(ent, edges_of(rec)) if reached is None else reached
    sets = reached.groupBy("module_idx").agg(F.sort_array(F.collect_set("entry_idx")).alias("entry_set"))
    sets = kept(sets.withColumn("key", F.array_join(F.col("entry_set").cast("array<string>"), ",")))
    numbered = sets.select("key").distinct().withColumn("chunk_idx", F.row_number().over(Window.orderBy("key")) - 1)
    return sets.join(unsent(numbered), "key").join(unsent(mod.select("module_idx", "size", "id", "package_id", "module_type", "has_side_effects")), "module_idx").drop("key")


def merge_targets(chunks: DataFrame, rec: DataFrame, ent: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """chunk_idx, target, verdict: into which entry each shared chunk of ``chunk_modules`` may be folded, or why into none.

    The target is the entry whose module all other user entries of the chunk (without any, all dynamic ones) import
    statically; of several the first. It isn't taken if it doesn't reach all the chunk's dynamic entries (``unreached``), if it has
    side effects that another user entry's load of one of those would run (``leaks``), if a dynamic entry in the chunk is
    imported from outside both (``importers``), or, among dynamic entries, if another one's module lies in the chunk (``pollutes``).
    Entries of a chunk are counted, never paired. ``reached`` is what all entries reach, where the caller has it.
    """
    table = lambda df: unsent(kept(df))
    chunks, ent, rec = table(chunks.select("module_idx", "entry_set", "chunk_idx", "has_side_effects")), table(ent), table(rec.select("importer", "importee", "kind"))
    shared = chunks.where(F.size("entry_set") > 1).select("chunk_idx", "entry_set").distinct()
    member = table(shared.select("chunk_idx", F.explode("entry_set").alias("entry_idx")).join(ent, "entry_idx"))
    sizes = member.groupBy("chunk_idx").agg(F.count_if(F.col("kind") == 0).alias("users"), F.count_if(F.col("kind") == 1).alias("dynamics"))
    group = table(member.join(sizes, "chunk_idx").where("users = 0 or kind = 0").select("chunk_idx", "entry_idx", "module_idx", "users", "dynamics"))
    static = rec.where("kind <> 'dynamic-import' and importer <> importee").select("importer", "importee").distinct()
    asked = group.join(static, group.module_idx == static.importer).groupBy("chunk_idx", F.col("importee").alias("module_idx")).agg(F.count(F.lit(1)).alias("n"))
    others = F.when(F.col("users") > 0, F.col("users")).otherwise(F.col("dynamics")) - 1
    targets = group.join(asked, ["chunk_idx", "module_idx"], "left").where(F.coalesce("n", F.lit(0)) == others).groupBy("chunk_idx").agg(F.min("entry_idx").alias("t"))
    plan = table(sizes.join(targets, "chunk_idx", "left"))
    # What user entries reach: (user entry, dynamic entry).
    dynamic = ent.where("kind = 1").select(F.col("entry_idx").alias("d"), "module_idx")
    users = ent.where("kind = 0")
    reached = reach(users, edges_of(rec)) if reached is None else reached.join(unsent(users.select("entry_idx")), "entry_idx", "left_semi")
    reached = table(reached.join(unsent(dynamic), "module_idx").select("entry_idx", "d").distinct())
    inside = table(member.where("kind = 1").select("chunk_idx", F.col("entry_idx").alias("d")).join(plan.where("users > 0 and t is not null").select("chunk_idx", "t"), "chunk_idx"))
    missing = inside.join(reached.select(F.col("entry_idx").alias("t"), "d"), ["t", "d"], "left_anti").select("chunk_idx").distinct().withColumn("unreached", F.lit(True))
    by = reached.groupBy("d").agg(F.min("entry_idx").alias("low"), F.max("entry_idx").alias("high"))
    effects = chunks.where(F.size("entry_set") == 1).groupBy(F.element_at("entry_set", 1).alias("t")).agg(F.bool_or("has_side_effects").alias("effects")).where("effects")
    leaks = inside.join(effects, "t").join(by, "d").where("low <> t or high <> t").select("chunk_idx").distinct().withColumn("leaks", F.lit(True))
    # Dynamic entries that lie in the chunk, and from where they are imported.
    held = chunks.join(dynamic, "module_idx").select("chunk_idx", "d", "module_idx")
    own = chunks.select(F.col("module_idx").alias("importer"), F.col("chunk_idx").alias("home"), F.when(F.size("entry_set") == 1, F.element_at("entry_set", 1)).alias("home_entry"))
    from_ = held.join(plan.where("users > 0 and t is not null").select("chunk_idx", "t"), "chunk_idx").join(rec.where("kind = 'dynamic-import'").select("importer", F.col("importee").alias("module_idx")).distinct(), "module_idx")
    entry_modules = dynamic.select(F.col("module_idx").alias("importer"), F.lit(True).alias("is_dynamic"))
    placed = from_.join(own, "importer", "left").join(entry_modules, "importer", "left")
    fine = (F.col("home_entry") == F.col("t")) | ((F.col("home") == F.col("chunk_idx")) & F.col("is_dynamic").isNull())
    outside = placed.where(~F.coalesce(fine, F.lit(False))).select("chunk_idx").distinct().withColumn("importers", F.lit(True))
    pollutes = held.join(plan.where("users = 0 and t is not null").select("chunk_idx", "t"), "chunk_idx").where("d <> t").join(member.select("chunk_idx", F.col("entry_idx").alias("d")), ["chunk_idx", "d"], "left_semi").select("chunk_idx").distinct().withColumn("pollutes", F.lit(True))
    out = plan
    for flag in (missing, leaks, outside, pollutes):
        out = out.join(unsent(flag), "chunk_idx", "left")
    verdict = F.when(F.col("t").isNull(), "no_target").when(F.col("pollutes"), "pollutes").when(F.col("unreached"), "unreached").when(F.col("leaks"), "leaks").when(F.col("importers"), "importers").otherwise("merged")
    return out.select("chunk_idx", F.when(verdict == "merged", F.col("t")).alias("target"), verdict.alias("verdict"))


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modified and content of the files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def merge_snapshot(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with all rows of the keys in ``delta`` replaced by those of ``delta``."""
    return base.join(delta.select(*keys).distinct(), keys, "left_anti").unionByName(delta)


def write_outputs(df: DataFrame, path: str, by: list[str], clean: bool = True) -> None:
    """Writes a table partitioned by columns; with ``clean`` what was there goes first."""
    df.write.mode("overwrite" if clean else "append").partitionBy(*by).parquet(path)


def chunk_edges(rec: DataFrame, chunks: DataFrame) -> DataFrame:
    a, b = chunks.select(F.col("module_idx").alias("importer"), F.col("chunk_idx").alias("src")), chunks.select(F.col("module_idx").alias("importee"), F.col("chunk_idx").alias("dst"))
    return rec.join(unsent(a), "importer").join(unsent(b), "importee").where("src <> dst").select("src", "dst").distinct()


def exports(mod: DataFrame) -> DataFrame:
    return mod.select("module_idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).where("(module_idx + k) % 3 <> 0").select("module_idx", F.concat(F.lit("e"), F.col("k").cast("string")).alias("name"))


def imports(rec: DataFrame) -> DataFrame:
    return rec.where("kind = 'import-statement'").select("importer", "rec_idx", "importee", F.when(F.col("rec_idx") % 5 == 4, "*").otherwise(F.concat(F.lit("e"), (F.col("rec_idx") % 3).cast("string"))).alias("name"))


def star_exports(exports_: DataFrame, stars: DataFrame) -> DataFrame:
    """root, name, origin: what a module exports itself or by export *; own names shadow those from below."""
    own = kept(exports_)
    first = own.where("name <> 'default'").select(F.col("module_idx").alias("root"), F.col("module_idx").alias("origin"), "name")
    up = kept(stars)

    def step(new):
        found = new.join(up, new.root == up.dst).select(F.col("src").alias("root"), "origin", "name")
        return found.join(own.select(F.col("module_idx").alias("root"), "name"), ["root", "name"], "left_anti").select("root", "origin", "name")

    return least_fixpoint(first, step)


def client_needs(clients: DataFrame, mod: DataFrame, shipped: DataFrame) -> DataFrame:
    """The result itself is a row for each affected module and client, so clients (few) meet affected modules only."""
    stale = shipped.join(mod, "module_idx").where("latest > stamp").select("client", "module_idx")
    lacking = clients.join(mod.where("affected").select("module_idx"), F.lit(True)).join(shipped.select("client", "module_idx"), ["client", "module_idx"], "left_anti")
    return stale.unionByName(lacking).distinct()


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the nearest row of ``right`` at or before it: one sort of both sides, no join.

    ``at`` must be unique in ``right`` for each key; a row without a predecessor gets null.
    """
    cols = [c for c in left.columns if c not in (*by, at)]
    both = left.select(*by, at, *cols, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(right.select(*by, at, F.lit(0).alias("__side"), value), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__side = 1").drop("__side")


def match_rules(mod: DataFrame, rules: DataFrame) -> DataFrame:
    """All rules each module meets; the rule table is a configuration of a few rows."""
    return mod.join(rules, F.contains("id", "test") & F.col("size").between(F.col("min_size"), F.col("max_size")))


def merge_small(groups: pd.DataFrame, least: float) -> pd.DataFrame:
    """Greedy: the smallest group below ``least`` joins the one with the nearest entries (then size, then key); keys are distinct.

    Only groups that share an entry are compared: of all others the one with the fewest entries is nearest.
    """
    size, key, n = [float(s) for s in groups["size"]], [str(k) for k in groups["key"]], [1] * len(groups)
    own: list[set | None] = [set(e) for e in groups["entry_set"]]
    holders: dict = {}
    for g, entries in enumerate(own):
        for e in entries:
            holders.setdefault(e, set()).add(g)
    # Outdated rows stay in both heaps, and are skipped.
    by_size, by_width = [(size[g], key[g], g) for g in range(len(own))], [(len(e), size[g], key[g], g) for g, e in enumerate(own)]
    heapq.heapify(by_size)
    heapq.heapify(by_width)
    left = len(own)
    while left > 1:
        while own[(g := by_size[0][2])] is None or by_size[0][:2] != (size[g], key[g]):
            heapq.heappop(by_size)
        if by_size[0][0] >= least:
            break
        heapq.heappop(by_size)
        small, own[g] = own[g], None
        while own[(w := by_width[0][3])] is None or by_width[0][:3] != (len(own[w]), size[w], key[w]):
            heapq.heappop(by_width)
        common = {w: 0}
        for e in small:
            holders[e].discard(g)
            for h in holders[e]:
                common[h] = common.get(h, 0) + 1
        best = min(common, key=lambda h: (len(own[h]) - 2 * common[h], size[h], key[h]))
        size[best], key[best], n[best] = size[best] + size[g], min(key[best], key[g]), n[best] + n[g]
        own[best] |= small
        for e in small:
            holders[e].add(best)
        heapq.heappush(by_size, (size[best], key[best], best))
        heapq.heappush(by_width, (len(own[best]), size[best], key[best], best))
        left -= 1
    rest = sorted((g for g, e in enumerate(own) if e is not None), key=lambda g: (size[g], key[g]))
    return pd.DataFrame([(key[g], sorted(own[g]), size[g], n[g]) for g in rest], columns=["key", "entry_set", "size", "merged"])


def in_flight(calls: DataFrame, by: list[str]) -> DataFrame:
    """by, at, n, dt: how many spans are open from each point on, and for how long; one row a point of time."""
    points = calls.select(*by, F.inline(F.array(F.struct(F.col("start_us").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("d")))))
    steps = points.groupBy(*by, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("at")
    return steps.select(*by, "at", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), (F.lead("at").over(w) - F.col("at")).alias("dt"))


def best_split(keys: list[str], sizes: list[float], least: float, most: float) -> int | None:
    """Where to cut an ordered list: both sides of ``least`` or more; candidates are scanned in order, for the comparison isn't transitive."""
    total, left, best = sum(sizes), 0.0, None
    for i in range(1, len(keys)):
        left += sizes[i - 1]
        if left < least or total - left < least:
            continue
        alike = sum(max(0, 10 - abs(a - b)) for a, b in zip(keys[i - 1].encode(), keys[i].encode(), strict=False))
        new = (i, alike, (left > most) + (total - left > most), max(left, total - left))
        if best is None or (new[1] < best[1] if abs(new[1] - best[1]) > 10 else new[2] < best[2] or (new[2] == best[2] and new[3] < best[3])):
            best = new
    return best and best[0]


def unique_names(names: list[str]) -> list[str]:
    """Counters from 2 on, before the extension, which begins at the first dot but a leading one of the last path segment.

    Names differ in more than ASCII case, unless they hold hash placeholders. Each name keeps its own counter of how often it was asked for.
    """
    asked: dict[str, int] = {}
    out = []
    for name in names:
        file = name.rsplit("/", 1)[-1]
        dot = file.find(".", 1) if file != ".." else -1
        ext = file[dot:] if dot > 0 else ""
        stem, new = name[: len(name) - len(ext)], name
        while (key := new if _PLACEHOLDER.search(new) else new.translate(_ASCII_LOWER)) in asked:
            n = asked[key]
            asked[key] = n + 1
            new = f"{stem}{n}{ext}"
        asked[key] = 2
        out.append(new)
    return out


_PLACEHOLDER = re.compile(r"!~\{[0-9a-zA-Z_$]+\}~")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def conflict_names(bases: list[str]) -> list[str]:
    """The first to ask for a name gets it, later ones name$1, name$2 and so on, past those that others have as their base."""
    used: dict[str, int] = {}
    out = []
    for base in bases:
        new, n = base, 0
        if base in used:
            used[base] += 1
            n = used[base]
            while (new := f"{base}${n}") in used:
                used[new] += 1
                n = used[new]
        used[new] = 0
        out.append(new)
    return out


def copy_files(found: DataFrame, root: str, folder: str) -> DataFrame:
    """file (path below ``root``) and length of the copies of ``found`` (path, content) in a mounted folder; a repeated task replaces its own."""
    import os
    import uuid

    root = "/" + re.sub(r"^file:/*", "", root).strip("/") + "/"

    def run(batches):
        for b in batches:
            names = []
            for path, content in zip(b["path"], b["content"], strict=True):
                at = "/" + re.sub(r"^file:/*", "", path).lstrip("/")
                if not at.startswith(root):
                    raise ValueError(f"{path} is not below {root}")
                names.append(at[len(root) :])
                os.makedirs(os.path.dirname(to := f"{folder}/{names[-1]}"), exist_ok=True)
                with open(own := f"{to}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(content)
                os.replace(own, to)
            yield pd.DataFrame({"file": names, "length": [os.path.getsize(f"{folder}/{n}") for n in names]})

    return found.select("path", "content").mapInPandas(run, "file string, length long")
