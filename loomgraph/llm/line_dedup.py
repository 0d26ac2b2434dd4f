"""Line dedup that can be undone: exact reference counts of lines, with a sharded cuckoo filter of the repeated ones in front.

A line's key is the line stripped of white space at both ends with A-Z lower-cased; only keys of MIN_CHARS code points or
more count, and a key is held as its MD5. ``LineIndex`` keeps two tables, a folder for each key shard: ``postings`` (which
document holds which key) and ``refs`` (how many hold it, and the smallest doc_id), and for each shard a cuckoo filter of
the keys that more than one document holds. ``insert`` and ``delete`` give a new version, which shares the files of all
shards that aren't touched with the old one; of a touched shard the filter is written only if its repeated keys changed, by
inserting and deleting fingerprints (anew if it gets too full). ``drops`` asks the filters first, so that only lines which
may be repeated meet the exact table.

Skew: a line that many documents hold is spread over tasks by document, when postings are written, when filters are asked
and when it meets its owner (from SPREAD documents on).

Cases: null or empty text is one empty line; null doc_ids are one document, smaller than all others; rows with the same
doc_id are the same document, so a line in two of them alone isn't repeated, and the smallest doc_id keeps a line wherever
its rows hold it; repeated rows are treated alike; very long texts are split whole, in one task each; other columns
stay (a result's name among them is refused; ``__doc``, ``__th`` and ``__dropped`` are its own); an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACES, local_path, mix, order_id, partitions, saved, scratch, text_hash

MIN_CHARS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tasks that share the lines of one key shard, so that a hot line doesn't make one long task.
SALT = 8
#: Documents of one line that meet its owner in one task.
SPREAD = 100_000
RESULTS = ("n_lines", "n_dropped", "kept_text")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """MD5 of the line's key; null for keys too short to count."""
    k = F.translate(F.trim(line, F.lit(SPACES)), UPPER, LOWER)
    return F.when(F.char_length(k) >= MIN_CHARS, F.unhex(F.md5(k.cast("binary"))))


def keyed(docs: DataFrame) -> DataFrame:
    """doc, th, keys (of all lines, null for those that don't count): a row for each row of ``docs``."""
    return docs.select(order_id().alias("doc"), text_hash().alias("th"), F.transform(lines_of(F.col("text")), key_of).alias("keys"))


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each in one of two buckets; a few that found no room lie apart."""

    WAYS, KICKS = 4, 500

    def __init__(self, n: int = 0, buckets: np.ndarray | None = None, apart: np.ndarray | None = None):
        size = 1 << max(4, int(np.ceil(np.log2(max(1, n) / (0.7 * self.WAYS)))))
        self.b = np.zeros((size, self.WAYS), np.uint16) if buckets is None else buckets
        self.apart = set() if apart is None else set(apart.tolist())

    def _where(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(np.asarray(h).astype(np.int64).view(np.uint64))
        mask = np.uint64(len(self.b) - 1)
        fp = ((h >> np.uint64(48)) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        one = h & mask
        return fp, one.astype(np.int64), (one ^ (mix(fp.astype(np.uint64)) & mask)).astype(np.int64)

    def insert(self, h: np.ndarray) -> None:
        fp, one, two = self._where(h)
        left = np.arange(len(fp))
        for turn in range(4 * self.WAYS):
            if not len(left):
                return
            at = (one, two)[turn % 2][left]
            _, first = np.unique(at, return_index=True)
            mine = left[first]
            at = at[first]
            room = self.b[at] == 0
            ok = room.any(1)
            self.b[at[ok], room[ok].argmax(1)] = fp[mine[ok]]
            left = np.setdiff1d(left, mine[ok], assume_unique=True)
        rng = np.random.default_rng(1)
        for i in left.tolist():
            f, at = int(fp[i]), int(one[i])
            for _ in range(self.KICKS):
                room = np.flatnonzero(self.b[at] == 0)
                if len(room):
                    self.b[at, room[0]] = f
                    break
                way = int(rng.integers(self.WAYS))
                f, self.b[at, way] = int(self.b[at, way]), f
                at = int(np.uint64(at) ^ (mix(np.array([f], np.uint64))[0] & np.uint64(len(self.b) - 1)))
            else:
                self.apart.add((f << 40) | at)

    def _pairs(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (fp.astype(np.int64) << 40) | at

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, one, two = self._where(h)
        hit = (self.b[one] == fp[:, None]).any(1) | (self.b[two] == fp[:, None]).any(1)
        if self.apart:
            apart = np.array(list(self.apart))
            hit |= np.isin(self._pairs(fp, one), apart) | np.isin(self._pairs(fp, two), apart)
        return hit

    def delete(self, h: np.ndarray) -> None:
        """Takes out keys that were put in."""
        fp, one, two = self._where(h)
        for f, a, b in zip(fp.tolist(), one.tolist(), two.tolist(), strict=True):
            for at in (a, b):
                if len(way := np.flatnonzero(self.b[at] == f)):
                    self.b[at, way[0]] = 0
                    break
                if (f << 40) | at in self.apart:
                    self.apart.discard((f << 40) | at)
                    break

    @property
    def load(self) -> float:
        return float((self.b != 0).mean())

    def save(self, path: str) -> None:
        with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            np.savez(f, b=self.b, apart=np.array(sorted(self.apart), np.int64))
        os.replace(own, path)

    @classmethod
    def read(cls, path: str) -> CuckooFilter:
        with np.load(path) as z:
            return cls(buckets=z["b"], apart=z["apart"])


class LineIndex:
    """One version of the state: for each key shard the folder of its ``postings`` and ``refs``, and the file of its filter."""

    POSTINGS, REFS = "key binary, doc long", "key binary, refs long, owner long"

    def __init__(self, spark: SparkSession, shards: int | None = None, where: dict[int, str] | None = None, filters: dict[int, str] | None = None):
        self.spark, self.where, self.filters = spark, where or {}, filters or {}
        self.shards = shards or partitions(spark)

    def _read(self, name: str, schema: str, shards: set[int] | None = None) -> DataFrame:
        paths = [f"{at}/{name}/shard={k}" for k, at in sorted(self.where.items()) if shards is None or k in shards]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", self.POSTINGS)

    @property
    def refs(self) -> DataFrame:
        return self._read("refs", self.REFS)

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _spread(self, rows: DataFrame) -> DataFrame:
        """Rows (shard, doc) so that a shard's are in SALT tasks, by document."""
        salt = F.pmod(F.xxhash64("doc"), F.lit(SALT))
        return rows.repartitionById(self.shards, F.pmod(F.col("shard") + salt * F.lit(max(1, self.shards // SALT)), F.lit(self.shards)).cast("int"))

    def _next(self, postings: DataFrame, touched: set[int]) -> LineIndex:
        """The version in which the touched shards hold ``postings`` (key, doc)."""
        at = scratch(self.spark, "lines")
        self._spread(postings.select("key", "doc", self._shard().alias("shard"))).write.partitionBy("shard").option("compression", "zstd").parquet(f"{at}/postings")
        back = self.spark.read.schema(self.POSTINGS + ", shard int").parquet(f"{at}/postings")
        refs = back.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc").alias("owner"))
        refs.repartitionById(self.shards, F.col("shard")).write.partitionBy("shard").option("compression", "zstd").parquet(f"{at}/refs")
        there = {r.shard for r in self.spark.read.schema(self.REFS + ", shard int").parquet(f"{at}/refs").select("shard").distinct().collect()}  # at most one row a shard
        kept = {k: v for k, v in self.where.items() if k not in touched}
        new = LineIndex(self.spark, self.shards, kept | {k: at for k in there}, {k: v for k, v in self.filters.items() if k in kept})
        new._write_filters(self, touched, local_path(f"{at}/filters"))
        return new

    @staticmethod
    def _shards_of(rows: DataFrame) -> set[int]:
        return {r.shard for r in rows.select("shard").distinct().collect()}  # at most one row a shard

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents of ``docs`` added; a document that is there already keeps its lines, and gets new ones."""
        return self.insert_keyed(keyed(docs))

    def insert_keyed(self, lines: DataFrame) -> LineIndex:
        # A doc_id may come in several rows: pairs are made distinct only among ids that occur more than once.
        own = lines.select("doc", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
        many = lines.groupBy("doc").count().where("count > 1").select("doc")
        if many.limit(1).count():
            own = own.join(many, "doc", "left_anti").unionByName(own.join(many, "doc", "left_semi").distinct())
        if not self.where:
            return self._next(own, set(range(self.shards)))
        touched = self._shards_of(own.select(self._shard().alias("shard")))
        old = self._read("postings", self.POSTINGS, touched)
        return self._next(old.unionByName(own.select("key", "doc").join(old, ["key", "doc"], "left_anti")), touched)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of these doc_ids, as if they had never been inserted."""
        gone = doc_ids.select(order_id().alias("doc")).distinct()
        touched = self._shards_of(self.postings.join(gone, "doc", "left_semi").select(self._shard().alias("shard")))
        return self._next(self._read("postings", self.POSTINGS, touched).join(gone, "doc", "left_anti"), touched)

    def _write_filters(self, old: LineIndex, touched: set[int], folder: str) -> None:
        """Filters of the touched shards: the old file if no key has become repeated or ceased to be, else a new one."""
        os.makedirs(folder, exist_ok=True)
        repeated = lambda ix, name: ix._read("refs", ix.REFS, touched).where("refs > 1").select(ix._shard().alias("shard"), F.xxhash64("key").alias("h"), F.lit(True).alias(name))
        rows = repeated(self, "now")
        rows = rows.join(repeated(old, "was"), ["shard", "h"], "full") if old.where else rows.withColumn("was", F.lit(False))
        before = dict(old.filters)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            t = pa.Table.from_batches(got)
            shard, h = t["shard"][0].as_py(), t["h"].to_numpy()
            now, was = (np.asarray(t[c].fill_null(False)) for c in ("now", "was"))
            path = before.get(shard, "")
            if not path or (now != was).any():
                f = CuckooFilter.read(path) if path else None
                if f is None or now.sum() > 0.9 * f.b.size:
                    f = CuckooFilter(int(now.sum()))
                    f.insert(h[now])
                else:
                    f.delete(h[was & ~now])
                    f.insert(h[now & ~was])
                f.save(path := f"{folder}/{shard}.npz")
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path])], names=["shard", "path"])

        done = rows.repartitionById(self.shards, F.col("shard")).mapInArrow(write, "shard int, path string")
        self.filters |= {r.shard: r.path for r in done.collect()}  # one row a shard

    def drops(self, docs: DataFrame) -> DataFrame:
        """doc, th, dropped: positions of the lines that another, smaller document holds, for rows that have any."""
        return self.drops_keyed(keyed(docs))

    def drops_keyed(self, lines: DataFrame, spread: int = SPREAD) -> DataFrame:
        rows = lines.select("doc", "th", F.posexplode("keys").alias("pos", "key")).where("key is not null")
        filters = dict(self.filters)

        def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, CuckooFilter | None] = {}
            for batch in batches:
                s, h = batch.column("shard").to_numpy(), batch.column("h").to_numpy()
                hit = np.zeros(len(s), bool)
                for k in np.unique(s).tolist():
                    if k not in own:
                        own[k] = CuckooFilter.read(filters[k]) if k in filters else None
                    if own[k] is not None:
                        of = s == k
                        hit[of] = own[k].contains(h[of])
                yield batch.filter(pa.array(hit))

        asked = self._spread(rows.select("key", "doc", "th", "pos", self._shard().alias("shard"), F.xxhash64("key").alias("h")))
        seen = asked.mapInArrow(maybe, "key binary, doc long, th long, pos int, shard int, h long").select("key", "doc", "th", "pos")
        held = saved(self.refs.where("refs > 1").select("key", "owner", F.ceil(F.col("refs") / spread).cast("int").alias("fan")), "held")
        hot = saved(held.where("fan > 1").select("key", "fan"), "hot")  # its size is known to the planner, and mostly nothing
        dealt = seen.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("doc"), F.coalesce("fan", F.lit(1))).cast("int")).drop("fan")
        sent = held.select("key", "owner", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"))
        return dealt.join(sent, ["key", "salt"]).where("doc <> owner").groupBy("doc", "th").agg(F.collect_set("pos").alias("dropped"))

    def apply(self, docs: DataFrame, drops: DataFrame | None = None) -> DataFrame:
        """``docs`` with n_lines, n_dropped and kept_text; ``drops`` as ``drops`` gives it, if that is known."""
        if clash := set(RESULTS) & set(docs.columns):
            raise ValueError(f"there are columns {sorted(clash)} already")
        drops = self.drops(docs) if drops is None else drops
        lines = lines_of(F.col("text"))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
        joined = docs.withColumns({"__doc": order_id(), "__th": text_hash()}).join(drops.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("dropped").alias("__dropped")), ["__doc", "__th"], "left")
        return joined.withColumns(
            {
                "n_lines": F.size(lines).cast("long"),
                "n_dropped": F.coalesce(F.array_size("__dropped"), F.lit(0)).cast("long"),
                "kept_text": F.when(F.col("__dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda p: F.get(lines, p)), "\n")),
            }
        ).drop("__doc", "__th", "__dropped")


def line_dedup(docs: DataFrame) -> DataFrame:
    """Each document with n_lines, n_dropped and kept_text, by an index of all of them."""
    lines = saved(keyed(docs), "keys")
    index = LineIndex(docs.sparkSession).insert_keyed(lines)
    return index.apply(docs, index.drops_keyed(lines))
