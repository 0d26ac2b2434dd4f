"""What several operators share: scratch tables in the shared folder, numpy text helpers, document keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Null doc_ids order before every other one.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a temporary one, with a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, as a URI."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The mounted path of a file: URI; anything else is refused, for the binary formats write through the file system."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"binary shards need a mounted shared folder, not {uri}")
    return uri


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and reread: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def small(spark: SparkSession, fields: list[tuple[str, pa.DataType]], rows: list[tuple]) -> DataFrame:
    """Rows of the driver as a table whose size the planner knows, so that it broadcasts it only below its threshold."""
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields]))


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that ``saved`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_hash(col: str | Column = "text") -> Column:
    """Part of a document's key beside doc_id, so that repeated ids with other texts stay apart."""
    return F.xxhash64(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))


def order_id(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def shown_id(col: str) -> Column:
    """The doc_id of what ``order_id`` gave."""
    return F.nullif(F.col(col), F.lit(NULL_ID))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
#: With punctuation and control characters of ASCII as well: words are runs of letters, digits and all beyond ASCII.
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[:128] = [not chr(i).isalnum() for i in range(128)]


def word_hashes(texts: list[bytes], punctuation: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words (A-Z lower-cased) of all texts, and each text's number of words.

    Words are parted by white space, with ``punctuation`` by that of ASCII as well. For each length in ``prefixes`` two more
    arrays follow: places of the words with more bytes than that, and hashes of their first bytes.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    space = (_IS_BREAK if punctuation else _IS_SPACE)[buf]
    prev = np.empty_like(space)
    prev[0], prev[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & prev)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), *[np.zeros(0, t) for _ in prefixes for t in (np.int64, np.uint64)]
    ends = np.flatnonzero(space & ~prev)
    keep = np.flatnonzero(~space)
    pos = (keep - np.repeat(starts, ends - starts)).astype(np.uint64)
    with np.errstate(over="ignore"):
        v = mix(_BYTE[_LOWER[buf[keep]]] + pos * np.uint64(0x9E3779B97F4A7C15))
        first = np.zeros(len(starts), np.int64)
        np.cumsum((ends - starts)[:-1], out=first[1:])
        h = mix(np.add.reduceat(v, first))
        more: list[np.ndarray] = []
        if prefixes:
            upto = np.append(np.uint64(0), np.cumsum(v, dtype=np.uint64))
            for n in prefixes:
                long = np.flatnonzero(ends - starts > n)
                more += [long, mix(upto[first[long] + n] - upto[first[long]] + np.uint64(n) * np.uint64(0xA0761D6478BD642F))]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens + 1, out=bounds[1:])
    return h, np.diff(np.searchsorted(starts, bounds)), *more


def groups(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes, for what is the better settled the more rows meet."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Lookup:
    """Places of 64-bit hashes in a sorted array of distinct ones, -1 for others; a bit table answers for most of those."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, np.uint64)
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of those found, and their places in the array."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], k[hit]


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; of fewer words, one of them all."""
    if not len(h):
        return h
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        x = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            x = x * np.uint64(0x100000001B3) + h[i : len(h) - n + 1 + i]
            x ^= x >> np.uint64(29)
        return mix(x)
