"""Near-duplicate classes by a containment ensemble of MinHash bandings, and a search for the documents that contain others.

A document is the set of its 5-word shingles (white-space separated, A-Z lower-cased; one shingle of all words if there are
fewer). ``classes``: two documents are near duplicates if the larger set is contained in the smaller by THRESHOLD or more,
|A & B| >= THRESHOLD * max(|A|, |B|). So everything with a Jaccard similarity of THRESHOLD is found, and a short text that
merely occurs in a long one doesn't join their classes. Classes are the connected components of that relation.
``containers``: for a set of queries, every document that contains THRESHOLD or more of a query's shingles, however long it is;
``with_containers`` asks it for the classes of a part of the documents, against all classes.

1. ``sketch``: one pass makes each set (32-bit hashes of shingles), a 128-bit hash of it, and its band keys. Sets are
   partitioned by size at powers of 1 / THRESHOLD, so that near duplicates lie in one partition or in neighbours; for each
   partition the containment threshold becomes the least Jaccard similarity such pairs can have, and rows and bands are
   chosen for it (``banding``). A set is filed in its own partition's bands and in the next one's.
2. Equal sets are one vertex from here on.
3. In every bucket that holds several sets the one with the smallest hash is the pivot. Each set is first checked,
   exactly, against the pivot that it meets most often; then classes are joined; then the other pivots of another class are
   checked. So a group of copies costs a few checks a member, however large it is. A pivot that many sets meet is sent to
   several tasks, its members being dealt to them.
4. The sets of buckets that hold several classes yet are compared by their rarest shingles: near duplicates share one of
   the n - ceil(THRESHOLD * n) + 1 rarest ones of either (rare among these sets), whatever common passages they hold besides.
   This finds all pairs across classes, with no pairs formed within a bucket, and none where a shingle's sets are one class.
5. Components are found by label propagation with shortcuts, on tables of links.

``containers`` goes by rarest shingles as well (step 4, with the queries' own shingles counted over all documents): across
partitions far apart the Jaccard threshold is so low that any banding would put all pairs that share a passage in one bucket.

MinHash finds a pair at the threshold's least Jaccard similarity with a probability of RECALL or more, and one of Jaccard 0.8
practically always. All decisions are exact containments, up to collisions of 32-bit shingle hashes within a pair.

Cases: null and white-space-only texts have no shingle and are each a class of their own, contained in nothing; null doc_ids
are ids; rows with the same doc_id are told apart by a hash of their text, equal rows are one document; very long texts are
read whole, each in one task; ties go to the smaller hash; other columns are ignored by ``classes`` and stay in ``dedup``
(``__doc``, ``__th``, ``__some`` and ``__k`` are its own); an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import groups, local_path, mix, ngram_hashes, order_id, saved, scratch, text_hash, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
RECALL = 0.99
#: Sets that may share one copy of a pivot's set.
MEMBERS = 2000
ROUNDS = 60
_A = (mix(np.arange(11, 11 + HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(5011, 5011 + HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def partition_of(n: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Partition of a set's size: sizes n and m with m >= threshold * n lie in one, or in neighbours."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(threshold) + 1e-9).astype(np.int64)


def least_jaccard(partition: int, threshold: float = THRESHOLD) -> float:
    """The smallest Jaccard similarity of near duplicates filed in this partition, from it and the one before."""
    low = max(1, math.ceil(threshold ** -(partition - 1) - 1e-6))
    high = math.floor(threshold ** -(partition + 1) + 1e-6)
    if high > 400:
        return threshold / (2 - threshold)
    best = 1.0
    for a in range(low, high + 1):
        for b in range(a, high + 1):
            both = math.ceil(threshold * b - 1e-9)
            if both <= a:
                best = min(best, both / (a + b - both))
    return best


@lru_cache
def banding(partition: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Rows a band, and bands, of a partition: as many rows as still find its least similarity with ``recall``."""
    s = least_jaccard(partition, threshold)
    if s >= 1:
        return 1, 0  # only equal sets are near duplicates there, and those are one vertex anyway
    for r in range(12, 1, -1):
        b = HASHES // r
        if 1 - (1 - s**r) ** b >= recall:
            while b > 1 and 1 - (1 - s**r) ** (b - 1) >= recall:
                b -= 1
            return r, b
    return 1, HASHES


def signature(x: np.ndarray) -> np.ndarray:
    """HASHES minima of a set of 32-bit hashes."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(out, ((x[k : k + 2048, None] ^ _B) * _A).min(0), out=out)
    return out


def keys(sig: np.ndarray, n: int) -> np.ndarray:
    """Bucket keys of a set of ``n`` shingles: of its partition's bands and of the next one's."""
    p = int(partition_of(np.array([n]))[0])
    found = []
    for q in (p, p + 1):
        r, b = banding(q)
        if b:
            with np.errstate(over="ignore"):
                x = np.full(b, q, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(b, dtype=np.uint64)
                for col in sig[: r * b].reshape(b, r).T:
                    x = mix(x ^ col)
            found.append(x)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


SKETCH = "doc long, th long, sid binary, n int, keys array<long>, shingles binary"


def sketch(docs: DataFrame) -> DataFrame:
    """SKETCH of every row of ``docs``; sid is null where there is no shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sid, size, buckets, sets = [], [], [], []
            for a, b in groups(texts, 1 << 20):
                h, n = word_hashes(texts[a:b])
                for words in np.split(h, np.cumsum(n)[:-1]):
                    if not len(words):
                        sid.append(None), size.append(0), buckets.append([]), sets.append(b"")
                        continue
                    full = np.unique(ngram_hashes(words, SHINGLE))
                    x = np.unique((full >> np.uint64(32)).astype(np.uint32))
                    with np.errstate(over="ignore"):
                        one, two = np.add.reduce(mix(full)), np.add.reduce(mix(full ^ np.uint64(0xD6E8FEB86659FD93)))
                    sid.append(one.tobytes() + two.tobytes())
                    size.append(len(x))
                    buckets.append(keys(signature(x), len(x)).view(np.int64))
                    sets.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.array(sid, pa.binary()), pa.array(size, pa.int32()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=[f.split()[0] for f in SKETCH.split(", ")])

    return docs.select(order_id().alias("doc"), text_hash().alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, SKETCH)


BITS = 26


def _two_bits(h: Column) -> Column:
    return F.array(F.pmod(h, F.lit(1 << BITS)), F.pmod(F.shiftright(h, BITS), F.lit(1 << BITS)))


def _head(sid: Column) -> Column:
    """The first 64 bits of a set's hash."""
    return F.conv(F.hex(F.substring(sid, 1, 8)), 16, -10).cast("long")


@lru_cache(maxsize=2)
def _bits_of(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        return np.frombuffer(f.read(), np.uint8)


def _in_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Both bits of each hash are looked at, the second only where the first is set."""
    out = np.zeros(len(at), bool)
    left = np.arange(len(at))
    for h in (at, at >> BITS):
        k = h[left] & ((1 << BITS) - 1)
        left = left[(bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1]
    out[left] = True
    return out


def _bit_file(hashes: DataFrame) -> str | None:
    """Path of a file of 2**BITS bits in the shared folder, two for each value of ``hashes`` (h), by which others are told; None if there is no value.

    Its size is fixed; with more values than it can tell apart, more rows travel to the exact join that follows.
    """
    folder = local_path(scratch(hashes.sparkSession, "bits"))
    words = hashes.select(F.explode(_two_bits(F.col("h"))).alias("b")).groupBy(F.floor(F.col("b") / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("x"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, any_ = np.zeros((1 << BITS) // 64, np.uint64), False
        for b in batches:
            out[b.column("w").to_numpy()] |= b.column("x").to_numpy().view(np.uint64)
            any_ |= b.num_rows > 0
        if not any_:
            return
        os.makedirs(folder, exist_ok=True)
        with open(own := f"{folder}/{uuid.uuid4().hex}", "wb") as f:
            f.write(out.tobytes())
        os.replace(own, f"{folder}/bits")
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["done"])

    return f"{folder}/bits" if words.repartition(1).mapInArrow(write, "done long").collect() else None  # one row


def _only(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``sets`` (sid, n, shingles) whose sid is in ``wanted``; most others are left out before they are shuffled."""
    path = _bit_file(wanted.select(_head(F.col("sid")).alias("h")))
    if path is None:
        return sets.limit(0)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits_of(path)
        for b in batches:
            yield b.filter(pa.array(_in_bits(bits, b.column("h").to_numpy())))

    return sets.withColumn("h", _head(F.col("sid"))).mapInArrow(pick, "sid binary, n int, shingles binary, h long").drop("h").join(wanted, "sid", "left_semi")


def _links(pairs: DataFrame, sets: DataFrame, threshold: float, members: int | None = None) -> DataFrame:
    """Those of ``pairs`` (a, b) that are near duplicates, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = np.concatenate([x, y])
                both.sort()
                keep.append(int((both[1:] == both[:-1]).sum()) >= threshold * max(len(x), len(y)) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    # A set that many others meet goes to one task for every MEMBERS of them.
    fan = saved(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / (members or MEMBERS)).cast("int").alias("fan")).where("fan > 1"), "fans")
    dealt = pairs.select("a", "b").join(fan, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("fan", F.lit(1))).cast("int").alias("salt"))
    copies = two.join(fan, "b", "left").select("b", "nb", "sb", F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1)).alias("salt"))
    return dealt.join(one, "a").join(copies, ["b", "salt"]).where(near).select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _rare(sets: DataFrame, threshold: float) -> DataFrame:
    """sid, g: the rarest shingles of each of ``sets`` (sid, n, shingles), as many as any near duplicate must share one of."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.int32) for x in batch.column("shingles").to_pylist()]
            if not own:
                continue
            every, at = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
            for k in range(0, len(at), 1 << 16):
                part = pa.array(at[k : k + (1 << 16)])
                yield pa.RecordBatch.from_arrays([batch.column("sid").take(part), batch.column("n").take(part), pa.array(every[k : k + (1 << 16)])], names=["sid", "n", "g"])

    each = saved(sets.select("sid", "n", "shingles").mapInArrow(spread, "sid binary, n int, g int"), "spread")
    count = each.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    return _first_rare(each.join(count, "g").select("sid", "n", "df", "g"), threshold)


def _first_rare(each: DataFrame, threshold: float) -> DataFrame:
    """sid, df, g of (sid, n, df, g): of each set the first n - ceil(threshold * n) + 1 by (df, g). A set is what one task holds."""
    many = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    per = each.groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("own"))
    return per.select("sid", F.inline(F.slice("own", F.lit(1), many)))


def components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """v, label: every vertex of ``links`` (a, b), labelled by the smallest vertex of its component."""
    edges = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = saved(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = edges.join(label, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("m"))
        # A shortcut: the label of one's label.
        up = label.select(F.col("v").alias("u"), F.col("label").alias("up"))
        new = saved(
            label.join(near, F.col("v") == F.col("a"))
            .withColumn("l", F.least("label", "m"))
            .join(up, F.col("l") == F.col("u"))
            .select("v", F.least("l", "up").alias("label"), (F.least("l", "up") != F.col("label")).alias("moved")),
            "labels",
        )
        label = new.select("v", "label")
        if not new.where("moved").limit(1).count():
            return label
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose ends have different labels; a vertex without one is its own."""
    one = label.select(F.col("v").alias("a"), F.col("label").alias("la"))
    two = label.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc, th, n_shingles, class_doc, class_th: each document with the first one of its class."""
    all_ = saved(sketch(docs), "sketch")
    uniq = saved(all_.where("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), "sets")
    filed = uniq.select("sid", F.explode("keys").alias("bucket"))
    buckets = saved(filed.groupBy("bucket").agg(F.min("sid").alias("pivot"), F.max("sid").alias("last")).where("pivot <> last").select("bucket", "pivot"), "buckets")
    held = saved(filed.join(buckets, "bucket"), "held")
    met = saved(held.where("sid <> pivot").groupBy(F.col("sid").alias("a"), F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("times")), "met")
    wanted = met.select(F.col("a").alias("sid")).unionByName(met.select(F.col("b").alias("sid"))).distinct()
    sets = saved(_only(all_.where("sid is not null").select("sid", "n", "shingles"), wanted).groupBy("sid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "shingles")
    most = saved(met.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b")), "pairs")
    links = saved(_links(most, sets, threshold), "links")
    label = components(links)
    second = saved(_across(met.select("a", "b").join(most, ["a", "b"], "left_anti"), label), "pairs")
    tried = most.unionByName(second)
    more = saved(_links(second, sets, threshold), "links")
    if _some(more):
        links = links.unionByName(more)
        label = components(links)
    # Buckets that hold several classes yet: pairs across them, by their rarest shingles.
    own = held.join(label.select(F.col("v").alias("sid"), "label"), "sid", "left").select("bucket", "sid", F.coalesce("label", "sid").alias("label"))
    mixed = own.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("k")).where("x <> y and k > 2").select("bucket")
    left = saved(own.join(mixed, "bucket", "left_semi").select("sid", "label").distinct(), "mixed")
    if _some(left):
        rare = saved(_rare(sets.join(left, "sid", "left_semi"), threshold).join(left, "sid").select("g", "sid", "label"), "rare")
        several = rare.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("g")
        rare = saved(rare.join(several, "g", "left_semi"), "rare")
        cross = rare.join(rare.select("g", F.col("sid").alias("b"), F.col("label").alias("lb")), "g").where("label <> lb and sid > b").select(F.col("sid").alias("a"), "b").distinct()
        done = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        more = saved(_links(saved(cross.join(done, ["a", "b"], "left_anti"), "pairs"), sets, threshold), "links")
        if _some(more):
            label = components(links.unionByName(more))
    member = all_.select("doc", "th", "sid", "n").distinct().join(label.select(F.col("v").alias("sid"), "label"), "sid", "left")
    member = member.select("doc", "th", "n", F.coalesce("label", "sid").alias("class"))
    first = member.where("class is not null").groupBy("class").agg(F.min(F.struct("doc", "th")).alias("first"))
    out = member.where("class is not null").join(first, "class").select("doc", "th", F.col("n").alias("n_shingles"), F.col("first.doc").alias("class_doc"), F.col("first.th").alias("class_th"))
    return out.unionByName(member.where("class is null").select("doc", "th", F.col("n").alias("n_shingles"), F.col("doc").alias("class_doc"), F.col("th").alias("class_th")))


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: that of the smallest document; of equal rows of it, one."""
    found = classes(docs, threshold)
    keep = found.where("doc = class_doc and th = class_th").select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), (F.col("n_shingles") > 0).alias("__some"))
    kept = docs.withColumns({"__doc": order_id(), "__th": text_hash()}).join(keep, ["__doc", "__th"])
    equal = F.row_number().over(Window.partitionBy("__doc", "__th").orderBy("__doc"))
    many = docs.groupBy(order_id().alias("__doc"), text_hash().alias("__th")).count().where("count > 1").select("__doc", "__th")
    if _some(many):
        kept = kept.withColumn("__k", equal).where("__k = 1 or not __some")
    return kept.select(*docs.columns)


# Containment in documents of any size ----------------------------------------------------------------------------------------


def _grams(docs: DataFrame, path: str | None, counts: bool = False, rows: str | None = None) -> DataFrame:
    """Of the distinct shingles of each text those that the bit file admits (all without one): h and n (how often in a batch),
    or doc, th, size of the set, h. ``rows`` is a bit file of the text hashes to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, some = path and _bits_of(path), rows and _bits_of(rows)
        for batch in batches:
            if some is not None:
                batch = batch.filter(pa.array(_in_bits(some, batch.column("th").to_numpy())))
            texts, held = batch.column("text").to_pylist(), []
            for a, b in groups(texts):
                h, n = word_hashes(texts[a:b])
                own = [np.unique(ngram_hashes(w, SHINGLE)) for w in np.split(h, np.cumsum(n)[:-1])]
                size = np.array([len(x) for x in own])
                every, at = np.concatenate(own).view(np.int64), np.repeat(np.arange(a, b), size)
                if bits is not None:
                    keep = _in_bits(bits, every)
                    every, at = every[keep], at[keep]
                if counts:
                    held.append(every)
                else:
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([batch.column("doc").take(take), batch.column("th").take(take), pa.array(size[at - a].astype(np.int32)), pa.array(every)], names=["doc", "th", "size", "h"])
            if held:
                every, many = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(many)], names=["h", "n"])

    keyed = docs.select(order_id().alias("doc"), text_hash().alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return keyed.mapInArrow(run, "h long, n long" if counts else "doc long, th long, size int, h long")


CONTAINED = "q long, qth long, n int, doc long, th long, size int, shared long"


def containers(docs: DataFrame, queries: DataFrame, among: DataFrame | None = None, threshold: float = THRESHOLD, members: int = MEMBERS) -> DataFrame:
    """CONTAINED: for each document of ``queries`` (doc, th) every other one (of ``among``, if given) with as many shingles or
    more that holds at least ``threshold`` of its own. Exact, up to collisions of 64-bit hashes.

    Only hashes that a bit file of the queries' admits leave the pass over the documents. A query of which all shingles are
    common is met by as many documents as hold its least common ones; the rows of such a shingle are dealt to several tasks.
    """
    none = docs.sparkSession.createDataFrame([], CONTAINED)
    asking = _bit_file(queries.select(F.col("th").alias("h")))
    if asking is None:
        return none
    asked = saved(_grams(docs, None, rows=asking).join(queries.distinct(), ["doc", "th"], "left_semi").distinct().select(F.col("doc").alias("q"), F.col("th").alias("qth"), F.col("size").alias("n"), "h"), "asked")
    path = _bit_file(asked.select("h").distinct())
    if path is None:
        return none
    df = _grams(docs, path, counts=True).groupBy("h").agg(F.sum("n").alias("df")).where("df > 1").join(asked.select("h").distinct(), "h", "left_semi")
    # Shingles that one row alone holds are no link; but they count among the rarest.
    each = asked.join(df, "h", "left").select(F.struct("q", "qth").alias("sid"), "n", F.coalesce("df", F.lit(1)).alias("df"), F.col("h").alias("g"))
    probes = saved(_first_rare(each, threshold).where("df > 1").select("sid.q", "sid.qth", F.col("g").alias("h"), F.ceil(F.col("df") / members).cast("int").alias("fan")), "probes")
    path = _bit_file(probes.select("h").distinct())
    if path is None:
        return none
    hot = saved(probes.where("fan > 1").select("h", "fan").distinct(), "hot")
    held = _grams(docs, path).join(hot, "h", "left").select("doc", "th", "size", "h", F.pmod(F.xxhash64("doc", "th"), F.coalesce("fan", F.lit(1))).cast("int").alias("salt"))
    if among is not None:
        held = held.join(among.select("doc", "th").distinct(), ["doc", "th"], "left_semi")
    sent = probes.join(asked.select("q", "qth", "n").distinct(), ["q", "qth"]).select("q", "qth", "n", "h", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"))
    pairs = saved(held.join(sent, ["h", "salt"]).where("size >= n and (doc <> q or th <> qth)").select("q", "qth", "n", "doc", "th", "size").distinct(), "pairs")
    # What the pairs' documents hold of all that those queries ask, counted exactly.
    ours = asked.join(pairs.select("q", "qth").distinct(), ["q", "qth"], "left_semi")
    path, rows = _bit_file(ours.select("h").distinct()), _bit_file(pairs.select(F.col("th").alias("h")).distinct())
    if path is None:
        return none
    theirs = _grams(docs, path, rows=rows).join(pairs.select("doc", "th").distinct(), ["doc", "th"], "left_semi").groupBy("doc", "th").agg(F.collect_set("h").alias("own"))
    both = pairs.join(ours.groupBy("q", "qth").agg(F.collect_list("h").alias("want")), ["q", "qth"]).join(theirs, ["doc", "th"])
    found = both.select("q", "qth", "n", "doc", "th", "size", F.size(F.array_intersect("want", "own")).cast("long").alias("shared"))
    return found.where(F.col("shared") >= F.col("n") * threshold - 1e-9)


EVERY = 20


def with_containers(docs: DataFrame, found: DataFrame, every: int = EVERY) -> DataFrame:
    """``found`` (of ``classes``) with n_containers and container_doc: how many other classes' first documents contain that of
    its class, and the shortest of these (then the first). For the classes of documents whose id ``every`` divides; null for others.
    """
    first = saved(found.where("doc = class_doc and th = class_th").select("doc", "th").distinct(), "first")
    queries = saved(found.where(F.col("doc") % every == 0).select(F.col("class_doc").alias("doc"), F.col("class_th").alias("th")).distinct(), "queries")
    pairs = containers(docs, queries, first)
    per = pairs.groupBy(F.col("q").alias("doc"), F.col("qth").alias("th")).agg(F.count(F.lit(1)).alias("n_containers"), F.min_by("doc", F.struct("size", "doc", "th")).alias("container_doc"))
    answer = queries.join(per, ["doc", "th"], "left").select(F.col("doc").alias("class_doc"), F.col("th").alias("class_th"), F.coalesce("n_containers", F.lit(0)).alias("n_containers"), "container_doc")
    return found.join(answer, ["class_doc", "class_th"], "left").select(*found.columns, "n_containers", "container_doc")
