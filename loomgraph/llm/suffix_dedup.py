"""Exact substring dedup: every byte within a WINDOW-byte string that also starts earlier is removed.

Earlier means a smaller document (doc_id, then a hash of its text) or an earlier start in the same one. Method: suffixes
are sorted by a difference-cover algorithm (``suffix_order``: sampled triples are sorted and named, names that tie are
sorted by recursion, the rest is merged in) and windows that equal their neighbour's first WINDOW bytes form groups, of
which all but the earliest member go. The sort is distributed by content, so that no task ever sees the whole text:

1. ``anchors``: every window is assigned to the smallest hashed K-gram in it (the leftmost of equal ones), which depends on
   the window's bytes alone; consecutive windows with the same one form a run. Equal windows thus have the same anchor.
   The runs of each batch, packed by columns, are shuffled by anchor, and anchors that occur once end here.
2. ``contents``: the documents' texts (compressed) meet their remaining runs, and the bytes of each run go to its anchor's
   task. Equal runs of a batch travel once; all but their earliest are duplicates as they stand.
3. ``_settle``: for each anchor, equal runs are folded in the same way, and where different runs are left (the edges of
   shared passages) their suffixes are sorted and adjacent prefixes compared. One run can't hold equal windows.
4. The duplicate windows of each document are joined and its bytes cut.

Skew: what occurs several times within a batch needs no company to be known as repeated, and goes to a task by document;
its anchor's task gets it once a batch. An anchor with more than HOT runs is taken apart into its windows, which travel as
128-bit hashes and meet under those, again folded by batch. Windows are told apart by their bytes, save those
of hot anchors, which are known by 128-bit hashes.

Cases: null text is empty; null doc_ids order first; equal rows are one document, each with the same result; rows with
one doc_id and other texts are documents of their own, ordered by that hash; texts shorter than WINDOW lose nothing; very long
ones are read whole, in one task, and their runs go to many; other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import gathered, groups, mix, order_id, partitions, saved, text_hash

WINDOW = 100
K = 32
HOT = 40_000
#: Bytes of rows among which repeats are settled before they are sent.
BATCH = 20 << 20
#: Rounds of names: after the last one names stand for 3**ROUNDS bytes, and need no further telling apart.
ROUNDS = 5
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFFFF)


# The suffix sort ------------------------------------------------------------------------------------------------------------


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and each one's rank among the distinct ones, from 1."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    s = keys[order]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(np.append(True, s[1:] != s[:-1]), dtype=np.int32)
    return order, rank


def suffix_order(t: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Places of ``t`` (positive integers, as many as fit in memory some 100 times over) in the order of their suffixes, by difference cover {1, 2} mod 3.

    With ``rounds`` of recursion, suffixes that agree for 3**rounds places may come in any order.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int32)
    s = np.zeros(n + 3, np.int32)
    s[:n] = t
    wide = lambda p: s[p].astype(np.int64)
    cover = np.concatenate([np.arange(1, n + (n % 3 == 1), 3, dtype=np.int32), np.arange(2, n, 3, dtype=np.int32)])
    bits = max(1, int(s.max()).bit_length())
    if 3 * bits <= 62:
        order, name = _names((wide(cover) << (2 * bits)) | (wide(cover + 1) << bits) | s[cover + 2])
    else:
        _, last = _names((wide(cover + 1) << 31) | s[cover + 2])
        order, name = _names((wide(cover) << 31) | last)
    if rounds > 1 and len(cover) and name[order[-1]] < len(cover):
        order = suffix_order(name, rounds - 1)
        name = np.empty(len(cover), np.int32)
        name[order] = np.arange(1, len(cover) + 1, dtype=np.int32)
    rank = np.zeros(n + 3, np.int32)
    rank[cover] = name
    sampled = cover[order]
    del cover, order, name
    sampled = sampled[sampled < n]
    # The rest: by the first symbol, then the sampled suffix behind it.
    zero = np.arange(0, n, 3, dtype=np.int32)
    key1 = lambda p: wide(p) * (n + 3) + rank[p + 1]
    zero = zero[np.argsort(key1(zero), kind="stable")]
    # Merge: against places 1 mod 3 by one symbol and a rank, against 2 mod 3 by two symbols and a rank.
    at1, at2 = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(np.maximum.accumulate(key1(at1)), key1(zero)).astype(np.int32) if len(at1) else np.zeros(len(zero), np.int32)
    if 2 * bits + int(n + 3).bit_length() <= 62:
        key2 = lambda p: ((wide(p) << bits) | s[p + 1]) * (n + 3) + rank[p + 2]
        k2, z2 = key2(at2), key2(zero)
    else:
        both = np.concatenate([at2, zero])
        _, first = _names((wide(both) << 31) | s[both + 1])
        k = first.astype(np.int64) * (n + 3) + rank[both + 2]
        k2, z2 = k[: len(at2)], k[len(at2) :]
    if len(at2):
        before += np.searchsorted(np.maximum.accumulate(k2), z2).astype(np.int32)
    before = np.maximum.accumulate(before)  # names that were left equal order what agrees that far in one way here, in another there
    slot = before + np.arange(len(zero), dtype=np.int32)
    out = np.empty(n, np.int32)
    out[slot] = zero
    free = np.ones(n, bool)
    free[slot] = False
    out[free] = sampled
    return out


def _same_as_previous(buf: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each place in ``order`` after the first: do its ``width`` bytes equal those of the place before it?"""
    word = np.ndarray((len(buf) - 7,), np.uint64, buf, 0, (1,))
    left = np.arange(1, len(order))
    for k in [*range(0, width - 8, 8), width - 8]:
        left = left[word[order[left] + k] == word[order[left - 1] + k]]
    same = np.zeros(max(0, len(order) - 1), bool)
    same[left - 1] = True
    return same


# Anchors ----------------------------------------------------------------------------------------------------------------------


def anchors(buf: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of valid windows that share an anchor: first window, number of windows, hash of the anchor."""
    none = np.zeros(0, np.int64)
    if len(buf) < WINDOW:
        return none, none, none.astype(np.uint64)
    word = np.ndarray((len(buf) - 7,), np.uint64, buf, 0, (1,))
    n = len(buf) - K + 1
    with np.errstate(over="ignore"):
        h = word[:n] * _C[0]
        for i in range(1, K // 8):
            h ^= h >> np.uint64(29)
            h += word[8 * i : n + 8 * i] * _C[i]
        h ^= h >> np.uint64(32)
        h *= _C[3]
    low = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
    span, size = WINDOW - K + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    low = low[: len(valid)]
    new = np.append(True, (low[1:] != low[:-1]) | (valid[1:] != valid[:-1]))
    start = np.flatnonzero(new & valid)
    if not len(start):
        return none, none, none.astype(np.uint64)
    edges = np.append(np.flatnonzero(new), len(valid))
    count = edges[np.searchsorted(edges, start, "right")] - start
    return start, count, mix(h[(low[start] & _LOW).astype(np.int64)])


PACKED = "part int, rows binary"


def _pack(part: int, *arrays: np.ndarray) -> tuple[int, bytes]:
    return part, zstandard.ZstdCompressor(level=1).compress(b"".join(np.array([len(a)], "<u4").tobytes() + a.tobytes() for a in arrays))


_COLUMNS = ("<i8", "<u8", "<u8", "<u4", "<u4", "u1", "<u4")


def _unpack(rows: bytes) -> list[np.ndarray]:
    b, at, out = zstandard.ZstdDecompressor().decompress(rows), 0, []
    for t in _COLUMNS:
        n = int(np.frombuffer(b, "<u4", 1, at)[0])
        out.append(np.frombuffer(b, t, n, at + 4))
        at += 4 + n * np.dtype(t).itemsize
    return out


def _runs(docs: DataFrame, parts: int) -> DataFrame:
    """PACKED: a batch's runs by part: documents' keys, then anchor, document's place, start, windows, occurrences (0: known to repeat, goes by document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BATCH):
            keys, ids, texts = batch.column("rk").to_numpy().view(np.uint64), batch.column("doc").to_numpy(), batch.column("text").to_pylist()
            got = []
            for a, b in groups(texts, 1 << 19):
                buf = np.frombuffer(b"".join(texts[a:b]) + bytes(8), np.uint8)[:-8]
                lens = np.array([len(t) for t in texts[a:b]])
                ends = np.cumsum(lens)
                if len(buf) < WINDOW:
                    continue
                doc = np.repeat(np.arange(b - a), lens)[: len(buf) - WINDOW + 1]
                start, count, anchor = anchors(buf, np.arange(len(buf) - WINDOW + 1) + WINDOW <= ends[doc])
                of = doc[start]
                got.append((anchor, (of + a).astype(np.uint32), (start - (ends - lens)[of]).astype(np.uint32), count.astype(np.uint8)))
            if not got:
                continue
            anchor, doc, start, count = (np.concatenate(x) for x in zip(*got, strict=True))
            _, first, back, times = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            many = np.ones(len(anchor), np.uint32)
            known = times[back] > 1
            many[known] = 0
            many[first] = times
            part = np.where(many > 0, anchor % np.uint64(parts), keys[doc] % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((start, doc, part))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                own = order[cuts[p] : cuts[p + 1]]
                if len(own):
                    which, place = np.unique(doc[own], return_inverse=True)
                    rows.append(_pack(p, np.diff(ids[which], prepend=0), keys[which], anchor[own], place.astype("<u4"), start[own], count[own], many[own]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "rows"])

    return docs.mapInArrow(run, PACKED)


REPEATED = "doc long, rk long, anchor long, start long, n int"


def _repeated(packed: DataFrame, parts: int, hot: int) -> DataFrame:
    """REPEATED: the runs whose anchor occurs more than once, and a row without n for each anchor that occurs more than ``hot`` times.

    What a task holds is its part of the runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpack(r) for b in batches for r in b.column("rows").to_pylist()]
        if not got:
            return
        id_, key = np.concatenate([np.cumsum(g[0])[g[3]] for g in got]), np.concatenate([g[1][g[3]] for g in got])
        anchor, start, count, many = (np.concatenate([g[i] for g in got]) for i in (2, 4, 5, 6))
        by = many > 0
        found, back = np.unique(anchor[by], return_inverse=True)
        total = np.bincount(back, many[by], len(found))[back]
        keep = ~by
        keep[by] = total > 1
        if len(over := np.unique(anchor[by][total > hot])):
            none = pa.nulls(len(over), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(over.view(np.int64)), none, pa.nulls(len(over), pa.int32())], names=["doc", "rk", "anchor", "start", "n"])
        own = np.flatnonzero(keep)
        for k in range(0, len(own), 100_000):
            o = own[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(id_[o]), pa.array(key[o].view(np.int64)), pa.array(anchor[o].view(np.int64)), pa.array(start[o].astype(np.int64)), pa.array(count[o].astype(np.int32))], names=["doc", "rk", "anchor", "start", "n"])

    return packed.repartitionById(parts, F.col("part")).mapInArrow(run, REPEATED)


CONTENTS = "part int, anchor long, content binary, doc long, rk long, start long, n int"
_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]


def _contents(joined: DataFrame, parts: int) -> DataFrame:
    """CONTENTS of (doc, rk, z, runs): runs with their bytes, windows of hot anchors with their hash (16 bytes, shorter than any
    run), and what is known to be a duplicate with neither (anchor null), there joined to stretches of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in gathered(batches, BATCH):
            best: dict[tuple, tuple] = {}
            known: dict[tuple[int, int], list[tuple[int, int]]] = {}

            def meet(at: tuple, row: tuple) -> None:
                old = best.get(at)
                if old is None:
                    best[at] = row
                elif old[:3] != row[:3]:
                    least, other = (row, old) if row[:3] < old[:3] else (old, row)
                    best[at] = least
                    known.setdefault(other[:2], []).append(other[2:4])

            for doc, rk, z, runs in zip(*(batch.column(c).to_pylist() for c in ("doc", "rk", "z", "runs")), strict=True):
                t = unzip.decompress(z)
                for r in runs:
                    anchor, start, n = r["anchor"], r["start"], r["n"]
                    if r["hot"]:
                        for i in range(start, start + n):
                            w = xxhash.xxh3_128_digest(t[i : i + WINDOW])
                            meet((int.from_bytes(w[:8], "little", signed=True), w), (doc, rk, i, 1))
                    else:
                        meet((anchor, t[start : start + n + WINDOW - 1]), (doc, rk, start, n))
            rows = [(a % parts, a, c, *row) for (a, c), row in best.items()]
            for (doc, rk), runs in known.items():
                runs.sort()
                at, upto = runs[0][0], runs[0][0]
                for start, n in [*runs, (1 << 60, 0)]:
                    if start > upto:
                        rows.append((rk % parts, None, None, doc, rk, at, upto - at))
                        at = start
                    upto = max(upto, start + n)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), _TYPES, strict=True)], names=[f.split()[0] for f in CONTENTS.split(", ")])

    return joined.mapInArrow(run, CONTENTS)


FLAGGED = "doc long, rk long, start long, n int"


def _sort_group(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    """Duplicates among the windows of different runs, by suffix sort; rows are (doc, rk, start, n, bytes)."""
    rows = sorted(rows, key=lambda r: r[:3])  # the order of runs isn't that of windows: these are compared below
    text = b"".join(r[4] for r in rows)
    buf = np.frombuffer(text + bytes(8), np.uint8)
    lens = np.array([len(r[4]) for r in rows])
    n = np.array([r[3] for r in rows])
    first = np.cumsum(lens) - lens
    # Windows lie within their runs, so bytes of the next run behind them do no harm.
    order = suffix_order(buf[: len(text)].astype(np.int32) + 1)
    of = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
    off = np.arange(len(text), dtype=np.int32) - first[of].astype(np.int32)
    order = order[off[order] < n[of[order]]]
    same = _same_as_previous(buf, order, WINDOW)
    group = np.cumsum(np.append(True, ~same))
    size = np.bincount(group)
    member = size[group] > 1
    order, group = order[member], group[member]
    if not len(order):
        return []
    run = of[order]
    doc = np.array([r[0] for r in rows])[run]
    rk = np.array([r[1] for r in rows])[run]
    at = np.array([r[2] for r in rows])[run] + off[order]
    by = np.lexsort((at, rk, doc, group))
    g = group[by]
    later = by[np.append(False, g[1:] == g[:-1])]
    return list(zip(doc[later].tolist(), rk[later].tolist(), at[later].tolist(), [1] * len(later), strict=True))


def _settle(contents: DataFrame, parts: int, most: int = 1 << 20) -> DataFrame:
    """FLAGGED: duplicate windows, as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pending: list[tuple] = []
        size = 0
        anchor, content, own = None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), [pa.int64(), pa.int64(), pa.int64(), pa.int32()], strict=True)], names=["doc", "rk", "start", "n"])

        for batch in batches:
            for a, b, doc, rk, start, n in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "doc", "rk", "start", "n")), strict=True):
                if a is None:
                    out.append((doc, rk, start, n))
                    continue
                if a != anchor:
                    if len(own) > 1:
                        more = sum(len(r[4]) for r in own)
                        if size and size + more > most:
                            out.extend(_sort_group(pending))
                            pending, size = [], 0
                        pending.extend(own)
                        size += more
                    anchor, content, own = a, None, []
                if b != content:  # the first of equal ones is the earliest
                    content, first = b, (doc, rk, start)
                    if len(b) >= WINDOW:
                        own.append((doc, rk, start, n, b))
                elif (doc, rk, start) != first:
                    out.append((doc, rk, start, n))
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        if len(own) > 1:
            if size and size + sum(len(r[4]) for r in own) > most:
                out.extend(_sort_group(pending))
                pending = []
            pending.extend(own)
        if pending:
            out.extend(_sort_group(pending))
        if out:
            yield batch_of(out)

    return contents.repartitionById(parts, F.col("part")).sortWithinPartitions("anchor", "content", "doc", "rk", "start").mapInArrow(run, FLAGGED)


def duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """FLAGGED for all rows of ``docs``, by ``order_id`` and ``text_hash``. Runs may repeat and overlap."""
    parts = partitions(docs.sparkSession)
    keyed = docs.select(order_id().alias("doc"), text_hash().alias("rk"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    long = keyed.where(F.octet_length("text") >= WINDOW)
    found = saved(_repeated(_runs(long.select("doc", "rk", "text"), parts), parts, hot), "repeated")
    # Hot anchors are a table of their own: the planner knows its size, and spares the runs a shuffle while it is small.
    over = saved(found.where("n is null").select("anchor", F.lit(True).alias("hot")).coalesce(1), "hot")
    repeated = found.where("n is not null").join(over, "anchor", "left").fillna(False, ["hot"])
    # A document has as many runs as it has windows at most.
    by_doc = repeated.groupBy("doc", "rk").agg(F.collect_set(F.struct("anchor", "start", "n", "hot")).alias("runs"))

    def zip_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("rk"), pa.array([z.compress(t) for t in b.column("text").to_pylist()], pa.binary())], names=["doc", "rk", "z"])

    joined = long.mapInArrow(zip_, "doc long, rk long, z binary").join(by_doc, ["doc", "rk"]).select("doc", "rk", "z", "runs")
    return _settle(_contents(joined, parts), parts)


RESULT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}


def suffix_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of each row of ``docs``."""
    runs = duplicates(docs, hot).groupBy("doc", "rk").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("runs"))

    def zip_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("doc"), b.column("rk"), pa.array([z.compress(t) for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "doc", "rk", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for z, own in zip(batch.column("z").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                t = unzip.decompress(z)
                parts_, at, gone, n = [], 0, 0, 0
                end = -1
                for r in own or []:
                    s, e = r["start"], r["start"] + r["n"] + WINDOW - 1
                    if s > end:
                        parts_.append(t[at:s])
                        n += 1
                        gone += e - s
                    elif e > end:
                        gone += e - end
                    end = max(end, e)
                    at = end
                parts_.append(t[at:])
                size.append(len(t))
                removed.append(gone)
                spans.append(n)
                kept.append(b"".join(parts_))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", *RESULT])

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order_id().alias("doc"), text_hash().alias("rk"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(zip_, "doc_id long, doc long, rk long, z binary")
    return packed.join(runs, ["doc", "rk"], "left").select("doc_id", "z", "runs").mapInArrow(cut, "doc_id long, " + ", ".join(f"{k} {v}" for k, v in RESULT.items()))
