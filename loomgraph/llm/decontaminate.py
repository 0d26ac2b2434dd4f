"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Every run of SEED words of
a test item is a seed (of a shorter item, all its words are). One pass over the documents finds the seeds of each whole
text. A seed that many items share is no evidence of any of them: what a seed's items must show besides is that enough of
their words occur in the document, and then that enough occur about the seed, for an alignment to reach the threshold. Both
bounds are exact (an alignment matches no more of the item's words than occur there), so no pair is lost by them, however
many documents or items hold a seed. What is left is aligned: match +2, other word -1, gap -1; score / (2 * words of the item)
of THRESHOLD or more makes the document contaminated. An alignment counts if it lies within reach of a seed, and for one
of that score, reach is as far as it can extend.

Test items are taken in blocks of at most BLOCK_WORDS words (or of one item that is longer), each a pass over the documents;
a block is what the driver and every task hold in memory, and no document's text leaves its task.

Cases: null and empty texts hold nothing; items that are null or without words are never found; null doc_ids and item_ids are
ids; rows that share a doc_id are told apart by a hash of their text; equal rows give one result; very long texts are read
whole, in one task each, and very long items aligned row by row; of alignments with equal scores that in the first passage is
reported, and within it the one that ends first in the item, then in the text, from the start that
matches most words, the nearest of these; other columns are ignored, whatever their
names (``clean`` keeps them; ``__doc`` and ``__th`` are its own); an empty table of either kind gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Lookup, groups, ngram_hashes, order_id, saved, text_hash, word_hashes

SEED = 3
THRESHOLD = 0.5
MATCH, MISS, GAP = 2, -1, -1
BLOCK_WORDS = 1_000_000
_UNIT = 1 << 24


class Items:
    """The words and seeds of a block of test items."""

    def __init__(self, texts: list[bytes], n: int = SEED):
        h, count = word_hashes(texts, punctuation=True)
        self.words = np.split(h, np.cumsum(count)[:-1])
        own = [np.unique(ngram_hashes(w, n)) for w in self.words]
        #: A seed of n words isn't one of fewer: texts of other lengths are hashed apart.
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})
        self.seeds, self.holders = [], []
        for size in self.sizes:
            of = [i for i, w in enumerate(self.words) if min(n, len(w)) == size]
            keys = np.concatenate([own[i] for i in of])
            item = np.repeat(of, [len(own[i]) for i in of])
            order = np.lexsort((item, keys))
            keys, item = keys[order], item[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.seeds.append(Lookup(keys[first]))
            self.holders.append((np.append(first, len(keys)), item))

        every = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        known, self.place = np.unique(every, return_inverse=True)
        self.vocabulary = Lookup(known) if len(known) else None
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.length) - self.length

    def hits(self, words: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places) for the seeds that occur among a text's words, of items of which enough words occur there."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size, seeds, (first, item) in zip(self.sizes, self.seeds, self.holders, strict=True):
            if len(words) < size:
                continue
            at, k = seeds(ngram_hashes(words, size))
            if len(k):
                key, back = np.unique(k, return_inverse=True)
                order = np.argsort(back, kind="stable")
                ends = np.cumsum(np.bincount(back))
                found += [(item[first[x] : first[x + 1]], at[order[ends[i - 1] if i else 0 : ends[i]]]) for i, x in enumerate(key.tolist())]
        if not found:
            return
        some = np.unique(np.concatenate([i for i, _ in found]))
        # The bound by the whole text, for all these items at once.
        there = np.zeros(len(self.vocabulary.keys), bool)
        there[self.vocabulary(words)[1]] = True
        n = self.length[some]
        ends = np.cumsum(n)
        of = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.first[some], n)
        enough = np.add.reduceat(there[self.place[of]].astype(np.int64), ends - n) >= threshold * n
        places: dict[int, list[np.ndarray]] = {int(i): [] for i in some[enough]}
        for items, at in found:
            for i in items.tolist():
                if i in places:
                    places[i].append(at)
        for i, own in places.items():
            yield i, np.concatenate(own)


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of ``item`` with each row of ``passages`` (padded by zeros): score, places after its last words in the item and in the passage."""
    n, m = passages.shape
    row = np.zeros((n, m + 1), np.int32)
    best, upto, end = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    ramp = -GAP * np.arange(m + 1, dtype=np.int32)
    for i, w in enumerate(item):
        new = np.zeros_like(row)
        np.maximum(row[:, :-1] + np.where(passages == w, MATCH, MISS), row[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp  # gaps in the item
        top = new.argmax(1)
        score = new[np.arange(n), top]
        up = score > best
        best[up], upto[up], end[up] = score[up], i + 1, top[up]
        row = new
    return best, upto, end


def traced(item: np.ndarray, passage: np.ndarray, upto: int, end: int) -> tuple[int, int]:
    """Of the best alignment that ends before these places: its first word in the passage, and how many words match.

    The same recurrence backwards from the end, without a fresh start, on scores that carry the number of matches along: as much
    memory as one row.
    """
    a, b = item[:upto][::-1], passage[:end][::-1][: 3 * upto + 1]
    ramp = -GAP * _UNIT * np.arange(len(b) + 1, dtype=np.int64)
    row, best, at = -ramp, 0, 0
    for w in a:
        new = np.empty_like(row)
        new[0] = row[0] + GAP * _UNIT
        np.maximum(row[:-1] + np.where(b == w, MATCH * _UNIT + 1, MISS * _UNIT), row[1:] + GAP * _UNIT, out=new[1:])
        row = np.maximum.accumulate(new + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), top
    return end - at, best % _UNIT


def _passages(places: np.ndarray, length: int, n_words: int, threshold: float) -> list[tuple[int, int]]:
    """Ranges of words about the seeds' places that hold every alignment worth reporting, overlapping ones joined.

    An alignment with m matches and e edits scores 2 m - e, so from the threshold on it has at most 2 (1 - threshold) * length edits.
    """
    reach = length + math.ceil(2 * (1 - threshold) * length)
    out: list[tuple[int, int]] = []
    for p in np.sort(places).tolist():
        a, b = max(0, p - reach), min(n_words, p + SEED + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _may_reach(item: np.ndarray, passage: np.ndarray, threshold: float) -> bool:
    """An alignment matches no more of the item's words than occur in the passage."""
    return int(np.isin(item, passage).sum()) >= threshold * len(item)


FOUND = "doc long, th long, item int, start array<int>, stop array<int>, words binary"


def _candidates(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            doc, th = batch.column("doc").to_numpy(), batch.column("th").to_numpy()
            rows = []
            for a, b in groups(texts):
                h, n = word_hashes(texts[a:b], punctuation=True)
                for k, words in enumerate(np.split(h, np.cumsum(n)[:-1])):
                    for i, at in items.hits(words, threshold):
                        spans = [(s, e) for s, e in _passages(at, len(items.words[i]), len(words), threshold) if _may_reach(items.words[i], words[s:e], threshold)]
                        if spans:
                            rows.append((int(doc[a + k]), int(th[a + k]), i, [s[0] for s in spans], [s[1] for s in spans], b"".join(words[s:e].tobytes() for s, e in spans)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])

    return docs.select(order_id().alias("doc"), text_hash().alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, FOUND)


SCORED = "doc long, th long, item int, score double, matches int, first_word int, last_word int"


def _align(pairs: DataFrame, items: Items, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[tuple[int, int], list] = {}
            for doc, th, item, start, stop, words in zip(*(batch.column(c).to_pylist() for c in ("doc", "th", "item", "start", "stop", "words")), strict=True):
                w, at = np.frombuffer(words, np.uint64), 0
                for s, e in zip(start, stop, strict=True):
                    by.setdefault((item, (e - s).bit_length()), []).append((doc, th, s, w[at : at + e - s]))
                    at += e - s
            best: dict[tuple, tuple] = {}
            for (item, _), rows in by.items():
                own = items.words[item]
                most = max(len(r[3]) for r in rows)
                step = max(1, (1 << 19) // most)
                for k in range(0, len(rows), step):
                    part = rows[k : k + step]
                    grid = np.zeros((len(part), most), np.uint64)
                    for i, r in enumerate(part):
                        grid[i, : len(r[3])] = r[3]
                    score, upto, end = align(own, grid)
                    for i in np.flatnonzero(score >= threshold * MATCH * len(own)).tolist():
                        doc, th, s, w = part[i]
                        new = (-int(score[i]), s + int(end[i]), int(upto[i]), int(end[i]), w)
                        if new[:2] < best.get((doc, th, item), (1,))[:2]:
                            best[doc, th, item] = new
            if best:
                rows = []
                for (doc, th, item), (score, stop, upto, end, w) in best.items():
                    own = items.words[item]
                    first, matches = traced(own, w, upto, end)
                    rows.append((doc, th, item, -score / (MATCH * len(own)), matches, stop - end + first, stop - 1))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCORED.split(", ")])

    return pairs.select("doc", "th", "item", "start", "stop", "words").mapInArrow(run, SCORED)


def _blocks(benchmark: DataFrame, most: int) -> Iterator[tuple[list, Items]]:
    ids: list = []
    texts: list[bytes] = []
    words = 0
    for r in benchmark.select("item_id", "text").where("text is not null").distinct().toLocalIterator():  # a block at a time
        text = r.text.encode()
        n = len(word_hashes([text], punctuation=True)[0])
        if texts and words + n > most:
            yield ids, Items(texts)
            ids, texts, words = [], [], 0
        ids.append(r.item_id)
        texts.append(text)
        words += n
    if texts:
        yield ids, Items(texts)


RESULT = "doc long, th long, item_id long, score double, matches int, first_word int, last_word int"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """RESULT: one row for each document (by ``order_id`` and ``text_hash``) and test item of which it holds a copy: its score, matched words, and first and last word."""
    spark = docs.sparkSession
    out = None
    for ids, items in _blocks(benchmark, block_words):
        if not items.sizes:
            continue
        found = saved(_candidates(docs, items, threshold), "seeds")
        scored = _align(found.repartition("doc", "th", "item"), items, threshold).groupBy("doc", "th", "item").agg(F.max_by(F.struct("score", "matches", "first_word", "last_word"), F.struct("score", -F.col("last_word"), "first_word")).alias("s"))
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, pa.int64())}))
        part = scored.join(names, "item").select("doc", "th", "item_id", "s.score", "s.matches", "s.first_word", "s.last_word")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RESULT) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold a copy of a test item."""
    bad = contaminated(docs, benchmark, threshold).select(F.col("doc").alias("__doc"), F.col("th").alias("__th")).distinct()
    return docs.withColumns({"__doc": order_id(), "__th": text_hash()}).join(bad, ["__doc", "__th"], "left_anti").select(*docs.columns)
