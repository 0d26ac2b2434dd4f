"""Token-ID output: raw id shards in document order, and a minimal perfect hash index from document key to place.

``write_corpus`` range-partitions documents by ``doc_id``, encodes each partition as a stream and writes one shard per
partition; ``build_index`` partitions the keys by hash and writes one minimal perfect hash per index part, whose slots
hold a fingerprint and the place of the key's documents; ``Index.get`` goes key -> index part -> slot -> fingerprint -> bytes
in constant time. ``read_keys`` does the same for a table of keys: each part of them meets its index part, and the places found
are read from the shards in order. ``read_corpus`` reads every shard back without an index.

Shard file ``shard-NNNNN.ids`` (little endian): magic ``LGID0001``, bytes per id (u32), documents (u64), ids (u64), the raw
ids of all documents one after another, then doc_ids (i64), a null flag a document (u8), and ids per document (u64).
A shard is written under a temporary name and renamed, so a repeated task replaces it by the same bytes.

Cases: null text counts as empty (its end id only); null doc_ids come first, and are one key; rows that share a doc_id
(repeated rows too) are kept one after another, ordered by text, in as many shards as the beginnings of their texts tell
apart, and are found together under their key; very long texts are encoded whole, each within one task; other columns are
ignored, whatever their names; an empty table gives no shard that holds documents, and an index without keys.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import groups, local_path, mix, partitions, scratch

END_ID = 1
MAGIC = b"LGID0001"
SHARDS = "shard int, path string, n_docs long, n_ids long"
CACHE_BITS = 21

_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[0xC3] = 1
_CLASS[0x80:0xC0] = 1  # only after 0xC3; otherwise the chunk is odd
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1000, 1256, dtype=np.uint64))
#: The word pattern whose pre-tokens ``Encoder`` can find itself.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Encodes texts with a tokenizers file; for one whose words are encoded apart, each word is encoded once and remembered.

    Words are found by a 64-bit hash and told apart by their bytes. White space parts words; a chunk between white space is split further only if it has
    nothing but ASCII and letters of Latin-1, and neither an apostrophe nor the beginning of a special token; other chunks
    are encoded whole. The memory is bounded: it is emptied when half full.
    """

    def __init__(self, path: str, cache_bits: int = CACHE_BITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        spec = json.load(open(path))
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec["model"].get("end_of_word_suffix") == "</w>" and _PATTERN in json.dumps(pre, ensure_ascii=False).replace("\\\\", "\\")
        n = self.t.get_vocab_size(True)
        self.dtype = np.dtype("<u2" if n <= 65536 else "<u4")
        self.ends = np.zeros(n, bool)
        for token, i in self.t.get_vocab(True).items():
            self.ends[i] = token.endswith("</w>")
        self.bits = cache_bits
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.n = 0
        self.starts, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool, self.used = np.zeros(1 << 18, self.dtype), 0
        #: The entries' words: odd ones as they are, others lower-cased.
        self.word_at, self.word_len = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.letters, self.lettered = np.zeros(1 << 18, np.uint8), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = h & mask
        key = self.keys[slot]
        out = np.where(key == h, self.at[slot], -1)
        rest = np.flatnonzero((key != h) & (key != 0))
        while len(rest):
            slot[rest] = (slot[rest] + np.uint64(1)) & mask
            key = self.keys[slot[rest]]
            hit = key == h[rest]
            out[rest[hit]] = self.at[slot[rest[hit]]]
            rest = rest[~hit & (key != 0)]
        return out

    def _append(self, ids: np.ndarray, lens: np.ndarray, letters: np.ndarray, letter_lens: np.ndarray) -> int:
        """Adds entries, which nothing leads to yet; the place of the first."""
        k = len(lens)
        while self.n + k > len(self.starts):
            for name in ("starts", "lens", "word_at", "word_len"):
                setattr(self, name, np.resize(getattr(self, name), 2 * len(getattr(self, name))))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        while self.lettered + len(letters) > len(self.letters):
            self.letters = np.resize(self.letters, 2 * len(self.letters))
        at = self.n
        self.starts[at : at + k], self.lens[at : at + k] = np.cumsum(lens) - lens + self.used, lens
        self.word_at[at : at + k], self.word_len[at : at + k] = np.cumsum(letter_lens) - letter_lens + self.lettered, letter_lens
        self.pool[self.used : self.used + len(ids)] = ids
        self.letters[self.lettered : self.lettered + len(letters)] = letters
        self.n += k
        self.used += len(ids)
        self.lettered += len(letters)
        return at

    def _enter(self, h: np.ndarray, first: int) -> None:
        """Makes the entries from ``first`` on findable by distinct hashes that aren't known yet."""
        mask = np.uint64((1 << self.bits) - 1)
        slot, left = h & mask, np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.at[slot[put]] = h[put], first + put
            done = np.zeros(len(h), bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = np.where(self.keys[slot[left]] != 0, (slot[left] + np.uint64(1)) & mask, slot[left])

    def _other(self, at: np.ndarray, body: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Places of words whose entry is that of another word with the same hash."""
        differ = self.word_len[at] != length
        same = np.flatnonzero(~differ)
        n = length[same]
        ends = np.cumsum(n)
        if len(same):
            step = np.arange(ends[-1]) - np.repeat(ends - n, n)
            unlike = body[step + np.repeat(first[same], n)] != self.letters[step + np.repeat(self.word_at[at[same]], n)]
            differ[same] = np.logical_or.reduceat(unlike, ends - n)
        return np.flatnonzero(differ)

    def _encode(self, new: np.ndarray, raw: bytes, starts: np.ndarray, length: np.ndarray, odd: np.ndarray, body: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, int]:
        """Adds entries for the words at ``new``; these in the entries' order, and the place of the first entry."""
        plain, whole = new[~odd[new]], new[odd[new]]
        got, lens = [], []
        for group, together in ((plain, True), (whole, False)):
            pieces = [raw[a : a + n].decode() for a, n in zip(starts[group].tolist(), length[group].tolist(), strict=True)]
            if not pieces:
                continue
            if together:
                ids = np.array(self.t.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
                n = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
                if len(n) != len(pieces):
                    raise ValueError("a word wasn't encoded apart from its neighbours")
            else:
                own = [e.ids for e in self.t.encode_batch_fast(pieces, add_special_tokens=False)]
                ids, n = np.array([i for x in own for i in x], self.dtype), np.array([len(x) for x in own], np.int64)
            got.append(ids)
            lens.append(n)
        order = np.concatenate([plain, whole])
        n = length[order]
        letters = body[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[order], n)]
        return order, self._append(np.concatenate(got), np.concatenate(lens), letters, n)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text."""
        if not self.by_word:
            own = [e.ids for e in self.t.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([i for x in own for i in x], self.dtype), np.array([len(x) for x in own], np.int64)
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        kind = _CLASS[buf]
        space = kind == 0
        prev = np.empty_like(kind)
        prev[0], prev[1:] = 0, kind[:-1]
        before = np.empty_like(buf)
        before[0], before[1:] = 32, buf[:-1]
        # What isn't ASCII must be a letter U+00C0 to U+00FF; an apostrophe or <| makes its chunk odd.
        odd = np.flatnonzero((buf == 39) | ((buf >= 0x80) & (buf != 0xC3) & ((buf >= 0xC0) | (before != 0xC3) | (buf == 0x97) | (buf == 0xB7))) | ((buf == 124) & (before == 60)))
        starts_chunk = ~space & (prev == 0)
        chunk = np.flatnonzero(starts_chunk)
        if not len(chunk):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        begin = ~space & ((kind != prev) | (kind == 2))
        if len(odd):
            is_odd = np.zeros(len(chunk), bool)
            is_odd[np.searchsorted(chunk, odd, "right") - 1] = True
            end = np.flatnonzero(space & (prev != 0))
            begin &= ~np.repeat(np.tile([False, True], len(chunk))[: 2 * len(chunk)] & np.repeat(is_odd, 2), self._runs(chunk, end, len(buf))) | starts_chunk
        starts = np.flatnonzero(begin)
        word = np.flatnonzero(~space)
        first = np.searchsorted(word, starts)
        length = np.diff(np.append(first, len(word)))
        body = _LOWER[buf[word]]
        if len(odd):
            odd_word = is_odd[np.searchsorted(chunk, starts, "right") - 1]
            body = np.where(np.repeat(odd_word, length), buf[word], body)
        else:
            odd_word = np.zeros(len(starts), bool)
        with np.errstate(over="ignore"):
            pos = (np.arange(len(word)) - np.repeat(first, length)).astype(np.uint64)
            h = mix(np.add.reduceat(mix(_BYTE[body] + pos * np.uint64(0x9E3779B97F4A7C15)), first) + odd_word.astype(np.uint64) * np.uint64(77)) | np.uint64(1)
        at = self._find(h)
        raw = b""
        if len(miss := np.flatnonzero(at < 0)):
            _, one = np.unique(h[miss], return_index=True)
            new = miss[one]
            if self.n + len(new) > (1 << self.bits) // 2:
                self._clear()
                _, new = np.unique(h, return_index=True)
            if self.n + len(new) > (1 << self.bits) // 2:
                return self._halves(texts)
            raw = buf.tobytes()
            order, entry = self._encode(new, raw, starts, length, odd_word, body, first)
            self._enter(h[order], entry)
            at = self._find(h)
        if len(other := self._other(at, body, first, length)):
            # Another word has that hash: these are encoded each time they come.
            order, entry = self._encode(other, raw or buf.tobytes(), starts, length, odd_word, body, first)
            at[order] = entry + np.arange(len(order))
        n = self.lens[at].astype(np.int64)
        to = np.cumsum(n)
        ids = self.pool[np.arange(to[-1]) + np.repeat(self.starts[at] - (to - n), n)]
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
        cut = np.append(0, to)[np.searchsorted(starts, bounds)]
        return ids, np.diff(cut)

    @staticmethod
    def _runs(chunk: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
        """Lengths of gap, chunk, gap, chunk ... as far as the last chunk's following space."""
        edge = np.empty(2 * len(chunk) + 1, np.int64)
        edge[0], edge[1::2], edge[2::2] = 0, chunk, end
        edge[-1] = n
        return np.diff(edge)

    def _halves(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For texts with more words than the memory holds."""
        if len(texts) > 1:
            k = len(texts) // 2
            a, b = self(texts[:k]), self(texts[k:])
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        ids = np.array(self.t.encode_batch_fast([texts[0].decode()], add_special_tokens=False)[0].ids, self.dtype)
        return ids, np.array([len(ids)], np.int64)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One a Python worker: its words stay known from task to task."""
    return Encoder(path)


#: Characters of a text by which rows with one doc_id may be dealt to several shards.
BEGINNING = 64


def write_corpus(docs: DataFrame, path: str, tokenizer: str, shards: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes shards below ``path``; one row (SHARDS) for each, in document order. Evaluated once, at once."""
    spark = docs.sparkSession
    folder = local_path(path)
    os.makedirs(folder, exist_ok=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    ready = (
        rows.repartitionByRange(shards or partitions(spark), F.col("doc_id").asc_nulls_first(), F.substring("text", 1, BEGINNING))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        out, at, ids_n, keys, nulls, lens = None, "", 0, [], [], []
        shard = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                shard = batch.column("part")[0].as_py()
                at = f"{folder}/.{shard}-{uuid.uuid4().hex}"
                out = open(at, "wb")
                out.write(MAGIC + bytes(20))
            texts = batch.column("text").to_pylist()
            for a, b in groups(texts):
                ids, n = enc(texts[a:b])
                full = np.full(len(ids) + b - a, end_id, enc.dtype)
                keep = np.ones(len(full), bool)
                keep[np.cumsum(n + 1) - 1] = False
                full[keep] = ids
                out.write(full.tobytes())
                lens.append(n + 1)
                ids_n += len(full)
            ids_ = batch.column("doc_id")
            nulls.append(np.asarray(ids_.is_null()).astype(np.uint8))
            keys.append(np.asarray(ids_.fill_null(0)))
        if out is None:
            return
        keys_, lens_ = np.concatenate(keys).astype("<i8"), np.concatenate(lens).astype("<u8")
        out.write(keys_.tobytes() + np.concatenate(nulls).tobytes() + lens_.tobytes())
        out.seek(len(MAGIC))
        out.write(np.array([enc.dtype.itemsize], "<u4").tobytes() + np.array([len(keys_), ids_n], "<u8").tobytes())
        out.close()
        os.replace(at, to := f"{folder}/shard-{shard:05d}.ids")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([to]), pa.array([len(keys_)], pa.int64()), pa.array([ids_n], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])

    done = sorted(ready.mapInArrow(write, SHARDS).collect())  # one row a shard
    return spark.createDataFrame([tuple(r) for r in done], SHARDS)


class Shard:
    """A shard file, opened without reading its ids."""

    def __init__(self, path: str):
        self.file = open(path, "rb")
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{path} is no id shard")
        self.width = int(np.frombuffer(self.file.read(4), "<u4")[0])
        self.n_docs, self.n_ids = (int(x) for x in np.frombuffer(self.file.read(16), "<u8"))
        self.base = 28
        self.file.seek(self.base + self.n_ids * self.width)
        tail = self.file.read(self.n_docs * 17)
        if len(tail) != self.n_docs * 17:
            raise ValueError(f"{path} is cut short")
        self.doc_ids = np.frombuffer(tail, "<i8", self.n_docs)
        self.null = np.frombuffer(tail, np.uint8, self.n_docs, 8 * self.n_docs).astype(bool)
        self.lens = np.frombuffer(tail, "<u8", self.n_docs, 9 * self.n_docs).astype(np.int64)

    def key(self, doc: int) -> int | None:
        return None if self.null[doc] else int(self.doc_ids[doc])

    def ids(self, first: int, n: int) -> np.ndarray:
        self.file.seek(self.base + first * self.width)
        return np.frombuffer(self.file.read(n * self.width), f"<u{self.width}")


def _with_base(shards: DataFrame) -> DataFrame:
    """Shards with the number of ids before each, spread so that each is a task of its own. One row a shard: driver work."""
    rows, base = [], 0
    for r in sorted(shards.collect()):
        rows.append((*r, base))
        base += r.n_ids
    spark = shards.sparkSession
    return spark.createDataFrame(rows, SHARDS + ", base long").repartitionById(max(1, len(rows)), F.col("shard"))


def read_corpus(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of ids as u32), shard, offset: from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row["path"])
                first = np.cumsum(s.lens) - s.lens
                for a in range(0, s.n_docs, 2000):
                    b = min(a + 2000, s.n_docs)
                    crc = []
                    for i in range(a, b):
                        crc.append(zlib.crc32(s.ids(int(first[i]), int(s.lens[i])).astype("<u4")))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(s.doc_ids[a:b], pa.int64(), mask=s.null[a:b]),
                            pa.array(first[a:b] + row["base"], pa.int64()),
                            pa.array(s.lens[a:b], pa.int64()),
                            pa.array(crc, pa.int64()),
                            pa.array(np.full(b - a, row["shard"]), pa.int32()),
                            pa.array(first[a:b], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset"],
                    )

    return _with_base(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long")


# The index -----------------------------------------------------------------------------------------------------------

ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("doc", "<u8"), ("n_docs", "<u4"), ("offset", "<u8"), ("n_ids", "<u8")])


def key_hash(doc_id: np.ndarray, null: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(doc_id.astype(np.int64).view(np.uint64) + np.where(null, np.uint64(0x5851F42D4C957F2D), np.uint64(0)))


class MinimalPerfectHash:
    """n distinct 64-bit hashes to 0..n-1: levels of bit arrays, each holding the keys that collide with none, ranked."""

    GAMMA, BLOCK = 2, 512

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            # Ones before each byte of the level, and in all levels before it.
            ones = np.append(0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)) + total
            self.ranks.append(ones)
            total = int(ones[-1])
        self.n = total

    @staticmethod
    def _at(h: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(h + np.uint64(level + 1) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> MinimalPerfectHash:
        levels, left = [], np.asarray(h, np.uint64)
        while len(left):
            size = -(-cls.GAMMA * len(left) // cls.BLOCK) * cls.BLOCK
            at = cls._at(left, len(levels), size)
            count = np.bincount(at, minlength=size)
            levels.append(np.packbits(count == 1))
            left = left[count[at] > 1]
            if len(levels) > 200:
                raise ValueError("keys aren't distinct")
        return cls(levels)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Slots; -1 where a key surely isn't among those it was built from."""
        h = np.asarray(h, np.uint64)
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = self._at(h[left], k, len(bits) * 8)
            byte = bits[at >> 3]
            hit = (byte >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            before = np.bitwise_count((byte.astype(np.uint16) >> (8 - (at & 7)).astype(np.uint16)).astype(np.uint8))
            out[left[hit]] = self.ranks[k][at[hit] >> 3] + before[hit]
            left = left[~hit]
        return out

    def save(self, f) -> None:
        f.write(np.array([len(self.levels), *map(len, self.levels)], "<u8").tobytes())
        for bits in self.levels:
            f.write(bits.tobytes())

    @classmethod
    def load(cls, f) -> MinimalPerfectHash:
        n = int(np.frombuffer(f.read(8), "<u8")[0])
        sizes = np.frombuffer(f.read(8 * n), "<u8").tolist()
        return cls([np.frombuffer(f.read(int(s)), np.uint8) for s in sizes])


def build_index(shards: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """Writes one index part per hash range of keys below ``path``; (part, path, n_keys) of each. Evaluated at once."""
    spark = shards.sparkSession
    folder = local_path(path)
    os.makedirs(folder, exist_ok=True)
    parts = parts or partitions(spark)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row["path"])
                new = np.flatnonzero(np.append(True, (s.doc_ids[1:] != s.doc_ids[:-1]) | (s.null[1:] != s.null[:-1])))
                h = key_hash(s.doc_ids[new], s.null[new])
                first = np.append(0, np.cumsum(s.lens))
                ends = np.append(new[1:], s.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array((h % np.uint64(parts)).astype(np.int32)), pa.array(np.full(len(new), row["shard"], np.int32)), pa.array(new), pa.array(ends - new), pa.array(first[new]), pa.array(first[ends] - first[new])],
                    names=["h", "part", "shard", "doc", "n_docs", "offset", "n_ids"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        part, h = t["part"][0].as_py(), t["h"].to_numpy().view(np.uint64)
        mph = MinimalPerfectHash.build(h)
        slots = np.zeros(len(h), ENTRY)
        at = mph(h)
        slots["print"][at] = (mix(h) >> np.uint64(32)).astype(np.uint32)
        for c in ("shard", "doc", "n_docs", "offset", "n_ids"):
            slots[c][at] = t[c].to_numpy()
        with open(own := f"{folder}/.{part}-{uuid.uuid4().hex}", "wb") as f:
            mph.save(f)
            f.write(slots.tobytes())
        os.replace(own, to := f"{folder}/part-{part:05d}.mph")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([to]), pa.array([len(h)], pa.int64())], names=["part", "path", "n_keys"])

    entries = _with_base(shards).mapInArrow(keys, "h long, part int, shard int, doc long, n_docs long, offset long, n_ids long")
    done = sorted(entries.repartitionById(parts, F.col("part")).mapInArrow(write, "part int, path string, n_keys long").collect())  # one row a part
    with open(f"{folder}/.index", "w") as f:
        json.dump({"parts": parts, "shards": {r.shard: r.path for r in shards.collect()}}, f)
    os.replace(f"{folder}/.index", f"{folder}/index.json")
    return spark.createDataFrame([tuple(r) for r in done], "part int, path string, n_keys long")


def read_part(folder: str, k: int) -> tuple[MinimalPerfectHash, np.ndarray] | None:
    """An index part's hash and slots; None for one without keys."""
    if not os.path.exists(at := f"{folder}/part-{k:05d}.mph"):
        return None
    with open(at, "rb") as f:
        mph = MinimalPerfectHash.load(f)
        return mph, np.frombuffer(f.read(), ENTRY)


class Index:
    """Keyed access: ``Index(path).get(doc_id)`` gives the id arrays of the documents of that key ([] if there is none)."""

    def __init__(self, path: str):
        self.folder = local_path(path)
        meta = json.load(open(f"{self.folder}/index.json"))
        self.parts, self.paths = meta["parts"], meta["shards"]
        self.part, self.shard = lru_cache(64)(self._part), lru_cache(64)(lambda k: Shard(self.paths[str(k)]))

    def _part(self, k: int) -> tuple[MinimalPerfectHash, np.ndarray] | None:
        return read_part(self.folder, k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        h = key_hash(np.array([doc_id or 0]), np.array([doc_id is None]))
        if (part := self.part(int(h[0] % np.uint64(self.parts)))) is None:
            return []
        at = int(part[0](h)[0])
        if at < 0 or int(part[1]["print"][at]) != int(mix(h)[0] >> np.uint64(32)):
            return []
        e = part[1][at]
        s, doc = self.shard(int(e["shard"])), int(e["doc"])
        if s.key(doc) != doc_id:
            return []
        lens = s.lens[doc : doc + int(e["n_docs"])]
        return np.split(s.ids(int(e["offset"]), int(e["n_ids"])), np.cumsum(lens)[:-1])


PLACES = "doc_id long, shard int, doc long, n_docs long, offset long, n_ids long"


def lookup(keys: DataFrame, index: str) -> DataFrame:
    """PLACES of the keys (doc_id, each once) that the index below ``index`` holds: their first document in a shard, how many there are, and their ids."""
    folder = local_path(index)
    with open(f"{folder}/index.json") as f:
        parts = json.load(f)["parts"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("doc_id")
            h = key_hash(np.asarray(key.fill_null(0)), np.asarray(key.is_null()))
            yield pa.RecordBatch.from_arrays([key, pa.array(h.view(np.int64)), pa.array((h % np.uint64(parts)).astype(np.int32))], names=["doc_id", "h", "part"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if part != (now := batch.column("part")[0].as_py()):
                part, own = now, read_part(folder, now)
            if own is None:
                continue
            mph, slots = own
            h = batch.column("h").to_numpy().view(np.uint64)
            at = mph(h)
            hit = at >= 0
            hit[hit] = slots["print"][at[hit]] == (mix(h[hit]) >> np.uint64(32)).astype(np.uint32)
            e = slots[at[hit]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(hit)), pa.array(e["shard"].astype(np.int32)), *(pa.array(e[c].astype(np.int64)) for c in ("doc", "n_docs", "offset", "n_ids"))], names=["doc_id", "shard", "doc", "n_docs", "offset", "n_ids"])

    return keys.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(deal, "doc_id long, h long, part int").repartitionById(parts, F.col("part")).mapInArrow(find, PLACES)


def read_keys(keys: DataFrame, shards: DataFrame, index: str) -> DataFrame:
    """The rows of ``read_corpus`` for the documents of these keys, each found through the index: its places are read in their order in a shard."""
    rows = sorted(shards.collect())  # one row a shard
    base = np.cumsum([0, *(r.n_ids for r in rows)])[:-1].tolist()
    at = {r.shard: (r.path, b) for r, b in zip(rows, base, strict=True)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, s, first = -1, None, None
        for batch in batches:
            out = []
            for key, k, doc, n_docs, offset, n_ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard", "doc", "n_docs", "offset", "n_ids")), strict=True):
                if k != shard:
                    shard, s = k, Shard(at[k][0])
                lens = s.lens[doc : doc + n_docs]
                if s.key(doc) != key:
                    continue  # a key that isn't there, with the fingerprint of one that is
                if int(lens.sum()) != n_ids:
                    raise ValueError(f"the index doesn't fit {at[k][0]}")
                for ids in np.split(s.ids(offset, n_ids), np.cumsum(lens)[:-1]):
                    out.append((key, at[k][1] + offset, len(ids), zlib.crc32(ids.astype("<u4")), k, offset))
                    offset += len(ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()], strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset"])

    places = lookup(keys, index).repartitionById(max(1, len(rows)), F.pmod(F.col("shard"), F.lit(max(1, len(rows))))).sortWithinPartitions("shard", "offset")
    return places.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long")


def token_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, shards: int | None = None) -> tuple[DataFrame, str]:
    """Shards and index below a new folder; a row for each document, found by its key through the index, and the index's folder."""
    at = scratch(spark, "token-ids")
    written = write_corpus(docs, at, tokenizer, shards)
    build_index(written, at + "/index")
    return read_keys(docs.select("doc_id").distinct(), written, at + "/index"), at + "/index"
