"""Language identification: multinomial logistic regression on TF-IDF of character n-grams, by FTRL-proximal.

Texts are lower-cased; every run of characters that aren't letters becomes one space, as do both ends. N-grams of 1 to 3
characters are hashed to 2**BITS features; a text's vector is (1 + log tf) * idf, of length 1. Document frequencies are
counted over all training documents. The model is trained online (follow the regularised leader, elastic net: per-coordinate
steps, l1 and l2) on about PER_LANGUAGE documents of each language, chosen by a hash of doc_id and text (and no more than twice
as many in all); a fifth of these is held back to fit the temperature of the softmax. Training is one task, from that bounded
sample; there are as many classes as languages, which are taken to be few.

Training documents are those with a non-null lang that ``trains`` admits. Cases: null texts and texts without a letter are
``und`` with score 0; with no training document every text is ``und``, with one language all others get it with score 1;
null doc_ids are admitted like others; repeated rows are in the sample together or not at all, up to its bound, and get equal
results; ties between languages go to the first by name; very long texts are read whole; other columns stay (held_out, lang_pred
or score among them are refused); an empty table gives no rows.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import text_hash

BITS = 15
D = 1 << BITS
PER_LANGUAGE = 1000
EPOCHS = 4
#: L1 leaves some 9 of 100 weights other than 0 at no cost in accuracy.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 1e-5
UNKNOWN = "und"

_ASCII_LETTER = re.compile("[A-Za-z]").search
#: By code point below 0x3000: is it a letter? Beyond, it is looked up.
_LETTER = np.array([chr(i).isalpha() for i in range(0x3000)])


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER(text) is not None or any(map(str.isalpha, text)))


def grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams, as a dense array of D."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[np.minimum(c, len(_LETTER) - 1)]
    far = np.flatnonzero(c >= len(_LETTER))
    if len(far):
        known, back = np.unique(c[far], return_inverse=True)
        letter[far] = np.array([chr(x).isalpha() for x in known.tolist()])[back]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first of each run of others stands for it
    c = np.where(letter, c, np.uint32(32))[keep]
    with np.errstate(over="ignore"):
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
    h = np.concatenate([one, two, three])
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    return np.bincount(h >> np.uint32(32 - BITS), minlength=D)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the text's TF-IDF vector."""
    n = grams(text)
    at = np.flatnonzero(n)
    v = (1 + np.log(n[at])) * idf[at]
    return at, v / np.sqrt(v @ v)


class Ftrl:
    """FTRL-proximal for a softmax over ``k`` classes, row by row."""

    def __init__(self, k: int):
        self.z, self.n = np.zeros((D, k)), np.zeros((D, k))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, v: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(v @ w)
        p[y] -= 1
        g = v[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(scores / np.exp(t))[np.arange(len(y)), y] + 1e-300).mean())

    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, names: list[str], idf: np.ndarray, w: np.ndarray, t: float):
        self.names, self.idf, self.w, self.t = names, idf, w, t

    def save(self) -> bytes:
        np.savez_compressed(f := io.BytesIO(), names=np.array(self.names, dtype=object).astype("U") if self.names else np.zeros(0, "U1"), idf=self.idf, w=self.w, t=self.t)
        return f.getvalue()

    @classmethod
    def load(cls, b: bytes) -> Model:
        with np.load(io.BytesIO(b)) as z:
            return cls(z["names"].tolist(), z["idf"], z["w"], float(z["t"]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        at, v = vector(text, self.idf)
        p = softmax(v @ self.w[at] / self.t)
        k = int(p.argmax())
        return self.names[k], float(p[k])


def train(texts: list[str], langs: list[str], names: list[str], idf: np.ndarray) -> Model:
    rng = np.random.default_rng(5)
    own = [(*vector(t, idf), names.index(y)) for t, y in zip(texts, langs, strict=True) if has_letter(t)]
    own = [own[i] for i in rng.permutation(len(own))]
    back, rest = own[::5], [o for i, o in enumerate(own) if i % 5]
    f = Ftrl(len(names))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rest)):
            f.learn(*rest[i])
    w = f.weights(slice(None)).astype(np.float32)
    scores = np.array([v @ w[at] for at, v, _ in back]).reshape(len(back), len(names))
    return Model(names, idf, w, temperature(scores, np.array([y for *_, y in back], int)))


def idf_of(docs: DataFrame) -> np.ndarray:
    """log((1 + N) / (1 + df)) + 1 over all of ``docs`` that have a letter; D sums are all that reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(D + 1, np.int64), 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                if has_letter(t):
                    df[:D] += grams(t) > 0
                    n += 1
        df[D] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["at", "n"])

    df = np.zeros(D + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        df[r.at] = r.n
    return np.log((1 + df[D]) / (1 + df[:D])) + 1


def fit(docs: DataFrame, trains: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Trains on the rows of ``docs`` (doc_id, text, lang) that have a lang and that ``trains`` admits."""
    own = docs.where(F.col("lang").isNotNull() & (F.lit(True) if trains is None else trains)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    names = sorted(counts)
    if not names:
        return Model([], np.ones(D), np.zeros((D, 0), np.float32), 1.0)
    idf = idf_of(own)
    bound = F.create_map(*[F.lit(x) for k in names for x in (k, int(min(1.0, per_language / counts[k]) * (1 << 30)))])
    hashed = own.withColumn("h", F.xxhash64("doc_id", text_hash(), F.lit(13)))
    chosen = hashed.where(F.pmod("h", F.lit(1 << 30)) < bound[F.col("lang")]).orderBy("h", "doc_id", "text", "lang").limit(2 * per_language * len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((str(d), t or "", y) for b in batches for d, t, y in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True))
        model = train([g[1] for g in got], [g[2] for g in got], names, idf)
        yield pa.RecordBatch.from_arrays([pa.array([model.save()], pa.binary())], names=["model"])

    got = chosen.repartition(1).mapInArrow(run, "model binary").first()  # the bounded sample only
    return Model.load(bytes(got[0])) if got else Model([], idf, np.zeros((D, 0), np.float32), 1.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score."""
    if clash := {"lang_pred", "score"} & set(docs.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    saved_ = model.save()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.load(saved_)
        for batch in batches:
            got = [own.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, mod 5; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def language_id(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out, lang_pred and score; learns from those that aren't held out."""
    if "held_out" in docs.columns:
        raise ValueError("there is a column held_out already")
    model = fit(docs, remainder() != 0)
    return predict(docs.withColumn("held_out", remainder() == 0), model)
