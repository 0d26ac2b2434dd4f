"""Toxicity by a classifier chain: each category's linear model sees the earlier categories' probabilities.

``fit`` takes documents with one 0/1 column for each category, in the chain's order. Terms are words
(runs of ASCII letters and digits and of all beyond ASCII, A-Z lower-cased, by hash) and the first PREFIXES bytes of longer words,
so that inflected and compound forms count together. It keeps the FEATURES terms with the largest chi-square against any
category among those in at least MIN_DOCS documents (if it is CHI_SQUARE at least); inputs are whether a term occurs at all,
twice, four times, and in at least DENSE of all words. One L2-penalised logistic model, without negative weights of terms, is trained after another; a later model's extra inputs are the log-odds of the earlier ones, in training out of fold (FOLDS folds
by a hash of the document), in prediction of the full models. At most SAMPLE labelled documents are used, chosen by a hash
of doc_id; copies among them (equal in one of two minimal word-triple hashes) count once. The model is trained by one task, from
that sample alone, and is a few hundred kB.

``CATEGORIES`` are those of the query: ``toxic`` is the table's label; ``intense`` and ``varied`` are derived on the sample
from words that stand out in toxic documents (log-odds of 3 or more): a toxic document with an above-median number of
them, and one with three different ones or more.

Cases: null and empty texts have no feature and get the models' base rates; a document without a label is no training
row, one with several labels has each as a row of its own; without any labelled row of both classes, all probabilities are 0;
null doc_ids and equal rows are scored like others; other columns stay.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import Lookup, groups, mix, ngram_hashes, text_hash, word_hashes

SAMPLE = 10_000
FEATURES = 3000
MIN_DOCS = 6
PREFIXES = (4, 5, 6, 7)
LEVELS = (1, 2, 4)
DENSE = 1 / 160
#: Of one degree of freedom, one in a million by chance: words that only go with single mislabelled documents stay out.
CHI_SQUARE = 24.0
FOLDS = 4
STEPS = 150
L2 = 0.5
THRESHOLD = 0.5
CATEGORIES = ("toxic", "intense", "varied")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Rows:
    """Sparse 0/1 rows and a few dense columns."""

    row: np.ndarray
    col: np.ndarray
    n: int
    d: int
    dense: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.dense @ w[self.d :]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.col, g[self.row], self.d), g @ self.dense)

    def take(self, keep: np.ndarray) -> Rows:
        new = np.cumsum(keep) - 1
        own = keep[self.row]
        return Rows(new[self.row[own]], self.col[own], int(keep.sum()), self.d, self.dense[keep])


def logistic(x: Rows, y: np.ndarray, steps: int = STEPS, l2: float = L2) -> np.ndarray:
    """Weights, then the intercept, of the least penalised log loss: L-BFGS with a backtracking line search."""
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w = np.zeros(x.d + x.dense.shape[1] + 1)
    w[-1] = np.log(p / (1 - p))

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(w[:-1]) + w[-1]
        g = _sigmoid(z) - y
        return float(np.logaddexp(0, z).sum() - z @ y + l2 / 2 * (w[:-1] @ w[:-1])), np.append(x.back(g) + l2 * w[:-1], g.sum())

    f, g = at(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, coef = -g.copy(), []
        for s, u, r in reversed(past):
            coef.append(r * (s @ d))
            d -= coef[-1] * u
        if past:
            s, u, _ = past[-1]
            d *= (s @ u) / (u @ u)
        for (s, u, r), c in zip(past, reversed(coef), strict=True):
            d += (c - r * (u @ d)) * s
        slope, step = float(g @ d), 1.0 if past else 1 / max(1.0, float(np.abs(g).sum()))
        if slope > -1e-9:
            break
        for _ in range(30):
            f2, g2 = at(w + step * d)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, u = step * d, g2 - g
        w = w + s
        if s @ u > 1e-12:
            past = [*past[-9:], (s, u, 1 / float(s @ u))]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        f, g = f2, g2
        if done:
            break
    return w


def rising(x: Rows, y: np.ndarray, rounds: int = 6) -> np.ndarray:
    """``logistic`` without negative weights of terms: those are left out, and the rest is fitted again.

    So a word that speaks for a category isn't outweighed by others that a long text has by chance.
    """
    off = np.zeros(x.d, bool)
    for _ in range(rounds):
        keep = ~off[x.col]
        w = logistic(Rows(x.row[keep], x.col[keep], x.n, x.d, x.dense), y)
        new = (w[: x.d] < 0) & ~off
        if not new.any():
            break
        off |= new
    w[: x.d] = np.maximum(w[: x.d], 0)
    return w


def levels(row: np.ndarray, key: np.ndarray, times: np.ndarray, words: np.ndarray, keys: int) -> Rows:
    """Inputs of documents with ``words`` words each, from how often which key occurs in which."""
    step = len(LEVELS) + 1
    over = [times >= k for k in LEVELS] + [times >= DENSE * words[row]]
    return Rows(np.concatenate([row[o] for o in over]), np.concatenate([key[o] * step + i for i, o in enumerate(over)]), len(words), keys * step, np.zeros((len(words), 0)))


class Chain:
    """The trained models: ``keys`` are the words' hashes, ``weights`` one row a category."""

    def __init__(self, keys: np.ndarray, weights: list[np.ndarray], names: list[str]):
        self.keys, self.weights, self.names = keys, weights, names
        self.look = Lookup(keys) if len(keys) else None

    def save(self) -> bytes:
        np.savez(f := io.BytesIO(), keys=self.keys, names=np.array(self.names), **{f"w{i}": w for i, w in enumerate(self.weights)})
        return f.getvalue()

    @classmethod
    def load(cls, b: bytes) -> Chain:
        with np.load(io.BytesIO(b)) as z:
            return cls(z["keys"], [z[f"w{i}"] for i in range(len(z.files) - 2)], z["names"].tolist())

    def rows(self, texts: list[bytes]) -> Rows:
        n = len(texts)
        if self.look is None:
            return Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), n, 0, np.zeros((n, 0)))
        h, counts, *more = word_hashes(texts, True, PREFIXES)
        ends = np.cumsum(counts)
        found = [self.look(h)] + [(more[i][at], k) for i in range(0, len(more), 2) for at, k in (self.look(more[i + 1]),)]
        row = np.searchsorted(ends, np.concatenate([f[0] for f in found]), "right")
        pair, times = np.unique(row * len(self.keys) + np.concatenate([f[1] for f in found]), return_counts=True)
        return levels(pair // len(self.keys), pair % len(self.keys), times, counts, len(self.keys))

    def predict(self, x: Rows) -> np.ndarray:
        """A column of probabilities for each category."""
        if not self.weights:
            return np.zeros((x.n, len(self.names)))
        odds = np.zeros((x.n, 0))
        for w in self.weights:
            z = Rows(x.row, x.col, x.n, x.d, odds).dot(w[:-1]) + w[-1]
            odds = np.column_stack([odds, np.clip(z, -10, 10)])
        return _sigmoid(odds)


def train(texts: list[bytes], labels: np.ndarray, names: list[str], derive=None) -> Chain:
    """Fits the chain on these texts; ``derive`` may add columns to the labels, given rows, words' presence and labels."""
    kept, terms, words, seen = [], [], [], (set(), set())
    for i, t in enumerate(texts):
        h, _, *more = word_hashes([t], True, PREFIXES)
        if len(h):
            own = [int(mix(ngram_hashes(h, 3) + np.uint64(k)).min()) for k in (1, 2)]
            if own[0] in seen[0] or own[1] in seen[1]:
                continue
            seen[0].add(own[0])
            seen[1].add(own[1])
        kept.append(i)
        words.append(len(h))
        own, times = np.unique(np.concatenate([h, *more[1::2]]), return_counts=True)
        terms.append((own, times.astype(np.int32)))
    y = labels[kept].astype(float)
    none = Chain(np.zeros(0, np.uint64), [], names)
    if not len(y) or not 0 < y[:, 0].sum() < len(y):
        return none
    fold = (mix(np.array([int(w[0]) if len(w) else i for i, (w, _) in enumerate(terms)], np.uint64)) % np.uint64(FOLDS)).astype(int)
    # Terms of fewer documents can't be chosen, and are most of all: they go before anything is made of them.
    every = np.concatenate([w for w, _ in terms])
    every.sort()
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))[: len(every)]
    df = np.diff(np.append(first, len(every)))
    keys, df = every[first[df >= MIN_DOCS]], df[df >= MIN_DOCS]
    del every, first
    for i, (w, c) in enumerate(terms):
        at = np.minimum(np.searchsorted(keys, w), max(0, len(keys) - 1))
        hit = keys[at] == w if len(keys) else np.zeros(len(w), bool)
        terms[i] = at[hit].astype(np.int32), c[hit]
    row = np.repeat(np.arange(len(terms)), [len(w) for w, _ in terms])
    col, times = (np.concatenate([t[k] for t in terms]).astype(np.int64) for k in (0, 1))
    del terms
    if derive:
        y = derive(y, row, col, df)
    n, score = len(y), np.zeros(len(keys))
    for k in range(y.shape[1]):
        both, pos = np.bincount(col, y[row, k], len(keys)), y[:, k].sum()
        want = df * pos / n
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = (both - want) ** 2 * n / (want * (n - df) * (1 - pos / n))
        score = np.maximum(score, np.nan_to_num(chi, posinf=0))
    score[df < MIN_DOCS] = -1
    best = np.sort(np.argsort(-score, kind="stable")[:FEATURES])
    best = best[score[best] >= CHI_SQUARE]
    to = np.full(len(keys), -1)
    to[best] = np.arange(len(best))
    own = to[col] >= 0
    base = levels(row[own], to[col[own]], times[own], np.array(words), len(best))
    weights = []
    for k in range(y.shape[1]):
        weights.append(rising(base, y[:, k]))
        out = np.zeros(n)
        for f in range(FOLDS):
            of = fold == f
            if of.any() and not of.all():
                w = rising(base.take(~of), y[~of, k])
                out[of] = base.take(of).dot(w[:-1]) + w[-1]
        base = Rows(base.row, base.col, n, base.d, np.column_stack([base.dense, np.clip(out, -10, 10)]))
    return Chain(keys[best], weights, names)


def derive_intensity(y: np.ndarray, row: np.ndarray, col: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Adds ``intense`` and ``varied`` to ``toxic``, by words that stand out in toxic rows."""
    toxic = y[:, 0] == 1
    pos = np.bincount(col, toxic[row].astype(float), len(df))
    odds = np.log((pos + 0.5) / toxic.sum()) - np.log((df - pos + 0.5) / (~toxic).sum())
    strong = (odds >= 3) & (df >= MIN_DOCS)
    n = np.bincount(row, strong[col].astype(float), len(y))
    middle = np.median(n[toxic & (n > 0)]) if (toxic & (n > 0)).any() else 1
    return np.column_stack([y[:, 0], toxic & (n > middle), toxic & (n >= 3)]).astype(float)


def fit(docs: DataFrame, labels: DataFrame, columns: list[str], names: list[str] | None = None, sample: int = SAMPLE, derive=None) -> Chain:
    """Trains on ``docs`` joined to ``labels`` by doc_id, ``columns`` being the labels' 0/1 columns."""
    own = labels.where(" and ".join(f"`{c}` is not null" for c in ["doc_id", *columns])).select("doc_id", *columns).distinct()
    n = own.count()
    if n > sample:  # the smallest hashes, to a bound that about ``sample`` rows keep
        own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < F.lit(int(sample / n * (1 << 30))))
    names = names or columns
    y = own.select(F.col("doc_id").alias("d"), F.array(*[F.col(f"`{c}`").cast("int") for c in columns]).alias("y")).distinct()
    rows = docs.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).cast("binary").alias("t"), text_hash().alias("th")).join(y, "d")
    # The smallest of each task, then of all: no more than ``sample`` rows meet, however many share an id.
    rows = rows.withColumn("h", F.xxhash64("d", "th", F.lit(11))).orderBy("h", "d", "t", "y").limit(sample).select("d", "t", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(d, t, y) for b in batches for d, t, y in zip(b.column("d").to_pylist(), b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True)]
        got.sort()
        y = np.array([g[2] for g in got]).reshape(len(got), len(columns))
        yield pa.RecordBatch.from_arrays([pa.array([train([g[1] for g in got], y, list(names), derive).save()], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").first()  # the bounded sample only
    return Chain.load(bytes(got[0])) if got else Chain(np.zeros(0, np.uint64), [], list(names))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with p_<category> for each category of the chain."""
    add = [f"p_{n}" for n in chain.names]
    if clash := set(add) & set(docs.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    saved_ = chain.save()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain.load(saved_)
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
            parts = [own.predict(own.rows(texts[a:b])) for a, b in groups(texts)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(add)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(len(add)))], names=[*batch.schema.names, *add])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(a, T.DoubleType()) for a in add)]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with p_toxic, p_intense, p_varied and rejected, by a chain fitted on ``labels`` (doc_id, toxic)."""
    if "rejected" in docs.columns:
        raise ValueError("there is a column rejected already")
    chain = fit(docs, labels, ["toxic"], list(CATEGORIES), derive=derive_intensity)
    return score(docs, chain).withColumn("rejected", F.greatest(*[F.col(f"p_{c}") for c in CATEGORIES]) >= threshold)
