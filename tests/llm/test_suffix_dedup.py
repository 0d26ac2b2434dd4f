import hashlib
import random

import numpy as np
import pytest

from loomgraph.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, rk string, start int, n int"


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by a table of all windows."""
    distinct = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    seen, gone = {}, {}
    for _, k in enumerate(distinct):
        b = k[2].encode()
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - S.WINDOW + 1):
            w = b[i : i + S.WINDOW]
            if w in seen:
                mark[i : i + S.WINDOW] = True
            seen.setdefault(w, k)
        gone[k] = mark
    out = []
    for d, t in rows:
        b, mark = (t or "").encode(), gone[d is not None, d or 0, t or ""]
        kept = bytes(np.frombuffer(b, np.uint8)[~mark])
        out.append((d, len(b), int(mark.sum()), int((np.diff(mark.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(12))
def test_suffix_order(seed):
    r = random.Random(seed)
    t = [r.randint(1, r.choice([1, 2, 3, 200])) for _ in range(r.randint(0, 200))]
    want = sorted(range(len(t)), key=lambda i: t[i:])
    assert S.suffix_order(np.array(t, np.int64), rounds=9).tolist() == want


@pytest.mark.parametrize("seed", range(8))
def test_suffix_order_to_a_depth(seed):
    r = random.Random(seed)
    part = [r.randint(1, 3) for _ in range(60)]
    t = [x for _ in range(20) for x in [*part[r.randint(0, 9) :], r.randint(1, 3)]]
    order = S.suffix_order(np.array(t, np.int64), rounds=2)
    assert sorted(order.tolist()) == list(range(len(t)))
    heads = [t[i : i + 9] for i in order.tolist()]
    assert heads == sorted(heads)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 9)))
    passage = [" ".join(word() for _ in range(r.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(passage) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 5))]
        parts = [p[r.randint(0, 30) :] if r.random() < 0.3 else p for p in parts]
        rows.append((i * 7, " ".join(parts)))
    rows += [(3, None), (4, ""), (5, "x" * 300), (6, "x" * 100), (8, "y" * 99), (9, "Shti " * 200), (None, rows[5][1]), (1000, rows[5][1]), (1001, "ab" * 4000 + rows[7][1])]
    rows += [rows[9], rows[9]]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, S.HOT), (2, 3)])
def test_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "e", 1, 2) for d, t in rows], SCHEMA)
    got = S.suffix_dedup(df.repartition(3), hot).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got], key=repr) == brute(rows)


def test_empty(spark):
    assert S.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_with_one_hash(spark, monkeypatch):
    """Documents are known by their id and a hash: with one hash for all, those of different ids stay apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "text_hash", lambda: F.lit(5).cast("long"))
    rows = [r for r in dict((d, (d, t)) for d, t in corpus(3)).values()]
    got = S.suffix_dedup(spark.createDataFrame([(d, t, "e", 1, 2) for d, t in rows], SCHEMA)).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got], key=repr) == brute(rows)
