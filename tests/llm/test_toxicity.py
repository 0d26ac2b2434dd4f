import random

import numpy as np

from loomgraph.llm import toxicity as X

SCHEMA = "doc_id long, text string, toxic string, rejected int"


def corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bad = [f"bad{i}" for i in range(8)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 150))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randint(1, 6)):
                w.insert(r.randint(0, len(w)), r.choice(bad).upper())
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_cases(spark):
    rows, labels = corpus(1200, 1)
    truth = dict(labels)
    known = [x for x in labels if x[0] < 700]
    extra = [(2000, None), (2001, ""), (None, "w1 bad1 bad2"), (2002, "w1 " * 40_000 + "bad3 bad4"), (2003, "w5 bad1"), (2003, "w5 bad1")]
    df = spark.createDataFrame([(d, t, "e", 1) for d, t in rows + extra], SCHEMA)
    lab = spark.createDataFrame([(d, y) for d, y in known] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    chain = X.fit(df, lab, ["toxic"], list(X.CATEGORIES), derive=X.derive_intensity)
    got = X.score(df.drop("toxic", "rejected"), chain).collect()
    assert len(got) == len(df.collect())
    held = [(g.p_toxic >= 0.5, truth[g.doc_id]) for g in got if g.doc_id is not None and 700 <= g.doc_id < 1200]
    assert np.mean([a == b for a, b in held]) > 0.97
    by = {g.doc_id: g for g in got}
    assert by[None].p_toxic > 0.5 and by[2002].p_toxic > 0.5 and by[2001].p_toxic < 0.5 and by[2000].p_toxic == by[2001].p_toxic
    assert chain.names == ["toxic", "intense", "varied"] and len(chain.weights[2]) == len(chain.weights[0]) + 2
    out = X.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), lab)
    assert {r.doc_id for r in out.where("rejected").collect()} - {d for d, y in labels if y} == set()


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in X.toxicity(df, none).select("p_toxic", "p_varied", "rejected").collect()] == [(0.0, 0.0, False)]
    assert X.toxicity(df.limit(0), none).count() == 0


def test_chain_by_hand():
    """Each model is the optimum of its penalised loss, on features and on log-odds that models of the other folds gave; predictions chain."""
    rows, labels = corpus(400, 3)
    texts = [t.encode() for _, t in rows]
    y = np.array([[a, a and i % 2] for i, (_, a) in enumerate(labels)])
    chain = X.train(texts, y, ["a", "b"])
    rows_ = chain.rows(texts)
    dense = np.zeros((rows_.n, rows_.d))
    np.add.at(dense, (rows_.row, rows_.col), 1)
    # Features one by one: how often a word or a prefix occurs.
    from loomgraph.llm.common import word_hashes

    place, step = {int(k): i for i, k in enumerate(chain.keys)}, len(X.LEVELS) + 1
    for i in range(0, 400, 37):
        words = texts[i].split()
        seen = {}
        for w in words:
            for x in {w} | {w[:n] for n in X.PREFIXES if len(w) > n}:
                seen[x] = seen.get(x, 0) + 1
        want = np.zeros(rows_.d)
        for x, times in seen.items():
            keys = [int(word_hashes([x], True)[0][0])] if x in words else []
            keys += [int(h[0]) for n in X.PREFIXES if len(x) == n for h in [word_hashes([x + b"z"], True, (n,))[2]]]
            for k in keys:
                if k in place:
                    # As a word and as a prefix it is counted apart, under its own hash.
                    count = sum(w == x for w in words) if k == keys[0] and x in words else sum(len(w) > len(x) and w.startswith(x) for w in words)
                    for j, ok in enumerate([count >= n for n in X.LEVELS] + [count >= X.DENSE * len(words)]):
                        want[place[k] * step + j] = ok and count > 0
        assert (want == dense[i]).all()
    fold = np.array([int(X.mix(np.unique(np.concatenate([h[0], *h[3::2]]))[:1])[0] % np.uint64(X.FOLDS)) for h in (word_hashes([t], True, X.PREFIXES) for t in texts)])
    sig = lambda z: 1 / (1 + np.exp(-z))
    extra = np.zeros((rows_.n, 0))
    odds = np.zeros((rows_.n, 0))
    for k, w in enumerate(chain.weights):
        full = np.column_stack([dense, extra])
        g = full.T @ (sig(full @ w[:-1] + w[-1]) - y[:, k]) + X.L2 * w[:-1]
        free = np.append(w[: rows_.d] > 0, np.ones(extra.shape[1], bool))
        assert np.abs(g[free]).max() < 0.05 and (w[: rows_.d] >= 0).all()
        out = np.zeros(rows_.n)
        for f in range(X.FOLDS):
            own = fold == f
            part = X.Rows(*(lambda keep: (np.cumsum(~own)[rows_.row[keep]] - 1, rows_.col[keep]))(~own[rows_.row]), int((~own).sum()), rows_.d, extra[~own])
            v = X.rising(part, y[~own, k].astype(float))
            out[own] = full[own] @ v[:-1] + v[-1]
        extra = np.column_stack([extra, np.clip(out, -10, 10)])
        odds = np.column_stack([odds, np.clip(np.column_stack([dense, odds]) @ w[:-1] + w[-1], -10, 10)])
    assert np.allclose(chain.predict(rows_), sig(odds))


def test_sample_is_bounded_and_clash_refused(spark):
    """Ids and labels that repeat don't enlarge the sample; a column rejected isn't overwritten."""
    import pytest

    df = spark.createDataFrame([(1, f"w{i} bad") for i in range(300)] + [(2, f"v{i} good") for i in range(300)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1)] * 50 + [(2, 0)] * 50, "doc_id long, toxic int")
    chain = X.fit(df, lab, ["toxic"], sample=40)
    p = {r.text.split()[1]: r.p_toxic for r in X.score(df, chain).collect()}
    assert p["bad"] > 0.5 > p["good"]
    with pytest.raises(ValueError):
        X.toxicity(df.selectExpr("*", "1 as rejected"), lab)
