import random

import numpy as np
import zlib

from loomgraph.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string, source string"
SYLLABLES = {"aa": "ka to mi ru se".split(), "bb": "ber sch ung lich ein".split(), "cc": "ção ño qué lla ará".split()}


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        t = " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 80)))
        rows.append((i, t.capitalize() + ".", lang))
    return rows


def test_held_out_accuracy_and_cases(spark):
    rows = corpus(900, 2)
    extra = [(5000, None, "aa"), (5001, "", "aa"), (5002, "123 -- !?", "bb"), (None, "kato miru", None), (5003, "berschung " * 20_000, None), (5004, "Ⅷ ² ½", None), (5005, "字", None), (5006, "kato", "aa"), (5006, "kato", "aa")]
    df = spark.createDataFrame([(*x, "e", "s") for x in rows + extra], SCHEMA).drop("score")
    got = L.language_id(df).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {d: y for d, _, y in rows}
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode() if g.doc_id is not None else b"") % 5 == 0) for g in got)
    held = [(g.lang_pred == truth[g.doc_id], g.score) for g in got if g.held_out and g.doc_id in truth]
    assert np.mean([h[0] for h in held]) > 0.99 and all(0 <= h[1] <= 1 for h in held)
    by = {g.doc_id: (g.lang_pred, g.score) for g in got}
    assert by[5000] == by[5001] == by[5002] == by[5004] == ("und", 0.0)
    assert by[None][0] == "aa" and by[5003][0] == "bb" and by[5005][0] in SYLLABLES


def test_calibration():
    r = np.random.default_rng(0)
    s = r.normal(size=(4000, 3))
    y = np.array([r.choice(3, p=L.softmax(row)) for row in s])
    assert abs(L.temperature(5 * s, y) - 5) < 0.5


def test_few_languages(spark):
    none = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.language_id(none).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, "kato mi", "aa") for i in range(8)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.language_id(one).collect()} == {("aa", 1.0)}
    assert L.language_id(one.limit(0)).count() == 0


def test_ftrl_by_hand(monkeypatch):
    """The vectorised learner against the formulas, coordinate by coordinate."""
    import math

    monkeypatch.setattr(L, "D", 6)
    r = random.Random(1)
    f, z, n = L.Ftrl(3), [[0.0] * 3 for _ in range(6)], [[0.0] * 3 for _ in range(6)]

    def weight(i, k):
        return 0.0 if abs(z[i][k]) <= L.L1 else -(z[i][k] - math.copysign(L.L1, z[i][k])) / ((L.BETA + math.sqrt(n[i][k])) / L.ALPHA + L.L2)

    for _ in range(200):
        at = sorted(r.sample(range(6), 3))
        v, y = [r.random() for _ in at], r.randrange(3)
        s = [sum(x * weight(i, k) for i, x in zip(at, v, strict=True)) for k in range(3)]
        p = [math.exp(x) / sum(map(math.exp, s)) for x in s]
        new = {(i, k): (x * (p[k] - (k == y)), weight(i, k)) for i, x in zip(at, v, strict=True) for k in range(3)}
        for (i, k), (g, w) in new.items():
            z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / L.ALPHA * w
            n[i][k] += g * g
        f.learn(np.array(at), np.array(v), y)
    assert np.allclose(f.z, z) and np.allclose(f.n, n)
    assert np.allclose(f.weights(slice(None)), [[weight(i, k) for k in range(3)] for i in range(6)])


def test_sample_is_bounded_and_clashes_refused(spark):
    import pytest

    rows = [(None, f"kato miru {i}", "aa") for i in range(300)] + [(7, f"berung lich {i}", "bb") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.fit(df, per_language=40)
    assert m.names == ["aa", "bb"] and m.predict("kato")[0] == "aa" and m.predict("berung")[0] == "bb"
    for c in ("held_out", "lang_pred", "score"):
        with pytest.raises(ValueError):
            L.language_id(df.withColumnRenamed("doc_id", "doc_id").selectExpr("*", f"1 as {c}"))
