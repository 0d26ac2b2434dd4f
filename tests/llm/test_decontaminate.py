import random

import numpy as np

from loomgraph.llm import decontaminate as D
from loomgraph.llm.common import NULL_ID

DOCS = "doc_id long, text string, item_id string, score int"
ITEMS = "item_id long, text string, doc_id int"


def table_of(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISS), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return h


def brute_align(a, b):
    return int(table_of(a, b).max(initial=0))


def norm(t):
    return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()


def brute(a, b):
    """The best score of item ``a`` in the words of ``b`` that are within reach of a seed; -1 without one."""
    n = min(D.SEED, len(a))
    seeds = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)} if a else set()
    near = np.zeros(len(b) + 1, bool)
    for p in range(len(b) - n + 1):
        if tuple(b[p : p + n]) in seeds:
            near[max(0, p - 2 * len(a)) : p + D.SEED + 2 * len(a)] = True
    near[len(b)] = False
    edges = np.flatnonzero(np.diff(near.astype(int), prepend=0))
    return max((brute_align(a, b[s:e]) for s, e in zip(edges[::2], edges[1::2], strict=True)), default=-1)


def test_alignment():
    r = np.random.default_rng(3)
    for _ in range(60):
        a, grid = r.integers(1, 5, 9).astype(np.uint64), r.integers(1, 5, (4, 17)).astype(np.uint64)
        score, upto, end = D.align(a, grid)
        assert score.tolist() == [brute_align(a, row) for row in grid]
        for s, i, e, row in zip(score.tolist(), upto.tolist(), end.tolist(), grid, strict=True):
            first, matches = D.traced(a, row, i, e)
            # The passage alone has that score, starts and ends with a match, and doesn't have it without its last word.
            assert brute_align(a, row[first:e]) == s == brute_align(a[:i], row[first:e])
            assert brute_align(a[:i], row[first : e - 1]) < s and 2 * matches >= s and row[first] in a and row[e - 1] == a[i - 1]


def test_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(r.randint(5, 30)))) for i in range(12)]
    rows = []
    for i in range(80):
        w = [word() for _ in range(r.randint(0, 120))]
        if r.random() < 0.6:
            c = r.choice(items)[1].split()
            for k in range(len(c)):
                if r.random() < 0.12:
                    c[k] = word()
            if r.random() < 0.3:
                del c[r.randrange(len(c))]
            at = r.randint(0, len(w))
            w[at:at] = c
        rows.append((i, " ".join(w).capitalize().replace(" ", ", ", 1)))
    rows += [(200, items[0][1].upper()), (201, None), (202, ""), (None, items[1][1]), (0, items[2][1]), (203, items[3][1] + " tail"), (203, items[3][1] + " tail"), (204, "z " * 30_000 + items[4][1]), (205, "hi there")]
    items += [(50, None), (51, ""), (52, "Hi there!"), (None, items[5][1]), (53, items[6][1])]
    docs = spark.createDataFrame([(d, t, "e", 1) for d, t in rows], DOCS)
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)
    want = {}
    for d, t in rows:
        for i, x in items:
            a, b = norm(x), norm(t)
            if a and len(b) < 1000 and (s := brute(a, b)) >= D.THRESHOLD * D.MATCH * len(a):
                want[NULL_ID if d is None else d, i, t] = s / (D.MATCH * len(a))
    want[204, 4, rows[-2][1]] = 1.0
    text = {(NULL_ID if d is None else d, i): norm(t) for d, i, t in want}
    for block in (D.BLOCK_WORDS, 40):
        got = D.contaminated(docs, bench, block_words=block).collect()
        assert sorted((g.doc, str(g.item_id), g.score) for g in got) == sorted((d, str(i), s) for d, i, s in {(d, i, s) for (d, i, _), s in want.items()})
        for g in got:
            if [k[:2] for k in want].count((g.doc, g.item_id)) == 1 and g.doc != 0:
                item = norm(dict(items)[g.item_id])
                passage = text[g.doc, g.item_id][g.first_word : g.last_word + 1]
                assert brute_align(item, passage) == g.score * D.MATCH * len(item) and passage[0] in item and passage[-1] in item and g.matches <= len(passage)
    assert {(200, 0), (NULL_ID, 1), (0, 2), (203, 3), (204, 4), (205, 52)} <= {(g.doc, g.item_id) for g in got}
    left = D.clean(docs, bench)
    assert left.columns == docs.columns and {(NULL_ID if r.doc_id is None else r.doc_id) for r in left.collect()} >= {201, 202}
    assert left.where("doc_id in (200, 203, 204, 205)").count() == 0
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0


def test_widely_quoted_item(spark):
    """Fifty documents quote an item's beginning, one quotes it all; and a copy that starts at word 3 is told so."""
    item = [f"w{i}" for i in range(20)]
    rows = [(i, f"so {i} " + " ".join(item[:11]) + f" end {i}") for i in range(50)] + [(99, "a b c " + " ".join(item) + " d")]
    got = D.contaminated(spark.createDataFrame([(d, t, "e", 1) for d, t in rows], DOCS), spark.createDataFrame([(7, " ".join(item), 3)], ITEMS)).collect()
    assert {g.doc: (g.score, g.matches, g.first_word, g.last_word) for g in got} == {i: (0.55, 11, 2, 12) for i in range(50)} | {99: (1.0, 20, 3, 22)}


def test_seed_of_many_items(spark):
    """A run of words that all items and documents share brings no pair that its other words don't."""
    items = [(i, "which of the following " + " ".join(f"q{i}x{k}" for k in range(6))) for i in range(40)]
    rows = [(i, "now which of the following is it " + " ".join(f"z{i}y{k}" for k in range(30))) for i in range(30)] + [(50, "say " + items[3][1])]
    docs = spark.createDataFrame([(d, t, "e", 1) for d, t in rows], DOCS)
    own = D.Items([t.encode() for _, t in items])
    assert [i for i, _ in own.hits(D.word_hashes([rows[0][1].encode()], punctuation=True)[0], D.THRESHOLD)] == []
    assert [(g.doc, g.item_id) for g in D.contaminated(docs, spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)).collect()] == [(50, 3)]


def test_edited_copy_beside_exact_ones(spark):
    """Whole copies elsewhere raise the counts of the very seeds that an edited copy has lost."""
    item = [f"w{i}" for i in range(50)]
    edited = {n: ["x" if i % (50 // n) == 2 and i // (50 // n) < n else w for i, w in enumerate(item)] for n in (8, 10, 12)}
    rows = [(0, " ".join(item)), (1, "so " + " ".join(item))] + [(n, "a b c " + " ".join(w)) for n, w in edited.items()]
    rows += [(100 + i, " ".join(item[i : i + 5]) + " and no more of it") for i in range(40)]
    for copies in (rows[:1] + rows[2:3], rows[:1] + rows[3:4], rows):
        docs = spark.createDataFrame([(d, t, "e", 1) for d, t in copies], DOCS)
        got = {g.doc: g.score for g in D.contaminated(docs, spark.createDataFrame([(7, " ".join(item), 3)], ITEMS)).collect()}
        want = {d: brute_align(item, t.split()) / (D.MATCH * len(item)) for d, t in copies}
        assert got == {d: s for d, s in want.items() if s >= D.THRESHOLD}
        assert set(got) == {d for d, _ in copies if d < 100}
