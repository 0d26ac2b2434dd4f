import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        docs = P.saved(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns, name
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False)) and seen[0] and len(seen[1]) < len(seen[0])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [r.text for r in docs.collect()]
    assert not [t for t in texts if any(i in t for i in items)]
    assert len(set(texts)) == len({r.doc_id for r in docs.collect()})
    out = P.run(spark, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in out) == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in out)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, rejected int, p_toxic string, size int, item_id string, sid string, copies int, path string"


def folder(spark, at, docs, labels, items):
    rows = [(d, t, "en", s, len(t or ""), 1, "e", 2, "i", "s", 3, "p") for d, t, s in docs]
    spark.createDataFrame(rows, EXTRA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_odd_rows_and_columns(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, null ids and sources, and columns with the operators' names."""
    import random

    r = random.Random(2)
    text = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    item, base = text(30), text(80)
    rows = [(i, text(60), "ab"[i % 2]) for i in range(40)] + [(100 + i, f"vile{i % 3} brute{i % 2} " * 6 + text(20), "a") for i in range(30)]
    rows += [(200, None, "a"), (201, "", None), (None, text(50), None), (None, text(50), "b"), (300, base, "a"), (301, base, "b"), (301, base, "b"), (302, base + " tail", "a"), (400, text(20) + " " + item + " " + text(20), "b"), (500, text(30_000), "b"), (5, text(70), "a")]
    at = folder(spark, tmp_path / "t", rows, [(d, 1, int(100 <= d < 130)) for d in [*range(40), *range(100, 130)]] + [(None, None, 1), (7, 1, None)], [(1, item), (2, None), (None, "")])
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in P.STAGES[:-1]:
        docs = P.saved(stage(spark, docs, at), f"test-{name}")
        assert docs.columns == [c.split()[0] for c in EXTRA.split(", ")]
        assert docs.where("rejected <> 1 or p_toxic <> 'e' or size <> 2 or path <> 'p'").count() == 0
        kept.append([(x.doc_id, x.text) for x in docs.collect()])
    ids = [{d for d, _ in k} for k in kept]
    assert not ids[0] & set(range(100, 130)) and ids[0] >= {*range(40), 200, 201, None, 300, 301, 302, 400, 500}
    assert [d for d, t in kept[1] if t and t.startswith(base)] == [300] and ids[1] == ids[0] - {301, 302} and sum(d == 5 for d, _ in kept[1]) == 2 and sum(d is None for d, _ in kept[1]) == 2
    assert ids[2] == ids[1] - {400} and ids[3] <= ids[2]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = P.STAGES[-1][1](spark, docs, at).collect()
    assert sorted((str(x.doc_id), x.n_tokens) for x in out) == sorted((str(d), len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x in kept[3])


def test_empty_tables(spark, tmp_path):
    assert P.run(spark, folder(spark, tmp_path / "t", [], [], [])).count() == 0
