import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import token_ids as T

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = ["", " \n\t", "Hello, World... it's 123 ok", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "é É é x y Ü×÷ß", "日本語 テスト。 　x", "a_b __ 12a3 '''s don't", "\x00\x1c\x1d z", "Σίσυφος ΣΑΣ İ", "a|b <| |> < |", "x" * 5000, "🙂🙂 fine", "1,000.50!?"]


def test_encoder_equals_library():
    t, e = Tokenizer.from_file(PATH), T.Encoder(PATH, cache_bits=8)
    for texts in (ODD, ODD[::-1], [" ".join(ODD)], [" ".join(f"w{i}x y{chr(97 + i % 26)}z{i}" for i in range(400))]):
        ids, n = e([x.encode() for x in texts])
        want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


@pytest.mark.parametrize("extra", [[], [(None, "null id"), (5, "twin"), (5, "twin"), (5, "other"), (9, None)]])
def test_round_trip_and_index(spark, extra):
    rows = [(i * 3, x) for i, x in enumerate(ODD)] + extra
    df = spark.createDataFrame([(d, x, "en", "s", 1) for d, x in rows], DOCS)
    out, index = T.token_ids(spark, df, PATH)
    assert sorted(map(tuple, out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == brute(rows)
    ix, t = T.Index(index), Tokenizer.from_file(PATH)
    for d in {r[0] for r in rows}:
        want = sorted([*t.encode(x or "", add_special_tokens=False).ids, 1] for k, x in rows if k == d)
        assert sorted(x.tolist() for x in ix.get(d)) == want
    assert ix.get(10**12) == [] and ix.get(-4) == []


def test_empty_table(spark):
    out, index = T.token_ids(spark, spark.createDataFrame([], DOCS), PATH)
    assert out.count() == 0 and T.Index(index).get(1) == []


def test_minimal_perfect():
    h = T.mix(np.arange(20_000, dtype=np.uint64))
    m = T.MinimalPerfectHash.build(h)
    assert sorted(m(h).tolist()) == list(range(20_000))


def test_words_with_one_hash(monkeypatch):
    """Words are told apart by their bytes: here there are but 16 hashes."""
    t, mix = Tokenizer.from_file(PATH), T.mix
    monkeypatch.setattr(T, "mix", lambda x: mix(x) & np.uint64(31))
    e = T.Encoder(PATH, cache_bits=8)
    for texts in (ODD, ["the cat sat on the mat", "The dog Sat ON a log <|x"], ODD[::-1], [" ".join(f"w{i} y{chr(97 + i % 26)}" for i in range(300))]):
        ids, n = e([x.encode() for x in texts])
        want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_many_shards_and_hot_key(spark):
    rows = [(i, f"text {i} of many") for i in range(400)] + [(7, f"one of {i} rows of an id") for i in range(400)] + [(None, f"none {i}") for i in range(20)]
    df = spark.createDataFrame([(d, x, "en", "s", 1) for d, x in rows], DOCS)
    shards = T.write_corpus(df, at := T.scratch(spark, "ids"), PATH, 80)
    assert shards.where("n_docs > 0").count() >= 64 and max(r.n_docs for r in shards.collect()) < 100
    want = brute(rows)
    read = sorted(map(tuple, T.read_corpus(shards).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert read == want
    assert [r[0] for r in want].count(7) == 401


def test_keys_that_are_not_there(spark):
    df = spark.createDataFrame([(d, f"text {d}", "en", "s", 1) for d in range(50)], DOCS)
    shards = T.write_corpus(df, at := T.scratch(spark, "ids"), PATH)
    T.build_index(shards, at + "/index")
    keys = spark.createDataFrame([(7,), (49,), (50,), (-1,), (None,)], "doc_id long")
    assert sorted(r.doc_id for r in T.read_keys(keys, shards, at + "/index").collect()) == [7, 49]
