import pytest
from pyspark.sql import functions as F

from loomgraph.functions import predicates as P
from loomgraph.functions import text as X
from loomgraph.operators.graph import post_order
from loomgraph.operators.relational import best_split, merge_small, unique_names
from loomgraph.streaming import changes as C


def value(spark, column, **inputs):
    row = {k: v for k, v in inputs.items()}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)) if row else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(("url", "clean", "query"), [("/a.js?x=1#h", "/a.js", "x=1"), ("/a.js#h?x", "/a.js", "x"), ("/a", "/a", ""), ("/a?b?c#d", "/a", "b?c")])
def test_urls(spark, url, clean, query):
    assert value(spark, X.clean_url(F.col("u")), u=url) == clean
    assert value(spark, X.get_query(F.col("u")), u=url) == query


@pytest.mark.parametrize(("url", "key", "want"), [("/a?k=1&k=2", "k", "2"), ("/a?k", "k", ""), ("/a?kk=1", "k", None), ("/a", "k", None)])
def test_query_values(spark, url, key, want):
    assert value(spark, X.query_value(F.col("u"), key), u=url) == want


@pytest.mark.parametrize(("glob", "text", "want"), [("*.js", "/w/a.js", True), ("*.js", "/w/x/a.js", False), ("**/*.js", "/x/a.js", True), ("/x/**", "/x/y/z", True), ("a?.{ts,js}", "/w/ab.ts", True), ("a?.{ts,js}", "/w/ab.css", False), ("a.b", "/w/aXb", False)])
def test_globs(spark, glob, text, want):
    assert value(spark, F.col("t").rlike(X.glob_regex(glob, "/w")), t=text) is want


@pytest.mark.parametrize(("mime", "text", "want"), [("text/plain", "abc", "data:text/plain,abc"), ("a/b", "\u00e9\u00e9\u00e9\u00e9", "data:a/b;base64,w6nDqcOpw6k=")])
def test_data_urls(spark, mime, text, want):
    assert value(spark, X.data_url(F.col("t"), mime), t=text) == want
    parts = X.parse_data_url(F.lit(want))
    assert value(spark, parts["payload"]) == text and value(spark, parts["mime"]) == mime
    assert value(spark, X.parse_data_url(F.lit("http://x"))["payload"]) is None


def test_names(spark):
    assert value(spark, X.sanitize_file_name(F.col("t")), t="C:/a:b?c*") == "C:/a_b_c_"
    assert value(spark, X.identifier(F.col("t")), t="1-a b") == "_1_a_b"
    assert value(spark, X.relative_path(F.col("t"), F.lit("/a/b/c")), t="/a/x/y.js") == "../../x/y.js"
    assert value(spark, X.common_directory(F.array(F.lit("/a/b/c.js"), F.lit("/a/b/d/e.js")))) == "/a/b"
    assert value(spark, X.display_size(F.lit(1234567))) == "1,234.56 kB"
    assert value(spark, X.loader_of(F.col("t"), {"json": "json", "b.json": "bundle"}), t="/x.y/a.b.json") == "bundle"
    assert unique_names(["foo.js", "foo.js", "FOO2.js", "foo.js"]) == ["foo.js", "foo2.js", "FOO22.js", "foo3.js"]


@pytest.mark.parametrize(("tokens", "want"), [([("id", "**/*.js")], True), ([("id", "**/*.js"), "not"], False), ([("id", "**/*.ts"), ("query", "k", "1"), ("or", 2)], False), ([("clean_url", ("id", "**/a.js")), ("query", "v", True), ("and", 2)], True), ([("query", "z", False)], True), ([("code", "x")], False), ([("code", "x"), "not"], True)])
def test_filter_trees(spark, tokens, want):
    url = "/p/a.js" if tokens[0] in (("id", "**/*.js"), ) else "/p/a.js?v=1"
    assert value(spark, P.compile_filter(P.parse(tokens), P.Inputs(id=F.col("u"))), u=url) is want


def test_filter_lists(spark):
    assert value(spark, P.pattern_filter(F.col("t"), [], []), t="a") is True
    assert value(spark, P.pattern_filter(F.col("t"), ["**/b"], []), t="/a") is False
    assert value(spark, P.pattern_filter(F.col("t"), ["**/a"], ["/x/**"]), t="/x/a") is False
    assert value(spark, P.ordered_filter([("exclude", F.col("t") == "a"), ("include", F.lit(True))]), t=None) is True
    with pytest.raises(ValueError):
        P.parse([("id", "a"), ("id", "b")])


@pytest.mark.parametrize(("kinds", "want"), [(["Create", "Update"], "Create"), (["Create", "Delete"], None), (["Delete", "Create"], "Update"), (["Create", "Delete", "Update"], "Update"), (["Update", "Delete"], "Delete"), (["Delete", "Create", "Delete"], "Delete")])
def test_change_folding(spark, kinds, want):
    assert value(spark, C.fold_kinds(F.array(*map(F.lit, kinds)))) == want


def test_queue(spark):
    got = value(spark, C.coalesce_queue(F.array(*map(F.lit, ["Hmr", "HmrRebuild", "Rebuild", "Rebuild", "Hmr", "FullBuild", "Hmr"]))))
    assert got == ["HmrRebuild", "Rebuild", "FullBuild"]


def test_sequential_kernels():
    import pandas as pd

    assert post_order([1, 5], {1: [2, 3], 2: [4], 3: [4, 1], 5: [3]}) == [4, 2, 3, 1, 5]
    assert best_split(["ab", "ab1", "z"], [5.0, 5.0, 5.0], 5, 100) == 2
    assert best_split(["a"], [5.0], 1, 100) is None
    out = merge_small(pd.DataFrame({"size": [1, 10, 20], "entry_set": [[1], [1, 2], [7]], "key": ["a", "b", "c"]}), 5)
    assert out["merged"].tolist() == [2, 1] and sorted(out["size"]) == [11, 20]


def test_minified_names_stay_distinct(spark):
    """Past three characters too, where the SQL of wn11 stops."""
    first = 54 + 54 * 64 + 54 * 64 * 64
    rows = spark.range(first - 3, first + 3).select("id", X.minified_name(F.col("id")).alias("name")).collect()
    assert [r.name for r in rows] == ["Z99", "$99", "_99", "aaaa", "baaa", "caaa"]


def test_merge_small_of_many_groups():
    """The same merges as comparing all groups makes, in a time that many groups allow."""
    import random
    import time

    import pandas as pd

    def plainly(groups, least):
        own = [(s, frozenset(e), k, 1) for s, e, k in groups]
        while len(own) > 1 and (small := min(own, key=lambda g: (g[0], g[2])))[0] < least:
            own.remove(small)
            best = min(own, key=lambda g: (len(g[1] ^ small[1]), g[0], g[2]))
            own.remove(best)
            own.append((best[0] + small[0], best[1] | small[1], min(best[2], small[2]), best[3] + small[3]))
        return {(k, tuple(sorted(e)), s, n) for s, e, k, n in own}

    def merged(groups, least):
        out = merge_small(pd.DataFrame({"size": [g[0] for g in groups], "entry_set": [g[1] for g in groups], "key": [g[2] for g in groups]}), least)
        return {(k, tuple(e), s, n) for k, e, s, n in zip(out["key"], out["entry_set"], out["size"], out["merged"], strict=True)}

    draw = random.Random(1)
    for _ in range(150):
        groups = [(float(draw.randint(0, 9)), draw.sample(range(12), draw.randint(0, 5)), f"k{i}") for i in range(draw.randint(0, 25))]
        assert merged(groups, 15) == plainly(groups, 15)
    many = [(1.0 + i % 7, [i // 4, i // 4 + 1 + i % 3], f"k{i:05}") for i in range(30_000)]
    begun = time.monotonic()
    assert sum(g[3] for g in merged(many, 15)) == len(many)
    assert time.monotonic() - begun < 30


def test_incremental_equals_full(spark):
    from loomgraph.operators.relational import as_of, merge_snapshot

    base = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "importer int, importee int")
    delta = spark.createDataFrame([(1, 9)], "importer int, importee int")
    assert {tuple(r) for r in merge_snapshot(base, delta, ["importer"]).collect()} == {(1, 9), (2, 3)}
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, t int, v string")
    assert {tuple(r) for r in as_of(left, right, ["k"], "t", "v").select("k", "t", "v").collect()} == {("a", 1, None), ("a", 5, "y"), ("b", 3, None)}


def test_unique_and_conflict_names():
    from loomgraph.operators.relational import conflict_names

    assert unique_names(["foo.js", "foo2.js", "foo.js"]) == ["foo.js", "foo2.js", "foo3.js"]
    assert unique_names(["a/x.d.js", "a/x.d.js", "a.b/x", "a.b/x", ".env", ".env"]) == ["a/x.d.js", "a/x2.d.js", "a.b/x", "a.b/x2", ".env", ".env2"]
    assert unique_names(["c-!~{00d}~.js", "c-!~{00D}~.js", "c-!~{00d}~.js"]) == ["c-!~{00d}~.js", "c-!~{00D}~.js", "c-!~{00d}~2.js"]
    assert conflict_names(["a", "a$1", "a", "a", "b"]) == ["a", "a$1", "a$2", "a$3", "b"]
    assert conflict_names(["a", "a", "a$1", "a$1"]) == ["a", "a$1", "a$1$1", "a$1$2"]


def test_watcher_and_coordinator(spark):
    from pyspark.sql import functions as F

    from loomgraph.streaming import changes as C

    def watched(*events):
        df = spark.createDataFrame([(list(events),)], "es array<struct<us:long,input:string>>")
        return tuple(df.select(C.watcher(F.col("es"), 10).alias("s")).select("s.state", "s.builds", "s.ignored").first())

    assert watched() == ("Idle", 0, 0)
    assert watched((0, "change"), (10, "change"), (21, "change")) == ("Debouncing", 1, 0)
    assert watched((0, "change"), (11, "close")) == ("Closing", 1, 0)
    assert watched((0, "change"), (1, "close"), (30, "change"), (60, "change")) == ("Closed", 0, 2)

    def built(*inputs):
        df = spark.createDataFrame([(list(inputs),)], "xs array<string>")
        return tuple(df.select(C.coordinator(F.col("xs")).alias("s")).select(*[f"s.{c}" for c in C.COORDINATOR]).first())

    assert built("change", "done") == ("Initialized", 0, 0, 0, 0, 0, 0)
    assert built("start", "change", "change") == ("FullBuildInProgress", 1, 2, 0, 0, 0, 0)
    assert built("start", "change", "change", "done") == ("InProgress", 2, 0, 2, 0, 0, 0)
    assert built("start", "change", "failed") == ("FullBuildFailed", 1, 1, 0, 0, 0, 0)
    assert built("start", "change", "failed", "change") == ("FullBuildInProgress", 2, 0, 0, 0, 0, 0)
    assert built("start", "done", "change", "change", "change", "failed") == ("InProgress", 3, 0, 0, 0, 2, 1)
    assert built("start", "done", "change", "failed") == ("Failed", 2, 0, 0, 0, 0, 0)
    assert built("start", "done", "change", "done", "done") == ("Idle", 2, 0, 0, 0, 0, 0)


def test_copies_keep_their_folders(spark, tmp_path):
    from loomgraph.operators.relational import copy_files, files

    for at in ("a", "b"):
        (tmp_path / "in" / at).mkdir(parents=True)
        (tmp_path / "in" / at / "x.bin").write_text(at)
    got = copy_files(files(spark, str(tmp_path / "in")), str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert sorted(r.file for r in got) == ["a/x.bin", "b/x.bin"]
    assert (tmp_path / "out/a/x.bin").read_text() == "a" and (tmp_path / "out/b/x.bin").read_text() == "b"


def test_merge_targets(spark):
    """One shared chunk for each verdict; entries 0-3 are user entries, 4-6 dynamic ones, entry k is module 10 + k."""
    from loomgraph.operators.relational import merge_targets

    def verdict(entry_set, records, effects=(), extra=()):
        """The chunk of module 1, loaded by ``entry_set``."""
        ent = spark.createDataFrame([(k, 10 + k, int(k >= 4)) for k in range(7)], "entry_idx long, module_idx long, kind int")
        rows = [(10 + k, [k], k, k in effects) for k in range(7) if 10 + k not in extra] + [(m, list(entry_set), 99, False) for m in (1, *extra)]
        chunks = spark.createDataFrame(rows, "module_idx long, entry_set array<long>, chunk_idx int, has_side_effects boolean")
        rec = spark.createDataFrame(records, "importer long, importee long, kind string")
        return tuple(merge_targets(chunks, rec, ent).first())[1:]

    s, d = "import-statement", "dynamic-import"
    assert verdict([0, 1], [(10, 11, s)]) == (1, "merged")
    assert verdict([0, 1], [(10, 11, d)]) == (None, "no_target")
    assert verdict([0, 1, 2], [(10, 11, s), (12, 11, s), (11, 12, s)]) == (1, "merged")
    assert verdict([0, 4], [(10, 14, d)]) == (0, "merged")
    assert verdict([0, 4], [(11, 14, d)]) == (None, "unreached")
    assert verdict([0, 4], [(10, 14, d), (11, 14, d)]) == (0, "merged")
    assert verdict([0, 4], [(10, 14, d), (11, 14, d)], effects=[0]) == (None, "leaks")
    assert verdict([0, 4], [(10, 14, d)], effects=[0]) == (0, "merged")
    assert verdict([0, 4], [(10, 14, d)], extra=[14]) == (0, "merged")
    assert verdict([0, 4], [(10, 14, d), (12, 14, d)], extra=[14]) == (None, "importers")
    assert verdict([4, 5], [(14, 15, s)]) == (5, "merged")
    assert verdict([4, 5], [(14, 15, s), (15, 14, s)], extra=[15]) == (None, "pollutes")
