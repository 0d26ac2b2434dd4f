import random

from loomgraph.llm import url_lists as U

LIST = "kind string, pattern string, category string, action string, at long"


def test_against_brute_force(spark):
    r = random.Random(1)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "B.ORG:80", "u@b.org"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['p', 'p/q', 'q/', '', 'p?x=/z#f'])}" for _ in range(200)] + ["", "nohost", None, "http:///p", "https://a.com"]
    caps = [(i, u, r.randint(0, 100)) for i, u in enumerate(urls)] + [(0, urls[0], None), (5, urls[5], 50), (5, urls[5], 50)]
    patterns = [("host", "a.com"), ("domain", "a.com"), ("domain", "com"), ("host", "b.org"), ("prefix", "a.com/p"), ("prefix", "b.org/p/q"), ("domain", "x.a.com")]
    changes = [(*r.choice(patterns), r.choice(["s", "t", None]), r.choice(["add", "remove"]), r.randint(0, 100)) for _ in range(80)]
    changes += [("host", "a.com", "s", "add", 40), ("host", "a.com", "s", "remove", 40), (None, "a.com", "s", "add", 0), ("host", None, "s", "add", 0), ("host", "b.org", "s", "noise", 0), ("host", "b.org", "s", "add", None)]

    def active(t):
        last = {}
        for k, p, c, a, at in sorted((x for x in changes if None not in (x[0], x[1], x[4]) and x[3] in ("add", "remove")), key=lambda x: (x[4], x[3] == "remove")):
            if at <= t:
                last[k, p, c] = a
        return [k for k, a in last.items() if a == "add"]

    def hits(u, t):
        if not u or t is None or "://" not in u:
            return []
        rest = u.split("://")[1].split("#")[0].split("?")[0]
        host, _, path = rest.partition("/")
        host = host.rpartition("@")[2].split(":")[0].lower()
        if not host:
            return []
        full = host + "/" + path
        return [x for x in active(t) if x[0] == "host" and x[1] == host or x[0] == "domain" and ("." + host).endswith("." + x[1]) or x[0] == "prefix" and (full == x[1] or full.startswith(x[1] + "/"))]

    df = spark.createDataFrame([(*c, "e") for c in caps], "page_id long, url string, fetched_at long, at string")
    out = U.judge(df, spark.createDataFrame(changes, LIST)).collect()
    assert len(out) == len(caps)
    for row in out:
        want = hits(row.url, row.fetched_at)
        assert row.n_active == len(want) and row.blocked == bool(want), row
        if want:
            top = max(want, key=lambda x: ({"prefix": 3, "host": 2, "domain": 1}[x[0]], len(x[1]), x[1], x[2] is not None, x[2] or ""))
            assert (row.kind, row.pattern, row.category) == top, row
    none = U.judge(df, spark.createDataFrame([], LIST))
    assert none.where("blocked").count() == 0 and none.count() == len(caps)
    assert U.judge(df.limit(0), spark.createDataFrame(changes, LIST)).count() == 0


def test_long_urls_and_clashing_columns(spark):
    """Twenty thousand segments; captures with the names that the operator uses itself; result names are refused."""
    import pytest

    long = "http://a.b.org/" + "/".join(f"s{i}" for i in range(20_000))
    deep = "http://" + "x." * 20_000 + "b.org/"
    rows = [(1, long, 5), (2, deep, 5), (3, "http://b.org/s0", 5), (4, "http://b.org//", 5), (5, "http://a.b.org/s0?q", 5)]
    changes = [("prefix", "a.b.org/s0", "p", "add", 1), ("prefix", "a.b.org/" + "/".join(f"s{i}" for i in range(40)), "q", "add", 1), ("domain", "b.org", "d", "add", 1), ("prefix", "b.org/", "e", "add", 1), ("prefix", "b.org", "e", "add", 1)]
    names = ["page_id", "url", "fetched_at", "best", "u", "t", "span", "spans", "salt"]
    df = spark.createDataFrame([(*r, *["e"] * 6) for r in rows], "page_id long, url string, fetched_at long, " + ", ".join(f"{n} string" for n in names[3:]))
    out = U.judge(df, spark.createDataFrame(changes, LIST))
    assert out.columns == names + U.RESULTS
    assert {r.page_id: (r.kind, r.category, r.n_active, r.best) for r in out.collect()} == {1: ("prefix", "q", 3, "e"), 2: ("domain", "d", 1, "e"), 3: ("domain", "d", 1, "e"), 4: ("domain", "d", 1, "e"), 5: ("prefix", "p", 2, "e")}
    with pytest.raises(ValueError):
        U.judge(df.withColumnRenamed("best", "blocked"), spark.createDataFrame(changes, LIST))
