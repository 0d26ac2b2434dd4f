"""URL filtering by lists as they stood when a page was fetched.

A list is a table of dated changes (kind, pattern, category, action 'add' or 'remove', at); kinds are ``host`` (that host
only), ``domain`` (it and all below it) and ``prefix`` (host and leading path segments, without scheme). ``intervals``
turns them into validity intervals [since, until): of changes at one instant a removal wins, repeated additions change
nothing. ``judge`` is the as-of join: every capture meets the entries of its own keys (host, each parent domain, each
path prefix, of the lengths that are listed at all) and those whose interval holds its fetch time are active. The most specific active entry is reported:
prefix before host before domain, then the longest pattern, then by category.

Skew: the list is folded to one row a key with an array of its intervals, which depends on the list alone; each such row is
replicated SALT times and each capture goes to one replica, so a host with a third of all captures is spread over as many
tasks. Nothing is broadcast by hint.

Cases: a null url, one without a host, or a null fetch time matches nothing (blocked is false); rows of the list with a
null kind, pattern, action or date, or an unknown action, change nothing; a null category is a category; a prefix that is a
bare host or ends in / matches nothing; repeated captures give a row each; of equally specific entries the last by
pattern, category and date is shown; urls of any length are taken whole: the work for one grows with its length times the
number of different lengths listed; other columns of the captures stay (a result's name among them is refused, any other
is free); empty captures give no rows, an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import saved, table
from loomgraph.shipping import shipped

SALT = 16
RESULTS = ["host", "blocked", "kind", "pattern", "category", "since", "n_active"]


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r"\.?(:[0-9]*)?$", "")


def keys_of(url: Column, host: Column, domains: list[int], prefixes: list[int]) -> Column:
    """All (kind, pattern) that could list the url, as an array of structs; of domains and prefixes those of these lengths."""
    full = F.concat(host, F.lit("/"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1))
    size, own = F.char_length(full), F.char_length(host)
    char = lambda s, i: F.substr(s, i, F.lit(1))
    some = lambda lengths: F.lit(lengths).cast("array<int>") if lengths else F.array().cast("array<int>")
    tails = F.filter(some(domains), lambda n: (n == own) | ((n < own) & (char(host, own - n) == ".")))
    heads = F.filter(some(prefixes), lambda n: (n > own + 1) & ((n == size) | ((n < size) & (char(full, n + 1) == "/"))) & (char(full, n) != "/"))
    entry = lambda kind, p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern"))
    found = F.concat(F.array(entry("host", host)), F.transform(tails, lambda n: entry("domain", F.right(host, n))), F.transform(heads, lambda n: entry("prefix", F.left(full, n))))
    return F.when(F.coalesce(host, F.lit("")) != "", found)


def intervals(changes: DataFrame) -> DataFrame:
    """kind, pattern, category, since, until (null: still valid) from dated changes."""
    own = changes.where("kind is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    each = own.groupBy("kind", "pattern", "category", "at").agg(F.min(F.col("action") == "add").alias("on"))
    w = Window.partitionBy("kind", "pattern", "category").orderBy("at")
    turns = each.withColumn("before", F.lag("on", 1, False).over(w)).where("`on` <> `before`")
    return turns.withColumn("until", F.lead("at").over(w)).where("`on`").select("kind", "pattern", "category", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, changes: DataFrame, url: str = "url", at: str = "fetched_at", salt: int = SALT) -> DataFrame:
    """``captures`` with host, blocked, kind, pattern, category, since and n_active."""
    if clash := set(RESULTS) & set(captures.columns):
        raise ValueError(f"captures already have {sorted(clash)}")
    listed = saved(intervals(changes).groupBy("kind", "pattern").agg(F.collect_list(F.struct("since", "until", "category")).alias("spans")), "listed")
    # The lengths of what is listed: at most as many as the longest pattern has characters.
    lengths = {r.kind: sorted(r.n) for r in listed.where("kind in ('domain', 'prefix')").groupBy("kind").agg(F.collect_set(F.char_length("pattern")).alias("n")).collect()}
    sent = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    # Equal urls fetched at one time are judged once.
    asked = captures.select(F.col(url).alias("u"), F.col(at).alias("t")).where("u is not null and t is not null").distinct()
    rank = F.create_map(*[F.lit(x) for x in ("prefix", 3, "host", 2, "domain", 1)])
    hits = (
        asked.withColumn("host", host_of(F.col("u")))
        .select("u", "t", F.pmod(F.xxhash64("u", "t"), F.lit(salt)).cast("int").alias("salt"), F.inline(keys_of(F.col("u"), F.col("host"), lengths.get("domain", []), lengths.get("prefix", []))))
        .join(sent, ["kind", "pattern", "salt"])
        .withColumn("span", F.explode(F.filter("spans", lambda s: (s.since <= F.col("t")) & (s.until.isNull() | (F.col("t") < s.until)))))
    )
    best = F.max_by(
        F.struct("kind", "pattern", F.col("span.category").alias("category"), F.col("span.since").alias("since")),
        F.struct(rank[F.col("kind")], F.char_length("pattern"), "pattern", F.col("span.category"), F.col("span.since")),
    )
    verdict = hits.groupBy("u", "t").agg(F.count(F.lit(1)).alias("n_active"), best.alias("best"))
    out = captures.join(verdict, (captures[url] == verdict.u) & (captures[at] == verdict.t), "left")
    return out.select(
        *[captures[c] for c in captures.columns],
        host_of(captures[url]).alias("host"),
        verdict.n_active.isNotNull().alias("blocked"),
        *[verdict.best[c].alias(c) for c in ("kind", "pattern", "category", "since")],
        F.coalesce(verdict.n_active, F.lit(0)).cast("long").alias("n_active"),
    )


# The query: a list derived from the hosts themselves, for the tables hold none -------------------------------------------

DAY = 86400
START = 1_704_067_200  # 2024-01-01


def _number(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 6), 16, 10).cast("long")


def sample_list(captures: DataFrame) -> DataFrame:
    """Dated changes (at in epoch seconds) for a part of the hosts, domains and first path segments that occur."""
    base = captures.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]+)", 1).alias("seg")).where("host <> ''").distinct()
    hosts = base.select(F.lit("host").alias("kind"), F.col("host").alias("pattern"), F.lit("spam").alias("category"), F.lit(2).alias("part"), F.lit(60).alias("days")).distinct()
    domains = base.select(F.lit("domain").alias("kind"), F.substring_index("host", ".", -2).alias("pattern"), F.lit("adult").alias("category"), F.lit(3).alias("part"), F.lit(150).alias("days")).distinct()
    prefixes = base.where("seg <> ''").select(F.lit("prefix").alias("kind"), F.concat_ws("/", "host", "seg").alias("pattern"), F.lit("mirror").alias("category"), F.lit(3).alias("part"), F.lit(30).alias("days")).distinct()
    own = hosts.unionByName(domains).unionByName(prefixes).withColumn("n", _number(F.concat_ws("|", "kind", "pattern"))).where("n % part = 0")
    day = lambda x: F.lit(START) + x * DAY
    first = F.col("n") % 200
    change = lambda action, at: F.struct(F.lit(action).alias("action"), at.cast("long").alias("at"))
    return own.select("kind", "pattern", "category", F.inline(F.array(change("add", day(first)), change("remove", day(first + F.col("days"))), change("add", day(first + 2 * F.col("days"))))))


@shipped
def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select("page_id", "url", (F.lit(START) + F.col("page_id") * 7919 % 525600 * 60).alias("fetched_at"))
    return judge(captures, sample_list(captures))


OP3_SQL = r"""
WITH c AS (
  SELECT page_id, url, 1704067200 + page_id * 7919 % 525600 * 60 AS fetched_at,
    regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', '')), '\.?(:[0-9]*)?$', '') AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1) AS seg,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)', 1) AS path
  FROM pages),
own AS (
  SELECT DISTINCT 'host' AS kind, host AS pattern, 'spam' AS category, 2 AS part, 60 AS days FROM c WHERE host <> ''
  UNION ALL SELECT DISTINCT 'domain', array_to_string(list_slice(string_split(host, '.'), -2, -1), '.'), 'adult', 3, 150 FROM c WHERE host <> ''
  UNION ALL SELECT DISTINCT 'prefix', host || '/' || seg, 'mirror', 3, 30 FROM c WHERE host <> '' AND seg <> ''),
numbered AS (SELECT *, ('0x' || substr(md5(kind || '|' || pattern), 1, 6))::BIGINT AS n FROM own),
spans AS (
  SELECT kind, pattern, category, 1704067200 + n % 200 * 86400 AS since, 1704067200 + (n % 200 + days) * 86400 AS until FROM numbered WHERE n % part = 0
  UNION ALL SELECT kind, pattern, category, 1704067200 + (n % 200 + 2 * days) * 86400, 9223372036854775807 FROM numbered WHERE n % part = 0),
hits AS (
  SELECT c.page_id, c.url, s.kind, s.pattern, s.category, s.since,
    row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY CASE s.kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(s.pattern) DESC, s.pattern DESC, s.category DESC, s.since DESC) AS r,
    count(*) OVER (PARTITION BY c.page_id, c.url) AS n
  FROM c JOIN spans s ON s.since <= c.fetched_at AND c.fetched_at < s.until AND (
    s.kind = 'host' AND c.host = s.pattern
    OR s.kind = 'domain' AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern))
    OR s.kind = 'prefix' AND (c.host || '/' || c.path = s.pattern OR starts_with(c.host || '/' || c.path, s.pattern || '/'))))
SELECT c.page_id, c.url, c.fetched_at, c.host, h.r IS NOT NULL AS blocked, h.kind, h.pattern, h.category, h.since, coalesce(h.n, 0)::BIGINT AS n_active
FROM c LEFT JOIN hits h ON c.page_id = h.page_id AND c.url = h.url AND h.r = 1
"""
