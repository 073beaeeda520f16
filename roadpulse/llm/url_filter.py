"""URL filters with a history: every capture is judged by the list entries active when it was fetched.

Lists change: an entry (list, action, pattern, date) adds a pattern or removes it. ``intervals`` turns the entries of
each (list, pattern) into validity intervals [from, until): between two entries the earlier one holds, and repeated
additions or removals extend what holds. ``as_of_join`` then finds, for each capture, the intervals that contain its
time among the patterns that its URL matches:

* ``host:h`` matches h itself and nothing else;
* ``domain:d`` matches d and every host below it;
* ``path:h/p`` matches h's URLs whose path begins with the whole segments p.

A URL's patterns are its own few keys, its path down to the deepest path that a list names (one small aggregate of the
entries), so that matching is an equality join on the pattern and the year; intervals
are cut into years, so that a capture meets only the entries of its own. A pattern that over HOT_SHARE of all keys
have (at most 1 / HOT_SHARE patterns, so that their names may be broadcast) is salted by the capture's id, and its
intervals are repeated SALTS times.

Defined results: a URL that is NULL or has no host matches nothing and is allowed; a NULL time counts as the table's
latest.
Hosts are lower-cased, user, port and a final dot are dropped, in URLs and in patterns; patterns may end in a slash. Entries
with a NULL field or of no known kind are ignored; of entries of one pattern and
list on one date the removal comes last. An empty list allows everything; an empty table gives an empty result.
Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.llm.common import HOT_SHARE, stored

SALTS = 32
END_OF_TIME = "9999-12-31"
RESULT = ("host", "n_active", "lists", "first_pattern", "listed_since", "blocked")


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return _host(F.regexp_extract(authority, r"^(?:.*@)?([^:@]*)", 1))


def _host(written: Column) -> Column:
    """A host in lower case without the dot that may end it; NULL if nothing is left."""
    host = F.regexp_replace(F.lower(written), r"\.+$", "")
    return F.when(host != "", host)


def normal_pattern(pattern: Column) -> Column:
    """A list's pattern as ``patterns_of`` spells it: host in lower case, no empty segments, no blanks around.

    A path without segments is its host. A pattern of no known kind, or without a host, is NULL.
    """
    written = F.trim(pattern)
    kind = F.lower(F.regexp_extract(written, r"^([A-Za-z]+):", 1))
    rest = F.regexp_replace(written, r"^[A-Za-z]+:", "")
    host = _host(F.substring_index(rest, "/", 1))
    segments = F.filter(F.slice(F.split(rest, "/"), 2, 1 << 30), lambda s: s != "")
    plain = F.concat(F.when((kind == "domain") & (F.size(segments) == 0), "domain:").otherwise("host:"), host)
    path = F.concat(F.lit("path:"), host, F.lit("/"), F.array_join(segments, "/"))
    return F.when(F.size(segments) == 0, F.when(kind.isin("host", "domain", "path"), plain)).when(kind == "path", path)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_depth(entries: DataFrame) -> int:
    """The largest number of segments among the path patterns."""
    segments = F.size(F.split("pattern", "/")) - 1
    return entries.filter(F.col("pattern").startswith("path:")).agg(F.max(segments)).first()[0] or 0


def patterns_of(url: Column, path_depth: int) -> Column:
    """All patterns that match a URL, with paths of at most ``path_depth`` segments; none if it has no host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    depth = F.least(F.size(segments), F.lit(path_depth))
    paths = F.when(depth > 0, F.transform(
        F.sequence(F.lit(1), depth), lambda i: F.concat(F.lit("path:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))
    )).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(F.array(F.concat(F.lit("host:"), host)), domains, paths))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_until) from (list, pattern, action, entry_date); the end is exclusive."""
    entries = entries.withColumn("pattern", normal_pattern(F.col("pattern")))
    known = entries.filter(F.col("action").isin("add", "remove")).dropna(subset=["list", "pattern", "entry_date"])
    last = known.groupBy("list", "pattern", "entry_date").agg(F.max("action").alias("action"))
    order = W.partitionBy("list", "pattern").orderBy("entry_date")
    changes = last.withColumn("before", F.lag("action").over(order)).filter(
        (F.col("action") != F.coalesce("before", F.lit("remove")))
    )
    until = F.lead("entry_date").over(order)
    spans = changes.withColumn("valid_until", F.coalesce(until, F.to_date(F.lit(END_OF_TIME))))
    return spans.filter("action = 'add'").select("list", "pattern", F.col("entry_date").alias("valid_from"), "valid_until")


def as_of_join(captures: DataFrame, active: DataFrame) -> DataFrame:
    """(capture columns, list, pattern, valid_from) for each interval that holds at a capture's ``fetched_on``.

    ``captures`` has ``capture_id, fetched_on, patterns``.
    """
    keyed = captures.select("*", F.explode("patterns").alias("pattern")).drop("patterns")
    counts = keyed.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1000)
    total = keyed.count()
    hot = stored(counts.filter(F.col("n") > total * HOT_SHARE).select("pattern", F.lit(True).alias("_hot")), "hot")
    salts = F.when(F.col("_hot"), F.array(*map(F.lit, range(SALTS)))).otherwise(F.array(F.lit(0)))
    bounds = captures.agg(F.year(F.min("fetched_on")).alias("low"), F.year(F.max("fetched_on")).alias("high"))
    start = F.greatest(F.year("valid_from"), bounds.select("low").scalar())
    end = F.least(F.year(F.date_sub(F.col("valid_until"), 1)), bounds.select("high").scalar())
    placed = active.withColumns({"_start": start, "_end": end}).filter("_start <= _end")
    placed = placed.withColumn("_year", F.explode(F.sequence("_start", "_end"))).drop("_start", "_end")
    placed = placed.join(F.broadcast(hot), "pattern", "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    keyed = keyed.join(F.broadcast(hot), "pattern", "left").withColumns({"_year": F.year("fetched_on"), "_salt": salt})
    holds = (F.col("valid_from") <= F.col("fetched_on")) & (F.col("fetched_on") < F.col("valid_until"))
    joined = keyed.drop("_hot").join(placed, ["pattern", "_year", "_salt"])
    return joined.filter(holds).drop("_year", "_salt", "valid_until")


def judge(pages: DataFrame, entries: DataFrame, page_id: str = "page_id", fetched_on: str = "fetched_on") -> DataFrame:
    """``pages`` with the lists that held its URL when it was fetched.

    Pages with no such entry are found by what is left after adding up per page: each page sends one row of its own,
    so that no second join is needed.
    """
    pages = pages.drop(*RESULT)
    latest = pages.agg(F.max(F.to_date(fetched_on)).alias("latest")).scalar()
    last = F.coalesce(latest, F.date_sub(F.to_date(F.lit(END_OF_TIME)), 1))
    active = stored(intervals(entries), "intervals")
    captures = pages.select(
        F.col(page_id).alias("capture_id"), F.col("url"), F.col(fetched_on).alias("fetched"),
        F.coalesce(F.to_date(fetched_on), last).alias("fetched_on"), patterns_of(F.col("url"), path_depth(active)).alias("patterns"),
    )
    found = as_of_join(captures, active).select("capture_id", "url", "fetched", "list", "pattern", "valid_from")
    nothing = captures.select("capture_id", "url", "fetched", *[
        F.lit(None).cast(t).alias(c) for c, t in (("list", "string"), ("pattern", "string"), ("valid_from", "date"))
    ])
    first = F.min(F.when(F.col("pattern").isNotNull(), F.struct("valid_from", "list", "pattern")))
    per_page = found.unionByName(nothing).groupBy("capture_id", "url", "fetched").agg(
        F.count("pattern").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        first.alias("first"), F.count_if(F.col("pattern").isNull()).alias("times"),
    )
    return per_page.select(
        F.col("capture_id").alias(page_id), "url", F.col("fetched").alias(fetched_on), host_of(F.col("url")).alias("host"),
        F.col("n_active"), "lists", F.col("first.pattern").alias("first_pattern"),
        F.col("first.valid_from").alias("listed_since"), (F.col("n_active") > 0).alias("blocked"), "times",
    ).withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


def _number(key: Column, digits: int) -> Column:
    """A number from the first hex digits of a key's md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, digits), 16, 10).cast("long")


def fetch_dates(pages: DataFrame) -> DataFrame:
    """The table has no fetch times; they are spread over 2024 by the id."""
    day = F.pmod(_number(F.concat(F.lit("fetch:"), F.col("page_id").cast("string")), 8), F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.to_date(F.lit("2024-01-01")), day).alias("fetched_on"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list history from the pages' own hosts: for two thirds of them additions, removals and new additions."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()
    seed = lambda word: _number(F.concat(F.lit(word + ":"), F.col("host")), 8)
    kind = F.pmod(seed("kind"), F.lit(3))
    tail = F.substring_index("host", ".", -3)
    pattern = F.when(kind == 0, F.concat(F.lit("host:"), F.col("host"))).when(kind == 1, F.concat(F.lit("domain:"), tail)).otherwise(
        F.concat(F.lit("path:"), F.col("host"), F.lit("/en"))
    )
    drawn = hosts.filter(F.pmod(seed("listed"), F.lit(3)) != 0)
    drawn = drawn.withColumns({"pattern": pattern, "list": F.concat(F.lit("list"), F.pmod(seed("list"), F.lit(3)).cast("string"))})
    steps = drawn.select("host", "pattern", "list", F.explode(F.array(*map(F.lit, range(4)))).alias("step"))
    gap = _number(F.concat(F.lit("gap:"), F.col("step").cast("string"), F.lit(":"), F.col("host")), 8)
    day = (F.col("step") * 100 + F.pmod(gap, F.lit(90))).cast("int")
    action = F.when(F.col("step") % 2 == 0, "add").otherwise("remove")
    return steps.select("list", "pattern", action.alias("action"), F.date_add(F.to_date(F.lit("2023-12-01")), day).alias("entry_date"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fetch_dates(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judge(pages, derived_entries(pages))


SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (('0x' || substr(md5('fetch:' || page_id), 1, 8))::BIGINT % 366)::INT AS fetched_on,
    nullif(rtrim(lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^(?:.*@)?([^:@]*)', 1)), '.'), '')
      AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg
  FROM pages),
h AS (
  SELECT DISTINCT host, ('0x' || substr(md5('kind:' || host), 1, 8))::BIGINT % 3 AS kind,
    'list' || (('0x' || substr(md5('list:' || host), 1, 8))::BIGINT % 3) AS list FROM p
  WHERE host IS NOT NULL AND ('0x' || substr(md5('listed:' || host), 1, 8))::BIGINT % 3 <> 0),
e AS (
  SELECT DISTINCT list, CASE kind WHEN 0 THEN 'host:' || host WHEN 1 THEN 'domain:' ||
      array_to_string(string_split(host, '.')[-3:], '.') ELSE 'path:' || host || '/en' END AS pattern,
    step % 2 AS gone, DATE '2023-12-01' +
      (step * 100 + ('0x' || substr(md5('gap:' || step || ':' || host), 1, 8))::BIGINT % 90)::INT AS day
  FROM h, (SELECT unnest([0, 1, 2, 3]) AS step)),
d AS (SELECT list, pattern, day, max(gone) AS gone FROM e GROUP BY ALL),
m AS (
  SELECT page_id, pattern FROM (
    SELECT page_id, 'host:' || host AS pattern FROM p WHERE host IS NOT NULL
    UNION ALL SELECT page_id, unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
      lambda i: 'domain:' || array_to_string(string_split(host, '.')[i:], '.'))) FROM p WHERE host IS NOT NULL
    UNION ALL SELECT page_id, unnest(list_transform(range(1, len(seg) + 1),
      lambda i: 'path:' || host || '/' || array_to_string(seg[:i], '/'))) FROM p WHERE host IS NOT NULL)),
s AS (
  SELECT page_id, list, pattern, arg_max(gone, day) AS gone,
    (SELECT min(b.day) FROM d b WHERE b.list = d.list AND b.pattern = d.pattern AND b.gone = 0 AND b.day <= p.fetched_on
      AND NOT EXISTS (SELECT 1 FROM d c WHERE c.list = b.list AND c.pattern = b.pattern AND c.gone = 1 AND c.day > b.day
        AND c.day <= p.fetched_on)) AS since
  FROM p JOIN m USING (page_id) JOIN d USING (pattern) WHERE d.day <= p.fetched_on
  GROUP BY page_id, list, pattern, p.fetched_on, d.list, d.pattern),
a AS (
  SELECT page_id, count(*) AS n_active, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists,
    min({'f': since, 'l': list, 'p': pattern}) AS first FROM s WHERE gone = 0 GROUP BY page_id)
SELECT p.page_id, url, fetched_on, host, coalesce(n_active, 0)::BIGINT AS n_active, coalesce(lists, '') AS lists,
  first.p AS first_pattern, first.f AS listed_since, coalesce(n_active, 0) > 0 AS blocked
FROM p LEFT JOIN a USING (page_id)
"""
