"""URL filters by a temporal list join.

A list is a stream of dated entries (pattern kind, pattern, action, day). Per pattern the
last entry of a day holds from that day until the next day with an entry: a validity
interval. "block" and "allow" decide, "remove" lifts the pattern. Every capture
is judged by the most specific pattern with an entry active on its fetch day: URL
prefix (host and first path segment), then host, then the longest parent domain.

The as-of join works on distinct (pattern, day) pairs, so its groups are bounded by the
number of days, not by the number of captures or entries of a hot host; captures then
meet the verdict of their (host, prefix, day) in an equi-join.

A null or unparsable URL, or a null fetch day, has verdict "none". Entries with a null
pattern or day never hold; repeated rows change nothing among entries and each get a row
among captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ["domain", "host", "prefix"]


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty if there is none."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), r"\.$", "")


def segment_of(url: Column) -> Column:
    """First path segment with its slash; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, valid_from, valid_to, action, entry_id) from (kind, pattern, day, action, entry_id).

    Of a pattern's entries of one day the highest entry_id counts; valid_to is exclusive, null if open.
    """
    daily = (entries.where("pattern is not null and day is not null")
             .groupBy("kind", "pattern", "day").agg(F.max(F.struct("entry_id", "action")).alias("e")))
    after = F.lead("day").over(Window.partitionBy("kind", "pattern").orderBy("day"))
    return daily.select("kind", "pattern", F.col("day").alias("valid_from"), after.alias("valid_to"),
                        F.col("e.action").alias("action"), F.col("e.entry_id").alias("entry_id"))


def _parents(host: Column) -> Column:
    """The host and its parents of at least two labels, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(
        F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (page_id, url, day) with host, verdict, kind, pattern, entry_id, valid_from, valid_to.

    A prefix entry is a host with its first path segment; one with more segments holds for no capture.
    """
    cap = captures.select("page_id", "url", "day", host_of(F.col("url")).alias("host"),
                          segment_of(F.col("url")).alias("segment"))
    keys = cap.where("day is not null and host <> ''").select("host", "segment", "day").distinct()
    wanted = F.concat(
        F.transform(_parents(F.col("host")), lambda p: F.struct(
            F.lit("domain").alias("kind"), p.alias("pattern"), F.length(p).alias("rank"))),
        F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern"), F.lit(1_000_000).alias("rank")),
                F.struct(F.lit("prefix").alias("kind"), F.concat("host", "segment").alias("pattern"),
                         F.lit(2_000_000).alias("rank"))))
    probes = keys.select("host", "segment", "day", F.explode(wanted).alias("w")).select(
        "host", "segment", "day", "w.kind", "w.pattern", "w.rank")
    held = intervals(entries)
    # As-of: entries and probes of a pattern side by side in day order; the last entry seen holds.
    points = probes.select("kind", "pattern", "day").distinct()
    line = (held.select("kind", "pattern", F.col("valid_from").alias("day"), F.lit(0).alias("probe"),
                        F.struct("action", "entry_id", "valid_from", "valid_to").alias("e"))
            .unionByName(points.select("kind", "pattern", "day", F.lit(1).alias("probe"),
                                       F.lit(None).cast("struct<action:string,entry_id:bigint,valid_from:date,valid_to:date>").alias("e"))))
    w = Window.partitionBy("kind", "pattern").orderBy("day", "probe").rowsBetween(Window.unboundedPreceding, 0)
    active = (line.withColumn("held", F.last("e", ignorenulls=True).over(w))
              .where("probe = 1 and held.action in ('block', 'allow')").select("kind", "pattern", "day", "held"))
    best = (probes.join(active, ["kind", "pattern", "day"])
            .groupBy("host", "segment", "day")
            .agg(F.max(F.struct("rank", "kind", "pattern", "held")).alias("b")))
    return cap.join(best, ["host", "segment", "day"], "left").select(
        "page_id", "url", "day", "host", F.coalesce("b.held.action", F.lit("none")).alias("verdict"),
        F.col("b.kind").alias("kind"), F.col("b.pattern").alias("pattern"),
        F.col("b.held.entry_id").alias("entry_id"), F.col("b.held.valid_from").alias("valid_from"),
        F.col("b.held.valid_to").alias("valid_to"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures with a fetch day from the page number, for tables that carry none."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 7919) % 366).cast("int"))
    return pages.select("page_id", "url", day.alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A list derived from all pages: page i reports its URL's parent domain, host or prefix on a day of its own."""
    p = F.col("page_id")
    src = pages.select("page_id", host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment"))
    parent = F.regexp_replace("host", r"^[^.]*\.(?=[^.]*\.)", "")
    kind = F.when(p % 16 == 0, "domain").when(p % 4 == 1, "host").otherwise("prefix")
    pattern = F.when(kind == "domain", parent).when(kind == "host", F.col("host")).otherwise(F.concat("host", "segment"))
    action = F.when(p % 5 < 2, "block").when(p % 5 < 4, "allow").otherwise("remove")
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((p * 104729) % 366).cast("int"))
    return src.where("host <> ''").select(kind.alias("kind"), pattern.alias("pattern"), day.alias("day"),
                                          action.alias("action"), p.cast("long").alias("entry_id"))


ORACLE = r"""
WITH p AS (SELECT page_id, url,
    regexp_replace(lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')), '\.$', '') AS host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)', 1), '') AS segment FROM pages),
c AS (SELECT *, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS day FROM p),
e0 AS (SELECT CASE WHEN page_id % 16 = 0 THEN 'domain' WHEN page_id % 4 = 1 THEN 'host' ELSE 'prefix' END AS kind, *,
    CASE WHEN page_id % 5 < 2 THEN 'block' WHEN page_id % 5 < 4 THEN 'allow' ELSE 'remove' END AS action,
    DATE '2024-01-01' + CAST((page_id * 104729) % 366 AS INTEGER) AS day FROM p WHERE host <> ''),
e1 AS (SELECT kind, CASE kind WHEN 'domain' THEN CASE WHEN len(string_split(host, '.')) > 2 THEN substr(host, strpos(host, '.') + 1) ELSE host END
    WHEN 'host' THEN host ELSE host || segment END AS pattern, day, action, page_id AS entry_id FROM e0),
e2 AS (SELECT kind, pattern, day, max(entry_id) AS entry_id, max_by(action, entry_id) AS action FROM e1 GROUP BY ALL),
v AS (SELECT *, lead(day) OVER (PARTITION BY kind, pattern ORDER BY day) AS until FROM e2),
w AS (
  SELECT page_id, c.day, v.*, CASE v.kind WHEN 'prefix' THEN 2000000 WHEN 'host' THEN 1000000 ELSE length(v.pattern) END AS rank
  FROM c JOIN v ON c.day >= v.day AND (v.until IS NULL OR c.day < v.until) AND v.action <> 'remove' AND c.host <> ''
    AND CASE v.kind WHEN 'prefix' THEN v.pattern = c.host || c.segment WHEN 'host' THEN v.pattern = c.host
      ELSE (c.host = v.pattern OR ends_with(c.host, '.' || v.pattern)) AND contains(v.pattern, '.') END),
b AS (SELECT page_id, kind, pattern, action, entry_id, day_1 AS valid_from, until AS valid_to FROM w
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank DESC) = 1)
SELECT c.page_id, c.url, c.day::VARCHAR AS day, c.host, coalesce(action, 'none') AS verdict, kind, pattern, entry_id, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to
FROM c LEFT JOIN b USING (page_id)
"""
