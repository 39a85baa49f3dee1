"""URL filters by a temporal list join.

A list is a log of dated entries (list, pattern, action ``add`` or ``remove``,
dated in epoch seconds). Entries become validity intervals: a pattern is on the
list from an ``add`` until the next ``remove``; repeated adds change nothing, and
of entries with one date a remove wins. A pattern is a host or a domain (a last
label alone too); it matches the host and all hosts below it. Every capture is judged by the entries
active when it was fetched.

The as-of join never pairs captures with intervals one by one. Captures are
first reduced to distinct (host, day), those to distinct (pattern, day) with the
patterns of the host's suffixes; intervals join these by pattern with a range
condition and are gathered by (pattern, day), then by (host, day), and a capture
meets only what was active on its day, to the second. So a host, or a domain
with very many hosts, that holds a third of all captures enters the joins once a
day, and (host, day) spreads its captures over as many keys as days.

All work is DataFrame functions.

A capture without host or fetch time matches nothing and is not blocked; such
rows are spread over the join's tasks. Entries without list, pattern or date are
no entries. Repeated captures get a row each. An empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute URL: what follows the last @ of the
    authority, up to the port, without trailing dots, or an address with its
    brackets; null if there is none."""
    place = F.substring_index(F.regexp_extract(url, AUTHORITY, 1), "@", -1)
    host = F.rtrim(F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:\[][^:]*)", 1)), F.lit("."))
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and the domains above it, the last label included; of an address
    in brackets itself alone."""
    labels = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (exclusive; null: still on the list)."""
    dated = (entries.where("list is not null and pattern is not null and dated is not null")
             .groupBy("list", F.lower("pattern").alias("pattern"), "dated")
             .agg(F.bool_and(F.col("action") == "add").alias("added")))
    line = Window.partitionBy("list", "pattern").orderBy("dated")
    changes = dated.withColumn("before", F.lag("added").over(line)).where("before is null or added <> before")
    return changes.withColumn("valid_to", F.lead("dated").over(line)).where("added").select(
        "list", "pattern", F.col("dated").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched_at, lists (those with an active entry, sorted),
    active_since (start of the newest active interval), n_active and blocked, for
    every capture (page_id, url, fetched_at in epoch seconds)."""
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), F.col("fetched_at").cast("long").alias("fetched_at"))
    rows = rows.withColumn("day", F.floor(F.col("fetched_at") / DAY))
    seen = rows.where("host is not null and day is not null").select("host", "day").distinct()
    wanted = seen.select("host", "day", F.explode(suffixes(F.col("host"))).alias("pattern"))
    spans = intervals(entries).withColumnRenamed("pattern", "listed")
    daily = (wanted.select("pattern", "day").distinct()
             .join(spans, (F.col("pattern") == F.col("listed")) & (F.col("valid_from") < (F.col("day") + 1) * DAY)
                   & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("day") * DAY)))
             .groupBy("pattern", "day").agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("spans")))
    by_host = (wanted.join(daily, ["pattern", "day"]).groupBy("host", "day")
               .agg(F.flatten(F.collect_list("spans")).alias("spans")))
    # No host has a space, so rows without a host find nothing and share no key.
    key = F.coalesce("host", F.concat(F.lit(" "), F.xxhash64("page_id", "fetched_at").cast("string")))
    judged = (rows.withColumn("key", key)
              .join(by_host.select(F.col("host").alias("key"), "day", "spans"), ["key", "day"], "left"))
    active = F.filter(F.coalesce("spans", F.array().cast("array<struct<list:string,valid_from:bigint,valid_to:bigint>>")),
                      lambda s: (s["valid_from"] <= F.col("fetched_at")) & (s["valid_to"].isNull() | (s["valid_to"] > F.col("fetched_at"))))
    return judged.withColumn("active", active).select(
        "page_id", "host", "fetched_at",
        F.array_join(F.array_sort(F.array_distinct(F.transform("active", lambda s: s["list"]))), ",").alias("lists"),
        F.array_max(F.transform("active", lambda s: s["valid_from"])).alias("active_since"),
        F.size("active").cast("long").alias("n_active"), (F.size("active") > 0).alias("blocked"))
