"""URL filters with dated lists: every capture against the list of its time.

List entries are added and removed on dates. An entry is a host (that host alone),
a domain (with all hosts below it) or a path (a host and whole leading path parts,
as host/part/part). Their events become validity intervals, and a capture meets,
for each entry that could apply to it, the last event at or before its fetch time:
an as-of join, done as one sort of captures and intervals together per entry and
time slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Cuts of the captures of one entry and time slice.
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; '' where there is none."""
    authority = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(:[0-9]*|\.)+$", "")


def path_parts(url: Column) -> Column:
    """Parts of the path of a url, without query and fragment; empty parts count
    but for a last one."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path, "/$", ""), "/", -1))


def candidates(host: Column, parts: Column) -> Column:
    """(rank, rule, key) of all entries that could apply: the host, domains from
    the host up to two labels, and paths. Higher ranks are more specific."""
    labels, n = F.split(host, "\\.", -1), F.size(F.split(host, "\\.", -1))
    entry = lambda rank, rule, key: F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), key.alias("key"))
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: entry(0, "domain", F.array_join(F.slice(labels, i, n), "."))
    )
    paths = F.transform(
        F.slice(F.sequence(F.lit(0), F.size(parts)), F.lit(2), F.size(parts)),
        lambda k: entry(2, "path", F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/"))),
    )
    none = F.array().cast("array<struct<rank:int,rule:string,key:string>>")
    return F.when(host == "", none).otherwise(F.concat(domains, F.array(entry(1, "host", host)), paths))


def validity(events: DataFrame) -> DataFrame:
    """key, rule, valid_from, valid_to (exclusive, null while in force) of dated
    events (key, at, action 'add' or 'remove', rule 'host', 'domain' or 'path').

    Each (rule, key) has its own intervals. The last event of an instant counts (a
    removal after an addition); events of unknown action or rule, null key or null
    time are left out; an addition to what is in force starts a new interval."""
    w = Window.partitionBy("rule", "key").orderBy("at")
    clean = events.where("key is not null and at is not null and action in ('add', 'remove') and rule in ('host', 'domain', 'path')")
    return (
        clean.groupBy("rule", "key", "at").agg(F.max("action").alias("action"))
        .withColumn("valid_to", F.lead("at").over(w))
        .where("action = 'add'")
        .select("key", "rule", F.col("at").alias("valid_from"), "valid_to")
    )


def filter_captures(captures: DataFrame, entries: DataFrame, *, slice_seconds: int = 86_400, id_col: str = "page_id") -> DataFrame:
    """Captures (id, url, fetched_at) with host, blocked, matched_key, rule,
    valid_from: the most specific entry in force at fetch time (a path before a
    host before a domain, a longer key before a shorter one).

    Entries with many captures are cut into time slices and these by salt; an
    interval enters each cut that it overlaps, so cuts are joined on their own.
    Null or hostless urls and null fetch times are never blocked; repeated rows
    are judged each; without entries nothing is blocked; extra columns of either
    side are left behind."""
    rows = captures.select(F.col(id_col).alias("id"), "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("host", host_of(F.col("url"))), "url-captures")
    found = F.explode(candidates(F.col("host"), path_parts(F.col("url"))))
    asks = rows.where("fetched_at is not null").select("row", "fetched_at", found.alias("c"))
    slot = F.floor(F.unix_seconds("fetched_at") / slice_seconds)
    asks = asks.select("row", "c.rank", "c.rule", "c.key", "fetched_at", slot.alias("slot"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    # Only cuts with captures matter: entries are given to those they overlap.
    cut = ["rule", "key", "slot", "salt"]
    cuts = asks.groupBy(*cut).agg(F.min("fetched_at").alias("least"), F.max("fetched_at").alias("most"))
    inside = (
        cuts.join(entries, ["rule", "key"])
        .where((F.col("valid_from") <= F.col("most")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("least"))))
        .select(*cut, "valid_from", "valid_to")
    )
    entry = F.struct("valid_from", "valid_to")
    both = asks.select(*cut, F.col("fetched_at").alias("at"), F.lit(1).alias("side"), "row", "rank", F.lit(None).cast("struct<valid_from:timestamp,valid_to:timestamp>").alias("entry")).unionByName(
        inside.select(*cut, F.col("valid_from").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("rank"), entry.alias("entry")))
    order = Window.partitionBy(*cut).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = (
        both.withColumn("e", F.last("entry", ignorenulls=True).over(order))
        .where("side = 1 and e is not null and (e.valid_to is null or at < e.valid_to)")
        .groupBy("row")
        .agg(F.max_by(F.struct("key", "rule", "e.valid_from"), F.struct("rank", F.length("key"))).alias("m"))
    )
    return (
        rows.join(met, "row", "left")
        .select(F.col("id").alias(id_col), "url", "fetched_at", "host", F.col("m").isNotNull().alias("blocked"),
                F.col("m.key").alias("matched_key"), F.col("m.rule").alias("rule"), F.col("m.valid_from").alias("valid_from"))
    )
