"""URL filters: an as-of join of captures with dated list entries, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def plain_host(host: Column) -> Column:
    """Lower case without final dots."""
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dots; empty text if there is none.

    The user ends at the last ``@`` before the path. An IPv6 address keeps its brackets.
    """
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    own = F.regexp_replace(place, "^.*@", "")
    return plain_host(F.regexp_extract(own, r"^(\[[^\]]*\]|[^:]*)", 1))


def is_address(host: Column) -> Column:
    """IPv4 and IPv6 addresses, which are no names with domains above them."""
    return F.startswith(host, F.lit("[")) | F.rlike(host, F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def lookup_keys(url: Column) -> Column:
    """Keys that entries for this URL can have.

    The host and the domains above it down to two labels (``a.b.com``, ``b.com``), of an address
    itself alone, and the host with each beginning of its path that ends at a slash or at the
    path's end.
    """
    host = host_of(url)
    labels = F.when(is_address(host), F.array(host)).otherwise(F.split(host, r"\."))
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, n), "."),
    )
    parts = F.split(path_of(url), "/")
    depth = F.size(parts)
    paths = F.transform(
        F.sequence(F.lit(2), F.greatest(depth, F.lit(2))),
        lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.when(i < depth, F.lit("/")).otherwise(F.lit(""))),
    )
    keys = F.concat(domains, F.when(depth > 1, paths).otherwise(F.array().cast("array<string>")))
    return F.when(host != "", F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of dated entries ``list, key, action, dated``.

    An ``add`` holds from its date until the day of the key's next entry in that list, or for
    ever. Of several entries on one day the removal wins. Entries with a null or another action are
    left out. Keys are compared in lower case and without final dots up to the path.
    """
    day = entries.where("list is not null and key is not null and dated is not null and action in ('add', 'remove')")
    host = F.regexp_extract("key", "^[^/]*", 0)
    day = day.withColumn("key", F.concat(plain_host(host), F.substr("key", F.length(host) + 1)))
    day = day.groupBy("list", "key", "dated").agg(F.max("action").alias("action"))
    following = F.lead("dated").over(W.partitionBy("list", "key").orderBy("dated"))
    spans = day.withColumn("until", F.coalesce(following, F.lit(FOREVER).cast("date")))
    return spans.where("action = 'add'").select("list", "key", F.col("dated").alias("since"), "until")


def matches(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Each list entry active for a capture at its time: ``capture_id, list, key, since``.

    Keys and times meet the intervals once each, however many captures share them; the time is part
    of the join's condition, so that at most one interval of a list and key leaves the join. Captures
    then find their key and time, so that a hot host is spread over its times.
    """
    keyed = captures.select("capture_id", "fetched", F.explode(lookup_keys(F.col("url"))).alias("key"))
    asked, spans = keyed.select("key", "fetched").distinct(), intervals(entries)
    active = (asked["key"] == spans["key"]) & (asked["fetched"] >= spans["since"]) & (asked["fetched"] < spans["until"])
    valid = asked.join(spans, active).select(asked["key"], "fetched", "list", "since")
    return keyed.join(valid, ["key", "fetched"]).select("capture_id", "list", "key", "since")


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture (``capture_id, url, fetched``) against the entries active at its time.

    Returns ``capture_id, url, fetched, host, blocked, n_matches, lists, reason``: the lists in
    order, joined by a comma, and the longest matching key (ties to the smaller). A capture with
    a null or hostless URL or without time matches nothing and is not blocked. Captures of the
    same id share their matches; a null id has none. Empty tables give empty tables; without
    entries nothing is blocked. Other columns are not read.
    """
    captures = captures.select("capture_id", "url", "fetched")
    found = matches(captures, entries).groupBy("capture_id").agg(
        F.count_distinct("list", "key").alias("n_matches"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.min(F.struct(-F.length("key"), F.col("key")))["key"].alias("reason"),
    )
    return captures.join(found, "capture_id", "left").select(
        "capture_id", "url", "fetched",
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.col("n_matches").isNotNull().alias("blocked"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )
