"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space, perhaps a scheme, two slashes, perhaps a user, then a bracketed address or the host up to a port, path, query or fragment.
HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
#: Addresses, which have no parent domains.
ADDRESS = r"^\[|^[0-9]+(\.[0-9]+){3}$"


def host_of(url: Column) -> Column:
    """The host in lower case without the dots or white space at its end, null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"[.\s]+$", "")
    return F.when(host != "", host)


def validity(entries: DataFrame) -> DataFrame:
    """list, kind, key, valid_from, valid_to of the spans in which each entry holds.

    entries: list, kind (block or allow), key (a host or a domain), action (add
    or remove), at (timestamp). An entry holds from an add until the next
    change of the same (list, key), exclusive, or for good. Of changes at one
    time the last action by name counts (remove beats add). Entries without a
    list, key or time never hold. History of one key is short: one row a change.
    """
    rows = entries.dropna(subset=["list", "key", "at"]).groupBy("list", "key", "at").agg(F.max("action").alias("action"), F.max("kind").alias("kind"))
    later = F.lead("at").over(Window.partitionBy("list", "key").orderBy("at"))
    return rows.withColumn("valid_to", later).filter("action = 'add'").select("list", "kind", "key", F.col("at").alias("valid_from"), "valid_to")


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels at least, with their number of labels; of an address itself alone."""
    labels = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.split(host, r"\."))
    n = F.size(labels)
    starts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array(F.lit(1)))
    return F.transform(starts, lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).alias("labels")))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Judges every capture by the entries that were active when it was fetched.

    captures: page_id, url, fetched. Of the active entries for its host or a
    parent domain, the most specific decide; allow beats block among equals.
    Captures without a host or a fetch time match nothing and are kept; rows
    of one page_id and fetch time are judged once, together.

    A capture meets the short history of its own keys only; keys are joined by
    equality, so Spark can split a host with many captures and broadcasts the
    intervals only when their measured size is small.

    Returns page_id, fetched, host, n_active, lists (names joined by a comma),
    decision (keep, allow or block).
    """
    spans = validity(entries)
    rows = captures.select("page_id", "fetched", host_of(F.col("url")).alias("host"))
    keys = rows.select("page_id", "fetched", "host", F.explode_outer(suffixes(F.col("host"))).alias("s")).select("page_id", "fetched", "host", "s.key", "s.labels")
    active = (keys["key"] == spans["key"]) & (spans["valid_from"] <= keys["fetched"]) & (spans["valid_to"].isNull() | (keys["fetched"] < spans["valid_to"]))
    met = keys.join(spans, active, "left").select("page_id", "fetched", "host", "labels", "list", "kind", keys["key"])
    out = met.groupBy("page_id", "fetched", "host").agg(
        # entries, however often the capture comes; they are few for one capture
        F.size(F.collect_set(F.when(F.col("list").isNotNull(), F.struct("list", "key")))).cast("long").alias("n_active"),
        F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
        # most labels first, then allow before block: the greatest of (labels, kind = allow)
        F.max(F.when(F.col("list").isNotNull(), F.struct("labels", (F.col("kind") == "allow").alias("allow")))).alias("top"),
    )
    decision = F.when(F.col("top").isNull(), "keep").when(F.col("top.allow"), "allow").otherwise("block")
    return out.select("page_id", "fetched", "host", "n_active", "lists", decision.alias("decision"))
