"""URL filter lists over time: dated list entries as validity intervals, and captures judged by what was listed at their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
KINDS = ("host", "domain", "url")


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none."""
    h = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(h != "", h)


def page_of(url: Column) -> Column:
    """A URL without its fragment, and without a slash at its end; scheme and host are in lower case, its path stays as it is."""
    page = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", "")
    start = F.regexp_extract(page, "^[^/?]*(?://[^/?]*)?", 0)
    return F.concat(F.lower(start), F.substr(page, F.length(start) + 1))


def listed_intervals(entries: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) in which a list holds an entry.

    entries: list, kind (host: that host; domain: the host and all below it; url: that page), pattern, action (add or
    remove), entry_date. An addition holds until the next entry of the same list, kind and pattern, or for good (valid_to
    null). On one date a removal counts, whatever else is entered. So a list has at most one interval for a pattern at any
    time. Rows with a null, and actions other than these two, are left out; repeated rows count once.
    """
    known = entries.where("list is not null and kind is not null and pattern is not null and entry_date is not null and action in ('add', 'remove')")
    pattern = F.when(F.col("kind") == "url", page_of(F.col("pattern"))).otherwise(F.lower("pattern"))
    daily = known.groupBy("list", "kind", pattern.alias("pattern"), "entry_date").agg(F.max(F.col("action") == "remove").alias("removed"))
    changes = Window.partitionBy("list", "kind", "pattern").orderBy("entry_date")
    return daily.select("*", F.lead("entry_date").over(changes).alias("valid_to")).where("not removed").select(
        "list", "kind", "pattern", F.col("entry_date").alias("valid_from"), "valid_to"
    )


def _keys(url: Column) -> Column:
    """What may be listed about a URL: its host, its host and all parent domains of two or more labels, and its page."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    deep = F.size(labels) >= 2
    starts = F.when(deep, F.sequence(F.lit(1), F.size(labels) - 1))
    domains = F.transform(starts, lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    one = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("pattern")))
    found = F.flatten(F.array_compact(F.array(one("host", host), domains, one("url", page_of(url)))))
    return F.filter(found, lambda k: k["pattern"].isNotNull())


def judge_captures(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """For each capture, the lists that held it when it was fetched.

    captures: page_id, url, fetch_date; intervals: as from listed_intervals(). Every capture's keys meet the intervals by
    equality, and the dates decide (valid_from <= fetch_date < valid_to), so a capture meets at most one interval of each
    list and key. The intervals are broadcast if their counted rows and bytes are few; else the join is shuffled, and Spark's
    adaptive skew join splits the partition of a host that has a third of all captures. Returns page_id, blocked, lists (sorted, joined by commas; null if none) and since (the earliest valid_from that
    holds; null if none). A null url or fetch_date is never blocked; repeated rows are judged each; an empty table gives
    no rows.
    """
    slim = captures.select("page_id", F.col("url").cast("string").alias("url"), "fetch_date")
    found = slim.join(_listed(slim, intervals), ["url", "fetch_date"], "left")
    return found.select("page_id", F.col("lists").isNotNull().alias("blocked"), "lists", "since")


def _listed(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each pair of url and fetch_date that a list held, once, with lists and since. What holds depends on these two columns only, so
    captures of one URL and day are brought together before their keys are made."""
    asked = captures.where("url is not null and fetch_date is not null").select("url", "fetch_date").distinct()
    keyed = asked.select("url", "fetch_date", F.explode(F.array_distinct(_keys(F.col("url")))).alias("k"))
    known = small(saved(intervals, "list-intervals"))
    active = keyed.join(known, (F.col("k.kind") == F.col("kind")) & (F.col("k.pattern") == F.col("pattern")) & (F.col("valid_from") <= F.col("fetch_date")) & (F.col("valid_to").isNull() | (F.col("fetch_date") < F.col("valid_to"))))
    return active.groupBy("url", "fetch_date").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("valid_from").alias("since"))


def allowed(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """captures that no list held when they were fetched; columns as before."""
    slim = captures.select(F.col("url").cast("string").alias("url"), "fetch_date")
    gone = small(saved(_listed(slim, intervals).select(F.col("url").alias("__sf_url"), F.col("fetch_date").alias("__sf_date")), "blocked"))
    same = (captures["url"].cast("string") == gone["__sf_url"]) & (captures["fetch_date"] == gone["__sf_date"])
    return captures.join(gone, same, "left_anti")
