"""Landed bodies of feeds and APIs as candidates: RSS and Atom, releases, model hubs, sitemaps and JSON inside scripts.

Each function takes a table of bodies (source columns and body) and returns rows of the candidate schema's columns. A body that
cannot be read gives no candidates; errors() lists those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

SOURCE_COLUMNS = ["source_name", "source_url", "source_trust", "source_is_primary", "source_type"]

_ITEM = "title string, link string, description string, pubDate string, guid string, source string"
_RSS = f"channel struct<item array<struct<{_ITEM.replace(' string', ':string')}>>>"
_ENTRY = "title:string,summary:string,published:string,updated:string,id:string,link:array<struct<_href:string>>"
_ATOM = f"entry array<struct<{_ENTRY}>>"
#: Entries of a feed, and models of a hub, that a run takes at most by default.
FEED_LIMIT, HUB_LIMIT = 100, 20


def _rfc822(text: Column) -> Column:
    """A feed's date: RFC 822 or ISO 8601; null if it is neither."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT)$", "+0000")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm Z")), T.iso_timestamp(text))


def _limited(rows: DataFrame, limit: Column | int) -> DataFrame:
    """The first entries of each source, in the feed's order."""
    place = F.row_number().over(W.partitionBy("source_name", "source_url").orderBy("position"))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def rss(bodies: DataFrame, limit: int = FEED_LIMIT, publishers: list[str] | None = None) -> DataFrame:
    """Entries of RSS and Atom bodies. With publishers, only theirs count, and the limit holds after that. The date falls back to
    that of the update; a blank title or a single dash becomes New post from the source."""
    parsed = bodies.select(*SOURCE_COLUMNS, F.from_xml("body", _RSS, {"mode": "PERMISSIVE"}).alias("r"), F.from_xml("body", _ATOM, {"mode": "PERMISSIVE"}).alias("a"))
    items = parsed.select(*SOURCE_COLUMNS, F.posexplode("r.channel.item").alias("position", "i")).select(
        *SOURCE_COLUMNS, "position", F.col("i.title").alias("title"), F.col("i.link").alias("url"), F.col("i.description").alias("summary"), F.col("i.pubDate").alias("date"), F.col("i.guid").alias("external_id"), F.col("i.source").alias("publisher")
    )
    entries = parsed.select(*SOURCE_COLUMNS, F.posexplode("a.entry").alias("position", "e")).select(
        *SOURCE_COLUMNS, "position", F.col("e.title").alias("title"), F.try_element_at("e.link", F.lit(1))["_href"].alias("url"), F.col("e.summary").alias("summary"), F.coalesce("e.published", "e.updated").alias("date"), F.col("e.id").alias("external_id"), F.lit(None).cast("string").alias("publisher")
    )
    rows = items.unionByName(entries)
    if publishers:
        rows = rows.where(F.lower(F.trim("publisher")).isin([p.lower() for p in publishers]))
    blank = F.trim(F.coalesce("title", F.lit(""))).isin("", "-")
    rows = rows.where("url is not null")
    return _limited(rows, limit).select(
        *SOURCE_COLUMNS, "position", F.when(blank, F.concat(F.lit("New post from "), F.col("source_name"))).otherwise(F.col("title")).alias("title"), "url", F.coalesce("summary", F.lit("")).alias("summary"), _rfc822(F.col("date")).alias("published_at"), "external_id", F.lit(None).cast("string").alias("exact_model_id")
    )


def releases(bodies: DataFrame) -> DataFrame:
    """Releases of a repository; drafts are left out, pre-releases are named as such in the summary."""
    schema = "array<struct<id:long,name:string,tag_name:string,html_url:string,published_at:string,body:string,draft:boolean,prerelease:boolean>>"
    rows = bodies.select(*SOURCE_COLUMNS, F.posexplode(F.from_json("body", schema)).alias("position", "r")).where(~F.coalesce(F.col("r.draft"), F.lit(False)))
    body = F.coalesce("r.body", F.lit(""))
    return rows.select(
        *SOURCE_COLUMNS, "position", F.coalesce(F.nullif(F.col("r.name"), F.lit("")), "r.tag_name").alias("title"), F.col("r.html_url").alias("url"), F.when(F.coalesce(F.col("r.prerelease"), F.lit(False)), F.concat(F.lit("Pre-release. "), body)).otherwise(body).alias("summary"), T.iso_timestamp(F.col("r.published_at")).alias("published_at"), F.col("r.id").cast("string").alias("external_id"), F.lit(None).cast("string").alias("exact_model_id")
    )


def models(bodies: DataFrame, site: str, limit: int = HUB_LIMIT) -> DataFrame:
    """New model repositories of a hub; rows without id or creation date are left out. The id is the model's identity, whatever
    its later changes."""
    schema = "array<struct<id:string,createdAt:string,lastModified:string,tags:array<string>>>"
    rows = bodies.select(*SOURCE_COLUMNS, F.posexplode(F.from_json("body", schema)).alias("position", "m")).where("m.id is not null and m.createdAt is not null")
    tags = F.array_join(F.slice(F.coalesce("m.tags", F.array().cast("array<string>")), 1, 12), ", ")
    return _limited(rows, limit).select(
        *SOURCE_COLUMNS, "position", F.concat(F.lit("New model repository: "), F.col("m.id")).alias("title"), F.concat(F.lit(site.rstrip("/") + "/"), F.col("m.id")).alias("url"), F.concat(F.lit("Tags: "), tags).alias("summary"), T.iso_timestamp(F.col("m.createdAt")).alias("published_at"), F.col("m.id").alias("external_id"), F.col("m.id").alias("exact_model_id")
    )


def sitemap(bodies: DataFrame, path_pattern: str) -> DataFrame:
    """Pages of a sitemap whose URL fits the pattern; the title is read from the last part of the path."""
    rows = bodies.select(*SOURCE_COLUMNS, F.posexplode(F.from_xml("body", "url array<struct<loc:string,lastmod:string>>")["url"]).alias("position", "u")).where(F.rlike("u.loc", F.lit(path_pattern)))
    slug = F.substring_index(F.regexp_replace(F.col("u.loc"), "/+$", ""), "/", -1)
    title = F.regexp_replace(F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))), r"\bAi\b", "AI")
    return rows.select(
        *SOURCE_COLUMNS, "position", title.alias("title"), F.trim("u.loc").alias("url"), F.concat(F.lit("Article: "), title).alias("summary"), T.iso_timestamp(F.col("u.lastmod")).alias("published_at"), F.col("u.loc").alias("external_id"), F.lit(None).cast("string").alias("exact_model_id")
    )


def script_entries(bodies: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Entries of JSON inside a page's script: one pattern with one group per field (title, slug, date, summary), which are found
    in the same order; shorter lists leave fields null."""
    names = list(patterns)
    found = F.arrays_zip(*[F.regexp_extract_all("body", F.lit(patterns[n]), F.lit(1)).alias(n) for n in names])
    return bodies.select(*SOURCE_COLUMNS, "source_url", F.posexplode(found).alias("position", "x")).select(*SOURCE_COLUMNS, "position", *[F.col("x")[n].alias(n) for n in names])


def last_cards(rows: DataFrame) -> DataFrame:
    """One row per source and URL of a page: the values of the last card, at the place of the first."""
    others = [c for c in rows.columns if c not in ("source_name", "url", "position")]
    g = rows.groupBy("source_name", "url").agg(F.min("position").alias("position"), F.max_by(F.struct(*others), "position").alias("x"))
    return g.select("source_name", "url", "position", "x.*").select(*rows.columns)


def combined(*parts: DataFrame) -> DataFrame:
    """All collectors' candidates; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def errors(bodies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sources that gave no candidates, with why: HTTP_ERROR for another status than 200, else PARSE_ERROR."""
    got = candidates.select("source_name").distinct()
    why = F.when(F.coalesce(F.col("http_status"), F.lit(200)) != 200, "HTTP_ERROR").otherwise("PARSE_ERROR")
    return bodies.join(got, "source_name", "left_anti").select("source_name", "source_url", why.alias("error"))
