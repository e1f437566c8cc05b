"""WARC archives: writing pages with revisit records, and reading large files in parallel.

Files are written and read by Spark's text source (with its own record separators), so they may lie in any store that
Spark reaches, writes are committed by Spark, and one file is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, small, small_batches

MAGIC, RECORD_END = "WARC/1.1\r\n", "\r\n\r\n"
#: Payloads of fewer bytes are always stored whole.
REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header_value(value: Column) -> Column:
    """A value that fits on a header line: control characters and spaces are percent-encoded as %20."""
    return F.regexp_replace(value.cast("string"), r"[\x00-\x20\x7F]", "%20")


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_revisits(pages: DataFrame, payload: str = "html", min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url and payload of pages with payload_bytes, payload_digest (hex SHA-1), record_type and refers_to.

    Of pages with equal payloads of at least min_bytes bytes, the one with the largest page_id is the response and the
    others revisit it. Payloads are equal if their SHA-256 and sizes are. Null payloads are empty. A null page_id revisits the response, and is a response where every id is
    null; rows that repeat the largest page_id are all responses. Only digests that occur more than once are joined back.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    size = F.octet_length(body).cast("long")
    same = F.when(size >= min_bytes, F.unhex(F.sha2(body, 256))).alias("_same")
    known = pages.select("page_id", "url", payload, size.alias("payload_bytes"), F.sha1(body).alias("payload_digest"), same)
    groups = known.where("_same is not null").groupBy("_same", "payload_bytes").agg(F.max("page_id").alias("_kept"), F.count("*").alias("_n"))
    several = small(saved(groups.where("_n > 1").drop("_n"), "warc-groups"))
    typed = known.join(several, ["_same", "payload_bytes"], "left")
    revisit = F.col("_kept").isNotNull() & F.coalesce(F.col("page_id") != F.col("_kept"), F.lit(True))
    return typed.select(
        "page_id",
        "url",
        payload,
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_kept")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, path: str, payload: str = "html", date: str = "2024-01-31T00:00:00Z", min_bytes: int = REVISIT_BYTES) -> None:
    """Write one WARC record per page (page_id, url, payload) under path, a file for each task.

    A response holds the HTTP header and the payload, a revisit the HTTP header only. Null url: no WARC-Target-URI. The
    page's id travels in a header of its own. An empty table writes no records. Other columns are ignored.
    """
    slim = pages.select("page_id", "url", payload)
    known = with_revisits(slim, payload, min_bytes)
    response = F.col("record_type") == "response"
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(response, F.concat(http, body)).otherwise(http)
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _header_value(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(~response, F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To", F.when(~response, _record_id(F.col("refers_to"), F.col("payload_digest")))),
        line("X-Page-Id", _header_value(F.col("page_id"))),
        line("X-Refers-To-Page-Id", _header_value(F.col("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )
    known.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


def _header(segment: Column) -> Column:
    """What stands before the first blank line after a magic, null where there is none; and the content length it gives."""
    header = F.substring_index(segment, "\r\n\r\n", 1)
    return F.when(F.octet_length(header) < F.octet_length(segment), header)


def _content_length(header: Column) -> Column:
    """The first content length in a header, null if there is none or it is no number."""
    value = F.trim(F.regexp_extract(header, r"(?id)(?:^|\n)[ \t]*content-length[ \t]*:([^\r\n]*)", 1))
    return F.when(value.rlike(r"^[0-9]{1,17}$"), value).cast("long")


def _read_segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics: file, block (where its split begins), at (grows along a block), value.

    Saved once: all that follows reads this table, so places stay the same however the files would be split another time."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    slim = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return saved(slim, "warc-segments", compression="zstd")


def boundaries(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate records (file, block, at, start, next, end) of segments as from _read_segments(), and those segments that are no
    simple record: (at, file, start, owner), owner being the start of the record they belong to, null where they belong to none.

    For every magic, tasks emit where the record that starts there would end by its own header. Nearly always that is the next
    magic; the others are the breaks of a file. From a break, the next one that counts is the first at or after the end it
    names, and jumps along these pointers, doubled in length each round, mark the breaks that can be reached from the start of
    the file. Magics strictly inside a reached break's record are payload. After a record that ends nowhere (a cut file)
    nothing is reached. Places come from the bytes of each block and of the blocks before it, so that no task gets more than
    a block, or a file's breaks.
    """
    d = len(MAGIC)
    header = _header(F.col("value"))
    total = d + F.octet_length(header) + 4 + _content_length(header) + len(RECORD_END)
    raw = saved(segments.select("file", "block", "at", F.octet_length("value").cast("long").alias("size"), total.cast("long").alias("total")), "warc-places")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file", "block").agg(F.sum(F.col("size") + d).alias("bytes"))
    blocks = saved(
        blocks.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"), (F.sum("bytes").over(Window.partitionBy("file")) - d).alias("eof")), "warc-blocks"
    )
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = raw.select("*", F.coalesce(F.sum(F.col("size") + d).over(inside), F.lit(0)).alias("before"))
    placed = before.join(small(blocks), ["file", "block"]).withColumn("start", F.col("base") + F.col("before") - d)
    spots = saved(placed.select("file", "block", "at", "start", (F.col("start") + F.col("size") + d).alias("next"), (F.col("start") + F.col("total")).alias("end"), "eof"), "warc-spots")
    # What stands before the first magic starts at -d and is no candidate.
    candidates = spots.where("start >= 0")
    breaks = candidates.where("end is null or end <> next").select("file", "start", F.coalesce("end", "eof").alias("end"), "eof", F.col("end").isNotNull().alias("sized"))
    breaks = saved(breaks, "warc-breaks")
    landed = candidates.select("file", F.col("start").alias("end")).join(small(breaks.select("file", "end").distinct()), ["file", "end"], "left_semi").withColumn("lands", F.lit(True))
    breaks = saved(breaks.join(landed, ["file", "end"], "left").select("file", "start", "end", (F.coalesce("lands", F.lit(False)) | ((F.col("end") == F.col("eof")) & F.col("sized"))).alias("lands")), "warc-breaks")
    starts = candidates.groupBy("file").agg(F.min("start").alias("start"))
    targets = breaks.where("lands").select("file", F.col("end").alias("at"), F.col("start").alias("of"), F.lit(0).alias("kind"))
    begin = starts.where("start = 0").select("file", F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("of"), F.lit(0).alias("kind"))
    marks = targets.unionByName(begin).unionByName(breaks.select("file", F.col("start").alias("at"), F.lit(None).cast("long").alias("of"), F.lit(1).alias("kind")))
    ahead = Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    jumps = saved(
        marks.select("*", F.min(F.when(F.col("kind") == 1, F.col("at"))).over(ahead).alias("to")).where("kind = 0 and to is not null").select("file", "of", "to"), "warc-jumps"
    )
    reached = jumps.where("of = -1").select("file", F.col("to").alias("start"))
    reached, count = saved(reached, "warc-reached"), -1
    while (now := reached.count()) != count:
        count = now
        further = reached.join(jumps.select("file", F.col("of").alias("start"), "to"), ["file", "start"]).select("file", F.col("to").alias("start"))
        reached = saved(reached.unionByName(further).distinct(), "warc-reached")
        first, second = jumps.alias("a"), jumps.alias("b")
        doubled = first.join(second, (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.of"))).select("a.file", "a.of", "b.to")
        jumps = saved(doubled, "warc-jumps")
    owners = small(saved(breaks.join(reached, ["file", "start"], "left_semi").select("file", "start", F.struct(F.col("start").alias("at"), "end", "lands").alias("own")), "warc-owners"))
    # A candidate belongs to the last reached break at or before it, if that one's record ends after it; where that lands
    # nowhere, all to the end of the file does. Within a block the last one is looked up, and each block brings its last one on.
    whole_bad = starts.where("start > 0").select("file", F.lit(True).alias("bad"))
    tagged = saved(candidates.select("file", "block", "at", "start").join(owners, ["file", "start"], "left"), "warc-tagged")
    per_block = tagged.groupBy("file", "block").agg(F.max("own").alias("own"))
    carried = per_block.select("file", "block", F.max("own").over(earlier).alias("carried"))
    upto = Window.partitionBy("file", "block").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = tagged.select("file", "block", "at", "start", F.max("own").over(upto).alias("last")).join(carried, ["file", "block"]).join(whole_bad, "file", "left")
    covered = covered.withColumn("own", F.coalesce("last", "carried"))
    held = F.coalesce((F.col("start") < F.col("own.end")) | ~F.col("own.lands"), F.lit(False)) | F.coalesce("bad", F.lit(False))
    odd = covered.where(held).select("at", "file", "start", F.when(F.col("own.lands") & F.col("bad").isNull(), F.col("own.at")).alias("owner"))
    lead_in = spots.where("start < 0").select("at", "file", "start", F.lit(None).cast("long").alias("owner"))
    return candidates, saved(odd.unionByName(lead_in), "warc-odd")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "headers", "http_headers", "payload"]
    types = [pa.string(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string()), pa.binary()]

    def fields(head: bytes) -> list[tuple[str, str]]:
        out: dict[str, str] = {}
        for line in head.split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if colon:
                out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
        return list(out.items())

    for batch in batches:
        rows = []
        for file, length, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            head, _, rest = value.partition(b"\r\n\r\n")
            block = rest[:length]
            headers = fields(head)
            http, payload = [], block
            if dict(headers).get("content-type", "").startswith("application/http"):
                head, _, payload = block.partition(b"\r\n\r\n")
                http = fields(head)
            rows.append((file, headers, http, payload))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files under path: file, headers and http_headers (maps, names in lower case) and payload.

    Boundaries are verified as in boundaries(): a payload that holds the magic, or whole WARC records, is never cut, and a
    truncated last record is left out. Files may be larger than a task's share, and are read once. Files without records give
    no rows.
    """
    small_batches(spark)
    segments = _read_segments(spark, path)
    _, odd = boundaries(segments)
    plain = segments.join(small(odd.select("at")), "at", "left_anti").select("file", "value")
    parts = segments.select("at", "value").join(small(odd.where("owner is not null")), "at").select("file", "owner", "start", "value")
    joined = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
    whole = joined.select("file", F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value"))
    rows = plain.unionByName(whole).select("file", _content_length(_header(F.col("value"))).alias("length"), F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(_parsed, "file string, headers map<string,string>, http_headers map<string,string>, payload binary")


def page_records(records: DataFrame) -> DataFrame:
    """Pages from records of read_warc(): page_id, payload_bytes, payload_digest (bare hex SHA-1), record_type, refers_to.

    Of a response, size and digest are those of the payload that was read; of a revisit, those its headers give for the
    payload that it refers to. Records of another writer may lack these headers or
    have other text in them: what is missing or no number is null.
    """
    header, response = F.col("headers"), F.col("headers")["warc-type"] == "response"
    return records.select(
        header["x-page-id"].try_cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_headers")["content-length"].try_cast("long")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring_index(header["warc-payload-digest"], ":", -1)).alias("payload_digest"),
        header["warc-type"].alias("record_type"),
        header["x-refers-to-page-id"].try_cast("long").alias("refers_to"),
    )
