import glob
import hashlib
from datetime import date

import pytest

from signalflow.llm import url_filters, warc

INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 12\r\n\r\nhello world!\r\n\r\n"


def pages():
    rows = [(i, f"http://h/{i}", f"<p>é {i % 7}</p>" * (i % 90)) for i in range(200)]
    return rows + [
        (1000, "u v\r\nx", "before " + INNER * 3 + " after"), (1001, None, "WARC/1.1\r\n"), (1002, "http://x", None), (1003, "http://x", ""), (1004, "a", INNER),
        (1005, "b", "x" * 5000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 999999999\r\n\r\n" + "y" * 3000), (None, "c", "z" * 2000), (1007, "c", "z" * 2000), (1007, "d", "z" * 2000),
        (1008, "c", "\r\n\r\n" + INNER + "\r\n\r\nWARC/1.1\r\n"), (1009, "d", "plain"), (1010, "e", "z" * 999), (1011, "e", "z" * 999),
    ]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    frame = spark.createDataFrame([(*r, 1, "x") for r in pages()], "page_id long, url string, html string, payload_bytes int, record_type string").coalesce(2)
    path = f"file://{tmp_path_factory.mktemp('warc')}/a"
    warc.write_warc(frame, path)
    return path


def wanted():
    groups = {}
    for i, _, h in pages():
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in pages():
        body = (h or "").encode()
        top = max(x for x in groups[h or ""] if x is not None)
        revisit = len(body) >= 1000 and i != top
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "9k"])
def test_round_trip_over_splits(spark, archive, split):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = warc.read_warc(spark, archive)
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(records).collect()), key=str)
        assert got == wanted()
        assert all(r.payload.decode() in {h or "" for _, _, h in pages()} for r in records.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_splits_may_change_between_reads(spark, tmp_path):
    """Executors come and go: what was read once keeps its places when the files would be split otherwise later."""
    names = ("spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism")
    before = {k: spark.conf.get(k, None) for k in names}
    rows = [(i, f"http://h/{i}", f"page {i} " + (INNER + "x" * (i % 50)) * (i % 6)) for i in range(300)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    try:
        spark.conf.set(names[0], "1")
        spark.conf.set(names[1], "8")
        records = warc.page_records(warc.read_warc(spark, f"file://{tmp_path}/w"))
        spark.conf.set(names[1], "2")
        got = {r.page_id: r.payload_digest for r in records.collect()}
        assert records.count() == 300 and got == {i: hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_cut_and_foreign_files(spark, archive, tmp_path):
    data = open(sorted(glob.glob(archive[7:] + "/part*"))[0], "rb").read()
    (tmp_path / "cut.warc").write_bytes(data[:-10])
    (tmp_path / "foreign.warc").write_bytes(b"junk" + data[:4000])
    (tmp_path / "none.warc").write_bytes(b"")
    whole = warc.read_warc(spark, archive).count()
    other = sum(1 for p in glob.glob(archive[7:] + "/part*") if open(p, "rb").read() != data)
    n = warc.read_warc(spark, f"file://{tmp_path}").count()
    assert other == 1 and 0 < n < whole


def test_records_of_another_writer(spark):
    kind = "file string, headers map<string,string>, http_headers map<string,string>, payload binary"
    headers = [{"warc-type": "response", "x-page-id": "p1"}, {"warc-type": "revisit", "x-page-id": "7", "x-refers-to-page-id": "none", "warc-payload-digest": "sha1:ab"}, {"warc-type": "warcinfo"}, {}]
    frame = spark.createDataFrame([("f", h, {"content-length": "12 bytes"}, bytearray(b"abc")) for h in headers] + [("f", None, None, None)], kind)
    got = [tuple(r) for r in warc.page_records(frame).collect()]
    sha = hashlib.sha1(b"abc").hexdigest()
    assert got == [(None, 3, sha, "response", None), (7, None, "ab", "revisit", None), (None, None, None, "warcinfo", None), (None, None, None, None, None), (None, None, None, None, None)]


def test_empty_table(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_temporal_lists(spark):
    d = date
    entries = spark.createDataFrame(
        [
            ("a", "host", "X.com", "add", d(2024, 1, 1)), ("a", "host", "x.com", "remove", d(2024, 2, 1)), ("a", "host", "x.com", "add", d(2024, 3, 1)),
            ("b", "domain", "x.com", "add", d(2024, 1, 15)), ("c", "url", "http://y.org/p", "add", d(2024, 1, 1)), ("c", "url", "http://y.org/p", "remove", d(2024, 1, 1)),
            ("c", "url", "http://y.org/q", "add", d(2024, 1, 1)), ("c", "url", "http://y.org/q", "add", d(2024, 1, 1)), (None, "host", "z", "add", d(2024, 1, 1)),
        ],
        "list string, kind string, pattern string, action string, entry_date date",
    )
    caps = [
        (1, "http://x.com/a", d(2024, 1, 1)), (2, "https://X.COM:80/b", d(2024, 2, 1)), (3, "http://u@x.com", d(2024, 3, 1)), (4, "http://m.x.com/", d(2024, 1, 14)), (5, "http://m.x.com/", d(2024, 1, 15)),
        (6, "http://y.org/p/#f", d(2024, 5, 1)), (7, "HTTP://Y.org/q", d(2024, 5, 1)), (6, "http://y.org/Q", d(2024, 5, 1)), (7, "http://y.org/q/#f", d(2024, 5, 1)), (8, None, d(2024, 1, 1)), (9, "http://x.com", None), (10, "not a url", d(2024, 1, 1)), (7, "http://y.org/other", d(2024, 5, 1)), (None, "http://x.com/a", d(2024, 1, 2)),
    ]
    frame = spark.createDataFrame([(*c, True, "k") for c in caps], "page_id int, url string, fetch_date date, blocked boolean, row string")
    iv = url_filters.listed_intervals(entries)
    got = sorted(((r.page_id, r.lists) for r in url_filters.judge_captures(frame, iv).collect()), key=str)
    want = [(1, "a"), (2, "b"), (3, "a,b"), (4, None), (5, "b"), (6, None), (7, "c"), (7, "c"), (6, None), (8, None), (9, None), (10, None), (7, None), (None, "a")]
    assert got == sorted(want, key=str)
    kept = url_filters.allowed(frame, iv)
    assert kept.columns == frame.columns and sorted(r.url for r in kept.where("page_id = 7").collect()) == ["http://y.org/other"]
    assert url_filters.judge_captures(frame.limit(0), iv).count() == 0 and url_filters.judge_captures(frame, iv.limit(0)).where("blocked").count() == 0
