import html
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from signalflow.functions import scoring as S
from signalflow.functions import text as T


def values(spark, column, items, kind="string"):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def python_canonical(url):
    p = urlsplit(url.strip())
    q = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in T.TRACKING_PARAMS)]
    return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/") or "/", urlencode(q), ""))


def test_canonical_urls(spark):
    urls = [
        "https://Example.COM/a/b/?utm_source=x&ref=1&b=2#top", "http://h.org", "http://h.org/", "http://h.org//a//", "HTTP://h/p?x=a+b&y=%C3%A9&z=~*&", "http://h/p?a&b=&c=1",
        "http://h?q=1", "ftp://h/x", "http://h/p?UTM_Medium=1&Source=2&k=%zz", " http://h/p#a?b=c ", "https://user@h:80/p?next=http://x/y?z",
    ]
    assert values(spark, T.canonical_url, urls) == [python_canonical(u) for u in urls]
    assert values(spark, T.canonical_url, [None]) == [None]
    assert values(spark, lambda c: T.canonical_url(c, keep_fragment=True), ["http://h/p/?ref=1#v2"]) == ["http://h/p#v2"]


def test_titles_and_summaries(spark):
    titles = ["Tool-Calling &amp; more!", "  ÄÖ_ß  9.5 ", "<b>x</b>", "", None, "a b\n\tc", "naïve—test"]
    want = [None if t is None else " ".join(re.sub(r"[^\w\s]", " ", html.unescape(t).lower()).split()) for t in titles]
    assert values(spark, T.normalized_title, titles) == want
    assert values(spark, T.clean_summary, ["&lt;p&gt;a &amp; b&lt;/p&gt; <i>c</i>"]) == ["a & b c"]
    assert values(spark, T.first_sentence, ["One two.  Three", "No stop here", "- x : y! z", "a" * 200]) == ["One two.", "No stop here", "x : y!", "a" * 180]


def test_dates(spark):
    got = values(spark, lambda c: F.date_format(T.parsed_date(c), "yyyy-MM-dd"), ["January 5, 2024", "Jan 5 2024", "5 March 2024", "5 Mar 2024", "2024-03-05", "soon", None])
    assert got == ["2024-01-05", "2024-01-05", "2024-03-05", "2024-03-05", "2024-03-05", None, None]
    assert values(spark, lambda c: F.date_format(T.iso_timestamp(c), "yyyy-MM-dd HH:mm"), ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "x"]) == ["2024-01-02 03:04", "2024-01-02 01:04", None]


def test_model_identity(spark):
    names = ["Qwen/Qwen3.5-35B-A3B", "Qwen3.5 35B A3B FP8", "New model repository: zai/GLM-5-Chat", "Command R+ 104B", "command_a vision", "Commander R", "DeepSeek V3", "deepseek-3 Base", None]
    assert values(spark, T.model_identity, names) == ["qwen-3.5-35b-a3b", "qwen-3.5-35b-a3b", "glm-5-chat", "command-r+-104b", "command-a-vision", None, None, "deepseek-3-base", None]


def test_anchors(spark):
    assert values(spark, T.anchor, ["Lab/Model_X 1.5", " a--b+ ", "x/y/Z!"]) == ["model-x-1-5", "a-b+", "z"]
    assert values(spark, T.identifiers, ["GPT-4 and gpt-4o, DeepSeek-V3 or chatgpt Pro"]) == [["gpt-4", "gpt-4o", "deepseek-v3", "chatgpt-pro"]]


def test_keyword_score_rounds_half_to_even(spark):
    assert values(spark, lambda c: T.keyword_score(c, [("a", "0.75"), ("b", "0.05"), ("api", "3.5")]), ["a", "ab", "capital", "x"]) == [22, 24, 100, 0]


@pytest.mark.parametrize("alert,conf,trust,primary,hype", [(90, 1.0, 80, False, 0.0), (45, 0.0, 90, True, 0.05), (100, 1.0, 100, True, 0.0), (0, 0.0, 30, False, 1.0), (30, 1.0, 85, False, 0.0)])
def test_alert_score(spark, alert, conf, trust, primary, hype):
    want = max(0, min(100, round(alert * (0.75 + conf * 0.25) + (trust - 80) * 0.1 + (2 if primary else 0) - hype * 20)))
    row = spark.range(1).select(S.alert_score(F.lit(alert), F.lit(conf), F.lit(trust), F.lit(primary), F.lit(hype)).alias("s")).first()
    assert row.s == want


def test_categories_and_times(spark):
    assert values(spark, S.category, [90, 89, 75, 74, 60, 59], "int") == ["CRITICAL", "RELEVANT", "RELEVANT", "INTERESTING", "INTERESTING", "IGNORE"]
    now = F.timestamp_seconds(F.lit(1_000_000))
    ago = lambda c: S.relative_time(F.timestamp_seconds(c), now)
    assert values(spark, ago, [1_000_050, 999_941, 999_940, 996_401, 996_400, 913_601, 913_600, None], "long") == ["just now", "just now", "1 min ago", "59 min ago", "1h ago", "23h ago", "1d ago", "—"]
