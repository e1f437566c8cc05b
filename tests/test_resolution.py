import random
import time

import pytest
from pyspark.sql import functions as F

from signalflow.functions import text as T
from signalflow.operators import evidence, prefilter, similarity
from signalflow.plans import queries
from signalflow.sources import adapters as A
from signalflow.sources import config as C


def dp_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row
        row = [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
    return row[-1]


def test_bit_parallel_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randrange(0, 90))) for _ in range(2))
        assert similarity.lcs_length(a, b) == dp_lcs(a, b)


def variants():
    rng = random.Random(7)
    base = ["new model repository alpha seven", "tool calling arrives in the api", "a", "", "ab", "abc", "the agents of tomorrow"]
    out = []
    for t in base * 9:
        s = list(t)
        for _ in range(rng.randrange(0, 4)):
            if s and rng.random() < 0.5:
                del s[rng.randrange(len(s))]
            else:
                s.insert(rng.randrange(len(s) + 1), rng.choice("xyz "))
        out.append("".join(s))
    return out


@pytest.mark.parametrize("ratio", [88.0, 86.0, 94.5])
def test_similar_titles_equal_all_pairs(spark, ratio):
    titles = variants()
    frame = spark.createDataFrame([*enumerate(titles), (1000, None), (3, titles[3])], "id long, title string")
    got = {(r.a, r.b) for r in similarity.similar_titles(frame, ratio).collect()}
    want = set()
    first = {}
    for i, t in enumerate(titles):
        first.setdefault(t, i)
    for i, a in enumerate(titles):
        for j in range(i + 1, len(titles)):
            b = titles[j]
            if a == b:
                if first[a] == i:
                    want.add((i, j))
            elif first[a] == i and first[b] == j and len(a) > 1 and len(b) > 1 and similarity.title_ratio(a, b) >= ratio:
                want.add((i, j))
    assert got == want


def test_blocks_of_titles_equal_all_pairs():
    """Tiles and chunks of any size, letters of one or several 64-bit words, more kinds of letters than are counted."""
    rng = random.Random(11)
    for trial in range(12):
        letters = "abc de" if trial % 2 else "".join(chr(0x4E00 + i) for i in range(300)) + "\U0001d4b3"
        base = ["".join(rng.choices(letters, k=k)) for k in (2, 5, 20, 63, 64, 65, 129, 300)]
        sides = []
        for _ in range(2):
            side = []
            for t in base * 5:
                s = list(t)
                for _ in range(rng.randrange(max(2, len(t) // 6))):
                    s.insert(rng.randrange(len(s) + 1), rng.choice(letters))
                    del s[rng.randrange(len(s))]
                side.append("".join(s))
            sides.append(side)
        with pytest.MonkeyPatch.context() as m:
            for name, value in (("TILE", rng.choice([1, 50, 1 << 18])), ("CHUNK", rng.choice([3, 4096])), ("CLASSES", rng.choice([1, 3, 32])), ("LETTERS", rng.choice([1, 1 << 20]))):
                m.setattr(similarity, name, value)
            for one, two in ((sides[0], None), sides):
                i, j, ratio = similarity.similar_in_blocks(one, two, 88.0)
                want = {(a, b): similarity.title_ratio(x, y) for a, x in enumerate(one) for b, y in enumerate(two or one) if two or a < b}
                assert len(i) and sorted(zip(i, j, ratio)) == sorted((a, b, v) for (a, b), v in want.items() if v >= 88.0)


def test_many_long_titles_of_one_small_vocabulary(spark):
    """Titles that share nearly all of their short runs of letters."""
    rng = random.Random(13)
    syllables = ["".join(rng.choices("etaonihsr ", k=3)) for _ in range(40)]
    titles = ["".join(rng.choices(syllables, k=55)) for _ in range(6000)]
    titles += [t[:40] + "x" + t[45:] for t in titles[:50]]
    began = time.time()
    got = {(r.a, r.b) for r in similarity.similar_titles(spark.createDataFrame(list(enumerate(titles)), "id long, title string")).collect()}
    assert got == {(i, 6000 + i) for i in range(50)} and time.time() - began < 60


def test_leaders_equal_the_loop(spark):
    rng = random.Random(3)
    n = 60
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(70)}
    lead = {}
    for v in range(n):
        found = [u for u in range(v) if (u, v) in pairs and lead[u] == u]
        lead[v] = found[0] if found else v
    got = similarity.leaders(spark.range(n), spark.createDataFrame(list(pairs), "a long, b long"))
    assert {r.id: r.leader for r in got.collect()} == lead


def frame(spark, rows):
    schema = "ordinal long, title string, summary string, url string, exact_model_id string"
    return A.normalized(spark.createDataFrame(rows, schema))


NONE = "event_no long, event_id string, title string, normalized_title string, subject_name string, first_seen_at timestamp, content_hashes array<string>"


def test_events_by_content_model_and_title(spark):
    long = "the same long summary that tells the whole story of it"
    rows = [
        (0, "Tool calling arrives", "s1", "http://a/0", None), (1, "Tool-calling arrives!", "s2", "http://a/1", None), (2, "Something else", long, "http://a/2", None), (3, "Another title", long, "http://a/3", None),
        (4, "Qwen3 30B is out", "s3", "http://a/4", None), (5, "New model repository: Qwen/Qwen3-30B-FP8", "s4", "http://a/5", "Qwen/Qwen3-30B-FP8"), (6, "Qwen3 30B against others", "s5", "http://a/6", None), (7, "Old story again", "short", "http://a/7", None),
    ]
    stored = spark.createDataFrame([(-5, "old", "Old story again", "old story again", None, None, [])], NONE).withColumn("first_seen_at", A.as_of() - F.expr("INTERVAL 3 DAYS"))
    got = {r.ordinal: (r.leader, r.by) for r in evidence.resolve_events(frame(spark, rows), stored, A.as_of()).collect()}
    assert got == {0: (0, "new"), 1: (0, "title"), 2: (2, "new"), 3: (2, "content"), 4: (4, "new"), 5: (4, "model"), 6: (6, "new"), 7: (-5, "title")}
    late = stored.withColumn("first_seen_at", A.as_of() - F.expr("INTERVAL 15 DAYS"))
    again = {r.ordinal: r.leader for r in evidence.resolve_events(frame(spark, rows), late, A.as_of()).collect()}
    assert again[7] == 7


def test_events_of_the_given_tables_read_their_texts_once(spark, sf_dir):
    """What follows works on saved rows, so no plan has the expressions over whole texts again."""
    found = queries.event_leaders(spark, sf_dir)
    assert found.count() and not any("documents" in f for f in found.inputFiles())


def test_seen_before(spark):
    c = frame(spark, [(0, "a", "", "http://h/x?utm_source=1", None), (1, "b", "", "http://H/x/", None), (2, "c", "", "http://h/y", None)])
    stored = spark.createDataFrame([(-1, "http://h/y")], "article_id long, canonical_url string")
    assert {r.ordinal: r.seen_article for r in evidence.already_seen(c, stored).collect()} == {0: None, 1: 0, 2: -1}


def test_upgrades(spark):
    rows = [
        (1, "e", False, 50, "analyzed", None, 0.9), (2, "e", False, 55, "analyzed", None, 0.9), (3, "e", False, 65, "analyzed", None, 0.9), (4, "e", True, 60, "analyzed", None, 0.9), (5, "e", True, 65, "analyzed", None, 0.9),
        (1, "f", False, 50, "pending", None, 0.0), (2, "f", False, 10, "pending", None, 0.0), (1, "g", False, 50, "discarded", "analysis_failed", 0.0), (2, "g", True, 40, "discarded", "analysis_failed", 0.0),
        (1, "h", False, 50, "analyzed", None, 0.5), (2, "h", False, 51, "analyzed", None, 0.5), (3, "h", False, 51, "analyzed", None, 0.5),
    ]
    schema = "article_id long, event_id string, source_is_primary boolean, source_trust int, event_status string, event_discard_reason string, event_confidence double"
    e = spark.createDataFrame(rows, schema).withColumn("event_primary_verified", F.lit(False))
    got = {(r.event_id, r.article_id): r.upgrade_reason for r in evidence.evidence_upgrades(e).collect() if r.upgrade_reason}
    assert got == {
        ("e", 3): "higher_trust_source", ("e", 4): "primary_source_discovered", ("f", 2): "pending_event_new_evidence", ("g", 2): "retry_failed_with_primary", ("h", 2): "low_confidence_better_evidence",
    }


def test_prefilter_chain(spark):
    base = {"title": "x", "summary": "nothing", "url": "http://a/1", "trust": 50, "primary": False, "type": "rss", "name": "feed", "hours": 1}
    cases = [
        ({}, "low_relevance"), ({"hours": None}, "invalid"), ({"hours": 49}, "too_old"), ({"trust": 39}, "low_trust"), ({"url": "mailto:x"}, "invalid"), ({"title": "!!"}, "invalid"),
        ({"summary": "keyone"}, None), ({"type": "web_changelog", "summary": "keyone typo"}, "low_relevance"), ({"type": "web_articles", "summary": "a new_gpu"}, None), ({"trust": 95, "primary": True, "summary": "preview"}, None),
        ({"type": "github_releases", "name": "vLLM", "title": "v1.2.3", "summary": "keyone"}, "low_relevance"), ({"type": "github_releases", "name": "vLLM", "title": "v1.2.0", "summary": "keyone"}, None), ({"type": "github_releases", "name": "vLLM", "title": "v1.2.3", "summary": "keyone quantization"}, None),
    ]
    rows = [(i, *[(base | c)[k] for k in base]) for i, (c, _) in enumerate(cases)]
    f = spark.createDataFrame(rows, "ordinal int, title string, summary string, url string, source_trust int, source_is_primary boolean, source_type string, source_name string, hours int")
    f = A.normalized(f.withColumn("published_at", F.when(F.col("hours").isNotNull(), A.as_of() - F.make_dt_interval(F.lit(0), "hours"))))
    got = {r.ordinal: r.reason for r in prefilter.prefiltered(f, [("keyone", "0.80")], A.as_of()).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_config():
    C.validated_profiles(C.SAMPLE_PROFILES, C.SAMPLE_TERMS)
    with pytest.raises(ValueError):
        C.validated_profiles([(1, "a", "A", "", False, [])], [])
    with pytest.raises(ValueError):
        C.validated_profiles([(1, "a", "A", "", True, []), (2, "a", "B", "", True, [])], [])
    assert ("que", "0.20") in C.active_terms() and all(t != "the" for t, _ in C.active_terms())


@pytest.mark.parametrize("seed", [1, 2])
def test_events_equal_the_loop(spark, seed):
    """One candidate after the other, against all heads so far: equal content, then the own model, then similar titles."""
    rng = random.Random(seed)
    names = [t for t in variants() if len(t) > 2] + ["Qwen3 30B is out", "GLM-4.5 arrives", "qwen3 30b", "!!"]
    models = [None] * 5 + ["Qwen/Qwen3-30B-FP8", "zai/GLM-4.5-FP8"]
    rows = [(i, rng.choice(names), rng.choice(["short", f"a summary of more than forty letters that is number {rng.randrange(60)}"]), f"http://a/{i}", rng.choice(models)) for i in range(120)]
    stored = spark.createDataFrame([(-1 - k, f"old{k}", names[3 * k], None, None, None, []) for k in range(6)], NONE).withColumn("normalized_title", T.normalized_title(F.col("title")))
    stored = stored.withColumn("first_seen_at", A.as_of() - F.expr("INTERVAL 3 DAYS")).withColumn("content_hashes", F.array(F.sha2(F.lit("a summary of more than forty letters that is number 7"), 256)))
    c = frame(spark, rows).withColumns({"own": T.model_identity(F.col("exact_model_id")), "model": T.model_identity(F.col("title"))})
    heads = sorted((r.event_no, r.normalized_title, r.model) for r in stored.withColumn("model", T.model_identity(F.col("title"))).collect())
    by_content = {r.content_hashes[0]: -6 for r in stored.collect()}
    want = {}
    for r in c.orderBy("ordinal").collect():
        long = len(r.summary) >= 40
        if long and r.content_hash in by_content:
            want[r.ordinal] = (by_content[r.content_hash], "content")
            continue
        like = lambda t: t == r.normalized_title or (min(len(t), len(r.normalized_title)) > 1 and similarity.title_ratio(t, r.normalized_title) >= 88)  # noqa: B023, E731
        by_model = [h for h, _, m in heads if r.own and m == r.own]
        by_title = [h for h, t, _ in heads if like(t)]
        want[r.ordinal] = (by_model[0], "model") if by_model else (by_title[0], "title") if by_title else (r.ordinal, "new")
        if want[r.ordinal][1] == "new":
            heads.append((r.ordinal, r.normalized_title, r.model))
        if long:
            by_content[r.content_hash] = want[r.ordinal][0]
    got = {r.ordinal: (r.leader, r.by) for r in evidence.resolve_events(c.drop("own", "model"), stored, A.as_of()).collect()}
    assert got == want


def test_seen_and_content_groups_of_nulls_hot_and_stored_keys(spark):
    long = "the same words in a summary that is long enough to tell"
    rows = [(i, "u" if i < 30 else None if i < 33 else f"u{i}", "h" if i % 2 else "g", long if i % 2 else "short", "clash") for i in range(40)]
    c = spark.createDataFrame(rows, "ordinal long, canonical_url string, content_hash string, summary string, _known_url string")
    stored = spark.createDataFrame([(-5, "u39"), (-7, "u39"), (-2, "u"), (-9, None)], "article_id long, canonical_url string")
    seen = {r.ordinal: r.seen_article for r in evidence.already_seen(c, stored).collect()}
    assert seen == {i: -2 if i < 30 else (None if i == 30 else 30) if i < 33 else -7 if i == 39 else None for i in range(40)}
    assert {r.ordinal: r.seen_article for r in evidence.already_seen(c, stored.limit(0)).collect()}[29] == 0
    got = evidence.content_groups(c)
    assert got.columns == c.columns + ["content_first"] and {r.ordinal: r.content_first for r in got.collect()} == {i: 1 if i % 2 else i for i in range(40)}
    assert evidence.content_groups(c.limit(0)).count() == 0 and evidence.already_seen(c.limit(0), stored).count() == 0


def test_marks_of_decisions_and_outcomes(spark):
    rows = [
        (1, "e", "too_old", True, None), (2, "e", "duplicate", False, None), (3, "e", "evidence_reanalysis", False, "analyzed"), (4, "e", "too_old", False, None),
        (5, "f", "analyze", True, "analysis_failed"), (6, "g", "low_trust", True, None), (7, "h", "analyze", True, "high_hype"), (8, "i", "analyze", True, None), (9, "i", "already_seen", False, None), (10, "j", "too_old", None, None),
    ]
    marks = evidence.marked(spark.createDataFrame(rows, "ordinal long, event_id string, decision string, is_new_event boolean, outcome string"))
    got = {r.event_id: tuple(r)[1:] for r in evidence.event_changes(marks).collect()}
    assert got == {
        "e": ("analyzed", "too_old", 1, 2, 2), "f": ("discarded", "analysis_failed", 0, 1, 0), "g": ("discarded", "low_trust", 0, 1, 1), "h": ("discarded", "high_hype", 1, 1, 1),
        "i": (None, None, 0, 0, 0), "j": ("discarded", "too_old", 0, 1, 1),
    }
    assert evidence.event_changes(marks.limit(0)).count() == 0
