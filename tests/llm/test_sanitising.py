import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from signalflow.llm import sanitising

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def plain_spans(text, kind):
    return [(m.start(), m.end()) for m in re.finditer(PLAIN[kind], text or "") if holds(kind, m[0])]


def odd_texts():
    rng = random.Random(12)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    texts = [draw("a@.-+%_ 01259é()\n", 120) for _ in range(1200)] + [draw("012 -", 90) for _ in range(300)] + [draw("12.+", 80) for _ in range(300)]
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "4111111111111112", "é 0004111 1111 1111 1111 1", "😀 4111 1111 1111 1111 😀 a@b.co"]
    return [*texts, *cards, None, "", "a@b@c.d", "x@y.z.", "1.1.1.1.1.1.1.1", "0255.0.00.1", "256.1.1.1"]


def test_patterns_equal_the_plain_ones(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(4)
    for row in df.select("i", *[sanitising.spans_of(F.coalesce("text", F.lit("")), k).alias(k) for k in PLAIN]).collect():
        for kind in PLAIN:
            assert [(s["start"], s["end"]) for s in row[kind]] == plain_spans(texts[row["i"]], kind), (kind, texts[row["i"]])
            assert all(texts[row["i"]][s["start"] : s["end"]] == s["value"] for s in row[kind])


def test_long_texts_take_time_in_proportion(spark):
    texts = ["1" * 200_000, "1 " * 100_000, "a" * 200_000 + "@", "a@b." * 25_000, "1.2.3.4 " * 20_000, "+1" * 50_000, "+1 " + "(" * 200_000]
    counts = spark.createDataFrame(enumerate(texts), "i int, text string").select("i", *[F.size(sanitising.spans_of(F.col("text"), k)).alias(k) for k in PLAIN]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in counts] == [(0, 0, 0, 0)] * 3 + [(12_500, 0, 0, 0), (0, 20_000, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


def corpus():
    filler = "common words that stand in every single text of this little corpus and nowhere else "
    docs = [(i, filler * 4) for i in range(60)]
    docs += [(100, "please write to Zorblat at z.orb@mail.example.com about these words"), (101, "Zorblat, known as z.orb@mail.example.com, said words"), (102, "I met ZORBLAT yesterday"), (103, "zorblat@home.example.org is no term")]
    docs += [(104, "call Commander at +49 (30) 1234567 words"), (105, "for Commander use +49 (30) 1234567 single"), (106, "commands " * 300)]
    docs += [(i, "only copies hold Quibbler near 10.0.0.7 here") for i in range(110, 115)]
    return docs


def test_terms_that_give_entities_away(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    texts = df.select("doc_id", "text")
    terms, _ = sanitising.disclosing_terms(sanitising.saved(sanitising.base_spans(texts), "b"), texts)
    found = {r["term"]: (r["kind"], r["entity"], r["put"]) for r in terms.collect()}
    assert found == {"zorblat": ("email", "z.orb@mail.example.com", "[removed]"), "commander": ("phone", "49301234567", "com…")}
    rows = {r["doc_id"]: r for r in sanitising.personal_spans(df).collect()}
    assert [(s["start"], s["end"]) for s in rows[102]["term"]] == [(6, 13)] and [(s["start"], s["end"]) for s in rows[101]["term"]] == [(0, 7)]
    assert rows[103]["term"] == [] and len(rows[103]["email"]) == 1 and rows[110]["term"] == [] and all(rows[i]["term"] == [] for i in range(60))
    new = {r["doc_id"]: r["text"] for r in sanitising.sanitised(df).collect()}
    assert new[101] == "[removed], known as [email], said words" and new[102] == "I met [removed] yesterday"
    assert new[105] == "for com… use [phone] single" and new[103] == "[email] is no term" and new[0] == corpus()[0][1]


@pytest.mark.parametrize("surroundings,disclosure", [(1, 0.9), (2, 0.5), (2, 0.9)])
def test_terms_equal_plain_counts(spark, docs, surroundings, disclosure):
    """Shares from plain loops over all texts; words around mentions by positions in the text."""
    import math

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    run = re.compile(r"[^\W\d_]{4,}")
    everywhere, beside, places, total = {}, {}, {}, 0
    for _, text in texts.collect():
        plain = re.sub(PLAIN["email"], " ", text)
        for w in run.findall(plain):
            everywhere[w.lower()] = everywhere.get(w.lower(), 0) + 1
            total += 1
        for kind in PLAIN:
            own = text if kind == "email" else plain
            all_ = [(m.start(), m.end(), m[0]) for m in re.finditer(PLAIN[kind], own)]
            for k, (a, b, m) in enumerate(all_):
                if holds(kind, m):
                    left, right = own[all_[k - 1][1] if k else 0 : a], own[b : all_[k + 1][0] if k + 1 < len(all_) else len(own)]
                    left = left if len(left) <= 100 else re.sub(r"^[^\W\d_]+", "", left[-100:])
                    right = right if len(right) <= 100 else re.sub(r"[^\W\d_]+$", "", right[:100])
                    name = m.lower() if kind == "email" else m if kind == "ip" else re.sub("[^0-9]", "", m)
                    for w in run.findall(left + " " + right):
                        beside[w.lower(), kind, name] = beside.get((w.lower(), kind, name), 0) + 1
                        places.setdefault((w.lower(), kind, name), set()).add((left, right))
    cover = {}
    for (_, kind, name), n in beside.items():
        cover[kind, name] = cover.get((kind, name), 0) + n
    want = {w for (w, kind, name), n in beside.items() if len(places[w, kind, name]) >= surroundings and 1 + math.log2(min(1, n / everywhere[w])) / math.log2(total / cover[kind, name]) >= disclosure}
    terms, _ = sanitising.disclosing_terms(sanitising.saved(sanitising.base_spans(texts), "b"), texts, surroundings, disclosure)
    assert {r["term"] for r in terms.collect()} == want and (want or surroundings > 1)


def test_edge_rows(spark, edge, empty):
    found = sanitising.span_columns(sanitising.personal_spans(edge)).collect()
    assert len(found) == edge.count() and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in found)
    assert sanitising.span_columns(sanitising.personal_spans(empty)).count() == 0 and sanitising.sanitised(empty).count() == 0
    same = sanitising.sanitised(edge)
    assert same.columns == edge.columns and sorted(map(str, same.collect())) == sorted(map(str, edge.collect()))
    rows = [(None, "a@b.co"), (None, "a@b.co"), (1, "é a@b.co +1 (222) 333-4444"), (1, "é a@b.co +1 (222) 333-4444")]
    got = sanitising.span_columns(sanitising.personal_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(str((r["doc_id"], r["n_email"], r["n_phone"], r["spans"])) for r in got) == sorted([str((None, 1, 0, "email:0:6"))] * 2 + [str((1, 1, 1, "email:2:8,phone:9:26"))] * 2)
