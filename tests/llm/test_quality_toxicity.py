import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from signalflow.llm import quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_base_measures(table, request):
    frame = request.getfixturevalue(table)
    rows = quality.judged(frame).collect()
    want = sorted(((r.doc_id, *brute(r.text)) for r in frame.select("doc_id", "text").collect()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=str) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_junk_goes_and_clean_text_stays(spark):
    f = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judged(f).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_good_documents_keeps_columns(edge):
    left = quality.good_documents(edge)
    assert left.columns == edge.columns and {(r["label"], r["__sf_hash"], r["__sf_row"]) for r in left.collect()} <= {("clash", "own", "own")}


def plain_em(rows, rounds=300):
    """Expectation-maximisation text by text and rule by rule; rows: votes as strings. Returns the posterior of good per row."""
    k = len(quality.RULES)
    hit, error, bad = [quality.FIRST_HIT] * k, [quality.FIRST_ERROR] * k, quality.FIRST_BAD
    for _ in range(rounds):
        good = []
        for row in rows:
            b, g = bad, 1 - bad
            for j, v in enumerate(row):
                if v == "0":
                    b, g = b * hit[j], g * error[j]
                elif v == "2":
                    b, g = b * (1 - hit[j]), g * (1 - error[j])
            good.append(g / (b + g))
        for j in range(k):
            voted = [(p, row[j] == "0") for p, row in zip(good, rows) if row[j] != "1"]
            e = (sum(p for p, v in voted if v) + quality.FIRST_ERROR) / (sum(p for p, _ in voted) + 1)
            h = (sum(1 - p for p, v in voted if v) + quality.FIRST_HIT) / (sum(1 - p for p, _ in voted) + 1)
            error[j] = min(max(e, quality.LEAST_SHARE), quality.MOST_ERROR)
            hit[j] = min(max(h, error[j], quality.LEAST_SHARE), 1 - quality.LEAST_SHARE)
        bad = min(max(sum(1 - p for p in good) / len(good), 0.001), quality.MOST_BAD)
    return good


def test_verdicts_equal_plain_expectation_maximisation(docs):
    rows = [r for r in quality.judged(docs).collect()]
    fit = [r for r in rows if not r.base_failed]
    for r, p in zip(fit, plain_em([r.votes for r in fit])):
        assert abs(r.posterior - p) < 1e-3 and (r.kept == (p >= 0.5) or abs(p - 0.5) < 1e-3)
    for r in rows:  # votes from the measures, rule by rule
        for v, (_, measure, above, below) in zip(r.votes, quality.RULES):
            over, under = (r[x] for x in measure.split(" / "))
            assert v == ("1" if not under else "0" if over / under > above else "2" if over / under < below else "1")


def test_label_model_finds_agreeing_rules():
    k = len(quality.RULES)
    good, bad = "2" * k, "000" + "2" * (k - 3)
    posterior, shares, share_bad = quality.label_model({good: 900, bad: 100, "1" * k: 5})
    assert posterior[good] > 0.99 and posterior[bad] < 0.01 and 0.05 < share_bad < 0.15
    assert quality.label_model({})[0] == {}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = [toxicity.Term(t, False, 1.0) for t in ("stupid", "moron", "scum", "worthlessness", "idiotic")]
    lexicon = toxicity.Lexicon(terms)
    words = ["stupid", "stupd", "stuppid", "stxpid", "sutpid", "morn", "moroon", "scum", "scun", "worthlesness", "worthlsness", "wrthlesness", "orthlessnes", "idiotik", "idiot", "zzz", "s"]
    for w in words:
        fits = [(edit_distance(w, t.text), i) for i, t in enumerate(terms) if edit_distance(w, t.text) <= min(lexicon.edits(len(w) + 1), lexicon.edits(len(t.text)))]
        found = lexicon.search(w)
        assert (found is None) == (not fits) and (found is None or found[1] == min(fits)[0])


def plain_find(token, terms):
    """The best (term, wrong letters): all terms are tried, and their distances computed in full."""
    word = token if token.isalpha() else token.strip(toxicity._EDGES)
    word = word if word.isalpha() else word.translate(toxicity.LOOKALIKES)
    fits = [(-t.weight, i) for i, t in enumerate(terms) if word and (word.startswith(t.text) if t.is_stem else word == t.text)]
    if fits:
        return min(fits)[1], 0
    edits = toxicity.Lexicon.edits
    near = [i for i, t in enumerate(terms) if not t.is_stem and abs(len(t.text) - len(word)) <= 2 and word]
    near = [(d, -terms[i].weight, i) for i in near if (d := edit_distance(word, terms[i].text)) <= min(edits(len(word) + 1), edits(len(terms[i].text)))]
    return (min(near)[2], min(near)[0]) if near else None


def plain_features(text, terms, known):
    """FEATURES from their definitions, word by word."""
    words = (text or "").lower().split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    for w in set(words) - known.keys():
        known[w] = plain_find(w, terms)
    quoted, hits = 0, []
    for i, w in enumerate(words):
        if known[w] is None:
            continue
        around = words[max(0, i - 4) : i + 5]
        marks = sum(x[0] in toxicity.QUOTE_SIGNS or x[-1] in toxicity.QUOTE_SIGNS for x in around)
        if marks >= 2 or (w[0] in toxicity.QUOTE_SIGNS and w[-1] in toxicity.QUOTE_SIGNS) or any(x.strip(".,:;") in toxicity.QUOTE_WORDS for x in around):
            quoted += 1
        else:
            hits.append((i, *known[w]))
    stems = [t.text for t in terms if t.is_stem]
    family = {min((s for s in stems if terms[t].text.startswith(s)), key=len, default=terms[t].text) for _, t, _ in hits}
    dense = max((sum(i <= j < i + 25 for j, _, _ in hits) for i, _, _ in hits), default=0)
    wrong = sum(e > 0 for _, _, e in hits)
    weight = sum(terms[t].weight / (1 + e) for _, t, e in hits)
    return [*np.log1p([len(hits) - wrong, wrong, quoted, len(family), dense, weight]), np.log1p(len(words)) / 10, 100 * len(hits) / (len(words) + 20)]


def test_scores_equal_plain_ones(spark):
    base = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    training = toxicity.training_rows(documents, labels)
    terms = toxicity.learn_terms(training)
    known = {}
    lessons = sorted((r.doc_id, r.toxic, r.text) for r in training.where("part = 0").collect() if len(r.text or "") < 4000)
    some = documents.where("length(text) < 1500").orderBy("doc_id").limit(60).collect()
    for t in [r.text for r in some] + [t for _, y, t in lessons if y][:30] + ["you stupd m0ron", 'he said "idiot"', "", None]:
        assert np.allclose(plain_features(t, terms, known), toxicity.text_features(t or "", toxicity.Lexicon(terms)))
    # A score is the logistic function of the weighted features; the weights leave no gradient of the penalised likelihood.
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + rng.normal(size=400) > 0.3).astype(float)
    w = np.array(toxicity.fit_weights(x, y))
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.abs(x.T @ (y - p) - w[1:]).max() < 1e-6 and abs((y - p).sum()) < 0.01
    got = list(toxicity._features(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["you stupd m0ron"])], names=["doc_id", "text"])]), terms, [0.5] + [0.1 * k for k in range(8)]))
    z = 0.5 + sum(0.1 * k * f for k, f in enumerate(plain_features("you stupd m0ron", terms, known)))
    assert abs(got[0].column(1)[0].as_py() - 1 / (1 + np.exp(-z))) < 1e-9


def test_training_rows_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 50, f"text {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(7, 0), (8, 1)], "doc_id long, toxic int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted((r.doc_id, r.text, r.toxic) for r in toxicity.training_rows(f, labels).collect()) for f in (frame.coalesce(1), frame.repartition(7, "text")))
    assert one == two and len(one) == len({r[0] for r in one})


def test_quotation_is_told_apart():
    lexicon = toxicity.Lexicon([toxicity.Term("moron", False, 5.0)])
    names = toxicity.FEATURES
    quoted = dict(zip(names, toxicity.text_features('he said "moron" to them once', lexicon)))
    direct = dict(zip(names, toxicity.text_features("you are such a m0ron and a mor0n", lexicon)))
    assert quoted["quoted"] > 0 and quoted["exact"] == 0 and direct["exact"] > 0 and direct["quoted"] == 0


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.6), ("sf0.1", 0.9)])
def test_held_out_accuracy(spark, sf, recall):
    """Of six held-out toxic texts of the small table two are toxic by label alone, so the share asked for is that of the larger one."""
    base = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    documents = spark.read.parquet(f"{base}/documents.parquet").join(labels, "doc_id", "left_semi")
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) >= recall * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_toxicity_edges(edge, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(edge, none).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.toxicity(empty, none).count() == 0


def taught(spark, toxic, clean):
    """Training rows of the lexicon's part."""
    rows = [(i, t, int(i < len(toxic)), 1) for i, t in enumerate([*toxic, *clean])]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, part long")


def test_learned_words_match_misspelled(spark):
    toxic = [f"you {w} go away" for w in ("moron", "idiot", "worthlessness") for _ in range(20)]
    lexicon = toxicity.Lexicon(toxicity.learn_terms(taught(spark, toxic, ["please come here now"] * 60)))
    for right, wrong, errors in (("moron", "morron", 1), ("idiot", "idiiot", 1), ("idiot", "ldiot", 1), ("worthlessness", "wrthlesnes", 3), ("worthlessness", "wrthlesness", 2)):
        assert lexicon.find(right)[1] == 0
        found = lexicon.find(wrong)
        assert found is None if errors > 2 else (lexicon.terms[found[0]].text, found[1]) == (right, errors)
        for w in (right, wrong):
            assert lexicon.find(w) == lexicon.search(w)


def test_misspelled_documents_score_higher(spark):
    rows = [(i, f"you {'moron' if i % 2 else 'friend'} go home {'today' if i % 3 else 'later'}", i % 2) for i in range(300)]
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    texts = [(i, t) for i, t, _ in rows] + [(1000, "you morron go home today"), (1001, "you person go home today")]
    score = {r.doc_id: r.score for r in toxicity.toxicity(spark.createDataFrame(texts, "doc_id long, text string"), labels).collect()}
    assert score[1000] > 0.5 > score[1001]


def test_rare_terms_are_learned(spark):
    letters = "bcdfghjklm"
    many = [f"{letters[i // 100 % 10]}{letters[i // 10 % 10]}{letters[i % 10]}{letters[i // 1000]}" for i in range(1200)]
    toxic = [" ".join(many)] * 500 + ["you zwackel"] * 5 + ["you friend"] * 95
    terms = {t.text for t in toxicity.learn_terms(taught(spark, toxic, ["you friend"] * 600))}
    assert {*many, "zwackel"} <= terms


def test_dense_hits_of_long_texts():
    lexicon = toxicity.Lexicon([toxicity.Term("moron", False, 5.0)])
    dense = lambda text: round(np.expm1(toxicity.text_features(text, lexicon)[toxicity.FEATURES.index("dense")]))
    scattered = " ".join("moron" if i % 50 == 0 else "tree" for i in range(20_000 + 5_000))
    assert dense(scattered) == 1
    assert dense(f"{'moron tree ' * 2500} {'moron ' * 60}") == toxicity.DENSE
    rng = np.random.default_rng(1)
    for share in (0.01, 0.1, 0.5):
        at = np.flatnonzero(rng.random(1500) < share).tolist()
        assert toxicity.densest(at) == max(sum(a <= b < a + toxicity.DENSE for b in at) for a in at)
