"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation learns how far to trust them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small, small_batches
from .shingles import chunks, ngram_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
#: Words in a window whose repeats count, and the fixed base rule.
REPEAT_WINDOW, MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30

#: (name, measure, bad when above, good when below): between the two bounds a rule abstains. Several rules look at each
#: kind of junk from different sides, since only votes that agree tell the two kinds of text apart.
RULES = (
    ("symbols", "n_symbols / n_words", 0.20, 0.05),
    ("symbol share", "n_symbols / word_chars", 0.03, 0.01),
    ("plain words", "n_odd_words / n_words", 0.30, 0.10),
    ("lone marks", "n_lone_marks / n_words", 0.15, 0.03),
    ("word ends", "n_odd_ends / n_words", 0.30, 0.05),
    ("capitals", "n_upper / n_letters", 0.40, 0.15),
    ("exclaims", "n_exclaims / n_words", 0.30, 0.05),
    ("repeats", "n_repeat_words / n_words", 0.20, 0.02),
    ("lines", "n_dup_lines / n_lines", 0.30, 0.10),
    ("variety", "n_seen_words / n_words", 0.75, 0.60),
    ("same next", "n_same_next / n_words", 0.20, 0.03),
)
#: Bounds of the share of good votes among bad texts and of bad votes among good texts, and of the share of bad texts.
LEAST_SHARE, MOST_ERROR, MOST_BAD, ROUNDS = 0.001, 0.30, 0.50, 300
#: What EM starts from: the share of bad texts, how often a vote on a bad text is bad, and on a good text.
FIRST_BAD, FIRST_HIT, FIRST_ERROR = 0.10, 0.40, 0.02

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_seen_words long, n_odd_words long, n_lone_marks long, n_odd_ends long, n_letters long, n_upper long, n_exclaims long, n_same_next long"


#: Bytes that are no part of a letter or digit.
_MARK = np.array([not (b > 127 or chr(b).isalnum()) for b in range(256)])


def _repeat_words(hashes: np.ndarray) -> int:
    """Positions covered by windows whose hash occurs at least twice; hashes are one text's window hashes."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(s) + REPEAT_WINDOW, np.int32)
    at = order[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + REPEAT_WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(_SPACE))
        else:
            seen.add(line)
    return n


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in MEASURES.split(", ")]
    for batch in batches:
        for at, texts in chunks(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
            words = word_hashes(texts)
            windows, first = ngram_hashes(words, REPEAT_WINDOW)
            marks = _MARK[words.buffer]
            upto = np.zeros(len(marks) + 1, np.int64)
            np.cumsum(marks, out=upto[1:])
            inside = upto[words.ends] - upto[words.starts]
            length = words.ends - words.starts
            last = marks[words.ends - 1] & marks[np.maximum(words.ends - 2, 0)] & (length > 1)
            odd, lone = inside > 1, inside == length
            rows = []
            for i, t in enumerate(texts):
                here = slice(words.first[i], words.first[i + 1])
                own = words.hashes[here]
                s = t.decode("utf-8", "replace")
                ascii_letters = len(t) - len(t.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                upper = len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                if len(s) != len(t):  # other alphabets
                    rest = s.encode("ascii", "ignore")
                    more = [c for c in s if c > "\x7f"] if len(rest) != len(s) else []
                    ascii_letters += sum(map(str.isalpha, more))
                    upper += sum(map(str.isupper, more))
                spaces = len(t) - len(t.translate(None, _SPACE))
                rows.append(
                    (
                        len(own),
                        len(s) - spaces,
                        len(t) - len(t.translate(None, SYMBOLS)),
                        _dup_lines(t),
                        _repeat_words(windows[first[i] : first[i + 1]]),
                        t.count(b"\n") + 1,
                        len(own) - len(np.unique(own)),
                        int(odd[here].sum()),
                        int(lone[here].sum()),
                        int(last[here].sum()),
                        ascii_letters,
                        upper,
                        t.count(b"!") + t.count(b"?"),
                        int((own[1:] == own[:-1]).sum()),
                    )
                )
            columns = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[*batch.schema.names[:-1], *names]
            )


def measures(documents: DataFrame) -> DataFrame:
    """row_hash and MEASURES of each whole text, with doc_id. Null and empty texts measure 0 in all but n_lines."""
    small_batches(documents.sparkSession)
    slim = documents.select("doc_id", F.xxhash64("text").alias("row_hash"), F.col("text").cast("string").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_measures, f"doc_id {kind}, row_hash long, {MEASURES}")


def votes() -> Column:
    """A digit per rule: 0 bad, 2 good, 1 abstains; as one string. Rules about words abstain where there are none."""
    digits = []
    for _, measure, bad, good in RULES:
        value = F.try_divide(*[F.col(c) for c in measure.split(" / ")])
        digits.append(F.when(F.coalesce(value > bad, F.lit(False)), "0").when(F.coalesce(value < good, F.lit(False)), "2").otherwise("1"))
    return F.concat(*digits)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def label_model(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior probability of good for each vote pattern; the share of bad votes of each rule among (bad, good) texts that
    it votes on, which is its accuracy on bad texts and its error on good ones; and the share of bad texts.

    A latent class model: given whether a text is good, rules vote independently; abstentions say nothing.
    Expectation-maximisation over pattern counts, so the cost depends on the number of patterns (3 ** rules at most) and not on
    the texts. It starts from rules that seldom err on good texts, and a bad vote never becomes a sign of a good text.
    """
    if not patterns:
        return {}, np.zeros((len(RULES), 2)), FIRST_BAD
    names = sorted(patterns)
    v = np.array([[int(c) - 1 for c in p] for p in names])  # -1 bad, 0 abstains, 1 good
    n = np.array([patterns[p] for p in names], float)
    votes_bad, votes_good, voted = (v < 0).astype(float), (v > 0).astype(float), (v != 0).astype(float)
    hit, error, bad = np.full(v.shape[1], FIRST_HIT), np.full(v.shape[1], FIRST_ERROR), FIRST_BAD
    for _ in range(rounds):
        log_bad = np.log(bad) + votes_bad @ np.log(hit) + votes_good @ np.log(1 - hit)
        log_good = np.log(1 - bad) + votes_bad @ np.log(error) + votes_good @ np.log(1 - error)
        p = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        b, g = n * (1 - p), n * p
        # One made-up vote of each rule on each kind, at the first guess, keeps shares defined where a rule never votes.
        new_hit = (b @ votes_bad + FIRST_HIT) / (b @ voted + 1)
        new_error = np.clip((g @ votes_bad + FIRST_ERROR) / (g @ voted + 1), LEAST_SHARE, MOST_ERROR)
        new_hit = np.clip(np.maximum(new_hit, new_error), LEAST_SHARE, 1 - LEAST_SHARE)
        new_bad = float(np.clip(b.sum() / n.sum(), 0.001, MOST_BAD))
        settled = max(np.abs(new_hit - hit).max(), np.abs(new_error - error).max(), abs(new_bad - bad)) < 1e-7
        hit, error, bad = new_hit, new_error, new_bad
        if settled:
            break
    return dict(zip(names, p.tolist())), np.stack([hit, error], axis=1), bad


def judged(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Measures, votes, posterior and verdict of each document.

    documents: doc_id, text. Returns doc_id, row_hash, MEASURES, votes, posterior, base_failed (fewer than MIN_BASE_WORDS
    words, or more than MAX_REPEAT_PERCENT percent of them in repeated windows) and kept: not base_failed and a posterior
    of at least threshold. Whole texts are read. Null and empty texts have no words and fail the base rule; null and
    repeated doc_ids are kept as they are; an empty table gives no rows; other columns are ignored. Only the counts of vote
    patterns, at most 3 ** len(RULES), come to the driver; texts that pass the base rule are what the model learns from.
    """
    known = saved(measures(documents).select("*", votes().alias("votes"), base_failed().alias("base_failed")), "quality")
    counts = known.where("not base_failed").groupBy("votes").agg(F.count("*").alias("n")).collect()
    posterior, _, bad = label_model({r["votes"]: r["n"] for r in counts})
    table = known.sparkSession.createDataFrame(list(posterior.items()) or [("", 1.0 - bad)], "votes string, posterior double")
    out = known.join(F.broadcast(table), "votes", "left").withColumn("posterior", F.coalesce("posterior", F.lit(0.0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def good_documents(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """documents that are kept; columns as before. The verdict depends on the text alone, so it is joined by id and text."""
    verdict = judged(documents, threshold).where("not kept").select(F.col("doc_id").alias("__sf_id"), F.col("row_hash").alias("__sf_row")).distinct()
    gone = small(saved(verdict, "rejected"))
    same = documents["doc_id"].eqNullSafe(gone["__sf_id"]) & (F.xxhash64(documents["text"]) == gone["__sf_row"])
    return documents.join(gone, same, "left_anti")
