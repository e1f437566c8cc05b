"""Toxicity scores: a lexicon trie searched with Levenshtein automata, and context windows around what it finds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small, small_batches

#: Labelled rows that the lexicon and the weights are learned from, at most about so many (chosen by a hash of doc_id).
TRAIN_ROWS = 12_000
#: Of every PARTS training rows, one teaches the weights and the others the lexicon, so that terms which fit the lexicon's rows
#: by chance get no weight.
PARTS = 3
#: A term is in at least so many toxic texts, and so many times as frequent there as in others.
TERM_TEXTS, TERM_RATIO = 5, 8.0
#: Stems are beginnings of words of these lengths.
STEM_LETTERS = range(4, 9)
#: Letters that a term needs for one and for two wrong letters.
ONE_EDIT, TWO_EDITS = 5, 11
#: Words on either side of a hit that belong to its context, and the words in which hits count together.
CONTEXT, DENSE = 4, 25
#: Digits and signs that stand for letters inside words (fixed values).
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
#: Words and signs around a term that is quoted (fixed values).
QUOTE_SIGNS = "\"'`«»„“”‘’"
QUOTE_WORDS = frozenset("said says wrote writes quoted quote called reported term word".split())
#: Words whose result a worker remembers.
REMEMBERED = 300_000

FEATURES = ("exact", "misspelled", "quoted", "distinct", "dense", "weight", "length", "share")


class Term(NamedTuple):
    text: str
    is_stem: bool
    weight: float


class Lexicon:
    """A trie of terms: words, which match with a few wrong letters, and stems, which match as they are whatever follows."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.root: dict = {}
        self.near: set[str] = set()
        words = [t.text for t in terms if not t.is_stem]
        self.lengths = {n + k for n in map(len, words) for k in range(-self.edits(n), self.edits(n) + 1)}
        self.most = max((self.edits(len(w)) for w in words), default=0)
        self.ends = {w[:2] for w in words} | {w[-2:] for w in words}
        stems = {t.text: i for i, t in enumerate(terms) if t.is_stem}
        #: The term's shortest stem, or the term itself: terms of one stem are not distinct hits.
        self.family = [next((stems[t.text[:n]] for n in range(1, len(t.text) + 1) if t.text[:n] in stems), i) for i, t in enumerate(terms)]
        for i, t in enumerate(terms):
            node = self.root
            for c in t.text:
                node = node.setdefault(c, {})
            node[("end", t.is_stem)] = i
            if not t.is_stem:
                self.near |= self._shortened(t.text, self.edits(len(t.text)))
        self.memory: dict[str, tuple[int, int] | None] = {}

    @staticmethod
    def edits(letters: int) -> int:
        return 0 if letters < ONE_EDIT else 1 if letters < TWO_EDITS else 2

    @staticmethod
    def _shortened(word: str, most: int) -> set[str]:
        """The word without up to most of its letters; two words with so few wrong letters between them have one in common."""
        out = last = {word}
        for _ in range(most):
            last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
            out = out | last
        return out

    def _may_match(self, word: str) -> bool:
        """Whether the search along the trie can find a term with wrong letters."""
        most = min(self.edits(len(word) + 1), self.most)
        if len(word) not in self.lengths:
            return False
        # One wrong letter leaves the first two letters or the last two.
        if most < 2 and word[:2] not in self.ends and word[-2:] not in self.ends:
            return False
        return not self.near.isdisjoint(self._shortened(word, most))

    def _as_it_is(self, word: str) -> tuple[int, int] | None:
        """The heaviest term that matches without a wrong letter, by one walk along the trie."""
        node, found = self.root, []
        for c in word:
            if c not in node:
                break
            node = node[c]
            if ("end", True) in node:
                found.append(node[("end", True)])
        else:
            if ("end", False) in node:
                found.append(node[("end", False)])
        return (min(found, key=lambda i: (-self.terms[i].weight, i)), 0) if found else None

    def search(self, word: str) -> tuple[int, int] | None:
        """The best (term, wrong letters) for a word, by running the word's Levenshtein automaton along the trie.

        A state of the automaton is a set of (letters read, errors so far); children whose state is empty are cut off. Fewest
        errors win, then the heaviest term."""
        best: tuple[int, float, int] | None = None
        most = self.edits(len(word) + 1)
        n = len(word)

        def closed(state: dict[int, int]) -> dict[int, int]:
            for i in sorted(state):  # leaving out letters of the word
                for j in range(i + 1, min(n, i + most - state[i]) + 1):
                    e = state[i] + j - i
                    if e <= most and e < state.get(j, most + 1):
                        state[j] = e
            return state

        stack = [(self.root, closed({0: 0}), 0)]
        while stack:
            node, state, depth = stack.pop()
            for key, child in node.items():
                if isinstance(key, tuple):
                    errors = state.get(depth, 1) if key[1] else state.get(n, most + 1)
                    if errors <= (0 if key[1] else min(most, self.edits(depth))):
                        found = (errors, -self.terms[child].weight, child)
                        if best is None or found < best:
                            best = found
                    continue
                now: dict[int, int] = {}
                for i, e in state.items():
                    steps = [(i + 1, e)] if i < n and word[i] == key else []
                    if e < most:
                        steps += [(i, e + 1), (i + 1, e + 1)] if i < n else [(i, e + 1)]
                    for j, f in steps:
                        if f < now.get(j, most + 1):
                            now[j] = f
                if now:
                    stack.append((child, closed(now), depth + 1))
        return (best[2], best[0]) if best else None

    def find(self, token: str) -> tuple[int, int] | None:
        """search() for a lower-case token without the signs around it and with look-alikes read as letters: first for the word as
        it is, then with wrong letters."""
        word = token if token.isalpha() else token.strip(_EDGES)
        if not word.isalpha():
            word = word.translate(LOOKALIKES)
        if not word:
            return None
        return self._as_it_is(word) or (self.search(word) if self._may_match(word) else None)


_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$") + QUOTE_SIGNS + "…–—¿¡"


def densest(at: list[int]) -> int:
    """The most of these ascending places that lie within DENSE words."""
    most = first = 0
    for k, b in enumerate(at):
        while b >= at[first] + DENSE:
            first += 1
        most = max(most, k + 1 - first)
    return most


def text_features(text: str, lexicon: Lexicon) -> list[float]:
    """FEATURES of one whole text."""
    memory = lexicon.memory
    words = text.lower().split()
    if not words:
        return [0.0] * len(FEATURES)
    if len(memory) > REMEMBERED:
        memory.clear()
    for w in set(words).difference(memory):
        memory[w] = lexicon.find(w)
    hits = [(i, f) for i, f in enumerate(map(memory.__getitem__, words)) if f is not None]
    exact = misspelled = quoted = weight = 0.0
    at = []
    for i, (term, errors) in hits:
        around = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
        own = words[i]
        in_quotes = (own[0] in QUOTE_SIGNS and own[-1] in QUOTE_SIGNS) or any(w.strip(".,:;") in QUOTE_WORDS for w in around) or sum(w[0] in QUOTE_SIGNS or w[-1] in QUOTE_SIGNS for w in around) >= 2
        if in_quotes:
            quoted += 1
            continue
        at.append(i)
        weight += lexicon.terms[term].weight / (1 + errors)
        if errors:
            misspelled += 1
        else:
            exact += 1
    dense = densest(at)
    distinct = len({lexicon.family[memory[words[i]][0]] for i in at})
    return [math.log1p(exact), math.log1p(misspelled), math.log1p(quoted), math.log1p(distinct), math.log1p(dense), math.log1p(weight), math.log1p(len(words)) / 10, 100 * len(at) / (len(words) + 20)]


def _features(batches: Iterator[pa.RecordBatch], terms: list[Term], weights: list[float] | None) -> Iterator[pa.RecordBatch]:
    lexicon = _lexicon(terms)
    for batch in batches:
        rows = [text_features(t or "", lexicon) for t in batch.column(batch.num_columns - 1).to_pylist()]
        x = np.array(rows).reshape(-1, len(FEATURES))
        if weights is None:
            values, names = [pa.array(list(map(list, x)), pa.list_(pa.float64()))], ["features"]
        else:
            z = x @ np.array(weights[1:]) + weights[0]
            values, names = [pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], ["score"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *values], names=[*batch.schema.names[:-1], *names])


_lexicons: dict[int, Lexicon] = {}


def _lexicon(terms: list[Term]) -> Lexicon:
    """The lexicon of these terms, built once per Python process."""
    key = hash(tuple(terms))
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(terms)
    return _lexicons[key]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder modulo 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic and part of at most about `rows` labelled documents that are not held out. Of several rows with one
    doc_id the smallest text counts, and of several labels the larger one."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = saved(known.where(~held_out(F.col("doc_id"))), "toxic-labels")
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = saved(chosen.select(F.col("doc_id").alias("_id"), "toxic"), "toxic-chosen")
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    joined = texts.join(small(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return saved(joined.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).alias("part")), "toxic-training")


def learn_terms(training: DataFrame) -> list[Term]:
    """Words and stems that are much more frequent in toxic texts, with the logarithm of how much more as weight.

    A stem stands for all words that begin with it; longer stems that a chosen shorter stem covers are left out. Words stay beside
    their stems, which match with no wrong letter."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1)))

    def with_stems(w: Column) -> Column:
        return F.array(w, *[F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEM_LETTERS])

    own = F.filter(F.flatten(F.transform("words", with_stems)), lambda t: t.isNotNull())
    terms = training.where("part > 0").select("toxic", words.alias("words")).select("toxic", F.explode(F.array_distinct(own)).alias("term"))
    size = training.where("part > 0").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, other = (size["t"] or 0) + 1.0, size["n"] - (size["t"] or 0) + 1.0
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where(F.col("t") >= TERM_TEXTS)
    ratio = ((F.col("t") + 0.5) / toxic) / ((F.col("n") - F.col("t") + 0.5) / other)
    found = counts.select("term", ratio.alias("ratio")).where(F.col("ratio") >= TERM_RATIO).collect()
    stems: dict[str, float] = {r["term"][:-1]: r["ratio"] for r in found if r["term"][-1] == "*"}
    chosen: list[Term] = []
    kept: set[str] = set()
    for stem in sorted(stems, key=len):
        if not any(stem[:n] in kept for n in STEM_LETTERS):
            kept.add(stem)
            chosen.append(Term(stem, True, round(math.log(stems[stem]), 4)))
    for r in found:
        w = r["term"]
        if w[-1] != "*":
            chosen.append(Term(w, False, round(math.log(r["ratio"]), 4)))
    return sorted(chosen)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> list[float]:
    """Intercept and weights of a ridge-penalised logistic regression, by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        gradient = a.T @ (y - p) - penalty * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """A toxicity score for each document, learned from labels of rows that are not held out.

    The lexicon (words and stems) and the weights come from at most about `rows` labelled documents. Every document's whole
    text is scored: each distinct word is looked up by its Levenshtein automaton in the lexicon's trie, hits inside quotes
    or next to words of quoting are counted apart, and hits that stand close together count as such. A score uses the
    text alone.

    documents: doc_id, text; labels: doc_id, toxic. Returns doc_id, held_out, score (0 to 1) and predicted (1 if
    score >= 0.5). Null, empty and blank texts get the score of a text without hits; repeated rows are scored each; with no
    labels, or labels of one kind, every score is the share of toxic labels (0 without any). An empty table gives no
    rows. Other columns are ignored.
    """
    small_batches(documents.sparkSession)
    training = training_rows(documents, labels, rows)
    kind = documents.schema["doc_id"].dataType.simpleString()
    terms = learn_terms(training)
    lessons = training.where("part = 0").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    known = lessons.mapInArrow(partial(_features, terms=terms, weights=None), f"doc_id {kind}, toxic int, features array<double>").select("toxic", "features").collect()
    x = np.array([r["features"] for r in known]).reshape(-1, len(FEATURES))
    y = np.array([r["toxic"] for r in known], float)
    if len(set(y.tolist())) == 2:
        weights = fit_weights(x, y)
    else:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        weights = [math.log(share / (1 - share))] + [0.0] * len(FEATURES)
    slim = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(partial(_features, terms=terms, weights=weights), f"doc_id {kind}, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
