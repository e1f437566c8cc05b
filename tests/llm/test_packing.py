import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from signalflow.llm import packing, token_counts, tokens
from signalflow.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é,.!?'’\n\t 1Ünit\x00|#$🙂中<>endoftext"), max_size=60))
def test_word_cache_equals_the_library(text):
    t = Tokenizer.from_file(PATH)
    assert np.frombuffer(tokens.tokenizer(PATH).encode(text), "<u4").tolist() == ids_of(t, text)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "x<|endoftext|>y", "<|endoftext|>", "a. <|endoftext|><|endoftext|>\nb", "<|ENDOFTEXT|> <|endoftext", "q" * 5000, "long " + "xyz-" * 4000 + " end"])
def test_special_strings_and_long_words_as_in_the_library(text, plain):
    own = tokens.CachedTokenizer(PATH)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids_of(plain, text)
    assert all(len(w) <= tokens.CACHED_CHARS for w in own.new)


def test_other_vocabularies_are_encoded_whole(tmp_path):
    texts = ["Hello  world, it's 12 o'clock", "a b", "É é\n\nx", " lead", "", "<|endoftext|> a"]
    assert tokens.CachedTokenizer(PATH).by_words
    changes = [("pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True)), ("pre_tokenizer", pre_tokenizers.Sequence([pre_tokenizers.Digits(True), pre_tokenizers.ByteLevel(add_prefix_space=False)])), ("normalizer", normalizers.Lowercase())]
    for i, (name, value) in enumerate(changes):
        other = Tokenizer.from_file(PATH)
        setattr(other, name, value)
        other.save(f"{tmp_path}/{i}.json")
        own = tokens.CachedTokenizer(f"{tmp_path}/{i}.json")
        assert not own.by_words
        for text in texts:
            assert np.frombuffer(own.encode(text), "<u4").tolist() == ids_of(other, text)


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_pieces_round_trip(table, request, plain):
    frame = request.getfixturevalue(table)
    rows = packing.pack(frame, PATH, keep_ids=True).collect()
    want = defaultdict(list)
    for r in frame.select("doc_id", "text").collect():
        want[r.doc_id].append(ids_of(plain, r.text) + [2])
    got = defaultdict(lambda: defaultdict(list))
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 1024 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        got[r.doc_id][r.piece].append((r.start, ids))
    for i, texts in want.items():
        if len(texts) > 1:  # rows that share an id
            assert sum(len(x) for p in got[i].values() for _, x in p) == sum(map(len, texts))
            continue
        whole, at = [], 0
        for k in range(len(got[i])):
            ((start, ids),) = got[i][k]
            assert start == at and (k == 0 or len(ids) == 1024)
            whole += ids
            at += len(ids)
        assert whole == texts[0]
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def plain_best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_all_pieces_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(128, rng.geometric(0.02, 1500) + rng.integers(0, 40, 1500))
    histogram = np.bincount(lengths, minlength=129)
    plan = packing.plan_packing(histogram, steps=200)
    used = np.bincount(np.concatenate([np.repeat(p, n) for p, n in plan]), minlength=129)
    assert (used == histogram).all() and all(sum(p) <= 128 for p, _ in plan)
    assert sum(n for _, n in plan) <= plain_best_fit(lengths.tolist(), 128)


def test_fit_reaches_an_exact_histogram():
    patterns = packing.length_patterns(32)
    histogram = np.zeros(33)
    for p, n in (((20, 12, 0), 40), ((10, 11, 11), 60)):
        for v in p:
            histogram[v] += n * (v > 0)
    x = packing.fit_patterns(histogram, patterns, 3000)
    assert abs(np.bincount(patterns.ravel(), weights=np.repeat(x, 3), minlength=33)[1:] - histogram[1:]).max() < 1


def test_rollup(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a b", "en", "s", "c" * 5), (2, None, None, "s", ""), (3, "", "en", None, "x")], "doc_id long, text string, lang string, source string, tokens string")
    counts = token_counts.bpe_counts(frame, {"v1": PATH})
    roll = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    assert roll.totals().count() == 0
    assert roll.apply("one", token_counts.inserted(counts)) and not roll.apply("one", token_counts.inserted(counts))
    more = counts.withColumn("tokens", counts["tokens"] + 10)
    roll.apply("two", token_counts.revised(counts, more))
    totals = lambda: sorted(((r.source, r.lang, r.docs, r.tokens) for r in roll.totals().collect()), key=str)
    want = sorted([("s", "en", 1, 12), ("s", None, 1, 10), (None, "en", 1, 10)], key=str)
    assert totals() == want
    # a batch that was written but not committed counts for nothing, and is replaced
    token_counts.inserted(counts).groupBy("source", "lang", "tokenizer").count().write.parquet(roll._at("deltas", "three"))
    assert totals() == want
    roll.compact()
    assert totals() == want and not roll.apply("two", token_counts.inserted(counts)) and roll.committed() == ["one", "two"]
    roll.apply("three", token_counts.deleted(more))
    assert totals() == []
