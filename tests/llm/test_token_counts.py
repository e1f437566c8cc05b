import re
from collections import Counter
from functools import cache

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer, normalizers, pre_tokenizers

from signalflow.llm import queries, token_counts, tokens

VERSIONS = ("byte_bpe_50k", "word_bpe_49k")


def library(version):
    t = Tokenizer.from_file(queries.tokenizer_path(f"{version}.json"))
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_query_counts_tokens_of_two_vocabularies(spark, sf_dir, docs):
    rows, docs_of, tokens_of = docs.select("source", "lang", "text").collect(), Counter(), Counter()
    for v in VERSIONS:
        count = library(v)
        for r in rows:
            if n := count(r.text):
                docs_of[r.source, r.lang, v] += 1
                tokens_of[r.source, r.lang, v] += n
    found = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in queries.queries()["op8_token_counts"](spark, sf_dir).collect()}
    assert found == {k: (docs_of[k], tokens_of[k]) for k in docs_of}


def test_white_space_and_odd_texts_count_as_in_the_library():
    texts = [None, "", " ", "It's  a\tTEST\n\nof gaps", "á ́b é", "x\x1cy !\x1f! \x00", "ΟΔΟΣ İstanbul ẞ", "<|startoftext|> hi <|endoftext|>", "...\n...\r\n12 345", "\u0085a b"]
    for v in VERSIONS:
        count, own = token_counts._counter(queries.tokenizer_path(f"{v}.json")), library(v)
        assert [count(t) for t in texts] == [own(t) for t in texts]


def test_letters_are_encoded_by_the_model_alone_whatever_follows_them(monkeypatch):
    seen, whole = [], tokens.CachedTokenizer.whole
    monkeypatch.setattr(tokens.CachedTokenizer, "whole", lambda self, text: seen.append(text) or whole(self, text))
    text = " ".join(f"{a}q{b}é{c}{end}" for a in "abcdefgh" for b in "stuvwx" for c in "Yz" for end in ("", ",", "%%%", ".\nOf"))
    for v in VERSIONS:
        token_counts._counter(queries.tokenizer_path(f"{v}.json"))("load")
        seen.clear()
        assert token_counts._counter(queries.tokenizer_path(f"{v}.json"))(text) == library(v)(text)
        assert len(seen) <= 5


@cache
def library_of(path):
    t = Tokenizer.from_file(path)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


PIECES = ["a", "Zé", "ÀÖ", "ªµº", "ÿß", "ΟΔΟΣ", "İ", "é", "\u0301", "\u0338", "日本", "'s", "'", "'LL", "don't", "12", "²", "_", ".", "<", "|>", "%%%", "–", "<|endoftext|>", "<|startoftext|>"]
GAPS = ["", "", " ", " ", " ", "\n", "  ", " \n", "\n\n", "\t", "\x1c", "\u00a0", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from(GAPS)), max_size=12).map(lambda x: "".join(a + b for a, b in x)))
def test_any_text_counts_as_in_the_library(text):
    paths = [queries.tokenizer_path(f"{v}.json") for v in VERSIONS]
    for t in (text, " " + text, text.replace("  ", " ").strip()):
        assert token_counts._counts(tuple(paths)).totals(t) == [library_of(p)(t) for p in paths]


def test_few_words_are_kept(monkeypatch):
    monkeypatch.setattr(token_counts, "GENERATION_WORDS", 20)
    known, count = token_counts.WordCounts([queries.tokenizer_path("word_bpe_49k.json")]), library("word_bpe_49k")
    for text in (" ".join(f"w{'abcdefghij'[i % 10] * (i // 10 + 1)}," for i in range(90)), "x" * 1000 + " " + "=" * 1000):
        assert known.totals(text) == [count(text)]
        assert len(known) <= 20 and len(known.old) <= 20 and all(len(w) <= tokens.CACHED_CHARS for w in [*known, *known.ends])


def test_other_vocabularies_count_whole_texts(tmp_path):
    texts = ["a b  c", " Lead, end ", "UNK unk a_b\n12", ""]
    changes = [("byte_bpe_50k", "normalizer", normalizers.Strip()), ("byte_bpe_50k", "normalizer", normalizers.Lowercase()), ("word_bpe_49k", "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True))]
    for i, (v, name, value) in enumerate(changes):
        other = Tokenizer.from_file(queries.tokenizer_path(f"{v}.json"))
        setattr(other, name, value)
        other.save(f"{tmp_path}/{i}.json")
    for v in VERSIONS:
        other = Tokenizer.from_file(queries.tokenizer_path(f"{v}.json"))
        other.add_tokens([AddedToken("unk", normalized=False), AddedToken("a b", normalized=True)])
        other.save(f"{tmp_path}/{v}.json")
    for path in tmp_path.iterdir():
        assert [token_counts._counter(str(path))(t) for t in texts] == [library_of(str(path))(t) for t in texts]


def test_word_and_byte_counts(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    want = sorted(((i, (0 if not t else t.count(" ") + 1), len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), len((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.parts, r.words, r.bytes) for r in token_counts.word_and_byte_counts(edge).collect()), key=str) == want
    assert token_counts.word_and_byte_counts(empty).count() == 0
    assert token_counts.bpe_counts(empty, {"v": queries.tokenizer_path("byte_bpe_50k.json")}).count() == 0


def test_many_merges_keep_all_names(spark, tmp_path):
    one = spark.createDataFrame([("s", "en", "v", 3)], "source string, lang string, tokenizer string, tokens long")
    roll = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    for k in range(3):
        assert roll.apply(f"b{k}", token_counts.inserted(one))
        roll.compact()
    assert roll.committed() == ["b0", "b1", "b2"] and not roll.apply("b0", token_counts.inserted(one))
    assert [(r.docs, r.tokens) for r in roll.totals().collect()] == [(3, 9)]
