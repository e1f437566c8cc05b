"""Token ids of whole texts by a byte-level BPE vocabulary file of the tokenizers library, with a cache of words."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

from tokenizers import Tokenizer
from tokenizers.models import BPE

#: Words in each of the two generations of a Python worker's cache, and characters of a word from which on it is not kept: so
#: the cache has a bounded number of bytes.
GENERATION_WORDS, CACHED_CHARS = 250_000, 64
#: The splitting rule and the settings of a BPE model under which words can be encoded one by one.
_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_PLAIN_MODEL = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
#: White space other than single spaces and line feeds between other characters: such texts are encoded as a whole.
_OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WIDE_GAPS = ("  ", "\n\n", " \n", "\n ")
_PUNCTUATION = ".,;:!?"
#: Marks a text's first word, which has no space before it.
_START = "\x00"


def _bytes_of(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class CachedTokenizer:
    """Encodes texts word by word.

    The vocabulary's splitting rule never joins characters across a single space between two others (the space begins the
    next piece), nor letters with the punctuation after them. So each word, with the space before it, is encoded once by
    the tokenizers library and reused: words of letters by its BPE model alone, other ones by the whole tokenizer. Texts
    with wider gaps, and texts in which the string of a special token occurs, are handed to it whole; the library reads such a
    string as that token. The cache holds two generations of words, so its size is bounded and frequent words stay. Vocabularies with
    another splitting rule, a normalizer or other settings of the model encode every text whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = self._splits_at_spaces()
        # A byte's character in the vocabulary, as the library writes it.
        self.letters = self._byte_letters()
        self.line_feed = self.whole("\n")
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the cache: words are encoded anew when they come again."""
        self.new, self.old, self.ends = {}, {}, {}

    def _splits_at_spaces(self) -> bool:
        split = self.tokenizer.pre_tokenizer
        rule = json.loads(split.__getstate__()) if split is not None else {}
        plain = isinstance(self.model, BPE) and all(getattr(self.model, k) == v for k, v in _PLAIN_MODEL.items())
        return self.tokenizer.normalizer is None and {k: rule.get(k) for k in _SPLIT} == _SPLIT and plain

    def _byte_letters(self) -> dict[int, str]:
        """Byte-level vocabularies write printable Latin-1 characters as they are, other bytes as characters from 256 on."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = [b for b in range(256) if b not in plain]
        return {b: chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)}

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library alone."""
        return _bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if "\n" in word:  # a line feed between two words is a piece of its own
            first, *rest = word.split("\n")
            return self._known(first) + b"".join(self.line_feed + self._known(_START + r) for r in rest)
        text = word[1:] if word[:1] == _START else " " + word
        bare = text.lstrip(" ")
        if bare.isalpha():
            letters = text.replace(" ", self.letters[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            return _bytes_of([t.id for t in self.model.tokenize(letters)])
        stem = word.rstrip(_PUNCTUATION)
        if len(stem) < len(word) and stem[-1:].isalpha():
            end = word[len(stem) :]
            if end not in self.ends and len(self.ends) < 10_000:
                self.ends[end] = self.whole(end)
            return self._known(stem) + (self.ends.get(end) or self.whole(end))
        return self.whole(text) if text else b""

    def _known(self, word: str) -> bytes:
        found = self.new.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self._word(word)
            if len(word) <= CACHED_CHARS:
                if len(self.new) >= GENERATION_WORDS:
                    self.old, self.new = self.new, {}
                self.new[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if not self.by_words or _START in text or text[0] in " \n" or text[-1] in " \n" or any(g in text for g in _WIDE_GAPS) or _OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        words = text.split(" ")
        words[0] = _START + words[0]
        found = list(map(self.new.get, words))
        if None in found:
            found = [self._known(w) if f is None else f for w, f in zip(words, found)]
        return b"".join(found)


_loaded: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """The tokenizer of that file, loaded once per Python process."""
    if path not in _loaded:
        _loaded[path] = CachedTokenizer(path)
    return _loaded[path]
