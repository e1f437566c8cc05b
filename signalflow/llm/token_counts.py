"""Token counts by source, language and tokenizer version, kept up to date by signed deltas."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.models import BPE

from .common import new_path, small_batches
from .mixing import word_count
from .tokens import _OTHER_SPACE, _PLAIN_MODEL, CACHED_CHARS, GENERATION_WORDS, tokenizer

GROUP = ["source", "lang", "tokenizer"]

#: The normalizer and the splitting rule of vocabularies that drop white space, under which words can be counted one by one.
_FOLD = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_FOLD_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Letters (isalpha() is asked too) with ASCII punctuation after them, and the line feed before.
_LETTERS = re.compile(r"(\n?)([^\W\d_]+)([!-/:-@\[-`{-~]*)")
#: Bits of one version's count in a number that holds those of all, and a count that no text has.
BITS, NEVER = 80, 1 << 40


def _words(text: str) -> list[str]:
    """What stands between single spaces; a word that begins the text or a line has a line feed before it."""
    words = text.replace("\n", " \n").split(" ")
    words[0] = "\n" + words[0]
    return words


class _Vocabulary:
    """Numbers of tokens of single words (as _words gives them), NEVER if they depend on the words around: where a vocabulary keeps
    white space, at white space of other kinds or more than one between words, and at strings of special tokens. Vocabularies
    with another normalizer, splitting rule or model than the two known ones count no word by itself."""

    def __init__(self, path: str):
        self.own = tokenizer(path)
        whole = self.own.tokenizer
        model = {k: v for k, v in _PLAIN_MODEL.items() if k != "end_of_word_suffix"}
        rules = [part and json.loads(part.__getstate__()) for part in (whole.normalizer, whole.pre_tokenizer)]
        single = whole.truncation is None and not any(t.normalized or t.content.isalpha() or re.search(r"\s", t.content) for t in whole.get_added_tokens_decoder().values())
        self.folds = single and rules == [_FOLD, _FOLD_SPLIT] and isinstance(self.own.model, BPE) and all(getattr(self.own.model, k) == v for k, v in model.items())
        self.by_words = self.folds or (single and self.own.by_words)
        self.line_feed = len(self.own.line_feed) // 4

    def whole(self, text: str) -> int:
        return len(self.own.whole(text)) // 4

    def letters(self, first: str, word: str) -> int:
        """Tokens of a word of letters only, after a line feed (first) or a space: by the BPE model alone."""
        if not self.by_words:
            return NEVER
        if self.folds and not word.isascii() and max(word) > "\xff":  # past Latin-1, folding takes more than lower()
            return self.whole(word)
        piece = word.lower() if self.folds else word
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.own.letters)
        if not first and not self.folds:
            piece = self.own.letters[32] + piece
        return self.line_feed * len(first) + len(self.own.model.tokenize(piece))

    def other(self, word: str) -> int:
        if self.folds:
            return self.whole(word)
        body = word.removeprefix("\n")
        if not self.by_words or not body or _OTHER_SPACE.search(body) or any(s in body for s in self.own.special):
            return NEVER
        return self.whole(word if body != word else " " + word)


class WordCounts(dict[str, int]):
    """Numbers of tokens of words by some vocabularies, BITS apart in one number, so a word is looked up once for all of them. A word is
    counted when it is first looked up: punctuation after letters by itself, so letters are encoded once whatever follows them.
    Two generations of words are held, so the size is bounded and frequent words stay."""

    def __init__(self, paths: Iterable[str]):
        super().__init__()
        self.vocabularies = [_Vocabulary(p) for p in paths]
        self.special = {s for v in self.vocabularies for s in v.own.special}
        self.start = self._joined(v.line_feed * v.by_words for v in self.vocabularies)
        self.old: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        self.same: dict[int, int] = {}

    def _joined(self, counts: Iterable[int]) -> int:
        return sum(n << (BITS * i) for i, n in enumerate(counts))

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self._count(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= GENERATION_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = n = self.same.setdefault(n, n)
        return n

    def _count(self, word: str) -> int:
        found = _LETTERS.fullmatch(word)
        if not found or not found[2].isalpha() or (found[3] and any(s in word for s in self.special)):
            return self._joined(v.other(word) for v in self.vocabularies)
        first, stem, end = found.groups()
        return self[first + stem] + self._end(end) if end else self._joined(v.letters(first, stem) for v in self.vocabularies)

    def _end(self, end: str) -> int:
        n = self.ends.get(end)
        if n is None:
            n = self._joined(v.whole(end) for v in self.vocabularies)
            if len(self.ends) < 10_000 and len(end) <= CACHED_CHARS:
                self.ends[end] = n
        return n

    def totals(self, text: str | None) -> list[int]:
        """Numbers of tokens of a text by each vocabulary."""
        if not text:
            return [0] * len(self.vocabularies)
        n = sum(map(self.__getitem__, _words(text))) - self.start if any(v.by_words for v in self.vocabularies) else 0
        found = [n >> (BITS * i) & ((1 << BITS) - 1) for i in range(len(self.vocabularies))]
        return [k if v.by_words and k < NEVER // 2 else v.whole(text) for v, k in zip(self.vocabularies, found)]


#: Counts of words are kept in a Python process from task to task.
_counts = cache(WordCounts)


def _counter(path: str):
    """The number of tokens of a text by one vocabulary."""
    return lambda text: _counts((path,)).totals(text)[0]


def _lengths(batches: Iterator[pa.RecordBatch], paths: dict[str, str]) -> Iterator[pa.RecordBatch]:
    known = _counts(tuple(paths.values()))
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for version, n in zip(paths, zip(*map(known.totals, texts))):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([version] * len(texts)), pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "tokenizer", "tokens"])


def bpe_counts(documents: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Counts (doc_id, source, lang, tokenizer, tokens) of whole texts, a row for each tokenizer version, by its vocabulary file in
    paths. All versions count in one pass over the texts. Null and empty texts have 0; an empty table gives no rows."""
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    slim = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(partial(_lengths, paths=paths), f"doc_id {kind}, source string, lang string, tokenizer string, tokens long")


def inserted(counts: DataFrame) -> DataFrame:
    """Signed changes that add these counts (source, lang, tokenizer, tokens)."""
    return counts.select(*GROUP, F.lit(1).alias("sign"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Signed changes that take these counts away."""
    return inserted(counts).withColumn("sign", F.lit(-1))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes that replace old counts by new ones of the same documents; a revision may also move a document to another
    source, language or tokenizer version. Nothing is joined: what did not change cancels out in the sums."""
    return deleted(old).unionByName(inserted(new))


class TokenRollup:
    """Additive totals of documents and tokens per source, language and tokenizer version, in a shared folder.

    apply() adds a batch of signed changes under its name. Its sums are written first and its commit mark after them, so a
    batch whose writer was lost counts for nothing until it is applied again, which replaces what was left; a batch that is
    committed is never added twice. compact() merges the committed batches into one and remembers their names in its own mark.
    Each group's changes are summed before they are shuffled. Nulls in source, lang and tokenizer are groups of their own.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "token-rollup")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str) -> str:
        return "/".join((self.path, *names))

    def _exists(self, path: str) -> bool:
        return self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def _names(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(folder))
        if not self._files.exists(path):
            return []
        found = [s.getPath().getName() for s in self._files.listStatus(path)]
        return sorted(n for n in found if self._exists(self._at(folder, n, "_SUCCESS")))

    def _mark(self, name: str, merged: list[str]) -> None:
        rows = [(m,) for m in merged] or [("",)]
        self.spark.createDataFrame(rows, "merged string").coalesce(1).write.mode("overwrite").parquet(self._at("commits", name))

    def _merged(self, marks: list[str]) -> tuple[str | None, set[str]]:
        """The last merge, and the names of all batches that it holds; those of earlier merges are among them."""
        last = max((m for m in marks if m.startswith("merge-")), key=lambda m: int(m[6:]), default=None)
        return last, {r[0] for r in self.spark.read.parquet(self._at("commits", last)).collect()} if last else set()

    def committed(self) -> list[str]:
        """Names of all batches that count."""
        marks = self._names("commits")
        return sorted({*(m for m in marks if not m.startswith("merge-")), *self._merged(marks)[1]} - {""})

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Add the changes (source, lang, tokenizer, sign, tokens) as the batch of that name; False if it was there already."""
        if not re.fullmatch(r"[\w.-]+", batch) or batch.startswith("merge-"):
            raise ValueError("a batch name has letters, digits, '_', '.' and '-', and does not begin with merge-")
        if batch in self.committed():
            return False
        sums = changes.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        sums.write.mode("overwrite").parquet(self._at("deltas", batch))
        self._mark(batch, [])
        return True

    def _live(self) -> list[str]:
        """The folders that make up the totals: the last merge, and batches that it does not hold."""
        marks = self._names("commits")
        last, held = self._merged(marks)
        return [last] * bool(last) + [m for m in marks if not m.startswith("merge-") and m not in held]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens over all committed batches; groups whose sums are both 0 are left out."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        live = [self._at("deltas", n) for n in self._live()]
        rows = self.spark.read.schema(schema).parquet(*live) if live else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Merge all committed batches into one folder."""
        names = self.committed()
        last = max((int(m[6:]) for m in self._names("commits") if m.startswith("merge-")), default=0)
        name = f"merge-{last + 1}"
        self.totals().write.mode("overwrite").parquet(self._at("deltas", name))
        self._mark(name, names)


def word_and_byte_counts(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, parts (between single spaces, a first guess), words and bytes of each whole text; null has 0."""
    text = F.col("text").cast("string")
    return documents.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1), F.lit(0)).cast("long").alias("parts"),
        word_count(text).alias("words"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
    )
