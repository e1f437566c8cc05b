"""Similar titles: an exact similarity join of blocks of near lengths, and leader clustering in rounds of joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .tables import saved

#: Titles match from this ratio on.
MIN_RATIO = 88.0
#: Titles and letters of a block at most; few titles make BLOCKS blocks or so, of LEAST_ROWS titles or more.
BLOCK_ROWS, LETTERS, BLOCKS, LEAST_ROWS = 4096, 1 << 20, 32, 64
#: Bands of lengths within the largest ratio of two similar titles' lengths.
BANDS = 3
#: Kinds of letters that are counted; pairs whose numbers of letters, and whose subsequences, are compared at once.
CLASSES, TILE, CHUNK = 32, 1 << 18, 1 << 14


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over one of the strings."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        both = row & masks.get(c, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def title_ratio(a: str, b: str) -> float:
    """100 for equal strings, 0 for strings without a common character: twice the common subsequence over both lengths."""
    total = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / total if total else 100.0


def _letter_codes(titles: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of titles; row, place and number (from 1, in letters) of each of their letters."""
    n = np.array([len(t) for t in titles], dtype=np.int64)
    row = np.repeat(np.arange(len(titles)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return n, row, place, np.searchsorted(letters, _code_points(titles)) + 1


def _code_points(titles: list[str]) -> np.ndarray:
    return np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _common_lengths(masks: list[np.ndarray], at: np.ndarray, texts: np.ndarray, j: np.ndarray, n2: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of longest common subsequences of many pairs at once, as lcs_length() does one: (which pairs, their lengths), those below
    need left out. masks: for each 64 letters of the first titles, the places of letter c at [at + c]; texts[i, j]: letter i of text j."""
    left, row, zero = np.arange(len(at)), [np.full(len(at), ~np.uint64(0)) for _ in masks], np.zeros(len(at), dtype=np.int64)
    for i in range(int(n2.max(initial=0))):
        place, carry = at[left] + texts[i, j[left]], None
        for w, mask in enumerate(masks):
            old, both = row[w], row[w] & mask[place]
            total = old + both
            over = total < old
            if carry is not None:
                total += carry
                over |= total < carry
            row[w], carry = total | (old - both), over.astype(np.uint64)
        if i % 16 == 15 or i + 1 == n2.max():
            zero = sum(64 - np.bitwise_count(x).astype(np.int64) for x in row)
            keep = zero + np.maximum(n2[left] - i - 1, 0) >= need[left]
            if not keep.all():
                left, row, zero = left[keep], [x[keep] for x in row], zero[keep]
    return left, zero


def similar_in_blocks(first: list[str], second: list[str] | None, min_ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j and ratio of all pairs of titles that reach the ratio, one of first and one of second; without second, i < j of first.

    Lengths and numbers of letters bound the common subsequence and leave few pairs, whose subsequence is computed. Pairs are looked at in
    tiles of TILE, so memory depends on the titles, not on their pairs."""
    r = min_ratio / 100.0
    order = np.argsort([len(t) for t in first], kind="stable")
    order2 = order if second is None else np.argsort([len(t) for t in second], kind="stable")
    one, two = [first[k] for k in order], [(first if second is None else second)[k] for k in order2]
    letters, number = np.unique(np.concatenate([_code_points(one), _code_points(two)]), return_counts=True)
    n, row, place, code = _letter_codes(one, letters)
    n2, row2, place2, code2 = _letter_codes(two, letters)
    longest = int(max(n.max(initial=0), n2.max(initial=0)))
    if longest == 0:
        return np.array([], dtype=int), np.array([], dtype=int), np.array([])
    # The most frequent letters are counted each, the others together.
    kinds = min(CLASSES, len(letters))
    kind = np.empty(len(letters) + 1, dtype=np.int64)
    kind[1 + np.argsort(-number, kind="stable")] = np.minimum(np.arange(len(letters)), kinds - 1)
    counted = np.min_scalar_type(longest)
    profile, profile2 = (np.bincount(x * kinds + kind[c], minlength=kinds * m).reshape(m, kinds).T.astype(counted) for x, c, m in ((row, code, len(n)), (row2, code2, len(n2))))
    texts = np.zeros((int(n2.max(initial=0)), len(n2)), dtype=np.min_scalar_type(len(letters)))
    texts[place2, row2] = code2
    words, size = int(n.max(initial=0)) // 64 + 1, len(letters) + 1
    tile, span = max(1, TILE // max(1, len(n2))), max(1, LETTERS * 4 // (size * words))
    found: list[tuple[np.ndarray, ...]] = []

    def decide(i: np.ndarray, j: np.ndarray) -> None:
        left, lcs = _common_lengths(masks, (i - start) * size, texts, j, n2[j], r * (n[i] + n2[j]) / 2 - 1e-6)
        i, j = i[left], j[left]
        ratio = 100.0 * 2 * lcs / (n[i] + n2[j])
        keep = ratio >= min_ratio
        found.append((order[i[keep]], order2[j[keep]], ratio[keep]))

    for start in range(0, len(n), span):
        stop = min(start + span, len(n))
        within = (row >= start) & (row < stop)
        where, bit, word = (row[within] - start) * size + code[within], np.left_shift(np.uint64(1), (place[within] % 64).astype(np.uint64)), place[within] // 64
        masks = [np.zeros((stop - start) * size, dtype=np.uint64) for _ in range(words)]
        for w in range(words):
            np.bitwise_or.at(masks[w], where[word == w], bit[word == w])
        waiting, waits = [], 0
        for begin in range(start, stop, tile):
            end = min(begin + tile, stop)
            low, high = int(np.searchsorted(n2, n[begin] * r / (2 - r) - 1e-6, "left")), int(np.searchsorted(n2, n[end - 1] * (2 - r) / r + 1e-6, "right"))
            low = max(low, begin + 1) if second is None else low
            if low < high:
                common, least = np.zeros((end - begin, high - low), dtype=counted), np.empty((end - begin, high - low), dtype=counted)
                for x, y in zip(profile, profile2):
                    common += np.minimum(x[begin:end, None], y[None, low:high], out=least)
                needed = np.maximum(np.ceil(r * (n[begin] + n2[low:high]) / 2 - 1e-6), 0).astype(counted)
                i, j = np.divmod(np.flatnonzero(common >= needed), high - low)
                shared, i, j = common[i, j], i + begin, j + low
                keep = shared >= r * (n[i] + n2[j]) / 2 - 1e-6
                if second is None:
                    keep &= i < j
                waiting.append((i[keep], j[keep]))
                waits += len(waiting[-1][0])
            if waiting and (waits >= CHUNK or end == stop):
                i, j = (np.concatenate(x) for x in zip(*waiting))
                for k in range(0, len(i), CHUNK):
                    decide(i[k : k + CHUNK], j[k : k + CHUNK])
                waiting, waits = [], 0
    i, j, ratio = (np.concatenate(x) for x in zip(*found)) if found else (np.array([], dtype=int), np.array([], dtype=int), np.array([]))
    return (np.minimum(i, j), np.maximum(i, j), ratio) if second is None else (i, j, ratio)


def _block_pairs(titles: DataFrame, r: float) -> DataFrame:
    """titles (rep, title, n) in each pair of blocks (block, block2) that they are compared in: side 0 is block's, side 1 block2's; a block's
    titles meet each other where both are the same.

    A block has titles of one band of lengths, dealt by their ids, so a frequent length or word makes more blocks, not larger ones. A title
    is entered in the blocks of those bands only that titles of the ratio can be in."""
    step = (2 - r) / r  # a similar title is at most so many times as long
    band = lambda n: F.floor(F.lit(BANDS) * F.log(n) / F.lit(math.log(step)) + F.lit(1e-9)).cast("int")
    n = F.col("n").cast("double")
    banded = titles.withColumn("band", band(n))
    sizes = saved(banded.groupBy("band").agg(F.count("*").alias("rows"), F.sum("n").alias("letters")), "title-bands")
    rows = max(LEAST_ROWS, min(BLOCK_ROWS, (sizes.agg(F.sum("rows")).first()[0] or 0) // BLOCKS))
    sizes = sizes.select("band", F.ceil(F.greatest(F.col("rows") / rows, F.col("letters") / LETTERS)).alias("blocks"))
    block = lambda band, k: F.col(band).cast("long") * (1 << 32) + k
    others = sizes.select(F.col("band").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k")).select("other", block("other", F.col("k")).alias("near"))
    own = banded.join(F.broadcast(sizes), "band").select(
        "rep", "title", block("band", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("own"), F.explode(F.sequence(band(n / step * (1 - 1e-9)), band(n * step * (1 + 1e-9)))).alias("other")
    )
    met = own.join(F.broadcast(others), "other")
    return met.select(F.least("own", "near").alias("block"), F.greatest("own", "near").alias("block2"), (F.col("own") > F.col("near")).cast("int").alias("side"), "rep", "title")


def title_pairs(kinds: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """All pairs (rep, rep2, ratio) of distinct titles (rep: an id, title) that reach the ratio; rep < rep2.

    Titles of near lengths are compared in pairs of blocks, one pair of blocks at a time. Titles of less than two characters are similar to no
    other title.
    """
    if min_ratio < 86:
        raise ValueError("min_ratio must be at least 86")
    titles = saved(kinds.select("rep", "title", F.length("title").alias("n")).where("n > 1"), "titles")
    kind = titles.schema["rep"].dataType

    def compared(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        one, two = (frame[frame["side"] == side] for side in (0, 1))
        i, j, ratio = similar_in_blocks(one["title"].tolist(), None if key[0] == key[1] else two["title"].tolist(), min_ratio)
        two = one if key[0] == key[1] else two
        return pd.DataFrame({"x": one["rep"].to_numpy()[i], "y": two["rep"].to_numpy()[j], "ratio": ratio})

    schema = StructType([StructField("x", kind), StructField("y", kind), StructField("ratio", DoubleType())])
    found = _block_pairs(titles, min_ratio / 100.0).groupBy("block", "block2").applyInPandas(compared, schema)
    return saved(found.select(F.least("x", "y").alias("rep"), F.greatest("x", "y").alias("rep2"), "ratio"), "title-pairs")


def title_groups(titles: DataFrame) -> DataFrame:
    """The smallest id of each title: (rep, title). Null titles and ids are left out, rows that repeat count once."""
    return titles.where("title is not null and id is not null").groupBy("title").agg(F.min("id").alias("rep")).select("rep", "title")


def similar_titles(titles: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Pairs (a, b, ratio) of ids whose titles reach the ratio; a < b: between the smallest ids of two titles, and from the smallest id of a
    title to each other id of it (ratio 100). So copies of a title are linked to it once each, not with all copies of similar titles.

    titles: id (orderable), title. Below a ratio of 0.86 the shortest titles need not share a gram of two letters, so it is not allowed.
    Null titles match nothing. Rows that repeat an id count once, with the first of its titles in order.
    """
    # Saved first, since conditions on a title would work it out again from the whole text that it comes from.
    titles = saved(titles.select("id", "title"), "given-titles")
    unique = titles.where("title is not null and id is not null").groupBy("id").agg(F.min("title").alias("title"))
    kinds = saved(title_groups(unique), "title-groups")
    pairs = title_pairs(kinds, min_ratio).select(F.col("rep").alias("a"), F.col("rep2").alias("b"), "ratio")
    same = unique.join(kinds, "title").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(100.0).alias("ratio"))
    return pairs.unionByName(same)


def leaders(items: DataFrame, pairs: DataFrame, max_rounds: int = 50) -> DataFrame:
    """The leader of each item: (id, leader).

    items: id, in the order of arrival; pairs: a < b. An item is a leader unless an earlier leader is paired with it; others
    follow the earliest such leader. Rounds: undecided items without an earlier undecided or leading neighbour lead, then
    their later neighbours follow. Each round works on what is undecided; raises RuntimeError rather than stopping early.
    """
    pairs = saved(pairs.select("a", "b").distinct(), "pairs")
    state = saved(items.select("id", F.lit(None).cast("boolean").alias("leads")), "leaders")
    open_ = pairs
    for _ in range(max_rounds):
        earlier = open_.join(state.select(F.col("id").alias("a"), F.col("leads").alias("la")), "a").join(state.select(F.col("id").alias("b"), F.col("leads").alias("lb")), "b").where("lb is null")
        earlier = saved(earlier, "undecided-pairs")
        open_ = earlier.select("a", "b")
        seen = earlier.groupBy("b").agg(F.max(F.col("la").isNull()).alias("open"), F.max(F.coalesce("la", F.lit(False))).alias("led"))
        now = state.join(seen, F.col("id") == F.col("b"), "left").select(
            "id",
            F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True).alias("leads"),
        )
        state = saved(now, "leaders")
        if state.where("leads is null").isEmpty():
            break
    else:
        raise RuntimeError(f"leaders did not settle in {max_rounds} rounds")
    first = pairs.join(state.where("leads").select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("leader"))
    return state.join(first, F.col("id") == F.col("b"), "left").select("id", F.when(F.col("leads"), F.col("id")).otherwise(F.col("leader")).alias("leader"))
