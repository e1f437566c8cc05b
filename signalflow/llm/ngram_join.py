"""Exact Jaccard self-join of word n-gram sets, and the classes it connects.

Texts are linked when |A and B| / |A or B| reaches the threshold, exactly, for all pairs. What is skipped follows from
relations between sets:

* equal sets are one class before anything else, however many rows share it;
* sets are ordered by one global order of their n-grams (frequent ones last), and only as many leading ones are indexed
  as a partner must share one of (prefix filter);
* n-grams whose lists turn out long, counted over the whole index, go last too, and sets that had them in front are indexed
  again; moving an n-gram back changes no other set's leading ones, so the order stays one order;
* index lists are stored in blocks by size, class and position. A block carries its smallest set and the largest set that
  its positions still allow as a partner; two blocks of a list whose bounds exclude each other, or which hold one class
  only, are skipped without a look at their entries;
* answers of a highly similar set are reused: in each list every set is first checked against one leader. Sets that are
  linked to the leader, directly or through others, have the leader's class; only list entries whose classes still
  differ after that are compared with each other. Inside a class nothing is compared any more, so a group of any size
  costs a number of checks in proportion to its index entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, saved, small, small_batches
from .shingles import chunks, mix64, shingle_sets

#: The threshold in hundredths, and the words of an n-gram.
PERCENT, WORDS = 80, 5
#: N-grams found this often within some hundred texts are candidates for the list of frequent ones.
LOCAL_REPEATS = 3
#: N-grams counted at least this often go last in the global order; of more than FREQUENT_ROWS, the most frequent ones do.
#: Any order gives the same links: this list only keeps index lists short, and so do the rounds of counting whole lists.
FREQUENT_COUNT, FREQUENT_ROWS, ORDER_ROUNDS = 48, 200_000, 2
#: Entries in a block of an index list, and the blocks of one list that a task compares with all its others.
BLOCK, BLOCKS_A_TASK = 128, 32
#: Rounds of comparing list entries with leaders before classes are compared.
LEADER_ROUNDS = 2
#: Entries of one class in a list from which on the class is large, and the number of its representatives there.
LARGE_CLASS = 16


def _lowered(column: pa.Array) -> list[bytes | None]:
    return [t if t is None else t.lower() for t in column.cast(pa.binary()).to_pylist()]


def _digests(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Per row: size and digest of its set; and rows (token, seen) for n-grams that are locally frequent."""
    names = ["doc_id", "row_hash", "n", "d1", "d2", "token", "seen"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    for batch in batches:
        ids, rows = batch.column(0), batch.column(1)
        for at, texts in chunks(_lowered(batch.column(2))):
            sets = shingle_sets(texts, n)
            with np.errstate(over="ignore"):
                d1 = [int(mix64(s.view(np.uint64) ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                d2 = [int(np.bitwise_xor.reduce(mix64(s.view(np.uint64) + np.uint64(77)), initial=np.uint64(0)).view(np.int64)) for s in sets]
            k = len(texts)
            tokens, seen = np.unique(np.concatenate(sets), return_counts=True)
            often = seen >= LOCAL_REPEATS
            tokens, seen = tokens[often], seen[often]
            none = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([x, none(len(tokens), t)]).cast(t)
                    for x, t in zip([ids.slice(at, k), rows.slice(at, k), pa.array([len(s) for s in sets], pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())], types)
                ]
                + [pa.concat_arrays([none(k, pa.int64()), pa.array(tokens, pa.int64())]), pa.concat_arrays([none(k, pa.int32()), pa.array(seen, pa.int32())])],
                names=names,
            )


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, percent: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Index entries (token, set, n, at) of each set: its first n - ceil(percent * n / 100) + 1 n-grams in the global
    order. frequent: the n-grams that come last, sorted by value, with their place among them."""
    values, place = frequent
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for at, texts in chunks(_lowered(batch.column(1))):
            token, owner, size, where = [], [], [], []
            for i, s in enumerate(shingle_sets(texts, n)):
                if not len(s):
                    continue
                if len(values):
                    j = np.searchsorted(values, s)
                    j[j == len(values)] = 0
                    hot = values[j] == s
                    if hot.any():
                        s = np.concatenate((s[~hot], s[hot][np.argsort(place[j[hot]])]))
                k = len(s) - -(-percent * len(s) // 100) + 1
                token.append(s[:k])
                owner.append(np.full(k, ids[at + i]))
                size.append(np.full(k, len(s), np.int32))
                where.append(np.arange(k, dtype=np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, owner, size, where)], names=["token", "row", "n", "at"])


def _full_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in chunks(_lowered(batch.column(1))):
            sets = shingle_sets(texts, n)
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(s) for s in sets], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], names=["set", "grams"])


def _pair_bounds(percent: int) -> dict[str, Column]:
    """Bounds for two entries (n, at) and (n2, at2) of one list, or for the pair of sets they come from.

    need: n-grams that must be shared. sizes: the smaller set has enough for that. place: so do the smaller rests from here
    on; the first n-gram that two linked sets share in the global order always passes. lists: index lists that linked sets
    share at least, since whatever they share beyond the index lies in the rest of the one whose prefix ends first.
    """
    need = F.expr(f"({percent} * (n + n2) + {99 + percent}) div {100 + percent}")
    rest = F.expr(f"({percent} * greatest(n, n2) + 99) div 100 - 1")
    return {
        "sizes": F.least("n", "n2") >= need,
        "place": F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= need,
        "lists": need - rest,
    }


def _long_lists_last(entries: DataFrame, lists: DataFrame, last: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame] | None:
    """The frequent n-grams with those of long lists put after all others, and the rows whose leading ones change by that; None if
    there are none. Places that were given stay, so all other rows keep their entries."""
    tokens, place = last
    room = FREQUENT_ROWS - len(tokens)
    known = saved(entries.sparkSession.createDataFrame(pa.table({"token": pa.array(tokens, pa.int64())})), "frequent")
    long = lists.where(F.col("c") >= FREQUENT_COUNT).join(small(known), "token", "left_anti")
    long = saved(long.orderBy(F.desc("c"), "token").limit(max(room, 0)).select("token", "c"), "long-lists")
    more = long.orderBy("c", "token").toPandas()["token"].to_numpy(np.int64)
    if not len(more):
        return None
    tokens = np.concatenate((tokens, more))
    place = np.concatenate((place, np.arange(len(more)) + place.max(initial=0) + 1))
    order = np.argsort(tokens)
    return (tokens[order], place[order]), saved(entries.join(small(long.select("token")), "token", "left_semi").select("row").distinct(), "reordered")


def _counted(entries: DataFrame) -> DataFrame:
    """Index lists (token, c entries) that hold more than one set."""
    return saved(entries.groupBy("token").agg(F.count("*").alias("c"), F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi").select("token", "c"), "lists")


def _met(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (src, dst) of sets of different labels that meet in a list (token, set, n, at, label) and pass the bounds there.

    Lists are cut by sizes into bands, so that linked sets are in one band or in neighbouring ones, and a band into blocks of about
    BLOCK entries: a label with many entries has blocks of its own, the others go by position. Blocks of one list meet by their
    summaries; only pairs of blocks that can hold a linked pair are opened. The blocks of a long list are dealt over several tasks.
    """
    # Sizes of linked sets differ by a factor of 100 / percent at most; bands are a little wider, against rounding.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(101.0 / percent)))
    # The largest partner that leaves need <= n - at n-grams, see _pair_bounds.
    reach = F.expr(f"((n - at) * {100 + percent}) div {percent} - n")
    listed = mixed.select("token", "set", "n", "at", "label", band.alias("band"), reach.alias("reach"))
    large = saved(listed.groupBy("token", "band", "label").agg(F.count("*").alias("own")).where(F.col("own") >= BLOCK), "large-labels")
    listed = listed.join(small(large), ["token", "band", "label"], "left")
    crowded = saved(listed.where("own is null").groupBy("token", "band").agg(F.count("*").alias("rest")).where(F.col("rest") > BLOCK), "long-bands")
    listed = listed.join(small(crowded), ["token", "band"], "left")
    cuts = F.ceil(F.coalesce("own", "rest", F.lit(1)) / BLOCK).cast("int")
    where = F.when(cuts > 1, F.expr("(16L * at) div n")).otherwise(0).cast("int")
    name = F.struct(F.when(F.col("own").isNotNull(), F.col("label")).otherwise(0).alias("a"), F.col("own").isNotNull().alias("b"), where.alias("c"), F.pmod(F.xxhash64("set"), cuts).alias("d"))
    blocks = listed.groupBy("token", "band", name.alias("block")).agg(
        F.collect_list(F.struct("set", "n", "at", "label")).alias("entries"), F.min("n").alias("least"), F.max("reach").alias("reach"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    blocks = saved(blocks, "list-blocks")
    spread = saved(blocks.groupBy("token").agg(F.ceil(F.count("*") / BLOCKS_A_TASK).cast("int").alias("slots")).where("slots > 1"), "long-lists")
    blocks = blocks.join(small(spread), "token", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    left = blocks.select("token", "slots", F.col("band").alias("band1"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("block").alias("block1"), F.col("entries").alias("e1"),
        F.col("least").alias("least1"), F.col("reach").alias("reach1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    left = left.withColumn("slot", F.pmod(F.xxhash64("block1"), F.col("slots")).cast("int")).drop("slots")
    right = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")).drop("slots")
    opened = left.join(right, ["token", "band", "slot"]).where("band1 < band or block1 <= block").where("least <= reach1 and least1 <= reach and not (lo = hi and lo1 = hi1 and lo = lo1)")
    one = opened.select("entries", F.explode("e1").alias("x"))
    pairs = one.select("x", F.explode("entries").alias("y")).select(
        F.col("x.set").alias("set"), F.col("x.n").alias("n"), F.col("x.at").alias("at"), F.col("x.label").alias("label"),
        F.col("y.set").alias("set2"), F.col("y.n").alias("n2"), F.col("y.at").alias("at2"), F.col("y.label").alias("label2"),
    )
    bounds = _pair_bounds(percent)
    pairs = pairs.where((F.col("label") != F.col("label2")) & bounds["sizes"] & bounds["place"])
    return pairs.select(F.least("set", "set2").alias("src"), F.greatest("set", "set2").alias("dst")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (src, dst) whose sets reach the threshold, by their whole sets."""
    left = sets.select(F.col("set").alias("src"), F.col("grams").alias("a"))
    right = sets.select(F.col("set").alias("dst"), F.col("grams").alias("b"))
    both = pairs.join(left, "src").join(right, "dst").select("src", "dst", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("c"))
    return both.where(F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("c"))).select("src", "dst")


def link_classes(documents: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Classes of documents that are connected by links of similarity percent / 100 or more.

    documents: doc_id (integer), text. A-Z is lower-cased; a document's set has its distinct n-grams of so many words; with
    fewer words the whole sequence is its one element; null, empty and blank texts have an empty set and link with
    nothing. Returns one row per document row: doc_id, n_shingles, component_id (the smallest doc_id that links reach) and
    set_copies (rows with the same set). Rows with a null doc_id get component_id null and link nothing; rows that repeat
    a doc_id are sets of their own. Whole texts are used; an empty table gives no rows; other columns are ignored. N-grams
    are compared by 64-bit hashes, whole sets by 128 bits and their size.
    """
    small_batches(documents.sparkSession)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.col("text").cast("string").alias("text"))
    scanned = saved(
        source.mapInArrow(partial(_digests, n=words), "doc_id long, row_hash long, n int, d1 long, d2 long, token long, seen int"),
        "set-digests",
    )
    # Equal sets are one vertex. The row with the smallest id stands for it, by its doc_id if no other row has that one.
    digest = ["n", "d1", "d2"]
    rows = scanned.where("n is not null").select("doc_id", "row_hash", *digest)
    known = rows.where("doc_id is not null and n > 0")
    classes = saved(
        known.groupBy(*digest).agg(F.min(F.struct("doc_id", "row_hash")).alias("first"), F.count("*").alias("set_copies")), "set-classes"
    )
    again = saved(classes.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.count("*").alias("times")).where("times > 1").select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    vertex = F.when(F.col("again"), F.xxhash64("doc_id", "row_hash")).otherwise(F.col("doc_id"))
    frequent = (
        scanned.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= FREQUENT_COUNT)
        .orderBy(F.desc("seen"), "token").limit(FREQUENT_ROWS).toPandas()
    )
    tokens = frequent["token"].to_numpy(np.int64)
    order = np.argsort(tokens)
    last = (tokens[order], (len(tokens) - np.arange(len(tokens)))[order])
    # All rows but the first of each set are left out; these are few, or else the join is shuffled.
    others = saved(
        known.join(classes.where("set_copies > 1").select(*digest, "first"), digest)
        .where(~((F.col("doc_id") == F.col("first.doc_id")) & (F.col("row_hash") == F.col("first.row_hash"))))
        .select("doc_id", "row_hash").distinct(),
        "set-copies",
    )
    firsts = source.where("doc_id is not null").join(small(others), ["doc_id", "row_hash"], "left_anti")
    keyed = firsts.join(small(again), "doc_id", "left").select(vertex.alias("row"), "text")
    indexed = lambda texts, last: texts.mapInArrow(partial(_prefixes, n=words, percent=percent, frequent=last), "token long, row long, n int, at int")
    entries = saved(indexed(keyed, last), "set-entries")
    lists = _counted(entries)
    for _ in range(ORDER_ROUNDS):
        changed = _long_lists_last(entries, lists, last)
        if changed is None:
            break
        last, moved = changed[0], small(changed[1])
        old = entries
        entries = saved(old.join(moved, "row", "left_anti").unionByName(indexed(keyed.join(moved, "row", "left_semi"), last)), "set-entries")
        discard(old)
        lists = _counted(entries)
    # Lists with one set only link nothing.
    index = saved(entries.join(lists, "token").select("token", F.col("row").alias("set"), "n", "at"), "set-index")
    discard(entries)
    bounds = _pair_bounds(percent)

    prefixes = saved(index.groupBy("set", "n").agg(F.collect_list("token").alias("grams")), "prefixes")
    # The sets in the middle of a group have few n-grams of their own, so more of theirs stand in lists: they lead.
    central = (F.count("*").over(Window.partitionBy("set")) * 1000 / F.col("n")).cast("int")
    index = saved(index.select("*", central.alias("central")), "set-index")
    ends = [F.least("set", "set2").alias("src"), F.greatest("set", "set2").alias("dst")]

    def screened(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that share enough index lists."""
        left = prefixes.select(F.col("set").alias("src"), "n", F.col("grams").alias("a"))
        right = prefixes.select(F.col("set").alias("dst"), F.col("n").alias("n2"), F.col("grams").alias("b"))
        both = pairs.join(left, "src").join(right, "dst").select("src", "dst", "n", "n2", F.size(F.array_intersect("a", "b")).alias("lists"))
        return both.where(F.col("lists") >= bounds["lists"]).select("src", "dst")

    def leader_pairs(mixed: DataFrame) -> DataFrame:
        """Each list's entries with the list's leader; the same sets lead many lists, so near copies meet few leaders."""
        rank = F.struct((-F.col("central")).alias("c"), F.xxhash64("set").alias("h"), "set", "n", "at")
        led = mixed.join(mixed.groupBy("token").agg(F.min(rank).alias("l")), "token").where("set <> l.set")
        led = led.select("set", "n", "at", F.col("l.set").alias("set2"), F.col("l.n").alias("n2"), F.col("l.at").alias("at2")).where(bounds["sizes"])
        counted = led.select(*ends, F.greatest("n", "n2").alias("n"), F.least("n", "n2").alias("n2"), bounds["place"].alias("place"))
        counted = counted.groupBy("src", "dst", "n", "n2").agg(F.count("*").alias("lists"), F.max("place").alias("place"))
        # A leader need not lead all lists that it shares with a set, so a part of the bound is asked for.
        return counted.where("place").where(4 * F.col("lists") >= bounds["lists"]).select("src", "dst")

    def class_pairs(mixed: DataFrame, turn: int) -> DataFrame:
        """For each set outside a large class, or class of such sets, the one of the class's representatives that shares most
        lists with it: most sets that belong to the class join it here, and need not meet its other members."""
        same = Window.partitionBy("token", "label")
        picked = F.row_number().over(same.orderBy(F.desc("central"), F.xxhash64("set", F.lit(turn))))
        large = mixed.groupBy("token", "label").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE_CLASS)
        chosen = mixed.select("*", picked.alias("k")).where(F.col("k") <= LARGE_CLASS).join(large, ["token", "label"])
        chosen = chosen.select(F.col("token").alias("token2"), F.col("set").alias("set2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("label").alias("label2"))
        met = mixed.join(chosen, (F.col("token") == F.col("token2")) & (F.col("label") != F.col("label2")) & bounds["sizes"] & bounds["place"])
        met = met.groupBy(*ends, F.least("label", "label2").alias("a"), F.greatest("label", "label2").alias("b")).agg(F.count("*").alias("lists"))
        return met.groupBy("a", "b").agg(F.max_by(F.struct("src", "dst"), F.struct("lists", "src", "dst")).alias("p")).select("p.src", "p.dst")

    links = checked = None
    mixed = index.withColumn("label", F.col("set"))
    for turn in range(LEADER_ROUNDS):
        tried = class_pairs(mixed, turn).join(checked, ["src", "dst"], "left_anti") if turn else leader_pairs(mixed)
        tried = saved(tried, "leader-pairs")
        sets = _sets_of(keyed, tried, words)
        new = saved(_verified(tried, sets, percent), "links")
        discard(sets)
        links, checked = (new, tried) if links is None else (links.unionAll(new), checked.unionAll(tried))
        if turn and new.isEmpty():
            break
        labels = saved(components(links), "leader-classes")
        labelled = mixed.drop("label").join(labels.select(F.col("id").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))
        several = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
        mixed = saved(labelled.join(several, "token").select("token", "set", "n", "at", "central", "label"), "mixed-lists")
    open_pairs = screened(_met(mixed, percent).join(checked, ["src", "dst"], "left_anti"))
    open_pairs = saved(open_pairs, "open-pairs")
    more = saved(_verified(open_pairs, _sets_of(keyed, open_pairs, words), percent), "links")
    final = components(links.unionAll(more))
    # row -> set of equal texts, and the smallest doc_id of each component.
    named = classes.select(*digest, "set_copies", "first.doc_id", "first.row_hash").join(small(again), "doc_id", "left").withColumn("id", vertex).withColumnRenamed("doc_id", "doc")
    named = named.join(final, "id", "left").withColumn("label", F.coalesce("label", "id"))
    smallest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    per_set = saved(named.join(smallest, "label").select(*digest, "set_copies", "component_id"), "set-components")
    out = rows.join(per_set, digest, "left")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("set_copies", F.lit(1)).cast("long").alias("set_copies"),
    )


def _sets_of(keyed: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The whole sets of all rows in the pairs."""
    needed = saved(pairs.select(F.explode(F.array("src", "dst")).alias("row")).distinct(), "needed-sets")
    return saved(keyed.join(small(needed), "row", "left_semi").select("row", "text").mapInArrow(partial(_full_sets, n=words), "set long, grams array<long>"), "sets")


def one_of_each_class(documents: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """documents without those whose class has a smaller doc_id; columns as before. Rows with a null doc_id stay; rows
    that repeat the smallest doc_id of their class all stay."""
    gone = saved(link_classes(documents, percent, words).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "class-members")
    gone = small(gone)
    return documents.join(gone, documents["doc_id"] == gone["_id"], "left_anti").select(*documents.columns)
