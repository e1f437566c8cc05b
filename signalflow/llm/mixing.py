"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, saved, small

#: A document's place is a hash of 60 bits; a bucket of places is as wide as one part in 2**BUCKET_BITS of its distance.
LAST_PLACE, BUCKET_BITS = (1 << 60) - 1, 9
#: No document is taken more often than this.
MAX_REPEATS = 3
#: A source is at its target if it is no further from it than this share of it.
NEAR = 0.001
#: Up to so many sources, each with a row of some hundred bytes, their rows are broadcast to the documents.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 09-0D; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def document_place() -> Column:
    """A document's fixed place in 0 .. 2**60 - 1: the first 15 hex digits of a digest of its id, source and text. Places are told apart
    within a source only: null and '' have the same ones."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets from one row (source, source_size) per source: weights repeat over the sources in code point order, null
    last; all sizes together are shared by weight; no target is above MAX_REPEATS times its source's size, and what is
    cut off goes to the others by weight until none is above.

    Sources in the order of cap / weight are cut off one after the other; the first level (size left / weight left)
    that no remaining cap is below is final. One row per source is the only thing that is sorted here.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    choices = F.array(*[F.lit(w) for w in weights])
    capped = sizes.select(
        "source",
        "source_size",
        F.element_at(choices, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"),
        (MAX_REPEATS * F.col("source_size")).alias("cap"),
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = capped.select(
        "*",
        F.row_number().over(by_ratio).alias("k"),
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    fits = F.col("cap") / F.col("weight") >= F.col("level")
    final = levels.select("*", F.min(F.when(fits, F.struct("k", "level"))).over(everything).alias("fill"))
    cap = F.col("cap").cast("double")
    return final.select(
        "source",
        "source_size",
        F.when(F.col("k") >= F.col("fill.k"), F.least(F.col("weight") * F.col("fill.level"), cap)).otherwise(cap).alias("target"),
    )


def _joined(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Each row with its source's row (null equals null); per_source is broadcast if the sources were counted to be few."""
    right = per_source.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(right) if few else right, rows["source"].eqNullSafe(right["_source"])).drop("_source")


def _updated(state: DataFrame, found: DataFrame) -> DataFrame:
    """Each source's row with what was found for it, if anything was; the planner chooses how to join."""
    right = found.withColumnRenamed("source", "_source")
    return state.join(right, state["source"].eqNullSafe(right["_source"]), "left").drop("_source")


def _bucket(offset: Column) -> Column:
    """A bucket number that grows with the offset: its bit length and the BUCKET_BITS bits after the first, so that buckets near 0
    hold one offset each and others are as wide as one part in 2**BUCKET_BITS of their distance."""
    length = F.length(F.bin(offset))
    shift = F.greatest(length - 1 - BUCKET_BITS, F.lit(0))
    return (shift.cast("long") * (1 << (BUCKET_BITS + 1)) + F.expr(f"shiftright(offset, greatest(length(bin(offset)) - {1 + BUCKET_BITS}, 0))")).cast("long")


def _filled(atoms: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """First fit: in the order of their places, documents are taken while their source is further from its target than near and
    they fit what is missing.

    Each round sums the words of the documents that fit by bucket of their place, counted from where the source stands. All
    buckets before the one that the budget ends in are taken, and that one alone is refined, until it holds one document, which
    is taken or skipped. As what is missing shrinks, a skipped document never fits again, so rounds go on from there with
    smaller documents until none fits."""
    while not state.where("open and missing > near and low <= last").isEmpty():
        open_ = state.where("open and missing > near and low <= last").select("source", "low", "until", "missing", "near")
        rows = _joined(atoms, open_, few).where((F.col("place") >= F.col("low")) & (F.col("place") <= F.col("until")) & (F.col("one") <= F.col("missing")))
        offset = rows.withColumn("offset", F.col("place") - F.col("low"))
        sums = offset.groupBy("source", "missing", "near", _bucket(F.col("offset")).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("place").alias("first"), F.max("place").alias("final")
        )
        run = Window.partitionBy("source").orderBy("bucket")
        running = sums.select("*", F.sum("words").over(run).alias("upto"))
        reached = F.col("upto") >= F.col("missing") - F.col("near")
        hit = F.min(F.when(reached, F.struct("bucket", "upto", "words", "rows", "first", "final")))
        found = running.groupBy("source").agg(hit.alias("hit"), F.max("upto").alias("everything"))
        one = F.col("hit.rows") == 1
        fits = F.col("hit.upto") <= F.col("missing")
        before = F.col("hit.upto") - F.col("hit.words")
        # Where the next round begins, and up to where this one has taken what fits.
        low = F.when(F.col("hit").isNull(), F.col("until") + 1).when(one, F.col("hit.first") + 1).otherwise(F.col("hit.first"))
        taken_to = F.when(F.col("hit").isNotNull() & one & ~fits, F.col("hit.first")).otherwise(low)
        words = F.when(F.col("hit").isNull(), F.coalesce("everything", F.lit(0))).when(one & fits, F.col("hit.upto")).otherwise(before)
        step = F.struct(F.col("low").alias("from"), taken_to.alias("to"), F.col("missing").alias("limit"))
        active = (F.col("missing") > F.col("near")) & (F.col("low") <= F.col("last"))
        grown = _updated(state, found)
        state = saved(
            grown.select(
                "source", "source_size", "target", "whole", "near", "last",
                F.when(active & (words > 0), F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"),
                F.when(active, F.col("missing") - words).otherwise(F.col("missing")).cast("long").alias("missing"),
                F.when(active, low).otherwise(F.col("low")).alias("low"),
                F.when(active & ~one, F.col("hit.final")).otherwise(F.col("last")).alias("until"),
                "more", "less", (active & (F.col("everything").isNotNull() | (F.col("until") < F.col("last")))).alias("open"),
            ),
            "mix-state",
        )
    return state


def _extra() -> Column:
    """Whether first fit took a document (place, one) beyond its whole copies."""
    return F.exists("steps", lambda s: (F.col("place") >= s["from"]) & (F.col("place") < s["to"]) & (F.col("one") <= s["limit"]))


def _times(places: Column) -> Column:
    return F.size(F.filter(places, lambda p: p == F.col("place")))


def _copies() -> Column:
    return (F.col("whole") + F.when(_extra(), 1).otherwise(0) + _times(F.col("more")) - _times(F.col("less"))).cast("int")


def _exchanged(atoms: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """While a source is further from its target than near: the exchange of one copy that comes nearest to it, one document (or
    none) out and another (or none) in, if any comes nearer.

    Only distinct sizes are compared: sorted, each size that may go stands next to the sizes that would best take its place.
    Exchanges that end within near are as good as each other, and of these one that repeats no document more often than first fit
    does is preferred; then the nearest, the smaller sizes, and the smaller places."""
    state = state.withColumn("open", F.lit(True))
    while not state.where("open and abs(missing) > near").isEmpty():
        far = state.where("open and abs(missing) > near").select("source", "whole", "near", "missing", "steps", "more", "less")
        rows = _joined(atoms, far, few).withColumn("copies", _copies())
        kind = F.when(F.col("copies") <= F.col("whole"), 0).otherwise(1)
        sides = rows.select(
            "source", "near", "missing", "size", "place",
            F.explode(F.array_compact(F.array(F.when(F.col("copies") > 0, F.lit(-1)), F.when(F.col("copies") < MAX_REPEATS, kind)))).alias("side"),
        )
        none = far.select("source", "near", "missing", F.lit(0).cast("long").alias("size"), F.lit(-1).cast("long").alias("place"), F.explode(F.array(F.lit(-1), F.lit(0))).alias("side"))
        sizes = sides.unionByName(none).groupBy("source", "near", "missing", "side", "size").agg(F.min("place").alias("place"))
        at = sizes.select("*", (F.col("size") + F.when(F.col("side") < 0, F.col("missing")).otherwise(0)).alias("at"))
        ahead = Window.partitionBy("source").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
        behind = Window.partitionBy("source").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        into = lambda side: F.when(F.col("side") == side, F.struct("size", "place"))
        near_by = at.select("*", *[x for s in (0, 1) for x in (F.max(into(s)).over(behind).alias(f"b{s}"), F.min(into(s)).over(ahead).alias(f"a{s}"))]).where("side < 0")
        pairs = near_by.select(
            "source", "near", "missing", F.col("size").alias("out"), F.col("place").alias("out_place"),
            F.explode(F.array_compact(F.array(*[F.when(F.col(f"{w}{s}").isNotNull(), F.struct(F.lit(s).alias("kind"), f"{w}{s}.size", f"{w}{s}.place")) for s in (0, 1) for w in "ba"]))).alias("into"),
        )
        gap = F.abs(F.col("missing") + F.col("out") - F.col("into.size"))
        ranked = pairs.where(gap < F.abs("missing")).select(
            "source", F.struct(F.greatest(gap, F.col("near")).alias("far"), "into.kind", gap.alias("gap"), "out", F.col("into.size").alias("size"), "out_place", F.col("into.place").alias("place")).alias("best")
        )
        best = ranked.groupBy("source").agg(F.min("best").alias("best"))
        put = lambda places, place: F.when(place >= 0, F.concat(places, F.array(place))).otherwise(F.col(places))
        state = saved(
            _updated(state, best).select(
                "source", "source_size", "target", "whole", "near", "last", "steps", (F.col("missing") + F.coalesce(F.col("best.out") - F.col("best.size"), F.lit(0))).alias("missing"),
                "low", "until", put("more", F.col("best.place")).alias("more"), put("less", F.col("best.out_place")).alias("less"), F.col("best").isNotNull().alias("open"),
            ),
            "mix-state",
        )
    return state


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Take documents so that each source gives about its target of words.

    A source of size S and target t takes every document floor(t / S) times, and for the rest of t (rounded to words) some
    documents once more: first fit in the order of their places (hashes), by histograms and nested thresholds, and then
    exchanges of single copies while the source is further from its target than NEAR of it and an exchange comes nearer. A
    filter on the place takes the documents; documents are never sorted, and there is no limit to the rounds: they end when
    each source is near, or nothing comes nearer.

    documents: doc_id, text, source, any type of id. Returns doc_id, source, size, source_size, target, place, copies and
    taken (size * copies). Null text has size 0; null source is a source of its own; rows that repeat in id, source and text
    have one place and are taken together; a source without words has target 0, and its documents copies 0. An empty table
    gives no rows. Other columns are ignored. Sources are ranked and capped in one task, a row each.
    """
    slim = saved(
        documents.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), document_place().alias("place")),
        "mix-sizes",
    )
    atoms = saved(slim.where("size > 0").groupBy("source", "place").agg(F.sum("size").alias("size"), F.max("size").alias("one")), "mix-atoms")
    sources = saved(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    none = F.array().cast("array<bigint>")
    state = saved(
        source_targets(sources, weights).select(
            "source", "source_size", "target", whole.alias("whole"), F.floor(F.col("target") * NEAR).cast("long").alias("near"), F.lit(LAST_PLACE).alias("last"),
            F.array().cast("array<struct<from:bigint,to:bigint,limit:bigint>>").alias("steps"),
            F.floor(F.col("target") - whole * F.col("source_size") + 0.5).cast("long").alias("missing"),
            F.lit(0).cast("long").alias("low"), F.lit(LAST_PLACE).alias("until"), none.alias("more"), none.alias("less"), F.lit(True).alias("open"),
        ),
        "mix-state",
    )
    few = state.count() <= BROADCAST_SOURCES
    state = _exchanged(atoms, _filled(atoms, state, few), few)
    taken = _joined(slim.withColumn("one", F.col("size")), state.select("source", "source_size", "target", "whole", "steps", "more", "less"), few)
    copies = F.when(F.col("target") <= 0, 0).otherwise(_copies())
    return taken.select("doc_id", "source", "size", "source_size", "target", "place", copies.alias("copies")).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken; columns as in documents. Source and place name a document, null
    and '' being two sources."""
    chosen = mix(documents, weights).where("copies > 0").select(F.col("source").alias("__sf_source"), F.col("place").alias("__sf_place"), F.col("copies").alias("__sf_copies"))
    taken = small(saved(chosen.distinct(), "mix-taken"))
    joined = documents.join(taken, (document_place() == taken["__sf_place"]) & documents["source"].eqNullSafe(taken["__sf_source"]))
    copy = "__sf_copy"
    while copy in documents.columns:
        copy += "_"
    return joined.select(*[documents[c] for c in documents.columns], F.explode(F.sequence(F.lit(1), taken["__sf_copies"])).alias(copy)).drop(copy)
