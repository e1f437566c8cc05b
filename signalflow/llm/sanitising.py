"""Information-theoretic sanitisation (DataFrame functions only): personal data by patterns, and the terms that give it away.

A pattern finds entities (addresses, numbers). Around their mentions the corpus tells which terms stand with which entity: the point
of view is a word position drawn at random, an entity's event is that the position lies within reach of one of its mentions, and a
term's pointwise mutual information with that event is what the term reveals of it. Divided by the entity's own information it is a
share: 1 if the term stands with that entity only. Terms that reveal too much are written more generally or removed, wherever they
stand, also in documents that do not name the entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small

#: Java patterns for the kinds of personal data, in the order in which spans are listed. Possessive quantifiers and the look behind (a
#: search begins where a run of characters does, or where the last match ended) find the same as the plain patterns, but take time in
#: proportion to the text and no stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PATTERNS = {
    "email": EMAIL,
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign that a text may hold a kind.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Terms are runs of so many letters or more; they stand within REACH code points of a mention.
TERM, REACH = r"\p{L}{4,}+", 100
#: A term is sanitised if it stands in so many different surroundings of one entity and reveals this share of its information.
SURROUNDINGS, DISCLOSURE = 2, 0.9
#: Letters that a more general form keeps.
STEM = 3
#: Prefix sums are taken in blocks of so many values.
BLOCK = 128


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array of longs: plus over all values before it, from 0. Blocks keep the work near linear."""
    fold = lambda part: F.aggregate(part, F.lit(0).cast("long"), plus)
    block = lambda i: F.floor(i / BLOCK).cast("int")
    by_block = lambda v: F.transform(F.sequence(F.lit(0), block(F.size(v))), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
    before = lambda sums: F.transform(sums, lambda _, b: fold(F.slice(sums, F.lit(1), b)))
    within = lambda v, first: F.transform(v, lambda _, i: plus(F.get(first, block(i)), fold(F.slice(v, block(i) * BLOCK + 1, i % BLOCK))))
    return _let(values, lambda v: _let(_let(by_block(v), before), lambda first: within(v, first)))


def matches(text: Column, pattern: str, holds: Callable[[Column], Column]) -> Column:
    """All leftmost matches, not overlapping, for which holds(match) is true: array of (start, end, value), code points."""
    with_gaps = lambda found, gaps: F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("n"), m.alias("m"))
    )
    placed = lambda parts: _let(
        _running(F.transform(parts, lambda p: p["gap"] + p["n"]), lambda a, b: a + b),
        lambda before: F.zip_with(parts, before, lambda p, b: F.struct((b + p["gap"]).alias("start"), (b + p["gap"] + p["n"]).alias("end"), p["m"].alias("value"))),
    )
    parts = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: with_gaps(found, F.split(text, pattern, -1)))
    return F.filter(_let(parts, placed), lambda s: holds(s["value"]))


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second from the end doubled and reduced, add up to a multiple of ten."""
    backwards = F.reverse(digits)
    digit = lambda i: F.substring(backwards, i + 1, F.lit(1))
    value = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(F.translate(digit(i), "0123456789", "0246813579")).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


#: What a match must be besides, and what its value is called in the corpus.
HOLDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(16, 19), _luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}
_NAME: dict[str, Callable[[Column], Column]] = {"email": F.lower, "ip": lambda m: m, "card": _digits, "phone": _digits}
_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """The spans of one kind of personal data."""
    return F.when(text.rlike(SIGNS[kind]), matches(text, PATTERNS[kind], HOLDS[kind])).otherwise(F.array().cast(_SPANS))


def _without_emails(text: Column) -> Column:
    return F.when(text.contains("@"), F.regexp_replace(text, EMAIL, " ")).otherwise(text)


def _mentions(text: Column, kind: str) -> Column:
    """Each entity of a kind with the words around it, up to REACH code points and the next match of the kind: array of (kind, entity,
    around). Words that the limit cuts are left out. text has no e-mail addresses unless they are the kind."""
    left = lambda g: F.when(F.length(g) > REACH, F.regexp_replace(F.right(g, F.lit(REACH)), r"^\p{L}+", "")).otherwise(g)
    right = lambda g: F.when(F.length(g) > REACH, F.regexp_replace(F.left(g, F.lit(REACH)), r"\p{L}+$", "")).otherwise(g)
    with_sides = lambda found, gaps: F.transform(
        found, lambda m, i: F.struct(F.lit(kind).alias("kind"), m.alias("entity"), F.concat(left(F.get(gaps, i)), F.lit(" "), right(F.get(gaps, i + 1))).alias("around"))
    )
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    whole = _let(found, lambda m: _let(F.split(text, PATTERNS[kind], -1), lambda gaps: with_sides(m, gaps)))
    held = F.filter(whole, lambda s: HOLDS[kind](s["entity"]))
    return F.transform(held, lambda s: F.struct(s["kind"], _NAME[kind](s["entity"]).alias("entity"), s["around"]))


def _row_key(text: str = "text") -> Column:
    """128 bits of a row's id and text; rows that share both have the same results."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("doc_id").isNull(), "?").otherwise(":"), F.col(text)).cast("binary"))


def _listed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def base_spans(texts: DataFrame) -> DataFrame:
    """doc_id, __key, the spans of each kind, the mentions of entities and the number of terms; texts has doc_id and text, not null."""
    found = texts.select("doc_id", "text", _row_key().alias("__key"), *[spans_of(F.col("text"), k).alias(k) for k in PATTERNS])
    some = sum((F.size(k) for k in PATTERNS), F.lit(0)) > 0
    plain = found.withColumn("__plain", _without_emails(F.col("text"))).withColumn("some", some)
    none = F.array().cast("array<struct<kind:string,entity:string,around:string>>")
    mentions = F.flatten(F.array(*[F.when(F.size(k) > 0, _mentions(F.col("text" if k == "email" else "__plain"), k)).otherwise(none) for k in PATTERNS]))
    return plain.select("doc_id", "__key", *PATTERNS, F.when(F.col("some"), mentions).otherwise(none).alias("mentions"), F.regexp_count("__plain", F.lit(TERM)).cast("long").alias("terms"))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def disclosing_terms(base: DataFrame, texts: DataFrame, surroundings: int = SURROUNDINGS, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """The terms to sanitise, (term, kind, entity, share, put) with the form to put in their place, and the rows that hold them, (__key, term).

    Counts are of whole texts: first terms around mentions, a row for each term, entity and surrounding; then, for terms that may be too
    revealing by these alone, all places in the corpus, and those of the more general form (first letters). The most revealed entity
    decides: the form is used if it reveals less than the threshold of each entity that the term reveals too much of, else nothing."""
    positions = base.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    near = base.where(F.size("mentions") > 0).select(F.explode("mentions").alias("m")).select("m.kind", "m.entity", F.xxhash64("m.around").alias("around"), F.explode(_terms(F.col("m.around"))).alias("term"))
    by_place = near.groupBy(F.lower("term").alias("term"), "kind", "entity", "around").agg(F.count("*").alias("n"))
    pairs = saved(by_place.groupBy("term", "kind", "entity").agg(F.sum("n").alias("beside"), F.count("*").alias("places")), "pairs")
    cover = pairs.groupBy("kind", "entity").agg(F.sum("beside").alias("cover"))
    # A place is within reach of two mentions of a kind at most, so half of these are places of their own.
    seen = pairs.groupBy("term", "kind").agg((F.sum("beside") / 2).alias("seen"))
    information = F.log2(F.lit(float(positions)) / F.col("cover"))
    share = lambda beside, everywhere: F.when(information > 0, 1 + F.log2(F.least(F.lit(1.0), beside / everywhere)) / information).otherwise(F.lit(0.0))
    often = pairs.where(F.col("places") >= surroundings)
    possible = often.join(cover, ["kind", "entity"]).join(seen, ["term", "kind"]).where(share(F.col("beside"), F.greatest(F.col("beside"), F.col("seen"))) >= disclosure)
    possible = saved(possible.select("term", "kind", "entity", "beside", "cover", F.left("term", F.lit(STEM)).alias("stem")), "possible-terms")
    wanted = small(saved(possible.select(F.explode(F.array("term", F.concat("stem", F.lit("*")))).alias("word")).distinct(), "wanted-words"))
    # Words are taken from a text once, before the rows are multiplied; counts are added up within tasks before the shuffle.
    plain = texts.select(_row_key().alias("__key"), F.transform(_terms(_without_emails(F.col("text"))), F.lower).alias("words"))
    forms = F.concat("words", F.transform("words", lambda w: F.concat(F.left(w, F.lit(STEM)), F.lit("*"))))
    everywhere = saved(plain.select(F.explode(forms).alias("word")).join(wanted, "word").groupBy("word").agg(F.count("*").alias("n")), "everywhere")
    flagged = possible.join(everywhere.select(F.col("word").alias("term"), F.col("n").alias("all")), "term").withColumn("share", share(F.col("beside"), F.col("all"))).where(F.col("share") >= disclosure)
    stems = pairs.groupBy(F.left("term", F.lit(STEM)).alias("stem"), "kind", "entity").agg(F.sum("beside").alias("beside"))
    general = flagged.select("term", "kind", "entity", "cover", "share", "stem").join(stems, ["stem", "kind", "entity"])
    general = general.join(everywhere.where(F.col("word").endswith("*")).select(F.expr("left(word, length(word) - 1)").alias("stem"), F.col("n").alias("all")), "stem")
    told = general.withColumn("open", share(F.col("beside"), F.col("all")) >= disclosure)
    worst = told.groupBy("term").agg(F.max(F.struct("share", "kind", "entity")).alias("worst"), F.max("open").alias("open"), F.first("stem").alias("stem"))
    put = F.when(F.col("open"), F.lit("[removed]")).otherwise(F.concat("stem", F.lit("\N{HORIZONTAL ELLIPSIS}")))
    terms = saved(worst.select("term", "worst.kind", "worst.entity", "worst.share", put.alias("put")), "terms")
    known = small(terms.select("term", "put"))
    rows = plain.select("__key", F.explode(F.array_distinct("words")).alias("term")).join(known, "term")
    return terms, rows


def personal_spans(documents: DataFrame, surroundings: int = SURROUNDINGS, disclosure: float = DISCLOSURE) -> DataFrame:
    """All spans of personal data in whole texts: by the patterns, and of terms that give entities away.

    documents: doc_id of any type and text. Returns doc_id, __key, the kinds email, ip, card and phone (each an array of start, end, value)
    and term (the same; value is what is put in its place), in code points, end exclusive. Null and empty texts have no spans; null ids
    and repeated rows keep a row each; ties can't arise, as spans are ordered by place; an empty table gives no rows; other columns are
    ignored. Neighbouring copies of one passage count as one surrounding, so copies alone do not make a term suspicious."""
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = saved(base_spans(texts), "base-spans")
    _, rows = disclosing_terms(base, texts, surroundings, disclosure)
    by_row = small(saved(rows.groupBy("__key").agg(F.map_from_entries(F.collect_set(F.struct("term", "put"))).alias("put")), "rows-with-terms"))
    held = texts.withColumn("__key", _row_key()).join(by_row, "__key").select("__key", "put", matches(F.col("text"), f"{EMAIL}|{TERM}", lambda m: ~m.contains("@")).alias("words"))
    own = F.filter(F.transform("words", lambda w: F.struct(w["start"], w["end"], F.try_element_at(F.col("put"), F.lower(w["value"])).alias("value"))), lambda w: w["value"].isNotNull())
    extra = small(saved(held.select("__key", own.alias("term")).dropDuplicates(["__key"]), "term-spans"))
    return base.join(extra, "__key", "left").select("doc_id", "__key", *PATTERNS, F.coalesce("term", F.array().cast(_SPANS)).alias("term"))


def span_columns(found: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256 and spans: kind:start:end by kind and start, joined by commas, without and
    with terms."""
    base = F.flatten(F.array(*[_listed(F.col(k), k) for k in PATTERNS]))
    rows = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in (*PATTERNS, "term")], base.alias("base"), _listed(F.col("term"), "term").alias("more"))
    digest = F.sha2(F.array_join("base", ",").cast("binary"), 256)
    return rows.select("doc_id", *[f"n_{k}" for k in (*PATTERNS, "term")], digest.alias("base_sha256"), F.array_join(F.concat("base", "more"), ",").alias("spans"))


def sanitised(documents: DataFrame, surroundings: int = SURROUNDINGS, disclosure: float = DISCLOSURE) -> DataFrame:
    """documents with each span of personal_spans() replaced in text: the kind in brackets for an entity, and for a term its first letters
    and an ellipsis, or [removed]. Spans that overlap are replaced together, by what stands for the first of them. Columns stay as they
    are, null texts stay null."""
    found = personal_spans(documents.select("doc_id", "text"), surroundings, disclosure)
    labelled = lambda kind, put: F.transform(kind, lambda s: F.struct(s["start"], s["end"], put(s).alias("put")))
    cuts_of = [labelled(k, lambda s, k=k: F.lit(f"[{k}]")) for k in PATTERNS] + [labelled("term", lambda s: s["value"])]
    cuts = found.select("__key", F.array_sort(F.flatten(F.array(*cuts_of))).alias("__cuts")).where(F.size("__cuts") > 0).dropDuplicates(["__key"])
    reached = _running(F.transform("__cuts", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    islands = _let(reached, lambda r: F.filter(F.zip_with("__cuts", r, lambda s, b: F.struct(s["start"].alias("start"), b.alias("before"), s["put"].alias("put"))), lambda s: s["start"] >= s["before"]))
    piece = lambda s: F.concat(F.substring(F.col("__text"), (s["before"] + 1).cast("int"), (s["start"] - s["before"]).cast("int")), s["put"])
    rest = F.substring(F.col("__text"), (F.array_max(F.transform("__cuts", lambda s: s["end"])) + 1).cast("int"), F.length("__text"))
    new = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform(islands, piece), ""), rest))
    keyed = documents.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("__key", _row_key("__text"))
    joined = keyed.join(cuts, "__key", "left")
    return joined.select(*[new.alias("text") if c == "text" else F.col(c) for c in documents.columns])
