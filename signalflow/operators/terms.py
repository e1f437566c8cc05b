"""Keyword scores for any number of terms: one automaton per worker finds all of them in one pass over a text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved

#: Terms of one automaton (some ten MB in a worker); more terms are looked for in blocks of so many, one pass over the texts each.
BLOCK_TERMS = 100_000
#: Parts of a weight's unit.
UNITS = 10_000


@lru_cache(maxsize=1)
def _automaton(terms: tuple[str, ...]):  # noqa: ANN202
    import ahocorasick

    found = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        if term:
            found.add_word(term, number)
    found.make_automaton()
    return found


def _hits(batches: Iterator[pa.RecordBatch], terms: tuple[str, ...], weights: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    always = {i for i, t in enumerate(terms) if not t}  # an empty term is part of every text
    automaton = _automaton(terms)
    for batch in batches:
        n_terms, weight = [], []
        for text in batch.column(1).to_pylist():
            seen = set() if text is None else always.union(i for _, i in automaton.iter(text)) if len(automaton) else always
            n_terms.append(len(seen))
            weight.append(sum(weights[i] for i in seen))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_terms, pa.int64()), pa.array(weight, pa.int64())], ["id", "n_terms", "weight"])


def term_scores(texts: DataFrame, terms: DataFrame, block: int = BLOCK_TERMS) -> DataFrame:
    """id, n_terms and keyword_score: how many of the terms are parts of a text, and 30 times their summed weights, rounded half to even, at
    most 100.

    texts: id, text (as it is searched: lower case, underscores as spaces). terms: term, weight (decimal, four places). A term that is given
    several times counts once, with its weights added. Null texts hold no term, null terms are left out, an empty term is in every text.
    Only the terms come to the driver, a block at a time; texts stay where they are, and rows that repeat keep a row each if there is one
    block (with more blocks ids must be unique).
    """
    unit = F.sum((F.col("weight").cast("decimal(10,4)") * UNITS).cast("long"))
    table = terms.where("term is not null").groupBy("term").agg(F.coalesce(unit, F.lit(0)).alias("weight"))
    table = saved(table.withColumn("block", F.lit(0)), "terms")
    blocks = max(1, -(-table.count() // block))
    kind = texts.schema["id"].dataType.simpleString()
    found = None
    for number in range(blocks):
        rows = table.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == number).orderBy("term").collect()
        find = partial(_hits, terms=tuple(r["term"] for r in rows), weights=tuple(r["weight"] for r in rows))
        part = texts.select("id", "text").mapInArrow(find, f"id {kind}, n_terms long, weight long")
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("id").agg(F.sum("n_terms").alias("n_terms"), F.sum("weight").alias("weight"))
    score = F.bround((F.col("weight") * 30).cast("decimal(20,4)") / F.lit(UNITS).cast("decimal(6,0)"), 0)
    return found.select("id", "n_terms", F.least(F.lit(100), score).cast("int").alias("keyword_score"))
