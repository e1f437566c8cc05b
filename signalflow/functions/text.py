"""Text functions of candidates: URLs, titles, summaries, hashes, model identities and anchors. Native unless said otherwise."""

from __future__ import annotations

import html
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that only track readers.
TRACKING_PARAMS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]

# Model families, their parts, and the tuning qualifiers that make a release of its own.
_FAMILY = r"(?i)\b(qwen|glm|deepseek)[\s_-]*([0-9]+(?:\.[0-9]+)*)(?:[\s_-]+([0-9]+(?:\.[0-9]+)?[bt](?:[\s_-]+a[0-9]+b)?))?(?:[\s_-]+([a-z][a-z0-9]*))?"
_COMMAND = r"(?i)\b(command)[\s_-]+(a|r\+|r)(?!\w)(?:[\s_-]+(vision|reasoning|[0-9]+b))?(?:[\s_-]+([a-z][a-z0-9]*))?"
_TUNING = ["instruct", "chat", "base"]

# Fixed value: concrete product identifiers in a text.
_IDENTIFIER = r"(?i)\b(?:deepseek(?:-ai/)?[-\w.]+|gpt[-‐-―][\w.‐-―+]+|chatgpt\s+[a-z][\w-]+)\b"


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(text: Column) -> Column:
    """Text with HTML entities read; only texts with an ampersand leave the JVM."""
    return F.when(F.contains(text, F.lit("&")), _unescape(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)


def html_escape(text: Column) -> Column:
    """Text with & < > " ' written as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def squeezed(text: Column) -> Column:
    """Text with each run of white space as one space, and none at its ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def _recoded(part: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))
    return F.replace(F.replace(F.url_encode(decoded), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column, keep_fragment: bool = False) -> Column:
    """A URL without tracking parameters, trailing slashes and (by default) fragment; scheme and host in lower case.

    Parameters keep their order and blank values. Null stays null; text that is no URL comes out with "/" as its path.
    """
    whole = F.trim(url)
    fragment = F.regexp_extract(whole, "(?s)^[^#]*(#.*)?$", 1)
    base = F.regexp_extract(whole, "^([^#]*)", 1)
    scheme = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    after = F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    netloc = F.regexp_extract(after, "^//([^/?]*)", 1)
    path = F.regexp_replace(F.regexp_extract(F.regexp_replace(after, "^//[^/?]*", ""), r"^([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(after, r"(?s)\?(.*)$", 1)
    name = lambda p: F.regexp_extract(p, "(?s)^([^=]*)", 1)
    value = lambda p: F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)
    key = lambda p: F.lower(F.coalesce(F.try_url_decode(name(p)), name(p)))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(key(p), F.lit("utm_")) & ~key(p).isin(TRACKING_PARAMS))
    encoded = F.array_join(F.transform(kept, lambda p: F.concat(_recoded(name(p)), F.lit("="), _recoded(value(p)))), "&")
    out = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), F.lower(netloc))).otherwise(""),
        F.when(path == "", "/").otherwise(path),
        F.when(encoded != "", F.concat(F.lit("?"), encoded)).otherwise(""),
    )
    return F.concat(out, fragment) if keep_fragment else out


def normalized_title(title: Column) -> Column:
    """Lower case, letters, digits and underscores only, single spaces; entities are read first."""
    return squeezed(F.regexp_replace(F.lower(html_unescape(title)), r"[^\p{L}\p{N}_\s]", " "))


def clean_title(title: Column) -> Column:
    return F.regexp_replace(html_unescape(title), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def clean_summary(summary: Column) -> Column:
    """Entities read, then tags out, then single spaces."""
    return squeezed(F.regexp_replace(html_unescape(summary), "<[^>]+>", " "))


def content_hash(summary: Column, norm_title: Column) -> Column:
    """SHA-256 of the lower-case summary, or of the normalized title where there is no summary."""
    return F.sha2(F.when(summary != "", F.lower(summary)).otherwise(norm_title), 256)


def first_sentence(text: Column, limit: int = 180) -> Column:
    """The first sentence, at most limit characters, without spaces, colons and dashes at its ends."""
    flat = squeezed(text)
    sentence = F.regexp_extract(flat, r"^(.*?[.!?])(?:\s|$)", 1)
    return F.regexp_replace(F.substring(F.when(sentence != "", sentence).otherwise(flat), 1, limit), "^[ :-]+|[ :-]+$", "")


def parsed_date(text: Column) -> Column:
    """A timestamp from one of the usual date spellings, commas ignored; null if none fits."""
    plain = F.trim(F.replace(text, F.lit(","), F.lit("")))
    patterns = ("MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)) for p in patterns])


def iso_timestamp(text: Column) -> Column:
    """A timestamp from ISO-8601 text; without a zone it is UTC (the session's zone); null if it is none."""
    return F.try_to_timestamp(F.trim(text))


def model_identity(value: Column) -> Column:
    """A model family's identity: vendor, version and size, with a tuning qualifier if that makes it a release of its own;
    null for what names no known family. Other qualifiers (formats, quantisation) do not count."""
    plain = F.regexp_replace(html_unescape(value), r"(?i)new model repository:\s*[^/]+/", "")

    def joined(pattern: str) -> Column:
        groups = [F.regexp_extract(plain, pattern, i) for i in (1, 2, 3)]
        parts = [F.when(g != "", F.translate(F.lower(g), " _", "--")) for g in groups]
        tuning = F.lower(F.regexp_extract(plain, pattern, 4))
        return F.concat_ws("-", *parts, F.when(tuning.isin(_TUNING), tuning))

    return F.when(F.rlike(plain, F.lit(_FAMILY)), joined(_FAMILY)).when(F.rlike(plain, F.lit(_COMMAND)), joined(_COMMAND))


def anchor(value: Column) -> Column:
    """The last part of an identifier in lower case, other signs than letters, digits and + as single dashes."""
    last = F.substring_index(F.trim(F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))), "/", -1)
    return F.regexp_replace(F.regexp_replace(last, "[^a-z0-9+]+", "-"), "^-+|-+$", "")


def identifiers(text: Column) -> Column:
    """The distinct anchors of concrete product identifiers in a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_IDENTIFIER), F.lit(0)), anchor))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """Whether any of the phrases is a part of the text."""
    found = F.lit(False)
    for p in sorted(phrases):
        found = found | F.contains(text, F.lit(p))
    return found


def candidate_text(norm_title: Column, summary: Column) -> Column:
    """What keywords are looked for in."""
    return F.translate(F.concat(norm_title, F.lit(" "), F.lower(summary)), "_", " ")


def keyword_score(text: Column, terms: list[tuple[str, str]]) -> Column:
    """30 times the summed weights (decimal strings) of the terms that are parts of the text, rounded half to even, at most
    100. Decimal sums do not depend on their order. For some hundred terms; each is one native search."""
    total = F.lit(0).cast("decimal(12,4)")
    for term, weight in terms:
        total = total + F.when(F.contains(text, F.lit(term)), F.lit(weight).cast("decimal(10,4)")).otherwise(F.lit(0).cast("decimal(10,4)"))
    return F.least(F.lit(100), F.bround((total * 30).cast("decimal(20,4)"), 0)).cast("int")
