"""One registered query per operator, over the whole of its table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, ngram_join, packing, quality, resampling, sanitising, suffix_dedup, token_counts, toxicity, url_filters, vector_codes, warc
from .common import new_path, saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file on this machine; it is the same on all machines of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(_table(spark, sf_dir, "documents"))


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_warc(spark, path))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents' tokens by two vocabularies: a load of the first one's counts under both versions, a recount by the
    second, delivered twice, and the removal of documents without tokens."""
    first, second = "byte_bpe_50k", "word_bpe_49k"
    counts = saved(token_counts.bpe_counts(_table(spark, sf_dir, "documents"), {v: tokenizer_path(f"{v}.json") for v in (first, second)}), "counts")
    old = counts.where(F.col("tokenizer") == first)
    guess = old.withColumn("tokenizer", F.lit(second))
    recount = token_counts.revised(guess, counts.where(F.col("tokenizer") == second))
    rollup = token_counts.TokenRollup(spark)
    rollup.apply("load", token_counts.inserted(old.unionByName(guess)))
    rollup.apply("recount", recount)
    rollup.apply("recount", recount)
    rollup.compact()
    rollup.apply("empty", token_counts.deleted(counts.where("tokens = 0")))
    return rollup.totals()


def op8_word_byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rollup over counts that SQL can check, words and bytes, after four batches: a load with first guesses, a recount, a
    second version, and the removal of documents without words. The recount is delivered twice and counts once."""
    counts = saved(token_counts.word_and_byte_counts(_table(spark, sf_dir, "documents")), "counts")
    by = lambda version, column: counts.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(column).alias("tokens"), "words")
    recount = token_counts.revised(by("words-1", "parts"), by("words-1", "words"))
    rollup = token_counts.TokenRollup(spark)
    rollup.apply("load", token_counts.inserted(by("words-1", "parts")))
    rollup.apply("recount", recount)
    rollup.apply("bytes", token_counts.inserted(by("bytes-1", "bytes")))
    rollup.apply("recount", recount)
    rollup.compact()
    rollup.apply("empty", token_counts.deleted(by("words-1", "words").where("words = 0").unionByName(by("bytes-1", "bytes").where("words = 0"))))
    return rollup.totals()


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _number(value: Column) -> Column:
    """A fixed number for a string: the first seven hex digits of its MD5."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 7), 16, 10).cast("int")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures, against lists derived from them: hosts that are added, mostly removed and sometimes added again,
    some domains, and a seventh of all pages by their URL. Days follow from fixed numbers of the patterns."""
    pages = _table(spark, sf_dir, "pages")
    first = F.lit("2023-01-01").cast("date")
    captures = pages.select("page_id", "url", F.date_add(first, F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetch_date"))
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("pattern")).where("pattern is not null").distinct()
    n = _number(F.col("pattern"))
    by_host = hosts.select("pattern", n.alias("n")).withColumn("list", F.concat(F.lit("hosts-"), (F.col("n") % 3).cast("string")))
    turns = [("add", F.col("n") % 300, F.lit(True)), ("remove", F.col("n") % 300 + 20 + F.floor(F.col("n") / 1000) % 100, F.col("n") % 4 != 0), ("add", F.col("n") % 300 + 150, F.col("n") % 5 == 0)]
    day = lambda d: F.date_add(first, d.cast("int")).alias("entry_date")
    entries = None
    for action, when, holds in turns:
        part = by_host.where(holds).select("list", F.lit("host").alias("kind"), "pattern", F.lit(action).alias("action"), day(when))
        entries = part if entries is None else entries.unionByName(part)
    domains = hosts.select(F.concat_ws(".", F.slice(F.split("pattern", r"\."), -3, 3)).alias("pattern")).where(F.size(F.split("pattern", r"\.")) == 3).distinct()
    listed = domains.where(n % 6 == 0).select(F.lit("domains").alias("list"), F.lit("domain").alias("kind"), "pattern", F.lit("add").alias("action"), day(n % 365))
    urls = pages.where("page_id % 7 = 0 and url is not null").select(
        F.lit("pages").alias("list"), F.lit("url").alias("kind"), url_filters.page_of(F.col("url")).alias("pattern"), F.lit("add").alias("action"), day(F.col("page_id") % 365)
    )
    intervals = url_filters.listed_intervals(entries.unionByName(listed).unionByName(urls))
    return url_filters.judge_captures(captures, intervals)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


def op12_pii_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitising.span_columns(sanitising.personal_spans(_table(spark, sf_dir, "documents")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mix, op2_ngram_jaccard, op3_pattern_packing, op4_exact_dedup, op5_suffix_dedup, op6_warc, op7_quality_rules, op8_token_counts, op8_word_byte_counts, op9_toxicity, op10_url_filters, op11_vector_codes, op12_pii_sanitising, op13_importance_resampling)}


_SIZES = r"""
SELECT doc_id, source, text,
       CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS place
FROM documents"""

#: Sizes and targets by the contract (the water level from sums over pairs of sources), then one document after the other: first
#: fit in the order of places, and exchanges chosen among all pairs of documents.
OP1_SQL = rf"""
WITH RECURSIVE sizes AS ({_SIZES}),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighted AS (
  SELECT *, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight FROM sources),
levels AS (
  SELECT a.cap / a.weight AS ratio, (SELECT sum(source_size) FROM sources) AS everything,
         coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0) AS full_caps, sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS open_weight
  FROM weighted a CROSS JOIN weighted b GROUP BY a.source, a.cap, a.weight),
water AS (
  SELECT min_by(CAST(everything - full_caps AS DOUBLE) / open_weight, ratio) AS level FROM levels
  WHERE ratio >= CAST(everything - full_caps AS DOUBLE) / open_weight),
targets AS (SELECT source, source_size, least(weight * level, CAST(cap AS DOUBLE)) AS target FROM weighted CROSS JOIN water),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole, CAST(floor(target * 0.001) AS BIGINT) AS near FROM targets),
atoms AS (
  SELECT source, place, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY place) AS k FROM sizes WHERE size > 0 GROUP BY source, place),
fits AS (
  SELECT source, CAST(0 AS BIGINT) AS k, near, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS missing, CAST(-1 AS BIGINT) AS place, CAST(0 AS BIGINT) AS size, whole, 0 AS extra FROM plan
  UNION ALL
  SELECT f.source, a.k, f.near, CASE WHEN f.missing > f.near AND a.size <= f.missing THEN f.missing - a.size ELSE f.missing END, a.place, a.size, f.whole,
         CASE WHEN f.missing > f.near AND a.size <= f.missing THEN 1 ELSE 0 END
  FROM fits f JOIN atoms a ON a.source IS NOT DISTINCT FROM f.source AND a.k = f.k + 1),
swaps AS (
  SELECT 0 AS turn, source, near, place, size, whole, whole + extra AS copies, last_value(missing) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS missing, true AS moved FROM fits
  UNION ALL
  SELECT s.turn + 1, s.source, s.near, s.place, s.size, s.whole,
         CASE WHEN s.place < 0 THEN s.copies ELSE s.copies + (s.place = m.best.place)::INT - (s.place = m.best.out_place)::INT END, s.missing + m.best.out - m.best.size, true
  FROM swaps s JOIN (
    SELECT a.source, min(struct_pack(far := greatest(abs(a.missing + a.size - b.size), a.near), kind := (b.place >= 0 AND b.copies > b.whole)::INT, gap := abs(a.missing + a.size - b.size),
                                     "out" := a.size, size := b.size, out_place := a.place, place := b.place)) AS best
    FROM swaps a JOIN swaps b ON a.source IS NOT DISTINCT FROM b.source
    WHERE (a.place < 0 OR a.copies > 0) AND (b.place < 0 OR b.copies < 3) AND abs(a.missing) > a.near AND abs(a.missing + a.size - b.size) < abs(a.missing)
    GROUP BY a.source) m ON m.source IS NOT DISTINCT FROM s.source),
final AS (SELECT source, place, arg_max(copies, turn) AS copies FROM swaps WHERE place >= 0 GROUP BY source, place)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(s.size * c AS BIGINT) AS taken, CAST(c AS INTEGER) AS copies
FROM (
  SELECT s.doc_id, s.size, s.source, p.source_size, p.target, CASE WHEN p.target <= 0 THEN 0 ELSE coalesce(f.copies, p.whole) END AS c
  FROM sizes s JOIN plan p ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN final f ON f.source IS NOT DISTINCT FROM s.source AND f.place = s.place) s
JOIN plan p ON p.source IS NOT DISTINCT FROM s.source"""

OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT body, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY body)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN g.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.top <> p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.body = g.body AND p.payload_bytes >= 1000"""

OP8_SQL = r"""
WITH d AS (
  SELECT source, lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words, octet_length(encode(coalesce(text, ''))) AS bytes
  FROM documents)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS docs, CAST(sum(words) AS BIGINT) AS tokens FROM d WHERE words > 0 GROUP BY 1, 2
UNION ALL
SELECT source, lang, 'bytes-1', count(*), CAST(sum(bytes) AS BIGINT) FROM d WHERE words > 0 GROUP BY 1, 2"""

OP10_SQL = r"""
WITH c AS (
  SELECT page_id, url, date_add(DATE '2023-01-01', to_days(CAST((page_id * 37) % 365 AS INTEGER)))::DATE AS fetch_date,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         lower(regexp_extract(regexp_replace(regexp_replace(url, '#.*$', ''), '/$', ''), '^[^/?]*(?://[^/?]*)?'))
         || regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '/$', ''), '^[^/?]*(?://[^/?]*)?', '') AS page
  FROM pages),
h AS (SELECT DISTINCT host AS pattern, CAST('0x' || substr(md5(host), 1, 7) AS INTEGER) AS n FROM c WHERE host IS NOT NULL),
dom AS (SELECT DISTINCT array_to_string(string_split(pattern, '.')[-3:], '.') AS pattern FROM h),
domn AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 7) AS INTEGER) AS n FROM dom WHERE len(string_split(pattern, '.')) = 3),
e AS (
  SELECT 'hosts-' || (n % 3) AS list, 'host' AS kind, pattern, 'add' AS action, n % 300 AS day FROM h
  UNION ALL SELECT 'hosts-' || (n % 3), 'host', pattern, 'remove', n % 300 + 20 + (n // 1000) % 100 FROM h WHERE n % 4 <> 0
  UNION ALL SELECT 'hosts-' || (n % 3), 'host', pattern, 'add', n % 300 + 150 FROM h WHERE n % 5 = 0
  UNION ALL SELECT 'domains', 'domain', pattern, 'add', n % 365 FROM domn WHERE n % 6 = 0
  UNION ALL SELECT 'pages', 'url', page, 'add', page_id % 365 FROM c WHERE page_id % 7 = 0 AND url IS NOT NULL),
daily AS (SELECT list, kind, pattern, day, max(action = 'remove') AS removed FROM e GROUP BY 1, 2, 3, 4),
i AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS until FROM daily),
v AS (
  SELECT list, kind, pattern, (DATE '2023-01-01' + CAST(day AS INTEGER)) AS valid_from, (DATE '2023-01-01' + CAST(until AS INTEGER)) AS valid_to FROM i WHERE NOT removed),
hit AS (
  SELECT c.page_id, v.list, v.valid_from FROM c JOIN v ON v.kind = 'host' AND v.pattern = c.host AND v.valid_from <= c.fetch_date AND (v.valid_to IS NULL OR c.fetch_date < v.valid_to)
  UNION ALL
  SELECT c.page_id, v.list, v.valid_from FROM c JOIN v ON v.kind = 'url' AND v.pattern = c.page AND v.valid_from <= c.fetch_date AND (v.valid_to IS NULL OR c.fetch_date < v.valid_to)
  UNION ALL
  SELECT c.page_id, v.list, v.valid_from FROM c JOIN v ON v.kind = 'domain' AND (v.pattern = c.host OR ends_with(c.host, '.' || v.pattern))
    AND v.valid_from <= c.fetch_date AND (v.valid_to IS NULL OR c.fetch_date < v.valid_to)),
found AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(valid_from) AS since FROM hit GROUP BY page_id)
SELECT c.page_id, f.lists IS NOT NULL AS blocked, f.lists, f.since FROM c LEFT JOIN found f USING (page_id)"""

OP4_SQL = """
WITH groups AS (
  SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, g.keep_id IS NULL) AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d JOIN groups g ON coalesce(d.text, '') = g.t"""




def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every part against every entry in each round, a WITH clause a step."""
    gap = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        "whole AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM whole, range({parts}) r(p))",
        f"seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole QUALIFY e < {entries})",
        "book0 AS MATERIALIZED (SELECT p, e, x AS c FROM cut JOIN seeds USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec_id, label, p, min(struct_pack(gap := {gap}, e := e)) AS best, any_value(x) AS x FROM cut JOIN book{r} USING (p) GROUP BY 1, 2, 3)")
        if r < rounds:
            steps.append(
                f"sums{r} AS (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, best.e AS e, x, unnest(range(1, len(x) + 1)) AS i FROM near{r}) GROUP BY 1, 2, 3), "
                f"moved{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sums{r} GROUP BY 1, 2), "
                f"book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM book{r} LEFT JOIN moved{r} USING (p, e))"
            )
    return (
        "WITH " + ",\n".join(steps) + f",\ncodes AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best.gap) AS BIGINT) AS error FROM near{rounds} GROUP BY 1, 2)"
        f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM codes"
    )


def _op12_sql() -> str:
    """Plain patterns with running sums of lengths, and terms with counts over all places of all texts."""
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({digits}), i + 1, 1) AS INTEGER) ELSE CAST(substr(reverse({digits}), i + 1, 1) AS INTEGER) * 2 % 10 + CAST(substr(reverse({digits}), i + 1, 1) AS INTEGER) // 5 END)) % 10 = 0"
    kinds = {
        "email": (email, "true", "lower(v)"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0", "v"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END", digits),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15", digits),
    }
    found, near = [], []
    for o, (kind, (pattern, holds, name)) in enumerate(kinds.items()):
        cut = lambda t: f"SELECT r, unnest(m) AS v, unnest(g[1:len(m)]) AS before, unnest(g[2:]) AS after, generate_subscripts(m, 1) AS i FROM (SELECT r, regexp_extract_all({t}, '{pattern}') AS m, string_split_regex({t}, '{pattern}') AS g FROM d)"  # noqa: B023, E731
        found.append(f"SELECT r, {o} AS o, '{kind}' AS kind, upto - length(v) AS a, upto AS b FROM (SELECT r, v, sum(length(before) + length(v)) OVER (PARTITION BY r ORDER BY i) AS upto FROM ({cut('t')})) WHERE {holds}")
        sides = "CASE WHEN length(before) > 100 THEN regexp_replace(right(before, 100), '^\\p{L}+', '') ELSE before END || ' ' || CASE WHEN length(after) > 100 THEN regexp_replace(left(after, 100), '\\p{L}+$', '') ELSE after END"
        near.append(f"SELECT '{kind}' AS kind, {name} AS entity, {sides} AS around FROM ({cut('t' if kind == 'email' else 'plain')}) WHERE {holds}")
    share = lambda beside, everywhere: f"1 + log2(least(1.0::DOUBLE, {beside} / CAST({everywhere} AS DOUBLE))) / log2(positions / CAST(cover AS DOUBLE))"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{email}', ' ', 'g') AS plain FROM documents),
spans AS MATERIALIZED ({" UNION ALL ".join(found)}),
mentions AS ({" UNION ALL ".join(near)}),
words AS MATERIALIZED (SELECT r, lower(unnest(regexp_extract_all(plain, '\p{{L}}{{4,}}'))) AS term FROM d),
total AS (SELECT CAST(count(*) AS DOUBLE) AS positions FROM words),
terms AS (SELECT term, count(*) AS everywhere FROM words GROUP BY 1),
pairs AS (
  SELECT term, kind, entity, count(*) AS beside, count(DISTINCT around) AS places
  FROM (SELECT kind, entity, around, lower(unnest(regexp_extract_all(around, '\p{{L}}{{4,}}'))) AS term FROM mentions) GROUP BY 1, 2, 3),
covers AS (SELECT kind, entity, sum(beside) AS cover FROM pairs GROUP BY 1, 2),
flagged AS MATERIALIZED (
  SELECT DISTINCT term FROM pairs JOIN covers USING (kind, entity) JOIN terms USING (term) CROSS JOIN total
  WHERE places >= 2 AND positions > cover AND {share("beside", "everywhere")} >= 0.9),
parts AS (
  SELECT r, unnest(m) AS v, unnest(g[1:len(m)]) AS before, generate_subscripts(m, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, '{email}|\p{{L}}{{4,}}') AS m, string_split_regex(t, '{email}|\p{{L}}{{4,}}') AS g FROM d WHERE r IN (SELECT r FROM words JOIN flagged USING (term)))),
hits AS (
  SELECT r, 4 AS o, 'term' AS kind, upto - length(v) AS a, upto AS b FROM (SELECT r, v, sum(length(before) + length(v)) OVER (PARTITION BY r ORDER BY i) AS upto FROM parts)
  WHERE NOT contains(v, '@') AND lower(v) IN (SELECT term FROM flagged)),
every AS (SELECT * FROM spans UNION ALL SELECT * FROM hits),
rows AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         count(*) FILTER (kind = 'term') AS n_term, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY o, a) FILTER (o < 4) AS base,
         string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY o, a) AS spans
  FROM every GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_term, 0) AS n_term,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN rows USING (r)"""


#: CRC-32 byte after byte over hexadecimal digits of each distinct word, whole sums, and ranks by one sort.
OP13_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
steps AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS step),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
bytes AS (SELECT word, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM hexed),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, step[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes CROSS JOIN steps),
found AS (SELECT side, doc_id, bucket FROM words JOIN hashed USING (word)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM found GROUP BY 1),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counts CROSS JOIN sums),
weights AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1),
scores AS (
  SELECT d.doc_id, coalesce(w.n, 0) AS n_features, coalesce(w.weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM documents d LEFT JOIN weights w USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scores),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, CAST(s.n_features AS BIGINT) AS n_features, s.weight, s.score, CASE WHEN p.place <= 10 * p.n // 100 THEN p.place END AS rank
FROM scored s LEFT JOIN places p USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_warc": OP6_SQL, "op8_word_byte_counts": OP8_SQL, "op10_url_filters": OP10_SQL, "op11_vector_codes": _op11_sql(), "op12_pii_sanitising": _op12_sql(), "op13_importance_resampling": OP13_SQL}
