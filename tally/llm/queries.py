"""The registered queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import ann, bpe, collocations, lm_score, mixing, pii, quality_rules, resampling, simhash, suffix_dedup, token_files, toxicity, warc
from tally.llm.common import ship, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))).drop("date")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixture_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, found = token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_simhash": op5_simhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_source_mixing": op8_source_mixing,
    "op9_token_files": op9_token_files,
    "op10_multiprobe_lsh": op10_multiprobe_lsh,
    "op11_personal_data": op11_personal_data,
    "op12_collocations": op12_collocations,
    "op13_importance_resampling": op13_importance_resampling,
}

_RULES = {"symbols": "n_symbols / word_chars", "marks": "n_marks / n_words", "capitals": "n_capitals / word_chars", "dup_lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words"}

OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s:' || lang, 'null') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
windows AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
covered AS (SELECT rid, least(8, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -8)) AS n FROM twice),
repeats AS (SELECT rid, sum(n) AS n FROM covered GROUP BY rid),
counts AS (
  SELECT d.rid, doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_marks, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals
  FROM d LEFT JOIN repeats r ON r.rid = d.rid),
features AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         n_words < {quality_rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality_rules.MOST_REPEAT_PERCENT} AS base_failed
  FROM counts),
scores AS (
  SELECT rid, doc_id, stratum, base_failed, rule, CASE WHEN b > 0 THEN least(1.0::DOUBLE, a::DOUBLE / b) ELSE 0.0 END AS score
  FROM ({" UNION ALL ".join(f"SELECT rid, doc_id, stratum, base_failed, '{r}' AS rule, {x.split(' / ')[0]} AS a, {x.split(' / ')[1]} AS b FROM features" for r, x in _RULES.items())})),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
known AS (
  SELECT stratum, doc_id, rule, min(quality) = 1 AS good, max(score) AS score, ('0x' || substr(md5(doc_id::VARCHAR), 1, 1))::INT % 2 = 1 AS holdout
  FROM scores JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY stratum, doc_id, rule),
gains AS (
  SELECT stratum, rule, c AS cutoff, count_if(NOT good AND score > c) - {quality_rules.GOOD_COST} * count_if(good AND score > c) AS gain
  FROM known, (SELECT unnest([{", ".join(map(str, quality_rules.CUTOFFS))}])::DOUBLE AS c)
  WHERE NOT holdout GROUP BY ALL HAVING gain > 0),
proposed AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS place
  FROM (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1)),
firsts AS (
  SELECT k.stratum, k.doc_id, min(p.place) FILTER (k.score > p.cutoff) AS first
  FROM known k LEFT JOIN proposed p ON p.stratum = k.stratum AND p.rule = k.rule WHERE holdout AND good GROUP BY ALL),
tails AS (
  SELECT stratum, rule, cutoff, CASE WHEN k > n * {quality_rules.RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, (k + 1)::BIGINT), lambda i:
         exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality_rules.RISK}) + (n - i) * ln(1 - {quality_rules.RISK})))) END AS tail
  FROM (SELECT stratum, rule, cutoff, place, count(*) AS n, count(*) FILTER (first <= place) AS k FROM proposed JOIN firsts USING (stratum) GROUP BY ALL)),
taken AS (
  SELECT stratum, rule, cutoff FROM tails WHERE tail <= {quality_rules.DELTA}::DOUBLE / (SELECT count(DISTINCT stratum) FROM proposed)),
rejected AS (SELECT DISTINCT rid FROM scores JOIN taken USING (stratum, rule) WHERE score > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM rejected) AS kept
FROM features
"""

def _urn(kind: str, source: str) -> str:
    return rf"'<urn:uuid:' || regexp_replace(md5('{kind}|' || {source}), '^(.{{8}})(.{{4}}).(.{{3}}).(.{{3}})(.{{12}})$', '\1-\2-3\3-8\4-\5') || '>'"


def _unescaped(text: str) -> str:
    for name, char in warc.ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, name, char.replace("'", "''"))
    return text


_TITLE = _unescaped(r"regexp_replace(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title', 1), '[ \t\r\n]+', ' ', 'g')")
_TEXT = f"regexp_replace(regexp_replace(h, '{warc.DROPPED}', ' ', 'g'), '{warc.BLOCKS}', chr(10), 'g')"
_TEXT = _unescaped(f"regexp_replace({_TEXT}, '{warc.TAGS}', '', 'g')")
_TEXT = rf"regexp_replace(regexp_replace(regexp_replace({_TEXT}, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
_CRLF = "chr(13) || chr(10)"

OP4_SQL = rf"""
WITH r AS (
  SELECT url, coalesce(html, '') AS h, {_urn("response", "coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')")} AS rid FROM pages),
b AS (
  SELECT rid, url, 'sha256:' || sha256(h) AS pd, strlen(h) AS pl, {_urn("metadata", "rid")} AS mid, {_urn("conversion", "rid")} AS cid, {_TITLE} AS title,
         regexp_extract(h, '(?i)<html\b[^>]*\blang="([^"]*)"', 1) AS lang,
         regexp_extract_all(h, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1) AS links, {_TEXT} AS text
  FROM r),
e AS (
  SELECT rid, url, pd, 'metadata' AS t, mid AS id, cid AS other, 'application/warc-fields' AS ct,
         CASE WHEN title <> '' THEN 'title: ' || title || {_CRLF} ELSE '' END || CASE WHEN lang <> '' THEN 'language: ' || lang || {_CRLF} ELSE '' END
         || 'source-http-header: HTTP/1.1 200 OK' || {_CRLF} || 'source-http-header: Content-Type: text/html; charset=utf-8' || {_CRLF}
         || 'source-http-header: Content-Length: ' || pl || {_CRLF} || 'source-payload-digest: ' || pd || {_CRLF} || 'source-payload-length: ' || pl || {_CRLF}
         || array_to_string(list_transform(links, lambda x: 'outlink: ' || {_unescaped("x")} || {_CRLF}), '') AS block
  FROM b UNION ALL
  SELECT rid, url, pd, 'conversion', cid, mid, 'text/plain; charset=utf-8', text FROM b)
SELECT id AS record_id, t AS warc_type, rid AS refers_to, other AS concurrent_to, url AS target_uri, ct AS content_type, strlen(block)::BIGINT AS content_length,
       'sha256:' || sha256(block) AS block_digest, pd AS payload_digest,
       'WARC/1.1' || {_CRLF} || 'WARC-Type: ' || t || {_CRLF} || 'WARC-Record-ID: ' || id || {_CRLF} || 'WARC-Refers-To: ' || rid || {_CRLF} || 'WARC-Concurrent-To: ' || other || {_CRLF}
       || coalesce('WARC-Target-URI: ' || url || {_CRLF}, '') || 'WARC-Date: 1970-01-01T00:00:00Z' || {_CRLF} || 'WARC-Block-Digest: sha256:' || sha256(block) || {_CRLF}
       || 'Content-Type: ' || ct || {_CRLF} || 'Content-Length: ' || strlen(block) || {_CRLF} AS header, block
FROM e
"""

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, source_size / weight AS ratio,
         sum(source_size) OVER () * 150 - 200 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s),
g AS (SELECT *, open * weight >= source_size * 200 * weights AS filled FROM f),
h AS (SELECT open, weights FROM g WHERE NOT filled ORDER BY ratio LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN filled THEN (source_size * 2)::DOUBLE
         ELSE ((SELECT open FROM h) * weight)::DOUBLE / ((SELECT weights FROM h) * 100)::DOUBLE END AS target,
         ('0x' || substr(md5('mix|' || coalesce('s' || source, 'null')), 1, 4))::BIGINT / 65536.0::DOUBLE AS start
  FROM g),
r AS (
  SELECT doc_id, size, source_size::BIGINT AS source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS step,
         row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(step * n + start) - floor(step * (n - 1) + start))::BIGINT * size AS taken FROM r
"""

OP12_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
grams AS ({" UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS phrase FROM w" for k in (1, 2, 3))}),
counts AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k >= 2 AND n >= {collocations.SUPPORT}),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer x ON x.lang = c.lang AND x.phrase = c.phrase WHERE x.a IS NULL OR 100 * x.a < 50 * c.a),
cuts AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.n AS l, r.n AS r, cut, (1000000::HUGEINT * c.a * c.a // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:len(ws)], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst QUALIFY rank <= {collocations.TOP}),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang)
"""

_BITS = "flatten(list_transform(range(strlen(feature)), lambda i: [('0x' || substr(hex(feature), 2 * i::INT + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
_CRC32 = f"xor(4294967295, list_reduce({_BITS}, lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295))"

OP13_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, 's' AS side, doc_id, text FROM documents UNION ALL SELECT NULL, 't', NULL, text FROM benchmark),
w AS (
  SELECT rid, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts),
found AS (SELECT rid, side, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM w),
once AS (SELECT feature, {_CRC32} % {resampling.BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM found)),
features AS (SELECT rid, side, bucket FROM found JOIN once USING (feature)),
counts AS (SELECT bucket, count_if(side = 's') AS s, count_if(side = 't') AS t FROM features GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE + {resampling.BUCKETS} AS s, coalesce(sum(t), 0)::DOUBLE + {resampling.BUCKETS} AS t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((c.t + 1)::DOUBLE * totals.s) / ((c.s + 1)::DOUBLE * totals.t)))::BIGINT AS gain FROM counts c, totals),
weights AS (SELECT rid, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE side = 's' GROUP BY rid),
scored AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (rid) WHERE side = 's'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id) AS place,
         count_if(n_words >= {resampling.LEAST_WORDS}) OVER () * {resampling.PERCENT} // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {resampling.LEAST_WORDS} AND place <= drawn THEN place END AS rank FROM ranked
"""

ORACLE_SQL = {"op13_importance_resampling": OP13_SQL, "op12_collocations": OP12_SQL, "op4_warc_derivatives": OP4_SQL, "op3_quality_rules": OP3_SQL, "op8_source_mixing": OP8_SQL}


def queries() -> dict:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict:
    return dict(ORACLE_SQL)
