"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, divergence, filter_audit, kneser_ney, license_scan, line_dedup, pii, quality_rules, sharding, simhash, suffix_dedup, url_filters
from docloom.llm.common import table

#: Host, path, verdict.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_dropped_lines", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "text")
    return license_scan.scan(docs).withColumn("cosine", F.round("cosine", 6))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_rows(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks), ranks)


def url_rules(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_rules(spark))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_rules, op2_simhash, op3_line_dedup, op4_license_scan, op5_suffix_dedup, op6_hilbert_sharding, op7_byte_bpe, op8_url_filter, op9_decontamination, op10_quality_classifier, op11_pii, op12_filter_audit, op13_source_divergence, pipeline)
    return {f.__name__: f for f in ops}


WORD = r"[^\x20\x09-\x0D]+"
OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM dup) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN line_counts USING (doc_id)),
f AS (
  SELECT *, n_words < 10 AS r0, 100 * n_repeat_words > 20 * n_words AS r1, 10 * n_symbols > word_chars AS r2, 100 * n_dup_lines > 30 * n_lines AS r3, 2 * n_upper > n_upper + n_lower AS r4, word_chars > 40 * n_words AS r5
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4) AS kept,
  (r0::BIGINT + 2 * r1::BIGINT + 4 * r2::BIGINT + 8 * r3::BIGINT + 16 * r4::BIGINT + 32 * r5::BIGINT)::BIGINT AS failed
FROM f"""
OP3 = r"""
WITH d AS (SELECT DISTINCT text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT text, unnest(parts) AS line, unnest(range(0, len(parts))) AS pos FROM d),
w AS (SELECT text, pos, list_filter(string_split_regex(regexp_replace(line, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS words FROM l),
x AS (SELECT text, pos, words, len(words)::VARCHAR || ' ' || array_to_string(words[1:3], ' ') AS leaf, array_to_string(words, ' ') AS own FROM w WHERE len(words) > 0),
leaves AS (SELECT leaf FROM (SELECT leaf, own, count(*) AS n FROM x GROUP BY ALL) GROUP BY leaf HAVING sum(n) >= 5 AND count(*) > 1),
found AS (SELECT text, pos, leaf, words FROM x JOIN leaves USING (leaf) WHERE len(words) > 3),
tokens AS (SELECT leaf, unnest(range(0, len(words))) AS place, unnest(words) AS token FROM found),
places AS (SELECT leaf, place, CASE WHEN max(n) >= 0.8 * sum(n) THEN arg_max(token, n) END AS token FROM (SELECT leaf, place, token, count(*) AS n FROM tokens GROUP BY ALL) GROUP BY leaf, place),
shape AS (SELECT leaf, list(token ORDER BY place) AS shape FROM places GROUP BY leaf HAVING avg((token IS NOT NULL)::INT::DOUBLE) FILTER (WHERE place >= 3) >= 0.6),
agree AS (SELECT text, pos, leaf FROM (SELECT text, pos, leaf, unnest(words) AS a, unnest(shape) AS b FROM found JOIN shape USING (leaf)) GROUP BY ALL HAVING bool_and(b IS NULL OR a = b)),
t AS (SELECT x.text, x.pos, coalesce('L' || agree.leaf, 'O' || own) AS template FROM x LEFT JOIN agree USING (text, pos)),
often AS (SELECT template FROM (SELECT DISTINCT template, text FROM t) GROUP BY template HAVING count(*) >= 5),
all_words AS (SELECT text, flatten(list(words ORDER BY pos)) AS ws FROM x WHERE text IN (SELECT text FROM t JOIN often USING (template)) GROUP BY text),
spots AS (SELECT text, ws, range(1, greatest(len(ws) - 2, 1) + 1) AS p FROM all_words),
heard AS (SELECT text, list_sort(list_distinct(list_transform(CASE WHEN len(list_filter(p, lambda i: (ascii(ws[i]) + length(ws[i])) % 4 = 0)) < 32 THEN p ELSE list_filter(p, lambda i: (ascii(ws[i]) + length(ws[i])) % 4 = 0) END, lambda i: md5(array_to_string(ws[i:i + 2], ' ')))))[1:32] AS voices FROM spots),
alone AS (SELECT text FROM (SELECT text, count(*) OVER (PARTITION BY voice) AS n FROM (SELECT text, unnest(voices) AS voice FROM heard)) GROUP BY text HAVING 3 * count(*) FILTER (n = 1) >= count(*)),
told AS (SELECT text, voices[1:4] AS voices FROM heard WHERE text NOT IN (SELECT text FROM alone)),
v AS (SELECT text, unnest(CASE WHEN len(voices) = 1 THEN voices ELSE flatten(list_transform(range(1, len(voices)), lambda i: list_transform(range(i + 1, len(voices) + 1), lambda j: voices[i] || voices[j]))) END) AS voice, voices[1] AS family FROM told),
kin1 AS (SELECT text, min(least) AS family FROM v JOIN (SELECT voice, min(family) AS least FROM v GROUP BY voice) USING (voice) GROUP BY text),
v1 AS (SELECT v.text, voice, kin1.family FROM v JOIN kin1 USING (text)),
kin AS (SELECT text, min(least) AS family FROM v1 JOIN (SELECT voice, min(family) AS least FROM v1 GROUP BY voice) USING (voice) GROUP BY text UNION ALL SELECT text, 'own ' || text FROM alone),
recurring AS (SELECT template FROM (SELECT DISTINCT template, text FROM t) JOIN kin USING (text) GROUP BY template HAVING count(DISTINCT family) >= 5 AND count(DISTINCT family) * 200 >= count(*)),
gone AS (SELECT text, pos FROM t JOIN recurring USING (template)),
kept AS (SELECT l.text AS whole, count(g.pos) AS n_dropped_lines, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text FROM l LEFT JOIN gone g USING (text, pos) GROUP BY l.text)
SELECT doc_id, coalesce(n_dropped_lines, 0)::BIGINT AS n_dropped_lines, length(k.text)::BIGINT AS n_chars_kept, sha256(k.text) AS kept_sha256 FROM documents LEFT JOIN kept k ON documents.text = k.whole"""
APOSTROPHE = "'"
OP4 = rf"""
WITH t(name, unit) AS (VALUES {", ".join(f"('{a}#{k}', '{b.replace(APOSTROPHE, APOSTROPHE * 2)}')" for k, (a, b) in enumerate(license_scan.ALL_TEMPLATES))}),
d AS (SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{license_scan.CUE}')) AS ls FROM documents),
h AS (SELECT * FROM d WHERE len(ls) > 0),
u AS (
  SELECT DISTINCT * FROM (
    SELECT doc_id, path, 'header' AS kind, unnest(ls) AS unit FROM h
    UNION ALL SELECT doc_id, path, 'file', text FROM h WHERE len(regexp_extract_all(lower(array_to_string(ls, chr(10))), '{license_scan.TERM}')) >= 0.5 * len(regexp_extract_all(lower(text), '{license_scan.TERM}')))),
ids AS (SELECT DISTINCT 'U' || unit AS id, unit FROM u UNION ALL SELECT 'T' || name, unit FROM t),
v AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(unit), '{license_scan.TERM}')) AS term FROM ids) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(DISTINCT id) FROM v) + 1) / (count(*) + 1)) + 1 AS idf FROM v GROUP BY term),
raw AS (SELECT id, term, tf * idf AS x FROM v JOIN idf USING (term)),
n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY id),
w AS (SELECT id, term, x / norm AS w FROM raw JOIN n USING (id)),
c AS (SELECT a.id, split_part(b.id[2:], '#', 1) AS licence, round(sum(a.w * b.w), 9) AS cosine FROM w a JOIN w b USING (term) WHERE a.id[1] = 'U' AND b.id[1] = 'T' GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= {license_scan.MIN_COSINE}),
best AS (SELECT id[2:] AS unit, cosine, licence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, licence) AS k FROM c) WHERE k = 1),
s AS (SELECT doc_id, path, kind, licence, cosine FROM u JOIN best USING (unit)),
own AS (SELECT doc_id, any_value(licence) FILTER (k = 1) AS own_licence, max(cosine) AS cosine, bool_or(kind = 'file') AS is_file FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) AS k FROM s) GROUP BY doc_id),
voices AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, licence, count(*) AS n FROM s WHERE kind = 'file' GROUP BY ALL),
speaks AS (SELECT dir, licence AS dir_licence FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, licence) AS k FROM voices) WHERE k = 1),
near AS (SELECT doc_id, dir, dir_licence, row_number() OVER (PARTITION BY doc_id ORDER BY length(dir) DESC) AS k FROM d JOIN speaks ON starts_with(path, dir || '/'))
SELECT d.doc_id, d.path, own_licence, round(cosine, 6) AS cosine, CASE WHEN own_licence IS NULL THEN dir END AS inherited_from, coalesce(own_licence, dir_licence) AS licence,
  CASE WHEN own_licence IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN dir_licence IS NULL THEN 'none' ELSE 'inherited' END AS origin
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN (SELECT * FROM near WHERE k = 1) USING (doc_id)"""
OP8 = f"""
WITH r(rule_host, rule_path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS k FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)"""

FOLD = f"'{url_filters.UPPER}', '{url_filters.LOWER}'"
NO_TERM, A_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The patterns of personal data as the contract has them.
PERSONAL = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: (1 + (i + 1) % 2) * reverse({DIGITS})[i]::INT - CASE WHEN i % 2 = 0 AND reverse({DIGITS})[i]::INT > 4 THEN 9 ELSE 0 END)) % 10 = 0"
PLACED = "list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)"
OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(f"SELECT row, {k} AS place, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS pieces FROM d" for k, (kind, pattern) in enumerate(PERSONAL))}),
a AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT row, place, kind, found[i] AS value, ({PLACED})::INT AS start, pieces[i] AS before, pieces[i + 1] AS after FROM a),
base AS (
  SELECT *, start + length(value) AS stop, CASE kind WHEN 'email' THEN translate(value, {FOLD}) WHEN 'ip' THEN value ELSE {DIGITS} END AS entity,
    CASE WHEN length(before) > 80 THEN regexp_replace(right(before, 80), '^{A_TERM}', '') ELSE before END || chr(10) || CASE WHEN length(after) > 80 THEN regexp_replace(left(after, 80), '{A_TERM}$', '') ELSE after END AS near
  FROM s WHERE CASE kind WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0
    WHEN 'card' THEN CASE WHEN length({DIGITS}) BETWEEN 13 AND 19 THEN {LUHN} ELSE false END WHEN 'phone' THEN length({DIGITS}) BETWEEN 9 AND 15 ELSE true END),
known AS (SELECT kind, entity, count(DISTINCT row) AS mentioned FROM base GROUP BY ALL HAVING mentioned >= {pii.MIN_MENTIONS}),
w AS (SELECT row, kind, entity, list_filter(string_split_regex(translate(near, {FOLD}), '{NO_TERM}'), lambda x: x <> '') AS words FROM base JOIN known USING (kind, entity)),
c AS (SELECT *, list_min(list_transform(range(1, greatest(len(words) - 2, 1) + 1), lambda i: md5(array_to_string(words[i:i + 2], ' ')))) AS context FROM w),
n AS (SELECT row, kind, entity, term, min(context) AS context FROM (SELECT *, unnest(words) AS term FROM c) WHERE length(term) >= {pii.MIN_TERM} GROUP BY ALL),
pairs AS (SELECT kind, entity, term, sum(n) AS n_both FROM (SELECT kind, entity, term, context, count(*) AS n FROM n GROUP BY ALL) GROUP BY ALL HAVING sum(n) * sum(n) >= {pii.MIN_CONTEXTS} * sum(n * n)),
held AS (SELECT term, count(DISTINCT row) AS held FROM (SELECT row, unnest(string_split_regex(translate(text, {FOLD}), '{NO_TERM}')) AS term FROM d) WHERE term IN (SELECT term FROM pairs) GROUP BY term),
telling AS (SELECT kind, entity, term FROM pairs JOIN held USING (term) JOIN known USING (kind, entity), (SELECT count(*) AS total FROM d) WHERE mentioned < total AND n_both / held >= pow(mentioned / total, {1 - pii.DISCLOSURE})),
told AS (SELECT DISTINCT row, term FROM base JOIN telling USING (kind, entity)),
b AS (SELECT row, regexp_extract_all(text, '{A_TERM}') AS found, string_split_regex(text, '{A_TERM}') AS pieces FROM d WHERE row IN (SELECT row FROM told)),
e AS (SELECT row, found[i] AS value, ({PLACED})::INT AS start FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM b)),
added AS (SELECT e.row, start, start + length(value) AS stop FROM e JOIN told ON told.row = e.row AND translate(value, {FOLD}) = term WHERE NOT EXISTS (SELECT * FROM base WHERE base.row = e.row AND base.start < e.start + length(e.value) AND base.stop > e.start)),
spans AS (SELECT row, place, kind, start, stop FROM base UNION ALL SELECT row, 4, '{pii.TERM_KIND}', start, stop FROM added),
digest AS (SELECT row, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) AS spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) FILTER (place < 4) AS base, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _ in PERSONAL)} FROM spans GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind, _ in PERSONAL)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN digest USING (row)"""
OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(least < doc_id, false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT unnest([{", ".join(f"'{x}'" for x in filter_audit.orders())}]) AS filter_order),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
e AS (SELECT part, n, good, toxic, filter_order, step, fails[ascii(filter_order[step]) - 64] AS fail, list_bool_or([false] || list_transform(range(1, step), lambda k: fails[ascii(filter_order[k]) - 64])) AS gone, len(list_filter(fails, lambda x: x)) AS k FROM c, s)
SELECT part, filter_order, step::INT AS step, sum(n) FILTER (NOT fail AND NOT gone) AS kept, sum(n) FILTER (fail AND NOT gone) AS removed, sum(n) FILTER (fail AND gone) AS redundant, sum(n) FILTER (fail AND k = 1) AS unique_fails,
  sum(good) FILTER (fail AND NOT gone) AS good_lost, sum(toxic) FILTER (fail AND NOT gone) AS toxic_lost, filter_order[step] AS letter FROM e GROUP BY ALL"""
OP12 = f"""
WITH r AS ({OP12}), h AS (SELECT part, letter, sum(removed)::BIGINT AS shapley FROM r GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(shapley, 0)::BIGINT AS shapley
FROM r JOIN h USING (part, letter)"""
OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{url_filters.UPPER}', '{url_filters.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
vocab AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS lt FROM vocab GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN vocab USING (lang, term) GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS gn FROM c GROUP BY ALL) USING (lang, source)),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(gn, 0) + v))::HUGEINT AS p, (1 + (1000000000::HUGEINT * (total + 1)) // (lt + v))::HUGEINT AS q FROM g JOIN vocab USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM dense WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op3_line_dedup": OP3, "op4_license_scan": OP4, "op8_url_filter": OP8, "op11_pii": OP11, "op12_filter_audit": OP12, "op13_source_divergence": OP13}
