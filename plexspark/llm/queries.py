"""The queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexspark.llm import chat, decontam, lines, minhash, negatives, periodic, pieces, pii, quality, sharding, substrings, toxicity, urls
from plexspark.llm.shared import table


def op1_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.mate_preferences(table(spark, sf_dir, "conversations"))
    out = chat.format_preferences(turns)
    learned = lambda m: F.aggregate(m, F.lit(0), lambda n, r: n + F.when(r["learn"], r["length"]).otherwise(0)).cast("long")
    return out.select("pair_id", "n_prompt", "n_chosen", "n_rejected", "prompt", "chosen", "rejected", learned(F.col("chosen_mask")).alias("chosen_learned"), learned(F.col("rejected_mask")).alias("rejected_learned"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), edits=0.2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.quality(docs).select("doc_id", "quality.*")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "zstd_ratio", "bad_chunk_share")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode_documents(docs, rate=0.1, seed=1)
    return out.select("doc_id", F.size("pieces.ids").cast("long").alias("n_pieces"), "pieces.ids", "pieces.round_trip")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs).select("doc_id", "pii.spans", F.length("pii.redacted").alias("redacted_chars"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in pii.KINDS[:4]]
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), score.alias("top_score"), F.coalesce("redacted_chars", F.lit(0)).alias("redacted_chars"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.repeated_spans(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").alias("n_spans"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    keep = {"doc_id": F.col("doc_id"), "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}
    out = sharding.assign(table(spark, sf_dir, "documents"), shards=16, keep=keep)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = toxicity.score(docs, labels.where(~held), label="toxic")
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.mine(rows, F.col("id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_cycles(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = periodic.find_runs(docs, exponent=3, least=24).select("doc_id", "periodic.*")
    out = out.withColumn("best", periodic.longest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent, digest(listed).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"), "n_words")


QUERIES = {f.__name__: f for f in (op1_chat_preferences, op2_decontamination, op3_quality_rules, op4_line_dedup, op5_url_filters, op6_merge_dropout, op7_minhash_near_dedup, op8_pii, op9_substring_dedup, op10_sharding, op11_toxicity, op12_hard_negatives, op13_periodic_runs)}

SQL = {}

SQL["op1_chat_preferences"] = r"""
WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
body AS (SELECT c.* FROM conversations c JOIN last l ON c.conv_id = l.conv_id AND c.turn <= l.last),
answer AS (SELECT c.conv_id, c.turn, min(c.text) AS text FROM body c JOIN last l ON c.conv_id = l.conv_id AND c.turn = l.last AND c.role = 'assistant' GROUP BY ALL),
pair AS (
  SELECT b.conv_id, b.turn, b.role, b.text AS chosen,
         CASE WHEN b.turn = a.turn AND b.role = 'assistant' THEN m.text ELSE b.text END AS rejected
  FROM body b JOIN answer a ON a.conv_id = b.conv_id JOIN answer m ON m.conv_id = xor(b.conv_id, 1)),
split AS (SELECT conv_id, min(turn) FILTER (WHERE chosen <> rejected) AS at FROM pair GROUP BY conv_id),
line AS (
  SELECT p.conv_id, p.turn, p.role, coalesce(p.turn < s.at, TRUE) AS shared, p.chosen, p.rejected,
         '<|im_start|>' || p.role || chr(10) || p.chosen || '<|im_end|>' || chr(10) AS c,
         '<|im_start|>' || p.role || chr(10) || p.rejected || '<|im_end|>' || chr(10) AS r
  FROM pair p JOIN split s ON s.conv_id = p.conv_id)
SELECT conv_id AS pair_id, count(*) FILTER (WHERE shared) AS n_prompt, count(*) FILTER (WHERE NOT shared) AS n_chosen, count(*) FILTER (WHERE NOT shared) AS n_rejected,
       coalesce(string_agg(c, '' ORDER BY turn) FILTER (WHERE shared), '') AS prompt,
       coalesce(string_agg(c, '' ORDER BY turn) FILTER (WHERE NOT shared), '') AS chosen,
       coalesce(string_agg(r, '' ORDER BY turn) FILTER (WHERE NOT shared), '') AS rejected,
       CAST(coalesce(sum(length(chosen) + 10) FILTER (WHERE NOT shared AND role = 'assistant'), 0) AS BIGINT) AS chosen_learned,
       CAST(coalesce(sum(length(rejected) + 10) FILTER (WHERE NOT shared AND role = 'assistant'), 0) AS BIGINT) AS rejected_learned
FROM line GROUP BY conv_id
"""

SQL["op4_line_dedup"] = r"""
WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
roll AS (SELECT doc_id, line, i, substr(md5(coalesce(lag(md5(line)) OVER w, '') || md5(line)), 1, 1) < '5' AS ends FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
part AS (SELECT doc_id, line, i, coalesce(count(*) FILTER (WHERE ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM roll),
chunk AS (
  SELECT doc_id, part, min(i) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes,
         count(*) FILTER (WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') > 1 AS worded
  FROM part GROUP BY doc_id, part),
judged AS (SELECT *, worded AND row_number() OVER (PARTITION BY worded, bytes ORDER BY doc_id, first) > 1 AS gone FROM chunk),
kept AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed,
         coalesce(string_agg(bytes, chr(10) ORDER BY first) FILTER (WHERE NOT gone), '') AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, k.text FROM documents d LEFT JOIN kept k USING (doc_id)
"""

SQL["op5_url_filters"] = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (
  SELECT page_id, regexp_extract(url, '^[^#]*') AS url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM cut),
tag AS (SELECT page_id, host, path, unnest(regexp_extract_all(html, '(?i)<(link|meta)\b[^<>]*>')) AS tag FROM page),
target AS (
  SELECT page_id, host, path, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS to_url FROM tag WHERE regexp_matches(tag, '(?i)^<link\b.*\brel\s*=\s*["'']?canonical\b')
  UNION ALL
  SELECT page_id, host, path, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM tag WHERE regexp_matches(tag, '(?i)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b')),
whole AS (  -- relative targets, without dot segments
  SELECT page_id, CASE WHEN contains(to_url, '://') THEN to_url WHEN starts_with(to_url, '//') THEN 'x:' || to_url WHEN starts_with(to_url, '/') THEN 'x://' || host || to_url
         ELSE 'x://' || host || regexp_extract('/' || ltrim(path, '/'), '^.*/') || to_url END AS url FROM target WHERE to_url <> ''),
ending AS (
  SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM whole),
name AS (
  SELECT *, row_number() OVER () AS n, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.(.)', '\2') || regexp_replace(path, '(/index\.html|\.html)?/*$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS address
  FROM (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')) AS kept
        FROM (SELECT page_id, TRUE AS own, url, host, path, query FROM page UNION ALL SELECT page_id, FALSE, NULL, host, path, query FROM ending))),
rules(h, p, v) AS (VALUES ('com', 'en/', 'block'), ('example.com', 'en/7', 'allow'), ('net', 'de/', 'allow'), ('example.net', 'de/8', 'block'), ('org', 'es/', 'block')),
named AS (
  SELECT s.n, any_value(s.page_id) AS page_id, any_value(s.own) AS own, any_value(s.url) AS url, any_value(s.host) AS host, any_value(s.path) AS path, any_value(s.address) AS address,
         arg_max(r.h || '/' || r.p, length(r.p) * 1000 + length(r.h)) AS rule, arg_max(r.v, length(r.p) * 1000 + length(r.h)) AS verdict
  FROM name s LEFT JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, '/' || r.p) GROUP BY s.n),
-- a page's written and plain address, and its written address and what it points to
edge AS (SELECT p.address || ' ' || p.url AS a, e.address AS b FROM named p JOIN named e ON e.page_id = p.page_id AND (e.n = p.n OR NOT e.own) WHERE p.own AND p.address IS NOT NULL AND e.address IS NOT NULL),
way AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
joined(node, c) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM way UNION
  SELECT k.b, min(j.c) FROM joined j JOIN way k ON k.a = j.node JOIN recurring.joined r ON r.node = k.b WHERE j.c < r.c GROUP BY k.b),
placed AS (SELECT m.*, coalesce(j.c, m.address) AS component FROM named m LEFT JOIN joined j ON j.node = m.address),
flags AS (SELECT component, bool_or(verdict = 'allow') AS allowed FROM placed WHERE verdict IS NOT NULL AND component IS NOT NULL GROUP BY component)
SELECT m.page_id, m.host, m.path, m.rule, coalesce(m.verdict, CASE WHEN NOT f.allowed THEN 'block' ELSE 'allow' END) AS verdict, m.address, m.component
FROM placed m LEFT JOIN flags f ON f.component = m.component WHERE m.own
"""

SQL["op7_minhash_near_dedup"] = r"""
WITH RECURSIVE lower AS (SELECT doc_id, row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
listed AS (SELECT doc_id, row, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM lower),
shingle AS (
  SELECT row, unnest(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM listed),
size AS (SELECT row, count(*) AS n FROM shingle GROUP BY row),
common AS (SELECT a.row AS a, b.row AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.row < b.row GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN size x ON x.row = a JOIN size y ON y.row = b WHERE 100 * c >= 80 * (x.n + y.n - c)
  UNION ALL SELECT b, a FROM common JOIN size x ON x.row = a JOIN size y ON y.row = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
least(row, d) USING KEY (row) AS (
  SELECT row, doc_id FROM listed UNION
  SELECT k.b, min(l.d) FROM least l JOIN link k ON k.a = l.row JOIN recurring.least r ON r.row = k.b WHERE l.d < r.d GROUP BY k.b)
SELECT l.doc_id, coalesce(n, 0) AS n_shingles, d AS component_id, l.doc_id = d AS kept
FROM listed l LEFT JOIN size USING (row) LEFT JOIN least USING (row)
"""

SQL["op9_substring_dedup"] = r"""
WITH listed AS (SELECT doc_id, row_number() OVER () AS row, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
word AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM listed),
place AS (SELECT row, i, string_agg(word, ' ') OVER w AS passage, count(*) OVER w AS n FROM word WINDOW w AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY passage) AS c FROM place WHERE n = 35) WHERE c > 1),
judged AS (SELECT word.row, word.i, word, bool_or(twice.i IS NOT NULL) OVER (PARTITION BY word.row ORDER BY word.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM word LEFT JOIN twice ON twice.row = word.row AND twice.i = word.i),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY i), FALSE) AS opens FROM judged),
summed AS (SELECT row, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM edged GROUP BY row)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS INTEGER) AS n_spans
FROM listed LEFT JOIN summed USING (row)
"""

SQL["op12_hard_negatives"] = r"""
WITH moved AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM moved a JOIN moved b ON a.id % 50 = 0 AND b.id <> a.id),
good AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT g.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY g.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM good g JOIN pair n ON n.anchor_id = g.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

SQL["op13_periodic_runs"] = r"""
WITH listed AS (
  SELECT doc_id, row_number() OVER () AS row, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         -- CRC-32 of the decimal id, bit by bit
         xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, x: list_reduce([xor(c, x)] || range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))) AS h
  FROM documents),
drawn AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 END AS g FROM listed),
circle AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM drawn),
turned AS (SELECT doc_id, row, n, CASE WHEN g IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM circle),
word AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM turned),
gram AS (SELECT row, i, string_agg(word, ' ') OVER w AS gram, count(*) OVER w AS c FROM word WINDOW w AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
-- in a run at least 16 words in a row equal the word a period later
agree AS (SELECT a.row, b.i - a.i AS q, a.i FROM gram a JOIN gram b ON a.row = b.row AND a.gram = b.gram AND a.i < b.i WHERE a.c = 16 AND b.c = 16),
island AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k FROM agree),
stretch AS (SELECT row, q, min(i) AS s, count(*) + 15 + q AS l FROM island GROUP BY row, q, k HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
run AS (SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.row = x.row AND y.q < x.q AND y.s <= x.s AND x.s + x.l <= y.s + y.l)),
gone AS (SELECT DISTINCT row, unnest(range(s + q, s + l)) AS i FROM run),
left_over AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (row, i) GROUP BY row),
best AS (SELECT row, s, l, q FROM run QUALIFY row_number() OVER (PARTITION BY row ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) = 1),
told AS (SELECT row, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM run GROUP BY row)
SELECT t.doc_id, coalesce(r.n, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
       sha256(coalesce(r.runs, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256, t.n AS n_words
FROM turned t LEFT JOIN told r USING (row) LEFT JOIN best b USING (row) LEFT JOIN left_over k USING (row)
"""
