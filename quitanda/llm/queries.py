"""One query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quitanda.llm import (
    filter_audit, line_spread, merge_dropout, ngram_join, packing, pigeonhole, pii, prefix_trie, quality_votes, token_files, toxicity, url_reputation, warc_zst,
)
from quitanda.llm.common import table
from quitanda.session import scratch_path


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_pii(docs, pii.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), pii.base_hash("base").alias("base_sha256"),
                        pii.listed("spans").alias("spans"))


def toxic_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label with its id: bad if of low quality or toxic."""
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = lambda c: F.size(F.split(F.coalesce(c, F.lit("")), "\n", -1)).cast("long")
    return (line_spread.drop_boilerplate(docs.select("doc_id", "text", "source", size(F.col("text")).alias("before")))
            .select("doc_id", (F.col("before") - F.when(F.col("text") == "", F.when(F.col("before") > 1, 0).otherwise(1))
                               .otherwise(size(F.col("text")))).alias("removed_lines"),
                    F.md5("text").alias("text_md5")))


def warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_zst.archive(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pigeonhole_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def ranked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(token_files.token_files(
        table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), str(public_tokenizers.path("word_bpe_49k.json")), packed=True))


def weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_votes.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("posterior", 6).alias("posterior"))


def dropout_model() -> str:
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def dropout_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = merge_dropout.checked(table(spark, sf_dir, "documents"), dropout_model())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "lossless")


def filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": ngram_jaccard,
    "op2_personal_data": personal_data,
    "op3_toxic_chain": toxic_chain,
    "op4_host_reputation": host_reputation,
    "op5_site_spread": site_spread,
    "op6_warc_dictionary": warc_dictionary,
    "op7_pigeonhole_edit": pigeonhole_edit,
    "op8_ranked_ids": ranked_ids,
    "op9_weak_supervision": weak_supervision,
    "op10_dropout_pieces": dropout_pieces,
    "op11_filter_interaction": filter_interaction,
    "op12_packed_windows": packed_windows,
    "op13_conversation_trie": conversation_trie,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents
  UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.r)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT id AS doc_id, min(r) AS component_id FROM reach GROUP BY 1) m USING (doc_id)
""",
    "op4_host_reputation": """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
placed AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM placed),
seen AS (SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bad
  FROM placed JOIN labels ON doc_id = page_id),
hosts AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
    count(*)::DOUBLE AS n, sum(bad) AS bad FROM seen GROUP BY 1),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
alles AS (SELECT coalesce(sum(n), 0) AS tn, coalesce(sum(bad), 0) AS tb FROM suffixes),
s1 AS (SELECT suffix, n, bad, (tb - bad + 1) / (tn - n + 2) AS r, tn - n + 2 AS w FROM suffixes, alles),
s2 AS (SELECT s1.*, least(m, w) AS held FROM s1, (SELECT CASE WHEN coalesce(sum(pow(bad - n * r, 2) - n * r * (1 - r)), 0) <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0,
  sum(n * (n - 1) * r * (1 - r)) / sum(pow(bad - n * r, 2) - n * r * (1 - r)) - 1)) END AS m FROM s1 WHERE n > 1)),
d1 AS (SELECT d.domain, d.n, d.bad, (s2.bad - d.bad + s2.r * s2.held) / (s2.n - d.n + s2.held) AS r, s2.n - d.n + s2.held AS w
  FROM domains d JOIN s2 USING (suffix)),
d2 AS (SELECT d1.*, least(m, w) AS held FROM d1, (SELECT CASE WHEN coalesce(sum(pow(bad - n * r, 2) - n * r * (1 - r)), 0) <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0,
  sum(n * (n - 1) * r * (1 - r)) / sum(pow(bad - n * r, 2) - n * r * (1 - r)) - 1)) END AS m FROM d1 WHERE n > 1)),
h1 AS (SELECT h.host, h.n, h.bad, (d2.bad - h.bad + d2.r * d2.held) / (d2.n - h.n + d2.held) AS r, d2.n - h.n + d2.held AS w
  FROM hosts h JOIN d2 USING (domain)),
h2 AS (SELECT host, bad + r * least(m, w) AS a, n + least(m, w) AS t FROM h1, (SELECT CASE WHEN coalesce(sum(pow(bad - n * r, 2) - n * r * (1 - r)), 0) <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0,
  sum(n * (n - 1) * r * (1 - r)) / sum(pow(bad - n * r, 2) - n * r * (1 - r)) - 1)) END AS m FROM h1 WHERE n > 1)),
h3 AS (SELECT host, a / t - 2 * sqrt(a * (t - a) / (t * t * (t + 1))) AS lower FROM h2)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN h3 USING (host)
""",
    "op5_site_spread": """
WITH split AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
lines AS (SELECT doc_id, source, unnest(list_transform(raw, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS line FROM split),
spread AS (SELECT line FROM lines WHERE line <> '' AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= 10),
marked AS (SELECT doc_id, list(DISTINCT line) AS bad FROM lines JOIN spread USING (line) GROUP BY 1),
cut AS (
  SELECT s.doc_id, text, len(raw) AS before,
    list_filter(raw, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) = '' OR bad IS NULL
      OR NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS kept
  FROM split s LEFT JOIN marked m USING (doc_id)),
done AS (SELECT doc_id, text, before, kept, array_to_string(kept, chr(10)) AS left_text,
    translate(array_to_string(kept, chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') = '' AS nothing FROM cut)
SELECT doc_id, CASE WHEN nothing THEN 0 ELSE before - len(kept) END::BIGINT AS removed_lines,
  md5(CASE WHEN nothing THEN text ELSE left_text END) AS text_md5
FROM done
""",
    "op6_warc_dictionary": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
""",
    "op11_filter_interaction": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1),
masks AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM w LEFT JOIN marks USING (doc_id)),
grouped AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM masks GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, k, substr(o, k, 1) AS letter, (1 << (ascii(substr(o, k, 1)) - 65)) AS bit,
    coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))), 0)::INT AS earlier
  FROM orders, (SELECT unnest(range(1, 6))::INT AS k)),
counted AS (SELECT part, o AS filter_order, k AS step, letter,
    coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(b) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM grouped, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
""",
    # crc32 bit by bit; a node is the list of hashes of its turns
    "op13_conversation_trie": """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
    md5(coalesce(role, '')) || md5(coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c::VARCHAR AS s FROM t),
sums AS (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(s))),
    lambda r, k: xor(CASE WHEN k % 8 = 0 THEN xor(r, ascii(substr(s, (k // 8 + 1)::INT, 1))) ELSE r END >> 1,
      3988292384 * ((CASE WHEN k % 8 = 0 THEN xor(r, ascii(substr(s, (k // 8 + 1)::INT, 1))) ELSE r END) & 1)))) % 4 AS n FROM ids),
taken AS (SELECT sums.c, t.i, t.h, t.words FROM sums JOIN t ON t.c = sums.c - sums.c % 20 AND t.i <= n
  UNION ALL SELECT t.c, t.i + 1000000, t.h, t.words FROM t JOIN sums USING (c) WHERE t.i > n),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, h, words FROM taken),
whole AS (SELECT c, count(h) AS n, coalesce(list(h ORDER BY d) FILTER (h IS NOT NULL), []) AS hs, coalesce(list(words ORDER BY d) FILTER (h IS NOT NULL), []) AS ws
  FROM (SELECT DISTINCT c FROM t) LEFT JOIN turns USING (c) GROUP BY 1),
places AS (SELECT c, n, d, sha256(array_to_string(hs[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(hs[1:d - 1], ',')) END AS up,
    coalesce(ws[d], 0) AS w FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM whole)),
nodes AS (SELECT k, d, any_value(up) AS up, any_value(w) AS w, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM places GROUP BY 1, 2),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY 1),
marked AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
above AS (SELECT DISTINCT low.k, high.k AS a FROM places low JOIN places high ON low.c = high.c AND high.d <= low.d),
sub AS (SELECT a AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM above JOIN marked USING (k) GROUP BY 1)
SELECT m.conv_id, m.d::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM marked m JOIN sub USING (k) LEFT JOIN nodes p ON p.k = m.up
""",
}
