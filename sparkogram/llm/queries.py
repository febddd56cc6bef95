"""The registered queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from sparkogram.llm import bpe_trie, warc
from sparkogram.llm.chat_format import link_events, turn_events
from sparkogram.llm.decontam_sam import contamination_report
from sparkogram.llm.minhash_tensor import near_duplicates
from sparkogram.llm.quality_qda import quality_scores
from sparkogram.llm.quality_rules import quality_report
from sparkogram.llm.substring_rlz import substring_report
from sparkogram.llm.textstats import text_counts
from sparkogram.llm.toxicity_weak import toxicity_scores
from sparkogram.llm.url_filter import filter_urls
from sparkogram.runtime import cut, table


def tokenizer_path() -> str:
    """The public vocabulary file; a parameter of the operator, never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bucket(modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the folds of the labelled rows."""
    return F.expr(f"crc32(cast(doc_id as string)) % {modulus}")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from rows outside fold 0 of 5."""
    counts = cut(text_counts(table(spark, sf_dir, "documents", "doc_id", "text")), "counts")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    got = quality_scores(counts, labels, train=bucket(5) != 0, threshold=0.3)
    return got.select("doc_id", (bucket(5) == 0).alias("held_out"), "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from rows outside fold 2 of 4."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    got = toxicity_scores(docs, labels, train=bucket(4) != 2, threshold=0.3)
    return got.select("doc_id", (bucket(4) == 2).alias("held_out"), "score", "predicted")


#: Host, path prefix and verdict of the URL rules.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, 5-word shingles, Jaccard 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=5, percent=85)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in all documents, windows of 10 words."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return contamination_report(table(spark, sf_dir, "documents", "doc_id", "text"), items, window=10)


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the learned decision list's verdict on all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_report(docs, labels, cut(text_counts(docs), "counts"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that also start in a smaller document."""
    return substring_report(table(spark, sf_dir, "documents", "doc_id", "text"), min_words=50)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back from the archives."""
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"), min_bytes=0)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    return bpe_trie.encode_digests(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


#: Arguments of the call that a user's turn makes.
CHAT_SCHEMA = [("reply", "text", "string", True), ("reply", "turn", "integer", True)]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, ordered, validated and serialised turns of all conversations."""
    schema = spark.createDataFrame(CHAT_SCHEMA, "name string, field string, type string, required boolean")
    return link_events(turn_events(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")), schema)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_urls": op3_urls,
    "op4_minhash": op4_minhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_rules": op6_rules,
    "op7_substring": op7_substring,
    "op8_warc": op8_warc,
    "op9_bpe": op9_bpe,
    "op10_chat": op10_chat,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_urls": r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
  ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), fit AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
""",
    "op10_chat": r"""
WITH e AS (
  SELECT conv_id, turn::BIGINT AS turn, role, text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN turn::VARCHAR WHEN 'assistant' THEN (turn - 1)::VARCHAR END AS id FROM conversations
), j AS (
  SELECT e.*, o.turn AS other FROM e LEFT JOIN e o
  ON o.conv_id = e.conv_id AND o.id = e.id AND o.kind <> e.kind AND e.kind <> 'message' AND o.kind <> 'message'
), s AS (
  SELECT *, CASE WHEN kind = 'message' THEN 'message' WHEN other IS NOT NULL THEN 'linked'
    WHEN kind = 'call' THEN 'pending' ELSE 'orphan' END AS status FROM j
)
SELECT conv_id, turn, role, kind, id,
  CASE WHEN kind = 'result' THEN greatest(turn, coalesce(other, turn)) ELSE turn END AS place, 0::BIGINT AS depth,
  CASE kind WHEN 'message' THEN 0 WHEN 'call' THEN 1 ELSE 2 END AS rank, status, '' AS errors,
  CASE kind
    WHEN 'call' THEN '{"arguments":{"text":' || to_json(text)::VARCHAR || ',"turn":' || turn || '},"id":"' || id
      || '","name":"reply","status":"' || status || '","type":"call"}'
    WHEN 'result' THEN '{"content":' || to_json(text)::VARCHAR || ',"id":"' || id || '","role":"assistant","status":"'
      || status || '","type":"result"}'
    ELSE '{"content":' || to_json(text)::VARCHAR || ',"role":"' || role || '","type":"message"}' END AS json
FROM s
""",
    "op8_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages
), s AS (
  SELECT page_id, strlen(body) AS n, min(page_id) OVER (PARTITION BY body) AS source, unhex(sha1(body))::BIT::VARCHAR AS bits FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
      + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = source THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> source THEN source END AS refers_to
FROM s
""",
    "op4_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS sh
  FROM w, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS t(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
""",
    "op5_decontaminate": rf"""
WITH q AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS t
  FROM q, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS g(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT n FROM win
), d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS t
  FROM d, sizes, unnest(generate_series(1, len(ws) - n + 1)) AS g(i) WHERE len(ws) >= n
), hit AS (SELECT doc_id, i, win.n, item FROM dw JOIN win ON win.t = dw.t AND win.n = dw.n
), words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, unnest(generate_series(0, n - 1)) AS g(k) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.t, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op7_substring": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM w, unnest(generate_series(1, len(ws) - 49)) AS t(i) WHERE len(ws) >= 50
), first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h
), hit AS (SELECT win.doc_id, i FROM win JOIN first USING (h) WHERE f < win.doc_id
), gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, unnest(generate_series(0, 49)) AS g(k)
), words AS (
  SELECT doc_id, p, ws[p] AS word FROM w, unnest(generate_series(1, len(ws))) AS t(p) WHERE len(ws) > 0
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
}
