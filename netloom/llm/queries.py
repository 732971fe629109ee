"""Queries of the operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import byte_bpe, html_text, mixing, near_duplicates, quality, source_divergence, substring_dedup, suffix_dedup, token_binary, token_counts, top_products, warc
from netloom.llm.shared import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op3_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_binary.packed(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("epochs")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = token_counts.attributed(docs, _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="first")
    return out.drop("field").withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.joined(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_n_bytes").alias("n_bytes"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_spans").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = byte_bpe.encoded(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audited(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_html_text": op2_html_text,
    "op3_top_products": op3_top_products,
    "op4_token_binary": op4_token_binary,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_source_divergence": op12_source_divergence,
}

#: SQL of the corpus operators for DuckDB.
SQL = {
    "op3_top_products": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op5_mixing": """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws('~', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), coalesce(text, ''))) AS k
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source),
caps AS (SELECT *, (r - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM sources),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM caps),
goals AS (
  SELECT source, source_size, r,
         least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN level <= cap / w THEN level END) OVER (), 0.0) * w) AS target FROM levels),
queued AS (
  SELECT d.doc_id, d.size, d.k, g.r, g.source_size, g.target,
         CAST(sum(d.size) OVER (PARTITION BY g.r ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
turns AS (
  SELECT *, CAST(e * source_size + c AS DOUBLE) / target AS t FROM queued, (SELECT unnest([0, 1, 2]) AS e)
  WHERE size > 0 AND target > 0),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY t, r, e, k, size ROWS UNBOUNDED PRECEDING) AS words FROM turns),
takes AS (
  SELECT doc_id, size, r, c, sum(size) AS taken FROM merged
  WHERE words <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN takes t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.size = t.size AND q.r = t.r AND q.c = t.c
""",
    "op8_quality_rules": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n FROM starts),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1 GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutters
  FROM d LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * n_dup_lines > n_lines OR 10 * stutters > 3 * n_words) AS kept
FROM judged
""",
    "op11_substring_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
starts AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS i,
         unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM d),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM starts),
covered AS (SELECT r, i + k AS i FROM windows, (SELECT unnest(range(35)) AS k) WHERE n > 1 GROUP BY ALL),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
left_over AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
""",
    "op12_source_divergence": """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
matches AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
vocabulary AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_count FROM matches GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(lang_count) AS HUGEINT) AS lang_total FROM vocabulary GROUP BY lang),
kept AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM matches JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, v.term, coalesce(k.n, 0) AS n,
         1 + (1000000000 * (coalesce(k.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
         1 + (1000000000 * (v.lang_count + 5)) // (l.lang_total + 5 * l.v) AS q
  FROM groups g JOIN vocabulary v USING (lang) JOIN langs l USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = v.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
""",
}
