"""Registered queries of the text operators and the SQL that some of them must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlore.llm import bpe, decontaminate, line_dedup, pii, prefix_trie, quality_rules, ranking, simhash, suffix_dedup, token_counts, token_files, vector_codes, warc
from orderlore.llm.tables import read_table

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.remove_repeated_lines(read_table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return left.select("doc_id", F.col("lines_total").alias("n_lines"), F.col("lines_removed").alias("n_removed"), kept)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_files.digests(token_files.read_tokens(*token_files.write_tokens(docs, public_tokenizers.path(BYTE_VOCABULARY))))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(read_table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations")).drop("node")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(*vector_codes.compress(read_table(spark, sf_dir, "embeddings")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(*warc.write_archives(read_table(spark, sf_dir, "pages")))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_token_files": op5_token_files,
    "op6_personal_data": op6_personal_data,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_warc": op13_warc,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Unsigned crc32 of a conversation id in decimal, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _codes_sql(rounds: int) -> str:
    """The rounds of the codebooks written out one after the other."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, v.p AS p, any_value(v.x) AS x, min({{'d': {square}::BIGINT, 'e': c.e}}) AS best FROM parts v JOIN c{r} c ON v.p = c.p GROUP BY vec_id, label, v.p)")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, best.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY p, best.e, i)
  GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT c.p AS p, c.e AS e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.p = m.p AND c.e = m.e)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
c0 AS MATERIALIZED (
  SELECT p, e, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) first USING (vec_id) WHERE e < 256),
{', '.join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
found AS (
  SELECT vec_id, label, string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM found, books"""


SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH items AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows))),
hits AS (SELECT doc_id, places.m AS m, i, item_id FROM places JOIN windows USING (win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT docs.doc_id AS doc_id, len(w) AS n_words, coalesce(hit_words.n, 0) AS n_hit, coalesce(hit_items.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit_words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words ON docs.doc_id = hit_words.doc_id LEFT JOIN hit_items ON docs.doc_id = hit_items.doc_id""",
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, line, md5(trim(line)) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
ahead AS (
  SELECT doc_id, i, w, h, lead(w, 1) OVER d AS w2, lead(w, 2) OVER d AS w3, lead(w, 3) OVER d AS w4,
    lead(h, 1) OVER d AS h2, lead(h, 2) OVER d AS h3, lead(h, 3) OVER d AS h4
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
windows AS (
  SELECT doc_id, i AS s, CASE WHEN w >= 50 THEN 1 WHEN w + w2 >= 50 THEN 2 WHEN w + w2 + w3 >= 50 THEN 3 WHEN h4 IS NOT NULL THEN 4 END AS k,
    CASE WHEN w >= 50 THEN h WHEN w + w2 >= 50 THEN h || h2 WHEN w + w2 + w3 >= 50 THEN h || h2 || h3 ELSE h || h2 || h3 || h4 END AS c
  FROM ahead),
firsts AS (SELECT c, min({'d': doc_id, 's': s}) AS q FROM windows WHERE k IS NOT NULL GROUP BY c HAVING count(*) > 1),
pairs AS (SELECT doc_id, s, q.d AS q_id, s - q.s AS shift FROM windows JOIN firsts USING (c) WHERE k IS NOT NULL AND {'d': doc_id, 's': s} > q),
diagonals AS (SELECT DISTINCT doc_id, q_id, shift FROM pairs),
equal AS (
  SELECT p.doc_id, d.q_id, d.shift, p.i, p.i - row_number() OVER (PARTITION BY p.doc_id, d.q_id, d.shift ORDER BY p.i) AS run
  FROM diagonals d JOIN lines p ON p.doc_id = d.doc_id JOIN lines g ON g.doc_id = d.q_id AND g.i = p.i - d.shift AND g.h = p.h),
runs AS (SELECT DISTINCT e.doc_id, e.q_id, e.shift, e.run FROM equal e JOIN pairs p ON p.doc_id = e.doc_id AND p.q_id = e.q_id AND p.shift = e.shift AND p.s = e.i),
gone AS (SELECT DISTINCT e.doc_id, e.i FROM equal e JOIN runs r ON r.doc_id = e.doc_id AND r.q_id = e.q_id AND r.shift = e.shift AND r.run = e.run),
left_over AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT documents.doc_id AS doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN left_over ON documents.doc_id = left_over.doc_id""",
    "op11_prefix_trie": rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
joined AS (
  SELECT c.conv_id AS conv_id, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND i <= h
  UNION ALL SELECT c.conv_id, 3 + i, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND i > h),
paths AS (
  SELECT conv_id, row_number() OVER o AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(len(role) || ':' || role || len(text) || ':' || text, '') OVER o AS path
  FROM joined WINDOW o AS (PARTITION BY conv_id ORDER BY i)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY path, depth),
up AS (
  SELECT n.path AS path, n.depth AS depth, n.n_convs AS n_convs, n.words AS words, p.path AS above, p.depth AS above_depth
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
children AS (SELECT above AS path, count(*) AS n FROM up WHERE above_depth = depth - 1 GROUP BY above),
totals AS (
  SELECT up.above AS path, sum((up.n_convs - 1) * up.words)::BIGINT AS saved, count(*) FILTER (children.n IS NULL) AS leaves
  FROM up LEFT JOIN children ON children.path = up.path GROUP BY up.above),
ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM paths
  WHERE (conv_id, depth) IN (SELECT (conv_id, max(depth)) FROM paths GROUP BY conv_id) GROUP BY path),
parents AS (SELECT up.path AS path, n.conv_id AS conv_id FROM up JOIN nodes n ON n.path = up.above WHERE above_depth = up.depth - 1)
SELECT nodes.conv_id AS conv_id, nodes.depth AS depth, parents.conv_id AS parent_conv_id, n_convs, coalesce(children.n, 0) AS n_children,
  leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN totals USING (path) LEFT JOIN children USING (path) LEFT JOIN ends USING (path) LEFT JOIN parents USING (path)""",
    "op12_vector_codes": _codes_sql(vector_codes.ROUNDS),
    "op13_warc": """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS n,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages),
hashed AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(sha1(payload), 5 * k::INT + 1, 5))::BIGINT) AS quads FROM rows)
SELECT page_id, strlen(payload) AS payload_bytes, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to,
  array_to_string(list_transform(quads, lambda q: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest
FROM hashed""",
}
