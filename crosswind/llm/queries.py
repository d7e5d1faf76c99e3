"""The registered queries of the operators; each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind.llm import ctw, decontam, embed_dedup, langid, mixing, packing, quality_cnn, ranked, secrets, simhash, suffix_index, token_cache, turns
from crosswind.llm.common import table


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op2_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_simhash_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op5_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ownership_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_place", "mix_weight")


def op11_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_big_integer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repairs(turns.damaged(table(spark, sf_dir, "conversations")))


def op13_shared_term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_context_tree,
        op2_projection_passes,
        op3_ownership_frequency,
        op4_byte_cnn,
        op5_nearest_centroid,
        op6_simhash_positions,
        op7_suffix_levels,
        op8_temperature_mixing,
        op9_token_cache,
        op10_bm25_wand,
        op11_sum_of_squares,
        op12_big_integer_repair,
        op13_shared_term_sets,
    )
}

# What only one SQL statement can say: all pairs by brute force.
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT COUNT(*) FROM links WHERE links.a = e.vec_id) AS n_links,
       (SELECT MIN(b) FROM reach WHERE reach.a = e.vec_id) AS component_id,
       (SELECT MIN(b) FROM reach WHERE reach.a = e.vec_id) = vec_id AS kept
FROM embeddings e
"""

# The automaton of the repair, one step of all conversations a recursion, with (cost, audit) as a pair.
OP12_SQL = """
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
named AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
fates AS (
  SELECT named.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, CAST(length(k) + 1 AS BIGINT)), lambda i: CAST(ord(k[i]) AS BIGINT))),
         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS fate FROM named, bytes),
rows AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fates WHERE fate <> 0),
timed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS time FROM rows),
numbered AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS i, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS body, time,
         ROW_NUMBER() OVER w AS place, left(LAG(role) OVER w, 1) AS before
  FROM timed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time)),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN time > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
convs AS (
  SELECT o.conv_id, COUNT(place) AS n, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (WHERE fault = 'blank') AS blank,
         COUNT(*) FILTER (WHERE fault = 'duplicate') AS duplicate, COUNT(*) FILTER (WHERE fault = 'truncated') AS truncated,
         COUNT(*) FILTER (WHERE place > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY 1),
never AS (SELECT {'c': 1000000000000, 'a': ''} AS no),
-- h is what follows when a row is settled, f what follows when insertions may come first
steps AS (
  SELECT conv_id, n AS place, {'st': {'c': CAST(0 AS BIGINT), 'a': ''}, 'sy': no, 'us': no, 'ac': {'c': CAST(0 AS BIGINT), 'a': ''}} AS h FROM convs, never
  UNION ALL
  SELECT conv_id, place - 1, {
    'st': least({'c': f.st.c + 4, 'a': 'D' || f.st.a}, CASE WHEN bad THEN no ELSE {'c': f.us.c + 3 + more, 'a': 'R' || f.us.a} END,
                CASE WHEN bad OR i NOT IN ('s', 'u') THEN no WHEN i = 's' THEN {'c': f.sy.c + more, 'a': 'K' || f.sy.a} ELSE {'c': f.us.c + more, 'a': 'K' || f.us.a} END),
    'sy': least({'c': f.sy.c + 4, 'a': 'D' || f.sy.a}, CASE WHEN bad THEN no ELSE {'c': f.us.c + 3 + more, 'a': 'R' || f.us.a} END,
                CASE WHEN bad OR i <> 'u' THEN no ELSE {'c': f.us.c + more, 'a': 'K' || f.us.a} END),
    'us': least({'c': f.us.c + 4, 'a': 'D' || f.us.a}, CASE WHEN bad THEN no ELSE {'c': f.ac.c + 3 + more, 'a': 'R' || f.ac.a} END,
                CASE WHEN bad OR i <> 'a' THEN no ELSE {'c': f.ac.c + more, 'a': 'K' || f.ac.a} END),
    'ac': least({'c': f.ac.c + 4, 'a': 'D' || f.ac.a}, CASE WHEN bad THEN no ELSE {'c': f.us.c + 3 + more, 'a': 'R' || f.us.a} END,
                CASE WHEN bad OR i <> 'u' THEN no ELSE {'c': f.us.c + more, 'a': 'K' || f.us.a} END)}
  FROM (
    SELECT s.conv_id, s.place, i, fault IN ('blank', 'duplicate') AS bad, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more, no, {
      'st': least(h.st, {'c': h.us.c + 3, 'a': 'I' || h.us.a}, {'c': h.ac.c + 6, 'a': 'II' || h.ac.a}),
      'sy': least(h.sy, {'c': h.us.c + 3, 'a': 'I' || h.us.a}, {'c': h.ac.c + 6, 'a': 'II' || h.ac.a}),
      'us': least(h.us, {'c': h.ac.c + 3, 'a': 'I' || h.ac.a}),
      'ac': least(h.ac, {'c': h.us.c + 3, 'a': 'I' || h.us.a})} AS f
    FROM steps s JOIN faults r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.place = s.place, never)),
ends AS (
  SELECT conv_id, least(h.st, {'c': h.us.c + 3, 'a': 'I' || h.us.a}, {'c': h.ac.c + 6, 'a': 'II' || h.ac.a}) AS e FROM steps WHERE place = 0),
letters AS (
  SELECT conv_id, o, e.a[o] AS letter FROM (SELECT conv_id, e, unnest(range(1, CAST(length(e.a) + 1 AS BIGINT))) AS o FROM ends)),
placed AS (
  SELECT *, COUNT(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY o) AS place FROM letters),
kept AS (
  SELECT p.*, r.role, r.text, letter = 'K' AND r.i = 's' AS first
  FROM placed p LEFT JOIN faults r ON p.letter <> 'I' AND r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.place = p.place WHERE letter <> 'D'),
lines AS (
  SELECT conv_id, o, CASE WHEN letter = 'K' THEN role ELSE CASE (COUNT(*) FILTER (WHERE NOT first) OVER (PARTITION BY conv_id ORDER BY o)) % 2
         WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || COALESCE(text, '') AS line FROM kept),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY o) AS whole FROM lines GROUP BY 1)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, e.c AS cost, e.a AS audit, sha256(COALESCE(whole, '')) AS repaired_sha256
FROM convs c JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""

TERMS_SQL = r"""unnest(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
OP13_SQL = f"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, doc_id, {TERMS_SQL.format("text")} AS term FROM d),
total AS (SELECT COUNT(DISTINCT r) AS docs, COUNT(*) AS terms FROM words),
sizes AS (SELECT r, ANY_VALUE(doc_id) AS doc_id, COUNT(*) AS n FROM words GROUP BY 1),
counts AS (SELECT r, term, COUNT(*) AS tf FROM words GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * COUNT(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counts, total GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {TERMS_SQL.format("text")} AS term FROM benchmark)),
scored AS (
  SELECT item_id, r, ANY_VALUE(doc_id) AS doc_id, CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (r), total GROUP BY 1, 2),
ranked AS (SELECT item_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
ORACLES: dict[str, str] = {"op2_projection_passes": OP2_SQL, "op12_big_integer_repair": OP12_SQL, "op13_shared_term_sets": OP13_SQL}
