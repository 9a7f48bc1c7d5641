"""The numbered operators as registered queries over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from urbanpulse.llm import (
    decontaminate, jaccard, language, licenses, neighbours, prefixes, privacy, quality, repeats, resample, token_counts, tokens, toxicity)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe_codes(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.digests(tokens.round_trip(table(spark, folder, "documents")))


def op2_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, folder, "embeddings"))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_documents(table(spark, folder, "documents"))


def op4_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.surrogate_texts(table(spark, folder, "documents"))


def op5_languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op6_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(table(spark, folder, "documents"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op10_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


def op11_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op12_importance_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, folder, "conversations"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_bpe_codes, op2_near_vectors, op3_jaccard_join, op4_surrogates, op5_languages, op6_benchmark_leaks, op7_toxicity,
    op8_quality, op9_token_counts, op10_repeated_bytes, op11_licenses,
    op12_importance_resample, op13_prefix_trie)}
# Words of five-word shingles: between white space, lower-cased, letters and digits only.
LEAKS_SQL = """
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '\\s+'),
             lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '\\s+'),
             lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')), lambda w: w <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(5, len(w)) AS n, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id FROM (SELECT doc_id, item_id, count(*) AS c FROM s JOIN i USING (n, s) GROUP BY ALL)
        JOIN (SELECT item_id, count(*) AS q FROM i GROUP BY ALL) USING (item_id) WHERE c >= 0.8 * q)
SELECT doc_id, count(item_id) AS n_items, coalesce(list(item_id ORDER BY item_id) FILTER (item_id IS NOT NULL), []) AS item_ids,
       count(item_id) > 0 AS contaminated
FROM documents LEFT JOIN hit USING (doc_id) GROUP BY doc_id
"""
TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', '{phrase}')" for i, (phrase, label) in enumerate(licenses.TEMPLATES.items()))
LICENSES_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
base AS (SELECT doc_id, i - 1 AS place, CASE WHEN w[i] = 'mit' THEN 'mit' WHEN w[i] = 'apache' THEN 'apache' ELSE 'gpl' END AS label
         FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
         WHERE (w[i] IN ('mit', 'apache') AND w[i + 1] = 'license') OR (w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license')),
t AS (SELECT id, label, string_split(words, ' ') AS w FROM (VALUES {TEMPLATE_ROWS}) v(id, label, words)),
tg AS (SELECT id, label, len(w) AS n, least(len(w), 3) AS k, i - 1 AS q, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM t)),
dg AS (SELECT doc_id, k, i - 1 AS p, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT unnest([2, 3]) AS k) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, id, label, n, q, p - q AS diagonal FROM dg JOIN tg USING (k, g)),
along AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, id ORDER BY diagonal) > (CASE WHEN n > 3 THEN 3 ELSE 0 END), true) AS b
          FROM (SELECT DISTINCT doc_id, id, n, diagonal FROM hit)),
span AS (SELECT *, sum(b::INT) OVER (PARTITION BY doc_id, id ORDER BY diagonal) AS s FROM along),
found AS (SELECT doc_id, id, label, s, count(DISTINCT q) / (n - least(n, 3) + 1) AS cover
          FROM hit JOIN span USING (doc_id, id, n, diagonal) GROUP BY doc_id, id, label, n, s HAVING cover >= 0.6),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
             array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM base GROUP BY doc_id),
m AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""
# CRC-32 (reflected, 0xEDB88320) of UTF-8 bytes by its table of 256 remainders.
CRC_TABLE = """tbl AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)
                 ORDER BY b) AS t FROM range(256) r(b))"""


def crc_sql(text: str, crc_table: str = "t") -> str:
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(0, octet_length(encode({text}))::INT), lambda i: ('0x' || substr({digits}, (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, {crc_table}[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"


RESAMPLE_SQL = f"""
WITH {CRC_TABLE},
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
f AS (SELECT side, id, unnest(w) AS f FROM w UNION ALL
      SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM w)),
hashed AS (SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), tbl),
counted AS (SELECT side, id, bucket, count(*) AS n FROM f JOIN hashed USING (f) GROUP BY ALL),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM counted GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
          FROM (SELECT bucket, s, t, sum(s) OVER ()::BIGINT AS all_s, sum(t) OVER ()::BIGINT AS all_t FROM buckets)),
weights AS (SELECT id, sum(n) AS n, floor(sum(n * gain) / sum(n))::BIGINT AS weight
            FROM counted JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, len(w.w) AS n_words,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
           FROM documents d JOIN w ON w.side = 'd' AND w.id = d.doc_id LEFT JOIN weights ON weights.id = d.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * 25 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
TRIE_SQL = f"""
WITH {CRC_TABLE},
turns AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST,
            sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
          FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT a.conv_id, a.own, b.own AS base, ({crc_sql("a.conv_id::VARCHAR")}) % 6 AS h
          FROM turns a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 100, tbl),
whole AS (SELECT conv_id, list_concat(coalesce(base, [])[1:h], own[h + 1:]) AS p FROM heads),
steps AS (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM whole),
nodes AS (SELECT p[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                 string_agg(conv_id, ',' ORDER BY conv_id) FILTER (d = len(p)) AS ends FROM steps GROUP BY p[1:d], d),
own AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(k[d].x) END AS saved,
               (SELECT count(*) FROM nodes c WHERE c.d = nodes.d + 1 AND c.k[1:nodes.d] = nodes.k) AS n_children FROM nodes),
below AS (SELECT a.k, a.d, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves
          FROM own a JOIN (SELECT k, saved, n_children, unnest(range(0, d + 1)) AS up FROM own) b ON b.up = a.d AND b.k[1:b.up] = a.k GROUP BY a.k, a.d)
SELECT o.conv_id, o.d AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, sha256(coalesce(o.ends, '')) AS ends_sha256
FROM own o JOIN below USING (k, d) LEFT JOIN nodes u ON u.d = o.d - 1 AND u.k = o.k[1:o.d - 1]
"""
ORACLES: dict[str, str] = {"op13_prefix_trie": TRIE_SQL, "op12_importance_resample": RESAMPLE_SQL, "op6_benchmark_leaks": LEAKS_SQL, "op11_licenses": LICENSES_SQL}
