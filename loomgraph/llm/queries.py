"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bpe import bpe_encode
from loomgraph.llm.common import table
from loomgraph.llm.conversations import damaged, repair_summary
from loomgraph.llm.decontaminate import search_benchmark
from loomgraph.llm.exact_dedup import exact_dedup
from loomgraph.llm.filter_audit import audit_filters
from loomgraph.llm.html_text import extract_pages
from loomgraph.llm.language_id import identify_language
from loomgraph.llm.license_scan import scan_licenses
from loomgraph.llm.lm_score import score_documents
from loomgraph.llm.media_store import media_features
from loomgraph.llm.near_dedup import near_duplicates
from loomgraph.llm.quality import classify_quality
from loomgraph.llm.secret_scan import scan_secrets


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify_language(docs, docs.filter(~held_out), held_out=held_out)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), path=F.col("source"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summary(damaged(table(spark, sf_dir, "conversations")))


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


OP2_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


WORDS_OF = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP8_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_OF} AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS m, unnest([list_slice(w, i, i + least(10, len(w)) - 1) for i in range(1, len(w) - least(10, len(w)) + 2)]) AS gram FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT m FROM bw),
d AS (SELECT doc_id, {WORDS_OF} AS w FROM documents),
dw AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m),
grams AS (SELECT dw.doc_id, dw.m, dw.i, list_slice(w, dw.i, dw.i + m - 1) AS gram FROM dw JOIN d USING (doc_id)),
hits AS (SELECT doc_id, m, i, item FROM grams JOIN bw USING (m, gram)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_id AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
said AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM d JOIN least_id USING (t) LEFT JOIN said USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m GROUP BY part, mask),
letters AS (SELECT chr(65 + i::INT) AS letter, (1 << i::INT) AS bit FROM range(5) r(i)),
orders AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || letter FROM orders, letters WHERE NOT contains(filter_order, letter)),
steps AS (SELECT filter_order, step::INT AS step, l.letter, l.bit, (SELECT coalesce(sum(b.bit), 0)::INT FROM letters b WHERE contains(substr(filter_order, 1, step::INT - 1), b.letter)) AS before
    FROM orders, range(1, 6) s(step), letters l WHERE length(filter_order) = 5 AND l.letter = substr(filter_order, step::INT, 1)),
found AS (SELECT part, filter_order, step, letter, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
    FROM c, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op8_benchmark_decontamination": OP8_SQL, "op13_filter_audit": OP13_SQL}
