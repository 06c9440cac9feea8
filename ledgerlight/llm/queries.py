"""Registered queries of this subpackage and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, content_sort, ctw, decontam, langid, ngram_join, pii, repeats, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(extra))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.deduplicate(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_tree": op1_context_tree,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_chat_format": op3_chat_format,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": """
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) END AS g FROM w),
        k AS MATERIALIZED (SELECT doc_id, hash(unnest(g)) AS h FROM s),
        b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM k x JOIN k y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM b JOIN s x ON a = x.doc_id JOIN s y ON b = y.doc_id WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a)
        SELECT id AS doc_id, CAST(any_value(len(g)) AS BIGINT) AS n_shingles, min(root) AS component_id FROM r JOIN s ON id = s.doc_id GROUP BY id""",
    "op3_chat_format": chat.oracle(),
    "op4_exact_dedup": """
        WITH n AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS c,
                 length(coalesce(text, '')) AS p
          FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
               CAST(count(*) OVER (PARTITION BY c) AS BIGINT) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(c) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY c ORDER BY p DESC, doc_id)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (
          SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS f FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               list_reduce(list_transform(range(32), lambda i:
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT)
                   >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), lambda a, b: a || b) AS payload_digest,
               CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> f THEN f END AS refers_to
        FROM d""",
    "op9_substring_dedup": """
        WITH w AS (
          SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS a FROM documents),
        d AS (SELECT doc_id, list_filter(a, lambda x: x <> '') AS a FROM w),
        g AS (
          SELECT doc_id, p, array_to_string(a[p:p + 12], ' ') AS k
          FROM (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS p FROM d)),
        m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) < doc_id AS gone FROM g),
        c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM m WHERE gone),
        r AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(list_filter(a, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
        FROM d LEFT JOIN r ON d.doc_id = r.doc_id""",
}
