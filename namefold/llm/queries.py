"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namefold.llm import chat, decontaminate, exact_dedup, jaccard_join, line_dedup, packing, quality, toxicity, url_filter, warc
from namefold.llm.common import table


def word_tokenizer() -> str:
    """The path of the public tokenizer that packing counts in; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(table(spark, sf_dir, "documents"), word_tokenizer())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(more))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(spark, table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op6_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_two_fit": op2_best_two_fit,
    "op3_chat_format": op3_chat_format,
    "op4_warc": op4_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_model": op6_url_model,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_jaccard_join": op10_jaccard_join,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A word of the contamination rule, for RE2.
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOW} AS low FROM documents),
        g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY low)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(low) AS text_sha256
        FROM t JOIN g USING (low)""",
    "op7_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines),
        often AS (
            SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 40
            GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
            SELECT doc_id, line, pos, coalesce(doc_id <> last_id, false) AS gone
            FROM keyed LEFT JOIN often USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op9_benchmark_decontamination": f"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM documents),
        i AS (
            SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM benchmark),
        w AS (
            SELECT DISTINCT item_id, least(len(ws), 13) AS size, array_to_string(ws[s:s + least(len(ws), 13) - 1], ' ') AS words
            FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
        sizes AS (SELECT DISTINCT size FROM w),
        places AS (
            SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM d JOIN sizes ON len(ws) >= size),
        hits AS (
            SELECT doc_id, s, places.size AS size, item_id
            FROM places JOIN w ON places.size = w.size AND array_to_string(ws[s:s + places.size - 1], ' ') = w.words),
        hit_words AS (
            SELECT doc_id, count(DISTINCT place) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM hits) GROUP BY doc_id),
        found AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (
            SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS shingle
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS s FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        o AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
            FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (
            SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
            WHERE 100 * o >= 75 * (na.n + nb.n - o)),
        reach AS (
            SELECT a AS doc_id, a AS other FROM link
            UNION
            SELECT reach.doc_id, b FROM reach JOIN link ON other = a)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(w.doc_id, min(other)), w.doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY w.doc_id, n""",
    "op3_chat_format": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
        e AS (
            SELECT *, length(x) + length(regexp_replace(x, '[^\\\\]', '', 'g'))
                      + len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 3) = '###'))
                      + len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 7) = '</turn>')) AS n
            FROM (SELECT *, unnest([r, t]) AS x, unnest([length(r) - length(replace(r, ':', '')), 0]) AS colons FROM c)),
        s AS (SELECT conv_id, sum(n + colons) AS n FROM e GROUP BY conv_id)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
               CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
               CAST(14 * count(*) + any_value(s.n) AS BIGINT) AS formatted_chars
        FROM c JOIN s USING (conv_id) GROUP BY conv_id""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT *, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first_id FROM p),
        d AS (
            SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(floor(i / 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS digest
            FROM h)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d""",
}
