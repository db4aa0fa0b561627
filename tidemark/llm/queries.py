"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, filter_audit, fingerprints, katz, langid, licenses, line_dedup, near_dup, repeats, vector_codes
from tidemark.llm.packing import pack_documents
from tidemark.llm.shared import workspace
from tidemark.llm.token_records import read_token_records, write_token_records
from tidemark.llm.warc import page_records, read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "token-records")
    write_token_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_records(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "record")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), length=100)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_records(read_warc(spark, path))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2, percent=80)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(table(spark, sf_dir, "documents"), lambda i: katz.remainder(i, 10) == 0)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", katz.remainder(F.col("doc_id"), 3) == 1)
    profiles = langid.fit(docs.where("not held_out").select("text", "lang"))
    return langid.predict(profiles, docs.select("doc_id", "held_out", "text")).drop("text")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_id", "coverage", "n_items")


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.encode(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label", parts=16, entries=64, rounds=2, scale=256)
    found = vector_codes.label_errors(coded).withColumn("codebooks_sha256", F.lit(coded.sha256()))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_shared_lines(table(spark, sf_dir, "documents"), least_chars=20, least_documents=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_records, op2_license_scan, op3_repeats, op4_warc, op5_near_duplicates,
        op6_fingerprints, op7_katz, op8_language, op9_decontaminate, op10_best_two_fit,
        op11_vector_codes, op12_line_dedup, op13_filter_audit,
    )
}


def _round(name: str, before: str, moved: bool = True) -> str:
    """DuckDB SQL of one round over the parts: the nearest entry of each (a_), and the codebook that it leaves (b_)."""
    near = f"""a_{name} AS (
            SELECT d.pos, d.part, any_value(d.n) AS n,
                   min(list_sum([(d.part[j] - b.part[j]) * (d.part[j] - b.part[j]) FOR j IN range(1, len(d.part) + 1)])::HUGEINT * 64 + b.entry) AS best
            FROM d JOIN {before} b USING (pos) GROUP BY d.pos, d.part)"""
    if not moved:
        return near
    return near + f""",
        s_{name} AS (
            SELECT pos, entry, j, sum(n * part[j])::HUGEINT AS total, sum(n)::HUGEINT AS held
            FROM (SELECT pos, part, n, best % 64 AS entry, unnest(range(1, len(part) + 1)) AS j FROM a_{name}) GROUP BY ALL),
        m_{name} AS (
            SELECT pos, entry, list(((total - ((total % held) + held) % held) // held)::BIGINT ORDER BY j) AS part FROM s_{name} GROUP BY ALL),
        b_{name} AS (
            SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM {before} b LEFT JOIN m_{name} m ON m.pos = b.pos AND m.entry = b.entry)"""


ORACLE_SQL: dict[str, str] = {
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
        f AS (
            SELECT w.doc_id, part,
                   (len(words) < 100)::INT AS a, (100 * len(list_distinct(words)) < 80 * len(words))::INT AS b,
                   (100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text))::INT AS c,
                   regexp_matches(text, '[#$%&*|]')::INT AS d, (w.doc_id > min(w.doc_id) OVER (PARTITION BY text))::INT AS e,
                   coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic
            FROM w LEFT JOIN (
                SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id) g USING (doc_id)),
        m AS (SELECT *, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails FROM f),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM l l1, l l2, l l3, l l4, l l5
            WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5),
        s AS (
            SELECT filter_order, step::INT AS step, 1 << (instr('ABCDE', filter_order[step]) - 1)::INT AS own,
                   coalesce(list_sum([1 << (instr('ABCDE', filter_order[k]) - 1)::INT FOR k IN range(1, step)]), 0)::INT AS earlier
            FROM o, range(1, 6) r(step)),
        c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
        r AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (fails & (own | earlier) = 0), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (fails & own <> 0 AND fails & earlier <> 0), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS toxic_lost
            FROM c, s GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
        FROM r""",
    "op12_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (
            SELECT doc_id, place, lines[place] AS line,
                   translate(trim(lines[place], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS place FROM d)),
        r AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        g AS (SELECT l.*, r.last IS NOT NULL AND l.doc_id < r.last AS gone FROM l LEFT JOIN r USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM g GROUP BY doc_id""",
    "op11_vector_codes": f"""
        WITH k AS (
            SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        p AS (SELECT vec_id, label, pos, list_slice(v, pos * (len(v) // 16) + 1, (pos + 1) * (len(v) // 16)) AS part FROM k, range(16) t(pos)),
        d AS (SELECT pos, part, count(*) AS n FROM p GROUP BY ALL),
        b_0 AS (
            SELECT pos, entry, part FROM p
            JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 64) USING (vec_id)),
        {_round("1", "b_0")},
        {_round("2", "b_1")},
        {_round("3", "b_2", moved=False)},
        c AS (
            SELECT vec_id, label, string_agg(printf('%02x', (best % 64)::BIGINT), '' ORDER BY pos) AS code, sum(best // 64)::BIGINT AS error
            FROM p JOIN a_3 USING (pos, part) GROUP BY vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) FROM b_2) AS codebooks_sha256
        FROM c""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM f""",
}
