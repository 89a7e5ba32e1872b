"""The registered queries of this folder and their SQL. Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import encode_corpus, garbled, languages, mix_sources, pack_containers, page_body, split_overlap, text_stats, token_budget


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats.not_prose(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "lang_samples"))


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats.text_statistics(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "lang_samples"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget.unusable_lengths(_read(spark, sf_dir, "tokenized_docs"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = token_budget.record_tokens(_read(spark, sf_dir, "tokenized_docs"), _read(spark, sf_dir, "split_docs"))
    return token_budget.budget(records, _read(spark, sf_dir, "source_catalog"))


def p2_text_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "source_catalog").select("source", "domain").dropDuplicates(["source"]), "source", "left")
    return token_budget.piece_totals(documents.select("source", "lang", "domain", "text"), ["source", "lang", "domain"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.unnamed_languages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "lang_samples"), _read(spark, sf_dir, "lang_labels"))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.document_segments(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "lang_samples"), _read(spark, sf_dir, "lang_labels"))


def p3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.document_languages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "lang_samples"), _read(spark, sf_dir, "lang_labels"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_containers.divided(p4_assignment(spark, sf_dir))


def p4_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_containers.pack(_read(spark, sf_dir, "tokenized_docs"), _read(spark, sf_dir, "container_sizes"))


def p4_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_containers.fill_report(p4_assignment(spark, sf_dir), _read(spark, sf_dir, "container_sizes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_body.furniture_lines(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "lang_samples"))


def p5_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_body.main_body(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "lang_samples"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.found_pairs(_read(spark, sf_dir, "split_docs"))


def p6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlaps(_read(spark, sf_dir, "split_docs"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.report(_read(spark, sf_dir, "split_docs"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus.encode_corpus(_read(spark, sf_dir, "documents"), length=F.col("n_chars"))


def _mixture(spark: SparkSession, sf_dir: str) -> mix_sources.Mixture:
    return mix_sources.Mixture(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).mix()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares()


def p8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shards()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_lines(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "lang_samples"), keep_text=False)


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_lines(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "lang_samples"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_statistics, p2_found, p2_totals, p2_text_totals, p3_found, p3_segments, p3_documents, p4_found, p4_assignment, p4_fill, p5_found, p5_body, p6_found, p6_overlaps, p6_report, p7_ids, p8_mix, p8_shares, p8_shards, p9_found, p9_restored]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested by brute force,
    round trip or held-out accuracy in tests/llm."""
    return {
        "p2_found": "SELECT DISTINCT rec_id FROM tokenized_docs WHERE length IS NULL OR (token_ids IS NOT NULL AND length <> len(token_ids))",
        "p2_totals": """
WITH r AS (SELECT rec_id, any_value(source) AS source, any_value(lang) AS lang,
                  max(CASE WHEN token_ids IS NOT NULL THEN len(token_ids) WHEN length >= 0 THEN length END)::BIGINT AS tokens,
                  bool_or(length IS NULL OR (token_ids IS NOT NULL AND length <> len(token_ids))) AS bad
           FROM tokenized_docs GROUP BY rec_id),
     d AS (SELECT r.source, r.lang, c.domain, r.tokens, r.bad FROM r LEFT JOIN (SELECT source, any_value(domain) AS domain FROM source_catalog GROUP BY source) c USING (source)),
     g AS (SELECT 'slice' AS level, source, lang, domain, count(*) AS records, sum(coalesce(tokens, 0)) AS tokens, count(*) FILTER (tokens IS NULL) AS unmeasured, count(*) FILTER (bad) AS unusable_lengths FROM d GROUP BY source, lang, domain
           UNION ALL SELECT 'source', source, NULL, NULL, count(*), sum(coalesce(tokens, 0)), count(*) FILTER (tokens IS NULL), count(*) FILTER (bad) FROM d GROUP BY source
           UNION ALL SELECT 'lang', NULL, lang, NULL, count(*), sum(coalesce(tokens, 0)), count(*) FILTER (tokens IS NULL), count(*) FILTER (bad) FROM d GROUP BY lang
           UNION ALL SELECT 'domain', NULL, NULL, domain, count(*), sum(coalesce(tokens, 0)), count(*) FILTER (tokens IS NULL), count(*) FILTER (bad) FROM d GROUP BY domain
           UNION ALL SELECT 'all', NULL, NULL, NULL, count(*), sum(coalesce(tokens, 0)), count(*) FILTER (tokens IS NULL), count(*) FILTER (bad) FROM d)
SELECT level, source, lang, domain, records::BIGINT AS records, tokens::BIGINT AS tokens, unmeasured::BIGINT AS unmeasured, unusable_lengths::BIGINT AS unusable_lengths FROM g""",
        "p4_found": "SELECT DISTINCT t.rec_id FROM tokenized_docs t JOIN container_sizes c USING (split) WHERE len(t.token_ids) > c.capacity",
    }
