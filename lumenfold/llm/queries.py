"""Queries of this folder's operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curve_pack, edit_match, gru_lm, jpeg, rule_ensemble, simhash, site_tree, token_store, url_filter, warc
from .common import table


def op1_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Odd rows and empty tables: as its operator states."""
    return site_tree.site_tree_query(spark, table(spark, sf_dir, "pages"))


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from archives of segmented records. Odd rows and empty tables: as its operator states."""
    return warc.warc_query(spark, table(spark, sf_dir, "pages"))


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back from a baseline JPEG, with dimensions and thumbnail hashes. Odd rows and empty tables: as its operator states."""
    return jpeg.media_query(spark, table(spark, sf_dir, "documents"))


def op4_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Odd rows and empty tables: as its operator states."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences along the curve. Odd rows and empty tables: as its operator states."""
    return curve_pack.pack_documents(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back from the content-addressed store. Odd rows and empty tables: as its operator states."""
    return token_store.token_store_query(spark, table(spark, sf_dir, "documents"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document. Odd rows and empty tables: as its operator states."""
    return rule_ensemble.quality_query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_edit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the benchmark items that it holds. Odd rows and empty tables: as its operator states."""
    return edit_match.decontamination_query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url. Odd rows and empty tables: as its operator states."""
    return url_filter.url_query(spark, table(spark, sf_dir, "pages"))


def op10_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every document. Odd rows and empty tables: as its operator states."""
    return gru_lm.language_model_query(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_site_tree, op2_warc_segments, op3_jpeg_media, op4_simhash_variants, op5_curve_packing, op6_token_store, op7_rule_ensemble, op8_edit_match, op9_url_trees, op10_gru_lm)}
ORACLE_SQL: dict[str, str] = {
    "op2_warc_segments": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes
            FROM pages
        ), k AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
        FROM k
    """,
}
