"""The registered queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.bpe import bpe_round_trip
from phasegrid.llm.embed_dedup import embedding_dedup
from phasegrid.llm.fingerprint import fingerprint_documents, to_hex
from phasegrid.llm.hpyp import hpyp_scores
from phasegrid.llm.html_extract import extract_main_text
from phasegrid.llm.mixing import mix_sources
from phasegrid.llm.quality import classify_quality
from phasegrid.llm.simhash import simhash_dedup
from phasegrid.llm.substring import substring_dedup
from phasegrid.llm.warc import warc_round_trip
from phasegrid.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that costs far more than moving a row: tables in fewer parts than there are
    slots (small ones, in few row groups) are dealt out; larger ones are read where they lie."""
    df = _table(spark, sf_dir, name).select(*columns)
    slots = spark.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_dealt(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "n_blocks", "n_content")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", to_hex(F.col("lanes")).alias("fingerprint"), to_hex(F.col("edited_lanes")).alias("edited_fingerprint"), "near_edited", "near_next")


def op6_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe_round_trip(_dealt(spark, sf_dir, "documents", "doc_id", "text"), vocabulary)
    return out.select("doc_id", (F.octet_length("ids_packed") / 4).cast("long").alias("n_tokens"), F.sha2("ids_packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(_dealt(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify_quality(_dealt(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "source", "lang", "quality_score", "quality_kept")


def op10_hpyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpyp_scores(_dealt(spark, sf_dir, "documents", "doc_id", "text"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f) for f in (op1_html, op2_embedding_dedup, op3_warc, op4_substring_dedup, op5_fingerprints, op6_bpe, op7_mixing, op8_simhash_dedup, op9_quality, op10_hpyp)
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r(vec_id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.reached),
        n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1),
        c AS (SELECT vec_id, min(reached) AS c FROM r GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
        win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS x FROM starts),
        least AS (SELECT x, min(doc_id) AS least FROM win GROUP BY 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN least USING (x) WHERE least < doc_id),
        tok AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
        kept AS (SELECT tok.doc_id, string_agg(word, ' ' ORDER BY tok.k) FILTER (WHERE gone.k IS NULL) AS kept, count(gone.k) AS n
                 FROM tok LEFT JOIN gone USING (doc_id, k) GROUP BY 1)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
        r AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN last > page_id THEN last END AS refers_to
        FROM d LEFT JOIN r USING (payload_digest)""",
}
