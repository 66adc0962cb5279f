"""Queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, license_scan, ngram_join, piece_codec, source_mix, token_count, token_store, toxicity, url_filter
from .shared import Store, read


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; any other path may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(read(spark, sf_dir, "embeddings"), Store(spark, "op1"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(read(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mix.plan(read(spark, sf_dir, "documents"), Store(spark, "op3"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digests(read(spark, sf_dir, "documents"), Store(spark, "op5"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(read(spark, sf_dir, "documents"), Store(spark, "op6"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(read(spark, sf_dir, "documents"), Store(spark, "op7"), tokenizer_path("word_bpe_49k.json"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages"), Store(spark, "op9"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.encoded(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_license_scan,
        op3_source_mix,
        op4_toxicity,
        op5_exact_dedup,
        op6_ngram_join,
        op7_token_store,
        op8_token_count,
        op9_url_filter,
        op10_piece_codec,
    )
}

SQL = {
    # exact: every pair; the operator finds links by hashing, of which the tests measure the recall
    "op1_embedding_dedup": """
        WITH RECURSIVE ok AS (
            SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
                  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
        reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT id, b FROM reach JOIN links ON a = other),
        found AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
        n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN found ON vec_id = id LEFT JOIN n ON vec_id = a""",
    # exact: every pair with a shingle in common
    "op6_ngram_join": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
        n AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM both_have JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
        reach(id, other) AS (SELECT doc_id, doc_id FROM t UNION SELECT id, y FROM reach JOIN links ON other = x)
        SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id
        FROM t LEFT JOIN n USING (doc_id) JOIN reach ON t.doc_id = id GROUP BY t.doc_id""",
    "op2_license_scan": license_scan.sql(),
    "op3_source_mix": source_mix.sql(),
    "op9_url_filter": url_filter.sql(),
    "op5_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}
