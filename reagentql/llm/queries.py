"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reagentql.llm import contract_sql
from reagentql.llm.common import table


def _spans(kinds: tuple[str, ...] | None) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined in their order."""
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.tokencount import prefix_token_counts

    counted = prefix_token_counts(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.toxicity import THRESHOLD, fit, held_out, score_documents

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.decontaminate import benchmark_overlaps

    return benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.bytebpe import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha(F.col("decoded")).alias("decoded_sha256"),
    )


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.suffixes import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.secrets import scan_secrets

    base = ("assign", "access", "hex")
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_count, base), _sha(_spans(base)).alias("base_sha256"), _spans(None).alias("spans"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.pii import scan_personal

    base = ("email", "ip", "card", "phone")
    found = scan_personal(table(spark, sf_dir, "documents"))
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores")
    return found.select("doc_id", *map(_count, base), _sha(_spans(base)).alias("base_sha256"), _spans(None).alias("spans"), scores)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.common import Scratch
    from reagentql.llm.merkle import folded, leaf_digest, proof_digest, proofs, write_manifest

    c = F.col
    other = [c("doc_id"), c("source"), c("lang"), c("n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(c("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_digest(*other, lowered))
    docs = table(spark, sf_dir, "documents")
    manifest = write_manifest(docs, leaf_digest(*other, c("text")), c("source"), c("doc_id"), {"doc_id": c("doc_id"), "tampered": tampered})
    found = proofs(manifest).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(c("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), c("path")).alias("folded_root")
    )
    out = Scratch(spark).spill(found.withColumn("verified", c("folded_root") == c("root")))
    manifest.delete()
    return out


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.centroids import centroid_clusters

    found = centroid_clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)
    joined = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", _sha(joined).alias("centroid_sha256"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reagentql.llm.quality import THRESHOLD, fit, held_out, score_documents

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_token_counts,
            op2_toxicity,
            op3_decontaminate,
            op4_byte_bpe,
            op5_exact_topk,
            op6_repeated_passages,
            op7_simhash,
            op8_url_filter,
            op9_secret_scan,
            op10_personal_data,
            op11_merkle_manifest,
            op12_centroids,
            op13_quality,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_topk": OP5_SQL, "op11_merkle_manifest": contract_sql.merkle_sql(), "op12_centroids": contract_sql.centroids_sql()}
