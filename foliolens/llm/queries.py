"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm import (centroids, decontaminate, language, packing, passages, pii, prefix_trie, quality, secrets,
                           simhash, sketch, sql, toxicity, vector_copies)

#: A key for the queries; a user passes a secret of their own.
PII_KEY = "example key of the registered query"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def tokenizer() -> dict[str, str]:
    """Where the vocabulary lies; a parameter of the packing operator."""
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@query
def op1_secrets(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query
def op2_decontaminate(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id", "n_same")


@query
def op4_fingerprints(spark, sf_dir):
    return sketch.edited_pairs(table(spark, sf_dir, "documents"))


@query
def op5_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, matrix = language.prototypes(docs.where(fold(5) != 0))
    return (language.predict(docs, langs, matrix)
            .select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"))


@query
def op6_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), **tokenizer())


@query
def op7_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return pii.pseudonymise(docs, PII_KEY)


@query
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.learn(docs, table(spark, sf_dir, "labels").where(fold(3) != 1))
    return toxicity.score(docs, weights).select(
        "doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.rate(docs, model).select("doc_id", "expected_grade", "tail_probability", "keep")


@query
def op11_centroids(spark, sf_dir):
    return centroids.digests(centroids.cluster(table(spark, sf_dir, "embeddings")))


SQL["op11_centroids"] = sql.centroid_sql()


@query
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("prefix")


SQL["op12_prefix_trie"] = sql.trie_sql()


@query
def op13_vector_copies(spark, sf_dir):
    return vector_copies.near_copies(table(spark, sf_dir, "embeddings"))
