"""The queries opN_* over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where vocabulary files of public tokenizers lie; None: the installed package that has them.
TOKENIZERS: str | None = None


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.top_k import fagin_top_k, integer_vectors

    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return fagin_top_k(vectors.where(F.col("id") % 100 == 0), vectors, 10)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as c from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * v.c[i])) as score
  from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id and len(q.c) = len(v.c)
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s
)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 10
"""


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.secrets import secret_digest, vocabulary_words

    return secret_digest(table(spark, sf_dir, "documents"), words=vocabulary_words(tokenizer("word_bpe_49k.json")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.licenses import find_licenses

    return find_licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 16)


OP6_SQL = None


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.simhash_dedup import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"), 4, 4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 512)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 4096, 1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_secrets": op2_secrets,
    "op3_licenses": op3_licenses,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {"op1_top_k": OP1_SQL}
