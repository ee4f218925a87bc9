"""Queries of the corpus operators, one for each, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlake.llm.common import held_out, table


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from actlake.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actlake.llm import line_dedup

    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actlake.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_imatch_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actlake.llm import fingerprint

    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actlake.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actlake.llm import secrets

    return secrets.digests(table(spark, sf_dir, "documents"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actlake.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actlake.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actlake.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actlake.llm import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actlake.llm import runs

    return runs.digests(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from actlake.llm import alignment

    return alignment.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actlake.llm import ngram_lm

    return ngram_lm.perplexities(table(spark, sf_dir, "documents"), order=2)


QUERIES = (op1_bpe_codec, op2_line_dedup, op3_source_mix, op4_imatch_fingerprint, op5_quality_qda, op6_secret_scan, op7_minhash_neardup, op8_ann_search, op9_language_id, op10_url_filter, op11_periodic_runs, op12_token_alignment, op13_ngram_lm)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from actlake.llm import line_dedup, url_filter

    return {"op2_line_dedup": line_dedup.ORACLE_SQL, "op10_url_filter": url_filter.ORACLE_SQL}
