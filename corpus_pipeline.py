"""A training-data pipeline over documents: quality, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it
again as the docs of the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlake import ship
from actlake.llm import bpe, line_dedup, mixing, neardup, quality
from actlake.llm.common import ASCII_SPACE, Workspace, table


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, source and the whole row as one column, so that extra columns can't clash with a stage's own."""
    return docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a score of at least 0.5. The other rows go."""
    rows = _packed(docs)
    scored = quality.score(rows, quality.fit(rows, table(spark, sf_dir, "labels")))
    return scored.where("score >= 0.5").select("_row.*")


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document with a smaller id has as well; n_chars follows, null texts stay null.

    A document of which nothing but space is left, because all else is in documents with smaller ids, goes. All others stay.
    """
    kept = line_dedup.dedup_lines(_packed(docs))
    kept = kept.where((F.col("n_dropped") == 0) | (F.btrim("kept", F.lit(ASCII_SPACE)) != ""))
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    row = F.col("_row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast("long"))
    return kept.select(row.alias("_row")).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Rows with a null id stay."""
    gone = neardup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return _packed(docs).join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select("_row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes its document: none, once or more. A row without words adds nothing and is taken no time."""
    size = mixing.word_count(F.col("text").cast("binary"))
    rows = _packed(docs).withColumn("_size", size).where("_size > 0")
    taken = mixing.mix(docs).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words"), (F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    # Rows that share id, source and size may swap places, so their rank tells them apart.
    nth = lambda df, name, *keys: df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    rows, taken = nth(rows, "_nth", "doc_id", "source", "_size"), nth(taken, "_mth", "_id", "_source", "_words")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_words")) & (F.col("_nth") == F.col("_mth"))
    return rows.join(taken, same).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the packed ids of each row."""
    import public_tokenizers

    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def _shipped(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, once the Python workers have the package."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _shipped(quality_filter)),
    ("line dedup", _shipped(line_filter)),
    ("MinHash near-dedup", _shipped(near_duplicates)),
    ("mixing sources", _shipped(source_mix)),
    ("byte-level BPE", _shipped(tokens)),
]

#: The classifier, the sampling and the encoding aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir))
    return docs
