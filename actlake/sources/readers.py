"""Readers of vector sets, normalisation statistics and dashboard batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlake.sources.schemas import BATCH, FEATURE


def vector_set(spark: SparkSession, path: str, d_model: int | None = None) -> DataFrame:
    """feature_id, name, w_enc, b_enc = 0 from a JSON file of {"vectors": [[..]], "config": {..}} or without config.

    Names are the config's vector_names, else vector_<i>. A vector of another length than d_model raises an error.
    """
    raw = spark.read.option("multiLine", True).json(path)
    config = dict(raw.dtypes).get("config", "")
    names = F.col("config.vector_names") if "vector_names" in config else F.lit(None).cast("array<string>")
    out = raw.select(names.alias("names"), F.posexplode(F.col("vectors").cast("array<array<double>>")).alias("feature_id", "w_enc"))
    if d_model is not None:
        out = out.withColumn("w_enc", F.when(F.size("w_enc") == d_model, F.col("w_enc")).otherwise(F.raise_error(F.lit("a vector has another length than d_model")).cast("array<double>")))
    return out.select("feature_id", F.coalesce(F.get("names", F.col("feature_id")), F.concat(F.lit("vector_"), F.col("feature_id").cast("string"))).alias("name"), "w_enc", F.lit(0.0).alias("b_enc"))


def norm_stats(spark: SparkSession, path: str, layer: int) -> tuple[list[float], list[float]] | None:
    """Mean and std of a layer's inputs from {layer: {"inputs": {"mean": [..], "std": [..]}}}; None where the layer is missing."""
    raw = spark.read.option("multiLine", True).json(path)
    if str(layer) not in raw.columns:
        return None
    row = raw.select(F.col(f"`{layer}`.inputs.mean").alias("m"), F.col(f"`{layer}`.inputs.std").alias("s")).first()
    return [float(x) for x in row["m"]], [float(x) for x in row["s"]]


def dashboard_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of batch-<n>.json files, with batch_id; any number of files, read in parallel. A folder without any is an error."""
    return spark.read.schema(BATCH).json(f"{folder}/batch-*.json").withColumn("batch_id", F.regexp_extract(F.col("_metadata.file_name"), r"batch-(\d+)", 1).cast("int"))


def written_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What sinks.write_batches() wrote, with batch_id from the folder names."""
    return spark.read.schema(T.StructType([*BATCH.fields, T.StructField("batch_id", T.IntegerType())])).json(folder)


def written_features(spark: SparkSession, folder: str) -> DataFrame:
    """The same, a row a feature: the dashboard schema and batch_id."""
    return written_batches(spark, folder).select("batch_id", F.explode("features").alias("f")).select("f.*", "batch_id")


def result(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Features and statistics of what sinks.write_result() wrote."""
    features = spark.read.schema(FEATURE).json(f"{path}/feature_data_dict")
    return features, spark.read.schema("feature_id int, max_act double, n_active long, frac_active double, frac_nonzero double").json(f"{path}/feature_stats")
