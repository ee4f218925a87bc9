"""Sinks: dashboard batches, bulk import rows, run settings, and bounded HTML pages."""

from __future__ import annotations

import html
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlake.functions.text import key_id

#: Tokens at the start of a sequence whose activations can be zeroed on export.
START_TOKENS = ("<bos>", "<|endoftext|>")


@dataclass(frozen=True)
class ExportConfig:
    """Where an export belongs. All missing fields are reported together."""

    model_name: str = ""
    creator_id: str = ""
    release_id: str = ""
    release_title: str = ""
    url: str = ""
    source_set: str = ""
    layer: int = 0
    hook_point: str = ""
    suffix: str | None = None
    zero_out_start: bool = False

    def __post_init__(self) -> None:
        missing = [k for k in ("model_name", "creator_id", "release_id", "release_title", "url", "source_set") if not getattr(self, k)]
        if missing:
            raise ValueError(f"missing: {', '.join(missing)}")

    @property
    def source(self) -> str:
        return f"{self.layer}-{self.source_set}" + (f"__{self.suffix}" if self.suffix else "")

    @property
    def hook(self) -> str:
        return f"blocks.{self.layer}.{self.hook_point}"


def without_start(tokens: Column, values: Column) -> Column:
    return F.zip_with(tokens, values, lambda t, v: F.when(t.isin(*START_TOKENS), 0.0).otherwise(v))


def activation_rows(features: DataFrame, zero_out_start: bool = False) -> DataFrame:
    """One bulk row for each activation: id, index, tokens, values, maxValue, maxValueTokenIndex (first), minValue and its bins.

    features: rows of the dashboard schema.
    """
    rows = features.select("feature_index", F.posexplode("activations").alias("at", "a"))
    values = without_start(F.col("a.tokens"), F.col("a.values")) if zero_out_start else F.col("a.values")
    rows = rows.withColumn("values", values)
    return rows.select(
        key_id(F.col("feature_index"), F.col("at")).alias("id"), F.col("feature_index").alias("index"), F.col("a.tokens").alias("tokens"), "values",
        F.array_max("values").alias("maxValue"), (F.array_position("values", F.array_max("values")) - 1).cast("int").alias("maxValueTokenIndex"), F.array_min("values").alias("minValue"),
        F.col("a.bin_min").alias("binMin"), F.col("a.bin_max").alias("binMax"), F.col("a.bin_contains").alias("binContains"), F.col("a.qualifying_token_index").alias("qualifyingTokenIndex"),
        F.col("a.dfa_values").alias("dfaValues"), F.col("a.dfa_maxValue").alias("dfaMaxValue"), F.col("a.dfa_targetIndex").alias("dfaTargetIndex"),
    )


def feature_rows(features: DataFrame, activations: DataFrame, config: ExportConfig) -> DataFrame:
    """One bulk row for each feature; maxActApprox is 0 or the largest of its activations."""
    best = activations.groupBy(F.col("index").alias("feature_index")).agg(F.max("maxValue").alias("_m"))
    out = features.join(best, "feature_index", "left").withColumn("maxActApprox", F.greatest(F.lit(0.0), F.coalesce("_m", F.lit(0.0))))
    has_vector = F.coalesce(F.size("vector") > 0, F.lit(False))
    extra = {"modelId": F.lit(config.model_name), "layer": F.lit(config.source), "creatorId": F.lit(config.creator_id), "hasVector": has_vector, "vectorDefaultSteerStrength": F.when(has_vector, F.col("maxActApprox")), "hookName": F.when(F.col("vector").isNotNull(), F.lit(config.hook))}
    return out.withColumns(extra).withColumnRenamed("feature_index", "index").drop("_m", "activations")


def _folder(spark: SparkSession, path: str):
    """Hadoop path and file system of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def batch_ids(spark: SparkSession, folder: str) -> list[int]:
    """Batches that a folder has already."""
    at, files = _folder(spark, folder)
    names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def write_batches(features: DataFrame, head: dict[str, str], folder: str) -> None:
    """One JSON document a row of `batch_id`, nulls left out; batches that exist already stay as they are, so a rerun adds nothing.

    A batch is a bounded number of features, each with a bounded report.
    """
    new = features.where(~F.col("batch_id").isin(batch_ids(features.sparkSession, folder)))
    batches = new.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in features.columns if c != "batch_id"]))).alias("features"))
    batches.select(*(F.lit(v).alias(k) for k, v in head.items()), "features", "batch_id").write.mode("append").partitionBy("batch_id").json(folder)


def write_result(features: DataFrame, stats: DataFrame, path: str) -> None:
    """A report's data as JSON lines, one a feature, under the keys feature_data_dict and feature_stats. path ends in .json."""
    if not path.endswith(".json"):
        raise ValueError("the path of a result must end in .json")
    for name, rows in (("feature_data_dict", features), ("feature_stats", stats)):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def export(features: DataFrame, config: ExportConfig, created_at: str, folder: str) -> None:
    """Everything a bulk import takes: release, model, source set and source once, and gzipped features and activations by batch.

    features: rows of the dashboard schema with batch_id.
    """
    write_heads(features.sparkSession, config, created_at, folder)
    activations = activation_rows(features, config.zero_out_start)
    about = {"modelId": F.lit(config.model_name), "layer": F.lit(config.source), "creatorId": F.lit(config.creator_id), "createdAt": F.lit(created_at)}
    batch = features.select(F.col("feature_index").alias("index"), "batch_id")
    rows = activations.withColumns(about).join(batch, "index")
    for name, part in (("features", feature_rows(features, activations, config).withColumn("createdAt", F.lit(created_at))), ("activations", rows)):
        part.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", False).partitionBy("batch_id").json(f"{folder}/{name}")


def write_bulk(rows: DataFrame, folder: str) -> None:
    """Gzipped JSON lines; nulls are written."""
    rows.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", False).json(folder)


def write_heads(spark: SparkSession, config: ExportConfig, created_at: str, folder: str) -> None:
    """release, model, sourceset and source: one row each. All but source stay as they are if they exist."""
    rows = {
        "release": {"name": config.release_id, "title": config.release_title, "url": config.url, "creatorId": config.creator_id, "createdAt": created_at, "visibility": "PUBLIC"},
        "model": {"id": config.model_name, "instruct": config.model_name.endswith("-it"), "creatorId": config.creator_id, "createdAt": created_at, "visibility": "PUBLIC"},
        "sourceset": {"modelId": config.model_name, "name": config.source_set, "releaseName": config.release_id, "creatorId": config.creator_id, "createdAt": created_at, "visibility": "PUBLIC"},
        "source": {"id": config.source, "modelId": config.model_name, "setName": config.source_set, "creatorId": config.creator_id, "createdAt": created_at, "visibility": "PUBLIC"},
    }
    for name, row in rows.items():
        frame = spark.createDataFrame([tuple(row.values())], list(row))
        frame.coalesce(1).write.mode("overwrite" if name == "source" else "ignore").option("ignoreNullFields", False).json(f"{folder}/{name}")


def renamed(rows: DataFrame, field: str, value: str) -> DataFrame:
    """Rows with one field rewritten; rows without it stay as they are."""
    return rows.withColumn(field, F.when(F.col(field).isNotNull(), F.lit(value))) if field in rows.columns else rows


def rewrite(spark: SparkSession, source: str, target: str, field: str, value: str) -> None:
    """A bulk folder with one field rewritten, written apart."""
    write_bulk(renamed(spark.read.json(source), field, value), target)


def rename_in_place(spark: SparkSession, folder: str, field: str, value: str) -> None:
    """Rewrites one field of all rows of a bulk folder.

    The new rows are written beside it and take its place when they are whole; the old ones are kept as .old until then,
    and put back if that fails. An .old that a lost run has left is put back first.
    """
    folder = folder.rstrip("/")
    (at, files), (new, _), (old, _) = (_folder(spark, f"{folder}{end}") for end in ("", ".new", ".old"))
    if files.exists(old) and not files.exists(at):
        files.rename(old, at)
    files.delete(new, True)
    rewrite(spark, folder, f"{folder}.new", field, value)
    files.delete(old, True)
    if not files.rename(at, old):
        raise OSError(f"{folder} can't be moved")
    try:
        if not files.rename(new, at):
            raise OSError(f"{folder}.new can't be moved")
    except Exception:
        files.rename(old, at)
        raise
    files.delete(old, True)


def run_settings(config: object) -> str:
    return json.dumps(asdict(config), sort_keys=True, default=str)


def html_page(features: DataFrame, title: str, limit: int = 200) -> str:
    """A page with a table a feature for at most `limit` features: what a browser can show is collected, nothing else."""
    rows = features.orderBy("feature_index").limit(limit).toJSON().collect()
    payload = json.dumps([json.loads(r) for r in rows]).replace("</", "<\\/")
    options = "".join(f"<option>{json.loads(r)['feature_index']}</option>" for r in rows)
    script = "const show=i=>{document.getElementById('out').textContent=JSON.stringify(DASHBOARD_DATA[i],null,1)};document.getElementById('pick').onchange=e=>show(e.target.selectedIndex);if(DASHBOARD_DATA.length)show(0);"
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><select id=pick>{options}</select><pre id=out></pre><script>const DASHBOARD_DATA={payload};{script}</script>"
