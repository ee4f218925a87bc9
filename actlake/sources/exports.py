"""Bulk exports that can be stopped, resumed and renamed.

An export is a folder: release, model, sourceset and source (a row each), features and activations by batch and commit, and
`commits`: which commit holds which batch. Rows are written first and the commit's row last, so that a reader sees a batch
whole or not at all; what a lost run has written belongs to no commit and is removed by the next.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlake.sources import sinks
from actlake.sources.folders import Folders

#: What a rename rewrites, with the field that names the model.
HEADS = {"model": "id", "sourceset": "modelId", "source": "modelId"}
TABLES = {"features": "modelId", "activations": "modelId", "explanations": "modelId"}
COMMIT = "batch_id int, commit string, settings string, at long, n_features long, n_activations long"


class Export:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Folders(spark)

    def commits(self) -> dict[int, dict]:
        """The last commit of each batch."""
        if not self.files.exists(f"{self.folder}/commits"):
            return {}
        rows = self.spark.read.schema(COMMIT).json(f"{self.folder}/commits").collect()  # a row a batch
        return {r["batch_id"]: r.asDict() for r in sorted(rows, key=lambda r: r["at"])}

    def read(self, part: str, schema: str | None = None) -> DataFrame:
        """Rows of features, activations or explanations of all batches that are whole, with batch_id; only these files are listed."""
        found = [f"{self.folder}/{part}/batch_id={b}/commit={c['commit']}" for b, c in sorted(self.commits().items())]
        reader = self.spark.read.option("basePath", f"{self.folder}/{part}")
        found = [p for p in found if self.files.exists(p)]
        if not found:
            raise FileNotFoundError(f"no batch in {self.folder}/{part}")
        return (reader.schema(schema) if schema else reader).json(found).drop("commit")

    def write(self, features: DataFrame, config: sinks.ExportConfig, created_at: str) -> list[int]:
        """Adds the batches that the export lacks, or has under other settings; gives their numbers back.

        features: rows of the dashboard schema with batch_id. A batch is written in order of its features, one file a table.
        """
        settings = hashlib.sha256(json.dumps([asdict(config), created_at], sort_keys=True).encode()).hexdigest()[:16]
        known = self.commits()
        same = [b for b, c in known.items() if c["settings"] == settings]
        wanted = sorted(r["batch_id"] for r in features.select("batch_id").distinct().where(~F.col("batch_id").isin(same)).collect())
        sinks.write_heads(self.spark, config, created_at, self.folder)
        if wanted:
            commit, rows = f"c{uuid.uuid4().hex[:12]}", features.where(F.col("batch_id").isin(wanted))
            activations = sinks.activation_rows(rows, config.zero_out_start)
            about = {"modelId": F.lit(config.model_name), "layer": F.lit(config.source), "creatorId": F.lit(config.creator_id), "createdAt": F.lit(created_at)}
            own = rows.select(F.col("feature_index").alias("index"), "batch_id")
            self._add("features", sinks.feature_rows(rows, activations, config).withColumn("createdAt", F.lit(created_at)), commit)
            self._add("activations", activations.withColumns(about).join(own, "index"), commit)
            sizes = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_features"), F.sum(F.coalesce(F.size("activations"), F.lit(0))).cast("long").alias("n_activations"))
            at = max((c["at"] for c in known.values()), default=0) + 1
            sizes.select("batch_id", F.lit(commit).alias("commit"), F.lit(settings).alias("settings"), F.lit(at).alias("at"), "n_features", "n_activations").coalesce(1).write.mode("append").json(f"{self.folder}/commits")
        self.tidy()
        return wanted

    def _add(self, part: str, rows: DataFrame, commit: str) -> None:
        dealt = rows.withColumn("commit", F.lit(commit)).repartition("batch_id").sortWithinPartitions("batch_id", "index")
        dealt.write.mode("append").option("compression", "gzip").option("ignoreNullFields", False).partitionBy("batch_id", "commit").json(f"{self.folder}/{part}")

    def tidy(self) -> None:
        """Removes rows of no commit or of one that another has replaced."""
        keep = {(b, c["commit"]) for b, c in self.commits().items()}
        for part in TABLES:
            for batch in self.files.names(f"{self.folder}/{part}"):
                for commit in self.files.names(f"{self.folder}/{part}/{batch}") if batch.startswith("batch_id=") else ():
                    if (int(batch[9:]), commit.removeprefix("commit=")) not in keep:
                        self.files.remove(f"{self.folder}/{part}/{batch}/{commit}")


def recover(spark: SparkSession, folder: str) -> None:
    """Ends or undoes a rename that was stopped. Its journal is the switch: with it everything becomes new, without it all stays old."""
    folder, files = folder.rstrip("/"), Folders(spark)
    parent, name = folder.rsplit("/", 1)
    for entry in files.names(parent):
        if not entry.endswith(".journal"):
            continue
        job = json.loads(spark.read.text(f"{parent}/{entry}").first()[0])
        if name not in (job["name"], job["target"]):
            continue
        own, staged, target = (f"{parent}/{job[k]}" for k in ("name", "staged", "target"))
        if files.exists(staged):  # the new export isn't in its place yet
            if files.exists(own) and not files.exists(f"{own}.old"):
                files.move(own, f"{own}.old")
            files.move(staged, target)
        files.remove(f"{own}.old")
        files.remove(f"{parent}/{entry}")
    for entry in files.names(parent):
        if entry.startswith(f"{name}.staged-") or entry == f"{name}.journal.part":
            files.remove(f"{parent}/{entry}")


def rename_model(spark: SparkSession, folder: str, model: str, target: str | None = None, step: Callable[[str], None] = lambda name: None) -> str:
    """Writes another model's name into every row of an export, and moves it to the folder `target` beside it if one is named.

    model, sourceset and source, and features, activations and explanations if they are there, are rewritten apart; rows
    without the field stay as they are, and so does the release. When all are whole a journal is written: that is the one
    point at which the rename happens. After a failure before it everything is old, after it everything is new, once
    recover() has run; each call runs it first. step is called with the name of each step before it. Gives the export's
    folder back.
    """
    folder, files = folder.rstrip("/"), Folders(spark)
    recover(spark, folder)
    parent, name = folder.rsplit("/", 1)
    target = target or name
    if target != name and files.exists(f"{parent}/{target}"):
        raise FileExistsError(f"{parent}/{target}")
    staged = f"{name}.staged-{uuid.uuid4().hex[:8]}"
    for part, field in [*HEADS.items(), *TABLES.items()]:
        step(part)
        if files.exists(f"{folder}/{part}"):
            _rewritten(spark, files, folder, f"{parent}/{staged}", part, field, model)
    for part in set(files.names(folder)) - set(HEADS) - set(TABLES):
        step(part)
        files.copy(f"{folder}/{part}", f"{parent}/{staged}/{part}")  # the release and the commits: a row each
    step("journal")
    files.remove(f"{folder}.old")  # of no journal
    files.put(f"{parent}/{name}.journal", json.dumps({"name": name, "staged": staged, "target": target}))
    step("move")
    files.move(folder, f"{parent}/{name}.old")
    step("switch")
    files.move(f"{parent}/{staged}", f"{parent}/{target}")
    step("clean")
    recover(spark, folder)
    return f"{parent}/{target}"


def _rewritten(spark: SparkSession, files: Folders, folder: str, staged: str, part: str, field: str, model: str) -> None:
    by = [] if part in HEADS else _levels(files, f"{folder}/{part}")
    rows = sinks.renamed(spark.read.option("recursiveFileLookup", False).json(f"{folder}/{part}"), field, model)
    writer = rows.write.option("ignoreNullFields", False)
    if part in TABLES:
        writer = writer.option("compression", "gzip")
    (writer.partitionBy(*by) if by else writer).json(f"{staged}/{part}")


def _levels(files: Folders, path: str) -> list[str]:
    """Names of the columns by which a table's folders are parted."""
    out: list[str] = []
    while found := next((n for n in files.names(path) if "=" in n), None):
        out.append(found.split("=")[0])
        path = f"{path}/{found}"
    return out

