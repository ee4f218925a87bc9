"""Correlation sums that grow with the positions: a mergeable state in a folder, fed by batches or by a stream."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from actlake.operators.corr import merged
from actlake.sources.folders import Folders


class CorrelationState:
    """Sums of corr.SUMS kept by batches of positions; whole sums are the sums of the parts.

    Folders: part=<batch> holds the sums of one batch, gen=<number> those of many with the names of their batches. Each is
    written apart and renamed, so it is there whole or not at all; the highest generation counts, and parts whose batch it
    holds don't. A run that is stopped anywhere leaves the sums as they were, or as they should become.
    """

    def __init__(self, spark: SparkSession, folder: str, by: list[str]):
        self.spark, self.folder, self.by, self.files = spark, folder.rstrip("/"), by, Folders(spark)

    def _generation(self) -> int | None:
        return max((int(n[4:]) for n in self.files.names(self.folder) if re.fullmatch(r"gen=\d+", n)), default=None)

    def _parts(self) -> tuple[list[str], list[str]]:
        """Names of batches: those in the generation, and those in parts of their own."""
        gen = self._generation()
        old = [] if gen is None else [r["batch"] for r in self.spark.read.parquet(f"{self.folder}/gen={gen}/batches").collect()]  # names only
        return old, sorted({n[5:] for n in self.files.names(self.folder) if n.startswith("part=")} - set(old))

    def batches(self) -> list[str]:
        return sorted(sum(self._parts(), []))

    def add(self, batch: str, sums: DataFrame) -> bool:
        """Adds the sums of a batch of positions; False, and nothing is done, if the batch is there already. Names are letters, digits, - and _."""
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError(f"{batch!r} isn't a name")
        if batch in self.batches():
            return False
        own = f"{self.folder}/new-{uuid.uuid4().hex[:8]}"
        merged(sums, self.by).write.parquet(own)
        self.files.move(own, f"{self.folder}/part={batch}")
        return True

    def sums(self) -> DataFrame | None:
        """Whole sums over all batches; None before the first."""
        gen, (_, new) = self._generation(), self._parts()
        paths = ([] if gen is None else [f"{self.folder}/gen={gen}/sums"]) + [f"{self.folder}/part={p}" for p in new]
        return merged(self.spark.read.parquet(*paths), self.by) if paths else None

    def compact(self) -> None:
        """Merges all batches into a new generation; what it replaces is removed after it is there."""
        gen, (old, new) = self._generation(), self._parts()
        if new:
            own, nxt = f"{self.folder}/new-{uuid.uuid4().hex[:8]}", 0 if gen is None else gen + 1
            self.sums().write.parquet(f"{own}/sums")
            self.spark.createDataFrame([(b,) for b in sorted(old + new)], "batch string").coalesce(1).write.parquet(f"{own}/batches")
            self.files.move(own, f"{self.folder}/gen={nxt}")
        self.tidy()

    def tidy(self) -> None:
        """Removes what a generation has replaced and what lost runs have left."""
        gen, (_, new) = self._generation(), self._parts()
        keep = {f"part={b}" for b in new} | ({f"gen={gen}"} if gen is not None else set())
        for name in self.files.names(self.folder):
            if name.startswith(("part=", "gen=", "new-")) and name not in keep:
                self.files.remove(f"{self.folder}/{name}")


def correlate_stream(stream: DataFrame, sums_of: Callable[[DataFrame], DataFrame], state: CorrelationState, checkpoint: str, every: int = 100) -> StreamingQuery:
    """Feeds a stream of positions into the state, a part for each micro-batch, merged after each `every` of them.

    sums_of gives the sums of a batch, such as corr.neuron_sums with an encoder. A micro-batch that is repeated after a
    failure has the same number, so it isn't added twice. Micro-batches without rows add nothing.
    """

    def add(rows: DataFrame, number: int) -> None:
        state.add(f"stream-{number}", sums_of(rows))
        if number % every == every - 1:
            state.compact()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

